"""Scores, classes and evidence of a record with features, as columns.

Input columns: the features, ``identity`` (of the best known hit), ``annotation_confidence``,
``cluster_size``, ``hit_id``, ``hit_annotation``, and for validation ``annotation``, ``evalue``, ``support``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.features import HISTIDINE, MEMBRANE_LEAST, METAL, STRENGTH
from residua.functions.residues import percent

#: Weights of the total, and the sentinel of a search without a hit.
NOVELTY_BIAS, CONFIDENCE_BIAS, LOAD_BIAS = 0.54, 0.28, 0.18
NO_HIT = "no Swiss-Prot hit"
LOW_COMPLEXITY = 0.42


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(value, F.lit(1.0)))


def with_scores(rows: DataFrame, novelty_bias: float = NOVELTY_BIAS, confidence_bias: float = CONFIDENCE_BIAS, load_bias: float = LOAD_BIAS) -> DataFrame:
    """Add novelty, confidence, machine_load, total and classification; terms are added from left to right."""
    size = F.col("cluster_size").cast("double")
    logged = F.log(F.greatest(size, F.lit(1.0)))
    motifs = F.size("motifs").cast("double")
    low = F.col("low_complexity")
    novelty = _unit(
        _unit(1.0 - F.col("identity")) * 0.46
        + _unit(1.0 - F.col("annotation_confidence")) * 0.34
        + F.least(motifs * 0.12, F.lit(0.24))
        + F.least(logged / F.log(F.lit(80.0)), F.lit(1.0)) * 0.16
        - F.when(low > LOW_COMPLEXITY, 0.16).otherwise(0.0)
    )
    n = F.col("length")
    sane = F.when(n.between(70, 520), 1.0).when(n.between(40, 69) | n.between(521, 760), 0.72).otherwise(0.42)
    motif_support = F.least(motifs * 0.18, F.lit(0.36))
    confidence = _unit(sane * 0.28 + F.col("entropy") * 0.28 + F.least(size / 40.0, F.lit(1.0)) * 0.28 + motif_support - low * 0.24)
    load = _unit(F.least(n / 600.0, F.lit(1.0)) * 0.48 + F.least(logged / F.log(F.lit(100.0)), F.lit(1.0)) * 0.34 + motif_support)
    factor = F.when(F.col("hit_id") == NO_HIT, F.when(size >= 4, 0.96).otherwise(0.88)).when(F.col("hit_annotation").isNull(), 0.94).otherwise(1.0)
    out = rows.withColumns({"novelty": novelty, "confidence": confidence, "machine_load": load})
    total = (F.col("novelty") * novelty_bias + F.col("confidence") * confidence_bias + F.col("machine_load") * load_bias) * factor
    return out.withColumns({"total": total, "classification": classification()})


def classification() -> Column:
    """The first class whose rule holds."""
    hit = F.lower(F.coalesce(F.col("hit_annotation"), F.lit("")))
    return (
        F.when(hit.contains("penicillin-binding protein"), "Remote PBP-like cell-wall enzyme candidate")
        .when(hit.contains("polyketide synthase"), "Remote polyketide-synthase-like candidate")
        .when(hit.rlike("transporter|permease"), "Remote membrane transport candidate")
        .when(F.array_contains("motifs", METAL) | F.array_contains("motifs", HISTIDINE), "Metalloenzyme-like orphan")
        .when(F.col("membrane_score") > MEMBRANE_LEAST, "Membrane-associated unknown")
        .when(F.col("low_complexity") > LOW_COMPLEXITY, "Low-complexity interaction candidate")
        .when((F.col("identity") < 0.22) & (F.col("annotation_confidence") < 0.30), "Remote-fold prospect")
        .otherwise("Annotation refinement target")
    )


def hypothesis() -> Column:
    """One sentence of advice per class."""
    kind = F.col("classification")
    return (
        F.when(kind.startswith("Remote PBP"), "Distant hit to a cell-wall enzyme; look for its catalytic motifs before renaming it.")
        .when(kind.startswith("Remote polyketide"), "Distant hit to polyketide chemistry; settle the domain borders first.")
        .when(kind.startswith("Remote membrane"), "The hit suggests transport; tell a transporter from plain hydrophobic stretches.")
        .when(kind.startswith("Metallo"), F.concat(F.lit("Weakly known, with "), F.array_join("motifs", ", "), F.lit("; test metal binding.")))
        .when(kind.startswith("Membrane"), "A hydrophobic stretch dominates; check that it spans a membrane.")
        .when(kind.startswith("Low-complexity"), "Unusual but repetitive; think of binding rather than of a folded enzyme.")
        .when(kind.startswith("Remote-fold"), "No close relative and no repeats; compare structures first.")
        .otherwise("Well enough known to calibrate against.")
    )


def qualifies() -> Column:
    """Whether a shortlisted record meets every threshold of validation."""
    weak = F.lower(F.coalesce(F.col("annotation"), F.lit(""))).rlike("uncharacterized|hypothetical")
    searched = (F.coalesce(F.col("evalue"), F.lit(1.7e308)) <= 1e-20) | (F.coalesce(F.col("support"), F.lit(0.0)) >= 0.035)
    return (
        weak & F.col("classification").startswith("Remote ") & (F.col("novelty") >= 0.85) & (F.col("confidence") >= 0.65)
        & F.col("identity").between(0.15, 0.40) & F.col("hit_annotation").isNotNull() & searched
    )


#: The kinds of evidence by title; motifs and all else are structure.
KINDS = {"Known hit identity": "novelty", "Annotation confidence": "novelty", "Best known hit": "novelty", "Composite novelty": "novelty", "Estimated compute value": "machineLoad", "Low-complexity warning": "caution"}
NOTES = {
    "Known hit identity": "the lower, the further from anything known", "Annotation confidence": "how far the stored name is trusted", "Sequence entropy": "how evenly the residues are used",
    "Estimated compute value": "how much there is to compute", "Low-complexity warning": "repeats and dominant residues can feign a signal", "Composite novelty": "identity, name, motifs and cluster together",
    "Composite confidence": "length, entropy, cluster and motifs together", "Best known hit": "closest record of the reference",
}


def evidence() -> Column:
    """Array of (ordinal, kind, title, value, weight, note), heaviest first; ties keep the order in which they are listed."""

    def item(title: Column, value: Column, weight: Column) -> Column:
        return F.struct(title.alias("title"), value.alias("value"), weight.cast("double").alias("weight"))

    def scored(title: str, value: Column, weight: Column | None = None) -> Column:
        return item(F.lit(title), percent(value), value if weight is None else weight)

    identity, annotated = F.col("identity"), F.col("annotation_confidence")
    fixed = [
        scored("Known hit identity", identity, 1.0 - identity), scored("Annotation confidence", annotated, 1.0 - annotated),
        scored("Sequence entropy", F.col("entropy")), scored("Estimated compute value", F.col("machine_load")),
    ]
    strength = F.create_map(*[F.lit(x) for pair in STRENGTH.items() for x in pair])
    motifs = F.transform("motifs", lambda m: item(m, percent(strength[m]), strength[m]))
    low = F.when(F.col("low_complexity") > LOW_COMPLEXITY, scored("Low-complexity warning", F.col("low_complexity")))
    hit = F.when(F.col("hit_id").isNotNull(), item(F.lit("Best known hit"), F.col("hit_id"), 1.0 - identity))
    rest = [low, scored("Composite novelty", F.col("novelty")), scored("Composite confidence", F.col("confidence")), hit]
    listed = F.filter(F.concat(F.array(*fixed), motifs, F.array(*rest)), lambda x: x.isNotNull())
    kinds, notes = (F.create_map(*[F.lit(x) for pair in table.items() for x in pair]) for table in (KINDS, NOTES))

    def placed(x: Column, i: Column) -> Column:
        kind, note = F.coalesce(kinds[x["title"]], F.lit("structure")), F.coalesce(notes[x["title"]], F.lit("pattern of residues"))
        return F.struct((-x["weight"]).alias("order"), i.alias("ordinal"), kind.alias("kind"), x["title"].alias("title"), x["value"].alias("value"), x["weight"].alias("weight"), note.alias("note"))

    return F.transform(F.array_sort(F.transform(listed, placed)), lambda x: x.dropFields("order"))


def domain_evidence(domains: Column, most: int = 3) -> Column:
    """The ``most`` strongest of an array of domains (name, accession, bits, independent_evalue, from, to, coverage, ordinal) as evidence of weight 0."""
    ordered = F.transform(domains, lambda d: F.struct((-d["bits"]).alias("o"), d["ordinal"].alias("k"), d.alias("d")))
    strongest = F.slice(F.array_sort(ordered), 1, most)

    def item(x: Column) -> Column:
        d = x["d"]
        note = F.concat(
            F.format_string("bit score %.1f, i-E-value %.1e, residues ", d["bits"], d["independent_evalue"]), d["from"].cast("string"), F.lit("-"), d["to"].cast("string"), F.lit(", "),
            percent(d["coverage"]), F.lit(" of the profile; advisory, scores are unchanged"),
        )
        return F.struct(F.lit("domain").alias("kind"), F.concat(F.lit("Pfam domain "), d["name"]).alias("title"), d["accession"].alias("value"), F.lit(0.0).alias("weight"), note.alias("note"))

    return F.transform(strongest, item)
