"""From a FASTA file to a validated shortlist: read, cluster, search, score, rank, annotate, report."""

from __future__ import annotations

import dataclasses
import datetime
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions import features as fx
from residua.functions import residues as rx
from residua.functions import scoring
from residua.operators import search
from residua.sources import fasta, host, tables


@dataclasses.dataclass
class Options:
    """What a run may be told; biases and thresholds default to the fixed values of scoring and search."""

    most: int = 8
    dataset: str = ""
    novelty_bias: float = scoring.NOVELTY_BIAS
    confidence_bias: float = scoring.CONFIDENCE_BIAS
    load_bias: float = scoring.LOAD_BIAS
    cluster_threshold: float = 0.38
    k: int = 4
    candidates_per_query: int = 3
    reference_filter: bool = True
    mmseqs_hits: str | None = None
    domains: str | None = None
    domain_evalue: float | None = None
    summary_model: str | None = None
    summarize: Callable[[str, str], str] | None = None


CRITERIA = (
    "the annotation is uncharacterized or hypothetical", "the class is a remote function", "novelty of 0.85 or more", "confidence of 0.65 or more",
    "identity to the known hit of 0.15 to 0.40", "the hit has an annotation", "an e-value of 1e-20 or less, or a k-mer support of 0.035 or more",
)
DISCLAIMER = "Wording of a local language model; it changed no score."


def searched(spark: SparkSession, rows: DataFrame, reference: str | None, options: Options, folder: str, notes: list[str]) -> DataFrame:
    """Rows (id, record_ordinal, sequence, motifs, ...) with what is known of them in a reference."""
    if reference is None:
        notes.append("no reference was searched; identities are assumed")
        none = {c: F.lit(None).cast(kind) for c, kind in (("hit_id", "string"), ("hit_annotation", "string"), ("hit_organism", "string"), ("evalue", "double"), ("bits", "double"), ("method", "string"), ("support", "double"))}
        return rows.withColumns({"identity": F.col("knownhitidentity"), **none})
    if options.mmseqs_hits:
        hits = tables.best_hits(tables.read_hits(spark, options.mmseqs_hits)).select(F.col("query").alias("id"), rx.accession(F.col("target")).alias("hit_id"), "identity", "evalue", "bits")
        notes.append(f"hits of an external search taken from {Path(options.mmseqs_hits).name}")
        return search.apply_mmseqs(rows, hits, fasta.header_index(fasta.read_fasta(spark, reference, "lenient")))
    known = fasta.discovery_subset(spark, reference, f"{folder}/references") if options.reference_filter else fasta.read_fasta(spark, reference, "lenient")
    known = known.withColumn("target", F.struct("source_path", "record_ordinal"))
    asked = rows.select(F.col("record_ordinal").alias("query"), F.col("sequence").alias("residues"), F.array_contains("motifs", fx.CELL_WALL).alias("cell_wall"))
    found = search.seed_search(asked, known.select("target", F.col("sequence").alias("residues"), "header"), options.k).join(known.select("target", "header"), "target")
    found = found.select(F.col("query").alias("record_ordinal"), rx.accession(F.col("header")).alias("hit_id"), "identity", "support", (F.col("shared") * options.k).alias("bits"))
    notes.append("nearest references found by shared k-mers" + (" among headers that name a function" if options.reference_filter else ""))
    return search.apply_native(rows, search.hit_per_id(found, rows, "record_ordinal"), fasta.header_index(known))


def ranked(rows: DataFrame, options: Options) -> DataFrame:
    """The first ``most`` rows by total, then id, then place in the input, with rank, evidence and hypothesis."""
    scores = scoring.with_scores(rows, options.novelty_bias, options.confidence_bias, options.load_bias)
    order = (F.desc("total"), F.asc("id"), F.asc("record_ordinal"))
    top = scores.orderBy(*order).limit(options.most)
    # The window sees the rows of the limit only.
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return top.withColumns({"evidence": scoring.evidence(), "hypothesis": scoring.hypothesis(), "qualifies": scoring.qualifies()})


def with_domains(top: DataFrame, domains: DataFrame, ident: str = "id") -> DataFrame:
    """The shortlist with its domains (array, strongest first) and the three strongest as evidence behind the rest; no score changes."""
    fields = ("name", "accession", "description", "full_evalue", "independent_evalue", "bits", "from", "to", "coverage", "ordinal")
    mine = domains.join(F.broadcast(top.select(F.col(ident).alias("query")).distinct()), "query")
    mine = mine if "ordinal" in domains.columns else mine.withColumn("ordinal", F.monotonically_increasing_id())
    held = mine.groupBy("query").agg(F.collect_list(F.struct(*fields)).alias("found"))
    joined = top.join(held.withColumnRenamed("query", ident), ident, "left")
    empty = F.array().cast("array<struct<name:string,accession:string,description:string,full_evalue:double,independent_evalue:double,bits:double,from:bigint,to:bigint,coverage:double,ordinal:bigint>>")
    return joined.withColumn("domains", F.coalesce("found", empty)).withColumn("domain_evidence", scoring.domain_evidence(F.col("domains"))).drop("found")


def domain_totals(top: DataFrame) -> tuple[int, int]:
    """Domains of the shortlist, and how many of its records have one."""
    row = top.agg(F.sum(F.size("domains")).alias("hits"), F.count_if(F.size("domains") > 0).alias("with_one")).first()
    return row.hits or 0, row.with_one


def validation(candidates: list[dict]) -> dict:
    """Whether any candidate of a shortlist qualifies, and which."""
    ids = [c["sequence"]["id"] for c in candidates if c["qualifies"]]
    return {"passed": bool(ids), "summary": f"{len(ids)} candidates met every threshold" if ids else "no candidate met every threshold", "qualifyingCandidateIDs": ids, "criteria": list(CRITERIA)}


def select_candidate(candidates: list[dict]) -> dict | None:
    """The first candidate of a remote class whose hit is a record and not the sign of none."""
    return next((c for c in candidates if c["classification"].startswith("Remote ") and c["sequence"].get("bestKnownHitID") and "no " not in c["sequence"]["bestKnownHitID"]), None)


def summary_prompt(run: dict) -> str:
    """What a language model may be asked to put into words: numbers of the first five candidates, nothing else."""
    lines = ["Put the numbers below into plain prose of 150 words at most. Claim nothing that they do not say.", "", f"Dataset: {run['configuration']['datasetName']}", f"Candidates: {len(run['candidates'])}"]
    tools = [t["executable"] for t in run["toolStatuses"] if t["available"]]
    lines.append(f"Tools: {', '.join(tools) or 'none'}")
    for c in run["candidates"][:5]:
        s = c["sequence"]
        lines += ["", f"#{c['rank']} {s['id']}: {c['classification']}", f"  annotation {s['annotation']}, organism {s['organism']}", f"  novelty {c['noveltyScore']:.0%}, confidence {c['confidenceScore']:.0%}, identity {s['knownHitIdentity']:.0%}"]
        if s.get("bestKnownHitAnnotation"):
            lines.append(f"  nearest: {s['bestKnownHitAnnotation']}")
        if c["domains"]:
            lines.append("  domains: " + ", ".join(f"{d['name']} ({d['accession']})" for d in c["domains"][:3]))
    return "\n".join([*lines, "", f"Validation: {run['validation']['summary']}"])


def _candidate(row: dict) -> dict:
    names = {"knownHitIdentity": "identity", "clusterSize": "cluster_size", "annotationConfidence": "annotation_confidence", "bestKnownHitID": "hit_id", "bestKnownHitAnnotation": "hit_annotation",
        "bestKnownHitOrganism": "hit_organism", "bestKnownHitEValue": "evalue", "bestKnownHitBitScore": "bits", "bestKnownHitMethod": "method", "bestKnownHitSupport": "support"}
    sequence = {"id": row["id"], "organism": row["organism"], "annotation": row["annotation"], "source": row["source"], "sequence": row["sequence"]} | {k: row[v] for k, v in names.items()}
    features = {k: row[k] for k in ("length", "hydrophobic_ratio", "charged_ratio", "cysteine_ratio", "aromatic_ratio", "entropy", "low_complexity", "membrane_score", "motifs")}
    evidence = [{k: e[k] for k in ("kind", "title", "value", "weight", "note")} for e in [*row["evidence"], *row["domain_evidence"]]]
    domains = sorted(row["domains"], key=lambda d: (-d["bits"], d["ordinal"]))
    return {
        "id": f"{row['id']}#{row['record_ordinal']}", "rank": row["rank"], "classification": row["classification"], "noveltyScore": row["novelty"], "confidenceScore": row["confidence"], "machineLoadScore": row["machine_load"],
        "total": row["total"], "hypothesis": row["hypothesis"], "qualifies": row["qualifies"], "sequence": sequence, "features": features, "evidence": evidence, "domains": domains,
    }


def run(spark: SparkSession, path: str, reference: str | None, output: str, options: Options | None = None) -> dict:
    """The whole pipeline over one input; gives the run (candidates, notes, tools, validation) whose files ``reports`` writes.

    Domains and wording are extras: what goes wrong with them becomes a note and changes no score.
    """
    options = options or Options()
    records = fasta.read_fasta(spark, path)
    notes = [f"input of {Path(path).name} read", *fasta.require(records)]
    rows = fasta.proteins(records, path)
    sizes = search.cluster_sizes(rows, "record_ordinal", "sequence", options.cluster_threshold).withColumnRenamed("id", "record_ordinal")
    rows = fx.with_features(rows.join(sizes, "record_ordinal"), "sequence").withColumn("annotation_confidence", F.col("annotationconfidence"))
    rows = searched(spark, rows, reference, options, output, notes)
    top = ranked(rows, options).cache()
    statuses = host.tool_statuses()
    if options.domains:
        try:
            found = tables.read_domains(spark, options.domains)
            if options.domain_evalue is not None:
                found = found.where(F.col("independent_evalue") <= options.domain_evalue)
            top = with_domains(top, found).cache()
            hits, having = domain_totals(top)
            notes.append(f"{hits} domains on {having} of {top.count()} candidates; advisory, no score changed")
        except Exception as error:  # an extra never fails a run
            notes.append(f"domains left out: {type(error).__name__}")
    if "domains" not in top.columns:
        top = with_domains(top, spark.createDataFrame([], "query string, name string, accession string, description string, full_evalue double, independent_evalue double, bits double, from long, to long, coverage double"))
    candidates = [_candidate(r.asDict(recursive=True)) for r in top.orderBy("rank").collect()]
    config = {"datasetName": options.dataset or Path(path).stem, "maximumCandidates": options.most, "noveltyBias": options.novelty_bias, "confidenceBias": options.confidence_bias, "machineLoadBias": options.load_bias}
    done = {
        "startedAt": datetime.datetime.now(datetime.timezone.utc).isoformat(), "configuration": config, "candidates": candidates, "toolStatuses": statuses,
        "notes": [*notes, *host.tool_notes(statuses)], "validation": validation(candidates), "advisorySummary": None,
    }
    if options.summary_model:
        try:
            if options.summarize is None:
                raise LookupError("no model is at hand")
            done["advisorySummary"] = {"text": options.summarize(options.summary_model, summary_prompt(done)), "model": options.summary_model, "disclaimer": DISCLAIMER}
        except Exception as error:
            done["notes"].append(f"wording left out: {error}")
    return done
