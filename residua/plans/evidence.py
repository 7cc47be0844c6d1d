"""Queries of the pipeline, the ledger's contract and the queue, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions import residues as rx
from residua.functions import scoring
from residua.operators import admission, ledger, search, structure
from residua.plans import catalog, pipeline, queue
from residua.sources import fasta, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
read = catalog.read


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def fasta_parsed(spark, folder):
    """Proteins written as FASTA with comments, indented headers and alignment gaps, and read back."""
    rows = read(spark, folder, "proteins").where("sequence is not null and id is not null")
    entry = F.concat(F.lit(">"), "id", F.lit(" protein OS=Some OX=1\r\n;note\r\n "), rx.wrapped(rx.clean_sequence(F.col("sequence")), 60), F.lit("-\r\n\r\n  >second "), "id", F.lit("\nACD*\n"))
    parts = fasta.split_records(rows.select("record_ordinal", entry.alias("value")), indented=True)
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith(";"))
    report = rx.cleaning_report(F.array_join(lines, ""))
    h = F.col("header")
    return parts.select("record_ordinal", F.col("_k").cast("int").alias("part"), rx.accession(h).alias("accession"), rx.organism_name(h).alias("organism"), report["residues"].alias("residues"), report["gaps"].alias("gaps"), report["stop_trimmed"].alias("stop_trimmed"))


@query
def subset_reference(spark, folder):
    rows = read(spark, folder, "reference_headers")
    header = F.concat_ws(" ", "id", "annotation")
    return rows.where(rx.is_informative_reference(header)).select("header_ordinal", "id")


def _names(spark, folder) -> DataFrame:
    return catalog.header_index(spark, folder).select("id", "annotation", "organism")


@query
def native_applied(spark, folder):
    """Every protein with its best native hit by support, or the sign of none."""
    hits = read(spark, folder, "native_hits").where("targetid is not null and supportscore is not null and not isnan(supportscore)")
    hits = hits.select(rx.accession(F.col("queryid")).alias("id"), rx.accession(F.col("targetid")).alias("hit_id"), F.col("supportscore").alias("support"), F.coalesce(F.nanvl("identity", F.lit(0.0)), F.lit(0.0)).alias("identity"), F.coalesce("alignmentscore", F.lit(0)).alias("bits"))
    best = search.best_hits(hits, "id", "support", "hit_id", "identity", "bits")
    rows = search.apply_native(read(spark, folder, "proteins").select("record_ordinal", "id"), best, _names(spark, folder))
    return rows.select("record_ordinal", "id", "hit_id", "hit_annotation", "hit_organism", F.round("identity", 6).alias("identity"), "bits", "method", F.round("support", 6).alias("support"))


@query
def mmseqs_applied(spark, folder):
    """Every protein with its best external hit by bit score, or the sign of none."""
    hits = read(spark, folder, "mmseqs_hits").where("targetid is not null")
    plain = [F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(n) for c, n in (("identity", "identity"), ("evalue", "evalue"), ("bitscore", "bits"))]
    hits = hits.select(rx.accession(F.col("queryid")).alias("id"), rx.accession(F.col("targetid")).alias("hit_id"), *plain)
    best = search.best_hits(hits, "id", "bits", "hit_id", "evalue", "identity")
    rows = search.apply_mmseqs(read(spark, folder, "proteins").select("record_ordinal", "id"), best, _names(spark, folder))
    return rows.select("record_ordinal", "id", "hit_id", F.round("identity", 6).alias("identity"), "evalue", "bits", "method")


def _domains(spark, folder) -> DataFrame:
    """Hits in the place of domains: each target once per query, with its highest score."""
    hits = read(spark, folder, "mmseqs_hits").where("queryid is not null and targetid is not null and bitscore is not null and not isnan(bitscore)")
    once = hits.groupBy(rx.accession(F.col("queryid")).alias("query"), rx.accession(F.col("targetid")).alias("name")).agg(F.max("bitscore").alias("bits"), F.max("alignmentlength").alias("to"))
    null = F.lit(None)
    return once.select("query", "name", F.concat(F.lit("D."), "name").alias("accession"), null.cast("string").alias("description"), null.cast("double").alias("full_evalue"), F.lit(1e-9).alias("independent_evalue"), "bits",
        F.lit(1).cast("long").alias("from"), F.coalesce("to", F.lit(0)).cast("long").alias("to"), F.lit(0.5).alias("coverage"), F.lit(0).cast("long").alias("ordinal"))


def _with_domains(spark, folder) -> DataFrame:
    return pipeline.with_domains(catalog._shortlist(spark, folder), _domains(spark, folder))


@query
def domain_evidence(spark, folder):
    """The strongest domain of every shortlisted record, behind the other evidence and without weight."""
    rows = _with_domains(spark, folder).select("record_ordinal", F.posexplode("domain_evidence").alias("place", "e"))
    strongest = rows.where("place = 0")
    return strongest.select("record_ordinal", "e.kind", "e.weight", F.startswith("e.title", F.lit("Pfam domain ")).alias("titled"), F.regexp_extract("e.note", r"bit score ([0-9.]+)", 1).alias("bits"))


@query
def domain_totals(spark, folder):
    rows = _with_domains(spark, folder).select("record_ordinal", F.size("domains").cast("long").alias("domains"), F.size("domain_evidence").cast("long").alias("shown"))
    return rows


@query
def evidence_shown(spark, folder):
    """The first eight pieces of evidence of each shortlisted record."""
    return catalog.evidence_ranked(spark, folder).where("place <= 8").select("record_ordinal", "place", "title")


@query
def selected_candidate(spark, folder):
    rows = catalog._shortlist(spark, folder).where(F.col("classification").startswith("Remote ") & F.col("hit_id").isNotNull() & ~F.col("hit_id").contains("no "))
    return rows.orderBy(F.desc("key"), F.asc("id"), F.asc("record_ordinal")).limit(1).select("record_ordinal", "id", "classification", "hit_id")


@query
def payload_check(spark, folder):
    """Why each ledger row would be refused as a job."""
    return read(spark, folder, "processed").select("record_ordinal", queue.payload_problem(F.col("accession"), F.col("sequence"), F.col("seq_sha256")).alias("problem"))


@query
def exactly_one(spark, folder):
    """Accessions that name one ledger row, and so may be asked for alone."""
    found = read(spark, folder, "processed").where("accession is not null").groupBy("accession").agg(F.count(F.lit(1)).alias("n"), F.min("record_ordinal").alias("record_ordinal"))
    return found.where("n = 1").select("accession", "record_ordinal")


@query
def subset_gate(spark, folder):
    """Per plan: which of its sources the documents lack in plain spelling, and whether the gate opens."""
    have = read(spark, folder, "documents").where("source is not null").agg(F.collect_set("source").alias("have"))  # one value per source name
    want = read(spark, folder, "mix_targets").groupBy("plan_id").agg(F.collect_set("source").alias("want"))
    missing = F.array_except("want", "have")
    return want.join(F.broadcast(have)).select("plan_id", F.size(missing).cast("long").alias("missing"), (F.size(missing) == 0).alias("opens"))


@query
def ledger_enriched(spark, folder):
    """Every protein with what the ledger says last of its accession."""
    rows = read(spark, folder, "processed").where("accession is not null")
    last = rows.groupBy("accession").agg(F.max_by(F.struct("verdict", "score", "classification"), "record_ordinal").alias("l"))
    joined = read(spark, folder, "proteins").select("record_ordinal", F.col("id").alias("accession")).join(last, "accession", "left")
    return joined.select("record_ordinal", F.coalesce("l.verdict", F.lit("screened")).alias("verdict"), "l.score", "l.classification")


def _stage_results(spark, folder) -> DataFrame:
    """Ledger rows in the place of job results: the stage by cycle, failed where there is no score."""
    backend = F.expr("case first_seen_cycle % 3 when 0 then 'esmfold' when 1 then 'openmm' else 'vina' end")
    status = F.when(F.col("score").isNull(), "failed").otherwise("ok")
    length = F.coalesce(F.length(rx.clean_sequence(F.col("sequence"))), F.lit(0)).cast("long")
    rows = read(spark, folder, "processed").where("accession is not null and first_seen_cycle is not null")
    return rows.select("accession", backend.alias("backend"), status.alias("status"), F.col("classification").alias("metrics"), F.col("record_ordinal").alias("ordinal"), length.alias("length"))


@query
def stage_evidence(spark, folder):
    results = _stage_results(spark, folder)
    model = read(spark, folder, "alphafold_cache").select(F.regexp_extract("modelentityid", "^AF-(.*)-F1$", 1).alias("accession"), "globalmetricvalue").where("accession <> ''")
    source = F.when(F.max(F.nanvl("globalmetricvalue", F.lit(0.0))) >= 90, "local-folding-backend").otherwise("alphafold-cache")
    return queue.evidence_rows(results.select("accession"), model.groupBy("accession").agg(source.alias("source")), results)


def memory_column(backend, length):
    """``admission.memory_of`` as a column."""
    flat = F.create_map(*[F.lit(x) for name, gib in admission.MEMORY.items() for x in (name, int(gib * admission.GIB))])
    fold = F.lit(admission.FOLD_MEMORY * admission.GIB) + length * length * admission.FOLD_BYTES
    return F.when(backend == "esmfold", fold).otherwise(F.coalesce(flat[backend], F.lit(int(admission.OTHER_MEMORY * admission.GIB)))).cast("long")


@query
def queue_counts(spark, folder):
    rows = _stage_results(spark, folder)
    return queue.result_counts(rows.withColumn("memory", memory_column(F.col("backend"), F.col("length"))))


@query
def backend_memory(spark, folder):
    """Bytes that a job on each protein would take, by backend."""
    names = F.array(*map(F.lit, ("mmseqs", "hmmer", "foldseek", "vina", "esmfold", "openmm", "another")))
    rows = read(spark, folder, "proteins").where("sequence is not null").select("record_ordinal", F.explode(names).alias("backend"), F.length(rx.clean_sequence(F.col("sequence"))).cast("long").alias("n"))
    return rows.select("record_ordinal", "backend", memory_column(F.col("backend"), F.col("n")).alias("bytes"))


@query
def model_confidence(spark, folder):
    """Mean, least and greatest confidence of each model over its versions, fractions as percentages."""
    rows = read(spark, folder, "alphafold_cache").where("modelentityid is not null and globalmetricvalue is not null and not isnan(globalmetricvalue)")
    scaled = rows.select(F.col("modelentityid").alias("source_path"), F.when(F.col("latestversion") % 2 == 0, F.col("globalmetricvalue") / 100).otherwise(F.col("globalmetricvalue")).alias("confidence"))
    found = tables.confidence_summary(tables.percent_confidence(scaled))
    return found.select(F.col("source_path").alias("modelentityid"), *[F.round(c, 6).alias(c) for c in ("mean", "least", "greatest")])


@query
def newest_model(spark, folder):
    """The newest model of each accession by date, then path."""
    rows = read(spark, folder, "alphafold_cache").where("modelentityid is not null and modelcreateddate is not null and pdbpath is not null")
    best = rows.groupBy("modelentityid").agg(F.max(F.struct("modelcreateddate", "pdbpath", "record_ordinal")).alias("m"))
    return best.select("modelentityid", "m.pdbpath", "m.record_ordinal")


@query
def first_reasons(spark, folder):
    """Distinct verdicts and classes in the order in which each first occurs, twelve at most."""
    firsts = read(spark, folder, "processed").groupBy("verdict", "classification").agg(F.min("record_ordinal").alias("first"))
    return firsts.orderBy("first").limit(12)


@query
def new_actionable(spark, folder):
    """The actionable entries that each cycle saw first, with the payload they are handed on with."""
    rows = ledger.first_seen(read(spark, folder, "processed"), "seq_sha256", "record_ordinal", "accession", "verdict", "first_seen_cycle", "sequence")
    return rows.where("verdict = 'actionable'").select("record_ordinal", "first_seen_cycle", "accession", "digest", F.col("sequence").isNotNull().alias("exportable"))


@query
def iso_stamp(spark, folder):
    rows = read(spark, folder, "alphafold_cache").where("modelcreateddate is not null")
    return rows.select("record_ordinal", F.date_format("modelcreateddate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query
def json_defaults(spark, folder):
    """Records through JSON and back into a schema with a field that older ones lack."""
    rows = read(spark, folder, "reference_headers").select("header_ordinal", F.to_json(F.struct("id", "annotation", "organism")).alias("j"))
    back = rows.select("header_ordinal", F.from_json("j", "id string, annotation string, organism string, domains array<string>").alias("r"))
    return back.select("header_ordinal", "r.id", "r.annotation", "r.organism", F.size(F.coalesce("r.domains", F.array().cast("array<string>"))).cast("long").alias("domains"))


@query
def structure_pairs(spark, folder):
    """Every 50th record of the cache against the next one by ordinal, residues as points on a chain: coverage, agreement of distances, verdict."""
    rows = read(spark, folder, "alphafold_cache").where("sequence is not null").select("record_ordinal", rx.clean_sequence(F.col("sequence")).alias("s")).where(F.length("s") >= 2)
    follow = rows.alias("q").where("record_ordinal % 50 = 0").join(rows.alias("t"), F.col("t.record_ordinal") == F.col("q.record_ordinal") + 1)
    both = follow.select(F.col("q.record_ordinal").alias("pair"), F.col("q.s").alias("q"), F.col("t.s").alias("t"))
    n = F.least(F.length("q"), F.length("t"))
    points = both.select("pair", "q", "t", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))

    def place(side: str):
        code = F.ascii(F.substring(side, F.col("i") + 1, F.lit(1)))
        return [(F.col("i") * 1.5).alias(f"{side}x"), (code % 7).cast("double").alias(f"{side}y"), (code % 5).cast("double").alias(f"{side}z")]

    found = structure.distance_map_scores(points.select("pair", "i", *place("q"), *place("t")))
    sized = both.select("pair", n.alias("shorter"))
    coverage, passed = structure.verdict(F.col("points"), F.col("shorter"), F.col("score"))
    return found.join(sized, "pair").select("pair", "points", F.round("score", 6).alias("score"), coverage.alias("coverage"), passed.alias("passed"))


@query
def seed_candidates(spark, folder):
    """The three best models of every protein whose ordinal is divisible by 50."""
    asked = catalog._featured(spark, folder).where("record_ordinal % 50 = 0").select(F.col("record_ordinal").alias("query"), "residues", F.lit(False).alias("cell_wall"))
    known = read(spark, folder, "alphafold_cache").where("sequence is not null")
    known = known.select(F.col("record_ordinal").alias("target"), rx.clean_sequence(F.col("sequence")).alias("residues"), F.lit("").alias("header"))
    found = search.seed_search(asked, known, candidates=3)
    return found.select("query", "place", "target", "shared", F.round("support", 6).alias("support"))


@query
def hypotheses(spark, folder):
    """The advice that each class of the shortlist stands for: whether there is one, and whether it names the motifs."""
    rows = catalog._shortlist(spark, folder).withColumn("h", scoring.hypothesis())
    named = F.when(F.col("classification").startswith("Metallo"), F.col("h").contains(F.array_join("motifs", ", "))).otherwise(F.lit(True))
    return rows.select("record_ordinal", (F.length("h") > 20).alias("said"), named.alias("named"))


@query
def cycle_ranks(spark, folder):
    """Actionable entries of each cycle by score, then accession, then ordinal."""
    rows = read(spark, folder, "processed").where("verdict = 'actionable'")
    order = Window.partitionBy("first_seen_cycle").orderBy(F.desc_nulls_last("score"), F.asc("accession"), F.asc("record_ordinal"))
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("record_ordinal", "first_seen_cycle", "place")
