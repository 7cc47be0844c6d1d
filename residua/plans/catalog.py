"""Queries of the engine's own operators, each with its SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import features as fx
from residua.functions import residues as rx
from residua.functions import scoring
from residua.operators import ledger, search, structure
from residua.plans import statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _six(column: str):
    return F.round(column, 6).alias(column)


@query
def residue_clean(spark, folder):
    rows = read(spark, folder, "processed").where("sequence is not null")
    return rows.select("record_ordinal", *[c.alias(name) for name, c in rx.cleaning_report(F.col("sequence")).items()])


@query
def cleaning_totals(spark, folder):
    rows = residue_clean(spark, folder)
    return rows.agg(
        F.count(F.lit(1)).alias("records"), F.sum((F.col("gaps") > 0).cast("long")).alias("gapped"), F.sum("gaps").alias("gaps"),
        F.sum(F.col("stop_trimmed").cast("long")).alias("stops"), F.sum("ambiguous").alias("ambiguous"),
        F.sum(rx.looks_like_nucleotide(F.col("residues")).cast("long")).alias("nucleotide"), F.count("problem").alias("problems"),
    )


@query
def duplicate_ids(spark, folder):
    groups = read(spark, folder, "proteins").where("id is not null").groupBy("id")
    return groups.agg(F.count(F.lit(1)).alias("records")).where("records > 1")


@query
def header_parse(spark, folder):
    rows = read(spark, folder, "reference_headers")
    organism = F.when(F.col("organism").isNotNull(), F.concat(F.lit(" OS="), "organism", F.lit(" OX=9"))).otherwise("")
    header = F.concat(F.lit("db|"), "id", F.lit("|X "), F.coalesce("annotation", F.lit("")), organism)
    rows = rows.select("header_ordinal", header.alias("h"))
    name = rx.annotation_name(F.col("h"))
    return rows.select(
        "header_ordinal", rx.accession(F.col("h")).alias("accession"), name.alias("annotation"), rx.organism_name(F.col("h")).alias("organism"),
        rx.annotation_confidence(name).alias("confidence"), rx.is_informative_reference(F.col("h")).alias("informative"),
    )


@query
def header_index(spark, folder):
    return search.last_header(read(spark, folder, "reference_headers"), "id", "header_ordinal")


def _featured(spark, folder) -> DataFrame:
    rows = read(spark, folder, "proteins").where("sequence is not null").withColumn("residues", rx.clean_sequence(F.col("sequence")))
    return fx.with_features(rows, "residues")


def _scored(spark, folder) -> DataFrame:
    rows = _featured(spark, folder).select(
        "record_ordinal", "id", "annotation", "length", "entropy", "low_complexity", "membrane_score", "motifs", F.col("knownhitidentity").alias("identity"),
        F.col("annotationconfidence").alias("annotation_confidence"), F.col("clustersize").alias("cluster_size"), F.col("bestknownhitid").alias("hit_id"),
        F.col("bestknownhitannotation").alias("hit_annotation"), F.col("bestknownhitevalue").alias("evalue"), F.col("bestknownhitsupport").alias("support"),
    )
    return scoring.with_scores(rows)


@query
def features(spark, folder):
    ratios = ["hydrophobic_ratio", "charged_ratio", "cysteine_ratio", "aromatic_ratio", "entropy", "low_complexity", "membrane_score"]
    return _featured(spark, folder).select("record_ordinal", "length", *map(_six, ratios), F.array_join("motifs", "; ").alias("motifs"))


@query
def scores(spark, folder):
    return _scored(spark, folder).select("record_ordinal", *map(_six, ["novelty", "confidence", "machine_load", "total"]), "classification")


def _shortlist(spark, folder) -> DataFrame:
    top = _scored(spark, folder).withColumn("key", F.round("total", 9))
    return top.orderBy(F.desc("key"), F.asc("id"), F.asc("record_ordinal")).limit(20)


@query
def rank_top(spark, folder):
    from pyspark.sql import Window

    # The window sees the twenty rows of the limit only.
    rank = F.row_number().over(Window.orderBy(F.desc("key"), F.asc("id"), F.asc("record_ordinal")))
    return _shortlist(spark, folder).select(rank.cast("long").alias("rank"), "id", "record_ordinal", _six("total"), "classification")


@query
def validated(spark, folder):
    return _shortlist(spark, folder).select("id", "record_ordinal", scoring.qualifies().alias("qualifies"))


@query
def evidence_ranked(spark, folder):
    rows = _shortlist(spark, folder).select("record_ordinal", F.posexplode(scoring.evidence()).alias("place", "e"))
    return rows.select("record_ordinal", (F.col("place") + 1).alias("place"), F.col("e.title").alias("title"), F.col("e.value").alias("value"), F.round("e.weight", 6).alias("weight"))


@query
def kmer_counts(spark, folder):
    rows = read(spark, folder, "proteins").where("sequence is not null")
    residues = search.standard_only(rx.clean_sequence(F.col("sequence")))
    return rows.select("record_ordinal", F.size(search.packed_kmers(residues, 4)).alias("kmers"))


@query
def seed_search(spark, folder):
    """Every protein whose ordinal is divisible by 50, against all cached models."""
    asked = _featured(spark, folder).where("record_ordinal % 50 = 0")
    asked = asked.select(F.col("record_ordinal").alias("query"), "residues", F.array_contains("motifs", fx.CELL_WALL).alias("cell_wall"))
    known = read(spark, folder, "alphafold_cache").where("sequence is not null")
    known = known.select(F.col("record_ordinal").alias("target"), rx.clean_sequence(F.col("sequence")).alias("residues"), F.col("uniprotdescription").alias("header"))
    return search.seed_search(asked, known).select("query", "target", "shared", *map(_six, ["support", "ranking", "identity"]))


@query
def cluster_sizes(spark, folder):
    rows = read(spark, folder, "proteins").select("record_ordinal", rx.clean_sequence(F.col("sequence")).alias("residues"))
    return search.cluster_sizes(rows, "record_ordinal", "residues").withColumnRenamed("id", "record_ordinal")


def _best_hits(spark, folder) -> DataFrame:
    hits = read(spark, folder, "mmseqs_hits").where("targetid is not null").withColumn("query", rx.accession(F.col("queryid")))
    hits = hits.withColumn("target", rx.accession(F.col("targetid"))).withColumn("bits", F.nanvl(F.coalesce("bitscore", F.lit(0.0)), F.lit(0.0)))
    hits = hits.withColumn("e", F.nanvl(F.coalesce("evalue", F.lit(1.7e308)), F.lit(1.7e308)))
    return search.best_hits(hits, "query", "bits", "target", "e", "loaded_at", "cycle")


@query
def best_hit(spark, folder):
    return _best_hits(spark, folder).select("query", "target", "bits")


@query
def enriched(spark, folder):
    hits = _best_hits(spark, folder).select(F.col("query").alias("id"), F.col("target").alias("hit_id"), "bits")
    names = header_index(spark, folder).select(F.col("id").alias("hit_id"), F.col("annotation").alias("hit_annotation"), F.col("organism").alias("hit_organism"))
    rows = read(spark, folder, "proteins").select("record_ordinal", "id").join(hits, "id", "left").join(names, "hit_id", "left")
    return rows.select("record_ordinal", "id", F.coalesce("hit_id", F.lit(scoring.NO_HIT)).alias("hit_id"), "hit_annotation", "hit_organism", "bits")


@query
def hit_lines(spark, folder):
    rows = read(spark, folder, "native_hits").where("queryid is not null and targetid is not null and identity is not null and not isnan(identity)")
    return rows.select(F.format_string("%s\t%s\t%.4f", "queryid", "targetid", "identity").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def latest_model(spark, folder):
    rows = read(spark, folder, "alphafold_cache").where("modelentityid is not null")
    best = search.best_hits(rows, "modelentityid", "latestversion", "record_ordinal")
    return best.select("modelentityid", "latestversion", "record_ordinal", "pdbpath")


@query
def structure_source(spark, folder):
    """Where each protein's structure comes from: the newest cached model of its accession, else none."""
    models = latest_model(spark, folder).select(F.regexp_extract("modelentityid", "^AF-(.*)-F1$", 1).alias("id"), F.col("pdbpath").alias("path"))
    rows = read(spark, folder, "proteins").select("record_ordinal", "id").join(models, "id", "left")
    return rows.select("record_ordinal", F.when(F.col("path").isNotNull(), "cache").otherwise("none").alias("origin"), "path")


@query
def seen_first(spark, folder):
    return ledger.first_seen(read(spark, folder, "processed"), "seq_sha256", "record_ordinal", "accession", "verdict", "first_seen_cycle")


@query
def seen_new_by_cycle(spark, folder):
    firsts = seen_first(spark, folder)
    return firsts.groupBy(F.col("first_seen_cycle").alias("cycle")).agg(F.count(F.lit(1)).alias("new_records"), F.sum((F.col("verdict") == "actionable").cast("long")).alias("new_actionable"))


@query
def digest_check(spark, folder):
    rows = read(spark, folder, "processed").where("sequence is not null and seq_sha256 is not null")
    return rows.select("record_ordinal", rx.digest(F.col("sequence")).alias("digest"), (rx.digest(F.col("sequence")) == F.lower("seq_sha256")).alias("matches"))


@query
def verdict_counts(spark, folder):
    return read(spark, folder, "processed").groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def cycle_series(spark, folder):
    return ledger.last_cycles(read(spark, folder, "processed"), "first_seen_cycle")


@query
def recent_actionable(spark, folder):
    rows = read(spark, folder, "processed").where("verdict = 'actionable'")
    rows = rows.orderBy(F.desc("first_seen_cycle"), F.desc("accession"), F.desc("record_ordinal")).limit(200)
    return rows.select("record_ordinal", "accession", "first_seen_cycle", "score", "classification")


@query
def top_by_score(spark, folder):
    rows = read(spark, folder, "processed").where("verdict = 'actionable'")
    return rows.orderBy(F.desc_nulls_last("score"), F.asc("accession"), F.asc("record_ordinal")).limit(32).select("record_ordinal", "accession", "score")


@query
def fasta_lines(spark, folder):
    rows = read(spark, folder, "proteins").where("sequence is not null and id is not null")
    return rows.select("record_ordinal", F.concat(F.lit(">"), "id", F.lit("\n"), rx.wrapped(rx.clean_sequence(F.col("sequence")), 60)).alias("entry"))


@query
def anchor(spark, folder):
    """The first S..K of each model, 1-based, as a docking anchor, with how many supporting patterns the model has."""
    rows = read(spark, folder, "alphafold_cache").where("sequence is not null").select("record_ordinal", rx.clean_sequence(F.col("sequence")).alias("s"))
    found = rows.select("record_ordinal", *[c.alias(n) for n, c in rx.docking_anchor(F.col("s")).items()]).where("anchor is not null")
    return found.select("record_ordinal", "anchor", "motif", F.size("places_SxN").cast("long").alias("sxn"), F.size("places_KTG").cast("long").alias("ktg"))


@query
def url_contract(spark, folder):
    rows = read(spark, folder, "reference_headers").where("id is not null")
    user = F.when(F.col("header_ordinal") % 11 == 0, "u:p@").otherwise("")
    port = F.expr("case header_ordinal % 13 when 0 then ':443' when 1 then ':8443' else '' end")
    asked = F.when(F.col("header_ordinal") % 17 == 0, "other").otherwise(F.col("id"))
    tail = F.expr("case header_ordinal % 5 when 0 then '' when 1 then '&cursor=a' when 2 then '&cursor=a&cursor=b' when 3 then '&other=1' else '#x' end")
    url = F.concat(F.lit("https://"), user, F.lit("rest.example.org"), port, F.lit("/search?query="), asked, F.lit("&format=fasta&size="), (F.col("header_ordinal") % 700).cast("string"), tail)
    exact = {"query": F.col("id"), "format": F.lit("fasta")}
    return rows.select("header_ordinal", rx.approved_url(url, "rest.example.org", "/search", ["query", "format", "size", "cursor"], 500, exact).alias("approved"))


@query
def memory_estimate(spark, folder):
    """Bytes that folding takes by length, and whether a 16 GiB host admits it."""
    rows = read(spark, folder, "proteins").where("sequence is not null")
    n = F.length(rx.clean_sequence(F.col("sequence"))).cast("long")
    need = F.lit(5 * 2**30) + F.lit(800) * n * n
    return rows.select("record_ordinal", need.alias("bytes"), (need <= 16 * 2**30).alias("fits"))


@query
def thread_split(spark, folder):
    return ledger.largest_remainder(read(spark, folder, "mix_targets"), "plan_id", "source", "target_share", 100)


@query
def file_names(spark, folder):
    rows = read(spark, folder, "reference_headers").select("header_ordinal", F.concat_ws(" ", "id", "annotation").alias("t"))
    return rows.select("header_ordinal", rx.safe_name(F.col("t")).alias("name"))


@query
def distance_map(spark, folder):
    """Vectors as 21 points in space, each compared with the vector of the next id."""
    rows = read(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    both = rows.alias("q").join(rows.alias("t"), F.col("t.vec_id") == F.col("q.vec_id") + 1).select(F.col("q.vec_id").alias("pair"), F.col("q.v").alias("q"), F.col("t.v").alias("t"))
    points = both.select("pair", "q", "t", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i"))
    axes = [F.get(side, F.col("i") * 3 + axis).alias(f"{side}{'xyz'[axis]}") for side in ("q", "t") for axis in range(3)]
    return structure.distance_map_scores(points.select("pair", "i", *axes)).select("pair", "points", _six("score"))


def _seed_pairs(spark, folder) -> DataFrame:
    """Every protein whose ordinal is divisible by 50 with its nearest cached model, as texts to align."""
    found = seed_search(spark, folder).select(F.col("query").alias("a"), F.col("target").alias("b"))
    left, right = (read(spark, folder, t).select(F.col("record_ordinal").alias(c), rx.clean_sequence(F.col("sequence")).alias(n)) for t, c, n in (("proteins", "a", "left"), ("alphafold_cache", "b", "right")))
    return found.join(left, "a").join(right, "b")


@query
def local_alignment(spark, folder):
    return structure.align(_seed_pairs(spark, folder), "left", "right", "a", "b", local=True)


@query
def global_alignment(spark, folder):
    return structure.align(_seed_pairs(spark, folder), "left", "right", "a", "b", local=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from residua.plans import evidence

    return QUERIES | evidence.QUERIES


def oracle_sql() -> dict[str, str]:
    return statements.all_statements()
