"""The problems' queries over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.residues import accession, clean_sequence
from residua.llm.components import connected_groups
from residua.llm.copies import texts
from residua.llm.encoding import Garbled
from residua.llm.forest import similar_groups, similar_pairs
from residua.llm.history import History
from residua.llm.leaks import leaks, without_leaks
from residua.llm.mixing import Mixture
from residua.llm.spans import shared_spans
from residua.llm.topn import top_n
from residua.llm.workspace import Workspace

SEARCHES = {"mmseqs": ("mmseqs_hits", "bitscore"), "native": ("native_hits", "supportscore")}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def hits(spark: SparkSession, folder: str, search: str) -> DataFrame:
    """search, queryid, targetid (accessions), score of one hit table; rows with a null id are left out."""
    table, score = SEARCHES[search]
    return (
        read(spark, folder, table)
        .where("queryid is not null and targetid is not null")
        .select(
            F.lit(search).alias("search"),
            accession(F.col("queryid")).alias("queryid"),
            accession(F.col("targetid")).alias("targetid"),
            F.col(score).cast("double").alias("score"),
        )
    )


#: Cycles at the end of the ledger that are entered one at a time; all earlier ones are loaded in bulk, in so many batches.
SINGLE, BULK = 2, 2


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of processed that repeat, exactly or nearly, a row of an earlier cycle.

    The index is filled with all cycles but the last few in bulk (a batch may hold many cycles, and a row
    is compared with earlier cycles of its own batch as well), then the last cycles come one by one, as they
    would from day to day. Every row is judged, by the same operator.
    """
    ledger = read(spark, folder, "processed").select(
        F.col("record_ordinal").alias("id"), F.col("seq_sha256").alias("digest"), clean_sequence(F.col("sequence")).alias("text"), F.col("first_seen_cycle").alias("cycle")
    )
    last = sorted(int(r.cycle) for r in ledger.select("cycle").where("cycle is not null").distinct().orderBy(F.desc("cycle")).limit(SINGLE + 1).collect())
    ends = sorted({*(int(x) for x in ledger.approxQuantile("cycle", [i / BULK for i in range(1, BULK)], 0.01)), *last[:-1]})
    history, found = History(spark), []
    for low, high in zip([None, *ends], [*ends, None], strict=True):
        batch = ledger if low is None else ledger.where(F.col("cycle") > low)
        found.append(history.ingest(batch if high is None else batch.where(F.col("cycle") <= high)))
    result = found[0]
    for more in found[1:]:
        result = result.unionAll(more)
    return result.select(F.col("id").alias("record_ordinal"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The five best targets of every query of either search."""
    parts = []
    for search in SEARCHES:
        found = top_n(hits(spark, folder, search).drop("search"), ["queryid"], "targetid", "score", 5)
        parts.append(found.select(F.lit(search).alias("search"), "queryid", "targetid"))
    return parts[0].unionAll(parts[1])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every accession in a hit of either search with the smallest accession it is connected to."""
    links = hits(spark, folder, "mmseqs").unionAll(hits(spark, folder, "native"))
    found = connected_groups(links, "queryid", "targetid")
    return found.select(F.col("record").alias("accession"), F.col("group").alias("group_accession"))


def sequences(spark: SparkSession, folder: str, tables: list[str], least: int) -> DataFrame:
    """``id``, ``text``: record_ordinal and clean sequence of all rows of the tables."""
    return texts([read(spark, folder, t) for t in tables], "record_ordinal", clean_sequence(F.col("sequence")), least)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of processed and alphafold_cache that occur letter for letter in another record."""
    found = shared_spans(sequences(spark, folder, ["processed", "alphafold_cache"], 40), 40)
    return found.withColumnRenamed("id", "record_ordinal")


def p4_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each record with a shared stretch is shared elsewhere."""
    rows = sequences(spark, folder, ["processed", "alphafold_cache"], 40)
    spans = shared_spans(rows, 40).groupBy("id").agg(F.sum(F.expr("span_end - span_start + 1")).alias("shared"))
    sized = rows.select("id", F.length("text").cast("long").alias("letters")).join(spans, "id")
    return sized.select(F.col("id").alias("record_ordinal"), "letters", "shared", (F.col("shared") / F.col("letters")).alias("share"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of processed and proteins whose clean sequences are alike."""
    found = similar_pairs(sequences(spark, folder, ["processed", "proteins"], 5), 0.5)
    return found.select(F.col("a").alias("record_ordinal_a"), F.col("b").alias("record_ordinal_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of processed and proteins with its exact copies, its links to other texts and the group they form."""
    found = similar_groups(sequences(spark, folder, ["processed", "proteins"], 5), 0.5)
    return found.select(F.col("id").alias("record_ordinal"), F.col("rep").alias("representative"), "copies", "links", F.col("group").alias("group_ordinal"))


def _documents_and_items(spark: SparkSession, folder: str) -> tuple:
    return read(spark, folder, "documents"), "doc_id", "text", read(spark, folder, "eval_items"), "item_id", "text"


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 12 consecutive words of an evaluation item."""
    found = leaks(*_documents_and_items(spark, folder))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p6_removed(spark: SparkSession, folder: str) -> DataFrame:
    """The leaking documents without the leaked spans."""
    found = without_leaks(*_documents_and_items(spark, folder))
    return found.withColumnRenamed("doc", "doc_id")


def _mixture(spark: SparkSession, folder: str) -> Mixture:
    return Mixture(read(spark, folder, "documents"), "doc_id", "source", "text", read(spark, folder, "mix_targets"))


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """What each plan draws: one row per copy in a shuffled order, with the share its source reaches."""
    mixture = _mixture(spark, folder)
    drawn = mixture.workspace.save(mixture.drawn(), "mix-drawn")
    shares = mixture.shares(drawn).select("plan_id", "source", "target_share", F.col("share_of_total").alias("reached_share"))
    rows = mixture.shuffled(drawn.join(F.broadcast(shares), ["plan_id", "source"]))
    return rows.select("plan_id", "place", F.col("id").alias("doc_id"), "copy", "repeats", "source", "tokens", "target_share", "reached_share")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of every plan and source."""
    mixture = _mixture(spark, folder)
    return mixture.shares(mixture.drawn())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a stretch that was decoded in a wrong encoding."""
    return Garbled(read(spark, folder, "documents"), "doc_id", "text").documents().withColumnRenamed("doc", "doc_id")


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    """These documents with the original words, where no bytes were lost."""
    return Garbled(read(spark, folder, "documents"), "doc_id", "text").restored().withColumnRenamed("doc", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_share": p4_share, "p5_found": p5_found, "p5_groups": p5_groups,
        "p6_found": p6_found, "p6_removed": p6_removed, "p7_mixture": p7_mixture, "p7_shares": p7_shares,
        "p8_found": p8_found, "p8_restored": p8_restored}
