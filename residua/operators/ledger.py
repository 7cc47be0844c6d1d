"""The ledger of everything seen: first arrivals count, later ones change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEDGER = "digest string, accession string, sequence string, verdict string, score double, classification string, first_seen_cycle int, run_id string, ts string"


def first_seen(arrivals: DataFrame, digest: str, ordinal: str, *kept: str) -> DataFrame:
    """The first arrival of each digest, in any case; rows without one are left out. Combined before the shuffle."""
    firsts = arrivals.where(F.col(digest).isNotNull()).groupBy(F.lower(digest).alias("digest"))
    return firsts.agg(F.min(F.struct(ordinal, *kept)).alias("f")).select("digest", *[F.col(f"f.{c}").alias(c) for c in (ordinal, *kept)])


#: Rows of a batch (64 bytes each) up to which its digests are sent to the scan of the ledger, which then is not shuffled.
SMALL_BATCH = 200_000


def unseen(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of a batch whose digest the ledger lacks. Of the ledger only digests are read; for a small batch only those that it shares are moved."""
    known = ledger.select("digest")
    asked = batch.select("digest").distinct()
    if asked.limit(SMALL_BATCH + 1).count() <= SMALL_BATCH:
        known = known.join(F.broadcast(asked), "digest", "left_semi").distinct()
    return batch.join(known, "digest", "left_anti")


def last_cycles(ledger: DataFrame, cycle: str, verdict: str = "actionable", most: int = 60) -> DataFrame:
    """Rows with the verdict per cycle, for the last ``most`` cycles of the ledger; cycles without any count 0."""
    bounds = ledger.agg(F.min(cycle).alias("low"), F.max(cycle).alias("high")).where("high is not null")
    first = F.greatest(F.col("low"), F.col("high") - (most - 1))
    every = bounds.select(F.explode(F.sequence(first, F.col("high"))).alias("cycle"))
    counts = ledger.where(F.col("verdict") == verdict).groupBy(F.col(cycle).alias("cycle")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "cycle", "left").select("cycle", F.coalesce("n", F.lit(0)).alias("n"))


def largest_remainder(rows: DataFrame, group: str, item: str, weight: str, total: int) -> DataFrame:
    """``total`` units per group: one each first, the rest by weight, what is left over to the largest fractions, then weights, then items from the end of the alphabet."""
    every = Window.partitionBy(group)
    spare = F.lit(total) - F.count(F.lit(1)).over(every)
    exact = F.col(weight) * spare / F.sum(weight).over(every)
    parts = rows.withColumn("_exact", F.round(exact, 9)).withColumn("_spare", spare).withColumn("_floor", F.floor("_exact"))
    order = Window.partitionBy(group).orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), F.desc(weight), F.desc(item))
    over = F.col("_spare") - F.sum("_floor").over(every)
    return parts.withColumn("units", F.lit(1) + F.col("_floor") + F.when(F.row_number().over(order) <= over, 1).otherwise(0)).select(group, item, F.col("units").cast("long").alias("units"))
