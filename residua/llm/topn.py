"""The best items of every group, taken from descending bands of the score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from residua.llm.workspace import Workspace

#: Bound of the list of heavy filled groups that is broadcast ahead of the shuffled anti-join.
HEAVY = 1000


def top_n(
    rows: DataFrame,
    groups: Sequence[str],
    item: str,
    score: str,
    n: int,
    *,
    quantiles: Sequence[float] = (0.85, 0.5),
    workspace: Workspace | None = None,
) -> DataFrame:
    """The ``n`` best distinct items of each group: score descending, then item ascending (bytes).

    Rows are cut into bands of the score at ``quantiles`` and written once, by band. Bands
    are processed from the top: groups that already have ``n`` items are anti-joined away
    before anything of a lower band is shuffled, an item counts with its highest score,
    and equal scores never straddle a band. A hot group costs no task more than its share:
    ranks are first limited to ``n`` rows on the map side.

    Result: groups, item, score, rank (1...n). Null and NaN scores and rows with a null
    group or item are ignored; infinite scores and -0.0 are ordinary; repeated rows count
    once; an empty table gives an empty result; all other columns are left out.
    """
    spark = rows.sparkSession
    workspace = workspace or Workspace(spark)
    keys = list(groups)
    tag = "topn-" + "-".join([*keys, item, score, str(id(rows))])
    data = rows.select(*keys, item, F.col(score).cast("double").alias(score))
    data = data.dropna(subset=[*keys, item, score]).where(~F.isnan(score))
    # The cuts are a handful of numbers whatever the size of the table.
    cuts = sorted(set(data.approxQuantile(score, list(quantiles), 0.01)), reverse=True) if quantiles else []
    band = reduce(lambda rest, i: F.when(F.col(score) >= cuts[i], i).otherwise(rest), reversed(range(len(cuts))), F.lit(len(cuts)))
    banded = workspace.save(data.withColumn("_band", band), f"{tag}-bands", "_band")

    order = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    done: list[DataFrame] = []
    kept: DataFrame | None = None
    for i in range(len(cuts) + 1):
        part = banded.where(F.col("_band") == i).drop("_band")
        if done:
            filled = reduce(DataFrame.unionAll, done).where("_rank = 1")
            heavy = filled.orderBy(F.desc("_seen"), *keys).limit(HEAVY).select(*keys)
            part = part.join(F.broadcast(heavy), keys, "left_anti").join(filled.select(*keys), keys, "left_anti")
        if kept is not None:
            part = part.unionByName(kept.select(*keys, item, score))
        best = part.groupBy(*keys, item).agg(F.max(score).alias(score), F.count(F.lit(1)).alias("_rows"))
        seen = best.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(n)).alias("_filled"), F.sum("_rows").alias("_seen"))
        ranked = best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rows")
        ranked = workspace.save(ranked.join(seen, keys), f"{tag}-{i}")
        done.append(ranked.where(F.col("_filled") >= n))
        kept = ranked.where(F.col("_filled") < n)
    result = reduce(DataFrame.unionAll, [*done, kept])
    return result.select(*keys, item, score, F.col("_rank").alias("rank"))
