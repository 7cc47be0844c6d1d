"""One group for all records that pairwise matches link, directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.workspace import Workspace

#: A key is hot with more than one row in so many (and more than LEAST); there can be at most twice as many hot keys.
HOT_SHARE, LEAST = 2000, 1000
SALTS = 32
#: Rows that one task joins with ease, even if all have one key: up to so many nothing is spread.
EASY = 100_000


def _hot(rows: DataFrame, key: str, n: int) -> DataFrame | None:
    """Keys that hold more than one in HOT_SHARE of about ``n`` rows; counted on the map side first, so no task sees all rows of one. None if all rows are EASY."""
    if n <= EASY:
        return None
    counts = rows.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.where(F.col("rows") > max(LEAST, n // HOT_SHARE)).select("k")


def _look_up(rows: DataFrame, key: str, other: str, table: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` with ``value`` of their ``key`` in ``table`` (k, value); rows of hot keys are spread over salts by ``other``, and their one entry is repeated per salt."""
    if hot is None:
        return rows.withColumnRenamed(key, "k").join(table, "k", how).withColumnRenamed("k", key)
    known = F.broadcast(hot.select("k", F.lit(True).alias("_hot")))
    salted = rows.withColumnRenamed(key, "k").join(known, "k", "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    spread = table.join(known, "k", "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    return salted.drop("_hot").join(spread.drop("_hot"), ["k", "_salt"], how).drop("_salt").withColumnRenamed("k", key)


def connected_groups(links: DataFrame, left: str, right: str, *, workspace: Workspace | None = None) -> DataFrame:
    """Borůvka's rounds: each component hooks onto its smallest neighbour, trees collapse, edges are relabelled.

    Edges are ordered by (smaller label, larger label), so a component's smallest outgoing
    edge leads to its smallest neighbour, and hooks close no cycle but pairs that chose each
    other, of which the smaller becomes the root. Trees collapse by pointer doubling; edges
    then get their roots as ends, loops and repeats go, until no edge is left. At least half
    of the components with edges vanish each round. Labels and edges stay distributed; the
    driver sees counts only.

    Result: ``record``, ``group``, where group is the smallest record (by bytes or number) of
    the component. Links with a null end are ignored, self links give a group of one, repeated
    links count once, an empty table gives an empty result, other columns are left out.
    """
    workspace = workspace or Workspace(links.sparkSession)
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna()
    edges = workspace.save(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges-0")
    vertices = edges.select(F.col("u").alias("c")).unionAll(edges.select("v")).distinct()
    groups = workspace.save(vertices.select(F.col("c").alias("record"), F.col("c").alias("label")), "groups-0")
    edges = edges.where("u <> v")
    n_edges, n_records, turn = edges.count(), groups.count(), 0
    while n_edges:
        turn += 1
        ends = edges.select(F.col("u").alias("c"), F.col("v").alias("d")).unionAll(edges.select("v", "u"))
        hooks = workspace.save(ends.groupBy("c").agg(F.min("d").alias("p"), F.count(F.lit(1)).alias("degree")), f"hooks-{turn}")
        crowded = None if 2 * n_edges <= EASY else hooks.where(F.col("degree") > max(LEAST, n_edges // HOT_SHARE)).select(F.col("c").alias("k"))
        # Who hooks onto a vertex has an edge to it, so a vertex with many hooks has a high degree.
        back = _look_up(hooks.select("c", "p"), "p", "c", hooks.select(F.col("c").alias("k"), F.col("p").alias("pp")), crowded)
        parents = back.select(
            "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")
        )
        parents, step, moving = workspace.save(parents, f"parents-{turn}-0"), 0, 1
        while moving:
            step += 1
            up = parents.select(F.col("c").alias("k"), F.col("p").alias("pp"))
            jumped = _look_up(parents, "p", "c", up, _hot(parents, "p", 2 * n_edges)).select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved"))
            jumped = workspace.save(jumped, f"parents-{turn}-{step}")
            moving = jumped.where("moved").count()
            parents = jumped.select("c", "p")
            workspace.drop(f"parents-{turn}-{step - 1}")
        # All of a tree now point to its root, which need not be the smallest of them.
        smallest = parents.groupBy(F.col("p").alias("k")).agg(F.min("c").alias("root"))
        labels = _look_up(parents, "p", "c", smallest, _hot(parents, "p", 2 * n_edges)).select("c", "root")
        labels = workspace.save(labels, f"labels-{turn}")
        table = labels.withColumnRenamed("c", "k")
        moved = _look_up(edges, "u", "v", table, crowded).select(F.col("root").alias("u"), "v")
        moved = _look_up(moved, "v", "u", table, crowded).select("u", F.col("root").alias("v")).where("u <> v")
        moved = moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        edges = workspace.save(moved, f"edges-{turn}")
        # Records of components without edges keep their label, which is in no table.
        renamed = _look_up(groups, "label", "record", table, _hot(groups, "label", n_records), "left")
        groups = workspace.save(renamed.select("record", F.coalesce("root", "label").alias("label")), f"groups-{turn}")
        n_edges = edges.count()
        workspace.drop(f"groups-{turn - 1}", f"edges-{turn - 1}", f"hooks-{turn}", f"labels-{turn}", f"parents-{turn}-{step}")
    return groups.select("record", F.col("label").alias("group"))
