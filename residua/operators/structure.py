"""Alignment of sequences and comparison of structures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP = 2, -1, -2
STRIDE_TARGET, DECAY = 180, 6.0


def _table(a: str, b: str, local: bool) -> np.ndarray:
    """Scores of all prefixes; a row at a time, the gaps along the row by a running maximum."""
    x, y = np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    steps = GAP * np.arange(len(y) + 1)
    if not local:
        table[0], table[:, 0] = steps, GAP * np.arange(len(x) + 1)
    for i in range(1, len(x) + 1):
        row = np.maximum(table[i - 1, :-1] + np.where(y == x[i - 1], MATCH, MISMATCH), table[i - 1, 1:] + GAP)
        row = np.concatenate([[table[i, 0]], np.maximum(row, 0) if local else row])
        table[i] = np.maximum.accumulate(row - steps) + steps
    return table


def trace(a: str, b: str, local: bool) -> tuple[int, list[tuple[int, int]], int]:
    """Score, paired places, and length with gaps; diagonal before up before left, first best cell."""
    table = _table(a, b, local)
    i, j = np.unravel_index(int(table.argmax()), table.shape) if local else (len(a), len(b))
    i, j, score, pairs, length = int(i), int(j), int(table[i, j]), [], 0
    while (i or j) and not (local and table[i, j] == 0):
        if i and j and table[i, j] == table[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif i and table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
        length += 1
    return score, pairs[::-1], length


def align(pairs: DataFrame, left: str, right: str, *keys: str, local: bool = True) -> DataFrame:
    """score, identical, aligned (length with gaps), paired, identity of each row's two texts; nulls count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b in zip(batch[left].fillna(""), batch[right].fillna(""), strict=True):
                score, paired, length = trace(a, b, local)
                same = sum(a[i] == b[j] for i, j in paired)
                whole = length if local else len(paired)
                rows.append((score, same, length, len(paired), same / whole if whole else 0.0))
            yield pd.concat([batch[list(keys)].reset_index(drop=True), pd.DataFrame(rows, columns=["score", "identical", "aligned", "paired", "identity"])], axis=1)

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", score long, identical long, aligned long, paired long, identity double"
    return pairs.select(*keys, left, right).mapInPandas(run, schema)


def distance_map_scores(points: DataFrame) -> DataFrame:
    """Mean agreement of all inner distances of two structures.

    ``points``: pair, i (place in the alignment), qx, qy, qz, tx, ty, tz. Of long alignments every
    n // 180-th place counts. Result: pair, points, score; fewer than two points score 0.
    """
    counted = points.join(points.groupBy("pair").agg(F.count(F.lit(1)).alias("points")), "pair")
    kept = counted.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("points") / STRIDE_TARGET)) == 0)

    def side(name: str) -> list:
        return ["pair", *[F.col(c).alias(name + c) for c in ("i", "qx", "qy", "qz", "tx", "ty", "tz")]]

    def apart(kind: str):
        return F.sqrt(sum(((F.col(f"a{kind}{c}") - F.col(f"b{kind}{c}")) ** 2 for c in "yz"), (F.col(f"a{kind}x") - F.col(f"b{kind}x")) ** 2))

    # Strides leave at most 360 places of a pair, so a pair has 64,620 distances at most.
    each = kept.select(*side("a")).join(kept.select(*side("b")), "pair").where("ai < bi")
    scored = each.groupBy("pair").agg(F.avg(F.exp(-F.abs(apart("q") - apart("t")) / DECAY)).alias("score"))
    return points.groupBy("pair").agg(F.count(F.lit(1)).alias("points")).join(scored, "pair", "left").select("pair", "points", F.coalesce("score", F.lit(0.0)).alias("score"))


#: What two structures must share to pass.
LEAST_PAIRS, LEAST_COVERAGE, LEAST_SCORE = 180, 0.45, 0.45


def verdict(pairs: Column, shorter: Column, score: Column) -> tuple[Column, Column]:
    """Coverage of the shorter structure, and whether the comparison passes."""
    coverage = pairs / F.greatest(shorter, F.lit(1))
    return coverage, (pairs >= LEAST_PAIRS) & (coverage >= LEAST_COVERAGE) & (score >= LEAST_SCORE)


def compare(pairs: DataFrame, carbons: DataFrame) -> DataFrame:
    """Structures compared: aligned globally by their letters, then by the distances inside each.

    ``pairs``: pair, query, target. ``carbons``: structure, i, letter, x, y, z (a structure is one molecule).
    Result: pair, query, target, aligned, identity, coverage, score, passed. A structure without
    carbons gives no row; a null letter counts as X.
    """
    letters = F.array_sort(F.collect_list(F.struct("i", F.coalesce("letter", F.lit("X")).alias("letter"))))
    texts = carbons.groupBy("structure").agg(F.array_join(F.transform(letters, lambda r: r["letter"]), "").alias("text"))
    both = pairs.join(texts.select(F.col("structure").alias("query"), F.col("text").alias("q")), "query").join(texts.select(F.col("structure").alias("target"), F.col("text").alias("t")), "target")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair, query, target, a, b in batch[["pair", "query", "target", "q", "t"]].itertuples(index=False):
                paired = trace(a, b, local=False)[1]
                same = sum(a[i] == b[j] for i, j in paired)
                head = {"pair": pair, "query": query, "target": target, "shorter": min(len(a), len(b)), "identity": same / len(paired) if paired else 0.0}
                yield pd.DataFrame([head | {"place": k, "qi": i, "tj": j} for k, (i, j) in enumerate(paired)] or [head | {"place": -1, "qi": -1, "tj": -1}])

    kinds = dict(pairs.dtypes)
    places = both.mapInPandas(run, f"pair {kinds['pair']}, query {kinds['query']}, target {kinds['target']}, shorter long, identity double, place long, qi long, tj long")

    def side(name: str, structure: str, at: str) -> DataFrame:
        return carbons.select(F.col("structure").alias(structure), F.col("i").alias(at), *[F.col(c).alias(name + c) for c in "xyz"])

    points = places.join(side("q", "query", "qi"), ["query", "qi"]).join(side("t", "target", "tj"), ["target", "tj"])
    scored = distance_map_scores(points.select("pair", F.col("place").alias("i"), *[n + c for n in "qt" for c in "xyz"]))
    heads = places.groupBy("pair").agg(*[F.first(c).alias(c) for c in ("query", "target", "shorter", "identity")])
    out = heads.join(scored, "pair", "left").select("pair", "query", "target", F.coalesce("points", F.lit(0)).alias("aligned"), "identity", "shorter", F.coalesce("score", F.lit(0.0)).alias("score"))
    coverage, passed = verdict(F.col("aligned"), F.col("shorter"), F.col("score"))
    return out.select("pair", "query", "target", "aligned", "identity", coverage.alias("coverage"), "score", passed.alias("passed"))
