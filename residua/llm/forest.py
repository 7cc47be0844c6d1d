"""Near-duplicate texts with small edits: an LSH forest over min-hash orders, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.blobs import as_batches, by_bucket, cut_wide, joined, settled, small, width
from residua.llm.components import connected_groups
from residua.llm.copies import members, representatives
from residua.llm.windows import five_codes, letters, mix, owners, pairs_of_runs, similarities, starts
from residua.llm.workspace import Workspace

#: Trees of the forest, and levels of a tree. A pair of similarity s shares the first two levels of
#: one tree with chance s * s, so it is missed by all 32 with (1 - s * s) ** 32: 1e-4 at s = 0.5, 4e-8 at 0.65.
TREES, LEVELS = 32, 4
#: Trees of the second forest, which records of divided regions enter: where a pair needs all four levels in each of the
#: 32 + 96 trees, it is missed with (1 - s ** 4) ** 128: 3e-4 at s = 0.5.
MORE_TREES = 96
#: Records of one slice of the forest that a task holds at a time, and records whose signatures are cut into slices together.
SLICE, TOGETHER = 40_000, 60_000
#: A region of at most so many records, or of so large a share of pairs that agree one level deeper, is not divided.
REGION, DENSE = 48, 0.2
_RNG = np.random.default_rng(5)
_MUL = (_RNG.integers(0, 2**32, (TREES + MORE_TREES) * LEVELS, dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, (TREES + MORE_TREES) * LEVELS, dtype=np.uint32)


def signatures(texts: list[str], trees: range = range(TREES)) -> np.ndarray:
    """One 64-bit signature per tree and text (trees x texts): four min-hashes of 16 bits, first level uppermost."""
    out = np.zeros((len(trees), len(texts)), np.uint64)
    for at in range(0, len(texts), 512):  # few enough for the caches
        points, lengths = letters(texts[at : at + 512])
        owner, place = owners(lengths, 5)
        base = (mix(five_codes(points)[place] + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
        first = starts(np.maximum(lengths - 4, 0))[:-1]
        for i, tree in enumerate(trees):
            whole = np.zeros(len(lengths), np.uint64)
            for level in range(LEVELS):
                k = tree * LEVELS + level
                low = np.minimum.reduceat(base * _MUL[k] + _ADD[k], first)
                whole = (whole << np.uint64(16)) | ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64)
            out[i, at : at + len(lengths)] = whole
    return out


def _plant(trees: range, slices: int, per: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of some ten thousand records at a time, cut by tree and by a hash of the first two levels."""

    def planted(ids: np.ndarray, signs: np.ndarray) -> Iterator[dict]:
        for i, tree in enumerate(trees):
            part = (mix((signs[i] >> np.uint64(32)) + np.uint64(tree)) % np.uint64(slices)).astype(np.int64)
            wide = -(-slices // per) * per  # ranges never straddle two trees
            for bucket, blob in cut_wide(part + i * wide, [signs[i], small(ids)], per):
                yield {"bucket": bucket, "blob": blob}

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("rep").to_numpy(zero_copy_only=False), signatures(batch.column("text").to_pylist(), trees)))
        if sum(len(ids) for ids, _ in held) >= TOGETHER:
            yield from as_batches(planted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)))
            held = []
    if held:
        yield from as_batches(planted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)))


def regions(signs: np.ndarray, region: int = REGION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place and size of the regions in sorted signatures whose records become candidates of each other, and places of records whose region was divided.

    A region is a run with a common prefix of two levels. One that is both large and thin
    (few of its pairs agree a level deeper, as when one common window is the minimum of
    unrelated texts) is divided a level deeper, up to the last level; a dense one is full
    of true pairs and stays whole.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    work = [(np.array([0]), np.array([len(signs)]))] if len(signs) else []
    divided = np.zeros(len(signs), bool)
    for level in range(2, LEVELS + 1):
        cuts = signs >> np.uint64(16 * (LEVELS - level))
        edge = np.flatnonzero(np.concatenate([[True], cuts[1:] != cuts[:-1]])) if len(signs) else np.zeros(0, int)
        size = np.diff(np.concatenate([edge, [len(signs)]]))
        inside = np.zeros(len(signs) + 1, np.int64)
        for first, count in work:
            np.add.at(inside, first, 1)
            np.add.at(inside, first + count, -1)
        keep = (np.cumsum(inside)[edge] > 0) & (size > 1)
        edge, size = edge[keep], size[keep]
        ready = size <= region
        if level < LEVELS:
            deeper = signs >> np.uint64(16 * (LEVELS - level - 1))
            for i in np.flatnonzero(~ready):
                _, parts = np.unique(deeper[edge[i] : edge[i] + size[i]], return_counts=True)
                ready[i] = (parts.astype(float) * (parts - 1)).sum() >= DENSE * float(size[i]) * (size[i] - 1)
                if not ready[i]:
                    divided[edge[i] : edge[i] + size[i]] = True
        else:
            ready[:] = True
        found.append((edge[ready], size[ready]))
        work = [(edge[~ready], size[~ready])]
    none = np.zeros(0, int)
    return np.concatenate([f[0] for f in found] or [none]), np.concatenate([f[1] for f in found] or [none]), np.flatnonzero(divided)


def _gather(region: int, _bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a slice; records of divided regions with -1."""
    signs, ids = joined([r["blob"] for r in rows])
    ids = ids.astype(np.int64)
    order = np.lexsort((ids, signs))
    signs, ids = signs[order], ids[order]
    first, size, divided = regions(signs, region)
    for i, j in pairs_of_runs(first, size, 1_000_000):
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        yield pa.RecordBatch.from_pydict({"a": a, "b": b})
    if len(divided):
        yield pa.RecordBatch.from_pydict({"a": ids[divided], "b": np.full(len(divided), -1)})


def _verify(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = similarities(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())
        keep = np.flatnonzero(near >= threshold)
        yield pa.RecordBatch.from_pydict({k: batch.column(k).take(pa.array(keep)) for k in ("a", "b")} | {"similarity": near[keep]})


def _grown(reps: DataFrame, trees: range, region: int, slices: int | None) -> DataFrame:
    """Candidates of one forest, repeated ones once."""
    full = max(1, -(-reps.count() // SLICE))
    parts = min(4096, max(reps.sparkSession.sparkContext.defaultParallelism, full * len(trees) // 4))
    slices = slices or full
    per = min(width(slices * len(trees)), slices)
    planted = settled(reps.select("rep", "text").mapInArrow(partial(_plant, trees, slices, per), "bucket long, blob binary"), per, parts)
    return by_bucket(planted, parts, partial(_gather, region), "a long, b long").distinct()


def similar_representatives(reps: DataFrame, threshold: float, *, region: int = REGION, slices: int | None = None, workspace: Workspace | None = None) -> DataFrame:
    """``a``, ``b``, ``similarity`` of distinct texts (a < b), checked letter by letter.

    Records whose region was divided in some tree enter a second forest of MORE_TREES trees: a pair
    that the division may have parted has both its records there.
    """
    workspace = workspace or Workspace(reps.sparkSession)
    first = workspace.save(_grown(reps, range(TREES), region, slices), "forest-first")
    candidates, divided = first.where("b >= 0"), first.where("b < 0").select(F.col("a").alias("rep")).distinct()
    if divided.head(1):
        again = workspace.save(_grown(reps.join(divided, "rep", "left_semi"), range(TREES, TREES + MORE_TREES), region, slices), "forest-second")
        candidates = candidates.unionAll(again.where("b >= 0")).distinct()
    left = reps.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    joined_texts = candidates.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined_texts.mapInArrow(partial(_verify, threshold), "a long, b long, similarity double")


def similar_pairs(rows: DataFrame, threshold: float = 0.5, *, workspace: Workspace | None = None) -> DataFrame:
    """All pairs of ``rows`` (id, text) whose 5-letter windows have a Jaccard similarity of ``threshold`` or more.

    Equal texts are first folded into one representative, which alone enters the forest; a
    pair of representatives stands for all pairs of their copies. Result: ``a``, ``b`` (ids,
    a < b). Texts under five letters and null texts have no pairs; a repeated id is one
    row; an empty table gives an empty result; other columns are left out.
    """
    workspace = workspace or Workspace(rows.sparkSession)
    reps = workspace.save(representatives(rows.where(F.length("text") >= 5)), "forest-reps")
    near = workspace.save(similar_representatives(reps, threshold, workspace=workspace).select("a", "b"), "forest-pairs")
    copied = reps.where("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    wanted = near.unionAll(copied)
    concerned = wanted.select(F.col("a").alias("rep")).unionAll(wanted.select("b")).distinct()
    who = workspace.save(members(rows.where(F.length("text") >= 5), reps.join(concerned, "rep", "left_semi")), "forest-members")
    x = who.select(F.col("rep").alias("a"), F.col("id").alias("ida"))
    y = who.select(F.col("rep").alias("b"), F.col("id").alias("idb"))
    every = wanted.join(x, "a").join(y, "b").where((F.col("a") != F.col("b")) | (F.col("ida") < F.col("idb")))
    return every.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b"))


def similar_groups(rows: DataFrame, threshold: float = 0.5, *, workspace: Workspace | None = None) -> DataFrame:
    """The groups that similar texts form, without writing out the pairs of copies.

    Result: one row per row of ``rows`` (id, text) with ``id``, ``rep`` (smallest id with the same
    text), ``copies`` (rows with that text), ``links`` (other texts that are similar to it) and
    ``group`` (smallest id linked to it directly or through others). Null texts and those under five
    letters are in no group and give no row; an empty table gives an empty result; ids must be unique.
    """
    workspace = workspace or Workspace(rows.sparkSession)
    rows = rows.where(F.length("text") >= 5)
    reps = workspace.save(representatives(rows), "forest-reps")
    near = workspace.save(similar_representatives(reps, threshold, workspace=workspace).select("a", "b"), "forest-pairs")
    ends = near.select(F.col("a").alias("rep")).unionAll(near.select("b"))
    links = ends.groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    groups = connected_groups(near, "a", "b", workspace=workspace).withColumnRenamed("record", "rep")
    every = reps.select("rep", F.col("n").alias("copies")).join(links, "rep", "left").join(groups, "rep", "left")
    every = every.select("rep", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("group", "rep").alias("group"))
    return members(rows, reps).join(every, "rep").select("id", "rep", "copies", "links", "group")
