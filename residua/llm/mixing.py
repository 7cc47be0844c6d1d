"""Draw records of several sources so that each has its share of the total size: Poisson replication.

Every record has a fixed uniform number, a hash of its id and plan. It is drawn as often as the
inverse of a Poisson distribution at that number says, but no more than its source allows. The
mean of the distribution is one number per plan and source; the size drawn rises with it, so
it is found by narrowing an interval around it: each pass sums, in one scan and without a
shuffle of records, what every mean of a grid would draw.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.llm.workspace import Workspace

#: Means tried per pass, and passes. The first grid is geometric down to LEAST of the highest mean, so that the later ones,
#: even inside one of its steps, leave a relative step of (LEAST ** (-1 / 47) - 1) / 47 ** 2 = 2e-4 of the mean.
GRID, PASSES, LEAST = 48, 3, 1e-7
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _count(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    for batch in batches:
        sizes = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "source": batch.column("source"), "tokens": pa.array(sizes, pa.int64())})


def plain_source(source: Column) -> Column:
    """Source names in plain form: no outer spaces, lower case, underscores for dashes."""
    return F.translate(F.lower(F.trim(source)), "-", "_")


def uniform(ident: Column, plan: Column) -> Column:
    """A fixed number in (0, 1) per record and plan."""
    return (F.shiftrightunsigned(F.xxhash64(ident, plan, F.lit(2024)), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def draws(u: np.ndarray, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Inverse of the Poisson distribution of ``mean`` at ``u``, at most ``most``; all three of one shape.

    Large means start where all before adds up to less than 1e-30, as exp(-mean) has no double beyond 745.
    """
    mean = mean.astype(float)
    first = np.maximum(0.0, np.floor(mean - 12 * np.sqrt(mean))) * (mean > 500)
    count = first.astype(np.int64)
    term = np.exp(-mean)
    for value in np.unique(mean[first > 0]):
        k = float(np.floor(value - 12 * np.sqrt(value)))
        term[mean == value] = math.exp(k * math.log(value) - value - math.lgamma(k + 1))
    total = term.copy()
    going = (u > total) & (count < most)
    while going.any():
        count[going] += 1
        with np.errstate(invalid="ignore"):
            term = np.where(going, term * mean / np.maximum(count, 1), term)
        total = np.where(going, total + term, total)
        going &= (u > total) & (count < most)
    return np.minimum(count, most)


def _grid_sums(grids, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size that each mean of each grid would draw of the records of a partition."""
    table = grids.value
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        u = batch.column("u").to_numpy(zero_copy_only=False)
        tokens = batch.column("tokens").to_numpy(zero_copy_only=False)
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        for s in np.unique(slot):
            mine = slot == s
            means, most = table[int(s)]
            held = sums.setdefault(int(s), np.zeros(len(means), np.int64))
            cap = np.full(mine.sum(), most)
            for g, mean in enumerate(means):
                held[g] += (draws(u[mine], np.full(mine.sum(), mean), cap) * tokens[mine]).sum()
    rows = [(s, g, int(v)) for s, held in sums.items() for g, v in enumerate(held)]
    yield pa.RecordBatch.from_pydict({"slot": pa.array([r[0] for r in rows], pa.int32()), "g": pa.array([r[1] for r in rows], pa.int32()), "size": pa.array([r[2] for r in rows], pa.int64())})


def _draw(chosen, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    means, most = chosen.value
    for batch in batches:
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        u = batch.column("u").to_numpy(zero_copy_only=False)
        times = draws(u, means[slot], most[slot])
        keep = pa.array(np.flatnonzero(times))
        yield pa.RecordBatch.from_pydict({k: batch.column(k).take(keep) for k in ("id", "slot", "tokens")} | {"repeats": times[times > 0]})


class Mixture:
    """Sized records and plans, and what each plan draws.

    ``documents``: id, source, text. ``targets``: plan_id, source, target_share, max_repeats, of a
    number of rows that the driver can hold (one per plan and source). The total of a plan is the
    size of its own sources. A source too small for its share at ``max_repeats`` is drawn whole,
    that often, and the share it reaches says so. Records with a null id or source, or of a source
    that no plan names, are never drawn; null and empty texts have no tokens; repeated ids are
    drawn alike; targets with a null, or without records, draw nothing; the same input always
    gives the same draw.
    """

    def __init__(self, documents: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame, *, tokenizer: str = TOKENIZER, workspace: Workspace | None = None):
        self.spark = documents.sparkSession
        self.workspace = workspace or Workspace(self.spark)
        rows = documents.select(F.col(doc_id).cast("long").alias("id"), plain_source(F.col(source)).alias("source"), F.col(text).alias("text"))
        sized = rows.where("id is not null and source is not null").mapInArrow(partial(_count, tokenizer), "id long, source string, tokens long")
        self.sized = self.workspace.save(sized, "mix-sized")
        self.targets = targets.select("plan_id", "source", "target_share", "max_repeats").dropna().orderBy("plan_id", "source").collect()
        self._solve()

    def _solve(self) -> None:
        sizes = {r.source: (r.tokens, r.docs) for r in self.sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).join(F.broadcast(self._slots().select("source").distinct()), "source").collect()}
        self.available = [sizes.get(t.source, (0, 0))[0] for t in self.targets]
        totals: dict = {}
        for t, size in zip(self.targets, self.available, strict=True):
            totals[t.plan_id] = totals.get(t.plan_id, 0) + size
        self.wanted = [t.target_share * totals[t.plan_id] for t in self.targets]
        # At 60 and twelve deviations above the cap every record is drawn as often as the cap allows, whatever its number.
        low = [0.0] * len(self.targets)
        high = [float(t.max_repeats + 60 + 12 * math.sqrt(t.max_repeats)) if size else 0.0 for t, size in zip(self.targets, self.available, strict=True)]
        sure = [size * t.max_repeats <= want for t, size, want in zip(self.targets, self.available, self.wanted, strict=True)]
        best = [(abs(want), 0.0) for want in self.wanted]
        rows = self._rows()
        for turn in range(PASSES):
            grid = np.linspace if turn else lambda _, top, n: np.concatenate([[0.0], np.geomspace(LEAST * top, top, n - 1)])
            open_slots = {i: (grid(low[i], high[i], GRID), t.max_repeats) for i, t in enumerate(self.targets) if not sure[i] and high[i] > low[i]}
            if not open_slots:
                break
            shared = self.spark.sparkContext.broadcast(open_slots)
            part = rows.where(F.col("slot").isin(list(open_slots)))
            drawn = part.mapInArrow(partial(_grid_sums, shared), "slot int, g int, size long").groupBy("slot", "g").agg(F.sum("size").alias("size")).collect()
            for i, (means, _) in open_slots.items():
                sums = np.zeros(GRID)
                for r in drawn:
                    if r.slot == i:
                        sums[r.g] = r["size"]
                best[i] = min(best[i], *((abs(s - self.wanted[i]), float(m)) for s, m in zip(sums, means, strict=True)))
                at = int(np.searchsorted(sums, self.wanted[i]))
                low[i], high[i] = float(means[max(at - 1, 0)]), float(means[min(at, GRID - 1)])
        self.means = np.array([high[i] if sure[i] else best[i][1] for i in range(len(self.targets))])

    def _slots(self) -> DataFrame:
        rows = [(i, t.plan_id, t.source) for i, t in enumerate(self.targets)]
        return self.spark.createDataFrame(rows, "slot int, plan_id int, source string")

    def _rows(self) -> DataFrame:
        joined = self.sized.join(F.broadcast(self._slots()), "source")
        return joined.select("id", "slot", "tokens", uniform(F.col("id"), F.col("plan_id")).alias("u"))

    def drawn(self) -> DataFrame:
        """``plan_id``, ``source``, ``id``, ``tokens``, ``repeats`` of the drawn records."""
        shared = self.spark.sparkContext.broadcast((self.means, np.array([t.max_repeats for t in self.targets])))
        rows = self._rows().mapInArrow(partial(_draw, shared), "id long, slot int, tokens long, repeats long")
        return rows.join(F.broadcast(self._slots()), "slot").select("plan_id", "source", "id", "tokens", "repeats")

    def shares(self, drawn: DataFrame) -> DataFrame:
        """Per plan and source: target and reached share of the total, and of all that was drawn."""
        rows = [(t.plan_id, t.source, float(t.target_share), int(t.max_repeats), int(a), float(w)) for t, a, w in zip(self.targets, self.available, self.wanted, strict=True)]
        plan = self.spark.createDataFrame(rows, "plan_id int, source string, target_share double, max_repeats int, available long, wanted double")
        got = drawn.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"), F.max("repeats").cast("int").alias("most_repeats"))
        both = plan.join(got, ["plan_id", "source"], "left").na.fill(0, ["drawn", "most_repeats"])
        total = both.groupBy("plan_id").agg(F.sum("available").alias("total"), F.sum("drawn").alias("drawn_total"))
        return both.join(total, "plan_id").select(
            "plan_id", "source", "target_share", "max_repeats", "available", "drawn", "most_repeats",
            F.coalesce(F.try_divide(F.col("drawn"), F.col("total")), F.lit(0.0)).alias("share_of_total"),
            F.coalesce(F.try_divide(F.col("drawn"), F.col("drawn_total")), F.lit(0.0)).alias("share_of_drawn"),
        )

    def shuffled(self, drawn: DataFrame) -> DataFrame:
        """One row per copy, in a global order that mixes all sources: ``place`` sorts a plan's rows."""
        copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))))
        place = F.xxhash64("plan_id", "id", "copy", F.lit(7))
        return copies.withColumn("place", place).repartitionByRange("plan_id", "place").sortWithinPartitions("plan_id", "place", "id", "copy")
