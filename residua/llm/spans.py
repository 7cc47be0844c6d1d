"""Long exact spans that records share with others, by fixed-block anchors.

Every window of ``span`` letters holds a whole block of ``span // 2`` letters that begins at a
multiple of ``span // 2``. These non-overlapping blocks are indexed, and every rolling window
of that length probes them. Hits are extended to both sides: every ``span``-letter window
around a hit is compared with those of the other records that hold the same block, and
runs of windows that another record has too are the maximal exact repeats.

No pair of records is ever formed. Records travel in fixed blocks of some thousand; a
block sends each distinct window once, so a window that a third of all records share costs
its bucket no more than one entry per block of records, and the answer goes back to blocks.
With more than RANGES buckets, windows and answers travel in two steps (see blobs), so that
a row holds hundreds of entries however many blocks and buckets there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.blobs import RANGES, by_bucket, cut, joined, pack, parted, regroup, unpack, width
from residua.llm.copies import members, representatives
from residua.llm.windows import letters, mix, owners, rolling
from residua.llm.workspace import Workspace

#: Letters of one block of records, and windows that a bucket holds at a time, about.
BLOCK_LETTERS, BUCKET_WINDOWS = 1_000_000, 1_500_000


def _number(room_of: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the number of its block to each record; written once, so it never changes."""
    from pyspark import TaskContext

    block, room = TaskContext.get().partitionId() << 32, room_of
    for batch in batches:
        lengths = np.array([len(t) for t in batch.column("text").to_pylist()], np.int64)
        numbers = np.zeros(len(lengths), np.int64)
        for i, n in enumerate(lengths):
            if room < n and room < room_of:
                block, room = block + 1, room_of
            numbers[i] = block
            room -= n
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("rep", "text", "n")} | {"block": numbers})


def _distinct(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and whether more than one record of the block has each."""
    order = np.lexsort((owner, hashes))
    h, o = hashes[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    last = np.concatenate([edge[1:], [len(h)]]).astype(int) - 1
    return h[edge], o[edge] != o[last] if len(h) else np.zeros(0, bool)


def _rows(block: int, buckets: int, per: int, keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[dict]:
    """Entries of a block by range of ``per`` buckets; ``keys`` are 64-bit hashes. Behind the columns: the sender and its number of entries."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    if per > 1:
        columns = [(bucket % per).astype(np.uint32), *columns]
    for key, part in parted(bucket // per, columns):
        yield {"bucket": key, "block": block, "blob": pack([*part, np.array([block]), np.array([len(part[0])])])}


def _finer(per: int, now: int, columns: list[np.ndarray]) -> Iterator[dict]:
    """Entries of a range by bucket, as ``_rows`` has them."""
    within, *rest, blocks, counts = columns
    for bucket, part in parted(now * per + within.astype(np.int64), [*rest, np.repeat(blocks, counts)]):
        sender = part[-1]
        edge = np.flatnonzero(np.concatenate([[True], sender[1:] != sender[:-1]]))
        yield {"bucket": bucket, "block": -1, "blob": pack([*part[:-1], sender[edge], np.diff(np.concatenate([edge, [len(sender)]]))])}


def _per_block(_range: int, columns: list[np.ndarray]) -> Iterator[dict]:
    for block, (codes,) in parted(columns[1], [columns[0]]):
        yield {"bucket": 0, "block": block, "blob": pack([codes])}


_SENT = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])
_SENT_SQL = "bucket long, block long, blob binary"


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    numbers = batch.column("block").to_numpy(zero_copy_only=False)
    for number in np.unique(numbers):
        yield int(number), batch.filter(pa.array(numbers == number))


def _anchors(span: int, buckets: int, per: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block of records and bucket: distinct rolling windows, which of them repeat inside, which are indexed blocks."""
    half = span // 2
    for batch in batches:
        for block, part in _blocks(batch):
            points, lengths = letters(part.column("text").to_pylist())
            owner, place = owners(lengths, half)
            hashes = rolling(points, half, 1)[place] if len(place) else np.zeros(0, np.uint64)
            first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            fixed = np.unique(hashes[(place - first[owner]) % half == 0])
            distinct, several = _distinct(hashes, owner)
            flags = several.astype(np.uint8) | (np.isin(distinct, fixed, assume_unique=True).astype(np.uint8) << 1)
            short = (distinct >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_pylist(list(_rows(block, buckets, per, distinct, [short, flags])), _SENT)


def _meet(indexed: bool, wide: bool, bucket: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Windows that more than one record has (and, of anchors, that some record has as a block), per block that sent them."""
    *keys, flags, blocks, counts = joined([r["blob"] for r in rows])
    sender = np.repeat(blocks, counts)
    order = np.lexsort((sender, *keys[::-1]))
    keys, flags, sender = [k[order] for k in keys], flags[order], sender[order]
    new = np.zeros(len(flags), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1) | (np.bincount(group, weights=flags & 1) > 0)
    if indexed:
        shared &= np.bincount(group, weights=flags & 2) > 0
    hit = np.flatnonzero(shared[group])
    codes, sender = keys[-1][hit], sender[hit]
    if wide:  # whole codes by range of blocks, cut by block in a second step
        codes = codes.astype(np.uint64) | (np.uint64(bucket) << np.uint64(32)) if codes.dtype == np.uint32 else codes
        ranges = (mix(sender.astype(np.uint64)) % np.uint64(RANGES)).astype(np.int64)
        found = [{"bucket": r, "block": -1, "blob": blob} for r, blob in cut(ranges, [codes, sender])]
    else:
        found = [{"bucket": bucket, "block": block, "blob": pack(part)} for block, part in parted(sender, [codes])]
    if found:
        yield pa.RecordBatch.from_pylist(found, _SENT)


def _answers(answers: pa.Table) -> np.ndarray:
    """The windows that were answered, sorted: anchors as bucket and 32 bits, long windows by their second hash."""
    parts = []
    for row in answers.to_pylist():
        found = unpack(row["blob"])[0]
        parts.append(found if found.dtype == np.uint64 else found.astype(np.uint64) | (np.uint64(row["bucket"]) << np.uint64(32)))
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))


def _isin(codes: np.ndarray, answered: np.ndarray) -> np.ndarray:
    if not len(answered):
        return np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(answered, codes), len(answered) - 1)
    return answered[at] == codes


def _near_anchors(span: int, buckets: int, part: pa.Table, answered: np.ndarray):
    """Places of the ``span``-letter windows of a block that hold an anchor hit, their owners, and two hashes of each."""
    half = span // 2
    points, lengths = letters(part.column("text").to_pylist())
    owner, place = owners(lengths, half)
    hashes = rolling(points, half, 1)[place] if len(place) else np.zeros(0, np.uint64)
    # A window has a hit if one of the rolling windows inside it, span - half to the right at most, has one.
    total = np.zeros(len(points) + 1, np.int64)
    total[1 + place[_isin(_codes(hashes, buckets), answered)]] = 1
    total = np.cumsum(total)
    owner, place = owners(lengths, span)
    held = total[place + span - half + 1] > total[place]
    owner, place = owner[held], place[held]
    return owner, place, rolling(points, span, 2)[place], rolling(points, span, 3)[place], lengths


def _extend(span: int, buckets: int, per: int, _key, part: pa.Table, answers: pa.Table) -> pa.Table:
    """All windows around the hits of a block, each distinct one once, by bucket."""
    block = part.column("block")[0].as_py() if part.num_rows else None
    if block is None or not answers.num_rows:
        return _SENT.empty_table()
    owner, _, one, two, _ = _near_anchors(span, buckets, part, _answers(answers))
    order = np.lexsort((owner, two, one))
    one, two, owner = one[order], two[order], owner[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    edge = np.flatnonzero(new)
    last = np.concatenate([edge[1:], [len(one)]]).astype(int) - 1
    flags = (owner[edge] != owner[last]).astype(np.uint8) if len(edge) else np.zeros(0, np.uint8)
    one, two = one[edge], two[edge]
    # 32 bits of the first hash and 64 of the second, besides the bucket: about 100 bits decide equality.
    rows = list(_rows(block, buckets, per, one, [(one >> np.uint64(32)).astype(np.uint32), two, flags]))
    return pa.Table.from_pylist(rows, _SENT)


def _runs(span: int, buckets: int, _key, part: pa.Table, both: pa.Table) -> pa.Table:
    """Maximal runs of shared positions of each record of a block (1-based, inclusive)."""
    reps = part.column("rep").to_numpy(zero_copy_only=False)
    copies = part.column("n").to_numpy(zero_copy_only=False)
    texts = part.column("text").to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = np.flatnonzero((copies > 1) & (lengths >= span))
    found = [(reps[whole], np.ones(len(whole), np.int64), lengths[whole])]
    if both.num_rows and part.num_rows:
        kind = both.column("kind").to_numpy(zero_copy_only=False)
        first, second = both.filter(pa.array(kind == 1)), both.filter(pa.array(kind == 2))
        owner, place, _, two, lengths = _near_anchors(span, buckets, part, _answers(first))
        good = _isin(two, _answers(second)) & ~((copies > 1)[owner] if len(owner) else np.zeros(0, bool))
        owner, place = owner[good], place[good]
        if len(owner):
            start = np.ones(len(owner), bool)
            start[1:] = (owner[1:] != owner[:-1]) | (place[1:] > place[:-1] + span)
            edge = np.flatnonzero(start)
            last = np.concatenate([edge[1:], [len(owner)]]).astype(int) - 1
            base = np.concatenate([[0], np.cumsum(lengths)])[:-1][owner[edge]]
            found.append((reps[owner[edge]], place[edge] - base + 1, place[last] - base + span))
    columns = [np.concatenate([f[i] for f in found]) for i in range(3)]
    return pa.table({"rep": columns[0].astype(np.int64), "span_start": columns[1].astype(np.int64), "span_end": columns[2].astype(np.int64)})


def _exchange(sent: DataFrame, indexed: bool, per: int, parts: int) -> DataFrame:
    """The answers of all buckets, by block."""
    if per > 1:
        sent = regroup(sent, parts, partial(_finer, per), _SENT_SQL)
    answers = by_bucket(sent, parts, partial(_meet, indexed, per > 1), _SENT_SQL)
    return regroup(answers, parts, _per_block, _SENT_SQL) if per > 1 else answers


def shared_spans(rows: DataFrame, span: int = 40, *, buckets: int | None = None, block_letters: int = BLOCK_LETTERS, workspace: Workspace | None = None) -> DataFrame:
    """Maximal runs of positions of each record that lie in a window of ``span`` letters another record has too.

    ``rows`` has ``id`` (unique) and ``text``. Result: ``id``, ``span_start``, ``span_end`` (1-based, inclusive).
    Null texts and those shorter than ``span`` share nothing; a window that only its own
    record repeats is not shared; copies share their whole text; an empty table gives an
    empty result; other columns are left out.
    """
    if span < 2 or span % 2:
        raise ValueError("span must be even and at least 2")
    spark = rows.sparkSession
    workspace = workspace or Workspace(spark)
    rows = rows.where(F.length("text") >= span)
    reps = representatives(rows).select("rep", "text", "n")
    blocks = workspace.save(reps.mapInArrow(partial(_number, block_letters), "rep long, text string, n long, block long"), "span-blocks")
    letters_all = blocks.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    full = max(32, -(-letters_all // BUCKET_WINDOWS))
    parts = min(4 * RANGES, max(spark.sparkContext.defaultParallelism, full // 2))
    buckets = buckets or full
    per = width(buckets)
    by_block = blocks.groupBy("block")
    sent = blocks.mapInArrow(partial(_anchors, span, buckets, per), _SENT_SQL)
    anchors = workspace.save(_exchange(sent, True, per, parts), "span-anchors")
    around = by_block.cogroup(anchors.groupBy("block")).applyInArrow(partial(_extend, span, buckets, per), _SENT_SQL)
    windows = workspace.save(_exchange(around, False, per, parts), "span-windows")
    both = anchors.withColumn("kind", F.lit(1)).unionAll(windows.withColumn("kind", F.lit(2)))
    runs = by_block.cogroup(both.groupBy("block")).applyInArrow(partial(_runs, span, buckets), "rep long, span_start long, span_end long")
    runs = workspace.save(runs, "span-runs")
    workspace.drop("span-anchors")
    workspace.drop("span-windows")
    concerned = blocks.join(runs.select("rep").distinct(), "rep", "left_semi")
    return members(rows, concerned).join(runs, "rep").select("id", "span_start", "span_end")
