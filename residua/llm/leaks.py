"""Passages of held-out items inside a corpus: every window of normalised words against a hash set."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.workspace import Workspace

#: Windows of items that are broadcast at a time (about 100 bytes each); more go in blocks, with one scan of the corpus each.
BLOCK_WINDOWS = 500_000
_FORMAT = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_PIECE = regex.compile(r"[^\s]+")


def normal(text: str) -> str:
    """NFKC, without format characters, lower case."""
    if text.isascii():
        return text.lower()
    return _FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower()


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the normalised text."""
    return _WORD.findall(normal(text))


def item_blocks(items: Iterator[tuple[int, str]], width: int, most: int) -> Iterator[dict[tuple[str, ...], list[int]]]:
    """Each window of ``width`` words with the items that have it, in blocks of ``most`` windows; one block is held at a time."""
    known: dict[tuple[str, ...], list[int]] = {}
    for ident, text in items:
        tokens = words(text)
        for i in range(len(tokens) - width + 1):
            holders = known.setdefault(tuple(tokens[i : i + width]), [])
            if not holders or holders[-1] != ident:
                holders.append(ident)
            if len(known) >= most:
                yield known
                known = {}
    if known:
        yield known


def hit_places(tokens: list[str], known: dict, vocabulary: frozenset, width: int) -> list[int]:
    """First words of the windows of ``tokens`` that are in ``known``; only runs of item words are looked up."""
    places, run = [], 0
    for i, token in enumerate(tokens):
        run = run + 1 if token in vocabulary else 0
        if run >= width and tuple(tokens[i - width + 1 : i + 1]) in known:
            places.append(i - width + 1)
    return places


def _scan(shared, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, vocabulary = shared.value
    for batch in batches:
        docs, items = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens = words(text)
            leaked = {item for i in hit_places(tokens, known, vocabulary, width) for item in known[tuple(tokens[i : i + width])]}
            docs += [doc] * len(leaked)
            items += sorted(leaked)
        yield pa.RecordBatch.from_pydict({"doc": pa.array(docs, pa.int64()), "item": pa.array(items, pa.int64())})


def _hits(shared, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every hit: number of its first word in the text, and the place of the pieces it lies in."""
    known, vocabulary = shared.value
    for batch in batches:
        docs, found = [], []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            # Words and their places are found piece by piece, so that places in the stored text are known.
            tokens, ends = [], []
            for m in _PIECE.finditer(text):
                for token in words(m.group()):
                    tokens.append(token)
                    ends.append(m.span())
            for i in hit_places(tokens, known, vocabulary, width):
                docs.append(doc)
                found.append((i, ends[i][0], ends[i + width - 1][1]))
        columns = zip(*found, strict=True) if found else ([], [], [])
        yield pa.RecordBatch.from_pydict({"doc": pa.array(docs, pa.int64())} | {n: pa.array(list(c), pa.int32()) for n, c in zip(("word", "start", "stop"), columns, strict=True)})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            kept, at, cut_to = [], 0, -1
            for hit in hits:
                if hit["start"] > cut_to:
                    kept.append(text[at : hit["start"]])
                at = cut_to = max(cut_to, hit["stop"])
            kept.append(text[at:])
            texts.append("".join(kept))
            counts.append(len(hits))
        yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "text": pa.array(texts, pa.string()), "windows": pa.array(counts, pa.int64())})


def _over_blocks(docs: DataFrame, items: DataFrame, item_id: str, item_text: str, width: int, most: int, work: Callable, schema: str, workspace: Workspace | None) -> DataFrame:
    """``work`` over the documents for every block of item windows; a second block begins only once the first is written."""
    spark = docs.sparkSession
    usable = items.select(F.col(item_id).cast("long").alias("doc"), F.col(item_text).alias("text")).dropna()
    found, held = None, None
    for i, known in enumerate(item_blocks(((r.doc, r.text) for r in usable.toLocalIterator()), width, most)):
        if held is not None:
            workspace = workspace or Workspace(spark)
            done = workspace.save(held[1], f"leaks-{schema.count(',')}-{i}")
            held[0].destroy()
            found = done if found is None else found.unionAll(done)
        shared = spark.sparkContext.broadcast((known, frozenset(word for window in known for word in window)))
        held = shared, docs.mapInArrow(partial(work, shared, width), schema)
    last = held[1] if held is not None else spark.createDataFrame([], schema)
    return (last if found is None else found.unionAll(last)).distinct()


def _usable(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).dropna()


def leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 12, *, block: int = BLOCK_WINDOWS, workspace: Workspace | None = None
) -> DataFrame:
    """Documents that hold ``width`` consecutive words of an item, with the item: ``doc``, ``item``.

    The items' windows are broadcast as a hash set, ``block`` of them at a time, and the documents
    are scanned once per block without a shuffle. Windows are compared word by word, so a
    hit needs no later check. Null texts, and texts or items of fewer words, have no hits; items
    with equal passages are all reported; repeated rows give one row; an empty table gives an empty
    result; other columns are left out.
    """
    return _over_blocks(_usable(documents, doc_id, text), items, item_id, item_text, width, block, _scan, "doc long, item long", workspace)


def without_leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, width: int = 12, *, block: int = BLOCK_WINDOWS, workspace: Workspace | None = None
) -> DataFrame:
    """The leaking documents with the leaked spans cut out: ``doc``, ``text``, ``windows`` (hits found).

    Spans are cut at white space, from the first to the last word of the hits; a passage whose
    words are joined by white space that is removed (format characters aside) is cut as a
    whole. Null texts and clean documents give no row; ids must be unique.
    """
    docs = _usable(documents, doc_id, text)
    hits = _over_blocks(docs, items, item_id, item_text, width, block, _hits, "doc long, word int, start int, stop int", workspace)
    # The hits of a document are no more than its words.
    places = hits.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "word"))).alias("hits"))
    return docs.join(places, "doc").select("doc", "text", "hits").mapInArrow(_cut, "doc long, text string, windows long")
