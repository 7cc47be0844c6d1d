"""Text decoded with a wrong character encoding: found and restored through the garbled forms of corpus words.

Every distinct corpus word that is not plain ASCII is put through wrong decodings of its legacy or UTF-8 bytes; from the
other end, readings of UTF-8 bytes are undone as often as they go. The
forms are joined by hash with the words of the documents; a word that is the garbled form
of another is accepted where it cannot be clean text, where corpus counts confirm it or where another
word of its document went through the same chain, and is replaced by its original.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua.llm.workspace import Workspace

#: The encodings that text is written in, and those it is wrongly read in.
UTF8_READ_AS = (
    "cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1254", "iso8859-9", "cp1257", "cp1253", "iso8859-7", "cp1251", "koi8-r",
    "koi8-u", "cp866", "iso8859-5", "mac-cyrillic", "cp437", "cp850", "cp852", "cp858", "mac-roman", "gbk", "gb18030", "gb2312", "cp932", "shift_jis", "big5", "cp949", "euc-kr", "euc-jp", "cp874",
)
WRITTEN_IN = ("cp1252", "iso8859-15", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-roman", "cp850", "cp437", "cp1253", "mac-cyrillic")
READ_AS = (
    "cp1252", "latin-1", "cp437", "cp850", "cp852", "mac-roman", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1250", "iso8859-2", "cp1253", "iso8859-7",
    "cp1254", "cp1257", "gbk", "cp932", "shift_jis", "big5", "cp949", "utf-8",
)
TWICE = ("cp1252", "latin-1", "cp437", "cp850", "mac-roman", "cp1251", "cp1250")
#: Forms that no clean text can hold are believed whatever their count. Of the rest, documents with a garbled form,
#: as a share of those with the original word, that are believed at most without further evidence: for
#: a chain that starts from UTF-8 bytes (its forms look like nothing else), for any other, and for any other that
#: gives a single sign (rare signs are also written on purpose).
MOST_UTF8, MOST_OTHER, MOST_SIGN = 0.5, 0.1, 0.003
#: The same for a single sign in a document that has another word of the same chain.
MOST_SIGNS = 0.2
#: Letters from which a word that looks clean is believed once fewer documents have it than its original.
LONG = 4
#: Garbled words up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_FORMS = 200_000
#: Bits of the filter that holds the corpus words, by which forms are dropped before they leave their task: 16 a word, but
#: never more than 2 ** MOST_BITS (16 MB), beyond which it lets more forms pass but still loses none; and bytes of one piece of it.
BITS_PER_WORD, LEAST_BITS, MOST_BITS, PIECE = 16, 16, 27, 8192
#: A run of letters, digits and signs beyond ASCII, with at least one of the latter.
WORD = r"(?<![0-9A-Za-z\x{80}-\x{10FFFF}])[0-9A-Za-z]*+[\x{80}-\x{10FFFF}][0-9A-Za-z\x{80}-\x{10FFFF}]*+"
_WORD = regex.compile(WORD.replace("x{80}", "u0080").replace("x{10FFFF}", "U0010ffff"))


def readings(raw: bytes, codec: str) -> set[str]:
    """What ``raw`` may look like when read in ``codec``: bytes without a meaning kept, dropped or marked."""
    try:
        return {raw.decode(codec)}
    except UnicodeDecodeError:
        pass
    found = {raw.decode(codec, "replace"), raw.decode(codec, "ignore")}
    if len(b"\x00".decode(codec)) == 1 and codec.startswith(("cp125", "iso8859", "cp874")):
        kept = []
        for byte in raw:
            try:
                kept.append(bytes([byte]).decode(codec))
            except UnicodeDecodeError:
                kept.append(chr(byte))
        found.add("".join(kept))
    return found


@lru_cache(maxsize=200_000)
def chains(word: str) -> dict[str, tuple[str, frozenset[int]]]:
    """All forms of ``word`` after wrong decodings: kind (``utf8``, ``twice`` or ``other``), and the numbers of the single legacy chains that give it."""
    found: dict[str, str] = {}
    legacy: dict[str, set[int]] = {}
    raw = word.encode("utf-8", "surrogatepass")
    first: list[str] = []
    for codec in UTF8_READ_AS:
        for form in readings(raw, codec):
            found.setdefault(form, "utf8")
            if codec in TWICE:
                first.append(form)
    second: list[str] = []
    for form in dict.fromkeys(first):
        for codec in TWICE:
            for again in readings(form.encode("utf-8", "surrogatepass"), codec):
                found.setdefault(again, "twice")
                if codec in TWICE[:2]:
                    second.append(again)
    for form in dict.fromkeys(second):
        for codec in TWICE[:2]:
            for again in readings(form.encode("utf-8", "surrogatepass"), codec):
                found.setdefault(again, "twice")
    for i, source in enumerate(WRITTEN_IN):
        try:
            raw = word.encode(source)
        except UnicodeEncodeError:
            continue
        for j, codec in enumerate(READ_AS):
            if codec != source:
                for form in readings(raw, codec):
                    found.setdefault(form, "other")
                    legacy.setdefault(form, set()).add(i * len(READ_AS) + j)
    found.pop(word, None)
    found.pop("", None)
    return {form: (kind, frozenset(legacy.get(form, ()))) for form, kind in found.items() if not form.isascii()}


def garbled(word: str) -> dict[str, str]:
    """All forms of ``word`` after one or more wrong decodings, with the kind of chain: ``utf8``, ``twice`` or ``other``."""
    return {form: kind for form, (kind, _) in chains(word).items()}


def unclean(word: str) -> int:
    """Signs that ``word`` cannot have been written so: control signs, lost bytes, and letters with other scripts, capitals or symbols in their midst."""
    count = 0
    for at, sign in enumerate(word):
        if sign < "\x80":
            continue
        if sign < "\xa0" or sign == "\ufffd":
            count += 1
            continue
        left, right = word[at - 1] if at else "", word[at + 1] if at + 1 < len(word) else ""
        kind = unicodedata.category(sign)
        if "\u2500" <= sign <= "\u259f":
            count += left.isalpha() or right.isalpha()
        elif left.isalpha() and right.isalpha():
            if kind[0] == "S" or kind == "No":
                count += 1
            elif kind[0] == "L" and (_script(left) == _script(right) != _script(sign)):
                count += 1
        if kind == "Lu" and left.islower() or kind == "Ll" and _script(sign) == "LATIN" and right.isascii() and right.isupper():
            count += 1
    return count


def _script(letter: str) -> str:
    return unicodedata.name(letter, "").split(" ")[0]


def believable(word: str, original: str, kind: str, undone: bool, docs: int, original_docs: int) -> int:
    """3: garbled whatever the counts; 2: garbled by the counts; 1: garbled if another word of its document has the same chain; 0: not garbled."""
    single = len(word) == 1
    if single and undone:
        return 0
    most = MOST_UTF8 if kind != "other" else MOST_SIGN if single and word != "\ufffd" else MOST_OTHER
    if not single and (undone or kind == "other" and unclean(word) > 0 == unclean(original)):
        return 3
    if not single and kind != "other" and (unclean(word) > unclean(original)):
        return 3
    if docs <= most * original_docs:
        return 2
    if unclean(word) < unclean(original) or docs >= original_docs or (single and docs > MOST_SIGNS * original_docs):
        return 0
    return 2 if len(word) >= LONG else 1


@lru_cache(maxsize=64)
def _lost(codec: str) -> tuple[int, ...]:
    """Continuation bytes without a meaning in a codec of single bytes."""
    found = []
    for byte in range(0x80, 0xC0):
        try:
            bytes([byte]).decode(codec)
        except UnicodeDecodeError:
            found.append(byte)
    return tuple(found) if len(found) < 32 else ()


def _filled(raw: list[int], lost: tuple[int, ...]) -> list[bytes]:
    """``raw`` with its marked bytes (-1) put back in all ways that give UTF-8, up to 64."""
    whole = [b""]
    for byte in raw:
        whole = [done + bytes([put]) for done in whole for put in ((byte,) if byte >= 0 else lost)]
        if byte >= 0x80:
            continue
        kept = []
        for done in whole[:4096]:
            try:
                done.decode("utf-8")
            except UnicodeDecodeError as error:
                if error.reason != "unexpected end of data":
                    continue
            kept.append(done)
        whole = kept[:64]
    return whole


def _one_undone(word: str) -> set[str]:
    found, marked = set(), any("\x80" <= c < "\xa0" or c == "\ufffd" for c in word)
    for codec in UTF8_READ_AS:
        try:
            found.add(word.encode(codec).decode("utf-8"))
            continue
        except UnicodeError:
            lost = marked and _lost(codec)
        if not lost or not all(c < "\xa0" or c == "\ufffd" or _fits(c, codec) for c in word):
            continue
        raw = [-1 if c == "\ufffd" else c.encode(codec)[0] if _fits(c, codec) else ord(c) for c in word]
        for text in _filled(raw, lost):
            try:
                found.add(text.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return {text for text in found if text and not text.isascii() and text != word}


@lru_cache(maxsize=100_000)
def _fits(sign: str, codec: str) -> bool:
    try:
        return len(sign.encode(codec)) == 1
    except UnicodeEncodeError:
        return False


def undone(word: str) -> set[str]:
    """What ``word`` was before the last, the last two, ... readings of its UTF-8 bytes in any encoding, as far back as it goes."""
    found, fresh = set(), {word}
    while fresh:
        fresh = {earlier for later in fresh for earlier in _one_undone(later)} - found - {word}
        found |= fresh
    return found


def _marked(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a bit filter with any of the hashes of a partition."""
    held = np.zeros(1 << bits, bool)
    for batch in batches:
        hashes = batch.column("h").to_numpy(zero_copy_only=False).astype(np.uint64)
        for shift in (0, 32):
            held[((hashes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    packed = np.packbits(held, bitorder="little").reshape(-1, min(PIECE, (1 << bits) // 8))
    some = np.flatnonzero(packed.any(axis=1))
    for at in range(0, len(some), 256):
        rows = [(int(i), packed[i].tobytes()) for i in some[at : at + 256]]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _united(table: pa.Table) -> pa.Table:
    rows = [np.frombuffer(b, np.uint8) for b in table.column("blob").to_pylist()]
    return pa.table({"piece": table.column("piece").slice(0, 1).cast(pa.int32()), "blob": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})


def word_filter(words: DataFrame, column: str, n: int) -> bytes:
    """Bits set at two places of the hash of every word; a power of two of them, 16 MB at most."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(BITS_PER_WORD * max(1, n))))))
    marks = words.select(F.xxhash64(column).alias("h")).mapInArrow(partial(_marked, bits), "piece int, blob binary")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for row in marks.groupBy("piece").applyInArrow(_united, "piece int, blob binary").toLocalIterator():
        part = np.frombuffer(row.blob, np.uint8)
        whole[row.piece * len(part) : (row.piece + 1) * len(part)] = part
    return whole.tobytes()


def passes(whole: bytes, word: str) -> bool:
    """False only if ``word`` is none of the words of the filter."""
    h, last = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42), len(whole) * 8 - 1  # as Spark hashes it
    low, high = h & last, (h >> 32) & last
    return bool(whole[low >> 3] >> (low & 7) & 1 and whole[high >> 3] >> (high & 7) & 1)


def _forms(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = shared.value
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows = [
                (form, word, kind, sorted(numbers), count)
                for word, count in zip(part.column("word").to_pylist(), part.column("docs").to_pylist(), strict=True)
                for form, (kind, numbers) in [(word, ("", ())), *chains(word).items()]
                if passes(whole, form)
            ]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            names = (("form", pa.string()), ("original", pa.string()), ("kind", pa.string()), ("chains", pa.list_(pa.int32())), ("original_docs", pa.int64()))
            yield pa.RecordBatch.from_pydict({name: pa.array(list(c), kind) for (name, kind), c in zip(names, columns, strict=True)})


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [
            (form, word, count, form != word)
            for word, count in zip(batch.column("word").to_pylist(), batch.column("docs").to_pylist(), strict=True)
            for form in [word, *undone(word)]
        ]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        names = (("form", pa.string()), ("word", pa.string()), ("docs", pa.int64()), ("undone", pa.bool_()))
        yield pa.RecordBatch.from_pydict({name: pa.array(list(c), kind) for (name, kind), c in zip(names, columns, strict=True)})


def _as_utf8_only(form: str, numbers: list[int]) -> bool:
    """Only legacy bytes read as UTF-8 give ``form``, with nothing marked: read back, that is clean text less a sign."""
    return bool(numbers) and "\ufffd" not in form and all(READ_AS[n % len(READ_AS)] == "utf-8" for n in numbers)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("word", "original", "kind", "undone", "docs", "original_docs")]
        there_and_back = [again and _as_utf8_only(*x) for again, *x in zip(columns[3], *(batch.column(name).to_pylist() for name in ("form", "chains")), strict=True)]
        belief = pa.array([0 if same else believable(*row) for same, row in zip(there_and_back, zip(*columns, strict=True), strict=True)], pa.int32())
        yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in ("word", "original", "kind", "chains", "original_docs")} | {"belief": belief})


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, done, left = [], [], []
        for text, pairs in zip(batch.column("text").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            table = {p["word"]: p["original"] for p in pairs}
            lossless = {w: o for w, o in table.items() if "\ufffd" not in w}
            texts.append(_WORD.sub(lambda m, t=lossless: t.get(m.group(), m.group()), text))
            done.append(len(lossless))
            left.append(len(table) - len(lossless))
        yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "text": pa.array(texts, pa.string()), "restored": pa.array(done, pa.int64()), "unrestored": pa.array(left, pa.int64())})


class Garbled:
    """Garbled words of a corpus, the documents that hold them, and their restored texts.

    ``documents``: a unique integer id and a text. Words count once per document. Null, empty and
    plain ASCII texts are never garbled; repeated texts are judged alike; an empty table
    gives empty results; other columns are left out.
    """

    def __init__(self, documents: DataFrame, doc_id: str, text: str, *, workspace: Workspace | None = None):
        self.workspace = workspace or Workspace(documents.sparkSession)
        self.docs = documents.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
        beyond = self.docs.where(F.col("text").rlike(r"[^\x00-\x7F]"))
        spoken = beyond.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("word"))
        self.spoken = self.workspace.save(spoken, "garbled-words")
        vocabulary = self.workspace.save(self.spoken.groupBy("word").agg(F.count(F.lit(1)).alias("docs")), "garbled-vocabulary")
        earlier = self.workspace.save(vocabulary.mapInArrow(_earlier, "form string, word string, docs long, undone boolean"), "garbled-earlier")
        spark = documents.sparkSession
        shared = spark.sparkContext.broadcast(word_filter(earlier, "form", earlier.count()))
        spread = vocabulary.repartition(4 * spark.sparkContext.defaultParallelism)
        forms = spread.mapInArrow(partial(_forms, shared), "form string, original string, kind string, chains array<int>, original_docs long")
        pairs = forms.join(earlier, "form").where("word <> original")
        judged = pairs.mapInArrow(_judged, "word string, original string, kind string, chains array<int>, original_docs long, belief int").where("belief > 0")
        judged = self.workspace.save(judged, "garbled-judged")
        sure = judged.where("belief = 3").select(F.col("word").alias("original")).distinct()
        believed = judged.where("belief = 3").unionByName(judged.where("belief < 3").join(sure, "original", "left_anti"))
        best = believed.groupBy("word").agg(
            F.min(F.struct((-F.col("original_docs")).alias("o"), F.col("original"), F.col("kind"))).alias("b"),
            F.array_distinct(F.flatten(F.collect_list("chains"))).alias("chains"),
            F.max("belief").alias("belief"),
        )
        self.table = self.workspace.save(best.select("word", "b.original", "b.kind", "chains", "belief"), "garbled-table")
        self._small = self.table.count() <= BROADCAST_FORMS

    def hits(self) -> DataFrame:
        """``doc``, ``word``, ``original``, ``kind``: every garbled word of every document."""
        found = self.spoken.join(F.broadcast(self.table) if self._small else self.table, "word")
        plain = found.where("belief > 1").select("doc", "word", "original", "kind")
        weak = found.where("belief = 1").select("doc", "word", "original", "kind", F.explode("chains").alias("chain"))
        others = found.join(weak.select("doc").distinct(), "doc", "left_semi").select("doc", F.explode("chains").alias("chain"))
        shared = others.groupBy("doc", "chain").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc", "chain")
        return plain.unionByName(weak.join(shared, ["doc", "chain"], "left_semi").drop("chain").distinct())

    def documents(self) -> DataFrame:
        """``doc`` of the documents with a garbled word."""
        return self.hits().select("doc").distinct()

    def restored(self) -> DataFrame:
        """``doc``, ``text`` with the originals put in, words ``restored``, and ``unrestored`` as bytes were lost."""
        pairs = self.hits().groupBy("doc").agg(F.collect_list(F.struct("word", "original")).alias("pairs"))
        return self.docs.join(pairs, "doc").mapInArrow(_restore, "doc long, text string, restored long, unrestored long")
