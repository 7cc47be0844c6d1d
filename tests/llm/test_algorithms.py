import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua.llm import blobs, forest, history, spans, windows
from residua.llm.components import connected_groups
from residua.llm.topn import top_n

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def protein(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        i = rng.randrange(len(letters))
        kind = rng.random()
        if kind < 0.5:
            letters[i] = rng.choice(LETTERS)
        elif kind < 0.75:
            letters.insert(i, rng.choice(LETTERS))
        else:
            del letters[i]
    return "".join(letters)


def family(seed, roots=8, size=6):
    rng, texts = random.Random(seed), []
    for _ in range(roots):
        root = protein(rng, rng.choice([7, 20, 45, 90, 160, 300, 700]))
        texts.append(root)
        for _ in range(size - 1):
            kind = rng.random()
            if kind < 0.2:
                texts.append(root)
            elif kind < 0.3:
                cut = len(root) // 2
                texts.append(root[cut:] + root[:cut])
            else:
                texts.append(edited(rng, root, rng.randrange(1, max(2, len(root) // 25))))
    return texts


def similarity(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


ODD = ["", "ACD", None, "QN" * 60, "QN" * 61, "Ã©ß語" * 12, "Ã©ß語" * 12]


def test_windows_are_exact():
    rng = random.Random(1)
    texts = [protein(rng, n) for n in (3, 5, 40, 200)] + ["語" * 9 + "abc", "QN" * 30]
    near = windows.similarities([a for a in texts for _ in texts], [b for _ in texts for b in texts])
    assert near.tolist() == pytest.approx([similarity(a, b) for a in texts for b in texts])
    points, _ = windows.letters(["ACDEFGHACDEFGH"])
    for width in (2, 5, 7):
        h = windows.rolling(points, width, 1)
        assert len(h) == 15 - width and h[0] == h[7] and len(set(h.tolist())) == 7


def test_pairs_of_runs_in_chunks():
    for limit in (3, 50, 10**6):
        got = set()
        for i, j in windows.pairs_of_runs(np.array([0, 1, 5, 8]), np.array([1, 4, 3, 9]), limit):
            got |= set(zip(i.tolist(), j.tolist(), strict=True))
        assert got == {(a, b) for f, n in ((1, 4), (5, 3), (8, 9)) for a in range(f, f + n) for b in range(a + 1, f + n)}


def test_blobs_return_what_was_packed():
    arrays = [np.array([1, 2], np.uint32), np.array([], np.int64), np.array([0.5])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(blobs.unpack(blobs.pack(arrays)), arrays, strict=True))
    assert [(b, blobs.unpack(x)[0].tolist()) for b, x in blobs.cut(np.array([3, 1, 3]), [np.array([7, 8, 9])])] == [(1, [8]), (3, [7, 9])]
    assert list(blobs.cut(np.array([], int), [np.array([])])) == []


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g, i] = max(best.get((g, i), float("-inf")), s)
    groups = {}
    for (g, i), s in best.items():
        groups.setdefault(g, []).append((-s, i))
    return {(g, i, r + 1) for g, items in groups.items() for r, (_, i) in enumerate(sorted(items)[:n])}


@pytest.mark.parametrize("quantiles", [(0.85, 0.5), (0.99, 0.9, 0.5, 0.1), ()])
def test_top_n(spark, quantiles):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", f"g{rng.randrange(40)}"]), f"t{rng.randrange(60)}", float(rng.randrange(12))) for _ in range(3000)]
    rows += rows[:50] + [(None, "a", 1.0), ("g1", None, 1.0), ("g1", "x", None), ("g1", "x", float("nan")), ("inf", "x", float("inf")), ("inf", "y", float("-inf")), ("tie", "é", 1.0), ("tie", "z", 1.0)]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "g string, t string, s double, _rank int, _band string")
    got = {(r.g, r.t, r["rank"]) for r in top_n(frame, ["g"], "t", "s", 5, quantiles=quantiles).collect()}
    assert got == brute_top(rows, 5)
    assert top_n(frame.limit(0), ["g"], "t", "s", 5).count() == 0


def brute_groups(links):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{rng.randrange(400):03d}", f"n{rng.randrange(400):03d}") for _ in range(160)]
    chain = [f"c{i:03d}" for i in range(70)]
    rng.shuffle(chain)
    links += list(zip(chain, chain[1:], strict=False)) + [("hub", f"h{i}") for i in range(300)] + [("self", "self"), (None, "x"), ("y", None)] + links[:9]
    frame = spark.createDataFrame([(*x, 1, "p") for x in links], "a string, b string, c int, root string")
    got = {r.record: r.group for r in connected_groups(frame, "a", "b").collect()}
    assert got == brute_groups(links)
    assert connected_groups(frame.limit(0), "a", "b").count() == 0


def test_components_with_hot_labels(spark, monkeypatch):
    from residua.llm import components

    monkeypatch.setattr(components, "HOT_SHARE", 10**9)
    monkeypatch.setattr(components, "LEAST", 20)
    monkeypatch.setattr(components, "EASY", 0)
    links = [("m", f"a{i:04d}") for i in range(1500)] + [(f"a{i:04d}", f"b{i:04d}") for i in range(0, 1500, 3)] + [("z1", "z2")]
    links += [(f"k{i // 2:04d}", f"k{i:04d}") for i in range(1, 700)]
    got = {r.record: r.group for r in connected_groups(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert got == brute_groups(links)


def test_a_hot_key_is_spread_over_partitions(spark, monkeypatch):
    from residua.llm import components

    monkeypatch.setattr(components, "EASY", 0)
    rows = spark.range(40_000).select(F.when(F.col("id") % 50 > 0, "hub").otherwise(F.col("id").cast("string")).alias("p"), F.col("id").alias("c"))
    table = rows.select("p").distinct().select(F.col("p").alias("k"), F.length("p").alias("value"))
    joined = components._look_up(rows, "p", "c", table.hint("merge"), components._hot(rows, "p", 40_000))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 40_000 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_the_second_hash_is_no_function_of_the_first(spark):
    from residua.llm.copies import fingerprint

    frame = spark.range(50).select(F.concat(F.lit("MKV"), F.col("id")).alias("text")).select("text", *fingerprint())
    chained = frame.select("h2", F.xxhash64("text", F.lit(1)).alias("c")).collect()
    assert all(r.h2 != r.c for r in chained) and frame.select("h1", "h2").distinct().count() == 50


def brute_pairs(rows):
    return {(min(i, j), max(i, j)) for i, a in rows for j, b in rows if i != j and a is not None and b is not None and similarity(a, b) >= 0.5}


def test_forest_pairs(spark):
    rows = list(enumerate([*family(5), *ODD]))
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], "id long, text string, a int, rep string")
    got = [(r.a, r.b) for r in forest.similar_pairs(frame, 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    assert forest.similar_pairs(frame.limit(0), 0.5).count() == 0
    texts, pairs = dict(rows), brute_pairs(rows)
    alone = [i for i, t in rows if t is not None and len(t) >= 5]
    groups = brute_groups([*pairs, *[(i, i) for i in alone]])
    same = {i: [j for j in alone if texts[j] == texts[i]] for i in alone}
    near = {i: {texts[j] for j in alone if (min(i, j), max(i, j)) in pairs} - {texts[i]} for i in alone}
    want = {(i, min(same[i]), len(same[i]), len(near[i]), groups[i]) for i in alone}
    assert {tuple(r) for r in forest.similar_groups(frame, 0.5).collect()} == want
    assert forest.similar_groups(frame.limit(0), 0.5).count() == 0


def test_forest_recall_where_every_region_is_divided(spark):
    rng = random.Random(19)
    roots = [protein(rng, 150) for _ in range(300)]
    texts = [*roots, *[edited(rng, t, 9) for t in roots]]
    near = windows.similarities(roots, texts[300:])
    frame = spark.createDataFrame(list(enumerate(texts)), "rep long, text string")
    got = {(r.a, r.b) for r in forest.similar_representatives(frame, 0.5, region=1).collect()}
    want = {(i, i + 300) for i in np.flatnonzero(near >= 0.5).tolist()}
    assert len(want) > 150 and len(want & got) >= 0.95 * len(want) and near[near >= 0.5].mean() < 0.75


@pytest.mark.parametrize("slices", [1, 100_000])
def test_forest_slices_do_not_thin_the_rows(spark, slices):
    rng = random.Random(20)
    rows = [(i, protein(rng, 30)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "rep long, text string").repartition(2)
    per = min(blobs.width(slices * forest.TREES), slices)
    planted = list(forest._plant(range(forest.TREES), slices, per, iter([b for b in frame.toArrow().to_batches()])))
    assert sum(b.num_rows for b in planted) <= forest.TREES + blobs.RANGES
    some = frame.limit(400).unionAll(frame.limit(200).selectExpr("rep + 10000", "concat(text, 'A')"))
    few = {tuple(r) for r in forest.similar_representatives(some.coalesce(1), 0.5, slices=slices).select("a", "b").collect()}
    assert few == brute_pairs([tuple(r) for r in some.collect()])


def test_forest_recall_against_brute_force():
    rng = random.Random(9)
    left = [protein(rng, 200) for _ in range(400)]
    right = [edited(rng, t, 13) for t in left]
    near = windows.similarities(left, right)
    x, y = forest.signatures(left), forest.signatures(right)
    met = ((x >> np.uint64(32)) == (y >> np.uint64(32))).any(axis=0)
    assert (near >= 0.5).sum() > 100 and met[near >= 0.5].mean() > 0.99


def test_forest_regions():
    def sign(*levels):
        return sum(v << 16 * (3 - i) for i, v in enumerate(levels))

    dense = [sign(1, 1, 1, 1)] * 9 + [sign(1, 1, 2, 1)]
    thin = [sign(2, 2, i, 0) for i in range(9)] + [sign(2, 2, 8, 1)]
    signs = np.sort(np.array([*dense, *thin, sign(3, 3, 0, 0), sign(3, 3, 5, 0)], np.uint64))
    first, size, divided = forest.regions(signs, 3)
    assert divided.tolist() == list(range(10, 20))
    assert sorted(zip(first.tolist(), size.tolist(), strict=True)) == [(0, 10), (18, 2), (20, 2)]


def brute_spans(rows, span):
    where = {}
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            where.setdefault(t[k : k + span], set()).add(i)
    out = set()
    for i, t in rows:
        marked = [False] * len(t or "")
        for k in range(len(t or "") - span + 1):
            if len(where[t[k : k + span]]) > 1:
                marked[k : k + span] = [True] * span
        k = 0
        while k < len(marked):
            if marked[k]:
                e = k
                while e < len(marked) and marked[e]:
                    e += 1
                out.add((i, k + 1, e))
                k = e
            else:
                k += 1
    return out


@pytest.mark.parametrize(("block", "buckets"), [(10**6, None), (500, None), (500, 100_000), (10**6, 100_000)])
@pytest.mark.parametrize("span", [40, 10])
def test_shared_spans(spark, block, buckets, span):
    rng = random.Random(4)
    shared = [protein(rng, n) for n in (9, 39, 40, 41, 80)]
    texts = [protein(rng, rng.randrange(0, 120)) + rng.choice(shared) + protein(rng, rng.randrange(0, 90)) + rng.choice(shared) for _ in range(30)]
    texts += [texts[0], texts[0], "QN" * 200, "QN" * 30, "A" * 300, "", None, "語é" * 60, "x" + "語é" * 60, protein(rng, 60) * 2]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, text string, rep int, block int")
    got = {tuple(r) for r in spans.shared_spans(frame, span, buckets=buckets, block_letters=block).collect()}
    assert got == brute_spans(rows, span)
    assert spans.shared_spans(frame.limit(0), span).count() == 0


def brute_repeats(rows):
    return {i for i, d, t, c in rows if c is not None and any(o[3] is not None and o[3] < c and ((d is not None and o[1] is not None and o[1].lower() == d.lower()) or (t is not None and o[2] is not None and similarity(t, o[2]) >= 0.5)) for o in rows)}


@pytest.mark.parametrize(("first_look", "small"), [(16, 10**6), (1, 10**6), (16, 0), (1, 0)])
def test_history_equals_brute_force(spark, monkeypatch, first_look, small):
    monkeypatch.setattr(history, "FIRST_LOOK", first_look)
    monkeypatch.setattr(history, "SMALL_POSTINGS", small)
    monkeypatch.setattr(history, "SMALL_ROWS", small)
    monkeypatch.setattr(history, "FAN", 2)
    rng = random.Random(11)
    texts = [*family(6, 9, 7), *ODD]
    rng.shuffle(texts)
    rows = [(i, rng.choice([f"D{i}", f"d{i % 17}", None]) if i % 3 == 0 else f"x{i}", t, rng.choice([None, *range(1, 9)])) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*r, 1, "q") for r in rows], "id long, digest string, text string, cycle int, rep int, bucket string").repartition(3)
    book, got = history.History(spark, rows_per_slot=5), []
    got += [r.id for r in book.ingest(frame.limit(0)).collect()]
    for low, high in ((0, 3), (3, 6), (6, 9)):
        part = frame.where((F.col("cycle") > low) & (F.col("cycle") <= high))
        got += [r.id for r in book.ingest(part).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_repeats(rows)


def test_postings_never_miss_a_similar_pair():
    order = np.zeros(1 << history.ORDER_BITS, np.uint8)
    rng = random.Random(8)
    for n in (6, 12, 30, 60, 120, 250, 500, 1500, 4000):
        for _ in range(12):
            a = protein(rng, n)
            b = edited(rng, a, max(1, n // rng.choice([14, 18, 30])))
            b = b[: len(b) - rng.randrange(0, max(1, n // 8))]
            if similarity(a, b) >= 0.5:
                owner, token, _ = history.postings([a, b], order, 0.5)
                assert set(token[owner == 0].tolist()) & set(token[owner == 1].tolist()), (n, a, b)


#: Seeds of texts whose first half shares too little in any 24 of its classes.
HIDDEN = (874, 4315, 4776, 7945)


def whole_and_half(seed):
    whole = "".join(random.Random(seed).choices("ACDEFGHIKLMNPQRSTVWY", k=294))
    return whole, whole[:149]


def test_postings_of_all_classes_hold_a_pair_at_the_bound():
    order = np.zeros(1 << history.ORDER_BITS, np.uint8)
    for seed in HIDDEN:
        whole, half = whole_and_half(seed)
        assert 0.5 <= similarity(whole, half) < 0.51
        owner, token, _ = history.postings([whole, half], order, 0.5)
        assert set(token[owner == 0].tolist()) & set(token[owner == 1].tolist()), seed


def test_history_finds_pairs_at_the_bound(spark):
    texts = [(seed, *whole_and_half(seed)) for seed in HIDDEN]
    first = [(seed, f"x{seed}", (whole, half)[seed % 2], 1) for seed, whole, half in texts]
    second = [(seed + 10_000, f"y{seed}", (half, whole)[seed % 2], 2) for seed, whole, half in texts]
    frame = spark.createDataFrame(first + second, "id long, digest string, text string, cycle int")
    assert {r.id for r in history.History(spark).ingest(frame).collect()} == {r[0] for r in second}
    book = history.History(spark)
    assert book.ingest(frame.where("cycle = 1")).count() == 0
    assert {r.id for r in book.ingest(frame.where("cycle = 2")).collect()} == {r[0] for r in second}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_postings_hold_pairs_at_the_bound_of_any_sizes(threshold):
    order = np.zeros(1 << history.ORDER_BITS, np.uint8)
    rng, texts = random.Random(3), []
    for _ in range(400):
        a = rng.choice([5, 20, 31, 32, 33, 63, 64, 65, 66, 129, 300])
        b = max(1, int(a * rng.uniform(threshold, 1)))
        shared = min(b, math.ceil(threshold / (1 + threshold) * (a + b)) + 1)
        head = protein(rng, shared + 4)
        texts += [head + protein(rng, a - shared), head + protein(rng, b - shared)]
    owner, token, _ = history.postings(texts, order, threshold)
    held = [set() for _ in texts]
    for i, t in zip(owner.tolist(), token.tolist(), strict=True):
        held[i].add(t)
    alike = [i for i in range(0, len(texts), 2) if similarity(texts[i], texts[i + 1]) >= threshold]
    assert len(alike) > 300 and all(held[i] & held[i + 1] for i in alike)


def test_blocks_of_texts_are_bounded_by_letters(monkeypatch):
    monkeypatch.setattr(history, "BLOCK_TEXTS", 3)
    monkeypatch.setattr(history, "BLOCK_LETTERS", 10)
    lengths = [4, 5, 1, 1, 30, 2, 2, 2, 2, 11, 0]
    batch = pa.RecordBatch.from_pydict({"text": ["A" * n for n in lengths]})
    got = [[len(t) for t in b.column("text").to_pylist()] for b in history._blocks(batch)]
    assert got == [[4, 5, 1], [1], [30], [2, 2, 2], [2], [11], [0]]


@pytest.mark.parametrize("chunk", [1000, 40, 3])
@pytest.mark.parametrize("bits", [1, 3])
def test_own_postings_meet_however_a_slot_is_cut(monkeypatch, chunk, bits):
    monkeypatch.setattr(history, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    n = 600
    top, low = (rng.integers(0, 4, n) << 14).astype(np.uint16), rng.integers(0, 40, n).astype(np.uint32)
    cycle, ident, size = rng.integers(0, 5, n).astype(np.int16), np.arange(n), np.full(n, 100, np.uint16)
    parts = [np.arange(at, min(at + 25, n)) for at in range(0, n, 25)]
    rows = sorted((b, blob) for p in parts for b, blob in blobs.cut((top[p] >> 15).astype(np.int64), [x[p] for x in (top, low, cycle, blobs.small(ident), size)]))
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
    made = [r for b in history._chunked(bits, iter([pa.RecordBatch.from_pylist([{"bucket": b, "blob": x} for b, x in rows], schema)])) for r in b.to_pylist()]
    assert sum(len(blobs.unpack(r["blob"])[0]) for r in made) == n
    assert {r["alone"] for r in made} == ({1} if chunk == 1000 else {0})
    rest = pa.RecordBatch.from_pylist(sorted(({"bucket": r["bucket"], "kind": 1, "blob": r["blob"]} for r in made if not r["alone"]), key=lambda r: r["bucket"]), pa.schema([("bucket", pa.int64()), ("kind", pa.int64()), ("blob", pa.binary())]))
    alone = pa.RecordBatch.from_pylist([{"blob": r["blob"]} for r in made if r["alone"]], schema.remove(0))
    got = [(r["b"], r["a"]) for found in (history._within(0.5, None, iter([alone])), history._gather(0.5, None, iter([rest]))) for b in found for r in b.to_pylist()]
    assert set(got) == {(b, a) for b in range(n) for a in range(n) if top[a] == top[b] and low[a] == low[b] and cycle[a] < cycle[b]}


def test_windows_of_ascii_letters_have_different_hashes():
    texts = ["".join(random.Random(i).choices("".join(map(chr, range(128))), k=5000)) for i in range(40)]
    points, _ = windows.letters(["".join(texts)])
    codes, hashed = windows.five_codes(points), history._window_hashes(points)
    assert len(np.unique(codes)) == len(np.unique(hashed)) and hashed.max() < 1 << 48
    mixed, _ = windows.letters(["ABCDEFéGHIJKLM"])
    plain, _ = windows.letters(["GHIJKLM"])
    assert history._window_hashes(mixed)[7:].tolist() == history._window_hashes(plain).tolist()
