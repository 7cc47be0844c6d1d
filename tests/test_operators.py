import itertools
import random

import numpy as np
import pytest

from residua.operators import admission, ledger, search, structure


def brute_cluster(texts, threshold, k=3):
    sets = [{t[i : i + k] for i in range(len(t) - k + 1)} if len(t) >= k else {t} for t in texts]
    if threshold <= 0:
        return [len(texts)] * len(texts)
    if not threshold <= 1:
        return [1] * len(texts)
    return [1 + sum(len(a & b) / len(a | b) >= threshold for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]


def lcg_texts():
    state, texts = 0xB10AB, ["AAAAAAAA", "CCCCCCCC", "AA", ""]
    for i in range(60):
        if i and i % 10 == 0:
            texts.append(texts[-1])
            continue
        letters = []
        for _ in range(48):
            state = (state * 6364136223846793005 + 1) % 2**64
            letters.append("ACDEFGHIKLMNPQRSTVWY"[(state >> 32) % 20])
        texts.append("".join(letters))
    return texts


@pytest.mark.parametrize("threshold", [-0.1, 0, 0.2, 0.38, 1, 1.1, float("nan")])
@pytest.mark.parametrize("block", [2048, 10])
def test_clusters_equal_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(search, "BLOCK", block)
    texts = lcg_texts()
    rows = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(999, None, 9)], "id int, t string, rep int")
    got = {r.id: r.cluster_size for r in search.cluster_sizes(rows, "id", "t", threshold).collect()}
    want = dict(enumerate(brute_cluster(texts, threshold)))
    assert got == want
    assert search.cluster_sizes(rows.limit(0), "id", "t", threshold).count() == 0


def brute_table(a, b, local):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                t[i][j] = 0 if local else -2 * (i + j)
            else:
                best = max(t[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1][j] - 2, t[i][j - 1] - 2)
                t[i][j] = max(best, 0) if local else best
    return t


@pytest.mark.parametrize("local", [True, False])
def test_alignment_scores(local):
    rng = random.Random(3)
    for _ in range(40):
        a, b = ("".join(rng.choice("ACDE") for _ in range(rng.randrange(12))) for _ in range(2))
        assert np.array_equal(structure._table(a, b, local), np.array(brute_table(a, b, local)).reshape(len(a) + 1, len(b) + 1))
        score, pairs, length = structure.trace(a, b, local)
        same = sum(a[i] == b[j] for i, j in pairs)
        assert score == 2 * same - (len(pairs) - same) - 2 * (length - len(pairs))


def test_align_frame(spark):
    rows = spark.createDataFrame([(1, "ACD", "ACD"), (2, None, "A"), (3, "", "")], "id int, l string, r string")
    got = {r.id: r for r in structure.align(rows, "l", "r", "id", local=False).collect()}
    assert got[1].identity == 1.0 and got[1].score == 6
    assert got[2].score == -2 and got[3].score == 0


def test_seed_search_prefers_overlap(spark):
    q = spark.createDataFrame([(1, "ACDEFGHIKLMNPQ", False), (2, None, False), (3, "WWWWWWW", False)], "query int, residues string, cell_wall boolean")
    t = spark.createDataFrame([(10, "ACDEFGHIKLMNPQ", None), (11, "ACDEFGHYYYYYYY", "x"), (12, None, "y")], "target int, residues string, header string")
    assert [(r["query"], r.target, r.shared) for r in search.seed_search(q, t).collect()] == [(1, 10, 11)]


def test_first_seen_and_series(spark):
    rows = spark.createDataFrame([("AB", 2, "x", 1), ("ab", 1, "y", 1), (None, 3, "z", 4)], "d string, o int, v string, c int")
    assert [(r.digest, r.o, r.v) for r in ledger.first_seen(rows, "d", "o", "v").collect()] == [("ab", 1, "y")]
    series = ledger.last_cycles(rows.withColumnRenamed("v", "verdict"), "c", "y").orderBy("cycle").collect()
    assert [(r.cycle, r.n) for r in series] == [(1, 1), (2, 0), (3, 0), (4, 0)]
    assert ledger.last_cycles(rows.limit(0).withColumnRenamed("v", "verdict"), "c").count() == 0


def test_admission():
    jobs = [{"backend": "vina", "length": 100} for _ in range(10)]
    taken, refused = admission.admit(jobs, 2 * admission.GIB, 1000)
    assert len(taken) == 2 and {r["reason"] for r in refused} == {"ram_budget"}
    taken, refused = admission.admit([{"backend": "esmfold", "length": 5000}, {"backend": "vina", "length": 5000}], 10**12, 1000)
    assert [r["reason"] for r in refused] == ["too_long"] and [t["backend"] for t in taken] == ["vina"]
    jobs = [{"backend": "esmfold", "length": 10}] * 2
    assert [r["reason"] for r in admission.admit(jobs, 10**12, 1000)[1]] == ["gpu_serialised"]
    assert [r["reason"] for r in admission.admit(jobs, 10**12, 1000, {"esmfold": False})[1]] == ["unavailable"] * 2
    assert admission.compute_value(True, False, True, True) == 1.0 and admission.compute_value(False, True, True, False) == 0.4


def test_memory_of_backends():
    gib = admission.GIB
    known = {b: admission.memory_of(b, 700) for b in ("openmm", "vina", "mmseqs", "foldseek", "hmmer", "other")}
    assert known == {"openmm": 1.5 * gib, "vina": 0.75 * gib, "mmseqs": gib, "foldseek": gib, "hmmer": 0.5 * gib, "other": 0.5 * gib}
    assert admission.memory_of("esmfold", 700) == 5 * gib + 700 * 700 * 800
    assert admission.memory_budget(10 * gib, 8 * gib, 4 * gib) == 6 * gib and admission.memory_budget(None, 8 * gib, 4 * gib) == 8 * gib
    with pytest.raises(ValueError):
        admission.memory_budget(1, 0, 0)


@pytest.mark.parametrize(("weights", "total", "want"), [
    ({"mmseqs": 1, "hmmer": 2}, 15, {"mmseqs": 5, "hmmer": 10}), ({"mmseqs": 1, "hmmer": 1}, 15, {"mmseqs": 8, "hmmer": 7}),
    ({"hmmer": 2}, 15, {"hmmer": 15}), ({}, 4, {}), ({"a": 1, "b": 1}, 1, {"a": 1, "b": 1}),
])
def test_thread_split(weights, total, want):
    assert admission.split_threads(weights, total) == want


def test_dispatch_makes_room_and_refuses():
    import threading

    gate, seen = threading.Barrier(2, timeout=20), []

    def work(job, timeout):
        seen.append((job["name"], timeout))
        if job["name"] in "ab":
            gate.wait()
        return {"name": job["name"], "status": "ok"}

    jobs = [{"name": n, "backend": "mmseqs", "length": 1} for n in "abc"] + [{"name": "huge", "backend": "esmfold", "length": 10**5}]
    results, refused, most = admission.dispatch(jobs, work, 2 * admission.GIB, 3, 1000.0, clock=lambda: 0.0)
    assert sorted(r["name"] for r in results) == ["a", "b", "c"] and [(r["name"], r["reason"]) for r in refused] == [("huge", "ram_budget")]
    assert most == {"most_at_once": 2, "peak_memory": 2 * admission.GIB} and all(t == 900 for _, t in seen)
    assert [r["reason"] for r in admission.dispatch(jobs[:1], work, admission.GIB, 1, 10.0, clock=lambda: 0.0)[1]] == ["budget_expired"]
    assert [r["reason"] for r in admission.dispatch(jobs[:1], work, admission.GIB, 1, 1e9, pressed=lambda: True)[1]] == ["memory_pressure"]


def test_commands_end_with_their_group():
    assert admission.run_command(["sh", "-c", "echo out; echo err >&2; exit 3"], 20)["status"] == "failed"
    late = admission.run_command(["sh", "-c", "trap '' TERM; sleep 30 & sleep 30"], 0.3, grace=0.3)
    assert late["status"] == "timeout" and late["seconds"] < 10
    assert admission.run_command(["/no/such/tool"], 1)["status"] == "missing"


def test_prerequisites(tmp_path):
    job = {"backend": "vina", "sequence": "A", "structure": "x"}
    assert admission.missing_prerequisite({"backend": "mmseqs", "sequence": "A"}, None, None, None) == "no reference"
    assert admission.missing_prerequisite({"backend": "openmm", "sequence": "A"}, None, None, None) == "no structure"
    assert admission.missing_prerequisite(job, None, None, None) == "no docking manifest"
    (tmp_path / "m").write_text("{}")
    assert admission.missing_prerequisite(job, None, None, str(tmp_path / "m")) == "no classification"
    assert admission.missing_prerequisite(job | {"classification": "c"}, None, None, str(tmp_path / "m")) is None
    assert admission.command_of("hmmer", "phmmer", "q", "o", reference="r", threads=3)[0] == ["phmmer", "--cpu", "3", "--tblout", "o/hits.tbl", "q", "r"]


def test_structures_are_compared(spark):
    rng = random.Random(4)
    chain = [(rng.choice("ACDEFGHIKL"), rng.random() * 9, rng.random() * 9, rng.random() * 9) for _ in range(400)]
    rows = [("q", i, *c) for i, c in enumerate(chain)] + [("t", i, a, x + 5, y - 2, z) for i, (a, x, y, z) in enumerate(chain[10:])] + [("far", 0, "A", 0.0, 0.0, 0.0)]
    carbons = spark.createDataFrame(rows, "structure string, i int, letter string, x double, y double, z double")
    pairs = spark.createDataFrame([(1, "q", "t"), (2, "q", "far"), (3, "q", "absent")], "pair int, query string, target string")
    got = {r.pair: r for r in structure.compare(pairs, carbons).collect()}
    assert set(got) == {1, 2} and got[1].aligned == 390 and got[1].identity == 1.0 and got[1].coverage == 1.0 and got[1].passed
    assert abs(got[1].score - 1) < 1e-9 and got[2].aligned == 1 and got[2].score == 0.0 and not got[2].passed


def test_hits_are_applied(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, record_ordinal int")
    found = spark.createDataFrame([(1, "T1", 0.3, 0.1, 40), (3, "T2", 0.2, 0.05, 20)], "record_ordinal int, hit_id string, identity double, support double, bits int")
    names = spark.createDataFrame([("T2", "kinase", "Some")], "id string, annotation string, organism string")
    hits = search.hit_per_id(found, rows, "record_ordinal")
    got = {r.record_ordinal: (r.hit_id, r.identity, r.hit_annotation, r.method, r.support) for r in search.apply_native(rows, hits, names).collect()}
    assert got == {1: ("T2", 0.2, "kinase", "native-swift", 0.05), 3: ("T2", 0.2, "kinase", "native-swift", 0.05), 2: ("no native reference hit", 0.0, None, "native-swift", None)}
    external = hits.selectExpr("id", "hit_id", "identity", "1e-30 AS evalue", "71.0 AS bits")
    got = {r.record_ordinal: (r.hit_id, r.method, r.evalue) for r in search.apply_mmseqs(rows, external).collect()}
    assert got[1] == ("T2", "mmseqs2", 1e-30) and got[2] == ("no Swiss-Prot hit", None, None)


def test_seed_scan_equals_the_join(spark, monkeypatch):
    rng = random.Random(12)
    pieces = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(30)) for _ in range(12)]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 6))) for _ in range(300)] + [None, "", "ACD", "XXXX"]
    headers = [rng.choice([None, "Transpeptidase", "polyketide thing", "x"]) for _ in texts]
    q = spark.createDataFrame([(i, t, rng.random() < 0.5, 1) for i, t in enumerate(texts[:60] + texts[-4:])], "query int, residues string, cell_wall boolean, target int")
    t = spark.createDataFrame([((f"f{i % 3}", i), t, h) for i, (t, h) in enumerate(zip(texts, headers, strict=True))], "target struct<path: string, n: int>, residues string, header string").repartition(3)
    found = {}
    for blocks in (10, 0):
        monkeypatch.setattr(search, "MOST_BLOCKS", blocks)
        monkeypatch.setattr(search, "BLOCK_QUERIES", 7 if blocks else 2000)
        found[blocks] = sorted((r["query"], r.place, tuple(r.target), r.shared, round(r.ranking, 12)) for r in search.seed_search(q.drop("target"), t, candidates=3).collect())
    assert found[10] == found[0] and len(found[0]) > 100
    assert search.seed_search(q.drop("target").limit(0), t).count() == 0 and search.seed_search(q.drop("target"), t.limit(0)).count() == 0


def test_several_seeds_per_query(spark):
    q = spark.createDataFrame([(1, "ACDEFGHIKLMNPQ", False)], "query int, residues string, cell_wall boolean")
    t = spark.createDataFrame([(i, "ACDEFGHIKLMNPQ"[: 14 - i], None) for i in range(5)], "target int, residues string, header string")
    assert [(r.target, r.place) for r in search.seed_search(q, t, candidates=3).orderBy("place").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_unseen_by_either_way(spark, monkeypatch):
    batch = spark.createDataFrame([("a",), ("b",), (None,)], "digest string")
    book = spark.createDataFrame([("b",), ("c",)], "digest string")
    for small in (200_000, 0):
        monkeypatch.setattr(ledger, "SMALL_BATCH", small)
        assert {r.digest for r in ledger.unseen(batch, book).collect()} == {"a", None}


def test_distance_map(spark):
    points = [(1, i, float(i), 0.0, 0.0, float(i), 0.0, 0.0) for i in range(5)] + [(2, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = {r.pair: r.score for r in structure.distance_map_scores(spark.createDataFrame(points, "pair int, i int, qx double, qy double, qz double, tx double, ty double, tz double")).collect()}
    assert got == {1: 1.0, 2: 0.0}


def test_best_hits_ties(spark):
    rows = spark.createDataFrame([("q", "b", 5.0), ("q", "a", 5.0), ("q", "c", None), (None, "d", 9.0)], "q string, t string, s double")
    assert [r.t for r in search.best_hits(rows, "q", "s", "t").collect()] == ["a"]


def test_packed_kmers_are_distinct(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("AAAAA",), ("ACDEF",), ("AC",), (None,)], "s string").select(search.packed_kmers(F.col("s"), 4).alias("k"))
    assert [len(r.k) for r in rows.collect()] == [1, 2, 0, 0]
    assert len(set(itertools.chain.from_iterable(r.k for r in rows.collect()))) == 3
