import random
import unicodedata

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from residua.llm import encoding, leaks, mixing


def plain_words(text):
    text = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf").lower()
    return regex.findall(r"[\p{L}\p{Nd}]+", text)


def brute_leaks(docs, items, width):
    known = {}
    for i, t in items:
        w = plain_words(t or "")
        for k in range(len(w) - width + 1):
            known.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = set()
    for d, t in docs:
        w = plain_words(t or "")
        for k in range(len(w) - width + 1):
            out |= {(d, i) for i in known.get(tuple(w[k : k + width]), ())}
    return out


@pytest.mark.parametrize("block", [500_000, 7])
def test_leaks(spark, block):
    rng = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(6)] + [(6, None), (7, ""), (8, "too short")]
    items.append((9, items[0][1]))
    docs = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(200))) for i in range(10)]
    docs += [(200, "x " + items[1][1].upper().replace(" ", " -- ")), (201, items[2][1].replace("é", "é").replace("w", "w​")), (202, None), (203, ""), (204, "W" * 100_000 + " " + items[3][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item int")
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc int")
    got = [tuple(r) for r in leaks.leaks(d, "doc_id", "text", q, "item_id", "text", block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(docs, items, 12)
    assert {(200, 1), (201, 2), (204, 3)} <= set(got)
    assert leaks.leaks(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    assert leaks.leaks(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("block", [500_000, 2])
def test_leaks_are_cut_out(spark, block):
    item = " ".join(f"word{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"Before it. {item}! After."), (2, "nothing here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc, r.text.split()) for r in leaks.without_leaks(docs, "doc_id", "text", items, "item_id", "text", block=block).collect()] == [(1, ["Before", "it.", "After."])]


def test_poisson_inverse():
    rng = np.random.default_rng(0)
    u = rng.random(200_000)
    for mean in (0.1, 1.0, 7.5):
        count = mixing.draws(u, np.full(len(u), mean), np.full(len(u), 1000))
        assert abs(count.mean() - mean) < 0.03 and abs(count.var() - mean) < 0.1
    assert mixing.draws(u, np.full(len(u), 70.0), np.full(len(u), 3)).min() == 3
    assert mixing.draws(u, np.zeros(len(u)), np.full(len(u), 3)).max() == 0


def test_poisson_inverse_of_large_means():
    u = np.random.default_rng(1).random(50_000)
    for mean in (499.0, 501.0, 800.0, 5000.0):
        count = mixing.draws(u, np.full(len(u), mean), np.full(len(u), 10**6))
        assert abs(count.mean() - mean) < 0.02 * np.sqrt(mean) and abs(count.var() / mean - 1) < 0.03
    near = [mixing.draws(u, np.full(len(u), m), np.full(len(u), 10**6)) for m in (500.0, 500.0001)]
    assert (near[1] - near[0] >= 0).all() and (near[1] != near[0]).mean() < 0.001


@pytest.mark.parametrize("share", [0.002, 0.05, 0.4, 3.0])
def test_shares_are_reached_within_a_thousandth(spark, share):
    rows = [(i, "big" if i % 10 else "small", "word " * (1 + i % 40)) for i in range(30_000)]
    frame = spark.createDataFrame(rows, "id long, source string, text string")
    targets = spark.createDataFrame([(1, "big", share, 9), (1, "small", 0.01, 2)], "plan_id int, source string, target_share double, max_repeats int")
    mixture = mixing.Mixture(frame, "id", "source", "text", targets)
    for r in mixture.shares(mixture.drawn()).collect():
        one = 45 / 600_000  # the largest record, as a share of all
        assert abs(r.share_of_total - r.target_share) <= 0.001 * r.target_share + one, r


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["A-one ", "a_one", "b", "B"]), "word " * rng.randrange(1, 60)) for i in range(1500)]
    docs += [(9001, "tiny", "word " * 10), (9002, None, "word"), (9003, "b", None), (9004, "other", "word"), (9005, "b", ""), (9006, "b", "x" * 50_000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "id long, source string, text string, tokens int")
    plan = [(1, "a_one", 0.3, 1), (1, "b", 0.5, 2), (1, "tiny", 0.2, 3), (2, "b", 1.0, 2), (3, "absent", 1.0, 1), (4, None, 1.0, 1)]
    targets = spark.createDataFrame([(*p, "x") for p in plan], "plan_id int, source string, target_share double, max_repeats int, id string")
    mixture = mixing.Mixture(frame, "id", "source", "text", targets)
    drawn = mixture.drawn()
    rows = drawn.collect()
    shares = {(r.plan_id, r.source): r for r in mixture.shares(drawn).collect()}
    assert abs(shares[1, "a_one"].share_of_total - 0.3) < 0.01 and abs(shares[1, "b"].share_of_total - 0.5) < 0.01
    assert shares[1, "tiny"].most_repeats == 3 and shares[1, "tiny"].share_of_total < 0.2
    assert abs(shares[2, "b"].share_of_total - 1) < 0.01 and shares[3, "absent"].drawn == 0
    caps = {(p, s): m for p, s, _, m in plan}
    assert all(1 <= r.repeats <= caps[r.plan_id, r.source] for r in rows)
    assert len({(r.plan_id, r.id) for r in rows}) == len(rows) and not {9002, 9004} & {r.id for r in rows}
    copies = mixture.shuffled(drawn)
    assert copies.count() == sum(r.repeats for r in rows)
    again = mixing.Mixture(frame.repartition(7), "id", "source", "text", targets).drawn()
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    empty = mixing.Mixture(frame.limit(0), "id", "source", "text", targets)
    assert empty.drawn().count() == 0 and empty.shares(empty.drawn()).count() == 5
    assert mixing.Mixture(frame, "id", "source", "text", targets.limit(0)).drawn().count() == 0


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "cp1251"), ("utf-8", "gb18030"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("latin-1", "utf-8")]


def test_garbled_words_are_found_and_restored(spark):
    words = ["größer", "Übung", "später", "naïve", "curator’s", "été", "señal", "região"]
    rng = random.Random(5)
    docs = [(i, "Ein Wort: " + " ".join(rng.choice(words) for _ in range(12)) + ".") for i in range(400)]
    docs += [(900, None), (901, ""), (902, "plain"), (903, "│ id │ 文献 ‹x› € ﬁ"), (904, "é" * 100_000), (905, "A" * 300_000)]
    wrong = {}
    for k, (source, target) in enumerate(CHAINS):
        text = f"Das ist größer und später {k}"
        wrong[1000 + k] = (text, text.encode(source).decode(target, "replace"))
    wrong[1100] = ("ein größer Wort", "ein größer Wort".encode().decode("latin-1").encode().decode("latin-1"))
    frame = spark.createDataFrame([(*d, 1) for d in [*docs, *[(i, g) for i, (_, g) in wrong.items()]]], "doc_id long, text string, word int")
    found = encoding.Garbled(frame, "doc_id", "text")
    assert {r.doc for r in found.documents().collect()} == set(wrong)
    restored = {r.doc: r for r in found.restored().collect()}
    for i, (text, garbled) in wrong.items():
        if "�" not in garbled:
            assert restored[i].text == text
        else:
            assert restored[i].unrestored > 0
    assert encoding.Garbled(frame.limit(0), "doc_id", "text").restored().count() == 0


def test_word_filter_lets_every_word_pass(spark):
    words = [f"größe{i}" for i in range(3000)] + ["語", "é" * 500]
    whole = encoding.word_filter(spark.createDataFrame([(w,) for w in words], "w string").repartition(3), "w", len(words))
    assert all(encoding.passes(whole, w) for w in words)
    assert sum(encoding.passes(whole, f"größer{i}") for i in range(3000)) < 150


def test_garbled_counts_words_once_per_document(spark):
    frame = spark.createDataFrame([(1, "süß süß süß"), (2, "süß")], "doc_id long, text string")
    assert encoding.Garbled(frame, "doc_id", "text").spoken.groupBy("word").agg(F.count("*").alias("n")).first().n == 2


@pytest.mark.parametrize(("chain", "every"), [(("cp1252", "cp850"), 3), (("utf-8", "latin-1"), 2)])
def test_garbled_words_are_found_however_many_documents_have_them(spark, chain, every):
    words = ["größer", "Übung", "später", "naïve", "curator’s", "été", "señal", "région"]
    rng = random.Random(5)
    texts = {i: "Ein Wort: größer " + " ".join(rng.choice(words) for _ in range(6)) + "." for i in range(300)}
    wrong = {i: t.encode(chain[0]).decode(chain[1]) for i, t in texts.items() if i % every == 0}
    frame = spark.createDataFrame([(i, wrong.get(i, t)) for i, t in texts.items()] + [(900, "clean │ table Å α")], "doc_id long, text string")
    found = encoding.Garbled(frame, "doc_id", "text")
    assert {r.doc for r in found.documents().collect()} == set(wrong)
    assert {r.doc: r.text for r in found.restored().collect()} == {i: texts[i] for i in wrong}


def test_doubtful_garbled_signs_need_a_second_word_of_their_chain(spark):
    docs = [(i, "at 4 Å ± 2 near") for i in range(100)] + [(200 + i, "at 4 ┼ ▒ 2 near") for i in range(15)] + [(300, "a ┼ b")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc for r in encoding.Garbled(frame, "doc_id", "text").documents().collect()} == set(range(200, 215))


STEPS = [
    [("cp1252", "mac-roman"), ("utf-8", "cp1252")],
    [("cp1252", "cp850"), ("utf-8", "latin-1")],
    [("utf-8", "gbk"), ("utf-8", "cp1252")],
    [("utf-8", "cp850"), ("utf-8", "cp1250"), ("utf-8", "cp437"), ("utf-8", "latin-1")],
]


def test_garbled_more_than_once_in_any_encodings(spark):
    docs = [(i, "Das ist größer und später, naïve Übung, вернуть ключ") for i in range(20)]
    wrong = {}
    for k, steps in enumerate([*STEPS, [("koi8-r", "cp1251"), ("utf-8", "cp1251")], [("utf-8", "koi8-r")] * 2]):
        text = "вернуть ключ" if k >= len(STEPS) else "größer und später"
        wrong[100 + k] = text
        for source, target in steps:
            text = text.encode(source).decode(target, "replace")
        docs.append((100 + k, text))
    docs += [(200, "Quelle\u00a0étape"), (201, "\u00a0Quelle\u00a0étape")]  # bytes that Mac Roman and UTF-8 share
    found = encoding.Garbled(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    assert {r.doc for r in found.documents().collect()} == set(wrong)
    restored = {r.doc: r for r in found.restored().collect()}
    assert all(restored[i].text == text or restored[i].unrestored for i, text in wrong.items())
