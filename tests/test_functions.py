import math

import pytest
from pyspark.sql import functions as F

from residua.functions import features as fx
from residua.functions import residues as rx
from residua.functions.terminal import rendered


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "raw,clean",
    [("MTPK--IVLA...GHG", "MTPKIVLAGHG"), ("MTPKIVLA*", "MTPKIVLA"), ("  1 MTPK IVLA\n 10 GHG ", "MTPKIVLAGHG"), ("MTXBZJOUK", "MTXBZJOUK"), ("AA**", "AA*"), ("----", ""), ("", ""), (None, None)],
)
def test_clean(spark, raw, clean):
    assert one(spark, raw, rx.clean_sequence) == clean


@pytest.mark.parametrize(
    "raw,gaps,stop,ambiguous,problem",
    [("MTPK--IVLA...GHG", 5, False, 0, None), ("MTPKIVLA*", 0, True, 0, None), ("MTXBZJOUK", 0, False, 6, None), ("MTPK*IVLA", 0, False, 0, "stop@5"), ("MTPK@IVLA", 0, False, 0, "letter@5"), ("----", 4, False, 0, "empty")],
)
def test_cleaning_report(spark, raw, gaps, stop, ambiguous, problem):
    row = spark.createDataFrame([(raw,)], "v string").select(*[c.alias(k) for k, c in rx.cleaning_report(F.col("v")).items()]).first()
    assert (row.gaps, row.stop_trimmed, row.ambiguous, row.problem) == (gaps, stop, ambiguous, problem)


@pytest.mark.parametrize("raw,accession", [("tr|A0A123|A0A123_BACT x", "A0A123"), ("A0A123 desc", "A0A123"), ("A0A123\tdesc", "A0A123\tdesc"), ("ref||X1|", "X1"), ("a|", "a|"), ("", ""), (None, None)])
def test_accession(spark, raw, accession):
    assert one(spark, raw, rx.accession) == accession


def test_header_parts(spark):
    header = "db|A|X Putative  thing OS=Some one OX=1 GN=g"
    assert one(spark, header, rx.annotation_name) == "Putative  thing"
    assert one(spark, header, rx.organism_name) == "Some one"
    assert one(spark, "plain", rx.annotation_name) == "plain"
    assert one(spark, "plain", rx.organism_name) is None
    assert one(spark, "a  b", rx.annotation_name) == " b"
    assert one(spark, "Uncharacterized (Fragment) kinase", rx.is_informative_reference) is False
    assert one(spark, "kinase", rx.is_informative_reference) is True


@pytest.mark.parametrize("text,flag", [("ACGT" * 20, True), ("ACGT", False), ("MKWVTFISLL" * 8, False)])
def test_nucleotide(spark, text, flag):
    assert one(spark, text, rx.looks_like_nucleotide) is flag


@pytest.mark.parametrize(
    "text,n,entropy,low,membrane,motifs",
    [
        ("", 0, 0, 1, 0, []), ("XXXX", 0, 0, 1, 0, []), (None, 0, 0, 1, 0, []), ("ACD", 3, 0.366726, 0.216667, 0, []), ("A" * 9, 9, 0, 1, 0, []),
        ("KTGSAAKSAN", 10, 0.566053, 0.195, 0, [fx.CELL_WALL]), ("A" * 19, 19, 0, 1, 1, [fx.MEMBRANE]), (rx.STANDARD * 2, 40, 1.0, 0.090833, 0.421053, None),
        ("AVILMFWY" * 20_000, 160_000, 0.694135, None, 1, None),
    ],
)
def test_features(spark, text, n, entropy, low, membrane, motifs):
    row = fx.with_features(spark.createDataFrame([(text, 1)], "v string, entropy_of int"), "v").first()
    assert row.length == n
    assert math.isclose(row.entropy, entropy, abs_tol=1e-6)
    assert low is None or math.isclose(row.low_complexity, low, abs_tol=1e-6)
    assert math.isclose(row.membrane_score, membrane, abs_tol=1e-6)
    assert motifs is None or row.motifs == motifs


@pytest.mark.parametrize("raw,shown", [("loading\rdone", "doneing"), ("loading\r\x1b[Kdone", "done"), ("abcdef\x1b[3DXYZ", "abcXYZ"), ("\x1b]0;t\x07a\x07\x08b", "ab"), ("\x1b[31mred\x1b[0m ", "red"), (None, None)])
def test_terminal(raw, shown):
    assert rendered(raw) == shown


def test_urls(spark):
    def good(u):
        return one(spark, u, lambda c: rx.approved_url(c, "h.org", "/s", ["q", "size", "cursor"], 500))

    assert good("https://h.org/s?q=1&size=5") is True
    assert good("https://h.org:443/s?q=1&size=5&cursor=a") is True
    for bad in ("http://h.org/s?size=5", "https://x.org/s?size=5", "https://u@h.org/s?size=5", "https://h.org/s?size=501", "https://h.org/s?size=5&z=1", "https://h.org/s?size=5&cursor=a&cursor=b", "https://h.org/s?size=5#f"):
        assert good(bad) is False
