import pytest

from residua.plans import reports
from residua.sources import fasta, tables
from residua.streaming import worker


def put(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_strict_fasta(spark, tmp_path):
    at = put(tmp_path / "a.fasta", "; note\r\n>tr|X1|N Hypothetical one OS=Some OX=1\r\nACDE-\r\n;c\r\nFGHI*\r\n\r\n>P2 Putative\nACDEFG\n>P2 again\nWWW\n")
    records = fasta.read_fasta(spark, at)
    rows = records.orderBy("record_ordinal").collect()
    assert [(r.sequence, r.problem) for r in rows] == [("ACDEFGHI", None), ("ACDEFG", None), ("WWW", None)]
    assert fasta.require(records) == ["aligned input: 1 gap signs taken out of 1 records", "a final stop was cut off 1 records", "repeated ids: P2"]
    first = fasta.proteins(records, "s").orderBy("record_ordinal").first()
    assert (first.id, first.annotation, first.organism, first.annotationconfidence) == ("X1", "Hypothetical one", "Some", 0.10)


@pytest.mark.parametrize("text,word", [("ACDE\n>a\nACDE\n", "before"), (">\nACDE\n", "header"), (">a\nAC@\n", "letter@3"), (">a\n" + "ACGT" * 20 + "\n", "nucleotides"), (";x\n", "no records")])
def test_strict_fasta_refuses(spark, tmp_path, text, word):
    at = put(tmp_path / "b.fasta", text)
    with pytest.raises(fasta.FastaError, match=word):
        fasta.require(fasta.read_fasta(spark, at))


def test_lenient_raw_and_write(spark, tmp_path):
    at = put(tmp_path / "c.fasta", ">a\nac-d e1\n>b\n---\n>\nAC*\n")
    assert [(r.header, r.sequence) for r in fasta.read_fasta(spark, at, "lenient").orderBy("record_ordinal").collect()] == [("a", "ACDE"), ("", "AC")]
    assert [r.sequence for r in fasta.read_fasta(spark, at, "raw").orderBy("record_ordinal").collect()] == ["ac-d e1", "---", "AC*"]
    rows = spark.createDataFrame([("x", "A" * 130)], "h string, s string")
    fasta.write_fasta(rows, "h", "s", str(tmp_path / "out"))
    assert [(r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()] == [("x", "A" * 130)]


def test_hits_and_domains(spark, tmp_path):
    at = put(tmp_path / "hits.m8", "Q\tT1\t24.0\tbad\t71.0\t90\nQ\tT2\tx\t1e-5\tx\t90\nshort\tline\n")
    rows = tables.read_hits(spark, at).orderBy("target").collect()
    assert [(r.identity, r.evalue, r.bits) for r in rows] == [(0.24, tables.LARGEST, 71.0), (0.0, 1e-5, 0.0)]
    line = "Dom PF1.2 240 Q1 - 500 1e-40 150 0 1 1 1e-44 6.8e-45 153.1 0.1 1 236 310 556 300 560 0.9 "
    at = put(tmp_path / "d.tbl", "# c\n" + line + "A  long name\n" + line + "-\nshort\n")
    got = tables.read_domains(spark, at).collect()
    assert [(r.description, r.bits, r["from"], r.to) for r in got] == [("A long name", 153.1, 310, 556), ("", 153.1, 310, 556)]
    assert got[0].coverage == pytest.approx(236 / 240)


def test_alpha_carbons(spark, tmp_path):
    atom = "ATOM      1  CA  ALA A 484      12.545   0.831 -19.870  1.00 87.25           C\n"
    at = put(tmp_path / "x.pdb", atom + atom.replace(" CA ", " CB ") + atom.replace("ALA", "MSE") + "ATOM short\n")
    rows = tables.read_alpha_carbons(spark, at).orderBy("i").collect()
    assert [(r.i, r.letter, r.x, r.confidence) for r in rows] == [(0, "A", 12.545, 87.25), (1, "X", 12.545, 87.25)]


def test_worker_enters_each_sequence_once(spark, tmp_path):
    inbox, book = tmp_path / "inbox", str(tmp_path / "ledger")
    inbox.mkdir()
    put(inbox / "a.fasta", ">A1 x\nACDE\nFG\n>B2\nWWWW\n>C3\nacdefg\n")
    worker.start(spark, str(inbox), book, str(tmp_path / "cp")).awaitTermination()
    put(inbox / "b.fasta", ">D4\nACDEFG\n>E5\nYYYY\n")
    worker.start(spark, str(inbox), book, str(tmp_path / "cp")).awaitTermination()
    rows = worker.read_ledger(spark, book).orderBy("accession").collect()
    assert [(r.accession, r.first_seen_cycle) for r in rows] == [("A1", 1), ("B2", 1), ("E5", 2)]
    again = spark.createDataFrame([("E5", "YYYY"), ("D4", "ACDEFG")], "accession string, sequence string")
    worker.enter(spark, again, book, 1, "run")  # a replay of the second batch
    assert worker.read_ledger(spark, book).count() == 3
    judged = spark.createDataFrame([("F6", "MMMM")], "accession string, sequence string")
    worker.enter(spark, judged, book, 2, "run", lambda rows: rows.selectExpr("accession", "'actionable' AS verdict", "0.5D AS score", "'c' AS classification"))
    one, two = (reports.write_discoveries(worker.read_ledger(spark, book), str(tmp_path / n)).read_bytes() for n in ("1.md", "2.md"))
    assert one == two and b"| 3 | F6 | 0.500 | c | 20" in one
    assert [r["accession"] for r in reports.export_new(worker.read_ledger(spark, book), 3)] == ["F6"]


def test_rank_and_reports(spark, tmp_path):
    from residua import cli

    at = put(tmp_path / "q.fasta", ">a Hypothetical\n" + "ACDEFGHIKLMNPQRSTVWY" * 4 + "\n>b Putative\n" + "MKTGSAAKSANW" * 6 + "\n")
    assert cli.main(["rank", "--input", at, "--reference", at, "--output", str(tmp_path / "out"), "--max", "2", "--all-references"]) == 0
    assert len(list((tmp_path / "out").glob("run-*.json"))) == 1
    assert (tmp_path / "out" / "discovery-report.md").read_text().count("\n### #") == 2


def test_indented_headers_are_records_in_strict_mode(spark, tmp_path):
    at = put(tmp_path / "i.fasta", "; top\n\n>a\nACD\n  >b two\nWW\n\t>c\n  YY \n")
    rows = fasta.read_fasta(spark, at).orderBy("record_ordinal").collect()
    assert [(r.record_ordinal, r.header, r.sequence) for r in rows] == [(1, "a", "ACD"), (2, "b two", "WW"), (3, "c", "YY")]
    assert [r.header for r in fasta.read_fasta(spark, at, "raw").orderBy("record_ordinal").collect()][-1] == "a"


def test_ordinals_follow_the_file_over_many_splits(spark, tmp_path):
    texts = {name: "".join(f">{name}{i}\n{'ACDE' * (i % 9 + 1)}\n" for i in range(4000)) for name in "xy"}
    for name, text in texts.items():
        put(tmp_path / f"{name}.fasta", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        frame = fasta.read_fasta(spark, str(tmp_path), "raw")
        assert frame.rdd.getNumPartitions() > 4
        assert "Exchange hashpartitioning(source_path" not in frame._jdf.queryExecution().optimizedPlan().toString()
        rows = frame.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert len(rows) == 8000 and all(r.header == f"{r.source_path[-7]}{r.record_ordinal - 1}" for r in rows)


def test_header_condition_text_and_single_record(spark, tmp_path):
    from pyspark.sql import functions as F

    at = put(tmp_path / "k.fasta", ">a kinase\nACD\n>b other\nWW\n")
    assert [(r.record_ordinal, r.header) for r in fasta.read_fasta(spark, at, "lenient", F.col("header").contains("other")).collect()] == [(2, "b other")]
    assert [(r.header, r.sequence, r.source_path) for r in fasta.read_text(spark, ">q\nAC-D\n").collect()] == [("q", "ACD", "text")]
    assert fasta.read_one(spark, put(tmp_path / "one.fasta", ">Z9 x\nac d\n")) == ("Z9", "ACD")
    for bad in (">a\nAC\n>b\nAC\n", ">a\nAC*\n", ">a\n\n"):
        with pytest.raises(fasta.FastaError):
            fasta.read_one(spark, put(tmp_path / "bad.fasta", bad))
    index = {r.id: r.annotation for r in fasta.header_index(fasta.read_fasta(spark, put(tmp_path / "h.fasta", ">a first\nA\n>a last\nA\n"), "raw")).collect()}
    assert index == {"a": "last"}


def test_reference_subset_follows_the_reference(spark, tmp_path):
    at = put(tmp_path / "r.fasta", ">a some kinase\nACD\n>b hypothetical kinase\nWW\n>c thing\nYY\n")
    assert [r.header for r in fasta.discovery_subset(spark, at, str(tmp_path / "s")).collect()] == ["a some kinase"]
    put(tmp_path / "r.fasta", ">d ligase of another\nACD\n>e lyase\nWWW\n")
    assert {r.header[0] for r in fasta.discovery_subset(spark, at, str(tmp_path / "s")).collect()} == {"d", "e"}
    put(tmp_path / "r.fasta", ">d thing again\nACD\n")
    with pytest.raises(fasta.FastaError):
        fasta.discovery_subset(spark, at, str(tmp_path / "s"))


def test_structure_files(spark, tmp_path):
    atom = "ATOM      1  CA  ALA A 484      12.545   0.831 -19.870  1.00  0.87           C"
    at = put(tmp_path / "x.pdb", atom + "\n" + atom.replace(" CA ", " CB ").replace("0.87", "0.10") + "\nEND\n")
    carbons = tables.read_alpha_carbons(spark, at)
    assert tables.one_carbon(carbons, "A", 484) == (12.545, 0.831, -19.870)
    with pytest.raises(ValueError):
        tables.one_carbon(carbons, "A", 485)
    with pytest.raises(ValueError):
        tables.require_carbons(carbons.limit(0))
    scaled = tables.percent_confidence(carbons)
    assert tables.confidence_summary(scaled).first().mean == pytest.approx(87)
    lines = tables.restore_confidence(spark.read.text(at), scaled.drop("source_path")).collect()
    assert sorted(r.value[60:66] for r in lines if r.value.startswith("ATOM")) == [" 87.00", " 87.00"] and "END" in {r.value for r in lines}
    at = put(tmp_path / "p.pdbqt", "REMARK VINA RESULT:    -8.3      0.000      0.000\nx\nREMARK VINA RESULT:    -7.1      1.0      2.0\n")
    assert [(r.pose, r.energy) for r in tables.read_poses(spark, at).orderBy("pose").collect()] == [(1, -8.3), (2, -7.1)]
    assert tables.read_model_names("NAME ID\nllama:latest x\n\nphi y\n") == ["llama:latest", "phi"] and tables.has_model("llama", ["llama:latest"])
    assert tables.newest(spark, str(tmp_path / "*.pdbqt")).endswith("p.pdbqt") and tables.newest(spark, str(tmp_path / "*.none")) is None
    assert tables.read_hits(spark, str(tmp_path / "none.m8")).count() == 0
    hits = tables.read_hits(spark, put(tmp_path / "t.m8", "Q\tB\t24\t1\t71\t9\nQ\tA\t25\t1\t71\t9\n"))
    assert [r.target for r in tables.best_hits(hits).collect()] == ["B"]
