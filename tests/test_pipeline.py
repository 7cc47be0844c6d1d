import hashlib
import json
import os

import pytest

from residua import cli
from residua.plans import pipeline, queue, reports
from residua.sources import host, pages
from residua.streaming import worker

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, newline="")
    return str(path)


QUERY = ">Q1 Hypothetical protein OS=Some OX=1\n" + (LETTERS * 6) + "\n>Q2 Putative thing\n" + ("MKTGSAAKSANW" * 9) + "\n>Q1 again\n" + ("WYTSRQPNML" * 8) + "\n"
REFERENCE = ">sp|R1|X transporter OS=Other OX=2\n" + (LETTERS * 5) + "\n>sp|R2|Y hypothetical\n" + ("MKTGSAAKSANW" * 9) + "\n"
DOMAIN = "Dom PF1.2 240 Q1 - 500 1e-40 150 0 1 1 1e-44 6.8e-45 {bits} 0.1 1 236 310 556 300 560 0.9 A name\n"


def test_pipeline_with_reference_and_domains(spark, tmp_path):
    q, r = put(tmp_path / "q.fasta", QUERY), put(tmp_path / "r.fasta", REFERENCE)
    plain = pipeline.run(spark, q, r, str(tmp_path / "out"), pipeline.Options(most=3))
    hits = {c["id"]: c["sequence"] for c in plain["candidates"]}
    assert hits["Q1#1"]["bestKnownHitID"] == "R1" and hits["Q1#1"]["bestKnownHitOrganism"] == "Other" and hits["Q1#1"]["bestKnownHitMethod"] == "native-swift"
    assert hits["Q1#3"]["bestKnownHitID"] == "R1"  # hits are kept by id
    assert hits["Q2#2"]["bestKnownHitID"] == "no native reference hit" and hits["Q2#2"]["knownHitIdentity"] == 0
    d = put(tmp_path / "d.tbl", "".join(DOMAIN.format(bits=b) for b in (10, 40, 30, 20)))
    rich = pipeline.run(spark, q, r, str(tmp_path / "out"), pipeline.Options(most=3, domains=d, summary_model="m", summarize=lambda m, p: "prose"))
    assert [(c["id"], c["total"]) for c in rich["candidates"]] == [(c["id"], c["total"]) for c in plain["candidates"]]
    found = next(c for c in rich["candidates"] if c["id"] == "Q1#1")
    assert [x["bits"] for x in found["domains"]] == [40, 30, 20, 10] and [e["weight"] for e in found["evidence"] if e["kind"] == "domain"] == [0, 0, 0]
    assert rich["advisorySummary"]["text"] == "prose" and any("8 domains on 2" in n for n in rich["notes"])
    broken = pipeline.run(spark, q, None, str(tmp_path / "out"), pipeline.Options(most=1, domains=str(tmp_path / "none"), summary_model="m"))
    assert len(broken["candidates"]) == 1 and sum("left out" in n for n in broken["notes"]) == 2
    assert broken["candidates"][0]["sequence"]["knownHitIdentity"] == 0.5
    text = reports.write_markdown(rich, str(tmp_path / "report.md")).read_text()
    assert "## Validation" in text and "| Dom | PF1.2 | 40.0 | 6.8e-45 | 310-556 | 98% |" in text and "Advisory wording" in text
    assert all(text.count(f"### #{i}") == 1 for i in (1, 2, 3))


def test_external_hits(spark, tmp_path):
    q, r = put(tmp_path / "q.fasta", QUERY), put(tmp_path / "r.fasta", REFERENCE)
    hits = put(tmp_path / "h.m8", "Q2\tsp|R1|X\t24.0\t1e-30\t71.0\t90\n")
    run = pipeline.run(spark, q, r, str(tmp_path / "o"), pipeline.Options(most=3, mmseqs_hits=hits))
    by = {c["id"]: c["sequence"] for c in run["candidates"]}
    assert by["Q2#2"]["bestKnownHitMethod"] == "mmseqs2" and by["Q2#2"]["knownHitIdentity"] == 0.24 and by["Q2#2"]["bestKnownHitAnnotation"] == "transporter"
    assert by["Q1#1"]["bestKnownHitID"] == "no Swiss-Prot hit" and by["Q1#1"]["bestKnownHitMethod"] is None


def _cand(name, kind, hit, qualifies=False):
    return {"sequence": {"id": name, "bestKnownHitID": hit, "bestKnownHitAnnotation": "n", "bestKnownHitOrganism": None, "bestKnownHitSupport": None, "knownHitIdentity": 0.2}, "classification": kind, "qualifies": qualifies,
            "noveltyScore": 0.9, "confidenceScore": 0.7, "machineLoadScore": 0.5, "rank": 1}


def test_selection_and_validation():
    rows = [_cand("a", "Remote x", None), _cand("b", "Remote x", "no native reference hit"), _cand("c", "Other", "T"), _cand("d", "Remote x", "T", True)]
    assert pipeline.select_candidate(rows)["sequence"]["id"] == "d" and pipeline.select_candidate(rows[:3]) is None
    assert pipeline.validation(rows)["qualifyingCandidateIDs"] == ["d"] and not pipeline.validation(rows[:3])["passed"]


def _atoms(shift):
    return "".join(f"ATOM  {i % 99999:5d}  CA  ALA A{i % 9999:4d}    {i * 1.5 + shift:8.3f}{(i % 7) * 1.0:8.3f}{(i % 3) * 2.0:8.3f}  1.00 90.00           C\n" for i in range(200))


def test_structure_and_achievement_commands(spark, tmp_path):
    run = {"candidates": [_cand("d", "Remote x", "T", True)], "configuration": {"datasetName": "n"}, "startedAt": "2026-01-01T00:00:00Z"}
    reports.write_json(tmp_path / "run-1.json", run)
    reports.write_json(tmp_path / "discovery-validation.json", pipeline.validation(run["candidates"]))
    put(tmp_path / "cache" / "d.pdb", _atoms(0))
    with pytest.raises(FileNotFoundError):
        cli.main(["structure", "--run", str(tmp_path), "--cache", str(tmp_path / "cache")])
    put(tmp_path / "cache" / "T.pdb", _atoms(30))
    assert cli.main(["structure", "--run", str(tmp_path), "--cache", str(tmp_path / "cache")]) == 0
    assert cli.main(["achievement", "--run", str(tmp_path)]) == 0
    assert "Status: passed" in (tmp_path / "automation-achievement.md").read_text()
    assert queue.cascading({"run": str(tmp_path / "native_structures"), "shared": "none"}, "d.pdb")[1] == "run-cache"


def test_settings_and_tools(tmp_path, monkeypatch):
    seen = {"physicalMemoryBytes": 24 * 2**30, "freeDiskBytes": 8 * 2**30, "system": "Linux", "machine": "x"}
    given = {k: "auto" for k in ("simReserveBytes", "simRamBudgetBytes", "maxWorkspaceBytes", "simMaxCpuJobs", "esmfoldDevice")} | {"openmmPlatform": "auto"}
    done, notes = host.resolved(given, seen)
    assert done == {"simReserveBytes": 8 * 2**30, "simRamBudgetBytes": 16 * 2**30, "maxWorkspaceBytes": 5 * 2**30, "simMaxCpuJobs": 0, "esmfoldDevice": "cpu", "openmmPlatform": "auto"} and len(notes) == 5
    assert given["simReserveBytes"] == "auto" and host.resolved({"simReserveBytes": 5}, {})[0] == {"simReserveBytes": 5}
    tool = tmp_path / "mmseqs"
    tool.write_text("#!/bin/sh\n")
    assert host.find_tool("mmseqs", folder=str(tmp_path)) is None
    tool.chmod(0o755)
    monkeypatch.setenv("SIM_BIN_DIR", str(tmp_path))
    assert host.find_tool("mmseqs") == str(tool) and host.backends()["mmseqs"]["available"] and not host.backends()["vina"]["available"]
    assert any("mmseqs" in n for n in host.tool_notes(host.tool_statuses()))


def pages_at(folder, *bodies):
    for i, (body, follow) in enumerate(bodies):
        put(folder / f"page-{i}.fasta", body)
        if follow:
            put(folder / f"page-{i}.next", follow)
    return pages.fixture_transport(str(folder))


HOST = "rest.uniprot.org"


def test_pages_follow_the_cursor_and_the_rotation(tmp_path):
    queries = put(tmp_path / "queries.json", json.dumps({"schemaVersion": 1, "queries": [{"id": "q1", "uniprotQuery": "a b"}, {"id": "q2", "uniprotQuery": "c"}]}))
    rotation, follow = str(tmp_path / "rotation.json"), pages.first_address(HOST, "a b", 200) + "&cursor=zz"
    get = pages_at(tmp_path / "fx", (">a\nAC\n", follow), (">b\nAC\n", None), (">c\nAC\n", None))
    held = []
    for _ in range(3):
        pages.refill(rotation, queries, str(tmp_path / "inbox"), HOST, get)
        held.append({k: json.loads(open(rotation).read())[k] for k in ("queryIndex", "queryId", "nextCursor")})
    assert held == [{"queryIndex": 0, "queryId": "q1", "nextCursor": follow}, {"queryIndex": 1, "queryId": "q2", "nextCursor": None}, {"queryIndex": 0, "queryId": "q1", "nextCursor": None}]
    assert len(list((tmp_path / "inbox").glob("*.fasta"))) == 3
    bound = json.loads(open(rotation).read()) | {"nextCursor": follow, "approvedQueryDigest": "sha256:other", "queryIndex": 1}
    pages.write_json(rotation, bound)
    asked = []
    pages.refill(rotation, queries, str(tmp_path / "inbox"), HOST, lambda url: (asked.append(url), (b">d\nA\n", None))[1])
    assert asked == [pages.first_address(HOST, "a b", 200)]


@pytest.mark.parametrize("url", [
    "http://{h}/uniprotkb/search?query=a&format=fasta&size=5", "https://evil/uniprotkb/search?query=a&format=fasta&size=5", "https://{h}:8443/uniprotkb/search?query=a&format=fasta&size=5",
    "https://u:p@{h}/uniprotkb/search?query=a&format=fasta&size=5", "https://{h}/other?query=a&format=fasta&size=5", "https://{h}/uniprotkb/search?query=b&format=fasta&size=5",
    "https://{h}/uniprotkb/search?query=a&format=json&size=5", "https://{h}/uniprotkb/search?query=a&format=fasta&size=500", "https://{h}/uniprotkb/search?query=a&format=fasta&size=5&x=1",
    "https://{h}/uniprotkb/search?query=a&format=fasta&size=5&cursor=1&cursor=2", "https://{h}/uniprotkb/search?query=a&format=fasta&size=5#f", "https://{h}:bad/uniprotkb/search",
])
def test_addresses_outside_the_scope(url):
    pages.check_address(f"https://{HOST}:443/uniprotkb/search?query=a&format=fasta&size=5&cursor=", HOST, "a", 200)
    with pytest.raises(pages.BrokenContract):
        pages.check_address(url.format(h=HOST), HOST, "a", 200)


def test_fetch_tries_again_and_checks_answers():
    def failing(codes):
        left = list(codes)

        def get(_):
            if left:
                raise pages.HttpStatus(left.pop(0))
            return b">a\nA\n", None

        return get

    pauses = []
    url = f"https://{HOST}/uniprotkb/search"
    assert pages.fetch(url, HOST, failing([503, 429]), pauses.append)[0] == b">a\nA\n" and pauses == [1, 2]
    with pytest.raises(pages.TemporaryFailure):
        pages.fetch(url, HOST, failing([503] * 3), pauses.append)
    with pytest.raises(pages.BrokenContract):
        pages.fetch(url, HOST, failing([404]), pauses.append)
    with pytest.raises(pages.BrokenContract):
        pages.fetch(url, HOST, lambda _: (b">a", "https://evil/x"))
    for body in (b"<html>", b">a\nA\n" * 3):
        with pytest.raises(pages.BrokenContract):
            pages.check_body(body, 2)
    assert pages.next_address('<https://x/y>; rel="next", <z>; rel="last"') == "https://x/y" and pages.next_address(None) is None


def approved(places, **more):
    manifest = {"referenceSha256": worker._digest(places.reference), "querySetDigest": worker._digest(places.queries), "reviewer": "someone", "reviewedDate": "2026-01-01", "exclusions": sorted(worker.EXCLUSIONS)} | more
    put(places.manifest, json.dumps(manifest))


def test_cycles(spark, tmp_path):
    places = worker.Places(tmp_path / "w")
    settings = {"maxCandidates": 2, "diskFloorGB": 0, "maxConsecutiveFailures": 2, "enableSimulation": True}
    with pytest.raises(FileNotFoundError):
        worker.cycle(spark, places, settings)
    put(places.reference, REFERENCE)
    assert worker.cycle(spark, places, settings) == (0, "inbox empty")
    put(places.inbox / "b.fasta", ">Z1\n" + LETTERS * 3 + "\n")
    put(places.inbox / "a.fasta", QUERY)
    assert worker.cycle(spark, places, settings, dry=True) == (0, "would read a.fasta")
    asked = []
    assert worker.cycle(spark, places, settings, queue=lambda rows, folder, left: asked.append(rows) or {"ran": 0, "skipped": []}) == (0, "cycle 1: 0 new")
    assert asked == [[]] and [p.name for p in places.inbox.glob("*")] == ["b.fasta"] and next(places.archive.glob("*")).name.endswith("__a.fasta")
    book = worker.read_ledger(spark, places.ledger)
    assert book.count() == 3 and {r.first_seen_cycle for r in book.collect()} == {1}
    run = next(places.runs.glob("cycle_*"))
    assert (run / ".complete").exists() and not (run / ".in_progress").exists() and (places.products / "dashboard.html").exists()
    state = worker.status(spark, places, {"enableNetwork": True})
    assert (state["cycles"], state["discoveries"], state["last_run"], state["network"]) == (1, 0, run.name, True)
    put(places.inbox / "c.fasta", "no fasta\n")
    (places.inbox / "b.fasta").unlink()
    assert worker.cycle(spark, places, settings)[0] == worker.BROKEN and places.failures.read_text() == "1"
    assert worker.cycle(spark, places, settings)[0] == worker.BROKEN and worker.cycle(spark, places, settings) == (0, "paused")
    assert json.loads(places.rotation.read_text())["cycle"] == 1 and (places.inbox / "c.fasta").exists()
    (places.state / "PAUSED").unlink()
    put(places.inbox / "0.fasta", QUERY)  # the same records again
    assert worker.cycle(spark, places, settings) == (0, "cycle 2: 0 new") and worker.read_ledger(spark, places.ledger).count() == 3 and not places.failures.exists()


def test_refill_needs_an_approved_scope(spark, tmp_path):
    places = worker.Places(tmp_path / "w")
    put(places.reference, REFERENCE)
    put(places.queries, json.dumps({"schemaVersion": 1, "queries": [{"id": "q", "uniprotQuery": "a"}]}))
    settings = {"enableNetwork": True, "diskFloorGB": 0, "uniprotHost": HOST}

    def down(_url):
        raise ConnectionError("down")

    assert worker.cycle(spark, places, settings, transport=down)[0] == pages.CONTRACT
    approved(places, reviewer="unset")
    assert worker.cycle(spark, places, settings, transport=down)[0] == pages.CONTRACT
    approved(places, exclusions=[])
    assert not worker.scope_approved(places, True) and worker.scope_approved(places, False)
    approved(places)
    real = pages.time.sleep
    pages.time.sleep = lambda _: None
    try:
        assert worker.cycle(spark, places, settings, transport=lambda url: (b"<html>", None)) == (pages.CONTRACT, "the answer is no FASTA")
    finally:
        pages.time.sleep = real
    put(places.reference, REFERENCE + ">x\nA\n")
    put(places.inbox / "a.fasta", QUERY)
    assert worker.cycle(spark, places, settings) == (pages.CONTRACT, "the reference is not the approved one")


def test_gates_and_lock(tmp_path):
    places = worker.Places(tmp_path)
    put(places.reference, REFERENCE)
    assert worker.gate(places, {"diskFloorGB": 0}) == (True, "ready")
    assert worker.gate(places, {}, free=2**30) == (False, "disk")
    put(places.runs / "x" / "y", "z" * 10)
    assert worker.gate(places, {"diskFloorGB": 0, "maxWorkspaceBytes": 5}) == (False, "quota")
    with pytest.raises(ValueError):
        worker.gate(places, {"budgetSeconds": 0})
    put(places.state / "STOP", "")
    assert worker.gate(places, {}) == (False, "stop")
    with worker.single_instance(places) as first, worker.single_instance(places) as second:
        assert first and not second and (places.lock / "pid").read_text() == str(os.getpid())
    places.lock.mkdir()
    put(places.lock / "pid", "999999999")
    with worker.single_instance(places) as again:
        assert again
    for i in range(5):
        put(places.logs / f"cycle-{i}.log", "x")
    assert worker.prune_logs(places.logs, 2) == 3 and len(list(places.logs.glob("*"))) == 2


def payload(name, sequence):
    return {"accession": name, "sequence": sequence, "seqSha256": hashlib.sha256(sequence.encode()).hexdigest(), "classification": "Remote x"}


def test_payloads(spark, tmp_path):
    assert queue.validated([payload("a", "ACD")])[0]["length"] == 3
    for bad in ({"accession": ""}, {"sequence": "AC-D"}, {"seqSha256": "x"}):
        with pytest.raises(ValueError):
            queue.validated([payload("a", "ACD") | bad])
    assert queue.only([payload("a", "A"), payload("b", "A")], "b")[0]["accession"] == "b" and len(queue.only([1, 2], None)) == 2
    with pytest.raises(ValueError):
        queue.only([payload("a", "A")] * 2, "a")
    rows = queue.load_candidates(spark, put(tmp_path / "c.fasta", ">sp|P1|x y\nac d\n>Q\nWW\n"))
    assert [r["accession"] for r in queue.validated(rows)] == ["P1", "Q"]


def test_queue_stages(tmp_path):
    ready = {b: {"available": b != "foldseek", "path": "tool", "reason": "found"} for b in ("mmseqs", "hmmer", "esmfold", "openmm", "vina", "foldseek")}
    reference, manifest = put(tmp_path / "r.fasta", ">r\nA\n"), put(tmp_path / "m.json", "{}")
    put(tmp_path / "cache" / "b.pdb", "x")
    order = []

    def work(job, timeout):
        order.append((job["backend"], job["accession"]))
        bad = job["backend"] == "vina" and job["accession"] == "b" or job["backend"] == "hmmer"
        out = put(tmp_path / f"{job['accession']}.{job['backend']}", "o")
        return {"accession": job["accession"], "backend": job["backend"], "status": "failed" if bad else "ok", "output": None if bad else out, "outputSha256": "s", "metrics": {"m": 1}}

    settings = queue.Settings(longest=5, manifest=manifest, fallback=str(tmp_path / "cache"), reserve=0, memory=10**12)
    summary = queue.run([payload("a", "ACD"), payload("b", "ACDEFG")], tmp_path / "run", settings, reference=reference, backends=ready, work=work)
    assert {x for x, _ in order[:2]} == {"mmseqs", "hmmer"} and order[2] == ("esmfold", "a") and ("esmfold", "b") not in order
    assert (summary["ran"], summary["failed"]) == (5, 2) and {s["reason_code"] for s in summary["skipped"]} == {"too_long", "unavailable"}
    worth = {e["accession"]: e["realizedComputeValue"] for e in summary["candidateEvidence"]}
    assert worth == {"a": 1.0, "b": 0.4} and summary["structureInputs"]["b"]["source"] == "alphafold-cache"
    assert json.loads((tmp_path / "run" / "sim" / "summary.json").read_text())["schemaVersion"] == 4
    assert len(reports.distinct_reasons([{"backend": "a", "reason": str(i % 20)} for i in range(100)])) == 12


def test_queue_runs_commands(tmp_path):
    tool = tmp_path / "mmseqs"
    put(tool, '#!/bin/sh\necho hit > "$4"\n')
    tool.chmod(0o755)
    backends = {"mmseqs": {"available": True, "path": str(tool), "reason": "found"}}
    reference = put(tmp_path / "r.fasta", ">r\nA\n")
    summary = queue.run([payload("a", "ACD")], tmp_path / "run", queue.Settings(reserve=0), reference=reference, backends=backends)
    job = summary["jobs"][0]
    assert job["status"] == "ok" and job["outputSha256"] == "sha256:" + hashlib.sha256(b"hit\n").hexdigest() and "sequence" not in job


def test_evidence_rows(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "accession string")
    inputs = spark.createDataFrame([("a", "local-folding-backend"), ("b", "alphafold-cache")], "accession string, source string")
    rows = [("a", "openmm", "ok", "{}", 1), ("a", "vina", "ok", "{}", 2), ("b", "openmm", "ok", "{}", 4), ("b", "vina", "failed", None, 3), ("b", "vina", "ok", "{}", 5)]
    results = spark.createDataFrame(rows, "accession string, backend string, status string, metrics string, ordinal int")
    got = {r.accession: (r.realized_compute_value, r.dock) for r in queue.evidence_rows(c, inputs, results).collect()}
    assert got == {"a": (1.0, "ok"), "b": (0.4, "failed"), "c": (0.0, None)}
    assert queue.result_counts(results.withColumn("memory", results.ordinal)).first().asDict() == {"ran": 4, "failed": 1, "peak_memory": 5}


def test_ledger_commands(spark, tmp_path, capsys):
    q = put(tmp_path / "q.fasta", QUERY)
    run = {"candidates": [_cand("Q2", "Remote x", "T", True)], "configuration": {"datasetName": "n"}, "startedAt": "2026-01-01T00:00:00Z"}
    reports.write_json(tmp_path / "run-1.json", run)
    reports.write_json(tmp_path / "discovery-validation.json", pipeline.validation(run["candidates"]))
    book = str(tmp_path / "ledger")
    record = ["ledger", "record", "--ledger", book, "--cycle", "1", "--input", q, "--run", str(tmp_path), "--out", str(tmp_path / "D.md")]
    assert cli.main(record) == 0 and cli.main(["ledger", "count-actionable", "--ledger", book]) == 0
    assert capsys.readouterr().out.split() == ["1", "1"]
    assert cli.main(["ledger", "export-new-actionable", "--ledger", book, "--cycle", "1", "--out", str(tmp_path / "n.json")]) == 0
    assert queue.validated(json.loads((tmp_path / "n.json").read_text()))[0]["accession"] == "Q2"
    assert cli.main(["dashboard", "--ledger", book, "--out", str(tmp_path / "d.html")]) == 0 and cli.main(["host"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["rank", "--unknown"])


def test_latest_run_and_hit_lines(spark, tmp_path):
    from residua.sources import tables

    for name, score in (("run-2026-01-01", 0.1), ("run-2026-01-02", 0.9)):
        reports.write_json(tmp_path / f"{name}.json", {"candidates": [{"id": "x", "sequence": {"id": "A1", "sequence": "MK"}, "noveltyScore": score, "classification": "c"}]})
    assert [tuple(r) for r in tables.read_latest_run(spark, str(tmp_path)).collect()] == [("A1", 0.9, "c")]
    hits = spark.createDataFrame([("b", "t", 0.5, 0.25, 40), ("a", "u", 1.0, 0.1, 4)], "query string, target string, identity double, support double, bits int")
    reports.write_hits(hits, str(tmp_path / "hits"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "hits")).collect()) == ["a\tu\t1.0000\t0.1000\t4.0000", "b\tt\t0.5000\t0.2500\t40.0000"]
    assert tables.read_json_object(str(tmp_path / "run-2026-01-01.json"), "candidates")["candidates"][0]["id"] == "x"
    for bad in ((str(tmp_path / "none.json"),), (str(tmp_path / "run-2026-01-01.json"), "absent")):
        with pytest.raises((FileNotFoundError, ValueError)):
            tables.read_json_object(*bad)


def test_worker_commands(spark, tmp_path, capsys):
    places = worker.Places(tmp_path / "w")
    put(places.reference, REFERENCE)
    put(places.inbox / "a.fasta", QUERY)
    config = put(tmp_path / "c.json", json.dumps({"diskFloorGB": 0, "simReserveBytes": "auto"}))
    assert cli.main(["cycle", "--root", str(places.root), "--config", config, "--dry-run"]) == 0
    assert cli.main(["cycle", "--root", str(places.root), "--config", config]) == 0
    assert cli.main(["status", "--root", str(places.root), "--config", config]) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[:2] == ["would read a.fasta", "cycle 1: 0 new"] and "cycles=1" in said and "network=False" in said
    reference, jobs = put(tmp_path / "r.fasta", ">r\nA\n"), put(tmp_path / "jobs.json", json.dumps([payload("a", "ACD"), payload("b", "ACD")]))
    assert cli.main(["queue", "--candidates", jobs, "--run-dir", str(tmp_path / "q"), "--reference", reference, "--accession", "b", "--config", put(tmp_path / "q.json", '{"simReserveBytes": 0}')]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["ran"] == 0
