"""The job queue over external tools: search side by side, folding one by one, then relaxing, then comparing and docking; and what it leaves as evidence."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions import residues as rx
from residua.operators import admission
from residua.plans import reports
from residua.sources import fasta, host

DEFINITION = "how complete the artefacts are; no statement on biology"
#: File names of a cached model, newest version first, and of each backend's measurements.
CACHED = ("AF-{0}-F1-model_v6.pdb", "AF-{0}-F1-model_v4.pdb", "{0}.pdb")
METRICS = {"esmfold": "prediction_metrics.json", "openmm": "relaxation_metrics.json", "vina": "docking_metrics.json"}


@dataclasses.dataclass
class Settings:
    memory: int = 16 * admission.GIB
    reserve: int = 8 * admission.GIB
    longest: int = 700
    workers: int = 0
    timeout: float = 900
    grace: float = 10
    last_call: float = 30
    structures: str | None = None
    manifest: str | None = None
    fallback: str | None = None
    search_weights: tuple[int, int] = (1, 2)


def payload_problem(accession, sequence, digest):
    """Why a candidate payload is refused (columns), or null: no accession, a sequence of other signs than letters, or another digest than its own."""
    plain = F.upper(F.regexp_replace(F.coalesce(sequence, F.lit("")), r"\s+", ""))
    said = F.lower(F.trim(F.coalesce(digest, F.lit(""))))
    return (
        F.when(F.trim(F.coalesce(accession, F.lit(""))) == "", "accession")
        .when(~F.coalesce(plain.rlike("^[A-Z]+$"), F.lit(False)), "sequence")
        .when(~said.rlike("^[0-9a-f]{64}$") | (said != F.sha2(plain, 256)), "digest")
    )


def validated(candidates: list[dict]) -> list[dict]:
    """Candidates with plain sequence and length; the first that is refused is an error."""
    done = []
    for c in candidates:
        accession, sequence = str(c.get("accession") or "").strip(), re.sub(r"\s+", "", str(c.get("sequence") or "")).upper()
        if not accession or not re.fullmatch("[A-Z]+", sequence):
            raise ValueError(f"no usable payload for {accession!r}")
        if str(c.get("seqSha256") or "").strip().lower() != hashlib.sha256(sequence.encode()).hexdigest():
            raise ValueError(f"the digest of {accession!r} does not match")
        done.append({"accession": accession, "sequence": sequence, "length": len(sequence), "classification": str(c.get("classification") or ""), "score": c.get("score")})
    return done


def load_candidates(spark: SparkSession, path: str) -> list[dict]:
    """Payloads of a JSON file, or of a FASTA file with digests of its own."""
    if path.endswith(".json"):
        return json.loads(Path(path).read_text(encoding="utf-8"))
    rows = fasta.read_fasta(spark, path, "raw").select(rx.accession(F.col("header")).alias("accession"), F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("sequence"), rx.digest(F.col("sequence")).alias("seqSha256"), "record_ordinal")
    return [{k: r[k] for k in ("accession", "sequence", "seqSha256")} for r in rows.orderBy("record_ordinal").collect()]


def only(candidates: list[dict], accession: str | None) -> list[dict]:
    """All candidates, or the one with the accession; none or several are an error."""
    if not accession:
        return candidates
    found = [c for c in candidates if c.get("accession") == accession]
    if len(found) != 1:
        raise ValueError(f"{len(found)} candidates are {accession}, one is needed")
    return found


def cached_structure(folder: str | None, accession: str) -> str | None:
    """A cached model of exactly this accession."""
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", accession)[:160]
    names = [name.format(safe) for name in CACHED] if folder else []
    return next((str(Path(folder) / n) for n in names if (Path(folder) / n).is_file()), None)


def file_digest(path: str) -> str:
    with open(path, "rb") as held:
        return "sha256:" + hashlib.file_digest(held, "sha256").hexdigest()


def cascading(folders: dict[str, str | None], name: str, fetch: Callable[[str], bytes] | None = None) -> tuple[str, str]:
    """Path of a file and where it was: run-cache, shared-cache (copied into the run) or, only if ``fetch`` is given, network (kept in both)."""
    run, shared = (Path(folders[k]) / name for k in ("run", "shared"))
    if run.is_file():
        return str(run), "run-cache"
    run.parent.mkdir(parents=True, exist_ok=True)
    if shared.is_file():
        run.write_bytes(shared.read_bytes())
        return str(run), "shared-cache"
    if fetch is None:
        raise FileNotFoundError(f"{name} is in no cache")
    body = fetch(name)
    shared.parent.mkdir(parents=True, exist_ok=True)
    for at in (run, shared):
        at.write_bytes(body)
    return str(run), "network"


def run_tool(job: dict, folder: Path, backends: dict, settings: Settings, reference: str | None, timeout: float, helpers: dict[str, Callable] | None = None) -> dict:
    """One job as a command in its own folder; result with status, output, its digest and the measurements beside it."""
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", job["accession"])[:160]
    at = folder / "sim" / "candidates" / safe
    out = at / job["backend"]
    out.mkdir(parents=True, exist_ok=True)
    query = at / "query.fasta"
    query.write_text("".join(f">{r['accession']}\n{r['sequence']}\n" for r in job.get("records") or [job]))
    tool, threads = backends[job["backend"]]["path"] or "", max(1, int(job.get("threads", 1)))
    if helpers and job["backend"] in helpers:
        command, expected = helpers[job["backend"]](job, str(query), str(out))
    else:
        target = settings.structures if job["backend"] == "foldseek" else reference
        command, expected = admission.command_of(job["backend"], tool, str(query), str(out), reference=target or "", structure=job.get("structure") or "", threads=threads)
    done = admission.run_command(command, timeout, settings.grace, {"OMP_NUM_THREADS": str(threads)})
    logs = folder / "sim" / "logs"
    logs.mkdir(parents=True, exist_ok=True)
    for name in ("stdout", "stderr"):
        (logs / f"{safe}.{job['backend']}.{name}.log").write_text(done[name])
    found = Path(expected)
    if found.is_dir():
        found = next(iter(sorted(found.glob("*.pdb"))), found / "missing")
    output = str(found) if found.is_file() else None
    status = "failed" if done["status"] == "ok" and output is None else done["status"]
    measured = found.parent / METRICS.get(job["backend"], "none")
    metrics = json.loads(measured.read_text()) if output and measured.is_file() else None
    public = {k: v for k, v in job.items() if k not in ("sequence", "records")}
    return public | {
        "status": status, "code": done["code"], "seconds": done["seconds"], "memory": admission.memory_of(job["backend"], job["length"]), "command": command, "output": output,
        "outputSha256": file_digest(output) if output else None, "metrics": metrics, "stderrTail": done["stderr"][-2000:],
    }


def evidence_rows(candidates: DataFrame, inputs: DataFrame, results: DataFrame) -> DataFrame:
    """What each candidate's stages left: accession, source, fold, relax and dock status, credit.

    ``inputs``: accession, source (local-folding-backend or alphafold-cache). ``results``: accession, backend,
    status, metrics (null for none), ordinal; the first result of a stage counts. Credit: 0.20 for an own fold or
    0.10 for a cached model, 0.30 for relaxing, 0.35 for docking, 0.15 for both.
    """
    first = results.groupBy("accession", "backend").agg(F.min_by(F.struct("status", "metrics"), "ordinal").alias("r"))
    wide = candidates.select("accession").distinct().join(inputs.select("accession", "source"), "accession", "left")
    for backend, name in (("esmfold", "fold"), ("openmm", "relax"), ("vina", "dock")):
        stage = first.where(F.col("backend") == backend)
        wide = wide.join(stage.select("accession", F.col("r.status").alias(name), ((F.col("r.status") == "ok") & F.col("r.metrics").isNotNull()).alias(f"{name}_done")), "accession", "left")
    relaxed, docked = F.coalesce("relax_done", F.lit(False)), F.coalesce("dock_done", F.lit(False))
    credit = (
        F.when(F.col("source") == "local-folding-backend", 0.20).when(F.col("source").isNotNull(), 0.10).otherwise(0.0)
        + F.when(relaxed, 0.30).otherwise(0.0) + F.when(docked, 0.35).otherwise(0.0) + F.when(relaxed & docked, 0.15).otherwise(0.0)
    )
    return wide.select("accession", "source", "fold", "relax", "dock", F.round(credit, 3).alias("realized_compute_value"))


def result_counts(results: DataFrame) -> DataFrame:
    """One row: jobs that ran, jobs that failed, the largest memory estimate and the most at once."""
    return results.agg(F.count_if(F.col("status") == "ok").alias("ran"), F.count_if(F.coalesce(F.col("status") != "ok", F.lit(True))).alias("failed"), F.max("memory").alias("peak_memory"))


def run(
    candidates: list[dict], folder: str | Path, settings: Settings, *, reference: str | None = None, budget: float = 21600, backends: dict | None = None,
    helpers: dict[str, Callable] | None = None, work: Callable[[dict, float], dict] | None = None, clock: Callable[[], float] = time.monotonic,
) -> dict:
    """Run the stages over validated candidates and write the summary and a file of evidence per candidate."""
    if budget <= 0:
        raise ValueError("the budget must be positive")
    folder, began, candidates = Path(folder), clock(), validated(candidates)
    backends = backends or host.backends()
    room = admission.memory_budget(host.facts()["physicalMemoryBytes"], settings.memory, settings.reserve)
    processors = host.facts()["logicalCpuCount"]
    work = work or (lambda job, timeout: run_tool(job, folder, backends, settings, reference, timeout, helpers))
    skipped, results, inputs, seen = [], [], {}, {"most_at_once": 0, "peak_memory": 0}

    def open_jobs(jobs: list[dict]) -> list[dict]:
        kept = []
        for job in jobs:
            state = backends.get(job["backend"], {"available": False, "reason": "unknown backend"})
            why = None if state["available"] else ("unavailable", state["reason"])
            if why is None and (missing := admission.missing_prerequisite(job, reference, settings.structures, settings.manifest)):
                why = ("prerequisite", missing)
            if why:
                skipped.append({k: v for k, v in job.items() if k not in ("sequence", "records")} | {"reason_code": why[0], "reason": why[1]})
            else:
                kept.append(job)
        return kept

    def together(jobs: list[dict], workers: int) -> list[dict]:
        if not jobs:
            return []
        done, refused, most = admission.dispatch(jobs, work, room, min(workers, len(jobs)), began + budget, longest_run=settings.timeout, last_call=settings.last_call, clock=clock)
        skipped.extend({k: v for k, v in j.items() if k not in ("sequence", "records")} | {"reason_code": j["reason"]} for j in refused)
        for key in seen:
            seen[key] = max(seen[key], most[key])
        return done

    workers = settings.workers or processors
    if candidates:
        batch = {"accession": f"batch-{len(candidates)}", "sequence": "".join(c["sequence"] for c in candidates), "records": candidates, "length": max(c["length"] for c in candidates)}
        jobs = open_jobs([batch | {"backend": b} for b in ("mmseqs", "hmmer")])
        weights = dict(zip(("mmseqs", "hmmer"), settings.search_weights, strict=True))
        threads = admission.split_threads({j["backend"]: weights[j["backend"]] for j in jobs}, processors)
        results += together([j | {"threads": threads[j["backend"]]} for j in jobs], workers)
    for c in candidates:  # folding holds the accelerator, so one at a time
        job = c | {"backend": "esmfold"}
        taken, refused = admission.admit(open_jobs([job]), room, settings.longest)
        skipped.extend({k: v for k, v in j.items() if k != "sequence"} | {"reason_code": j["reason"]} for j in refused)
        for result in together(taken, 1):
            results.append(result)
            if result["status"] == "ok" and result["output"]:
                inputs[c["accession"]] = {"source": "local-folding-backend", "path": result["output"], "sha256": result["outputSha256"]}
    for c in candidates:
        if c["accession"] not in inputs and (path := cached_structure(settings.fallback, c["accession"])):
            inputs[c["accession"]] = {"source": "alphafold-cache", "path": path, "sha256": file_digest(path)}
    relaxed = together(open_jobs([c | {"backend": "openmm", "structure": inputs.get(c["accession"], {}).get("path")} for c in candidates]), workers)
    ready = {r["accession"]: r["output"] for r in relaxed if r["status"] == "ok" and r["output"]}
    after = together(open_jobs([c | {"backend": b, "structure": ready.get(c["accession"])} for c in candidates for b in ("foldseek", "vina")]), workers)
    results += relaxed + after

    def stage(accession: str, backend: str) -> dict:
        return next((r for r in results if r["accession"] == accession and r["backend"] == backend), {})

    evidence = []
    for c in candidates:
        name = c["accession"]
        source, relax, dock = inputs.get(name, {}).get("source"), stage(name, "openmm"), stage(name, "vina")
        good = [bool(s.get("status") == "ok" and s.get("metrics")) for s in (relax, dock)]
        value = admission.compute_value(source == "local-folding-backend", source is not None, *good)
        entry = {
            "schemaVersion": 1, "accession": name, "structureInput": inputs.get(name), "folding": stage(name, "esmfold").get("metrics"), "openmm": relax.get("metrics"), "vina": dock.get("metrics"),
            "relaxedStructure": relax.get("output"), "dockingPose": dock.get("output"), "realizedComputeValue": value, "realizedComputeValueDefinition": DEFINITION,
        }
        safe = re.sub(r"[^A-Za-z0-9_.-]+", "_", name)[:160]
        reports.write_json(folder / "sim" / "candidates" / safe / "structure_evidence.json", entry)
        evidence.append(entry)
    summary = {
        "schemaVersion": 4, "host": host.facts(), "seconds": round(clock() - began, 3), "budgetSeconds": budget, "candidateCount": len(candidates), "backends": backends,
        "resources": seen | {"memoryBudget": room, "processors": processors}, "ran": sum(r["status"] == "ok" for r in results), "failed": sum(r["status"] != "ok" for r in results),
        "jobs": results, "skipped": skipped, "structureInputs": inputs, "candidateEvidence": evidence,
    }
    reports.write_json(folder / "sim" / "summary.json", summary)
    return summary
