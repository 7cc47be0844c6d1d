"""The perpetual worker: one inbox file per micro-batch, each sequence entered into the ledger once."""

from __future__ import annotations

import contextlib
import dataclasses
import datetime
import hashlib
import json
import os
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from residua.functions import residues as rx
from residua.operators.ledger import LEDGER, last_cycles, unseen
from residua.plans import pipeline, reports
from residua.sources import fasta, pages
from residua.sources.fasta import split_records


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All entries; empty before the first batch."""
    schema = f"{LEDGER}, batch long"
    try:
        return spark.read.schema(schema).parquet(ledger)
    except Exception as missing:  # no batch has been committed yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def enter(spark: SparkSession, batch: DataFrame, ledger: str, number: int, run_id: str, judge: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Enter the new sequences of a batch (accession, sequence, in the order of its rows) under its number; gives how many new ones are actionable.

    The first of equal sequences counts; what the ledger holds is never changed. A batch that is
    replayed replaces its own entries only, so a crash between entering and committing costs nothing.
    ``judge`` gives accession, verdict, score and classification (of several rows of an accession the
    last counts); without it all are screened.
    """
    known = read_ledger(spark, ledger).where(F.col("batch") != number)
    numbered = batch.where("sequence is not null and sequence <> ''").withColumn("digest", rx.digest(F.col("sequence"))).withColumn("_o", F.monotonically_increasing_id())
    firsts = numbered.groupBy("digest").agg(F.min(F.struct("_o", "accession", "sequence")).alias("f")).select("digest", "f.accession", "f.sequence")
    fresh = unseen(firsts, known)
    if judge is not None:
        said = judge(fresh).withColumn("_o", F.monotonically_increasing_id())
        last = said.groupBy("accession").agg(F.max_by(F.struct("verdict", "score", "classification"), "_o").alias("j"))
        fresh = fresh.join(last.select("accession", "j.*"), "accession", "left")
    else:
        fresh = fresh.withColumns({"verdict": F.lit(None), "score": F.lit(None), "classification": F.lit(None)})
    stamp = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    entry = fresh.select(
        "digest", "accession", F.upper(F.regexp_replace("sequence", r"\s+", "")).alias("sequence"), F.coalesce(F.col("verdict").cast("string"), F.lit("screened")).alias("verdict"),
        F.col("score").cast("double").alias("score"), F.col("classification").cast("string").alias("classification"), F.lit(number + 1).cast("int").alias("first_seen_cycle"),
        F.lit(run_id).alias("run_id"), F.lit(stamp).alias("ts"),
    )
    at = f"{ledger}/batch={number}"
    entry.write.mode("overwrite").parquet(at)
    return spark.read.schema(LEDGER).parquet(at).where("verdict = 'actionable'").count()


def start(spark: SparkSession, inbox: str, ledger: str, checkpoint: str, *, judge: Callable[[DataFrame], DataFrame] | None = None, run_id: str = "run", once: bool = True) -> StreamingQuery:
    """Read FASTA files of ``inbox`` one per batch; the checkpoint commits after the ledger."""
    lines = spark.readStream.schema("value string").option("lineSep", "\n>").option("maxFilesPerTrigger", 1).text(inbox)
    records = split_records(lines).select(rx.accession(F.col("header")).alias("accession"), F.regexp_replace("body", "\n", "").alias("sequence"))
    writer = records.writeStream.foreachBatch(lambda batch, number: enter(spark, batch, ledger, number, run_id, judge) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="300 seconds")).start()


def judged(run: dict) -> Callable[[DataFrame], DataFrame]:
    """The verdicts of a run, as ``enter`` wants them; a record outside the shortlist is screened."""
    rows = [(c["sequence"]["id"], "actionable" if c["sequence"]["id"] in set(run["validation"]["qualifyingCandidateIDs"]) else "screened", float(c["noveltyScore"]), c["classification"]) for c in run["candidates"]]
    return lambda batch: batch.sparkSession.createDataFrame(rows, "accession string, verdict string, score double, classification string").coalesce(1)


#: Exit codes of a cycle, beside those of the page source.
DONE, BROKEN, EXPORT_FAILED, PAGE_FAILED = 0, 2, 5, 6
#: Fixed value: what an approved scope must exclude.
EXCLUSIONS = frozenset({"virulence factors", "toxin biosynthesis gene clusters", "select-agent homologs"})


@dataclasses.dataclass
class Places:
    """Where a worker keeps its things, all below one folder unless told otherwise."""

    root: Path
    inbox: Path | None = None
    reference: Path | None = None
    manifest: Path | None = None
    queries: Path | None = None

    def __post_init__(self) -> None:
        self.root = Path(self.root)
        for name, default in (("inbox", "inbox"), ("reference", "reference.fasta"), ("manifest", "config/approved_manifest.json"), ("queries", "config/query_rotation.json")):
            setattr(self, name, Path(getattr(self, name) or self.root / default))
        self.state, self.runs, self.archive, self.logs, self.products = (self.root / n for n in ("state", "runs", "processed", "logs", "discoveries"))
        self.rotation, self.ledger, self.lock, self.failures = self.state / "rotation.json", str(self.state / "ledger"), self.state / ".lock", self.state / "consecutive_failures"


def _digest(path: Path) -> str:
    return "sha256:" + hashlib.sha256(path.read_bytes()).hexdigest()


def scope_approved(places: Places, with_queries: bool) -> bool:
    """Whether the approved manifest names the reference as it is and, for a refill, the queries, a reviewer, a date and every needed exclusion."""
    said = json.loads(places.manifest.read_text(encoding="utf-8"))
    if said.get("referenceSha256") != _digest(places.reference):
        return False
    if not with_queries:
        return True
    excluded = {str(x).strip().lower() for x in said.get("exclusions", [])}
    reviewer, date = str(said.get("reviewer", "")).strip().lower(), str(said.get("reviewedDate", "")).strip()
    return said.get("querySetDigest") == _digest(places.queries) and reviewer not in ("", "unset") and len(date) == 10 and excluded >= EXCLUSIONS


def _size(folder: Path) -> int:
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file()) if folder.exists() else 0


def gate(places: Places, settings: dict, free: int | None = None) -> tuple[bool, str]:
    """Whether a cycle may begin, before it touches anything; an absent reference or a wrong budget is an error."""
    for name in ("STOP", "PAUSED"):
        if (places.state / name).exists():
            return False, name.lower()
    if not places.reference.is_file() or not places.reference.stat().st_size:
        raise FileNotFoundError("the reference is missing or empty")
    if int(settings.get("budgetSeconds", 21600)) <= 0:
        raise ValueError("budgetSeconds must be positive")
    free = shutil.disk_usage(places.root).free if free is None else free
    if free < int(settings.get("diskFloorGB", 10)) * 2**30:
        return False, "disk"
    if _size(places.runs) >= int(settings.get("maxWorkspaceBytes", 20 * 2**30)):
        return False, "quota"
    return True, "ready"


@contextlib.contextmanager
def single_instance(places: Places) -> Iterator[bool]:
    """True while this process holds the lock; a lock whose process is gone, or never wrote its number, is taken over."""
    places.state.mkdir(parents=True, exist_ok=True)
    for attempt in range(2):
        try:
            places.lock.mkdir()
            break
        except FileExistsError:
            try:
                os.kill(int((places.lock / "pid").read_text()), 0)
                alive = True
            except (OSError, ValueError) as error:
                alive = isinstance(error, PermissionError)
            if alive or attempt:
                yield False
                return
            shutil.rmtree(places.lock, ignore_errors=True)
    (places.lock / "pid").write_text(str(os.getpid()))
    try:
        yield True
    finally:
        shutil.rmtree(places.lock, ignore_errors=True)


def _failed(places: Places, most: int) -> None:
    n = int(places.failures.read_text() or 0) + 1 if places.failures.exists() else 1
    places.failures.write_text(str(n))
    if n >= most:
        (places.state / "PAUSED").write_text(f"{n} failures in a row\n")


def cycle(
    spark: SparkSession, places: Places, settings: dict, *, transport: Callable | None = None, queue: Callable[[list[dict], Path, float], dict] | None = None,
    notify: Callable[[int, int], None] | None = None, dry: bool = False,
) -> tuple[int, str]:
    """One cycle over the first inbox file by name: exit code and what happened.

    Order: gates, refill of an empty inbox (only with ``transport`` and an approved scope), lock, pipeline,
    ledger, optional job queue within what is left of the budget, products, rotation, archive. A
    crash at any point is followed by a replay that the ledger makes harmless. Failures in a
    row are counted and at ``maxConsecutiveFailures`` pause the worker; a success forgets them.
    """
    began = time.monotonic()
    may, why = gate(places, settings)
    if not may:
        return DONE, why
    batches = sorted(places.inbox.glob("*.fasta"))
    if dry:
        return DONE, f"would read {batches[0].name if batches else 'nothing'}"
    if not batches and transport is not None and settings.get("enableNetwork"):
        if not places.manifest.is_file() or not scope_approved(places, with_queries=True):
            return pages.CONTRACT, "scope is not approved"
        try:
            pages.refill(str(places.rotation), str(places.queries), str(places.inbox), settings.get("uniprotHost", "rest.uniprot.org"), transport, page_size=int(settings.get("fetchPageSize", 200)))
        except pages.TemporaryFailure:
            return DONE, "no answer; cursor unchanged"
        except pages.BrokenContract as error:
            return pages.CONTRACT, str(error)
        batches = sorted(places.inbox.glob("*.fasta"))
    if not batches:
        return DONE, "inbox empty"
    if places.manifest.is_file() and not scope_approved(places, with_queries=False):
        return pages.CONTRACT, "the reference is not the approved one"
    with single_instance(places) as mine:
        if not mine:
            return DONE, "another cycle runs"
        held = json.loads(places.rotation.read_text()) if places.rotation.exists() else {}
        number = int(held.get("cycle", 0)) + 1
        stamp = time.strftime("%Y%m%d_%H%M%S", time.gmtime())
        places.runs.mkdir(parents=True, exist_ok=True)
        folder = Path(tempfile.mkdtemp(prefix=f"cycle_{stamp}_", dir=places.runs))
        (folder / ".in_progress").touch()
        try:
            code, new = _work(spark, places, settings, batches[0], number, folder, held, began, queue)
        except Exception as error:
            code, new, why = getattr(error, "code", BROKEN), 0, f"{type(error).__name__}: {error}"
        (folder / ".in_progress").unlink()
        if code != DONE:
            (folder / ".failed").write_text(f"status={code}\n{why}\n")
            _failed(places, int(settings.get("maxConsecutiveFailures", 5)))
            return code, why
        (folder / ".complete").write_text(time.strftime("%Y-%m-%dT%H:%M:%SZ\n", time.gmtime()))
        places.failures.unlink(missing_ok=True)
    if new and notify is not None:
        with contextlib.suppress(Exception):
            notify(new, number)
    return DONE, f"cycle {number}: {new} new"


class StepFailed(RuntimeError):
    def __init__(self, code: int, what: str):
        super().__init__(what)
        self.code = code


def _work(spark, places: Places, settings: dict, batch: Path, number: int, folder: Path, held: dict, began: float, queue) -> tuple[int, int]:
    options = pipeline.Options(most=int(settings.get("maxCandidates", 20)), dataset=batch.stem)
    run = pipeline.run(spark, str(batch), str(places.reference), str(folder), options)
    reports.write_run(run, str(folder))
    reports.write_markdown(run, str(folder / "discovery-report.md"))
    records = fasta.read_fasta(spark, str(batch), "raw").orderBy("record_ordinal").select(rx.accession(F.col("header")).alias("accession"), "sequence").coalesce(1)
    new = enter(spark, records, places.ledger, number - 1, folder.name, judged(run))
    book = read_ledger(spark, places.ledger)
    reports.write_discoveries(book, str(places.products / "DISCOVERIES.md"))
    summary = None
    if settings.get("enableSimulation") and queue is not None:
        try:
            payload = reports.export_new(book, number)
            reports.write_json(folder / "sim_candidates.json", payload)
            left = int(settings.get("budgetSeconds", 21600)) - (time.monotonic() - began)
            summary = queue(payload, folder, left) if left > 0 else None
        except Exception as error:
            raise StepFailed(EXPORT_FAILED, f"queue: {error}") from error
    try:
        counts = {r.verdict: r.n for r in book.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
        actionable = book.where("verdict = 'actionable'").select("first_seen_cycle", "accession", "score", "classification")
        recent = actionable.orderBy(F.desc("first_seen_cycle"), F.desc("accession"))
        top = actionable.orderBy(F.desc_nulls_last("score"), F.asc("accession"))
        reports.write_dashboard(last_cycles(book, "first_seen_cycle"), recent, str(places.products / "dashboard.html"), counts=counts, top=top, queue=summary)
    except Exception as error:
        raise StepFailed(PAGE_FAILED, f"page: {error}") from error
    # Rotation before archive: a crash between them costs one replay, which enters nothing.
    pages.write_json(places.rotation, held | {"schemaVersion": 1, "cycle": number, "updatedCycle": number, "lastRunId": folder.name})
    places.archive.mkdir(parents=True, exist_ok=True)
    kept = places.archive / f"{folder.name}__{batch.name}"
    if kept.exists():
        raise FileExistsError(f"{kept} exists")
    os.rename(batch, kept)
    prune_logs(places.logs, int(settings.get("maxLogFiles", 200)))
    return DONE, new


def prune_logs(folder: Path, most: int) -> int:
    """Remove the oldest of the worker's own logs beyond ``most``; gives how many went."""
    logs = sorted(folder.glob("cycle-*.log"), key=lambda p: (p.stat().st_mtime, p.name), reverse=True) if folder.exists() else []
    for old in logs[most:]:
        old.unlink()
    return len(logs[most:])


def status(spark: SparkSession, places: Places, settings: dict) -> dict:
    """Cycles, discoveries, last run, the gates' files, the lock, network and free disk."""
    held = json.loads(places.rotation.read_text()) if places.rotation.exists() else {}
    return {
        "cycles": int(held.get("cycle", 0)), "discoveries": read_ledger(spark, places.ledger).where("verdict = 'actionable'").count(), "last_run": held.get("lastRunId") or "none",
        "stop": (places.state / "STOP").exists(), "paused": (places.state / "PAUSED").exists(), "locked": places.lock.exists(), "network": bool(settings.get("enableNetwork")),
        "disk_free_gb": shutil.disk_usage(places.root).free // 2**30,
    }
