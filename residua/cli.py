"""``python -m residua.cli``: rank, check structures, report, and keep the worker and its ledger."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from residua import __version__
from residua.operators import structure
from residua.plans import pipeline, queue, reports
from residua.sources import host, pages, tables
from residua.streaming import worker


def _rank(spark: SparkSession, given: argparse.Namespace) -> int:
    options = pipeline.Options(
        most=given.max, dataset=given.dataset or "", mmseqs_hits=given.mmseqs_hits, domains=given.domains, domain_evalue=given.domain_evalue,
        summary_model=given.summarize, reference_filter=not given.all_references,
    )
    run = pipeline.run(spark, given.input, given.reference, given.output, options)
    reports.write_run(run, given.output)
    reports.write_markdown(run, f"{given.output}/discovery-report.md")
    for c in run["candidates"]:
        names = ", ".join(d["name"] for d in c["domains"][:3])
        print(f"#{c['rank']} {c['sequence']['id']} {c['classification']} {c['total']:.3f}" + (f" [{names}]" if names else ""))
    return 2 if given.require_discovery and not run["validation"]["passed"] else 0


def _latest(folder: str) -> dict:
    runs = sorted(Path(folder).glob("run-*.json"))
    if not runs:
        raise FileNotFoundError(f"no run in {folder}")
    return tables.read_json_object(str(runs[-1]), "candidates", "configuration", "startedAt")


def _structure(spark: SparkSession, given: argparse.Namespace) -> int:
    candidate = pipeline.select_candidate(_latest(given.run)["candidates"])
    if candidate is None:
        raise LookupError("no candidate of a remote class with a hit")
    names = {"query": candidate["sequence"]["id"], "target": candidate["sequence"]["bestKnownHitID"]}
    paths, sources = {}, {}
    for side, accession in names.items():
        paths[side], sources[side] = queue.cascading({"run": f"{given.run}/native_structures", "shared": given.cache}, f"{accession}.pdb")
    carbons = None
    for side, path in paths.items():
        own = tables.require_carbons(tables.read_alpha_carbons(spark, path)).select(F.lit(names[side]).alias("structure"), "i", "letter", "x", "y", "z")
        carbons = own if carbons is None else carbons.unionAll(own)
    pairs = spark.createDataFrame([(1, names["query"], names["target"])], "pair int, query string, target string")
    result = {k: v for k, v in structure.compare(pairs, carbons.distinct()).first().asDict().items() if k != "pair"}
    print(reports.write_structure_summary(result, candidate, sources, given.run))
    return 0 if result["passed"] else 3


def _achievement(_spark, given: argparse.Namespace) -> int:
    run = _latest(given.run)
    validation = tables.read_json_object(f"{given.run}/discovery-validation.json", "passed", "qualifyingCandidateIDs")
    result = tables.read_json_object(f"{given.run}/native_structure_result.json", "passed", "query", "target")
    path, passed = reports.write_achievement(run, validation, result, given.run)
    print(path)
    return 0 if passed else 2


def _cycle(spark: SparkSession, given: argparse.Namespace) -> int:
    places, settings = worker.Places(given.root), host.load_settings(given.config) if given.config else {}
    transport = pages.fixture_transport(given.pages) if given.pages else None
    code, what = worker.cycle(spark, places, settings, transport=transport, dry=given.dry_run)
    print(what)
    return code


def _status(spark: SparkSession, given: argparse.Namespace) -> int:
    for name, value in worker.status(spark, worker.Places(given.root), host.load_settings(given.config) if given.config else {}).items():
        print(f"{name}={value}")
    return 0


def _ledger(spark: SparkSession, given: argparse.Namespace) -> int:
    book = worker.read_ledger(spark, given.ledger)
    if given.action == "count-actionable":
        print(book.where("verdict = 'actionable'").count())
    elif given.action == "export-new-actionable":
        reports.write_json(given.out, reports.export_new(book, given.cycle))
    else:
        from residua.functions import residues as rx
        from residua.sources import fasta

        run = _latest(given.run) | {"validation": tables.read_json_object(f"{given.run}/discovery-validation.json", "qualifyingCandidateIDs")}
        rows = fasta.read_fasta(spark, given.input, "raw").orderBy("record_ordinal").select(rx.accession(F.col("header")).alias("accession"), "sequence").coalesce(1)
        print(worker.enter(spark, rows, given.ledger, given.cycle - 1, given.run_id, worker.judged(run)))
        reports.write_discoveries(worker.read_ledger(spark, given.ledger), given.out)
    return 0


def _drain(spark: SparkSession, given: argparse.Namespace) -> int:
    worker.start(spark, given.inbox, given.ledger, given.checkpoint).awaitTermination()
    return 0


def _queue(spark: SparkSession, given: argparse.Namespace) -> int:
    settings, _ = host.resolved(json.loads(Path(given.config).read_text()) if given.config else {})
    own = queue.Settings(
        memory=int(settings.get("simRamBudgetBytes", queue.Settings.memory)), reserve=int(settings.get("simReserveBytes", queue.Settings.reserve)), longest=int(settings.get("simMaxSeqLength", 700)),
        workers=int(settings.get("simMaxCpuJobs", 0)), timeout=float(settings.get("simJobTimeoutSeconds", 900)), structures=settings.get("foldseekStructureDatabase"), manifest=settings.get("dockingManifest"),
        fallback=settings.get("structureFallbackDirectory"),
    )
    candidates = queue.only(queue.load_candidates(spark, given.candidates), given.accession)
    summary = queue.run(candidates, given.run_dir, own, reference=given.reference, budget=given.budget_seconds)
    print(json.dumps({"ran": summary["ran"], "failed": summary["failed"], "skipped": len(summary["skipped"])}))
    return 0


def _dashboard(spark: SparkSession, given: argparse.Namespace) -> int:
    from residua.operators.ledger import last_cycles

    book = worker.read_ledger(spark, given.ledger)
    recent = book.where("verdict = 'actionable'").orderBy(F.desc("first_seen_cycle"), F.desc("accession")).select("first_seen_cycle", "accession", "score", "classification")
    print(reports.write_dashboard(last_cycles(book, "first_seen_cycle"), recent, given.out))
    return 0


def _host(_spark, given: argparse.Namespace) -> int:
    done, notes = host.resolved(json.loads(Path(given.config).read_text()) if given.config else {})
    print(json.dumps({"host": host.facts(), "settings": done, "notes": notes}, indent=2, sort_keys=True))
    return 0


#: Commands: what they run, whether they need a session, and their arguments (a trailing ``!`` marks one that is needed).
COMMANDS = {
    "rank": (_rank, True, {"--input!": {}, "--reference": {}, "--output!": {}, "--max": {"type": int, "default": 8}, "--dataset": {}, "--require-discovery": {"action": "store_true"}, "--mmseqs-hits": {}, "--domains": {},
        "--domain-evalue": {"type": float}, "--summarize": {}, "--all-references": {"action": "store_true"}}),
    "structure": (_structure, True, {"--run!": {}, "--cache!": {}}),
    "achievement": (_achievement, False, {"--run!": {}}),
    "cycle": (_cycle, True, {"--root!": {}, "--config": {}, "--pages": {}, "--dry-run": {"action": "store_true"}}),
    "status": (_status, True, {"--root!": {}, "--config": {}}),
    "ledger": (_ledger, True, {"action": {"choices": ["record", "count-actionable", "export-new-actionable"]}, "--ledger!": {}, "--cycle": {"type": int}, "--out": {}, "--input": {}, "--run": {}, "--run-id": {"default": "run"}}),
    "drain": (_drain, True, {"--inbox!": {}, "--ledger!": {}, "--checkpoint!": {}}),
    "queue": (_queue, True, {"--candidates!": {}, "--run-dir!": {}, "--config": {}, "--reference": {}, "--accession": {}, "--budget-seconds": {"type": int, "default": 21600}}),
    "dashboard": (_dashboard, True, {"--ledger!": {}, "--out!": {}}),
    "host": (_host, False, {"--config": {}}),
}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="residua")
    parser.add_argument("--version", action="version", version=__version__)
    parts = parser.add_subparsers(dest="command", required=True)
    for name, (_, _, flags) in COMMANDS.items():
        own = parts.add_parser(name)
        for flag, kind in flags.items():
            own.add_argument(flag.rstrip("!"), **kind, **({"required": True} if flag.endswith("!") else {}))
    given = parser.parse_args(arguments)
    work, needs_session, _ = COMMANDS[given.command]
    return work(SparkSession.builder.appName("residua").getOrCreate() if needs_session else None, given)


if __name__ == "__main__":
    sys.exit(main())
