"""Files written from bounded results: JSON, Markdown, the ledger's listing and a page. Each is replaced in one step."""

from __future__ import annotations

import html
import json
import os
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _replace(path: Path, text: str) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, path)
    return path


def write_json(path: str | Path, value) -> Path:
    return _replace(Path(path), json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def write_run(run: dict, folder: str) -> Path:
    """The run as sorted, indented JSON named after its time stamp, the validation beside it."""
    write_json(Path(folder) / "discovery-validation.json", run["validation"])
    name = "run-" + run["startedAt"].replace(":", "-").replace(".", "-") + ".json"
    return write_json(Path(folder) / name, {k: v for k, v in run.items() if k != "validation"})


def _percent(value: float) -> str:
    return f"{int(value * 100 + 0.5)}%"


def _cell(value) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def write_markdown(run: dict, path: str) -> Path:
    """The report: tools, notes, validation, and a section per candidate with its first eight pieces of evidence and its domains."""
    lines = ["# Discovery report", "", f"- Started: {run['startedAt']}", f"- Dataset: {run['configuration']['datasetName']}", f"- Candidates: {len(run['candidates'])}", "", "## Tools", ""]
    lines += [f"- {t['executable']}: {t['path'] or 'not installed'}" for t in run["toolStatuses"]]
    lines += ["", "## Notes", "", *[f"- {note}" for note in run["notes"]]]
    if run.get("advisorySummary"):
        lines += ["", "## Advisory wording", "", f"> {run['advisorySummary']['disclaimer']}", "", run["advisorySummary"]["text"]]
    checked = run["validation"]
    lines += ["", "## Validation", "", f"- Status: {'passed' if checked['passed'] else 'failed'}", f"- {checked['summary']}", f"- Qualifying: {', '.join(checked['qualifyingCandidateIDs']) or 'none'}"]
    lines += ["", *[f"- {c}" for c in checked["criteria"]], "", "## Candidates"]
    for c in run["candidates"]:
        s = c["sequence"]
        facts = [
            ("Class", c["classification"]), ("Organism", s["organism"]), ("Annotation", s["annotation"]), ("Novelty", _percent(c["noveltyScore"])), ("Confidence", _percent(c["confidenceScore"])),
            ("Compute value", _percent(c["machineLoadScore"])), ("Identity to the known hit", _percent(s["knownHitIdentity"])), ("Known hit", s["bestKnownHitID"]), ("Its annotation", s["bestKnownHitAnnotation"]),
            ("Its organism", s["bestKnownHitOrganism"]), ("E-value", None if s["bestKnownHitEValue"] is None else f"{s['bestKnownHitEValue']:.2e}"), ("Method", s["bestKnownHitMethod"]),
            ("Support", None if s["bestKnownHitSupport"] is None else f"{s['bestKnownHitSupport']:.3f}"), ("Cluster", s["clusterSize"]),
        ]
        lines += ["", f"### #{c['rank']} {s['id']}", "", *[f"- {name}: {value}" for name, value in facts if value is not None], "", c["hypothesis"], "", "Evidence:"]
        lines += [f"- {e['title']} ({e['value']}): {e['note']}" for e in c["evidence"][:8]]
        if c["domains"]:
            lines += ["", "| Domain | Accession | Bits | E-value | Residues | Coverage |", "| --- | --- | ---: | ---: | --- | ---: |"]
            lines += [f"| {_cell(d['name'])} | {_cell(d['accession'])} | {d['bits']:.1f} | {d['independent_evalue']:.1e} | {d['from']}-{d['to']} | {_percent(d['coverage'])} |" for d in c["domains"]]
    return _replace(Path(path), "\n".join(lines) + "\n")


def write_structure_summary(result: dict, candidate: dict, sources: dict[str, str], folder: str) -> Path:
    """What a structure comparison gave, as JSON and Markdown."""
    write_json(Path(folder) / "native_structure_result.json", result)
    s = candidate["sequence"]
    lines = [
        "# Structure comparison", "", f"- Status: {'passed' if result['passed'] else 'failed'}", f"- Candidate: {s['id']} ({candidate['classification']}), from {sources.get('query', 'unknown')}",
        f"- Hit: {s['bestKnownHitID']}, from {sources.get('target', 'unknown')}", f"- Aligned residues: {result['aligned']}", f"- Identity: {result['identity'] * 100:.1f}%",
        f"- Coverage: {result['coverage']:.3f}", f"- Agreement of distances: {result['score']:.3f}",
    ]
    return _replace(Path(folder) / "native_structure_summary.md", "\n".join(lines) + "\n")


def write_achievement(run: dict, validation: dict, structure: dict, folder: str) -> tuple[Path, bool]:
    """One page on a run, its validation and its structure comparison; whether both passed."""
    if not run["candidates"]:
        raise ValueError("the run has no candidate")
    top = run["candidates"][0]
    s, passed = top["sequence"], bool(validation["passed"] and structure["passed"])
    support = s.get("bestKnownHitSupport")
    lines = [
        "# Achievement", "", f"- Status: {'passed' if passed else 'failed'}", f"- Started: {run['startedAt']}", f"- Dataset: {run['configuration']['datasetName']}", f"- Candidates: {len(run['candidates'])}",
        f"- Actionable: {len(validation['qualifyingCandidateIDs'])}", f"- First: {s['id']}, {top['classification']}", "", "## Evidence", "", f"- Novelty {_percent(top['noveltyScore'])}, confidence {_percent(top['confidenceScore'])}, compute value {_percent(top['machineLoadScore'])}",
        f"- Hit {s.get('bestKnownHitID') or 'n/a'}, {s.get('bestKnownHitAnnotation') or 'n/a'}, {s.get('bestKnownHitOrganism') or 'n/a'}; identity {_percent(s['knownHitIdentity'])}, support {'n/a' if support is None else f'{support:.3f}'}",
        f"- Structures {structure['query']} and {structure['target']}: {structure['aligned']} residues, coverage {structure['coverage']:.3f}, identity {_percent(structure['identity'])}, score {structure['score']:.3f}",
        "", "A lead by computation; nothing here was measured in a laboratory.",
    ]
    return _replace(Path(folder) / "automation-achievement.md", "\n".join(lines) + "\n"), passed


def write_discoveries(ledger: DataFrame, path: str) -> Path:
    """All actionable entries by cycle, accession and digest; the same ledger gives the same bytes."""
    rows = ledger.where("verdict = 'actionable'").orderBy("first_seen_cycle", "accession", "digest").toLocalIterator()
    lines = ["# Discoveries", "", "| Cycle | Accession | Score | Class | Seen | Run |", "| ---: | --- | ---: | --- | --- | --- |"]
    lines += [f"| {r.first_seen_cycle} | {_cell(r.accession)} | {'—' if r.score is None else f'{r.score:.3f}'} | {_cell(r.classification or '—')} | {r.ts} | {_cell(r.run_id)} |" for r in rows]
    return _replace(Path(path), "\n".join(lines) + "\n")


def distinct_reasons(skipped: Iterable[dict], most: int = 12) -> list[tuple[str, str]]:
    """(backend, reason) of refused jobs in the order in which each first occurs, at most ``most``."""
    return list(dict.fromkeys((s.get("backend", ""), s.get("reason", "")) for s in skipped))[:most]


def write_dashboard(series: DataFrame, recent: DataFrame, path: str, *, counts: dict | None = None, top: DataFrame | None = None, queue: dict | None = None, structures: dict[str, str] | None = None) -> Path:
    """A self-contained page: counts, a bar per cycle, the newest and the best entries, refused jobs, up to six structures; everything is escaped."""
    bars = series.orderBy("cycle").collect()
    high = max([r.n for r in bars], default=0) or 1
    drawn = "".join(f'<rect x="{8 * i}" y="{60 - 60 * r.n / high:.1f}" width="6" height="{60 * r.n / high:.1f}"><title>{r.cycle}: {r.n}</title></rect>' for i, r in enumerate(bars))

    def table(rows, head) -> str:
        def line(cells, tag):
            return "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in cells) + "</tr>"

        return "<table>" + line(head, "th") + "".join(line(r, "td") for r in rows) + "</table>"

    parts = [f'<svg width="{8 * len(bars) + 8}" height="64">{drawn}</svg>']
    if counts:
        parts.insert(0, table(sorted(counts.items()), ("verdict", "entries")))
    parts.append(table(recent.limit(200).collect(), recent.columns))
    if top is not None:
        parts.append(table(top.limit(32).collect(), top.columns))
    if queue:
        parts.append(table([(queue.get("ran", 0), queue.get("failed", 0))], ("ran", "failed")) + table(distinct_reasons(queue.get("skipped", [])), ("backend", "reason")))
    for name, text in list((structures or {}).items())[:6]:
        parts.append(f"<details><summary>{html.escape(name)}</summary><pre>{html.escape(text)}</pre></details>")
    return _replace(Path(path), '<!doctype html><meta charset="utf-8"><title>Ledger</title>' + "".join(parts) + "\n")


def export_new(ledger: DataFrame, cycle: int) -> list[dict]:
    """Actionable entries first seen in a cycle, as payload; an entry without its sequence is an error."""
    rows = ledger.where((F.col("verdict") == "actionable") & (F.col("first_seen_cycle") == cycle)).orderBy("accession", "digest").collect()
    if any(r.sequence is None for r in rows):
        raise ValueError("an actionable entry has no sequence")
    return [{"accession": r.accession, "sequence": r.sequence, "seqSha256": r.digest, "classification": r.classification, "score": r.score} for r in rows]


def write_hits(hits: DataFrame, path: str) -> None:
    """Hit lines (query, target, identity, support, bits) sorted by query, tab-separated, four decimals."""
    line = F.format_string("%s\t%s\t%.4f\t%.4f\t%.4f", "query", "target", "identity", "support", F.col("bits").cast("double"))
    hits.orderBy("query").select(line.alias("value")).write.mode("overwrite").text(path)
