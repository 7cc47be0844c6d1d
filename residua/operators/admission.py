"""Which jobs fit into memory, how they share the processors, and their dispatch: small lists on the driver."""

from __future__ import annotations

import os
import signal
import subprocess
import time
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from pathlib import Path

GIB = 2**30
#: GiB that each backend takes (folding also by the square of the length), and which need the accelerator.
MEMORY = {"openmm": 1.5, "vina": 0.75, "mmseqs": 1.0, "foldseek": 1.0, "hmmer": 0.5}
OTHER_MEMORY, FOLD_MEMORY, FOLD_BYTES = 0.5, 5, 800
ACCELERATED = frozenset({"esmfold"})


def memory_of(backend: str, length: int) -> int:
    """Bytes a job is expected to take."""
    if backend == "esmfold":
        return FOLD_MEMORY * GIB + FOLD_BYTES * length * length
    return int(MEMORY.get(backend, OTHER_MEMORY) * GIB)


def memory_budget(total: int | None, most: int, reserve: int) -> int:
    """Bytes that jobs may take: what was configured, but no more than the host has beyond its reserve."""
    if most <= 0 or reserve < 0:
        raise ValueError("a budget must be positive and a reserve not negative")
    return max(0, min(most, (most + reserve if total is None else total) - reserve))


def admit(jobs: Sequence[dict], budget: int, longest: int, available: dict[str, bool] | None = None, accelerators: int = 1) -> tuple[list[dict], list[dict]]:
    """Greedy in the given order; a job that is turned away uses nothing up.

    Jobs have backend and length. Backends that ``available`` does not name as available are
    ``unavailable``; accelerated jobs longer than ``longest`` are ``too_long``; what does not fit into what
    is left is ``ram_budget``; an accelerated job beyond the first ``accelerators`` is ``gpu_serialised``.
    """
    taken, refused, used, busy = [], [], 0, 0
    for job in jobs:
        heavy, need = job["backend"] in ACCELERATED, memory_of(job["backend"], job["length"])
        if available is not None and not available.get(job["backend"], False):
            reason = "unavailable"
        elif heavy and job["length"] > longest:
            reason = "too_long"
        elif used + need > budget:
            reason = "ram_budget"
        elif heavy and busy >= accelerators:
            reason = "gpu_serialised"
        else:
            used, busy = used + need, busy + heavy
            taken.append(job)
            continue
        refused.append({**job, "reason": reason})
    return taken, refused


def split_threads(weights: dict[str, int], total: int) -> dict[str, int]:
    """One thread for each name and the rest by weight; what is left over goes to the largest fractions, then weights, then names from the end of the alphabet."""
    if len(weights) < 2:
        return {name: max(1, total) for name in weights}
    spare = max(total - len(weights), 0)
    exact = {name: spare * weight / sum(weights.values()) for name, weight in weights.items()}
    parts = {name: 1 + int(x) for name, x in exact.items()}
    order = sorted(weights, key=lambda name: (exact[name] - int(exact[name]), weights[name], name), reverse=True)
    for name in order[: max(0, total - sum(parts.values()))]:
        parts[name] += 1
    return parts


def compute_value(folded: bool, cached: bool, relaxed: bool, docked: bool) -> float:
    """What was realised of a candidate's pipeline; the view counts with both relaxation and docking."""
    value = (0.20 if folded else 0.10 if cached else 0.0) + 0.30 * relaxed + 0.35 * docked
    return round(value + 0.15 * (relaxed and docked), 3)


def run_command(command: Sequence[str], timeout: float, grace: float = 10, env: dict[str, str] | None = None) -> dict:
    """Run a command in a process group of its own; beyond ``timeout`` the group is asked to end, after ``grace`` seconds killed.

    Gives status (ok, failed, timeout, missing), code, stdout, stderr and seconds.
    """
    began = time.monotonic()
    try:
        process = subprocess.Popen(list(command), stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, start_new_session=True, env=os.environ | (env or {}))
    except OSError as error:
        return {"status": "missing", "code": None, "stdout": "", "stderr": str(error), "seconds": 0.0}
    status = None
    for step, patience in ((None, timeout), (signal.SIGTERM, grace), (signal.SIGKILL, None)):
        if step is not None:
            status = "timeout"
            try:
                os.killpg(process.pid, step)
            except ProcessLookupError:
                pass
        try:
            out, err = process.communicate(timeout=patience)
            break
        except subprocess.TimeoutExpired:
            continue
    status = status or ("ok" if process.returncode == 0 else "failed")
    return {"status": status, "code": process.returncode, "stdout": out, "stderr": err, "seconds": round(time.monotonic() - began, 3)}


def dispatch(
    jobs: Sequence[dict], work: Callable[[dict, float], dict], budget: int, workers: int, deadline: float, *,
    longest_run: float = 900, last_call: float = 30, pressed: Callable[[], bool] = lambda: False, clock: Callable[[], float] = time.monotonic,
) -> tuple[list[dict], list[dict], dict]:
    """Run jobs side by side within a memory budget; one that ends makes room for the first that now fits, in order.

    ``work(job, timeout)`` gives a result. Refused: ``ram_budget`` (never fits), ``budget_expired``
    (less than ``last_call`` seconds to ``deadline``), ``memory_pressure`` (``pressed()`` while nothing runs). Also
    gives the most jobs and bytes that were in use at once.
    """
    waiting, results, refused, active, used = list(jobs), [], [], {}, 0
    seen = {"most_at_once": 0, "peak_memory": 0}
    with ThreadPoolExecutor(max(1, workers)) as pool:
        while waiting or active:
            if pressed():
                if not active:
                    refused += [{**job, "reason": "memory_pressure"} for job in waiting]
                    break
            else:
                left = deadline - clock()
                if waiting and left <= last_call:
                    refused += [{**job, "reason": "budget_expired"} for job in waiting]
                    waiting = []
                for job in list(waiting):
                    need = memory_of(job["backend"], job["length"])
                    if need > budget:
                        refused.append({**job, "reason": "ram_budget"})
                        waiting.remove(job)
                    elif used + need <= budget and len(active) < workers:
                        waiting.remove(job)
                        active[pool.submit(work, job, min(longest_run, max(1.0, left - last_call)))] = need
                        used += need
                        seen = {"most_at_once": max(seen["most_at_once"], len(active)), "peak_memory": max(seen["peak_memory"], used)}
            if active:
                for future in wait(active, timeout=1, return_when=FIRST_COMPLETED).done:
                    used -= active.pop(future)
                    results.append(future.result())
    return results, refused, seen


def missing_prerequisite(job: dict, reference: str | None, structures: str | None, manifest: str | None) -> str | None:
    """Why a job cannot run, or None."""
    backend = job["backend"]
    if not job.get("sequence"):
        return "no sequence"
    if backend in ("mmseqs", "hmmer") and not (reference and Path(reference).is_file()):
        return "no reference"
    if backend in ("openmm", "foldseek", "vina") and not job.get("structure"):
        return "no structure"
    if backend == "foldseek" and not (structures and Path(structures).exists()):
        return "no structure database"
    if backend == "vina" and not (manifest and Path(manifest).is_file()):
        return "no docking manifest"
    if backend == "vina" and not job.get("classification"):
        return "no classification"
    return None


def command_of(backend: str, tool: str, query: str, out: str, *, reference: str = "", structure: str = "", threads: int = 1) -> tuple[list[str], str]:
    """The command line of a search tool and the file that it writes; tools of other kinds are given by the caller."""
    if backend == "mmseqs":
        return [tool, "easy-search", query, reference, f"{out}/hits.m8", f"{out}/tmp", "--threads", str(threads)], f"{out}/hits.m8"
    if backend == "hmmer":
        return [tool, "--cpu", str(threads), "--tblout", f"{out}/hits.tbl", query, reference], f"{out}/hits.tbl"
    if backend == "foldseek":
        return [tool, "easy-search", structure, reference, f"{out}/hits.m8", f"{out}/tmp", "--threads", str(threads)], f"{out}/hits.m8"
    if backend == "esmfold":
        return [tool, "-i", query, "-o", out], out
    raise ValueError(f"no command is known for {backend}")
