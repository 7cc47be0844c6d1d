"""What the host offers, settings that follow from it, and which tools are installed."""

from __future__ import annotations

import json
import os
import platform
import shutil
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

GIB = 2**30
AUTO = "auto"
#: What is assumed of a host that cannot be asked, and the bounds of what follows.
UNKNOWN_MEMORY, UNKNOWN_DISK = 8 * GIB, 20 * GIB
LEAST_RESERVE, LEAST_BUDGET, LEAST_WORKSPACE, MOST_WORKSPACE = 4 * GIB, GIB, 5 * GIB, 20 * GIB
#: Tools by executable, with the backend that needs them and where else they may lie.
TOOLS = {
    "mmseqs": ("mmseqs", "sequence search"), "phmmer": ("hmmer", "profile search"), "hmmscan": ("domains", "domain annotation"),
    "foldseek": ("foldseek", "structure search"), "vina": ("vina", "docking"), "esmfold": ("esmfold", "folding"), "ollama": ("summary", "advisory wording"),
}
PREFIXES = ("/opt/homebrew/bin", "/usr/local/bin", "/usr/bin")


def facts(path: str = ".") -> dict:
    """System, machine, processors, and bytes of memory and free disk (None where the host does not tell)."""
    try:
        memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError):
        memory = None
    try:
        disk = shutil.disk_usage(path).free
    except OSError:
        disk = None
    return {"system": platform.system(), "machine": platform.machine(), "logicalCpuCount": os.cpu_count() or 1, "physicalMemoryBytes": memory, "freeDiskBytes": disk}


def resolved(settings: dict, host: dict | None = None) -> tuple[dict, list[dict]]:
    """A copy of ``settings`` with the five ``auto`` values replaced by what follows from the host, and a note on each."""
    host, done, notes = host or facts(), dict(settings), []
    memory, disk = host.get("physicalMemoryBytes") or UNKNOWN_MEMORY, host.get("freeDiskBytes") or UNKNOWN_DISK

    def put(key: str, value, reason: str) -> None:
        if done.get(key) == AUTO:
            done[key] = value
            notes.append({"key": key, "value": value, "reason": reason})

    own_reserve = max(LEAST_RESERVE, memory // 3)
    put("simReserveBytes", own_reserve, "a third of the memory, 4 GiB at least")
    reserve = done.get("simReserveBytes")
    put("simRamBudgetBytes", max(LEAST_BUDGET, memory - (reserve if isinstance(reserve, int) else own_reserve)), "the memory beyond the reserve")
    put("maxWorkspaceBytes", max(LEAST_WORKSPACE, min(disk // 4, MOST_WORKSPACE)), "a quarter of the free disk, 5 to 20 GiB")
    put("simMaxCpuJobs", 0, "no limit beyond the processors")
    apple = host.get("system") == "Darwin" and host.get("machine") == "arm64"
    put("esmfoldDevice", "mps" if apple else "cpu", "the accelerator of the host, if any")
    return done, notes


def load_settings(path: str, host: dict | None = None) -> dict:
    """Settings of a JSON file, resolved."""
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ValueError(f"{path}: an object is needed")
    return resolved(value, host)[0]


def find_tool(name: str, bundled: str | None = None, folder: str | None = None) -> str | None:
    """Where an executable is: in ``folder`` alone if one is named (SIM_BIN_DIR), else bundled, on the path, or at a usual prefix."""
    def usable(path: Path) -> str | None:
        return str(path) if path.is_file() and os.access(path, os.X_OK) else None

    folder = folder or os.environ.get("SIM_BIN_DIR")
    if folder:
        return usable(Path(folder) / name)
    tried = [Path(bundled)] if bundled else []
    on_path = shutil.which(name)
    tried += [Path(on_path)] if on_path else []
    tried += [Path(prefix) / name for prefix in dict.fromkeys(PREFIXES)]
    return next((found for path in tried if (found := usable(path))), None)


def tool_statuses(names: Sequence[str] = tuple(TOOLS), folder: str | None = None) -> list[dict]:
    """executable, role, available, path of each tool."""
    found = {name: find_tool(name, folder=folder) for name in names}
    return [{"executable": n, "role": TOOLS.get(n, ("", "tool"))[1], "available": found[n] is not None, "path": found[n]} for n in names]


def tools_frame(spark: SparkSession, statuses: list[dict]) -> DataFrame:
    return spark.createDataFrame(statuses, "executable string, role string, available boolean, path string")


def tool_notes(statuses: list[dict]) -> list[str]:
    """One note on what is there, one on what is not."""
    there, absent = ([s["executable"] for s in statuses if s["available"] is wanted] for wanted in (True, False))
    return ([f"external tools found: {', '.join(there)}"] if there else ["no external tool found; own operators only"]) + ([f"not installed: {', '.join(absent)}"] if absent else [])


def backends(folder: str | None = None) -> dict[str, dict]:
    """available, path and reason of each backend of the queue."""
    out = {}
    for name, (backend, _) in TOOLS.items():
        if backend in ("domains", "summary"):
            continue
        path = find_tool(name, folder=folder)
        if backend == "esmfold" and not path:
            path = find_tool("esm-fold", folder=folder)
        second = find_tool("mk_prepare_receptor.py", folder=folder) if backend == "vina" else path
        good = bool(path and second)
        out[backend] = {"available": good, "path": path, "reason": "found" if good else f"{name} not found" if not path else "mk_prepare_receptor.py not found"}
    out["openmm"] = {"available": False, "path": None, "reason": "python module openmm not installed"}
    try:
        import importlib.util
        import sys

        if importlib.util.find_spec("openmm"):
            out["openmm"] = {"available": True, "path": sys.executable, "reason": "python module openmm"}
    except ImportError:
        pass
    return out
