"""Composition, repetition and motif features of residues, as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residua.functions.residues import STANDARD

#: Residue classes, the membrane window and its threshold, the motifs with their strength.
HYDROPHOBIC, CHARGED, AROMATIC = "AVILMFWY", "DEKRH", "FWY"
MEMBRANE_WINDOW, MEMBRANE_LEAST = 19, 0.72
METAL, HISTIDINE, GLYCINE, CELL_WALL, MEMBRANE = (
    "Cys/His metal-binding pattern", "Histidine-acid catalytic pattern", "Glycine-rich loop", "PBP/transpeptidase motif set", "Hydrophobic membrane segment",
)
STRENGTH = {METAL: 0.86, HISTIDINE: 0.72, GLYCINE: 0.48, CELL_WALL: 0.74, MEMBRANE: 0.64}
METAL_PATTERN, HISTIDINE_PATTERN, GLYCINE_PATTERN = "C.{2,4}C.{6,18}H.{2,4}H", "H.{1,3}H.{8,35}D", "G.G..G"
CELL_WALL_PATTERNS = ("S..K", "S.N", "KTG")


@F.pandas_udf(T.StructType([T.StructField("triplet", T.IntegerType()), T.StructField("membrane", T.IntegerType())]))
def _window_counts(residues: pd.Series) -> pd.DataFrame:
    """Most frequent overlapping triplet, and most hydrophobic letters in one membrane window; whole batches at once."""
    texts = residues.fillna("").tolist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int64) - 65
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]

    def places(width: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.maximum(lengths - width + 1, 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)

    triplet, membrane = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32)
    owner, place = places(3)
    if len(owner):
        code, count = np.unique(owner * 17576 + letters[place] * 676 + letters[place + 1] * 26 + letters[place + 2], return_counts=True)
        np.maximum.at(triplet, code // 17576, count.astype(np.int32))
    owner, place = places(MEMBRANE_WINDOW)
    if len(owner):
        total = np.concatenate([[0], np.cumsum(np.isin(letters, [ord(c) - 65 for c in HYDROPHOBIC]))])
        np.maximum.at(membrane, owner, (total[place + MEMBRANE_WINDOW] - total[place]).astype(np.int32))
    return pd.DataFrame({"triplet": triplet, "membrane": membrane})


def _ratio(q: Column, letters: str) -> Column:
    return F.when(F.length(q) > 0, F.length(F.regexp_replace(q, f"[^{letters}]", "")) / F.length(q)).otherwise(0.0)


def with_features(rows: DataFrame, residues: str) -> DataFrame:
    """Add the feature columns of ``residues``; letters beyond the twenty are left out first.

    Columns: length, hydrophobic_ratio, charged_ratio, cysteine_ratio, aromatic_ratio, entropy,
    low_complexity, membrane_score, motifs (array of names in fixed order). Without any of the twenty
    letters all are 0 but low_complexity, which is 1. Null counts as empty. Sums are folded
    in the order of the letters, so the bits do not depend on partitions.
    """
    q = F.col("_q")
    n = F.length(q)
    out = rows.withColumn("_q", F.regexp_replace(F.coalesce(F.col(residues), F.lit("")), f"[^{STANDARD}]", ""))
    out = out.withColumn("_w", _window_counts("_q"))
    out = out.withColumn("_counts", F.array(*[n - F.length(F.translate(q, letter, "")) for letter in STANDARD]))
    entropy = F.aggregate("_counts", F.lit(0.0), lambda total, c: total + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0))
    repeats = F.when(n >= 9, F.least((F.col("_w.triplet") - 1) / F.lit(6.0), F.lit(1.0))).otherwise(0.0)
    low = F.least(F.array_max("_counts") / n * F.lit(0.65) + repeats * F.lit(0.35), F.lit(1.0))
    membrane = F.col("_w.membrane") / F.lit(float(MEMBRANE_WINDOW))
    walls = sum((q.rlike(p).cast("int") for p in CELL_WALL_PATTERNS[1:]), q.rlike(CELL_WALL_PATTERNS[0]).cast("int"))
    named = [
        F.when(q.rlike(METAL_PATTERN), METAL), F.when(q.rlike(HISTIDINE_PATTERN), HISTIDINE), F.when(q.rlike(GLYCINE_PATTERN), GLYCINE),
        F.when(walls >= 2, CELL_WALL), F.when(membrane > MEMBRANE_LEAST, MEMBRANE),
    ]
    return out.withColumns(
        {
            "length": n,
            "hydrophobic_ratio": _ratio(q, HYDROPHOBIC),
            "charged_ratio": _ratio(q, CHARGED),
            "cysteine_ratio": _ratio(q, "C"),
            "aromatic_ratio": _ratio(q, AROMATIC),
            "entropy": F.when(n > 0, F.least(entropy / F.log2(F.lit(20.0)), F.lit(1.0))).otherwise(0.0),
            "low_complexity": F.when(n > 0, low).otherwise(1.0),
            "membrane_score": membrane,
            "motifs": F.filter(F.array(*named), lambda m: m.isNotNull()),
        }
    ).drop("_q", "_w", "_counts")
