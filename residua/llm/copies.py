"""Exact copies: one representative for equal texts, and who belongs to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts(frames: list[DataFrame], ident: str, text, least: int) -> DataFrame:
    """``id``, ``text`` of all frames; null texts and those under ``least`` letters are left out."""
    rows = [f.select(F.col(ident).cast("long").alias("id"), text.alias("text")) for f in frames]
    both = rows[0]
    for more in rows[1:]:
        both = both.unionAll(more)
    return both.where(F.col("id").isNotNull() & (F.length("text") >= least))


def representatives(rows: DataFrame) -> DataFrame:
    """``rep`` (smallest id), ``text``, ``n``: one row per distinct text, combined before the shuffle."""
    return rows.groupBy("text").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))


def fingerprint() -> list:
    """128 bits of ``text`` in two columns: equal texts without shuffling the texts.

    Spark seeds the hash of a column with that of the column before it, so a literal ahead of the
    text gives a second hash of the text itself (a literal behind it would only hash the hash).
    """
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def members(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``id``, ``rep`` of every row; narrow, and hot copies do no more than repeat a join key."""
    return rows.select("id", *fingerprint()).join(reps.select("rep", *fingerprint()), ["h1", "h2"]).select("id", "rep")
