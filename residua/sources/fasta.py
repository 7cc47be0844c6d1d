"""FASTA as a splittable source: one row per record, however many lines it has."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions import residues as rx

NUCLEOTIDE_SHARE = 0.9
MODES = ("strict", "lenient", "raw")
#: Fixed value: the letters of a record that is to be folded.
FOLDABLE = "ACDEFGHIKLMNPQRSTVWYX"


class FastaError(ValueError):
    """A file that strict reading refuses."""


def split_records(lines: DataFrame, indented: bool = False) -> DataFrame:
    """header, body and whether a ``>`` stood before it, of rows that were cut at ``\\n>``; ``indented`` also cuts where white space is before the ``>``."""
    text = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n+\\z", "")
    if indented:
        lines = lines.select(*[c for c in lines.columns if c != "value"], F.posexplode(F.split(text, r"\n[ \t\x0B\f]+>")).alias("_k", "value"))
        text, later = F.col("value"), F.col("_k") > 0
    else:
        later = F.lit(False)
    marked = later | F.regexp_like(text, F.lit(r"\A\s*>"))
    text = F.when(marked & ~later, F.regexp_replace(text, r"\A\s*>", "")).otherwise(text)
    header = F.regexp_replace(F.substring_index(text, "\n", 1), r"\A\s+|\s+\z", "")
    body = F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + F.lit(1), F.length(text))).otherwise("")
    return lines.withColumns({"header": header, "body": body, "marked": marked})


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``record_ordinal`` in file order: the place of a row in its split, and the rows of the splits before. Only one row a split is moved.

    A first row that is no record (``_void``: comments above the first header) has ordinal 0.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    splits = rows.groupBy("source_path", "_at").agg(F.min("_row").alias("_least"), F.count(F.lit(1)).alias("_n"), F.min_by("_void", "_row").alias("_first"))
    before = Window.partitionBy("source_path").orderBy("_at")
    ahead = F.sum("_n").over(before) - F.col("_n") - F.first("_first").over(before).cast("long")
    offsets = splits.select("source_path", "_at", "_least", ahead.alias("_ahead"), F.first("_first").over(before).alias("_opened"))
    joined = rows.join(F.broadcast(offsets), ["source_path", "_at"])
    return joined.withColumn("record_ordinal", F.col("_row") - F.col("_least") + F.col("_ahead") + 1)


def read_fasta(spark: SparkSession, path: str | list[str], mode: str = "strict", keep: Column | None = None) -> DataFrame:
    """``source_path``, ``record_ordinal`` (1... in file order), ``header``, ``sequence``, ``problem``.

    strict: white space around lines is nothing, lines that start with ``;`` are dropped, bodies cleaned;
    ``problem`` says what is wrong with a record. lenient: upper case, only A to Z, records without letters
    dropped. raw: lines joined, nothing else. ``keep`` is a condition on ``header``; the bodies of other records
    are not looked at. Files are read in splits; ordinals come from the splits' offsets.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    raw = spark.read.option("lineSep", "\n>").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_at"))
    rows = split_records(raw, indented=mode == "strict")
    text_lines = F.split(F.concat_ws("\n", "header", "body"), "\n")
    void = F.forall(text_lines, lambda x: (F.trim(x).startswith(";") if mode == "strict" else F.lit(False)) | (F.trim(x) == ""))
    rows = _numbered(rows.withColumn("_void", ~F.col("marked") & void)).where("record_ordinal > 0")
    if keep is not None:
        rows = rows.where(keep)
    lines = F.transform(F.split("body", "\n"), lambda x: F.trim(x))
    if mode == "strict":
        lines = F.filter(lines, lambda x: ~x.startswith(";"))
    joined = F.array_join(lines, "")
    fields = ("source_path", "record_ordinal", "header")
    fine = F.lit(None).cast("string").alias("problem")
    if mode == "raw":
        return rows.select(*fields, joined.alias("sequence"), fine)
    if mode == "lenient":
        return rows.withColumn("sequence", F.regexp_replace(F.upper(joined), "[^A-Z]", "")).where("sequence <> ''").select(*fields, "sequence", fine)
    ahead = ~F.col("marked") & (F.col("record_ordinal") == 1) & ~F.col("_opened")
    report = rx.cleaning_report(joined)
    problem = F.when(ahead, "data before the first header").when(F.col("header") == "", "empty header").otherwise(report["problem"])
    kept = (report["residues"].alias("sequence"), problem.alias("problem"), report["gaps"].alias("gaps"), report["stop_trimmed"].alias("stop_trimmed"), report["ambiguous"].alias("ambiguous"))
    return rows.select(*fields, *kept)


def read_text(spark: SparkSession, text: str, mode: str = "strict") -> DataFrame:
    """Records of a text that the caller holds."""
    with tempfile.NamedTemporaryFile("w", suffix=".fasta", delete=False, newline="", encoding="utf-8") as held:
        held.write(text)
    try:
        found = read_fasta(spark, held.name, mode).drop("source_path").collect()  # a text in memory is small
    finally:
        Path(held.name).unlink()
    schema = "record_ordinal long, header string, sequence string, problem string" + (", gaps int, stop_trimmed boolean, ambiguous int" if mode == "strict" else "")
    return spark.createDataFrame(found, schema).withColumn("source_path", F.lit("text"))


def read_one(spark: SparkSession, path: str) -> tuple[str, str]:
    """Accession and sequence of a file of exactly one record, of the letters that can be folded."""
    found = read_fasta(spark, path, "raw").limit(2).collect()
    if len(found) != 1:
        raise FastaError(f"{path}: one record is needed")
    sequence = re.sub(r"\s+", "", found[0].sequence).upper()
    if not sequence or set(sequence) - set(FOLDABLE):
        raise FastaError(f"{path}: empty, or letters other than {FOLDABLE}")
    return (found[0].header.split() or [""])[0], sequence


def proteins(records: DataFrame, source: str) -> DataFrame:
    """Records as proteins with the values that a search fills in later."""
    h = F.col("header")
    name = rx.annotation_name(h)
    return records.select(
        rx.accession(h).alias("id"), F.coalesce(rx.organism_name(h), F.lit("unknown organism")).alias("organism"), F.lit(source).alias("source"), name.alias("annotation"),
        "sequence", F.lit(0.50).alias("knownhitidentity"), rx.annotation_confidence(name).alias("annotationconfidence"), F.lit(1).cast("long").alias("clustersize"),
        "source_path", "record_ordinal",
    )


def parsing_counts(records: DataFrame) -> DataFrame:
    """One row: records, and those with gaps, trimmed stops, ambiguity codes, a look of nucleotides, or a problem."""
    def some(condition: Column, name: str) -> Column:
        return F.sum(condition.cast("long")).alias(name)

    return records.agg(
        F.count(F.lit(1)).alias("records"), some(F.col("gaps") > 0, "gapped"), F.sum("gaps").alias("gaps"), some(F.col("stop_trimmed"), "stops"),
        some(F.col("ambiguous") > 0, "ambiguous"), some(rx.looks_like_nucleotide(F.col("sequence")), "nucleotide"), F.count("problem").alias("problems"),
    )


def require(records: DataFrame) -> list[str]:
    """Raise what strict reading refuses; else notes. The driver sees counts and a few ids."""
    first = records.where("problem is not null").orderBy("source_path", "record_ordinal").select("header", "problem").head(1)
    if first:
        raise FastaError(f"{first[0].header or 'record'}: {first[0].problem}")
    total = parsing_counts(records).first()
    if not total.records:
        raise FastaError("no records")
    if total.nucleotide / total.records >= NUCLEOTIDE_SHARE:
        raise FastaError("these records look like nucleotides")
    notes = []
    if total.gapped:
        notes.append(f"aligned input: {total.gaps} gap signs taken out of {total.gapped} records")
    if total.stops:
        notes.append(f"a final stop was cut off {total.stops} records")
    if total.ambiguous:
        notes.append(f"{total.ambiguous} records hold ambiguity codes, which are scored as they are")
    if total.nucleotide:
        notes.append(f"{total.nucleotide} records look like nucleotides")
    repeated = records.groupBy(rx.accession(F.col("header")).alias("id")).count().where("count > 1").orderBy("id").limit(6).collect()
    if repeated:
        notes.append("repeated ids: " + ", ".join(r.id for r in repeated[:5]) + (", ..." if len(repeated) > 5 else ""))
    return notes


def header_index(headers: DataFrame) -> DataFrame:
    """One row per id (annotation, organism): the last record with it counts."""
    h = F.col("header")
    rows = headers.select(rx.accession(h).alias("id"), rx.annotation_name(h).alias("annotation"), rx.organism_name(h).alias("organism"), "source_path", "record_ordinal")
    last = rows.groupBy("id").agg(F.max(F.struct("source_path", "record_ordinal", "annotation", "organism")).alias("l"))
    return last.select("id", "l.annotation", "l.organism")


def discovery_subset(spark: SparkSession, reference: str, folder: str) -> DataFrame:
    """The references whose header names a function, kept as Parquet under a digest of the reference's files; none is an error.

    A changed reference has another digest, so a kept subset is never stale.
    """
    files = spark.read.format("binaryFile").load(reference).select("path", "length", "modificationTime")
    key = files.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", "path", "length", "modificationTime")))), 256).alias("k")).first().k
    at = f"{folder}/subset-{key[:24]}"
    try:
        kept = spark.read.parquet(at)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        read_fasta(spark, reference, "lenient", rx.is_informative_reference(F.col("header"))).drop("problem").write.mode("overwrite").parquet(at)
        kept = spark.read.parquet(at)
    if not kept.head(1):
        raise FastaError(f"{reference}: no header names a function")
    return kept


def write_fasta(rows: DataFrame, header: str, sequence: str, path: str, width: int = 60) -> None:
    """One entry per row; ``width`` 0 leaves sequences unwrapped."""
    body = rx.wrapped(F.col(sequence), width) if width else F.col(sequence)
    entry = F.concat(F.lit(">"), F.col(header), F.lit("\n"), body)
    rows.where(F.col(header).isNotNull() & F.col(sequence).isNotNull()).select(entry.alias("value")).write.mode("overwrite").text(path)
