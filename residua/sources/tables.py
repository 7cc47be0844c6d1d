"""Readers of search hits, domain tables, structures and JSON runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Three-letter residue names in the order of their letters.
THREE = "ALA CYS ASP GLU PHE GLY HIS ILE LYS LEU MET ASN PRO GLN ARG SER THR VAL TRP TYR".split()
ONE = "ACDEFGHIKLMNPQRSTVWY"
LARGEST = 1.7976931348623157e308


def _number(value: Column, otherwise: float) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(otherwise))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and their order in it: the offset of the split, then the row within."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("ordinal"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated hits: query, target, identity (of 1), evalue, bits, length, ordinal (file and order of lines in it).

    Empty fields shift the rest; short lines are dropped; a missing file has no hits.
    """
    try:
        lines = _lines(spark, path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "query string, target string, identity double, evalue double, bits double, length long, ordinal struct<path: string, at: long, row: long>")
    f = F.filter(F.split("value", "\t"), lambda x: x != "")
    rows = lines.withColumn("f", f).where(F.size("f") >= 6)
    return rows.select(
        F.col("f")[0].alias("query"), F.col("f")[1].alias("target"), (_number(F.col("f")[2], 0.0) / 100).alias("identity"), _number(F.col("f")[3], LARGEST).alias("evalue"),
        _number(F.col("f")[4], 0.0).alias("bits"), F.coalesce(F.col("f")[5].try_cast("long"), F.lit(0)).alias("length"), "ordinal",
    )


def best_hits(hits: DataFrame) -> DataFrame:
    """The hit of each query with the most bits; the first in its file wins ties. Combined before the shuffle."""
    best = hits.groupBy("query").agg(F.min(F.struct((-F.col("bits")).alias("order"), "ordinal", "target", "identity", "evalue", "bits", "length")).alias("b"))
    return best.select("query", "b.target", "b.identity", "b.evalue", "b.bits", "b.length")


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domain table of 22 and more columns; ``#`` lines and short lines are dropped; coverage is clamped to 0...1."""
    rows = spark.read.text(path).where("value not like '#%'").withColumn("f", F.split(F.trim("value"), " +")).where(F.size("f") >= 22)
    at = F.col("f")
    length, low, high = _number(at[2], 0.0), _number(at[15], 0.0), _number(at[16], 0.0)
    text = F.array_join(F.slice("f", 23, F.greatest(F.size("f") - 22, F.lit(0))), " ")
    return rows.select(
        at[3].alias("query"), at[0].alias("name"), at[1].alias("accession"), F.when(text == "-", "").otherwise(text).alias("description"),
        _number(at[6], LARGEST).alias("full_evalue"), _number(at[12], LARGEST).alias("independent_evalue"), _number(at[13], 0.0).alias("bits"),
        at[17].try_cast("long").alias("from"), at[18].try_cast("long").alias("to"),
        F.when(length > 0, F.greatest(F.lit(0.0), F.least((high - low + 1) / length, F.lit(1.0)))).otherwise(0.0).alias("coverage"),
    )


def _cut(low: int, high: int) -> Column:
    return F.trim(F.substring("value", low + 1, high - low))


def read_alpha_carbons(spark: SparkSession, path: str) -> DataFrame:
    """Alpha carbons of fixed-width structure files: source_path, i (0... in file order), chain, number, insertion, residue, letter, x, y, z, confidence."""
    from pyspark.sql import Window

    v = F.col("value")
    rows = _lines(spark, path).where(v.startswith("ATOM") & (F.length(v) >= 66) & (_cut(12, 16) == "CA"))
    names = F.create_map(*[F.lit(x) for pair in zip(THREE, ONE, strict=True) for x in pair])
    rows = rows.select(
        F.col("ordinal.path").alias("source_path"), "ordinal", _cut(21, 22).alias("chain"), _cut(22, 26).try_cast("int").alias("number"), _cut(26, 27).alias("insertion"),
        _cut(17, 20).alias("residue"), F.coalesce(names[_cut(17, 20)], F.lit("X")).alias("letter"), _cut(30, 38).try_cast("double").alias("x"),
        _cut(38, 46).try_cast("double").alias("y"), _cut(46, 54).try_cast("double").alias("z"), _cut(60, 66).try_cast("double").alias("confidence"),
    )
    whole = rows.where("x is not null and y is not null and z is not null")
    # A structure file holds one molecule, so a window over a file is small.
    return whole.withColumn("i", (F.row_number().over(Window.partitionBy("source_path").orderBy("ordinal")) - 1).cast("long")).drop("ordinal")


def require_carbons(carbons: DataFrame) -> DataFrame:
    """``carbons``, or an error if there are none."""
    if not carbons.head(1):
        raise ValueError("no alpha carbons found")
    return carbons


def one_carbon(carbons: DataFrame, chain: str, number: int, insertion: str = "") -> tuple[float, float, float]:
    """Where the one alpha carbon with this key is; none or several are an error."""
    found = carbons.where((F.col("chain") == chain) & (F.col("number") == number) & (F.col("insertion") == insertion)).select("x", "y", "z").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found)} alpha carbons at {chain}:{number}{insertion}, one is needed")
    return tuple(found[0])


def restore_confidence(lines: DataFrame, carbons: DataFrame) -> DataFrame:
    """Atom lines (value) with the confidence of their residue's alpha carbon in columns 61 to 66; lines without one keep theirs."""
    atoms = lines.withColumns({"chain": _cut(21, 22), "number": _cut(22, 26).try_cast("int"), "insertion": _cut(26, 27)})
    known = carbons.groupBy("chain", "number", "insertion").agg(F.first("confidence", ignorenulls=True).alias("confidence"))
    joined = atoms.join(F.broadcast(known), ["chain", "number", "insertion"], "left")
    put = F.overlay(F.rpad("value", 80, " "), F.format_string("%6.2f", "confidence"), F.lit(61), F.lit(6))
    atom = F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")
    kept = [c for c in lines.columns if c != "value"]
    return joined.select(*kept, F.when(atom & F.col("confidence").isNotNull(), F.rtrim(put)).otherwise(F.col("value")).alias("value"))


def percent_confidence(carbons: DataFrame) -> DataFrame:
    """Confidences of 0 to 1 (no file's value above 1.5) as 0 to 100; others as they are."""
    top = carbons.groupBy("source_path").agg(F.max("confidence").alias("_top"))
    return carbons.join(F.broadcast(top), "source_path").withColumn("confidence", F.when(F.col("_top") <= 1.5, F.col("confidence") * 100).otherwise(F.col("confidence"))).drop("_top")


def confidence_summary(carbons: DataFrame) -> DataFrame:
    """Per file: mean, least and greatest confidence."""
    return carbons.groupBy("source_path").agg(F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("greatest"))


def read_poses(spark: SparkSession, path: str) -> DataFrame:
    """Binding energies of docked poses in file order: source_path, pose (1...), energy."""
    from pyspark.sql import Window

    found = F.regexp_extract("value", r"^REMARK VINA RESULT:\s*(-?[0-9.]+)", 1).try_cast("double")
    rows = _lines(spark, path).select(F.col("ordinal.path").alias("source_path"), "ordinal", found.alias("energy")).where("energy is not null")
    return rows.select("source_path", F.row_number().over(Window.partitionBy("source_path").orderBy("ordinal")).alias("pose"), "energy")


def read_model_names(text: str) -> list[str]:
    """First words of the lines below the heading of a model listing."""
    return [line.split()[0] for line in text.splitlines()[1:] if line.split()]


def has_model(name: str, known: list[str]) -> bool:
    """The name itself or its ``:latest`` tag is listed."""
    return name in known or f"{name}:latest" in known


def newest(spark: SparkSession, pattern: str) -> str | None:
    """Path of the newest file of a pattern; of equally new ones the last by name; None if there is none."""
    try:
        files = spark.read.format("binaryFile").load(pattern).select("modificationTime", "path")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    best = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first().m
    return best and best.path


def read_latest_run(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of the last ``run-*.json`` by name: accession, novelty, classification."""
    schema = "candidates array<struct<id string, sequence struct<id string, sequence string>, noveltyScore double, classification string>>"
    runs = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/run-*.json").withColumn("path", F.col("_metadata.file_path"))
    last = runs.agg(F.max_by("candidates", "path").alias("c"))
    return last.select(F.explode("c").alias("c")).select(F.col("c.sequence.id").alias("accession"), F.col("c.noveltyScore").alias("novelty"), F.col("c.classification").alias("classification"))


def read_json_object(path: str, *needed: str) -> dict:
    """A JSON object that must exist and have the named fields."""
    import json
    from pathlib import Path

    at = Path(path)
    if not at.is_file():
        raise FileNotFoundError(f"{path} is missing")
    value = json.loads(at.read_text(encoding="utf-8"))
    if not isinstance(value, dict) or set(needed) - set(value):
        raise ValueError(f"{path}: an object with {', '.join(needed) or 'fields'} is needed")
    return value
