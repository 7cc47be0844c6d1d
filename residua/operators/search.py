"""Nearest references by shared k-mers, redundancy by Jaccard similarity, best hits and enrichment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.residues import STANDARD

#: Gates of a seed hit.
LEAST_SUPPORT, LEAST_SHARED = 0.025, 18


def kmer_sets(rows: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-letter windows of ASCII texts, packed at five bits a letter: text number and code, sorted by both, and how many each text has."""
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    letters = np.frombuffer("".join(rows).encode("ascii"), np.uint8).astype(np.int64) - 64
    counts = np.maximum(lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(rows)), counts)
    place = (np.cumsum(lengths) - lengths)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    code = np.zeros(len(owner), np.int64)
    for i in range(k):
        code = (code << 5) | letters[place + i]
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return owner[fresh], code[fresh], np.bincount(owner[fresh], minlength=len(rows))


def packed_kmers(residues: Column, k: int) -> Column:
    """Distinct k-letter windows of texts of the twenty letters, packed into one number each; none in a shorter text."""
    if k > 12:
        raise ValueError("at most 12 letters fit into one number")

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        _, code, sizes = kmer_sets(texts.fillna("").tolist(), k)
        return pd.Series(np.split(code, np.cumsum(sizes)[:-1]))

    return run(residues)


def standard_only(residues: Column) -> Column:
    """Only the twenty letters; windows then span what was left out."""
    return F.regexp_replace(residues, f"[^{STANDARD}]", "")


#: Queries of one block of the seed scan, references looked at together, and blocks and letters of queries up to which references are scanned and not shuffled.
BLOCK_QUERIES, TOGETHER, MOST_BLOCKS, MOST_LETTERS = 2000, 500, 10, 20_000_000


def _ranking(shared, nq, nt, q_length, t_length, factor):
    """Support and ranking score; the same arithmetic for columns and arrays."""
    support = shared / np.minimum(np.maximum(nq, 1), nt)
    asked = np.maximum(q_length, 1)
    return support, support * (np.minimum(asked, t_length) / np.maximum(asked, t_length) * 0.60 + 0.40) * factor


def _scan_block(shared, k: int, candidates: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References of a batch against one block of queries: window counts as a small matrix, and of each query the best few."""
    ids, by_code, asker, nq, q_length, wall = shared.value
    n = len(nq)
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            owner, code, nt = kmer_sets(part.column("q").to_pylist(), k)
            first, last = np.searchsorted(by_code, code), np.searchsorted(by_code, code, "right")
            many = last - first
            place = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            counts = np.bincount(np.repeat(owner, many) * n + asker[place], minlength=part.num_rows * n)
            hit = np.flatnonzero(counts)
            target, asked, both = hit // n, hit % n, counts[hit]
            header = part.column("header").to_pylist()
            chemistry = np.array(["polyketide" in h for h in header], bool)
            function = np.array([any(w in h for w in ("penicillin-binding", "transpeptidase", "carboxypeptidase")) for h in header], bool)
            t_length = part.column("t_length").to_numpy(zero_copy_only=False)
            factor = np.where(wall[asked] & function[target], 2.4, 1.0)
            factor = factor * np.where(wall[asked] & chemistry[target], 0.35, 1.0) * np.where((q_length[asked] < 1500) & (t_length[target] > 2000) & chemistry[target], 0.55, 1.0)
            support, ranking = _ranking(both, nq[asked], nt[target], q_length[asked], t_length[target], factor)
            gated = np.flatnonzero((support >= LEAST_SUPPORT) | (both >= LEAST_SHARED))
            gated = gated[np.lexsort((-both[gated], -ranking[gated], asked[gated]))]
            run = np.flatnonzero(np.concatenate([[True], asked[gated][1:] != asked[gated][:-1]])) if len(gated) else np.zeros(0, int)
            size = np.diff(np.concatenate([run, [len(gated)]]))
            limit = gated[np.minimum(run + candidates, run + size) - 1] if len(gated) else gated
            # Ties with the last of the best few stay: the target decides between them, over all batches.
            edge = np.repeat(limit, size)
            kept = gated[(ranking[gated] > ranking[edge]) | ((ranking[gated] == ranking[edge]) & (both[gated] >= both[edge]))]
            yield pa.RecordBatch.from_pydict({
                "query": ids.take(pa.array(asked[kept])), "target": part.column("target").take(pa.array(target[kept])), "shared": both[kept].astype(np.int64),
                "support": support[kept].astype(np.float64), "ranking": ranking[kept].astype(np.float64),
            })


def _scanned(queries: DataFrame, references: DataFrame, k: int, candidates: int) -> DataFrame | None:
    """All blocks of queries against one scan of the references each, or None if the queries are too many or too long for that."""
    asked = queries.select("query", F.col("cell_wall").cast("boolean").alias("wall"), F.length("residues").alias("n"), standard_only(F.col("residues")).alias("q")).where("q is not null")
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("q").cast("long")).alias("letters")).first()
    if size.rows > BLOCK_QUERIES * MOST_BLOCKS or (size.letters or 0) > MOST_LETTERS:
        return None
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *references.schema.fields]}
    schema = f"query {kinds['query']}, target {kinds['target']}, shared long, support double, ranking double"
    known = references.select("target", F.lower(F.coalesce("header", F.lit(""))).alias("header"), F.length("residues").alias("t_length"), standard_only(F.col("residues")).alias("q")).where("q is not null")
    held, found = asked.toArrow(), queries.sparkSession.createDataFrame([], schema)
    for at in range(0, held.num_rows, BLOCK_QUERIES):
        part = held.slice(at, BLOCK_QUERIES).combine_chunks()
        owner, code, nq = kmer_sets(part.column("q").to_pylist(), k)
        order = np.argsort(code, kind="stable")
        wall = np.array([bool(w) for w in part.column("wall").to_pylist()], bool)
        block = (part.column("query").combine_chunks(), code[order], owner[order], nq, part.column("n").to_numpy(), wall)
        shared = queries.sparkSession.sparkContext.broadcast(block)  # 2,000 queries
        found = found.unionAll(known.mapInArrow(partial(_scan_block, shared, k, candidates), schema))
    return found


def _joined(queries: DataFrame, references: DataFrame, k: int) -> DataFrame:
    """All pairs that pass the gates, by an equi-join on the window, counted with map-side combination."""
    q = queries.select("query", "cell_wall", F.length("residues").alias("q_length"), packed_kmers(standard_only(F.col("residues")), k).alias("ks"))
    t = references.select("target", F.lower(F.coalesce("header", F.lit(""))).alias("header"), F.length("residues").alias("t_length"), packed_kmers(standard_only(F.col("residues")), k).alias("ks"))
    q_windows = q.select("query", F.explode("ks").alias("w"))
    t_windows = t.select("target", F.explode("ks").alias("w"))
    shared = t_windows.join(q_windows, "w").groupBy("query", "target").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(q.select("query", "cell_wall", "q_length", F.size("ks").alias("nq")), "query").join(t.select("target", "header", "t_length", F.size("ks").alias("nt")), "target")
    support = F.col("shared") / F.least(F.greatest(F.col("nq"), F.lit(1)), F.col("nt"))
    gated = sized.withColumn("support", support).where((F.col("support") >= LEAST_SUPPORT) | (F.col("shared") >= LEAST_SHARED))
    longest, shortest = F.greatest(F.greatest("q_length", F.lit(1)), F.col("t_length")), F.least(F.greatest("q_length", F.lit(1)), F.col("t_length"))
    wall = F.when(F.col("cell_wall") & F.col("header").rlike("penicillin-binding|transpeptidase|carboxypeptidase"), 2.4).otherwise(1.0)
    chem = F.when(F.col("cell_wall") & F.col("header").contains("polyketide"), 0.35).otherwise(1.0)
    huge = F.when((F.col("q_length") < 1500) & (F.col("t_length") > 2000) & F.col("header").contains("polyketide"), 0.55).otherwise(1.0)
    ranking = F.col("support") * (shortest / longest * F.lit(0.60) + F.lit(0.40)) * (wall * chem * huge)
    return gated.select("query", "target", "shared", "support", ranking.alias("ranking"))


def seed_search(queries: DataFrame, references: DataFrame, k: int = 4, candidates: int = 1) -> DataFrame:
    """The best ``candidates`` references of each query by shared k-mers.

    ``queries``: query (unique), residues, cell_wall (has that motif set). ``references``: target, residues,
    header. Up to MOST_BLOCKS blocks of queries are each broadcast to a scan of the references, which
    are not shuffled and of which only the best few per query and batch leave their task. More queries meet the
    references by an equi-join on the window. Order: ranking score, then shared windows (both
    descending), then target. Result: query, target, shared, support, ranking, identity, and place if
    ``candidates`` is above one; queries without a hit are absent. Null residues have no windows.
    """
    found = _scanned(queries, references, k, candidates)
    found = _joined(queries, references, k) if found is None else found
    best = Window.partitionBy("query").orderBy(F.desc("ranking"), F.desc("shared"), F.asc("target"))
    ranked = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= candidates)
    identity = F.greatest(F.lit(0.0), F.least(F.pow("support", F.lit(1.0 / k)) * 0.58, F.lit(0.95)))
    place = [F.col("_r").cast("long").alias("place")] if candidates > 1 else []
    return ranked.select("query", "target", "shared", "support", "ranking", identity.alias("identity"), *place)


#: What a search without a hit leaves behind, and how hits were found.
NO_NATIVE_HIT, NO_MMSEQS_HIT = "no native reference hit", "no Swiss-Prot hit"
NATIVE, MMSEQS = "native-swift", "mmseqs2"


def _named(rows: DataFrame, hits: DataFrame, names: DataFrame | None) -> DataFrame:
    hits = hits.withColumn("_found", F.lit(True))
    if names is not None:
        hits = hits.join(names.select(F.col("id").alias("hit_id"), F.col("annotation").alias("hit_annotation"), F.col("organism").alias("hit_organism")), "hit_id", "left")
    else:
        hits = hits.withColumns({"hit_annotation": F.lit(None).cast("string"), "hit_organism": F.lit(None).cast("string")})
    return rows.join(hits, "id", "left")


def apply_native(rows: DataFrame, hits: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Every row with its native hit or the sign of none: identity, hit_id, hit_annotation, hit_organism, evalue (null), bits, method, support.

    ``hits``: id, hit_id, identity, support, bits (alignment score), one row per id.
    """
    found = _named(rows, hits.select("id", "hit_id", F.col("identity").alias("_identity"), "support", F.col("bits").cast("double").alias("bits")), names)
    return found.withColumns({
        "identity": F.coalesce("_identity", F.lit(0.0)), "hit_id": F.coalesce("hit_id", F.lit(NO_NATIVE_HIT)), "evalue": F.lit(None).cast("double"), "method": F.lit(NATIVE),
    }).drop("_identity", "_found")


def apply_mmseqs(rows: DataFrame, hits: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """As ``apply_native`` for hits with id, hit_id, identity, evalue, bits; without a hit the method stays unset."""
    found = _named(rows, hits.select("id", "hit_id", F.col("identity").alias("_identity"), "evalue", "bits"), names)
    return found.withColumns({
        "identity": F.coalesce("_identity", F.lit(0.0)), "hit_id": F.coalesce("hit_id", F.lit(NO_MMSEQS_HIT)), "method": F.when(F.col("_found"), MMSEQS), "support": F.lit(None).cast("double"),
    }).drop("_identity", "_found")


def hit_per_id(hits: DataFrame, owners: DataFrame, ordinal: str) -> DataFrame:
    """Hits by record as hits by id: of records that share an id, the last one that has a hit counts for all. ``owners``: id and the ordinal."""
    fields = [c for c in hits.columns if c != ordinal]
    last = hits.join(owners.select("id", ordinal), ordinal).groupBy("id").agg(F.max_by(F.struct(*fields), ordinal).alias("h"))
    return last.select("id", *[F.col(f"h.{c}").alias(c) for c in fields])

#: Distinct texts of one block of the all-pairs product, and windows (columns) multiplied at a time.
BLOCK, COLUMNS = 2048, 4096


def _codes(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, window) of all distinct windows; a text shorter than k is its own window."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    width = np.where(lengths < k, lengths, k)
    counts = np.maximum(lengths - k, 0) + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    place = (np.cumsum(lengths) - lengths)[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    code = np.zeros(len(owner), np.int64)
    for i in range(k):  # dense numbers after every letter, so that any k fits
        letter = np.where(i < width[owner], points[np.minimum(place + i, max(len(points) - 1, 0))] + 1 if len(points) else 0, 0)
        _, code = np.unique((code << 21) | letter, return_inverse=True)
    kinds = int(code.max(initial=0)) + 1
    both = np.unique(owner * kinds + code)
    return both // kinds, both % kinds


def _partners(threshold: float, k: int, key: tuple, table: pa.Table) -> pa.Table:
    """Copies of similar texts between two blocks (or inside one), summed per text, by a blocked 0/1 matrix product."""
    low, high = key[0].as_py(), key[1].as_py()
    block, reps, copies = (table.column(c).to_numpy() for c in ("block", "rep", "copies"))
    owner, code = _codes(table.column("text").to_pylist(), k)
    sizes = np.bincount(owner, minlength=len(reps))
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    row = np.zeros(len(reps), np.int64)
    row[left] = np.arange(len(left))
    row[right] = np.arange(len(right))
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code.max(initial=-1)) + 1, COLUMNS):
        part = (code >= at) & (code < at + COLUMNS)
        one, two = (np.zeros((len(x), COLUMNS), np.float32) for x in (left, right))
        for matrix, wanted in ((one, low), (two, high)):
            mine = part & (block[owner] == wanted)
            matrix[row[owner[mine]], code[mine] - at] = 1
        shared += one @ two.T  # counts below 2 ** 24 are exact in float32
    near = shared / np.maximum(sizes[left][:, None] + sizes[right][None, :] - shared, 1).astype(np.float64) >= threshold
    if low == high:
        np.fill_diagonal(near, False)
        ends = [(left, near @ copies[left])]
    else:
        ends = [(left, near @ copies[right]), (right, near.T @ copies[left])]
    kept = [(reps[who][more > 0], more[more > 0]) for who, more in ends]
    return pa.table({"rep": np.concatenate([x[0] for x in kept]).astype(np.int64), "more": np.concatenate([x[1] for x in kept]).astype(np.int64)})


def cluster_sizes(rows: DataFrame, ident: str, residues: str, threshold: float = 0.38, k: int = 3) -> DataFrame:
    """1 + the number of other records whose k-mer sets have a Jaccard similarity of ``threshold`` or more.

    A text shorter than k is its own only window. A threshold of 0 or less counts all records,
    one above 1 or NaN none. Equal texts are folded first and count with their number. With
    three letters nearly all texts share rare windows, so an index prunes nothing; distinct texts
    meet in pairs of fixed blocks, each one matrix product, of which only sums per text leave the
    task. The work is quadratic in distinct texts by definition of the operator. Rows with null
    residues are left out; ids must be unique integers; an empty table gives an empty result.
    """
    data = rows.select(F.col(ident).cast("long").alias("id"), F.col(residues).alias("text")).where("text is not null")
    if math.isnan(threshold) or threshold > 1:
        return data.select("id", F.lit(1).cast("long").alias("cluster_size"))
    if threshold <= 0:
        total = data.count()
        return data.select("id", F.lit(total).cast("long").alias("cluster_size"))
    reps = data.groupBy("text").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    blocks = max(1, -(-reps.count() // BLOCK))
    numbered = reps.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    paired = numbered.withColumn("_o", other).select("rep", "text", "copies", "block", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"))

    def run(key, table):
        return _partners(threshold, k, key, table)

    ends = paired.groupBy("low", "high").applyInArrow(run, "rep long, more long")
    partners = ends.groupBy("rep").agg(F.sum("more").alias("more"))
    sized = reps.join(partners, "rep", "left").select("text", (F.col("copies") + F.coalesce("more", F.lit(0))).alias("cluster_size"))
    return data.join(sized, "text").select("id", "cluster_size")


def best_hits(hits: DataFrame, query: str, score: str, *ties: str) -> DataFrame:
    """The row of each query with the highest score; ties by the given columns ascending. Null queries are left out."""
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last(score), *[F.asc(t) for t in ties])
    return hits.where(F.col(query).isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def last_header(headers: DataFrame, ident: str, ordinal: str) -> DataFrame:
    """One row per id: the one with the largest ordinal."""
    order = Window.partitionBy(ident).orderBy(F.desc(ordinal))
    return headers.where(F.col(ident).isNotNull()).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
