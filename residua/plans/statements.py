"""SQL that states the queries of the catalog independently of Spark."""

from __future__ import annotations

#: Fixed values, written out here once more so that a wrong one in the functions shows.
STANDARD, AMBIGUOUS = "ACDEFGHIKLMNPQRSTVWY", "BZJXOU"
HYDROPHOBIC, CHARGED, AROMATIC = "AVILMFWY", "DEKRH", "FWY"
METAL, METAL_PATTERN = "Cys/His metal-binding pattern", "C.{2,4}C.{6,18}H.{2,4}H"
HISTIDINE, HISTIDINE_PATTERN = "Histidine-acid catalytic pattern", "H.{1,3}H.{8,35}D"
GLYCINE, GLYCINE_PATTERN = "Glycine-rich loop", "G.G..G"
CELL_WALL, MEMBRANE = "PBP/transpeptidase motif set", "Hydrophobic membrane segment"
STRENGTH = {METAL: 0.86, HISTIDINE: 0.72, GLYCINE: 0.48, CELL_WALL: 0.74, MEMBRANE: 0.64}
EXCLUDED_WORDS = ("uncharacterized", "hypothetical", "fragment")
INFORMATIVE_WORDS = (
    "penicillin-binding", "transpeptidase", "carboxypeptidase", "polyketide", "synthase", "transferase", "hydrolase", "oxidase", "reductase", "dehydrogenase",
    "kinase", "phosphatase", "transport", "transporter", "permease", "channel", "ligase", "isomerase", "lyase", "enzyme",
)
NO_HIT = "no Swiss-Prot hit"

CLEAN = "regexp_replace(regexp_replace(upper(sequence), '[\\s0-9.~-]', '', 'g'), '\\*$', '')"
_COUNTS = ", ".join(f"length(q) - length(replace(q, '{c}', ''))" for c in STANDARD)


def accession(column: str) -> str:
    token = f"split_part(ltrim({column}, ' '), ' ', 1)"
    pieces = f"list_filter(string_split({token}, '|'), lambda x: x <> '')"
    return f"CASE WHEN len({pieces}) >= 2 THEN {pieces}[2] ELSE {token} END"


def _share(letters: str) -> str:
    return f"CASE WHEN n > 0 THEN length(regexp_replace(q, '[^{letters}]', '', 'g')) / n ELSE 0 END"


FEATURES = f"""
base AS (SELECT *, regexp_replace({CLEAN}, '[^{STANDARD}]', '', 'g') AS q FROM proteins WHERE sequence IS NOT NULL),
sized AS (SELECT *, length(q) AS n, [{_COUNTS}] AS counts FROM base),
triplets AS (SELECT record_ordinal, max(c) AS triplet FROM (
  SELECT record_ordinal, substr(q, i, 3) AS w, count(*) AS c
  FROM (SELECT record_ordinal, q, unnest(range(1, length(q) - 1)) AS i FROM base WHERE length(q) >= 3) GROUP BY 1, 2) GROUP BY 1),
membranes AS (SELECT record_ordinal, max(length(regexp_replace(substr(q, i, 19), '[^{HYDROPHOBIC}]', '', 'g'))) AS m
  FROM (SELECT record_ordinal, q, unnest(range(1, length(q) - 17)) AS i FROM base WHERE length(q) >= 19) GROUP BY 1),
measured AS (SELECT sized.*, coalesce(m, 0) / 19.0::DOUBLE AS membrane_score,
  CASE WHEN n > 0 THEN least(list_sum(list_transform(counts, lambda c: CASE WHEN c > 0 THEN -(c / n) * log2(c / n) ELSE 0 END)) / log2(20), 1) ELSE 0 END AS entropy,
  CASE WHEN n > 0 THEN least(0.65::DOUBLE * list_max(counts) / n + 0.35::DOUBLE * CASE WHEN n >= 9 THEN least((triplet - 1) / 6.0::DOUBLE, 1) ELSE 0 END, 1) ELSE 1 END AS low_complexity
  FROM sized LEFT JOIN triplets USING (record_ordinal) LEFT JOIN membranes USING (record_ordinal)),
featured AS (SELECT *, list_filter([
  CASE WHEN regexp_matches(q, '{METAL_PATTERN}') THEN '{METAL}' END,
  CASE WHEN regexp_matches(q, '{HISTIDINE_PATTERN}') THEN '{HISTIDINE}' END,
  CASE WHEN regexp_matches(q, '{GLYCINE_PATTERN}') THEN '{GLYCINE}' END,
  CASE WHEN regexp_matches(q, 'S..K')::INT + regexp_matches(q, 'S.N')::INT + regexp_matches(q, 'KTG')::INT >= 2 THEN '{CELL_WALL}' END,
  CASE WHEN membrane_score > 0.72 THEN '{MEMBRANE}' END], lambda x: x IS NOT NULL) AS motifs FROM measured)"""

SCORES = f"""{FEATURES},
terms AS (SELECT *, knownhitidentity AS ident, annotationconfidence AS conf, clustersize::DOUBLE AS size, len(motifs)::DOUBLE AS k, lower(coalesce(bestknownhitannotation, '')) AS hit FROM featured),
parts AS (SELECT *,
  greatest(0, least(1, greatest(0, least(1 - ident, 1)) * 0.46::DOUBLE + greatest(0, least(1 - conf, 1)) * 0.34::DOUBLE + least(k * 0.12::DOUBLE, 0.24::DOUBLE)
    + least(ln(greatest(size, 1)) / ln(80), 1) * 0.16::DOUBLE - CASE WHEN low_complexity > 0.42 THEN 0.16::DOUBLE ELSE 0 END)) AS novelty,
  greatest(0, least(1, CASE WHEN n BETWEEN 70 AND 520 THEN 1 WHEN n BETWEEN 40 AND 69 OR n BETWEEN 521 AND 760 THEN 0.72::DOUBLE ELSE 0.42::DOUBLE END * 0.28::DOUBLE
    + entropy * 0.28::DOUBLE + least(size / 40, 1) * 0.28::DOUBLE + least(k * 0.18::DOUBLE, 0.36::DOUBLE) - low_complexity * 0.24::DOUBLE)) AS confidence,
  greatest(0, least(1, least(n / 600, 1) * 0.48::DOUBLE + least(ln(greatest(size, 1)) / ln(100), 1) * 0.34::DOUBLE + least(k * 0.18::DOUBLE, 0.36::DOUBLE))) AS machine_load
  FROM terms),
scored AS (SELECT *, (novelty * 0.54::DOUBLE + confidence * 0.28::DOUBLE + machine_load * 0.18::DOUBLE)
    * CASE WHEN bestknownhitid = '{NO_HIT}' THEN CASE WHEN size >= 4 THEN 0.96::DOUBLE ELSE 0.88::DOUBLE END WHEN bestknownhitannotation IS NULL THEN 0.94::DOUBLE ELSE 1 END AS total,
  CASE WHEN contains(hit, 'penicillin-binding protein') THEN 'Remote PBP-like cell-wall enzyme candidate'
    WHEN contains(hit, 'polyketide synthase') THEN 'Remote polyketide-synthase-like candidate'
    WHEN contains(hit, 'transporter') OR contains(hit, 'permease') THEN 'Remote membrane transport candidate'
    WHEN list_contains(motifs, '{METAL}') OR list_contains(motifs, '{HISTIDINE}') THEN 'Metalloenzyme-like orphan'
    WHEN membrane_score > 0.72 THEN 'Membrane-associated unknown'
    WHEN low_complexity > 0.42 THEN 'Low-complexity interaction candidate'
    WHEN ident < 0.22 AND conf < 0.30 THEN 'Remote-fold prospect' ELSE 'Annotation refinement target' END AS classification FROM parts),
shortlist AS (SELECT * FROM scored ORDER BY round(total, 9) DESC, id, record_ordinal LIMIT 20)"""

BEST_HITS = f"""
hits AS (SELECT {accession("queryid")} AS query, {accession("targetid")} AS target, CASE WHEN bitscore IS NULL OR isnan(bitscore) THEN 0 ELSE bitscore END AS bits, evalue AS e, loaded_at, cycle
  FROM mmseqs_hits WHERE queryid IS NOT NULL AND targetid IS NOT NULL),
best AS (SELECT query, target, bits FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, target) AS r FROM hits) WHERE r = 1)"""
_LAST = "SELECT id, annotation, organism, header_ordinal FROM reference_headers WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY header_ordinal DESC) = 1"
_DENSE = "regexp_replace(upper(sequence), '[\\s0-9]', '', 'g')"
CLEANED = f"""
WITH a AS (SELECT record_ordinal, {_DENSE} AS dense FROM processed WHERE sequence IS NOT NULL),
b AS (SELECT *, regexp_replace(dense, '[.~-]', '', 'g') AS bare FROM a),
c AS (SELECT *, regexp_replace(bare, '\\*$', '') AS residues FROM b),
cleaned AS (SELECT record_ordinal, residues, length(dense) - length(bare) AS gaps, bare LIKE '%*' AS stop_trimmed,
  length(regexp_replace(residues, '[^{AMBIGUOUS}]', '', 'g')) AS ambiguous,
  CASE WHEN regexp_matches(dense, '[^{STANDARD}{AMBIGUOUS}.~*-]') THEN 'letter@' || (length(regexp_extract(dense, '^[{STANDARD}{AMBIGUOUS}.~*-]*')) + 1)
    WHEN contains(residues, '*') THEN 'stop@' || strpos(residues, '*') WHEN residues = '' THEN 'empty' END AS problem FROM c)"""
_FIRST = "SELECT lower(seq_sha256) AS digest, record_ordinal, accession, verdict, first_seen_cycle FROM processed WHERE seq_sha256 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(seq_sha256) ORDER BY record_ordinal) = 1"
_MODEL = "SELECT modelentityid, latestversion, record_ordinal, pdbpath FROM alphafold_cache WHERE modelentityid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY modelentityid ORDER BY latestversion DESC NULLS LAST, record_ordinal) = 1"


def _evidence() -> str:
    def pct(v: str) -> str:
        return f"round({v} * 100)::INT || '%'"

    rows = [
        (1, "'Known hit identity'", pct("ident"), "1 - ident", "true"), (2, "'Annotation confidence'", pct("conf"), "1 - conf", "true"),
        (3, "'Sequence entropy'", pct("entropy"), "entropy", "true"), (4, "'Estimated compute value'", pct("machine_load"), "machine_load", "true"),
    ]
    rows += [(5 + i, f"'{name}'", pct(f"{strength}::DOUBLE"), f"{strength}::DOUBLE", f"list_contains(motifs, '{name}')") for i, (name, strength) in enumerate(STRENGTH.items())]
    rows += [
        (20, "'Low-complexity warning'", pct("low_complexity"), "low_complexity", "low_complexity > 0.42"), (21, "'Composite novelty'", pct("novelty"), "novelty", "true"),
        (22, "'Composite confidence'", pct("confidence"), "confidence", "true"), (23, "'Best known hit'", "bestknownhitid", "1 - ident", "bestknownhitid IS NOT NULL"),
    ]
    return " UNION ALL ".join(f"SELECT record_ordinal, {o} AS o, {t} AS title, {v} AS value, ({w})::DOUBLE AS weight FROM shortlist WHERE {c}" for o, t, v, w, c in rows)


def _four(source: str) -> str:
    return f"SELECT DISTINCT record_ordinal, substr(q, i, 4) AS w FROM (SELECT record_ordinal, q, unnest(range(1, length(q) - 2)) AS i FROM {source} WHERE length(q) >= 4)"


SEED = f"""WITH {FEATURES},
asked AS (SELECT record_ordinal, {CLEAN} AS residues, q, list_contains(motifs, '{CELL_WALL}') AS wall FROM featured WHERE record_ordinal % 50 = 0),
known AS (SELECT record_ordinal, {CLEAN} AS residues, regexp_replace({CLEAN}, '[^{STANDARD}]', '', 'g') AS q, lower(coalesce(uniprotdescription, '')) AS header FROM alphafold_cache WHERE sequence IS NOT NULL),
qw AS ({_four("asked")}), tw AS ({_four("known")}),
shared AS (SELECT x.record_ordinal AS query, y.record_ordinal AS target, count(*) AS shared FROM qw x JOIN tw y USING (w) GROUP BY 1, 2),
seeds AS (SELECT *, (SELECT count(*) FROM qw WHERE record_ordinal = query) AS nq, (SELECT count(*) FROM tw WHERE record_ordinal = target) AS nt FROM shared),
gated AS (SELECT s.*, shared / least(greatest(nq, 1), nt) AS support, greatest(length(a.residues), 1) AS ql, length(k.residues) AS tl, wall, header
  FROM seeds s JOIN asked a ON a.record_ordinal = query JOIN known k ON k.record_ordinal = target),
ranked AS (SELECT query, target, shared, support, support * (0.40::DOUBLE + 0.60::DOUBLE * least(ql, tl) / greatest(ql, tl))
    * CASE WHEN wall AND regexp_matches(header, 'penicillin-binding|transpeptidase|carboxypeptidase') THEN 2.4::DOUBLE ELSE 1 END
    * CASE WHEN wall AND contains(header, 'polyketide') THEN 0.35::DOUBLE ELSE 1 END
    * CASE WHEN ql < 1500 AND tl > 2000 AND contains(header, 'polyketide') THEN 0.55::DOUBLE ELSE 1 END AS ranking FROM gated WHERE support >= 0.025 OR shared >= 18)
SELECT query, target, shared, round(support, 6) AS support, round(ranking, 6) AS ranking, round(greatest(0, least(power(support, 0.25) * 0.58::DOUBLE, 0.95::DOUBLE)), 6) AS identity
FROM ranked QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(ranking, 12) DESC, shared DESC, target) = 1"""

CLUSTERS = f"""
WITH texts AS (SELECT s, count(*) AS copies, row_number() OVER () AS t FROM (SELECT {CLEAN} AS s FROM proteins WHERE sequence IS NOT NULL) GROUP BY s),
windows AS (SELECT DISTINCT t, w FROM (SELECT t, substr(s, i, 3) AS w FROM (SELECT t, s, unnest(range(1, length(s) - 1)) AS i FROM texts WHERE length(s) >= 3)
  UNION ALL SELECT t, s FROM texts WHERE length(s) < 3)),
sizes AS (SELECT t, count(*) AS n FROM windows GROUP BY t),
shared AS (SELECT x.t AS a, y.t AS b, count(*) AS c FROM windows x JOIN windows y USING (w) WHERE x.t <> y.t GROUP BY 1, 2),
more AS (SELECT a AS t, sum(copies) AS m FROM shared JOIN sizes p ON p.t = a JOIN sizes q ON q.t = b JOIN texts ON texts.t = b WHERE c / (p.n + q.n - c) >= 0.38 GROUP BY a)
SELECT record_ordinal, (copies + coalesce(m, 0))::BIGINT AS cluster_size FROM proteins JOIN texts ON s = {CLEAN} LEFT JOIN more USING (t)"""

_POINTS = "SELECT vec_id, i, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y, embedding[3 * i + 3]::DOUBLE AS z FROM embeddings, range(21) r(i)"


def all_statements() -> dict[str, str]:
    from residua.plans.evidence_sql import more_statements

    return _statements() | more_statements()


def _statements() -> dict[str, str]:
    ratios = {"hydrophobic_ratio": HYDROPHOBIC, "charged_ratio": CHARGED, "cysteine_ratio": "C", "aromatic_ratio": AROMATIC}
    shares = ", ".join(f"round({_share(letters)}, 6) AS {name}" for name, letters in ratios.items())
    header = "'db|' || id || '|X ' || coalesce(annotation, '') || coalesce(' OS=' || organism || ' OX=9', '')"
    informative = "|".join(INFORMATIVE_WORDS)
    excluded = "|".join(EXCLUDED_WORDS)
    return {
        "residue_clean": f"{CLEANED} SELECT * FROM cleaned",
        "cleaning_totals": f"""{CLEANED} SELECT count(*) AS records, count(*) FILTER (gaps > 0) AS gapped, sum(gaps)::BIGINT AS gaps, count(*) FILTER (stop_trimmed) AS stops, sum(ambiguous)::BIGINT AS ambiguous,
            count(*) FILTER (length(residues) >= 40 AND length(regexp_replace(residues, '[^ACGTUN]', '', 'g')) >= 0.95 * length(residues)) AS nucleotide, count(problem) AS problems FROM cleaned""",
        "duplicate_ids": "SELECT id, count(*) AS records FROM proteins WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
        "header_parse": f"""WITH h AS (SELECT header_ordinal, {header} AS h FROM reference_headers),
            p AS (SELECT header_ordinal, h, split_part(substr(h, strpos(h, ' ') + 1), ' OS=', 1) AS annotation FROM h)
            SELECT header_ordinal, {accession("h")} AS accession, annotation, CASE WHEN contains(h, ' OS=') THEN split_part(split_part(h, ' OS=', 2), ' OX=', 1) END AS organism,
            CASE WHEN regexp_matches(lower(annotation), 'uncharacterized|hypothetical') THEN 0.10 WHEN regexp_matches(lower(annotation), 'putative|probable') THEN 0.42
              WHEN regexp_matches(lower(annotation), 'domain-containing|duf') THEN 0.30 ELSE 0.62 END::DOUBLE AS confidence,
            NOT regexp_matches(lower(h), '{excluded}') AND regexp_matches(lower(h), '{informative}') AS informative FROM p""",
        "header_index": _LAST,
        "features": f"WITH {FEATURES} SELECT record_ordinal, n AS length, {shares}, round(entropy, 6) AS entropy, round(low_complexity, 6) AS low_complexity, round(membrane_score, 6) AS membrane_score, array_to_string(motifs, '; ') AS motifs FROM featured",
        "scores": f"WITH {SCORES} SELECT record_ordinal, round(novelty, 6) AS novelty, round(confidence, 6) AS confidence, round(machine_load, 6) AS machine_load, round(total, 6) AS total, classification FROM scored",
        "rank_top": f"WITH {SCORES} SELECT row_number() OVER (ORDER BY round(total, 9) DESC, id, record_ordinal) AS rank, id, record_ordinal, round(total, 6) AS total, classification FROM shortlist",
        "validated": f"""WITH {SCORES} SELECT id, record_ordinal, regexp_matches(lower(coalesce(annotation, '')), 'uncharacterized|hypothetical') AND classification LIKE 'Remote %' AND novelty >= 0.85 AND confidence >= 0.65
            AND ident BETWEEN 0.15 AND 0.40 AND bestknownhitannotation IS NOT NULL AND (coalesce(bestknownhitevalue <= 1e-20, false) OR coalesce(bestknownhitsupport >= 0.035, false)) AS qualifies FROM shortlist""",
        "evidence_ranked": f"WITH {SCORES}, e AS ({_evidence()}) SELECT record_ordinal, row_number() OVER (PARTITION BY record_ordinal ORDER BY weight DESC, o)::INT AS place, title, value, round(weight, 6) AS weight FROM e",
        "kmer_counts": f"WITH b AS (SELECT record_ordinal, regexp_replace({CLEAN}, '[^{STANDARD}]', '', 'g') AS q FROM proteins WHERE sequence IS NOT NULL), k AS ({_four('b')}) SELECT record_ordinal, count(w)::INT AS kmers FROM b LEFT JOIN k USING (record_ordinal) GROUP BY 1",
        "seed_search": SEED,
        "cluster_sizes": CLUSTERS,
        "best_hit": f"WITH {BEST_HITS} SELECT * FROM best",
        "enriched": f"""WITH {BEST_HITS}, names AS ({_LAST}) SELECT record_ordinal, p.id, coalesce(target, '{NO_HIT}') AS hit_id, n.annotation AS hit_annotation, n.organism AS hit_organism, bits
            FROM proteins p LEFT JOIN best ON best.query = p.id LEFT JOIN names n ON n.id = target""",
        "hit_lines": "SELECT printf('%s\t%s\t%.4f', queryid, targetid, identity) AS line, count(*) AS n FROM native_hits WHERE queryid IS NOT NULL AND targetid IS NOT NULL AND identity IS NOT NULL AND NOT isnan(identity) GROUP BY 1",
        "latest_model": _MODEL,
        "structure_source": f"WITH m AS ({_MODEL}) SELECT p.record_ordinal, CASE WHEN pdbpath IS NOT NULL THEN 'cache' ELSE 'none' END AS origin, pdbpath AS path FROM proteins p LEFT JOIN m ON m.modelentityid = 'AF-' || p.id || '-F1'",
        "seen_first": _FIRST,
        "seen_new_by_cycle": f"SELECT first_seen_cycle AS cycle, count(*) AS new_records, count(*) FILTER (verdict = 'actionable') AS new_actionable FROM ({_FIRST}) GROUP BY 1",
        "digest_check": "SELECT record_ordinal, d AS digest, d = lower(seq_sha256) AS matches FROM (SELECT *, sha256(upper(regexp_replace(sequence, '\\s+', '', 'g'))) AS d FROM processed WHERE sequence IS NOT NULL AND seq_sha256 IS NOT NULL)",
        "verdict_counts": "SELECT verdict, count(*) AS n FROM processed GROUP BY verdict",
        "cycle_series": """WITH b AS (SELECT greatest(min(first_seen_cycle), max(first_seen_cycle) - 59) AS low, max(first_seen_cycle) AS high FROM processed)
            SELECT c::INT AS cycle, count(record_ordinal) AS n FROM (SELECT unnest(range(low, high + 1)) AS c FROM b) LEFT JOIN processed ON first_seen_cycle = c AND verdict = 'actionable' GROUP BY c""",
        "recent_actionable": "SELECT record_ordinal, accession, first_seen_cycle, score, classification FROM processed WHERE verdict = 'actionable' ORDER BY first_seen_cycle DESC, accession DESC, record_ordinal DESC LIMIT 200",
        "top_by_score": "SELECT record_ordinal, accession, score FROM processed WHERE verdict = 'actionable' ORDER BY score DESC NULLS LAST, accession, record_ordinal LIMIT 32",
        "fasta_lines": f"SELECT record_ordinal, '>' || id || chr(10) || rtrim(regexp_replace({CLEAN}, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) AS entry FROM proteins WHERE sequence IS NOT NULL AND id IS NOT NULL",
        "anchor": f"SELECT record_ordinal, length(regexp_extract(s, '^(.*?)S..K', 1)) + 1 AS anchor, regexp_extract(s, 'S..K') AS motif, len(regexp_extract_all(s, 'S.N')) AS sxn, len(regexp_extract_all(s, 'KTG')) AS ktg FROM (SELECT record_ordinal, {CLEAN} AS s FROM alphafold_cache WHERE sequence IS NOT NULL) WHERE regexp_matches(s, 'S..K')",
        "url_contract": """WITH u AS (SELECT header_ordinal, id, 'https://' || CASE WHEN header_ordinal % 11 = 0 THEN 'u:p@' ELSE '' END || 'rest.example.org' || CASE header_ordinal % 13 WHEN 0 THEN ':443' WHEN 1 THEN ':8443' ELSE '' END
              || '/search?query=' || CASE WHEN header_ordinal % 17 = 0 THEN 'other' ELSE coalesce(id, '') END || '&format=fasta&size=' || header_ordinal % 700
              || CASE header_ordinal % 5 WHEN 0 THEN '' WHEN 1 THEN '&cursor=a' WHEN 2 THEN '&cursor=a&cursor=b' WHEN 3 THEN '&other=1' ELSE '#x' END AS url FROM reference_headers),
            p AS (SELECT *, list_transform(string_split(string_split(url, '?')[2], '&'), lambda x: string_split(x, '=')) AS params, string_split(string_split(url, '?')[1], '/')[3] AS authority FROM u)
            SELECT header_ordinal, authority IN ('rest.example.org', 'rest.example.org:443') AND NOT contains(url, '#')
              AND len(list_filter(params, lambda x: x[1] NOT IN ('query', 'format', 'size', 'cursor'))) = 0 AND len(list_filter(params, lambda x: x[1] = 'cursor')) <= 1
              AND list_filter(params, lambda x: x[1] = 'query')[1][2] = id AND list_filter(params, lambda x: x[1] = 'format')[1][2] = 'fasta'
              AND coalesce(TRY_CAST(list_filter(params, lambda x: x[1] = 'size')[1][2] AS INT) BETWEEN 1 AND 500, false) AS approved FROM p WHERE id IS NOT NULL""",
        "memory_estimate": f"SELECT record_ordinal, 5368709120 + 800 * length({CLEAN})::BIGINT * length({CLEAN}) AS bytes, 5368709120 + 800 * length({CLEAN})::BIGINT * length({CLEAN}) <= 17179869184 AS fits FROM proteins WHERE sequence IS NOT NULL",
        "thread_split": """WITH a AS (SELECT plan_id, source, target_share, round(target_share * (100 - count(*) OVER p) / sum(target_share) OVER p, 9) AS exact, 100 - count(*) OVER p AS spare FROM mix_targets WINDOW p AS (PARTITION BY plan_id)),
            b AS (SELECT *, floor(exact) AS f, spare - sum(floor(exact)) OVER (PARTITION BY plan_id) AS over, row_number() OVER (PARTITION BY plan_id ORDER BY round(exact - floor(exact), 9) DESC, target_share DESC, source DESC) AS r FROM a)
            SELECT plan_id, source, (1 + f + CASE WHEN r <= over THEN 1 ELSE 0 END)::BIGINT AS units FROM b""",
        "file_names": "SELECT header_ordinal, left(regexp_replace(concat_ws(' ', id, annotation), '[^A-Za-z0-9_.-]+', '_', 'g'), 160) AS name FROM reference_headers",
        "distance_map": f"""WITH p AS ({_POINTS}), d AS (SELECT a.vec_id, a.i, b.i AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.i < b.i)
            SELECT q.vec_id AS pair, 21::BIGINT AS points, round(avg(exp(-abs(q.d - t.d) / 6.0::DOUBLE)), 6) AS score FROM d q JOIN d t ON t.vec_id = q.vec_id + 1 AND t.i = q.i AND t.j = q.j GROUP BY 1""",
    }
