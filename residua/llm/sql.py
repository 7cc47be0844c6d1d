"""The same problems as SQL, where SQL can state them and is fast enough on whole tables."""

from __future__ import annotations


def _accession(column: str) -> str:
    token = f"split_part(ltrim({column}, ' '), ' ', 1)"
    pieces = f"list_filter(string_split({token}, '|'), lambda x: x <> '')"
    return f"CASE WHEN len({pieces}) >= 2 THEN {pieces}[2] ELSE {token} END"


_HITS = f"""
hits AS (
  SELECT 'mmseqs' AS search, {_accession("queryid")} AS q, {_accession("targetid")} AS t, bitscore AS score
  FROM mmseqs_hits WHERE queryid IS NOT NULL AND targetid IS NOT NULL
  UNION ALL
  SELECT 'native', {_accession("queryid")}, {_accession("targetid")}, supportscore
  FROM native_hits WHERE queryid IS NOT NULL AND targetid IS NOT NULL
)"""

P2 = f"""
WITH {_HITS},
best AS (SELECT search, q, t, max(score) AS score FROM hits
         WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY search, q, t),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search, q ORDER BY score DESC, t) AS r FROM best)
SELECT search, q AS queryid, t AS targetid FROM ranked WHERE r <= 5"""

P3 = f"""
WITH RECURSIVE {_HITS},
edges AS (SELECT q AS a, t AS b FROM hits UNION SELECT t, q FROM hits),
reached(a, low) USING KEY (a) AS (
  SELECT a, least(a, min(b)) FROM edges GROUP BY a
  UNION
  SELECT e.a, min(r.low) FROM edges e JOIN reached r ON e.b = r.a
  JOIN recurring.reached own ON own.a = e.a
  GROUP BY e.a, own.low HAVING min(r.low) < own.low
)
SELECT a AS accession, low AS group_accession FROM reached"""


_CLEAN = "regexp_replace(regexp_replace(upper(sequence), '[\\s0-9.~-]', '', 'g'), '\\*$', '')"


def _windows(source: str) -> str:
    """Distinct 5-letter windows of each distinct text of ``source`` (column s), and how many it has."""
    return f"""
texts AS (SELECT s, row_number() OVER () AS t FROM (SELECT DISTINCT s FROM {source} WHERE length(s) >= 5)),
windows AS (SELECT DISTINCT t, substr(s, i, 5) AS w
            FROM (SELECT t, s, unnest(range(1, length(s) - 3)) AS i FROM texts)),
sizes AS (SELECT t, count(*) AS n FROM windows GROUP BY t),
shared AS (SELECT x.t AS a, y.t AS b, count(*) AS c FROM windows x JOIN windows y USING (w) WHERE x.t < y.t GROUP BY 1, 2),
near AS (SELECT a, b FROM shared JOIN sizes p ON p.t = a JOIN sizes q ON q.t = b WHERE 2 * c >= p.n + q.n - c
         UNION ALL SELECT b, a FROM shared JOIN sizes p ON p.t = a JOIN sizes q ON q.t = b WHERE 2 * c >= p.n + q.n - c
         UNION ALL SELECT t, t FROM texts)"""


P1 = f"""
WITH seqs AS (SELECT record_ordinal AS id, first_seen_cycle AS c, lower(seq_sha256) AS h, {_CLEAN} AS s FROM processed),
{_windows("seqs")},
firsts AS (SELECT t, min(c) AS c FROM seqs JOIN texts USING (s) GROUP BY t),
earliest AS (SELECT a AS t, min(c) AS c FROM near JOIN firsts ON b = t GROUP BY a),
digests AS (SELECT h, min(c) AS c FROM seqs GROUP BY h)
SELECT id AS record_ordinal FROM seqs
LEFT JOIN digests USING (h) LEFT JOIN texts USING (s) LEFT JOIN earliest USING (t)
WHERE seqs.c > digests.c OR seqs.c > earliest.c"""

_SPANS = f"""
seqs AS (SELECT record_ordinal AS id, {_CLEAN} AS s FROM processed
         UNION ALL SELECT record_ordinal, {_CLEAN} FROM alphafold_cache),
windows AS (SELECT id, i, substr(s, i, 40) AS w FROM (SELECT id, s, unnest(range(1, length(s) - 38)) AS i FROM seqs WHERE length(s) >= 40)),
repeated AS (SELECT w FROM windows GROUP BY w HAVING min(id) <> max(id)),
places AS (SELECT DISTINCT id, i FROM windows JOIN repeated USING (w)),
marked AS (SELECT id, i, CASE WHEN i > lag(i) OVER (PARTITION BY id ORDER BY i) + 40 THEN 1 ELSE 0 END AS jump FROM places),
runs AS (SELECT id, i, sum(jump) OVER (PARTITION BY id ORDER BY i) AS run FROM marked),
spans AS (SELECT id, min(i) AS span_start, max(i) + 39 AS span_end FROM runs GROUP BY id, run)"""

P4 = f"WITH {_SPANS} SELECT id AS record_ordinal, span_start, span_end FROM spans"

P4_SHARE = f"""
WITH {_SPANS}
SELECT id AS record_ordinal, length(any_value(s)) AS letters, sum(span_end - span_start + 1)::BIGINT AS shared,
       sum(span_end - span_start + 1) / length(any_value(s)) AS share
FROM spans JOIN seqs USING (id) GROUP BY id"""

P5 = f"""
WITH seqs AS (SELECT record_ordinal AS id, {_CLEAN} AS s FROM processed
              UNION ALL SELECT record_ordinal, {_CLEAN} FROM proteins),
{_windows("seqs")},
placed AS (SELECT id, t FROM seqs JOIN texts USING (s))
SELECT x.id AS record_ordinal_a, y.id AS record_ordinal_b
FROM placed x JOIN near ON x.t = near.a JOIN placed y ON y.t = near.b WHERE x.id < y.id"""

P5_GROUPS = f"""
WITH RECURSIVE seqs AS (SELECT record_ordinal AS id, {_CLEAN} AS s FROM processed
              UNION ALL SELECT record_ordinal, {_CLEAN} FROM proteins),
{_windows("seqs")},
placed AS (SELECT id, t FROM seqs JOIN texts USING (s)),
named AS (SELECT t, min(id) AS rep, count(*) AS copies FROM placed GROUP BY t),
edges AS (SELECT x.rep AS a, y.rep AS b FROM near JOIN named x ON x.t = near.a JOIN named y ON y.t = near.b),
reached(a, low) USING KEY (a) AS (
  SELECT a, least(a, min(b)) FROM edges GROUP BY a
  UNION
  SELECT e.a, min(r.low) FROM edges e JOIN reached r ON e.b = r.a
  JOIN recurring.reached own ON own.a = e.a
  GROUP BY e.a, own.low HAVING min(r.low) < own.low
)
SELECT p.id AS record_ordinal, n.rep AS representative, n.copies,
       (SELECT count(*) FROM edges WHERE edges.a = n.rep AND edges.b <> n.rep) AS links, r.low AS group_ordinal
FROM placed p JOIN named n USING (t) JOIN reached r ON r.a = n.rep"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p2_found": P2, "p3_found": P3, "p4_found": P4, "p4_share": P4_SHARE, "p5_found": P5, "p5_groups": P5_GROUPS}
