"""SQL of the queries in ``evidence``, with every constant written out."""

from __future__ import annotations

from residua.plans import statements as st

CLEAN, accession = st.CLEAN, st.accession
_PLAIN = "CASE WHEN {0} IS NULL OR isnan({0}) THEN 0 ELSE {0} END"


def more_statements() -> dict[str, str]:
    informative, excluded = "|".join(st.INFORMATIVE_WORDS), "|".join(st.EXCLUDED_WORDS)
    domains = f"""hits AS (SELECT {accession("queryid")} AS hq, {accession("targetid")} AS ht, max(bitscore) AS bits FROM mmseqs_hits
        WHERE queryid IS NOT NULL AND targetid IS NOT NULL AND bitscore IS NOT NULL AND NOT isnan(bitscore) GROUP BY 1, 2)"""
    stages = f"""jobs AS (SELECT accession, CASE first_seen_cycle % 3 WHEN 0 THEN 'esmfold' WHEN 1 THEN 'openmm' ELSE 'vina' END AS backend, CASE WHEN score IS NULL THEN 'failed' ELSE 'ok' END AS status,
        classification AS metrics, record_ordinal AS ordinal, coalesce(length({CLEAN}), 0)::BIGINT AS n FROM processed WHERE accession IS NOT NULL AND first_seen_cycle IS NOT NULL)"""
    gib = "1073741824::BIGINT"
    memory = f"""CASE b WHEN 'esmfold' THEN 5 * {gib} + 800 * n * n WHEN 'openmm' THEN 3 * {gib} // 2 WHEN 'vina' THEN 3 * {gib} // 4 WHEN 'mmseqs' THEN {gib} WHEN 'foldseek' THEN {gib} ELSE {gib} // 2 END"""
    plain = f"regexp_replace(upper(coalesce(sequence, '')), '\\s+', '', 'g')"
    return {
        "fasta_parsed": f"""WITH p AS (SELECT record_ordinal, id, {CLEAN} AS s FROM proteins WHERE sequence IS NOT NULL AND id IS NOT NULL)
            SELECT record_ordinal, 0::INT AS part, {accession("id")} AS accession, 'Some' AS organism, s AS residues, 1::INT AS gaps, false AS stop_trimmed FROM p
            UNION ALL SELECT record_ordinal, 1::INT, 'second', NULL, 'ACD', 0::INT, true FROM p""",
        "subset_reference": f"SELECT header_ordinal, id FROM reference_headers WHERE NOT regexp_matches(lower(concat_ws(' ', id, annotation)), '{excluded}') AND regexp_matches(lower(concat_ws(' ', id, annotation)), '{informative}')",
        "native_applied": f"""WITH hits AS (SELECT {accession("queryid")} AS q, {accession("targetid")} AS t, supportscore AS s, {_PLAIN.format("identity")} AS i, coalesce(alignmentscore, 0) AS b
              FROM native_hits WHERE queryid IS NOT NULL AND targetid IS NOT NULL AND supportscore IS NOT NULL AND NOT isnan(supportscore)),
            best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, t, i, b) = 1), names AS ({st._LAST})
            SELECT record_ordinal, p.id, coalesce(t, 'no native reference hit') AS hit_id, n.annotation AS hit_annotation, n.organism AS hit_organism, round(coalesce(i, 0), 6) AS identity, b::DOUBLE AS bits,
              'native-swift' AS method, round(s, 6) AS support FROM proteins p LEFT JOIN best ON q = p.id LEFT JOIN names n ON n.id = t""",
        "mmseqs_applied": f"""WITH hits AS (SELECT {accession("queryid")} AS q, {accession("targetid")} AS t, {_PLAIN.format("bitscore")} AS b, {_PLAIN.format("evalue")} AS e, {_PLAIN.format("identity")} AS i
              FROM mmseqs_hits WHERE queryid IS NOT NULL AND targetid IS NOT NULL),
            best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY q ORDER BY b DESC, t, e, i) = 1)
            SELECT record_ordinal, id, coalesce(t, 'no Swiss-Prot hit') AS hit_id, round(coalesce(i, 0), 6) AS identity, e AS evalue, b AS bits, CASE WHEN t IS NOT NULL THEN 'mmseqs2' END AS method FROM proteins LEFT JOIN best ON q = id""",
        "domain_evidence": f"WITH {st.SCORES}, {domains} SELECT record_ordinal, 'domain' AS kind, 0::DOUBLE AS weight, true AS titled, printf('%.1f', max(bits)) AS bits FROM shortlist JOIN hits ON hq = id GROUP BY record_ordinal",
        "domain_totals": f"WITH {st.SCORES}, {domains} SELECT record_ordinal, count(hq) AS domains, least(count(hq), 3) AS shown FROM shortlist LEFT JOIN hits ON hq = id GROUP BY record_ordinal",
        "evidence_shown": f"WITH {st.SCORES}, e AS ({st._evidence()}) SELECT record_ordinal, row_number() OVER (PARTITION BY record_ordinal ORDER BY weight DESC, o)::INT AS place, title FROM e QUALIFY place <= 8",
        "selected_candidate": f"WITH {st.SCORES} SELECT record_ordinal, id, classification, bestknownhitid AS hit_id FROM shortlist WHERE classification LIKE 'Remote %' AND NOT contains(bestknownhitid, 'no ') ORDER BY round(total, 9) DESC, id, record_ordinal LIMIT 1",
        "payload_check": f"""SELECT record_ordinal, CASE WHEN trim(coalesce(accession, '')) = '' THEN 'accession' WHEN NOT regexp_full_match({plain}, '[A-Z]+') THEN 'sequence'
            WHEN lower(trim(coalesce(seq_sha256, ''))) <> sha256({plain}) THEN 'digest' END AS problem FROM processed""",
        "exactly_one": "SELECT accession, min(record_ordinal) AS record_ordinal FROM processed WHERE accession IS NOT NULL GROUP BY accession HAVING count(*) = 1",
        "subset_gate": """SELECT plan_id, count(*) FILTER (m) AS missing, count(*) FILTER (m) = 0 AS opens FROM (SELECT DISTINCT plan_id, source, source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) AS m FROM mix_targets) GROUP BY plan_id""",
        "ledger_enriched": """WITH l AS (SELECT accession, verdict, score, classification FROM processed WHERE accession IS NOT NULL QUALIFY row_number() OVER (PARTITION BY accession ORDER BY record_ordinal DESC) = 1)
            SELECT record_ordinal, coalesce(verdict, 'screened') AS verdict, score, classification FROM proteins LEFT JOIN l ON accession = id""",
        "stage_evidence": f"""WITH {stages}, firsts AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY accession, backend ORDER BY ordinal) = 1),
            models AS (SELECT regexp_extract(modelentityid, '^AF-(.*)-F1$', 1) AS accession, CASE WHEN max(CASE WHEN isnan(globalmetricvalue) THEN 0 ELSE globalmetricvalue END) >= 90 THEN 'local-folding-backend' ELSE 'alphafold-cache' END AS source
              FROM alphafold_cache WHERE regexp_matches(modelentityid, '^AF-.+-F1$') GROUP BY 1),
            wide AS (SELECT j.accession, any_value(m.source) AS source, max(status) FILTER (backend = 'esmfold') AS fold, max(status) FILTER (backend = 'openmm') AS relax, max(status) FILTER (backend = 'vina') AS dock,
              coalesce(bool_or(status = 'ok' AND metrics IS NOT NULL) FILTER (backend = 'openmm'), false) AS r, coalesce(bool_or(status = 'ok' AND metrics IS NOT NULL) FILTER (backend = 'vina'), false) AS d
              FROM firsts j LEFT JOIN models m USING (accession) GROUP BY j.accession)
            SELECT accession, source, fold, relax, dock, round(CASE source WHEN 'local-folding-backend' THEN 0.20 WHEN 'alphafold-cache' THEN 0.10 ELSE 0 END + CASE WHEN r THEN 0.30 ELSE 0 END + CASE WHEN d THEN 0.35 ELSE 0 END
              + CASE WHEN r AND d THEN 0.15 ELSE 0 END, 3)::DOUBLE AS realized_compute_value FROM wide""",
        "queue_counts": f"WITH {stages} SELECT count(*) FILTER (status = 'ok') AS ran, count(*) FILTER (status <> 'ok') AS failed, max({memory}) AS peak_memory FROM (SELECT *, backend AS b FROM jobs)",
        "backend_memory": f"SELECT record_ordinal, b AS backend, {memory} AS bytes FROM (SELECT record_ordinal, length({CLEAN})::BIGINT AS n, unnest(['mmseqs', 'hmmer', 'foldseek', 'vina', 'esmfold', 'openmm', 'another']) AS b FROM proteins WHERE sequence IS NOT NULL)",
        "model_confidence": """WITH a AS (SELECT modelentityid, CASE WHEN latestversion % 2 = 0 THEN globalmetricvalue / 100 ELSE globalmetricvalue END AS c FROM alphafold_cache WHERE modelentityid IS NOT NULL AND globalmetricvalue IS NOT NULL AND NOT isnan(globalmetricvalue)),
            b AS (SELECT modelentityid, CASE WHEN max(c) OVER (PARTITION BY modelentityid) <= 1.5 THEN c * 100 ELSE c END AS c FROM a)
            SELECT modelentityid, round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS greatest FROM b GROUP BY 1""",
        "newest_model": """SELECT modelentityid, pdbpath, record_ordinal FROM alphafold_cache WHERE modelentityid IS NOT NULL AND modelcreateddate IS NOT NULL AND pdbpath IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY modelentityid ORDER BY modelcreateddate DESC, pdbpath DESC, record_ordinal DESC) = 1""",
        "first_reasons": "SELECT verdict, classification, min(record_ordinal) AS first FROM processed GROUP BY 1, 2 ORDER BY 3 LIMIT 12",
        "new_actionable": """SELECT record_ordinal, first_seen_cycle, accession, lower(seq_sha256) AS digest, sequence IS NOT NULL AS exportable FROM (SELECT * FROM processed WHERE seq_sha256 IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY lower(seq_sha256) ORDER BY record_ordinal) = 1) WHERE verdict = 'actionable'""",
        "iso_stamp": "SELECT record_ordinal, strftime(modelcreateddate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM alphafold_cache WHERE modelcreateddate IS NOT NULL",
        "json_defaults": "SELECT header_ordinal, id, annotation, organism, 0::BIGINT AS domains FROM reference_headers",
        "structure_pairs": f"""WITH a AS (SELECT record_ordinal AS r, {CLEAN} AS s FROM alphafold_cache WHERE sequence IS NOT NULL), ok AS (SELECT * FROM a WHERE length(s) >= 2),
            p AS (SELECT q.r AS pair, q.s AS q, t.s AS t, least(length(q.s), length(t.s)) AS n FROM ok q JOIN ok t ON t.r = q.r + 1 WHERE q.r % 50 = 0),
            k AS (SELECT pair, q, t, n, unnest(range(n)) AS i FROM p),
            g AS (SELECT pair, i, i * 1.5::DOUBLE AS x, ascii(substr(q, i + 1, 1)) % 7 AS qy, ascii(substr(q, i + 1, 1)) % 5 AS qz, ascii(substr(t, i + 1, 1)) % 7 AS ty, ascii(substr(t, i + 1, 1)) % 5 AS tz FROM k WHERE i % greatest(1, n // 180) = 0),
            d AS (SELECT a.pair, avg(exp(-abs(sqrt((a.x - b.x) ** 2 + (a.qy - b.qy) ** 2 + (a.qz - b.qz) ** 2) - sqrt((a.x - b.x) ** 2 + (a.ty - b.ty) ** 2 + (a.tz - b.tz) ** 2)) / 6.0::DOUBLE)) AS score FROM g a JOIN g b ON a.pair = b.pair AND a.i < b.i GROUP BY 1)
            SELECT pair, n AS points, round(score, 6) AS score, 1::DOUBLE AS coverage, n >= 180 AND score >= 0.45 AS passed FROM p JOIN d USING (pair)""",
        "seed_candidates": f"""WITH asked AS (SELECT record_ordinal, regexp_replace({CLEAN}, '[^{st.STANDARD}]', '', 'g') AS q, {CLEAN} AS residues FROM proteins WHERE sequence IS NOT NULL AND record_ordinal % 50 = 0),
            known AS (SELECT record_ordinal, regexp_replace({CLEAN}, '[^{st.STANDARD}]', '', 'g') AS q, {CLEAN} AS residues FROM alphafold_cache WHERE sequence IS NOT NULL), qw AS ({st._four("asked")}), tw AS ({st._four("known")}),
            nq AS (SELECT record_ordinal, count(*) AS n FROM qw GROUP BY 1), nt AS (SELECT record_ordinal, count(*) AS n FROM tw GROUP BY 1),
            shared AS (SELECT x.record_ordinal AS query, y.record_ordinal AS target, count(*) AS shared FROM qw x JOIN tw y USING (w) GROUP BY 1, 2),
            s AS (SELECT query, target, shared, shared / least(greatest(nq.n, 1), nt.n) AS support, least(greatest(length(a.residues), 1), length(k.residues)) / greatest(greatest(length(a.residues), 1), length(k.residues)) AS part
              FROM shared JOIN nq ON nq.record_ordinal = query JOIN nt ON nt.record_ordinal = target JOIN asked a ON a.record_ordinal = query JOIN known k ON k.record_ordinal = target)
            SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(support * (0.40::DOUBLE + 0.60::DOUBLE * part), 12) DESC, shared DESC, target) AS place, target, shared, round(support, 6) AS support
            FROM s WHERE support >= 0.025 OR shared >= 18 QUALIFY place <= 3""",
        "hypotheses": f"WITH {st.SCORES} SELECT record_ordinal, true AS said, true AS named FROM shortlist",
        "cycle_ranks": "SELECT record_ordinal, first_seen_cycle, row_number() OVER (PARTITION BY first_seen_cycle ORDER BY score DESC NULLS LAST, accession, record_ordinal) AS place FROM processed WHERE verdict = 'actionable'",
    }
