"""SQL equivalents of the queries in `runs`, over the same tables."""

from __future__ import annotations

from siteledger.functions.rules import REGION_TERMS
from siteledger.plans.oracle import _IMPACT, _NOW, _ROBOTS, _RULES, _SNAP, _SYNC, _UNITS
from siteledger.sources import views as v

_FIELD = "'Falta el campo requerido \"%s\" para el tipo %s'"
_BAD = "'El bloque JSON-LD no es JSON válido'"
_JSON_LD = f"""p AS (SELECT url, page_id % 8 AS n FROM pages), ld AS (
  SELECT url, 'none' AS schema_type, false AS is_valid, CASE n WHEN 6 THEN 'No se pudo obtener la página: status 500' ELSE 'No se encontró ningún bloque JSON-LD en la página' END AS errors FROM p WHERE n IN (0, 6)
  UNION ALL SELECT url, 'Article', n = 1, CASE n WHEN 2 THEN {_FIELD % ('headline', 'Article')} || '|' || {_FIELD % ('author', 'Article')} ELSE '' END FROM p WHERE n IN (1, 2)
  UNION ALL SELECT url, 'Organization', false, {_FIELD % ('url', 'Organization')} FROM p WHERE n = 3
  UNION ALL SELECT url, 'WebSite', true, '' FROM p WHERE n = 3
  UNION ALL SELECT url, 'invalid-json', false, {_BAD} FROM p WHERE n IN (3, 4)
  UNION ALL SELECT url, 'Thing', true, '' FROM p WHERE n = 5
  UNION ALL SELECT url, 'DefinedTermSet', false, {_FIELD % ('name', 'DefinedTermSet')} FROM p WHERE n = 7
  UNION ALL SELECT url, 'Dataset', true, '' FROM p WHERE n = 7
), ld_found AS (
  SELECT url, finding_type, CASE finding_type WHEN 'structured-data-missing' THEN 'Sin datos estructurados en ' || url WHEN 'structured-data-invalid-json' THEN 'JSON-LD inválido en ' || url
                             ELSE 'Campos requeridos faltantes en el schema ' || schema_type || ' de ' || url END AS title,
         finding_type || ':' || url || CASE finding_type WHEN 'structured-data-missing-field' THEN ':' || schema_type ELSE '' END AS k, CAST(to_json(string_split(errors, '|')) AS VARCHAR) AS detail
  FROM (SELECT *, CASE schema_type WHEN 'none' THEN 'structured-data-missing' WHEN 'invalid-json' THEN 'structured-data-invalid-json' ELSE 'structured-data-missing-field' END AS finding_type FROM ld WHERE NOT is_valid)
)"""

_CONTENT_TITLES = """titles AS (
  SELECT 'content-declining' AS finding_type, 'content-declining:' || page AS k, page AS ref, page || ' ha bajado un ' || printf('%.0f', round(decline * 100, 0)) || '% en clics (' || prior_clicks || ' → ' || recent_clicks || ')' AS title FROM now_decline
  UNION ALL SELECT 'content-cannibalization', 'content-cannibalization:' || query, query, '"' || query || '" recibe impresiones desde ' || n_pages || ' páginas distintas: ' || replace(pages, ',', ', ') FROM now_compete
  UNION ALL SELECT 'content-query-gap', 'content-query-gap:' || page || ':' || query, page || ':' || query, '"' || query || '" tiene ' || impressions || ' impresiones pero posición ' || printf('%.1f', round(position, 1)) || ' en ' || page FROM now_gap
)"""


def _shown(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


_SPEED = f"""speed AS ({v.PERFORMANCE_AUDIT}), slow AS (
  SELECT id, url, run_no, 'performance-lcp-red' AS finding_type, 'LCP en rojo (' || {_shown('lcp')} || 's) en ' || url AS title FROM speed WHERE lcp > 4
  UNION ALL SELECT id, url, run_no, 'performance-cls-red', 'CLS en rojo (' || {_shown('cls')} || ') en ' || url FROM speed WHERE cls > 0.25
  UNION ALL SELECT id, url, run_no, 'performance-inp-red', 'INP en rojo (' || {_shown('inp')} || 'ms) en ' || url FROM speed WHERE inp > 500
  UNION ALL SELECT id, url, run_no, 'performance-low-score', 'Puntuación PageSpeed baja (' || performance_score || ') en ' || url FROM speed WHERE performance_score < 50
)"""

_NAMES = "[" + ", ".join(f"'{t}'" for t in REGION_TERMS) + "]"
_GAP = f"""terms AS (SELECT unnest({_NAMES}) AS term), places AS (
  SELECT date, impressions, {_NAMES}[1 + (CAST(regexp_extract(query, '([0-9]+)$', 1) AS INT) + 3 * CAST(regexp_extract(page, '([0-9]+)$', 1) AS INT)) % {len(REGION_TERMS)}] AS place FROM snap
), region_gap AS (
  SELECT term, CAST(sum(impressions) AS BIGINT) AS impressions FROM places JOIN terms ON contains('boda en ' || place, term)
  WHERE date >= DATE '2024-01-30' - 90 AND NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id % 4 = 0 AND contains('bodas-' || {_NAMES}[1 + CAST(vec_id % 12 AS INT)], term))
  GROUP BY term HAVING sum(impressions) >= 500
)"""

_UNIT_TABLES = _UNITS.removeprefix("WITH ")
_ARCHITECTURE = f"""{_NOW}, {_CONTENT_TITLES}, {_GAP}, {_UNIT_TABLES}, {_SPEED}, arch AS (
  SELECT 'site-architecture-template-performance' AS finding_type, url AS k, 'Rendimiento consistentemente bajo en ' || url || ' (últimas puntuaciones: ' || string_agg(CAST(performance_score AS VARCHAR), ', ' ORDER BY run_no, id) || ')' AS title
  FROM speed GROUP BY url HAVING count(performance_score) >= 3 AND max(performance_score) < 50
  UNION ALL SELECT 'site-architecture-near-duplicate', source_slug || ':' || target_slug, 'Posible contenido casi duplicado: ' || source_slug || ' / ' || target_slug || ' (similitud ' || printf('%.2f', round(s, 2)) || ')' FROM pairs WHERE source_slug < target_slug AND s >= 0.4
  UNION ALL SELECT 'site-architecture-missing-template', term, '"' || term || '" tiene ' || impressions || ' impresiones sin página provincial dedicada' FROM region_gap
), keyed AS (SELECT sha256('siteArchitecture:' || finding_type || ':' || k) AS stable_key, finding_type, title FROM arch)"""

_CAPPED = f"""WITH l AS ({v.TIER_LEDGER}), c AS ({v.TIER_CHANGES}), t AS (
  SELECT stable_key, finding_type, priority_score,
         CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.status = 'open' AND c.stable_key = l.stable_key) THEN 'skippedDuplicate' WHEN finding_type = 'robots-blocks-all' THEN 'skippedNoFixer' ELSE 'open' END AS action
  FROM l WHERE status = 'open' AND starts_with(finding_type, 'robots-')
), plan AS (
  SELECT * FROM (SELECT *, count(*) FILTER (action = 'open') OVER (ORDER BY priority_score DESC, stable_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM t) WHERE opened < 3
)"""

_NEWEST = """SELECT workflow, run_on, CASE WHEN bool_or(outcome = 'failure') THEN 'failed' ELSE 'ok' END AS status, count(*) FILTER (outcome = 'failure') AS failed_steps
  FROM w WHERE %s AND run_on = (SELECT max(x.run_on) FROM w x WHERE x.workflow = w.workflow AND %s) GROUP BY workflow, run_on"""
_EARLY, _REST = (_NEWEST % (f"run_on {op} DATE '2024-01-15'", f"x.run_on {op} DATE '2024-01-15'") for op in ("<", ">="))

_NEGATIVE = "outcome = 'negative'"
_BODY = "'El cambio https://code.example/pr/' || change_id || ' (findingType: ' || finding_type || ')'"

ORACLE_SQL: dict[str, str] = {
    "json_ld_audit": f"WITH {_JSON_LD} SELECT * FROM ld",
    "json_ld_findings": f"WITH {_JSON_LD} SELECT finding_type, sha256('structuredData:' || k) AS stable_key, title, detail FROM ld_found",
    "finding_titles": f"""{_NOW}, {_CONTENT_TITLES}, {_SPEED}, {_ROBOTS.removeprefix('WITH ')}
        SELECT 'content' AS source, finding_type, k AS stable_key_input, title, ref AS source_ref_id FROM titles
        UNION ALL SELECT 'performance', finding_type, finding_type || ':' || url, title, id FROM slow
        UNION ALL SELECT 'robots', 'robots-fetch-failed', 'robots-fetch-failed', 'No se pudo obtener robots.txt', site FROM marked WHERE fetch_error IS NOT NULL
        UNION ALL SELECT 'robots', 'robots-missing-sitemap-directive', 'robots-missing-sitemap-directive', 'robots.txt no declara ninguna directiva Sitemap', site FROM marked WHERE no_map
        UNION ALL SELECT 'robots', 'robots-blocks-all', 'robots-blocks-all', 'robots.txt bloquea la indexación de todo el sitio', site FROM marked WHERE blocks""",
    "other_findings": """SELECT s AS source, s || '-other' AS finding_type, 'odd ' || source AS stable_key_input, 'odd ' || source AS title, 'odd ' || source AS detail, CAST(doc_id AS VARCHAR) AS source_ref_id
        FROM documents, (VALUES ('sitemap'), ('robots')) t(s)""",
    "daily_findings": f"""{_NOW}, {_JSON_LD}, {_UNIT_TABLES}, {_SPEED}, {_ROBOTS.removeprefix('WITH ')},
        site AS (SELECT min(CAST(n AS VARCHAR)) AS id FROM (SELECT DISTINCT o_orderkey % 40 AS n FROM orders) WHERE n % 5 = (SELECT min(o_orderkey % 40 % 5) FROM orders)),
        bot AS (SELECT * FROM marked WHERE (CAST(site AS BIGINT) + 2) % 7 = 0 ORDER BY site LIMIT 1), found AS (
          SELECT 'sitemap' AS source, 'sitemap-out-of-domain' AS finding_type, 'URL fuera de dominio en el sitemap: ' || id AS k FROM site
          UNION ALL SELECT 'sitemap', 'sitemap-stale-entries', 'sitemap-stale-entries' FROM site
          UNION ALL SELECT 'robots', 'robots-fetch-failed', 'robots-fetch-failed' FROM bot WHERE fetch_error IS NOT NULL
          UNION ALL SELECT 'robots', 'robots-missing-sitemap-directive', 'robots-missing-sitemap-directive' FROM bot WHERE no_map UNION ALL SELECT 'robots', 'robots-blocks-all', 'robots-blocks-all' FROM bot WHERE blocks
          UNION ALL SELECT 'structuredData', finding_type, k FROM ld_found WHERE length(url) % 3 = (SELECT min(length(url) % 3) FROM pages)
          UNION ALL SELECT 'performance', finding_type, finding_type || ':' || url FROM slow WHERE run_no = (SELECT max(run_no) FROM speed)
          UNION ALL SELECT 'internalLinking', 'internal-link-suggestion', 'internal-link:' || source_slug || ':' || target_slug FROM suggested
        ), keyed AS (SELECT DISTINCT source, finding_type, sha256(source || ':' || k) AS stable_key FROM found UNION ALL SELECT 'content', finding_type, stable_key FROM now_found)
        SELECT source, finding_type, stable_key, tier, round(CAST(impact AS DOUBLE) / effort, 6) AS priority_score FROM keyed JOIN ({_RULES}) rules USING (finding_type)""",
    "reopened_ledger": f"""{_SYNC} SELECT stable_key, CASE action WHEN 'created' THEN 'resolved' ELSE 'open' END AS status, CASE action WHEN 'created' THEN 'resolved' WHEN 'resolved' THEN 'reopened' ELSE 'updated' END AS action,
        first_detected_at, CASE action WHEN 'created' THEN TIMESTAMP '2024-02-06' END AS resolved_at FROM merged""",
    "reopened_counts": f"{_SYNC} SELECT CAST(0 AS BIGINT) AS created, count(*) FILTER (action = 'resolved') AS reopened, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'created') AS resolved FROM merged",
    "architecture_sync": f"""{_ARCHITECTURE}
        SELECT stable_key, 'siteArchitecture' AS source, finding_type, title, CASE WHEN ascii(stable_key) % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN ascii(stable_key) % 3 = 0 THEN 'resolved' ELSE 'updated' END AS action FROM keyed
        UNION ALL SELECT sha256('content:' || k), 'content', finding_type, title, 'open', 'kept' FROM titles""",
    "region_term_gap": f"{_SNAP}, {_GAP} SELECT * FROM region_gap",
    "closest_pairs": f"{_UNITS} SELECT source_slug AS slug_a, target_slug AS slug_b, round(s, 6) AS similarity FROM pairs WHERE source_slug < target_slug AND s >= 0.4 ORDER BY round(s, 9) DESC, source_slug, target_slug LIMIT 10",
    "link_impact": f"""WITH change AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'internal-link-suggestion' ELSE finding_type END AS kind FROM ({v.APPLIED_CHANGE}) WHERE status = 'merged' AND merged_on <= DATE '2002-01-31' - 14),
        clicks AS ({v.DAILY_CLICKS}), per_day AS (SELECT day, sum(clicks) AS clicks FROM clicks GROUP BY day), met AS (
          SELECT c.id, c.kind, c.merged_on, d.day, d.clicks FROM change c LEFT JOIN per_day d ON d.day >= c.merged_on - 14 AND d.day < c.merged_on + 14 WHERE id % 3 <> 0
          UNION ALL SELECT c.id, c.kind, c.merged_on, d.day, d.clicks FROM change c LEFT JOIN clicks d ON d.page = c.page AND d.day >= c.merged_on - 14 AND d.day < c.merged_on + 14 WHERE id % 3 = 0 AND id % 5 <> 0
        ), sums AS (
          SELECT id, kind, merged_on, CAST(coalesce(sum(clicks) FILTER (day < merged_on), 0) AS BIGINT) AS before, CAST(coalesce(sum(clicks) FILTER (day >= merged_on), 0) AS BIGINT) AS after FROM met GROUP BY ALL
        ) SELECT id AS change_id, kind AS finding_type, merged_on, before, after, CASE WHEN before = 0 THEN 'inconclusive' WHEN (after - before) / CAST(before AS DOUBLE) <= -0.15 THEN 'negative' ELSE 'positive' END AS outcome FROM sums""",
    "measurable_changes": f"WITH c AS ({v.APPLIED_CHANGE}) SELECT id, finding_type, merged_on FROM c WHERE status = 'merged' AND merged_on <= DATE '2002-01-31' - 14 AND id % 2 <> 0 AND finding_type <> 'type-3'",
    "graduation_continued": f"{_IMPACT} SELECT change_id, finding_type, good, eligible, event FROM events WHERE merged_on >= DATE '1998-01-01'",
    "impact_alerts": f"""{_IMPACT}, files AS (SELECT id, file_path IS NOT NULL AND previous_content IS NOT NULL AS can FROM change), kinds AS (
          SELECT change_id, finding_type, event AS kind FROM events WHERE event <> ''
          UNION ALL SELECT change_id, finding_type, CASE WHEN can THEN 'negative-impact' ELSE 'revert-manual-needed' END FROM events JOIN files ON id = change_id WHERE {_NEGATIVE})
        SELECT *, CASE kind WHEN 'revoked' THEN 'Graduación revocada: ' || finding_type WHEN 'graduated' THEN 'Graduación conseguida: ' || finding_type
                            WHEN 'negative-impact' THEN 'Impacto negativo detectado — PR de reversión abierto' ELSE 'Impacto negativo detectado — reversión manual necesaria' END AS subject,
               CASE kind WHEN 'revoked' THEN {_BODY} || ' mostró un impacto negativo tras el merge. Se revoca autoMergeEligible para este tipo de hallazgo — volverá a necesitar 10 instancias limpias consecutivas.'
                         WHEN 'graduated' THEN finding_type || ' ha completado 10 instancias consecutivas sin impacto negativo. A partir de ahora, los PRs de este tipo se auto-mergean sin esperar revisión.'
                         WHEN 'negative-impact' THEN {_BODY} || ' mostró impacto negativo. Se abrió un PR de reversión. Revísalo y decide si mergearlo — el sistema nunca lo mergea solo.'
                         ELSE {_BODY} || ' mostró impacto negativo, pero no tiene contenido previo capturado (cambio de una fase anterior a Fase 6). Se requiere reversión manual necesaria.' END AS body FROM kinds""",
    "revert_changes": f"""{_IMPACT} SELECT c.stable_key, 'revert' AS finding_type, 'open' AS status, c.file_path, c.previous_content AS new_content, c.id AS reverts_change_id
        FROM change c JOIN measured m ON m.change_id = c.id WHERE {_NEGATIVE} AND c.file_path IS NOT NULL AND c.previous_content IS NOT NULL""",
    "tier1_capped": f"{_CAPPED} SELECT stable_key, finding_type, action FROM plan",
    "tier1_counts": f"{_CAPPED} SELECT count(*) FILTER (action = 'open') AS opened, count(*) FILTER (action = 'skippedDuplicate') AS skipped_duplicate, count(*) FILTER (action = 'skippedNoFixer') AS skipped_no_fixer FROM plan",
    "collection_failures": "SELECT count(*) AS checked, count(*) FILTER (p_partkey % 4 = 3) AS failing FROM part",
    "reviewed_ledger": f"""{_UNITS} SELECT sha256('internalLinking:internal-link:' || source_slug || ':' || target_slug) AS stable_key, CASE source_id % 4 WHEN 1 THEN 'resolved' ELSE 'open' END AS status,
        CASE WHEN source_id % 4 = 1 THEN TIMESTAMP '2024-02-06' END AS resolved_at, CASE WHEN source_id % 4 = 0 THEN TIMESTAMP '2024-02-06' END AS reviewed_at,
        CASE WHEN source_id % 4 = 0 THEN sha256(coalesce(d.text, '')) END AS reviewed_content_hash, CASE WHEN source_id % 4 = 0 THEN 'why' END AS review_reason
        FROM suggested LEFT JOIN documents d ON d.doc_id = source_id""",
    "link_detail_check": """SELECT 'k' || o_orderkey AS stable_key, CASE WHEN n < 2 THEN 's' || o_orderkey WHEN n = 3 THEN 's' END AS source_slug, CASE WHEN n IN (0, 2, 3) THEN 't' END AS target_slug,
        CASE WHEN n < 2 THEN CAST(0.5 AS DOUBLE) WHEN n = 2 THEN CAST(1 AS DOUBLE) END AS similarity, n = 0 AS well_formed FROM (SELECT o_orderkey, o_orderkey % 6 AS n FROM orders)""",
    "embedding_counts": "SELECT count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS embedded, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 = 0) AS skipped, count(*) FILTER (doc_id % 5 = 0) AS failed FROM documents",
    "late_corrections": f"{_SNAP} SELECT date, page, query, CAST(CASE WHEN date >= DATE '2024-01-27' THEN clicks - 1 ELSE clicks END AS INT) AS clicks, impressions FROM snap",
    "health_upsert": f"WITH w AS ({v.WORKFLOW_RUN}), rest AS ({_REST}), early AS ({_EARLY}) SELECT * FROM rest UNION ALL SELECT * FROM early WHERE workflow NOT IN (SELECT workflow FROM rest)",
    "open_priorities": f"WITH l AS ({v.TIER_LEDGER}) SELECT stable_key, finding_type, priority_score FROM l WHERE status = 'open' ORDER BY priority_score DESC, stable_key LIMIT 50",
}
