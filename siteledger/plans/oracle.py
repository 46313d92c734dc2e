"""SQL equivalents of the registered queries, over the same tables."""

from __future__ import annotations

from siteledger.functions.rules import FINDING_RULES
from siteledger.sources import views as v

_RULES = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{t}', {i}, {e}, {n})" for s, t, i, e, n in FINDING_RULES) + ") r(rule_source, finding_type, impact, effort, tier)"
_TERMS = "SELECT * FROM (VALUES ('q1'), ('q2'), ('q3'), ('q9'), ('q24'), ('v7'), ('1'), ('24'), ('q77')) t(term)"


def _content(name: str, as_of: str) -> str:
    """CTEs that end in name_found: key, type and reference of content findings."""
    return f"""
{name}_recent AS (SELECT * FROM snap WHERE date >= DATE '{as_of}' - 14 AND date <= DATE '{as_of}'),
{name}_prior AS (SELECT * FROM snap WHERE date >= DATE '{as_of}' - 28 AND date < DATE '{as_of}' - 14),
{name}_decline AS (
  SELECT r.page, p.clicks AS prior_clicks, r.clicks AS recent_clicks, (p.clicks - r.clicks) / CAST(p.clicks AS DOUBLE) AS decline
  FROM (SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks FROM {name}_recent GROUP BY page) r
  JOIN (SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks FROM {name}_prior GROUP BY page) p ON r.page = p.page
  WHERE p.clicks > 0 AND (p.clicks - r.clicks) / CAST(p.clicks AS DOUBLE) >= 0.3
),
{name}_compete AS (
  SELECT query, CAST(count(DISTINCT page) AS INT) AS n_pages, string_agg(DISTINCT page, ',' ORDER BY page) AS pages
  FROM {name}_recent GROUP BY query HAVING count(DISTINCT page) >= 2
),
{name}_gap AS (
  SELECT page, query, date, clicks, impressions, position FROM (
    SELECT *, row_number() OVER (PARTITION BY page, query ORDER BY date DESC, impressions DESC) AS n FROM {name}_recent
    WHERE impressions >= 100 AND clicks / CAST(impressions AS DOUBLE) < 0.01 AND position > 10
  ) WHERE n = 1
),
{name}_found AS (
  SELECT sha256('content:' || k) AS stable_key, f.finding_type, r.impact, r.effort, r.tier, CAST(r.impact AS DOUBLE) / r.effort AS priority_score
  FROM (
    SELECT 'content-declining' AS finding_type, 'content-declining:' || page AS k FROM {name}_decline
    UNION ALL SELECT 'content-cannibalization', 'content-cannibalization:' || query FROM {name}_compete
    UNION ALL SELECT 'content-query-gap', 'content-query-gap:' || page || ':' || query FROM {name}_gap
  ) f JOIN ({_RULES}) r ON r.finding_type = f.finding_type
)"""


_SNAP = f"WITH snap AS ({v.SEARCH_SNAPSHOT})"
_NOW = f"{_SNAP}, {_content('now', '2024-01-30')}"
_SYNC = f"""{_NOW}, {_content('old', '2024-01-23')}, merged AS (
  SELECT coalesce(o.stable_key, n.stable_key) AS stable_key, coalesce(o.finding_type, n.finding_type) AS finding_type,
         CASE WHEN n.stable_key IS NULL THEN 'resolved' ELSE 'open' END AS status,
         CASE WHEN o.stable_key IS NULL THEN 'created' WHEN n.stable_key IS NULL THEN 'resolved' ELSE 'updated' END AS action,
         CASE WHEN o.stable_key IS NULL THEN TIMESTAMP '2024-01-30' ELSE TIMESTAMP '2024-01-23' END AS first_detected_at,
         CASE WHEN n.stable_key IS NULL THEN TIMESTAMP '2024-01-30' END AS resolved_at
  FROM old_found o FULL OUTER JOIN now_found n ON o.stable_key = n.stable_key
)"""

_UNITS = f"""WITH arts AS ({v.SLUGS}), units AS (
  SELECT slug, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / norm) AS u
  FROM (SELECT *, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM arts) WHERE norm > 0
), pairs AS (
  SELECT a.slug AS source_slug, b.slug AS target_slug, a.vec_id AS source_id, b.vec_id AS target_id, list_dot_product(a.u, b.u) AS s
  FROM units a JOIN units b ON a.slug <> b.slug
), top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_slug ORDER BY round(s, 9) DESC, target_slug) AS rank FROM pairs WHERE contains(source_slug, '/')
  ) WHERE rank <= 5
), suggested AS (
  SELECT sha256('internalLinking:' || source_slug || ':' || target_slug) AS stable_key, * FROM top WHERE s >= 0.35
)"""

_IMPACT = f"""WITH change AS (SELECT * FROM ({v.APPLIED_CHANGE}) WHERE status = 'merged' AND merged_on <= DATE '2002-01-31' - 14),
clicks AS ({v.DAILY_CLICKS}), per_day AS (SELECT day, sum(clicks) AS clicks FROM clicks GROUP BY day),
sums AS (
  SELECT c.id AS change_id, c.finding_type, c.merged_on,
         CAST(coalesce(sum(d.clicks) FILTER (d.day < c.merged_on), 0) AS BIGINT) AS before,
         CAST(coalesce(sum(d.clicks) FILTER (d.day >= c.merged_on), 0) AS BIGINT) AS after
  FROM change c LEFT JOIN per_day d ON d.day >= c.merged_on - 14 AND d.day < c.merged_on + 14
  GROUP BY c.id, c.finding_type, c.merged_on
), measured AS (
  SELECT *, CASE WHEN before = 0 THEN 'inconclusive' WHEN (after - before) / CAST(before AS DOUBLE) <= -0.15 THEN 'negative' ELSE 'positive' END AS outcome FROM sums
), runs AS (
  SELECT *, sum(CASE WHEN outcome = 'negative' THEN 1 ELSE 0 END) OVER (PARTITION BY finding_type ORDER BY merged_on, change_id ROWS UNBOUNDED PRECEDING) AS run FROM measured
), streaks AS (
  SELECT *, CAST(sum(CASE WHEN outcome = 'negative' THEN 0 ELSE 1 END) OVER (PARTITION BY finding_type, run ORDER BY merged_on, change_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS good FROM runs
), steps AS (
  SELECT *, good >= 10 AS eligible, coalesce(lag(good >= 10) OVER (PARTITION BY finding_type ORDER BY merged_on, change_id), false) AS was FROM streaks
), events AS (
  SELECT *, CASE WHEN eligible AND NOT was THEN 'graduated' WHEN outcome = 'negative' AND was THEN 'revoked' ELSE '' END AS event FROM steps
)"""

_ROBOTS = f"""WITH docs AS ({v.ROBOTS_DOCUMENTS}), marked AS (
  SELECT site, fetch_error,
         NOT regexp_matches(chr(10) || body, '(?i)\\n\\s*sitemap:') AS no_map,
         regexp_matches(chr(10) || body || chr(10), '(?i)\\n\\s*disallow:\\s*/[ \\t]*\\n') AS blocks
  FROM docs
)"""

_SITES = """WITH urls AS (
  SELECT CAST(page_id // 100 AS BIGINT) AS n, url, DATE '2024-01-30' - CAST(page_id % 800 AS INT) AS lastmod FROM pages
), sites AS (
  SELECT n, count(*) AS urls, count(*) FILTER (CAST(lastmod AS TIMESTAMP) < TIMESTAMP '2024-01-30' - INTERVAL 400 DAY) AS stale,
         count(*) FILTER (NOT starts_with(url, 'https://')) AS foreign_urls,
         min(CASE WHEN NOT starts_with(url, 'https://') THEN url END) AS first_url
  FROM urls GROUP BY n
)"""


def _bad(part: str) -> str:
    return f"(n % 8 = {3 if part == 'cut' else 5})"


ORACLE_SQL: dict[str, str] = {
    "content_declining": f"{_NOW} SELECT page, prior_clicks, recent_clicks, round(decline, 6) AS decline, sha256('content:content-declining:' || page) AS stable_key, CAST(1.0 AS DOUBLE) AS priority_score FROM now_decline",
    "content_cannibalization": f"{_NOW} SELECT query, n_pages, pages, sha256('content:content-cannibalization:' || query) AS stable_key FROM now_compete",
    "content_query_gap": f"{_NOW} SELECT page, query, date, clicks, impressions, position, sha256('content:content-query-gap:' || page || ':' || query) AS stable_key FROM now_gap",
    "term_gap": f"""{_SNAP}, terms AS ({_TERMS}), slugs AS ({v.SLUGS}), asked AS (
        SELECT term, CAST(sum(impressions) AS BIGINT) AS impressions FROM snap JOIN terms ON contains(lower(query), term) WHERE date >= DATE '2024-01-30' - 90 GROUP BY term)
        SELECT * FROM asked WHERE impressions >= 500 AND NOT EXISTS (SELECT 1 FROM slugs WHERE contains(lower(slug), term))""",
    "scored_findings": f"{_NOW} SELECT 'content' AS source, finding_type, stable_key, impact, effort, tier, round(priority_score, 6) AS priority_score FROM now_found",
    "priority_by_tier": f"{_NOW} SELECT tier, finding_type, count(*) AS n, round(sum(priority_score), 6) AS priority FROM now_found GROUP BY tier, finding_type",
    "opportunity_sync": f"{_SYNC} SELECT * FROM merged",
    "opportunity_sync_counts": f"{_SYNC} SELECT count(*) FILTER (action = 'created') AS created, count(*) FILTER (action = 'reopened') AS reopened, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'resolved') AS resolved FROM merged",
    "open_by_source": f"{_SYNC} SELECT 'content' AS source, count(*) AS n FROM merged WHERE status = 'open' HAVING count(*) > 0",
    "snapshot_upsert": f"{_SNAP} SELECT date, page, query, CAST(CASE WHEN date >= DATE '2024-01-18' THEN clicks + 1 ELSE clicks END AS INT) AS clicks, impressions FROM snap WHERE date <= DATE '2024-01-21'",
    "search_collection": f"{_SNAP} SELECT date, page, query, clicks, impressions, CAST(0 AS DOUBLE) AS ctr, position FROM snap WHERE date BETWEEN DATE '2024-01-27' AND DATE '2024-01-30'",
    "traffic_collection": v.TRAFFIC_SNAPSHOT,
    "latest_batch": f"{_SNAP} SELECT date, page, query, clicks FROM snap WHERE date = (SELECT max(date) FROM snap)",
    "page_speed_audit": f"""WITH p AS ({v.PERFORMANCE_AUDIT}) SELECT id AS url,
        CASE WHEN run_no <> 3 THEN performance_score END AS performance_score, CASE WHEN run_no <> 3 THEN round(lcp, 6) END AS lcp,
        CASE WHEN run_no <> 3 THEN round(cls, 6) END AS cls, CASE WHEN run_no <> 3 THEN round(inp, 6) END AS inp,
        CASE WHEN run_no = 3 THEN 'No se pudo obtener PageSpeed Insights: status 500' ELSE '' END AS errors FROM p""",
    "performance_findings": f"""WITH p AS ({v.PERFORMANCE_AUDIT}), f AS (
        SELECT id, url, 'performance-lcp-red' AS finding_type FROM p WHERE lcp > 4 UNION ALL SELECT id, url, 'performance-cls-red' FROM p WHERE cls > 0.25
        UNION ALL SELECT id, url, 'performance-inp-red' FROM p WHERE inp > 500 UNION ALL SELECT id, url, 'performance-low-score' FROM p WHERE performance_score < 50)
        SELECT finding_type, id, sha256('performance:' || finding_type || ':' || url) AS stable_key FROM f""",
    "template_performance": f"WITH p AS ({v.PERFORMANCE_AUDIT}) SELECT url, string_agg(CAST(performance_score AS VARCHAR), ',' ORDER BY run_no, id) AS scores FROM p WHERE performance_score IS NOT NULL GROUP BY url HAVING count(*) >= 3 AND max(performance_score) < 50",
    "near_duplicate_pairs": f"{_UNITS} SELECT source_slug AS slug_a, target_slug AS slug_b, round(s, 6) AS similarity FROM pairs WHERE source_slug < target_slug AND s >= 0.4",
    "near_duplicates": f"""WITH arts AS ({v.SLUGS}), e AS (
          SELECT slug, vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM arts
        ), b AS (
          SELECT slug, v FROM e UNION ALL
          SELECT 'twin/' || slug, list_transform(v, lambda x, i: x + CASE WHEN i - 1 = vec_id % 8 THEN CASE WHEN vec_id % 3 = 0 THEN 0.6 ELSE 0.2 END * norm ELSE 0.0 END) FROM e
        ), u AS (SELECT slug, list_transform(v, lambda x: x / n) AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM b) WHERE n > 0)
        SELECT x.slug AS slug_a, y.slug AS slug_b, round(list_dot_product(x.u, y.u), 6) AS similarity FROM u x JOIN u y ON x.slug < y.slug WHERE list_dot_product(x.u, y.u) >= 0.92""",
    "link_suggestions": f"{_UNITS} SELECT stable_key, source_slug, target_slug, round(s, 6) AS similarity FROM suggested WHERE (source_id + target_id) % 3 <> 0",
    "suggestion_sync": f"""{_UNITS} SELECT stable_key, source_slug, target_slug, CASE WHEN target_id % 3 = 0 THEN 'dismissed' ELSE 'open' END AS status,
        CASE target_id % 3 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'updated' ELSE 'created' END AS action FROM suggested""",
    "impact_measurement": f"{_IMPACT} SELECT change_id, finding_type, merged_on, before, after, outcome FROM measured",
    "impact_by_page": f"""WITH change AS (SELECT * FROM ({v.APPLIED_CHANGE}) WHERE status = 'merged' AND merged_on <= DATE '2002-01-31' - 14), clicks AS ({v.DAILY_CLICKS})
        SELECT c.id AS change_id, c.page, CAST(coalesce(sum(d.clicks) FILTER (d.day < c.merged_on), 0) AS BIGINT) AS before, CAST(coalesce(sum(d.clicks) FILTER (d.day >= c.merged_on), 0) AS BIGINT) AS after
        FROM change c LEFT JOIN clicks d ON d.page = c.page AND d.day >= c.merged_on - 14 AND d.day < c.merged_on + 14 GROUP BY c.id, c.page""",
    "graduation_streaks": f"{_IMPACT} SELECT change_id, finding_type, good, eligible, event FROM events",
    "graduation_records": f"""{_IMPACT} SELECT finding_type, good AS consecutive_good, eligible AS auto_merge_eligible FROM (
        SELECT *, row_number() OVER (PARTITION BY finding_type ORDER BY merged_on DESC, change_id DESC) AS n FROM events) WHERE n = 1""",
    "graduation_alerts": f"""{_IMPACT}, files AS (SELECT id, file_path IS NOT NULL AND previous_content IS NOT NULL AS can FROM change)
        SELECT change_id, finding_type, event AS kind FROM events WHERE event <> ''
        UNION ALL SELECT change_id, finding_type, CASE WHEN can THEN 'negative-impact' ELSE 'revert-manual-needed' END FROM events JOIN files ON id = change_id WHERE outcome = 'negative'""",
    "tier1_plan": f"""WITH l AS ({v.TIER_LEDGER}), c AS ({v.TIER_CHANGES}), t AS (
        SELECT *, finding_type = 'robots-missing-sitemap-directive' AND EXISTS (SELECT 1 FROM c WHERE status = 'open') AS other,
               EXISTS (SELECT 1 FROM c WHERE c.status = 'open' AND c.stable_key = l.stable_key) AS same
        FROM l WHERE status = 'open' AND starts_with(finding_type, 'robots-')
    ), o AS (
        SELECT *, first_value(CASE WHEN NOT other AND NOT same THEN finding_type END IGNORE NULLS) OVER (ORDER BY priority_score DESC, stable_key ROWS UNBOUNDED PRECEDING) AS taker FROM t
    ), a AS (SELECT *, CASE WHEN other OR same OR taker <> finding_type THEN 'skippedDuplicate' ELSE 'open' END AS action FROM o)
        SELECT stable_key, finding_type, action, action = 'open' AND finding_type IN (SELECT finding_type FROM c WHERE status = 'merged') AS auto_merge FROM a""",
    "change_sync": f"""WITH c AS ({v.APPLIED_CHANGE}), s AS ({v.CHANGE_STATUS})
        SELECT id, CASE WHEN c.status = 'open' AND s.state IS NOT NULL THEN CASE WHEN s.state = 'open' THEN 'open' WHEN s.merged THEN 'merged' ELSE 'closed' END ELSE c.status END AS status
        FROM c LEFT JOIN s ON s.pr_number = c.id""",
    "briefing_rows": f"""{_UNITS}, text_of AS (SELECT u.slug, u.vec_id, d.text FROM arts u LEFT JOIN documents d ON d.doc_id = u.vec_id)
        SELECT sha256('internalLinking:internal-link:' || source_slug || ':' || target_slug) AS stable_key, 'internal-link-suggestion' AS finding_type, CAST(2 AS DOUBLE) AS priority_score, false AS malformed,
               source_slug, target_slug, CAST(length(substr(a.text, 1, 2000)) AS INT) AS source_chars, CAST(length(substr(b.text, 1, 2000)) AS INT) AS target_chars
        FROM suggested JOIN text_of a ON a.slug = source_slug JOIN text_of b ON b.slug = target_slug WHERE source_id % 4 <> 0""",
    "embedding_change_set": "SELECT CAST(doc_id AS VARCHAR) AS slug, sha256(text) AS content_hash, CASE doc_id % 3 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'changed' ELSE 'new' END AS action FROM documents",
    "embedding_refresh": """SELECT CAST(doc_id AS VARCHAR) AS slug, CASE WHEN doc_id % 3 < 2 THEN 'was' ELSE 'https://site.example/blog/' || CAST(doc_id AS VARCHAR) END AS url, sha256(text) AS content_hash,
        CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 256 END AS INT) AS dims, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-23' ELSE TIMESTAMP '2024-01-30' END AS updated_at FROM documents""",
    "workflow_health": f"WITH w AS ({v.WORKFLOW_RUN}) SELECT workflow, run_on, CASE WHEN bool_or(outcome = 'failure') THEN 'failed' ELSE 'ok' END AS status, count(*) FILTER (outcome = 'failure') AS failed_steps FROM w GROUP BY workflow, run_on",
    "workflow_alerts": f"""WITH w AS ({v.WORKFLOW_RUN}) SELECT 'workflow-failed' AS type, 'Workflow "' || workflow || '" tuvo al menos un paso fallido' AS subject, false AS acknowledged
        FROM w WHERE run_on = (SELECT max(run_on) FROM w) GROUP BY workflow HAVING bool_or(outcome = 'failure')""",
    "expiry_alerts": f"""WITH e AS ({v.EXPIRATIONS}), t AS (SELECT name, CAST(floor(date_diff('second', TIMESTAMP '1998-08-01 13:00:00', TRY_CAST(expires_at AS TIMESTAMP)) / 86400.0 + 0.5) AS BIGINT) AS days_left FROM e)
        SELECT * FROM t WHERE days_left < 30""",
    "last_changes": f"WITH c AS ({v.APPLIED_CHANGE}) SELECT id, finding_type, status, merged_on FROM c ORDER BY merged_on DESC, id DESC LIMIT 20",
    # HTML reads these names also without their semicolon, as at the end of a title that was cut.
    "article_text": r"""WITH inner_ AS (SELECT url, regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', '', 'g') AS t FROM pages),
        plain AS (SELECT url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS t FROM inner_)
        SELECT url, trim(regexp_replace(t, '[\s\x0B\x85\p{Z}\x{FEFF}]+', ' ', 'g')) AS text FROM plain""",
    "existing_links": r"""WITH h AS (SELECT url, unnest(regexp_extract_all(replace(html, 'href="/', 'href="/blog/'), '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages),
        s AS (SELECT DISTINCT url, regexp_replace(regexp_extract(replace(href, '&amp;', '&'), '/blog/([^"?#\s]+)', 1), '/$', '') AS slug FROM h) SELECT * FROM s WHERE slug <> ''""",
    "structured_data_audit": "SELECT url, 'none' AS schema_type, false AS is_valid, 'No se encontró ningún bloque JSON-LD en la página' AS errors FROM pages",
    "structured_data_findings": "SELECT 'structured-data-missing' AS finding_type, sha256('structuredData:structured-data-missing:' || url) AS stable_key FROM pages",
    "robots_audit": f"""{_ROBOTS} SELECT site, fetch_error IS NULL AND NOT no_map AND NOT blocks AS is_valid,
        CASE WHEN fetch_error IS NOT NULL THEN 'No se pudo obtener robots.txt: ' || fetch_error
             ELSE concat_ws('|', CASE WHEN no_map THEN 'robots.txt no declara ninguna directiva Sitemap:' END, CASE WHEN blocks THEN 'robots.txt contiene ''Disallow: /'' — bloquearía la indexación de todo el sitio' END) END AS errors FROM marked""",
    "robots_findings": f"""{_ROBOTS} SELECT site, t AS finding_type, t AS stable_key_input FROM (
        SELECT site, 'robots-fetch-failed' AS t FROM marked WHERE fetch_error IS NOT NULL
        UNION ALL SELECT site, 'robots-missing-sitemap-directive' FROM marked WHERE no_map UNION ALL SELECT site, 'robots-blocks-all' FROM marked WHERE blocks)""",
    "sitemap_audit": f"""{_SITES} SELECT CAST(n AS VARCHAR) AS site, CAST(CASE WHEN {_bad('cut')} OR {_bad('failed')} THEN 0 ELSE urls END AS INT) AS url_count,
        CAST(CASE WHEN {_bad('cut')} OR {_bad('failed')} THEN 0 ELSE stale END AS INT) AS stale_entries, CAST(CASE WHEN {_bad('cut')} OR {_bad('failed')} THEN 1 ELSE foreign_urls END AS INT) AS n_errors,
        CASE WHEN {_bad('cut')} THEN 'El XML del sitemap parece estar mal formado (no se encontró </urlset>)' WHEN {_bad('failed')} THEN 'No se pudo obtener el sitemap: status 404'
             ELSE coalesce('URL fuera de dominio en el sitemap: ' || first_url, '') END AS first_error FROM sites""",
    "sitemap_findings": f"""{_SITES} SELECT CAST(n AS VARCHAR) AS source_ref_id, 'sitemap-malformed' AS finding_type, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS n_keys FROM sites WHERE {_bad('cut')}
        UNION ALL SELECT CAST(n AS VARCHAR), 'sitemap-fetch-failed', 1, 1 FROM sites WHERE {_bad('failed')}
        UNION ALL SELECT CAST(n AS VARCHAR), 'sitemap-out-of-domain', foreign_urls, foreign_urls FROM sites WHERE NOT {_bad('cut')} AND NOT {_bad('failed')} AND foreign_urls > 0
        UNION ALL SELECT CAST(n AS VARCHAR), 'sitemap-stale-entries', 1, 1 FROM sites WHERE NOT {_bad('cut')} AND NOT {_bad('failed')} AND stale > 0""",
    "published_articles": f"""{_SITES} SELECT DISTINCT regexp_replace(url, '^https?://[^/]*/', '') AS slug, regexp_replace(url, '^https?://[^/]*/', 'https://site.example/blog/') AS url
        FROM urls WHERE NOT {_bad('cut')} AND NOT {_bad('failed')} AND regexp_replace(url, '^https?://[^/]*/', '') <> ''""",
}
