"""Views that give the shared test tables the shapes that operators expect."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2024, 1, 30)
LEDGER_AS_OF = dt.date(2024, 1, 23)
BASE = "https://site.example"

SEARCH_SNAPSHOT = """
SELECT CAST(ts AS DATE) AS date,
       concat('https://site.example/blog/cat', CAST(user_id % 3 AS STRING), '/a', CAST(user_id % 20 AS STRING)) AS page,
       concat('q', CAST(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) % 25 AS STRING)) AS query,
       CAST(sum(CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END) AS INT) AS clicks,
       CAST(sum(CAST(floor(value) AS BIGINT)) AS INT) AS impressions,
       CAST(1 + min(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT)) % 30 AS DOUBLE) AS position
FROM events GROUP BY 1, 2, 3
"""

TRAFFIC_SNAPSHOT = """
SELECT CAST(ts AS DATE) AS date, concat('/p/', CAST(user_id % 20 AS STRING)) AS page, event_type AS channel,
       CAST(count(*) AS INT) AS sessions, CAST(count(DISTINCT user_id) AS INT) AS engaged_sessions,
       CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS conversions
FROM events GROUP BY 1, 2, 3
"""

ARTICLES = """
SELECT e.vec_id,
       CASE WHEN e.vec_id % 25 = 0 THEN concat('v', CAST(e.vec_id AS STRING))
            ELSE concat('c', CAST(e.label AS STRING), '/v', CAST(e.vec_id AS STRING)) END AS slug,
       d.text AS text, e.embedding
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
"""

SLUGS = """
SELECT CASE WHEN vec_id % 25 = 0 THEN concat('v', CAST(vec_id AS STRING))
            ELSE concat('c', CAST(label AS STRING), '/v', CAST(vec_id AS STRING)) END AS slug, vec_id, embedding
FROM embeddings
"""

PERFORMANCE_AUDIT = """
SELECT CAST(p_partkey AS STRING) AS id,
       concat('https://site.example/t/', CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS STRING)) AS url,
       CAST(p_partkey % 4 AS INT) AS run_no,
       CAST(p_size * 2 AS INT) AS performance_score,
       CAST(p_size AS DOUBLE) / 8.0 AS lcp,
       CAST(p_size AS DOUBLE) / 100.0 AS cls,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size * 15 AS DOUBLE) END AS inp
FROM part
"""

APPLIED_CHANGE = """
SELECT o_orderkey AS id, concat('type-', substr(o_orderpriority, 1, 1)) AS finding_type,
       CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'open' ELSE 'closed' END AS status,
       concat('https://site.example/p/', CAST(o_custkey % 20 AS STRING)) AS page,
       CAST(o_orderdate AS DATE) AS merged_on,
       CASE WHEN o_custkey % 2 = 0 THEN 'a/file' END AS file_path,
       CASE WHEN o_custkey % 4 = 0 THEN 'before' END AS previous_content,
       concat('k', CAST(o_orderkey AS STRING)) AS stable_key
FROM orders
"""

DAILY_CLICKS = """
SELECT CAST(l_shipdate AS DATE) AS day,
       concat('https://site.example/p/', CAST(l_suppkey % 20 AS STRING)) AS page,
       sum(CAST(l_quantity AS BIGINT)) AS clicks
FROM lineitem GROUP BY 1, 2
"""

WORKFLOW_RUN = """
SELECT concat('wf', CAST(user_id % 10 AS STRING)) AS workflow, CAST(ts AS DATE) AS run_on, event_id AS step_no,
       CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome
FROM events
"""

#: Ledger rows of four types over all orders, and open changes of some of them.
TIER_LEDGER = """
SELECT concat('k', CAST(o_orderkey AS STRING)) AS stable_key,
       CASE o_custkey % 4 WHEN 0 THEN 'robots-blocks-all' WHEN 1 THEN 'robots-missing-sitemap-directive'
                          WHEN 2 THEN 'sitemap-out-of-domain' ELSE 'content-declining' END AS finding_type,
       CAST(CASE o_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 1 END AS DOUBLE) AS priority_score,
       CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status
FROM orders
"""

TIER_CHANGES = """
SELECT concat('k', CAST(o_orderkey AS STRING)) AS stable_key, 'robots-blocks-all' AS finding_type,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'open' ELSE 'merged' END AS status
FROM orders WHERE o_custkey % 4 = 0
"""

CHANGE_STATUS = """
SELECT o_orderkey AS pr_number, CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'open' ELSE 'closed' END AS state,
       substr(o_orderpriority, 1, 1) IN ('1', '2') AS merged
FROM orders WHERE substr(o_orderpriority, 1, 1) <> '4'
"""

EXPIRATIONS = "SELECT CAST(o_orderkey AS STRING) AS name, CASE WHEN o_orderstatus = 'P' THEN 'never' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS expires_at FROM orders"

ROBOTS_DOCUMENTS = """
SELECT CAST(doc_id AS STRING) AS site,
       CASE doc_id % 4 WHEN 0 THEN concat(text, chr(10), ' SITEMAP: /s.xml') WHEN 1 THEN concat(text, chr(10), 'disallow: / ')
                       WHEN 2 THEN text ELSE NULL END AS body,
       CASE WHEN doc_id % 4 = 3 THEN concat('status ', source) END AS fetch_error
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the tables it names after FROM and JOIN."""
    names = {n for n in ("events", "embeddings", "documents", "part", "orders", "lineitem", "pages") if f"FROM {n}" in sql or f"JOIN {n}" in sql}
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})
