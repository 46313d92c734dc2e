"""Weighted URL vocabulary (operator 13).

An Aho-Corasick automaton over a vocabulary of weighted terms goes once over each
address. An occurrence counts where it stands alone: no letter, digit or
character beyond ASCII before or after it. Each distinct term counts once with
its weight, and an address is blocked when its weights reach THRESHOLD: one
strict term does, or several soft ones. Rules of hosts and paths come first: a
rule fits its host and all hosts below it, where the path begins with the
rule's; the longest that fits decides.

Hosts, paths and rules are Spark expressions; only ids and addresses go through
Python, as Arrow batches. Nothing is shuffled or collected. The rules are a
short fixed list, tested one by one; the automaton is built once a task.

Defined cases: a null or empty address, or one without ://, has an empty host and
path; no rule fits it, and its own terms still count (the whole of it is
scanned). An address without a path has an empty one, which begins with no rule's
path. Port and user are part of the host. Repeated ids and rows are judged one by
one; an empty table gives an empty result; very long addresses are scanned in
pieces; columns other than page_id and url are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions.automaton import Automaton, string_bytes

#: Weights of which an address is blocked; a strict term has it, a soft one half.
THRESHOLD, STRICT, SOFT = 2, 2, 1
STRICT_TERMS = ("adult", "bitcoin-casino", "camgirls", "casino", "casinos", "escorts", "hentai", "keygen", "malware", "phishing", "porn", "porno", "viagra", "warez", "xxx")
SOFT_TERMS = (
    "ads", "bet", "bets", "betting", "bonus", "cheap", "click", "crack", "dating", "deal", "deals", "discount", "doubleclick",
    "farm", "free", "gambling", "jackpot", "loan", "loans", "lottery", "pharma", "pharmacy", "pill", "pills", "poker", "popup", "prize",
    "sex", "slots", "spam", "sponsor", "sponsored", "torrent", "track", "tracker", "tracking", "win", "winner",
)
VOCABULARY = {t: STRICT for t in STRICT_TERMS} | {t: SOFT for t in SOFT_TERMS}

#: Host, path and verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Bytes that belong to a word: letters, digits and all of a character beyond ASCII.
_INNER = np.zeros(256, bool)
_INNER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_UPPER_LETTERS, _LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lower case, and path of an address; both empty without ://."""
    rest = F.coalesce(F.substring_index(F.regexp_extract(url, r"(?s)://(.*)", 1), "#", 1), F.lit(""))
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, _UPPER_LETTERS, _LOWER_LETTERS), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict, or null."""
    tests = []
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(prefix))
        tests.append(F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*tests, none)


def url_terms(pages: DataFrame, vocabulary: dict[str, int] = VOCABULARY) -> DataFrame:
    """page_id, url and terms: the distinct terms that stand alone in the address,
    sorted. The vocabulary's terms are in lower case."""
    words = sorted(vocabulary)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = Automaton(words), pa.array(words, pa.string())
        for batch in batches:
            data, offsets = string_bytes(batch.column("url"))
            text, term, start = automaton.matches(_LOWER[data], offsets)
            end = start + automaton.sizes[term]
            before = (start > offsets[text]) & _INNER[data[np.maximum(start - 1, 0)]]
            after = (end < offsets[text + 1]) & _INNER[data[np.minimum(end, len(data) - 1)]] if len(data) else before
            alone = ~before & ~after
            hit = np.unique(text[alone] * len(words) + term[alone])
            places = np.concatenate([[0], np.cumsum(np.bincount(hit // max(len(words), 1), minlength=batch.num_rows))]).astype(np.int32)
            terms = pa.ListArray.from_arrays(places, names.take(pa.array(hit % max(len(words), 1))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), terms], ["page_id", "url", "terms"])

    return pages.select("page_id", "url").mapInArrow(run, f"page_id {kind}, url string, terms array<string>")


def judge_urls(pages: DataFrame, vocabulary: dict[str, int] = VOCABULARY, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, weight and terms of every row of pages
    (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = url_terms(pages, vocabulary).withColumns({"host": host, "path": path}).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    weights = F.create_map(*[F.lit(x) for pair in sorted(vocabulary.items()) for x in pair]) if vocabulary else F.create_map().cast("map<string,int>")
    weight = F.aggregate(F.transform("terms", lambda t: F.element_at(weights, t)), F.lit(0), lambda s, w: s + w)
    rows = rows.withColumn("weight", weight)
    own = F.when(F.col("weight") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", own).alias("verdict"), "weight", "terms")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("terms", F.array_join("terms", "|"))


OP13_SQL = rf"""
WITH terms AS (
  SELECT * FROM (VALUES {", ".join(f"('{t}', {w})" for t, w in sorted(VOCABULARY.items()))}) t(term, weight)
), parts AS (
  SELECT page_id, url, translate(split_part(rest, '/', 1), '{_UPPER_LETTERS}', '{_LOWER_LETTERS}') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path
  FROM (SELECT page_id, url, split_part(split_part(coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, ''), '#', 1), '?', 1) AS rest FROM pages)
), hits AS (
  SELECT page_id, CAST(sum(weight) AS INT) AS weight, string_agg(term, '|' ORDER BY term) AS terms
  FROM pages JOIN terms ON regexp_matches(translate(url, '{_UPPER_LETTERS}', '{_LOWER_LETTERS}'), '(^|[^a-z0-9\x{{80}}-\x{{10FFFF}}])' || term || '([^a-z0-9\x{{80}}-\x{{10FFFF}}]|$)')
  GROUP BY page_id
), ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts
)
SELECT r.page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block'
                 ELSE CASE WHEN coalesce(h.weight, 0) >= {THRESHOLD} THEN 'block' ELSE 'allow' END END AS verdict,
       coalesce(h.weight, 0) AS weight, coalesce(terms, '') AS terms
FROM ruled r LEFT JOIN hits h ON r.page_id = h.page_id
"""
