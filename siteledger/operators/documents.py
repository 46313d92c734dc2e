"""Document audits and extraction: robots, sitemaps, structured data, article text, links."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.functions.rules import REQUIRED_FIELDS
from siteledger.functions.scalars import collapsed, link_slug, trimmed, url_slug
from siteledger.operators import findings
from siteledger.sources.landing import sitemap_urls

STALE_DAYS = 400
#: Characters of pages whose parts are given back together: objects of Python take
#: several times a page, so few pages are held as such at once.
GIVEN_CHARS = 2_000_000
NO_JSON_LD = "No se encontró ningún bloque JSON-LD en la página"
BAD_JSON_LD = "El bloque JSON-LD no es JSON válido"
PAGE_FAILED = "No se pudo obtener la página: "


def _texts(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def audit_robots(documents: DataFrame) -> DataFrame:
    """site, is_valid and errors of documents (site, body, fetch_error)."""
    lines = F.transform(F.split("body", "\n", -1), trimmed)
    errors = F.when(F.col("fetch_error").isNotNull(), F.array(F.concat(F.lit(findings.ROBOTS_FAILED), "fetch_error"))).otherwise(_texts(
        F.when(~F.exists(lines, lambda l: l.rlike("(?i)^sitemap:")), findings.NO_DIRECTIVE),
        F.when(F.exists(lines, lambda l: l.rlike(r"(?i)^disallow:\s*/\s*$")), findings.BLOCKS_ALL + " — bloquearía la indexación de todo el sitio"),
    ))
    return documents.withColumn("errors", errors).select("site", (F.size("errors") == 0).alias("is_valid"), "errors")


def audit_sitemaps(documents: DataFrame, now: dt.datetime) -> DataFrame:
    """site, url_count, stale_entries and errors of documents (site, base_url,
    body, fetch_error). Foreign addresses are listed in the order of their text."""
    whole = F.contains("body", F.lit("</urlset>"))
    fine = documents.filter(F.col("fetch_error").isNull() & whole)
    urls = sitemap_urls(fine.select("site", "base_url", "body"))
    limit = F.lit(now - dt.timedelta(STALE_DAYS)).cast("timestamp")
    stale = F.expr("try_to_timestamp(lastmod)") < limit
    foreign = (F.col("loc") != "") & ~F.col("loc").startswith(F.col("base_url"))
    sums = urls.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(stale).alias("s"), F.array_sort(F.collect_list(F.when(foreign, F.concat(F.lit(findings.OUT_OF_DOMAIN), "loc")))).alias("e"))
    failed = F.col("fetch_error").isNotNull()
    none = F.array().cast("array<string>")
    errors = F.when(failed, F.array(F.concat(F.lit(findings.SITEMAP_FAILED), "fetch_error"))).when(~whole, F.array(F.lit(findings.MALFORMED + " (no se encontró </urlset>)"))).otherwise(F.coalesce("e", none))
    out = documents.join(sums, "site", "left")
    return out.select("site", F.coalesce("n", F.lit(0)).cast("int").alias("url_count"), F.coalesce("s", F.lit(0)).cast("int").alias("stale_entries"), errors.alias("errors"))


class _Page(HTMLParser):
    """One pass over a page: article text, body text, nested main, links and
    JSON-LD blocks. Unclosed elements end with the page."""

    SKIP = {"script", "style"}
    FURNITURE = {"nav", "footer", "header", "aside", "script", "style"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.article: list[str] | None = None
        self.main: list[str] | None = None
        self.body: list[str] = []
        self.article_depth = self.main_depth = 0
        self.blocks: list[str] = []
        self.in_block = False
        self.hrefs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if tag == "a" and given.get("href"):
            self.hrefs.append(given["href"])
        if tag == "script" and (given.get("type") or "").strip().lower() == "application/ld+json":
            self.in_block = True
            self.blocks.append("")
        if tag in self.VOID:
            return
        self.open.append(tag)
        if tag == "article" and self.article is None:
            self.article, self.article_depth = [], len(self.open)
        if tag == "main" and self.main is None and "main" in self.open[:-1]:
            self.main, self.main_depth = [], len(self.open)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID and self.open and self.open[-1] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            if self.open.pop() == tag:
                break
        if len(self.open) < self.article_depth:
            self.article_depth = 10**9  # closed: only the first one counts
        if len(self.open) < self.main_depth:
            self.main_depth = 10**9
        if tag == "script":
            self.in_block = False

    def handle_data(self, data: str) -> None:
        if self.in_block:
            self.blocks[-1] += data
        if self.SKIP.intersection(self.open):
            return
        if self.article is not None and 0 < self.article_depth <= len(self.open):
            self.article.append(data)
        if self.main is not None and 0 < self.main_depth <= len(self.open):
            self.main.append(data)
        if not self.FURNITURE.intersection(self.open) and "head" not in self.open:
            self.body.append(data)

    @property
    def text(self) -> str:
        return "".join(next(x for x in (self.article, self.main, self.body) if x is not None))


def _given(b: pa.RecordBatch, out: list[tuple], last: int) -> pa.RecordBatch:
    kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
    first = last - len(out)
    return pa.RecordBatch.from_arrays([b.column(0)[first:last], b.column(2)[first:last], *[pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]], names=["url", "fetch_error", "raw", "hrefs", "blocks"])


def parsed_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """url, fetch_error, raw, hrefs and blocks of url, html, fetch_error, each page
    parsed once, given back a few pages at a time."""
    for b in batches:
        out, size = [], 0
        for n, html in enumerate(b.column(1)):
            text = html.as_py() or ""
            page = _Page()
            page.feed(text)
            page.close()
            out.append((page.text, page.hrefs, page.blocks))
            size += len(text)
            if size >= GIVEN_CHARS:
                yield _given(b, out, n + 1)
                out, size = [], 0
        if out:
            yield _given(b, out, len(b.column(1)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """url, fetch_error, text, hrefs and blocks (JSON-LD) of pages (url, html,
    fetch_error), each page parsed once; text is null where the fetch failed."""
    parsed = pages.select("url", "html", "fetch_error").mapInArrow(parsed_pages, "url string, fetch_error string, raw string, hrefs array<string>, blocks array<string>")
    failed = F.col("fetch_error").isNotNull()
    return parsed.select("url", "fetch_error", F.when(~failed, collapsed(F.col("raw"))).alias("text"), F.when(~failed, F.col("hrefs")).alias("hrefs"), F.when(~failed, F.col("blocks")).alias("blocks"))


def article_texts(extracted: DataFrame) -> DataFrame:
    return extracted.select("url", "text", "fetch_error")


def linked_slugs(extracted: DataFrame) -> DataFrame:
    """url and slug of each article that a page links to."""
    return extracted.select("url", F.explode("hrefs").alias("h")).select("url", link_slug(F.col("h")).alias("slug")).filter("slug <> ''").distinct()


def published_articles(sitemaps: DataFrame, base: str) -> DataFrame:
    """slug and url of the articles in sitemaps (body); each once."""
    return sitemap_urls(sitemaps).select(url_slug(F.col("loc"), base).alias("slug"), F.col("loc").alias("url")).filter("slug is not null").distinct()


def _missing_fields(kind: Column, item: Column) -> Column:
    """Errors for required fields that are absent, null or empty text."""
    chain = None
    for name, fields in REQUIRED_FIELDS.items():
        errors = []
        for f in fields:
            v = F.try_variant_get(item, f"$.{f}", "variant")
            gone = v.isNull() | F.is_variant_null(v) | (F.coalesce(F.schema_of_variant(v), F.lit("")) == "STRING") & (F.try_variant_get(item, f"$.{f}", "string") == "")
            errors.append(F.when(gone, F.lit(f'Falta el campo requerido "{f}" para el tipo {name}')))
        chain = F.when(kind == name, _texts(*errors)) if chain is None else chain.when(kind == name, _texts(*errors))
    return chain.otherwise(F.array().cast("array<string>"))


def audit_structured_data(extracted: DataFrame) -> DataFrame:
    """url, schema_type, is_valid and errors: a row for each object of each
    JSON-LD block, for each block that is no JSON, object or array of objects,
    and for each page without a block."""
    failed = F.col("fetch_error").isNotNull()
    bare = extracted.filter(failed | (F.size("blocks") == 0)).select("url", F.lit("none").alias("schema_type"), F.lit(False).alias("is_valid"), F.array(F.when(failed, F.concat(F.lit(PAGE_FAILED), "fetch_error")).otherwise(NO_JSON_LD)).alias("errors"))
    blocks = extracted.filter(~failed).select("url", F.explode("blocks").alias("b")).select("url", F.try_parse_json("b").alias("v"))
    shape = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    blocks = blocks.withColumn("k", F.when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("bad"))
    arrays = blocks.filter("k = 'array'").select("url", F.col("v").alias("block"))
    items = arrays.lateralJoin(extracted.sparkSession.tvf.variant_explode(F.col("block").outer())).select("url", F.col("value").alias("v"))
    objects = blocks.filter("k = 'object'").select("url", "v").unionByName(items)
    is_object = F.coalesce(F.schema_of_variant("v"), F.lit("")).startswith("OBJECT")
    kind = F.coalesce(F.try_variant_get("v", "$['@type']", "string"), F.lit("unknown"))
    good = objects.filter(is_object).select("url", kind.alias("schema_type"), "v")
    good = good.withColumn("errors", _missing_fields(F.col("schema_type"), F.col("v"))).select("url", "schema_type", (F.size("errors") == 0).alias("is_valid"), "errors")
    broken = blocks.filter("k = 'bad'").select("url").unionByName(objects.filter(~is_object).select("url"))
    broken = broken.select("url", F.lit("invalid-json").alias("schema_type"), F.lit(False).alias("is_valid"), F.array(F.lit(BAD_JSON_LD)).alias("errors"))
    return findings.union(bare, good, broken)
