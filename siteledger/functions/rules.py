"""Fixed dimensions: finding rules, region terms, required fields, fix targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Source, finding type, impact, effort, tier.
FINDING_RULES = [
    ("sitemap", "sitemap-malformed", 8, 3, 3),
    ("sitemap", "sitemap-out-of-domain", 6, 2, 2),
    ("sitemap", "sitemap-fetch-failed", 8, 3, 3),
    ("sitemap", "sitemap-stale-entries", 2, 1, 3),
    ("sitemap", "sitemap-other", 3, 3, 3),
    ("robots", "robots-missing-sitemap-directive", 4, 1, 1),
    ("robots", "robots-blocks-all", 10, 1, 1),
    ("robots", "robots-fetch-failed", 8, 3, 3),
    ("robots", "robots-other", 3, 3, 3),
    ("structuredData", "structured-data-missing", 5, 4, 2),
    ("structuredData", "structured-data-invalid-json", 4, 3, 2),
    ("structuredData", "structured-data-missing-field", 3, 3, 2),
    ("performance", "performance-lcp-red", 7, 6, 3),
    ("performance", "performance-cls-red", 7, 6, 3),
    ("performance", "performance-inp-red", 7, 6, 3),
    ("performance", "performance-low-score", 5, 6, 3),
    ("internalLinking", "internal-link-suggestion", 4, 2, 2),
    ("content", "content-cannibalization", 6, 7, 3),
    ("content", "content-declining", 6, 6, 3),
    ("content", "content-query-gap", 5, 5, 3),
    ("siteArchitecture", "site-architecture-template-performance", 7, 8, 3),
    ("siteArchitecture", "site-architecture-near-duplicate", 5, 7, 3),
    ("siteArchitecture", "site-architecture-missing-template", 6, 9, 3),
]

DAILY_SOURCES = ["sitemap", "robots", "structuredData", "performance", "internalLinking", "content"]
ALL_SOURCES = [*DAILY_SOURCES, "siteArchitecture"]

# Lower-case, unaccented names of regions.
REGION_TERMS = [
    "alava", "albacete", "alicante", "almeria", "asturias", "avila",
    "badajoz", "barcelona", "burgos", "caceres", "cadiz", "cantabria",
    "castellon", "ciudad real", "cordoba", "cuenca", "gerona", "girona",
    "granada", "guadalajara", "guipuzcoa", "huelva", "huesca",
    "islas baleares", "baleares", "jaen", "la coruna", "la rioja",
    "las palmas", "leon", "lerida", "lleida", "lugo", "madrid", "malaga",
    "murcia", "navarra", "orense", "ourense", "palencia", "pontevedra",
    "salamanca", "segovia", "sevilla", "soria", "tarragona", "tenerife",
    "teruel", "toledo", "valencia", "valladolid", "vizcaya", "zamora",
    "zaragoza",
]

# Required fields by schema.org type.
REQUIRED_FIELDS = {
    "Article": ["headline", "author", "datePublished"],
    "PhotographyBusiness": ["name", "address"],
    "BreadcrumbList": ["itemListElement"],
    "Organization": ["name", "url"],
    "WebSite": ["name", "url"],
    "DefinedTermSet": ["name"],
    "Dataset": ["name", "description"],
}

# Finding type, target file, whether a fixer exists.
FIX_TARGETS = [
    ("robots-missing-sitemap-directive", "src/app/robots.ts", True),
    ("robots-blocks-all", "src/app/robots.ts", True),
]


def finding_rules(spark: SparkSession) -> DataFrame:
    """23 rows, so always broadcast."""
    return spark.createDataFrame(FINDING_RULES, "rule_source string, finding_type string, impact int, effort int, tier int")


def region_terms(spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms or REGION_TERMS], "term string")


def fix_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIX_TARGETS, "finding_type string, target_file string, has_fixer boolean")
