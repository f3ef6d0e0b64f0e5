"""URL filter by a temporal list join, in DataFrame operations only.

A list is a log of dated entries: a pattern is added to a category or removed from
it. An entry holds until the next one of its pattern and category, so the log becomes
validity intervals. A capture is judged by the entries that were active when it was
fetched: an as-of join of every capture's keys with the intervals.

Patterns are of two kinds: ``domain`` (the host itself and all hosts below it) and
``prefix`` (host and leading path segments). A capture's keys are the suffixes of its
host with two labels or more, and its host with each leading part of its path.

Each distinct (url, time) is judged once. The intervals are one row for each pattern:
broadcast if there are at most ``BROADCAST_ROWS``, else joined with salted keys, so a
host with a third of all captures is shared out.

Urls are compared in lower case without scheme, user, port, query and fragment, and
without a trailing slash. Null or hostless urls match nothing and are not blocked; a
null time is before every entry. Two entries of one pattern, category and time: the
removal wins. Repeated rows are kept. Empty tables give empty results (no entries: nothing
is blocked). Kept columns may have any names but those of the three that are added.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach

#: The list of the registered query: pattern, kind, category, time, action.
ENTRIES = (
    ("spam-farm.example.org", "domain", "spam", "2024-01-15 00:00:00", "add"),
    ("spam-farm.example.org", "domain", "spam", "2024-06-01 00:00:00", "remove"),
    ("spam-farm.example.org", "domain", "spam", "2024-08-20 12:00:00", "add"),
    ("cheap-pills.example.com", "domain", "pharma", "2024-02-01 00:00:00", "add"),
    ("cheap-pills.example.com", "domain", "spam", "2024-05-01 00:00:00", "add"),
    ("cheap-pills.example.com", "domain", "spam", "2024-09-01 00:00:00", "remove"),
    ("adult-x.example.net", "domain", "adult", "2023-11-01 00:00:00", "add"),
    ("tionsh.example.net", "domain", "spam", "2024-03-01 00:00:00", "add"),
    ("tionsh.example.net", "domain", "spam", "2024-03-15 00:00:00", "remove"),
    ("blog.ththan.example.net/en", "prefix", "scraper", "2024-04-01 00:00:00", "add"),
    ("thther.example.org/fr", "prefix", "scraper", "2024-01-01 00:00:00", "add"),
    ("thther.example.org/fr", "prefix", "scraper", "2024-10-01 00:00:00", "remove"),
)
_URL = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]*)?([^?#]*)"


def clean_url(url: Column) -> Column:
    """host and path in lower case, null without a host."""
    low = F.lower(F.trim(url))
    host = F.nullif(F.rtrim(F.regexp_extract(low, _URL, 1), F.lit(".")), F.lit(""))
    return F.concat(host, F.regexp_replace(F.regexp_extract(low, _URL, 2), "/+$", ""))


def keys(clean: Column) -> Column:
    """Distinct keys of a cleaned url: 'd:' host suffixes, 'p:' host with leading segments."""
    parts = F.split(clean, "/")
    labels = F.split(F.element_at(parts, 1), r"\.")
    host = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("p:"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(clean.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(host, prefix)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, spans): for each pattern, when it is active in which category. ``entries``: pattern, kind, category, at, action."""
    e = entries.where("pattern is not null and at is not null")
    key = F.concat(F.when(F.col("kind") == "domain", F.lit("d:")).otherwise(F.lit("p:")), F.regexp_replace(F.lower("pattern"), "/+$", ""))
    # of entries at one time the removal counts
    e = e.groupBy(key.alias("key"), "category", "at").agg(F.max((F.col("action") == "remove").cast("int")).alias("off"))
    e = e.withColumn("until", F.lead("at").over(Window.partitionBy("key", "category").orderBy("at"))).where("off = 0")
    return e.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "until", "category"))).alias("spans"))


def filter_urls(captures: DataFrame, entries: DataFrame, *keep: str) -> DataFrame:
    """Adds blocked, categories and pattern (the longest active one) to the columns ``keep`` of ``captures`` (url, fetched_at)."""
    # kept columns travel under numbers, so any names will do; a url without a host can't match and needs no join
    rows = captures.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.when(clean_url(F.col("url")).isNotNull(), F.col("url")).alias("_url"), F.col("fetched_at").alias("_at"))
    once = rows.where("_url is not null").select("_url", "_at").distinct().withColumn("key", F.explode(keys(clean_url(F.col("_url")))))
    met = attach(once, intervals(entries), "key", salt="_url")
    active = F.filter("spans", lambda s: (s["at"] <= F.col("_at")) & (s["until"].isNull() | (F.col("_at") < s["until"])))
    met = met.withColumn("active", active).where(F.size("active") > 0)
    pattern = F.max_by(F.substring("key", 3, 1 << 20), F.struct(F.length("key"), F.col("key")))
    verdict = met.groupBy("_url", "_at").agg(F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("active", lambda s: s["category"])))))).alias("categories"), pattern.alias("pattern"))
    v = verdict.alias("v")
    r = rows.withColumn("_salt", F.when(F.col("_url").isNull(), F.xxhash64(F.monotonically_increasing_id()))).alias("r")
    # null urls are spread by a salt that nothing matches
    out = r.join(v.withColumn("_salt", F.lit(None).cast("long")).alias("v"), (F.col("r._url") == F.col("v._url")) & F.col("r._at").eqNullSafe(F.col("v._at")) & F.col("r._salt").eqNullSafe(F.col("v._salt")), "left")
    return out.select(*[F.col(f"r._k{i}") for i in range(len(keep))], F.col("v.categories").isNotNull().alias("blocked"), F.coalesce("v.categories", F.lit("")).alias("categories"), F.col("v.pattern")).toDF(*keep, "blocked", "categories", "pattern")


def entry_table(spark: SparkSession) -> DataFrame:
    rows = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in ENTRIES)
    return spark.sql(f"SELECT pattern, kind, category, CAST(at AS TIMESTAMP) AS at, action FROM VALUES {rows} AS t(pattern, kind, category, at, action)")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """``pages`` holds no time of fetching: one is made up from page_id, every minute of 2024 in turn."""
    minutes = F.pmod(F.col("page_id") * 3571, F.lit(527_040))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60).alias("fetched_at"))
    out = filter_urls(pages, entry_table(spark), "page_id", "url", "fetched_at")
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


_VALUES = ", ".join("(" + ", ".join(f"'{x}'" for x in e) + ")" for e in ENTRIES)
ORACLE = rf"""
WITH e AS (SELECT (CASE WHEN kind = 'domain' THEN 'd:' ELSE 'p:' END) || lower(pattern) AS key, category, since::TIMESTAMP AS since, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS off
           FROM (VALUES {_VALUES}) t(pattern, kind, category, since, action) GROUP BY ALL),
spans AS (SELECT * FROM (SELECT key, category, since, lead(since) OVER (PARTITION BY key, category ORDER BY since) AS until, off FROM e) WHERE off = 0),
p AS (SELECT page_id, url, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (page_id * 3571 % 527040)::INT AS t,
             regexp_extract(lower(trim(url)), '{_URL}', 1) AS h, regexp_replace(regexp_extract(lower(trim(url)), '{_URL}', 2), '/+$', '') AS path FROM pages),
k AS (SELECT page_id, t, unnest(list_transform(range(1, greatest(len(string_split(h, '.')), 2)), lambda i: 'd:' || array_to_string(string_split(h, '.')[i:], '.'))) AS key FROM p WHERE h <> ''
      UNION SELECT page_id, t, unnest(list_transform(range(1, len(string_split(h || path, '/')) + 1), lambda i: 'p:' || array_to_string(string_split(h || path, '/')[:i], '/'))) FROM p WHERE h <> ''),
m AS (SELECT DISTINCT page_id, k.key, category FROM k JOIN spans s ON k.key = s.key AND s.since <= k.t AND (s.until IS NULL OR k.t < s.until)),
v AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, substr(arg_max(key, (length(key), key)), 3) AS pattern FROM m GROUP BY page_id)
SELECT p.page_id, p.url, strftime(p.t, '%Y-%m-%d %H:%M:%S') AS fetched_at, v.page_id IS NOT NULL AS blocked, coalesce(v.categories, '') AS categories, v.pattern
FROM p LEFT JOIN v USING (page_id)
"""
