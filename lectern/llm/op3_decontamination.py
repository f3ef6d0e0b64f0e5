"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

A document is contaminated by an item if one of its windows, as long as the item, is
similar to it: the weighted Jaccard similarity of their shingles of five words (each
weighs as often as it stands there) is 3/4 or more. Words are runs of letters and
digits, A-Z as a-z, so punctuation between them doesn't count. An item of fewer words
than five is one shingle. A document shorter than the item is one window.

1. Gate, without loss: a window this similar shares 6/7 of its shingles with the item,
   so documents are searched for the items' shingles (one join with the items, which
   are the query set; broadcast within ``BROADCAST_SHINGLES``), and only windows with
   that many places of one item go on. Each is found from its first place in one step.
2. SimHash: the window's 64-bit fingerprint, the majority of its shingles' hashes.
3. Multi-index: a fingerprint is eight bytes. Two within the radius of ``RADIUS`` = 23
   bits have a byte that differs in two bits or fewer, so an item is entered under the
   37 values near each of its bytes and a window asks under its own: every pair of
   fingerprints within the radius meets. At the similarity of 3/4 the distance is 11
   bits on average with a deviation of 3 to 4, so 23 bits are far out.
4. Exact: the similarity of each pair that met.

The benchmark (``BROADCAST_SHINGLES``) may grow: beyond the bounds the joins are
shuffled. Windows and matches grow with the contaminated passages alone.

Null and empty texts (documents or items) match nothing. The result has one row for
each document (doc_id and text) and item that match; equal rows are one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE, row_key, spark_count, staged
from .op10_license_scan import padded_line

RADIUS = 23
BROADCAST_SHINGLES = 500_000
BROADCAST_ITEMS = 1_000
BROADCAST_IDS = 300_000


def word_array(text: Column) -> Column:
    return F.filter(F.split(padded_line(text), " "), lambda w: w != "")


def hashes(words: Column, k: int) -> Column:
    """Hash of each run of k words, in order; empty if there are fewer words."""
    last = F.size(words) - (k - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(shingles: Column) -> Column:
    """SimHash: each bit is that of most shingles. Counts of two bits go through one fold, 32 bits for each, so no array overflows them."""
    n = F.size(shingles)
    out = []
    for lane in range(32):
        spread = lambda h, lane=lane: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftrightunsigned(h, 2 * lane + i).bitwiseAND(F.lit(1).cast("bigint")), 32 * i) for i in range(2)])
        count = F.aggregate(shingles, F.lit(0).cast("bigint"), _adder(spread))
        for i in range(2):
            most = F.shiftrightunsigned(count, 32 * i).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) * 2 > n
            out.append(F.when(most, F.lit(1 << (2 * lane + i) if 2 * lane + i < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return reduce(lambda a, b: a.bitwiseOR(b), out)


def _adder(spread):
    return lambda a, h: a + spread(h)


def item_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, k, m, sh, f): shingle width, number of shingles, their hashes, fingerprint."""
    words = benchmark.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(SHINGLE))
    sh = reduce(lambda a, k: a.when(width == k, hashes(F.col("w"), k)), range(2, SHINGLE + 1), F.when(width == 1, hashes(F.col("w"), 1)))
    items = words.select("item_id", width.alias("k"), sh.alias("sh")).withColumn("m", F.size("sh"))
    return staged(items.withColumn("f", fingerprint(F.col("sh"))))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over what both hold."""
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda t, x: t + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))


def _starts(places: Column, m: Column, last: Column, n: Column) -> Column:
    """First shingles of the windows that hold enough places; ``places`` is sorted."""
    size = F.least(m, n)
    need = F.ceil((m + size) * 3 / 7).cast("int")
    count = F.size(places)

    def windows(i: Column) -> Column:
        a, b = F.element_at(places, i), F.element_at(places, i + need - 1)
        low, high = F.greatest(b - size + 1, F.lit(1)), F.least(a, last)
        return F.when((b - a <= size - 1) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(count >= need, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), count - need + 1), windows)))).otherwise(F.array().cast("array<int>"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, key, item_id, similarity, first_word): documents and the items they hold; key is the text's hash."""
    items = item_table(benchmark)
    widths = sorted(r.k for r in items.select("k").distinct().collect())
    grams = items.select("item_id", "k", "m", F.explode(F.array_distinct("sh")).alias("h"))
    few = spark_count(grams, BROADCAST_SHINGLES) is not None
    words = docs.where("text is not null").select("doc_id", row_key().alias("key"), word_array(F.col("text")).alias("w"))
    hits = None
    for k in widths:
        at = words.select("doc_id", "key", (F.size("w") - (k - 1)).alias("n"), F.posexplode(hashes(F.col("w"), k)).alias("p", "h"))
        g = grams.where(F.col("k") == k)
        got = at.join(F.broadcast(g) if few else g, "h").select("doc_id", "key", "n", "item_id", "k", "m", (F.col("p") + 1).alias("p"))
        hits = got if hits is None else hits.union(got)
    empty = "doc_id bigint, key bigint, item_id bigint, similarity double, first_word bigint"
    if hits is None:
        return docs.sparkSession.createDataFrame([], empty)
    places = hits.groupBy("doc_id", "key", "n", "item_id", "k", "m").agg(F.sort_array(F.collect_set("p")).alias("places"))
    last = F.greatest(F.col("n") - F.col("m") + 1, F.lit(1))
    wins = staged(places.select("doc_id", "key", "k", "m", "item_id", F.explode(_starts(F.col("places"), F.col("m"), last, F.col("n"))).alias("s")).distinct())
    named = wins.groupBy("doc_id", "key").agg(F.collect_set(F.struct("item_id", "k", "m", "s")).alias("wins"))
    some = spark_count(wins.select("doc_id", "key").distinct(), BROADCAST_IDS) is not None
    ids = wins.select("doc_id", "key").distinct()
    # key first: rows of other texts are not split into words
    texts = docs.where("text is not null").select("doc_id", row_key().alias("key"), "text").alias("d")
    ids = (F.broadcast(ids) if some else ids).alias("i")
    texts = texts.join(ids, F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("d.key") == F.col("i.key"))).select("d.doc_id", "d.key", word_array(F.col("d.text")).alias("w"))
    texts = texts.groupBy("doc_id", "key").agg(F.first("w").alias("w")).select("doc_id", "key", *[hashes(F.col("w"), k).alias(f"sh{k}") for k in widths]).alias("t")
    n = named.alias("n")
    both = n.join(texts, F.col("n.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("n.key") == F.col("t.key"))).select("n.doc_id", "n.key", F.explode("n.wins").alias("x"), *[f"t.sh{k}" for k in widths])
    sh = reduce(lambda a, k: a.when(F.col("x.k") == k, F.slice(F.col(f"sh{k}"), F.col("x.s"), F.col("x.m"))), widths[1:], F.when(F.col("x.k") == widths[0], F.slice(F.col(f"sh{widths[0]}"), F.col("x.s"), F.col("x.m"))))
    windows = staged(both.select("doc_id", "key", "x.item_id", "x.k", "x.m", "x.s", sh.alias("win")).withColumn("f", fingerprint(F.col("win"))))

    byte = lambda f, b: F.shiftrightunsigned(F.col(f), 8 * b).bitwiseAND(F.lit(255).cast("bigint")).cast("int")
    index = items.select("item_id", "k", "m", F.col("f").alias("fi"), F.posexplode(F.array(*[byte("f", b) for b in range(8)])).alias("b", "v"))
    near = F.array(*[F.lit(x) for x in range(256) if bin(x).count("1") <= 2])
    # a window asks for the items of its gate only, so windows never meet all items of their size
    index = index.select("item_id", "fi", "b", F.explode(F.transform(near, lambda x: F.col("v").bitwiseXOR(x))).alias("v"))
    index = F.broadcast(index) if spark_count(items, BROADCAST_ITEMS) is not None else index
    asked = windows.select("doc_id", "key", "item_id", "s", "f", F.posexplode(F.array(*[byte("f", b) for b in range(8)])).alias("b", "v"))
    met = asked.join(index, ["item_id", "b", "v"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("fi"))) <= RADIUS)
    met = met.select("doc_id", "key", "s", "item_id").distinct().alias("c")
    w = windows.alias("w")
    pairs = met.join(w, F.col("c.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("c.key") == F.col("w.key")) & (F.col("c.item_id") == F.col("w.item_id")) & (F.col("c.s") == F.col("w.s")))
    shi = items.select("item_id", F.col("sh").alias("item"))
    pairs = pairs.select("c.doc_id", "c.key", "c.item_id", "c.s", "w.win").join(F.broadcast(shi) if spark_count(items, BROADCAST_ITEMS) is not None else shi, "item_id")
    pairs = pairs.withColumn("o", multiset_overlap(F.col("win"), F.col("item"))).withColumn("u", F.size("win") + F.size("item") - F.col("o")).where("4 * o >= 3 * u")
    sim = F.col("o") / F.col("u")
    return staged(pairs.groupBy("doc_id", "key", "item_id").agg(F.max(sim).alias("similarity"), F.min_by(F.col("s") - 1, F.struct(-sim, F.col("s"))).cast("long").alias("first_word")))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).select("doc_id", "item_id", F.bround("similarity", 6).alias("similarity"), "first_word")


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ig AS (SELECT item_id, least(len(w), 5) AS k, w, len(w) - least(len(w), 5) + 1 AS m FROM i WHERE len(w) > 0),
ix AS (SELECT item_id, k, m, unnest(list_transform(range(1, (m + 1)::BIGINT), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM ig),
ic AS (SELECT item_id, k, m, g, count(*) AS c FROM ix GROUP BY ALL),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dx AS (SELECT d.doc_id, kk.k, len(w) - kk.k + 1 AS n, unnest(range(1, (len(w) - kk.k + 2)::BIGINT)) AS p,
              unnest(list_transform(range(1, (len(w) - kk.k + 2)::BIGINT), lambda q: array_to_string(w[q:q + kk.k - 1], ' '))) AS g
       FROM d, (SELECT DISTINCT k FROM ig) kk WHERE len(w) >= kk.k),
h AS (SELECT DISTINCT dx.doc_id, ic.item_id, dx.k, ic.m, dx.n, dx.p FROM dx JOIN ic ON dx.k = ic.k AND dx.g = ic.g),
s AS (SELECT DISTINCT doc_id, item_id, k, m, n, unnest(range(greatest(p - m + 1, 1)::BIGINT, (least(p, greatest(n - m + 1, 1)) + 1)::BIGINT)) AS s FROM h),
wc AS (SELECT s.doc_id, s.item_id, s.k, s.m, s.s, dx.g, count(*) AS c, any_value(least(s.m, s.n)) AS sw FROM s JOIN dx ON dx.doc_id = s.doc_id AND dx.k = s.k AND dx.p BETWEEN s.s AND s.s + s.m - 1 GROUP BY ALL),
o AS (SELECT wc.doc_id, wc.item_id, wc.s, any_value(wc.m + wc.sw) AS t, sum(least(wc.c, ic.c)) AS o FROM wc JOIN ic ON ic.item_id = wc.item_id AND ic.g = wc.g GROUP BY ALL),
b AS (SELECT doc_id, item_id, s, o::DOUBLE / (t - o) AS sim FROM o WHERE 4 * o >= 3 * (t - o))
SELECT doc_id, item_id, round(max(sim), 6) AS similarity, (arg_min(s, (-sim, s)) - 1)::BIGINT AS first_word FROM b GROUP BY doc_id, item_id
"""
