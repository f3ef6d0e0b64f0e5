"""Query registry of the engine's own operators, each over whole tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import catalog_state
from .functions import formulas as fm
from .functions import text as t
from .operators import blueprint as bp
from .operators import agent, diagrams, export, html, metrics, pages, practice, retrieve, schedule, segment, tools, verify, writing
from .sources import readers

NOW = "2024-01-29 00:00:00"


def _read(spark: SparkSession, sf_dir: str, *tables: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in tables]


def content_ids(spark, d):
    (docs,) = _read(spark, d, "documents")
    return docs.select("doc_id", t.content_id(F.col("text").cast("binary")).alias("content_id"), F.length(t.squash(F.col("text"))).cast("long").alias("squashed"), F.length("text").cast("long").alias("chars"))


def search_bm25(spark, d):
    docs, bench = _read(spark, d, "documents", "benchmark")
    return retrieve.bm25(docs, bench, "doc_id", "item_id", 5)


def search_cosine(spark, d):
    (v,) = _read(spark, d, "embeddings")
    return retrieve.cosine_top(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), top=10)


def search_fused(spark, d):
    """Two rankings of the same texts, by BM25 and by shared stems, fused by rank."""
    docs, bench = _read(spark, d, "documents", "benchmark")
    words = retrieve.bm25(docs, bench, "doc_id", "item_id", 20)
    stems = docs.select("doc_id", F.explode(t.content_stems(F.col("text"))).alias("stem"))
    asked = bench.select("item_id", F.explode(t.content_stems(F.col("text"))).alias("stem"))
    shared = asked.join(stems, "stem").groupBy("item_id", "doc_id").agg(F.count("*").cast("double").alias("score"))
    return retrieve.fuse([words, retrieve.best(shared, "item_id", "doc_id", 20)], "item_id", "doc_id", 5)


def search_hybrid(spark, d):
    """Keyword and vector rankings of whole documents, fused; vectors are made of the tokens."""
    docs, bench = _read(spark, d, "documents", "benchmark")
    return retrieve.search(docs.select("doc_id", "text"), bench, "doc_id", "item_id", 5, stem=False)


def search_stemmed(spark, d):
    """Items against documents by Porter stems without accents."""
    docs, bench = _read(spark, d, "documents", "benchmark")
    return retrieve.bm25(docs, bench, "doc_id", "item_id", 5, stem=True)


def item_blueprint(spark, d):
    """Items as questions, matched to sections (hundreds of documents) by search, two sections each."""
    docs, bench = _read(spark, d, "documents", "benchmark")
    hits = retrieve.bm25(docs, bench, "doc_id", "item_id", bp.DEPTH)
    hits = hits.select("item_id", F.lit("d").alias("doc_id"), F.floor(F.col("doc_id") / 100).cast("string").alias("sid"), "rank")
    asked = bench.select("item_id", (F.col("item_id") % 11).alias("marks"), (2016 + F.col("item_id") % 5).cast("int").alias("year"))
    return bp.blueprint(bp.matched(asked, hits, "item_id", (2.0, 1.0))).select("sid", "weight", "share", "marks", "questions")


#: Pairs of formulas that a task compares.
COMPARED = 10_000


def formula_values(spark, d):
    """Formulas made of each part's key: whether values and relations are the same, and whether relations contradict."""
    (p,) = _read(spark, d, "part")
    # a row costs far more to compare than to read, so rows are dealt out by number and not by the bytes of their file
    p = p.select("p_partkey").repartition(max(1, -(-p.count() // COMPARED)))
    k, n = F.col("p_partkey") + 1, F.col("p_partkey") % 100
    tenths = F.floor(n * 10 / 8)
    written = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    value = F.concat(F.lit("\\frac{"), n.cast("string"), F.lit("}{8}"))
    relation = F.concat(F.lit("y = "), k.cast("string"), F.lit(" x z"))
    solved = F.concat(F.lit("x = \\frac{y}{"), (k + k % 2).cast("string"), F.lit(" z}"))
    return p.select("p_partkey", fm.same_formula(value, written).alias("same_value"), fm.comparing(relation, solved).alias("of")).select("p_partkey", "same_value", F.col("of.same").alias("same_relation"), F.col("of.contrary").alias("contrary"))


def hit_rates(spark, d):
    docs, bench = _read(spark, d, "documents", "benchmark")
    gold = _gold(docs, bench)
    return metrics.hit_rates(retrieve.bm25(docs, bench, "doc_id", "item_id", 10), gold, "item_id", "doc_id")


def _gold(docs, bench):
    """Documents that hold an item whole: met by inner words of the item (an item of few words: by every document), then checked."""
    words = bench.select("item_id", F.col("text").alias("item"), F.split("text", " ").alias("w"))
    long = F.size("w") >= 6
    # only words between spaces within the item stand whole in a document that holds it
    a = words.where(long).select("item_id", "item", F.array_join(F.slice("w", 2, 4), " ").alias("k"))
    d = docs.select("doc_id", "text", F.split("text", " ").alias("w"))
    b = d.where("size(w) >= 4").select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " ")))).alias("k"))
    met = b.join(a, "k").select("doc_id", "item_id", "item").distinct()
    held = met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item"))).select("item_id", "doc_id")
    # short items are a stated query set against all rows; there are few of them
    short = docs.select("doc_id", "text").join(words.where(~long).select("item_id", "item"), F.contains("text", F.col("item"))).select("item_id", "doc_id")
    return held.union(short)


def chunk_stats(spark, d):
    (docs,) = _read(spark, d, "documents")
    c = segment.chunks(docs, "doc_id")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).cast("long").alias("longest"), F.sum(F.length(F.regexp_replace("chunk", r"\s+", ""))).alias("kept_chars"))


def sentence_counts(spark, d):
    (docs,) = _read(spark, d, "documents")
    return docs.select("doc_id", F.size(t.sentences(F.col("text"))).cast("long").alias("sentences"))


def source_support(spark, d):
    """How far each item's stems are supported by the documents that share any."""
    docs, bench = _read(spark, d, "documents", "benchmark")
    stems = docs.select("doc_id", F.explode(t.content_stems(F.col("text"))).alias("stem"))
    asked = bench.select("item_id", t.content_stems(F.col("text")).alias("s")).where("size(s) >= 3")
    hits = asked.select("item_id", F.size("s").alias("n"), F.explode("s").alias("stem")).join(stems, "stem").groupBy("item_id", "doc_id").agg((F.count("*") / F.first("n")).alias("r"))
    return hits.where(F.col("r") >= verify.LEAST_SUPPORT).groupBy("item_id").agg(F.count("*").alias("documents"), F.bround(F.max("r"), 4).alias("best"))


def copied_items(spark, d):
    """Items whose stems overlap by Jaccard 0.7 or more, met through common stems."""
    (b,) = _read(spark, d, "benchmark")
    q = b.select("item_id", "text", F.lit(1).alias("sid"))
    return verify.nearest_copy(q, q.withColumnRenamed("item_id", "other_id"), "item_id", "other_id", "sid").select("item_id", F.bround("nearest", 4).alias("nearest"), (F.col("nearest") >= verify.COPY).alias("copy"))


def _attempts(spark, d):
    (e,) = _read(spark, d, "events")
    awarded = F.pmod(F.floor(F.abs("value") * 100), F.lit(6)).cast("long")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("question"), F.col("event_type").alias("section"), awarded.alias("awarded"), F.lit(5).cast("long").alias("most"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("due_at"))


def latest_attempts(spark, d):
    return practice.latest(_attempts(spark, d), "question", "section").select("question", "section", "id", "awarded")


def due_retries(spark, d):
    return practice.due(_attempts(spark, d), F.lit(NOW).cast("timestamp"), "question", "section").select("question", "section", "id", "awarded")


def section_mastery(spark, d):
    return practice.mastery(practice.latest(_attempts(spark, d), "question", "section"), "section")


def weak_topics(spark, d):
    m = practice.mastery(practice.latest(_attempts(spark, d), "question", "section"), "section")
    return practice.weak_topics(m, None, "section", 3)


def exam_blueprint(spark, d):
    """Orders as questions, their lines as the sections they match: weights with recency, shares."""
    return bp.blueprint(_matches(spark, d)).select("sid", "weight", "share", "marks", "questions")


def _matches(spark, d):
    o, li = _read(spark, d, "orders", "lineitem")
    line = li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    return line.select(F.col("l_orderkey").alias("question"), F.pmod(F.col("l_orderkey"), F.lit(11)).cast("long").alias("marks"), F.year("o_orderdate").alias("year"), F.lit("d").alias("doc_id"), F.concat(F.pmod(F.col("l_suppkey"), F.lit(9)).cast("string"), F.lit("."), F.pmod(F.col("l_suppkey"), F.lit(4)).cast("string")).alias("sid"), rank.alias("rank"), F.col("l_quantity").cast("double").alias("score"))


def chapter_rollup(spark, d):
    return bp.chapter_shares(bp.blueprint(_matches(spark, d)))


def label_rates(spark, d):
    """How often labels hold, overall and by language."""
    docs, labels = _read(spark, d, "documents", "labels")
    j = labels.join(docs.select("doc_id", "lang"), "doc_id")
    j.createOrReplaceTempView("_lectern_labels")
    return spark.sql("SELECT coalesce(lang, 'all') AS lang, count(*) AS n, bround(avg(quality), 4) AS quality, bround(avg(toxic), 4) AS toxic FROM _lectern_labels GROUP BY GROUPING SETS ((lang), ())")


def chat_window(spark, d):
    (c,) = _read(spark, d, "conversations")
    return readers.last_turns(c).select("conv_id", "turn", "role", "back")


def item_error_rates(spark, d):
    """Character error of each item's letters and digits against the next item's, over whole texts."""
    return _error_rates(spark, d, t.squash)


def item_text_error_rates(spark, d):
    """Character error of each item's whole text against the next item's, one space kept for what is no letter or digit."""
    return _error_rates(spark, d, t.spaced)


def _error_rates(spark, d, plain):
    (b,) = _read(spark, d, "benchmark")
    x = b.select("item_id", plain(F.col("text")).alias("a"))
    y = x.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return x.join(y, "item_id").select("item_id", F.bround(t.error_rate(F.col("a"), F.col("b")), 6).alias("cer"))


def hit_rates_by_parity(spark, d):
    """Hit rates of the items overall and by parity of their ids, with hundreds of doc_ids as chapters."""
    docs, bench = _read(spark, d, "documents", "benchmark")
    chapter = F.floor(F.col("doc_id") / 100).alias("chapter")
    ranked = retrieve.bm25(docs, bench, "doc_id", "item_id", 10).select("item_id", "doc_id", chapter, "rank")
    gold = _gold(docs, bench).select("item_id", "doc_id", chapter, F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return metrics.hit_rates_by(ranked, gold, "item_id", "doc_id", "chapter", "kind")


def label_catch_rates(spark, d):
    """How often low quality catches what is toxic, and how often it drops what isn't."""
    (labels,) = _read(spark, d, "labels")
    return metrics.catch_rates(labels.select((F.col("toxic") == 1).alias("bad"), (F.col("quality") == 0).alias("dropped")), "bad", "dropped")


def event_threshold(spark, d):
    """The value below which dropping events catches most errors over what it drops wrongly."""
    (e,) = _read(spark, d, "events")
    return metrics.best_threshold(e.select("value", (F.col("event_type") == "error").alias("bad")), "value", "bad", [float(x) for x in range(0, 101, 5)])


def leak_check(spark, d):
    """The document that most items find first, and whether that is too often."""
    docs, bench = _read(spark, d, "documents", "benchmark")
    top = metrics.leak_share(retrieve.bm25(docs, bench, "doc_id", "item_id", 1), "doc_id")
    return top.select("share", "leak")


def event_rates(spark, d):
    """By kind of event: rates of flags, a share of sums, a median."""
    (e,) = _read(spark, d, "events")
    x = e.select("event_type", (F.col("value") > 1).alias("above_one"), (F.col("user_id") % 2 == 0).alias("even_user"), F.col("event_id").alias("part"), (F.col("event_id") + F.col("user_id")).alias("whole"), "value")
    return metrics.rates(x, "event_type", ["above_one", "even_user"], "part", "whole", "value")


#: The calls which call_scores expects of every nation.
EXPECTED = [{"name": "describe", "args": {"name": {"$contains": ["a"]}, "region": {"$range": [1, 3]}, "note": {"$optional": {"$contains": "x"}}}}]


def call_scores(spark, d):
    """A call made up of each nation's row as a reply, recovered and scored against ``EXPECTED``."""
    (n,) = _read(spark, d, "nation")
    body = F.concat(F.lit('{"name": "describe", "arguments": {"name": "'), "n_name", F.lit('", "region": '), F.col("n_regionkey").cast("string"), F.lit("}}"))
    reply = F.concat(F.lit("<think>hm</think>ok <tool_call>"), body, F.lit("</tool_call>"))
    calls = agent.text_calls(agent.strip_thinking(reply))
    return n.select("n_nationkey", F.size(calls).cast("long").alias("calls"), agent.call_score(EXPECTED, calls).alias("s")).select("n_nationkey", "calls", "s.tools", "s.arguments")


def refusals(spark, d):
    """Replies of each conversation judged as answers: the mark alone refuses, later it makes a reply mixed."""
    (c,) = _read(spark, d, "conversations")
    r = c.select("conv_id", "turn", agent.refusal(F.col("text"), "the", F.col("turn") % 2 == 0, F.array(F.lit("a"))).alias("r"))
    return r.select("conv_id", "turn", "r.refused", "r.mixed", "r.correct")


def retry_schedule(spark, d):
    """Memory state and next due time of each user's questions, by event type."""
    a = _attempts(spark, d).withColumn("answered_at", F.col("due_at") - F.expr("INTERVAL 1 DAY"))
    grade = practice.rating(F.col("awarded"), F.col("most"))
    a = a.withColumn("grade", F.when(grade == "good", 3).when(grade == "hard", 2).otherwise(1))
    return schedule.schedule(a, "question", "section", places=3).select("question", "section", "reviews", "stability", "difficulty")


def nation_mindmap(spark, d):
    """A map of each region with its nations as branches."""
    r, n = _read(spark, d, "region", "nation")
    b = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("label"), F.array().cast("array<string>").alias("children")))).alias("b"))
    return r.join(b, F.col("r_regionkey") == F.col("n_regionkey")).select("r_regionkey", diagrams.mindmap(F.col("r_name"), F.col("b")).alias("diagram"))


def deck_ids(spark, d):
    (n,) = _read(spark, d, "nation")
    return n.select("n_nationkey", export.stable_id(F.col("n_name")).alias("deck_id"), export.safe_name(F.concat(F.lit("Ch. "), "n_name")).alias("file"))


def tool_faults(spark, d):
    """A call for questions made of each part's size: too many, or of an unknown kind."""
    (p,) = _read(spark, d, "part")
    size = F.col("p_size").cast("string")
    call = F.concat(F.lit('{"topic": "t", "count": '), size, F.lit(', "marks": 2, "question_type": "'), F.when(F.col("p_partkey") % 2 == 0, "short").otherwise("odd"), F.lit('"}'))
    return p.select("p_partkey", tools.call_fault(F.lit("generate_questions"), call).alias("fault"))


def diagram_problems(spark, d):
    """A flowchart for each nation with an arrow to the node of its region, which stands in it only for the first three."""
    (n,) = _read(spark, d, "nation")
    text = F.concat(F.lit('flowchart TD\n    n0["'), "n_name", F.lit('"]\n    n1["x"]\n    n2["n7"]\n    n0 --> n'), F.col("n_regionkey").cast("string"))
    return n.select("n_nationkey", F.array_join(diagrams.problems(F.lit("flowchart"), text), "; ").alias("problems"))


def calculations(spark, d):
    (p,) = _read(spark, d, "part")
    e = F.concat(F.lit("("), F.col("p_partkey").cast("string"), F.lit(" + 2) * "), F.col("p_size").cast("string"), F.lit(" - 2**3"))
    return p.select("p_partkey", tools.calculated(e).alias("value"))


def question_shares(spark, d):
    """337 questions spread over the nations as sections, at most ten a call."""
    (n,) = _read(spark, d, "nation")
    return writing.question_calls(n.select(F.col("n_name").alias("sid"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("text")), 337).select("sid", "call", "wanted")


def marked_answers(spark, d):
    """An answer for each customer, right as a formula for even keys; the model of this query finds the second point in every answer."""
    (c,) = _read(spark, d, "customer")
    k = F.col("c_custkey") + 2
    odd = (F.col("c_custkey") % 2).cast("string")
    answer = F.concat(F.lit("y = "), k.cast("string"), F.lit(" x + "), odd)
    point = F.concat(F.lit("States $x = y/"), k.cast("string"), F.lit("$"))
    rows = c.select("c_custkey", F.lit("q").alias("question"), F.array(point, F.lit("names units"), F.lit("draws it")).alias("marking_points"), answer.alias("answer"), F.lit(6).alias("most"))
    marked = writing.grade_answers(rows, lambda p: F.lit('{"points_met": [false, true, false], "feedback": "ok"}'), "c_custkey")
    return marked.select("c_custkey", "awarded", F.size("missing").cast("long").alias("missing"), F.get("by_formula", F.lit(0)).alias("formula"))


def cleaned_readings(spark, d):
    """Readings made of the parts' names: spaces only where LaTeX needs them, and whether they may be formulas."""
    (p,) = _read(spark, d, "part")
    raw = F.concat(F.lit(" \\text { "), F.replace("p_name", F.lit("#"), F.lit("")), F.lit(" }  \\bf v "))
    return p.select("p_partkey", pages.clean_latex(raw).alias("latex"), pages.plausible(pages.clean_latex(raw)).alias("plausible"))


def note_pages(spark, d):
    """The nations of each region as sections of one page of notes."""
    (n,) = _read(spark, d, "nation")
    text = F.concat(F.lit("# "), "n_name", F.lit("\n\n**a** < b"))
    notes = n.select("n_regionkey", F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("sid"), F.col("n_name").alias("title"), text.alias("markdown"), F.lit(None).cast("array<struct<format:string,text:string>>").alias("visuals"))
    return html.to_html(notes, "n_regionkey", title="Nations").select("n_regionkey", F.regexp_extract("html", "(?s)<main>(.*)</main>", 1).alias("main"))


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)
_CLEAN = r"regexp_replace(regexp_replace(text, '(?s)\$\$.*?\$\$|\$[^$]*\$|\\\(.*?\\\)|\\\[.*?\\\]', ' ', 'g'), '(?i)\(\s*\d+\s*marks?[^)]*\)', ' ', 'g')"
_STEMS = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({_CLEAN}), '[a-z][a-z-]{{3,}}'), lambda w: w NOT IN ({_STOP})), lambda w: w[1:6]))"
_BM25 = f"""
t AS (SELECT doc_id, {_TOK} AS t FROM documents), size AS (SELECT count(*) AS total, avg(len(coalesce(t, []))) AS mean FROM t),
q AS (SELECT item_id, unnest(list_distinct({_TOK})) AS term FROM benchmark),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t), tf AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM p GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, doc_id, round_even(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term), size GROUP BY item_id, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""
_ATT = "a AS (SELECT event_id AS id, user_id AS question, event_type AS section, (floor(abs(value) * 100)::BIGINT % 6)::BIGINT AS awarded, 5::BIGINT AS most, ts + INTERVAL 1 DAY AS due_at FROM events), l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY question, section ORDER BY id DESC) = 1), m AS (SELECT section, count(*) AS attempts, sum(awarded)::BIGINT AS awarded, sum(most)::BIGINT AS most, round_even(sum(awarded)::DOUBLE / sum(most), 4) AS score FROM l GROUP BY section)"
_BLUE = """m AS (SELECT l_orderkey AS question, l_orderkey % 11 AS marks, year(o_orderdate) AS year, (l_suppkey % 9)::VARCHAR || '.' || (l_suppkey % 4)::VARCHAR AS sid,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rank, l_quantity::DOUBLE AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT *, (CASE WHEN marks = 0 THEN 1 ELSE marks END) * (1 + 0.5 * coalesce((year - min(year) OVER ())::DOUBLE / nullif(max(year) OVER () - min(year) OVER (), 0), 0)) * score / sum(score) OVER (PARTITION BY question) AS part FROM m),
s AS (SELECT sid, sum(part) AS weight, sum(CASE WHEN rank = 1 THEN marks ELSE 0 END)::BIGINT AS marks, count(*) FILTER (rank = 1) AS questions FROM w GROUP BY sid),
b AS (SELECT sid, round_even(weight, 4) AS weight, round_even(weight / sum(weight) OVER (), 4) AS share, marks, questions FROM s)"""


def oracle_sql() -> dict[str, str]:
    w = schedule.W
    factor = f"({schedule.FACTOR!r})"
    easy = f"({w[4]} - exp({w[5]} * 3) + 1)"
    soon = f"exp({w[17]} * (g - 3 + {w[18]})) * pow(s, -{w[19]})"
    r = f"pow(1 + {factor} * days / s, -{w[20]})"
    kept = f"s * (1 + exp({w[8]}) * (11 - d) * pow(s, -{w[9]}) * (exp((1 - {r}) * {w[10]}) - 1) * CASE WHEN g = 2 THEN {w[15]}::DOUBLE ELSE 1 END)"
    lost = f"least({w[11]} * pow(d, -{w[12]}) * (pow(s + 1, {w[13]}) - 1) * exp((1 - {r}) * {w[14]}), s / exp({w[17]} * {w[18]}))"
    fsrs = f"""WITH RECURSIVE {_ATT}, v AS (SELECT question, section, due_at AS tm, (CASE WHEN awarded >= most THEN 3 WHEN awarded * 2 >= most THEN 2 ELSE 1 END)::DOUBLE AS g, row_number() OVER (PARTITION BY question, section ORDER BY due_at, id) AS k FROM a),
    f AS (SELECT question, section, k, tm, (CASE g WHEN 1 THEN {w[0]} WHEN 2 THEN {w[1]} ELSE {w[2]} END)::DOUBLE AS s, greatest(1.0::DOUBLE, least(10.0::DOUBLE, {w[4]} - exp({w[5]} * (g - 1)) + 1)) AS d FROM v WHERE k = 1
    UNION ALL SELECT question, section, k, tm, greatest(0.001::DOUBLE, CASE WHEN days < 1 THEN s * (CASE WHEN g >= 3 THEN greatest({soon}, 1.0::DOUBLE) ELSE {soon} END) WHEN g = 1 THEN {lost} ELSE {kept} END),
    greatest(1.0::DOUBLE, least(10.0::DOUBLE, {w[7]} * {easy} + (1 - {w[7]}) * (d - {w[6]} * (g - 3) * (10 - d) / 9))) FROM (SELECT v.question, v.section, v.k, v.tm, v.g, f.s, f.d, greatest(0, floor((epoch(v.tm) - epoch(f.tm)) / 86400)) AS days FROM f JOIN v ON v.question = f.question AND v.section = f.section AND v.k = f.k + 1))
    SELECT question, section, k AS reviews, round_even(s, 3) AS stability, round_even(d, 3) AS difficulty FROM f QUALIFY row_number() OVER (PARTITION BY question, section ORDER BY k DESC) = 1"""
    return {
        "retry_schedule": fsrs,
        "nation_mindmap": """SELECT r_regionkey, 'mindmap' || chr(10) || '  n0["' || any_value(r_name) || '"]' || string_agg(chr(10) || '    n' || i || '["' || n_name || '"]', '' ORDER BY i) AS diagram FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) JOIN region ON r_regionkey = n_regionkey GROUP BY r_regionkey""",
        "deck_ids": "SELECT n_nationkey, ('0x' || substr(sha256(n_name), 1, 12))::BIGINT % 2147483648 AS deck_id, regexp_replace(regexp_replace('Ch. ' || n_name, '[^a-zA-Z0-9]', '-', 'g'), '^-+|-+$', '', 'g') AS file FROM nation",
        "content_ids": "SELECT doc_id, substr(sha256(text), 1, 16) AS content_id, length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'))::BIGINT AS squashed, length(text)::BIGINT AS chars FROM documents",
        "search_bm25": f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 5",
        "search_cosine": "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round_even(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
        "search_hybrid": f"""WITH {_BM25}, w AS (SELECT 'd' AS kind, doc_id AS id, unnest({_TOK}) AS w FROM documents UNION ALL SELECT 'q', item_id, unnest({_TOK}) FROM benchmark),
    c AS (SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS place, count(*)::DOUBLE AS n FROM w GROUP BY ALL), u AS (SELECT kind, id, place, n / sqrt(sum(n * n) OVER (PARTITION BY kind, id)) AS n FROM c),
    cs AS (SELECT q.id AS item_id, d.id AS doc_id, round_even(round(sum(q.n * d.n), 9), 6) AS score FROM u q JOIN u d ON q.kind = 'q' AND d.kind = 'd' AND q.place = d.place GROUP BY ALL),
    every AS (SELECT id AS item_id FROM u WHERE kind = 'q' GROUP BY id), alldocs AS (SELECT id AS doc_id FROM u WHERE kind = 'd' GROUP BY id),
    cz AS (SELECT item_id, doc_id, coalesce(score, 0) AS score FROM every CROSS JOIN alldocs LEFT JOIN cs USING (item_id, doc_id)),
    cr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cz), un AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank FROM cr WHERE rank <= 50),
    f AS (SELECT item_id, doc_id, round_even(sum(1.0::DOUBLE / (rank + 60)), 9) AS score FROM un GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5""",
        "item_blueprint": f"""WITH {_BM25}, h AS (SELECT item_id, (doc_id // 100)::VARCHAR AS sid, min(rank) AS rank FROM bm WHERE rank <= 10 GROUP BY ALL),
    o AS (SELECT item_id, sid, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank FROM h),
    m AS (SELECT o.*, item_id % 11 AS marks, 2016 + item_id % 5 AS year, CASE rank WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM o WHERE rank <= 2),
    w AS (SELECT *, (CASE WHEN marks = 0 THEN 1 ELSE marks END) * (1 + 0.5 * coalesce((year - min(year) OVER ())::DOUBLE / nullif(max(year) OVER () - min(year) OVER (), 0), 0)) * score / sum(score) OVER (PARTITION BY item_id) AS part FROM m),
    s AS (SELECT sid, sum(part) AS weight, sum(CASE WHEN rank = 1 THEN marks ELSE 0 END)::BIGINT AS marks, count(*) FILTER (rank = 1) AS questions FROM w GROUP BY sid)
    SELECT sid, round_even(weight, 4) AS weight, round_even(weight / sum(weight) OVER (), 4) AS share, marks, questions FROM s""",
        "formula_values": "SELECT p_partkey, abs((p_partkey % 100) / 8.0 - floor((p_partkey % 100) * 10 / 8) / 10.0) < 1e-6 * greatest(1, (p_partkey % 100) / 8.0) AS same_value, p_partkey % 2 = 1 AS same_relation, p_partkey % 2 = 0 AS contrary FROM part",
        "tool_faults": """SELECT p_partkey, nullif(concat_ws('; ', CASE WHEN p_size NOT BETWEEN 1 AND 20 THEN 'count: a whole number from 1 to 20 wanted' END,
    CASE WHEN p_partkey % 2 = 1 THEN 'question_type: one of mcq, short, long, numerical, diagram, case_study' END), '') AS fault FROM part""",
        "diagram_problems": "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'undeclared nodes: [' || chr(39) || 'n' || n_regionkey || chr(39) || ']' ELSE '' END AS problems FROM nation",
        "calculations": "SELECT p_partkey, ((p_partkey + 2) * p_size - 8)::DOUBLE AS value FROM part",
        "question_shares": """WITH n AS (SELECT n_name AS sid, row_number() OVER (ORDER BY n_nationkey, n_name) AS i, count(*) OVER () AS n FROM nation), s AS (SELECT sid, 337 // n + (i <= 337 % n)::INT AS share FROM n)
    SELECT sid, call::INT AS call, least(10, share - call * 10)::INT AS wanted FROM s, range(0, 40) r(call) WHERE call * 10 < share""",
        "marked_answers": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 2 END::INT AS awarded, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS missing, c_custkey % 2 = 0 AS formula FROM customer",
        "cleaned_readings": r"""WITH c AS (SELECT p_partkey, replace(replace(p_name, '#', ''), ' ', '') AS x FROM part) SELECT p_partkey, '\text{' || x || '}\bf v' AS latex, NOT regexp_matches(x, '[A-Za-z]{5,}') AS plausible FROM c""",
        "note_pages": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation)
    SELECT n_regionkey, string_agg('<section id="s' || i || '"><h1>' || n_name || '</h1>' || chr(10) || '<p><strong>a</strong> &lt; b</p></section>', '' ORDER BY i) AS main FROM n GROUP BY n_regionkey""",
        "search_fused": f"WITH {_BM25}, ds AS (SELECT doc_id, unnest({_STEMS}) AS stem FROM documents), qs AS (SELECT item_id, unnest({_STEMS}) AS stem FROM benchmark), sh AS (SELECT item_id, doc_id, count(*) AS score FROM qs JOIN ds USING (stem) GROUP BY ALL), sr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sh), u AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM sr WHERE rank <= 20), f AS (SELECT item_id, doc_id, round_even(sum(1.0::DOUBLE / (rank + 60)), 9) AS score FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT * FROM r WHERE rank <= 5",
        "hit_rates": f"WITH {_BM25}, g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT g.item_id, min(bm.rank) AS r FROM g LEFT JOIN bm ON bm.item_id = g.item_id AND bm.doc_id = g.doc_id AND bm.rank <= 10 GROUP BY 1) SELECT count(*) AS queries, round_even(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_1, round_even(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_5, round_even(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END), 4) AS mrr_at_10 FROM f",
        "sentence_counts": r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)))::BIGINT AS sentences FROM documents",
        "source_support": f"WITH ds AS (SELECT doc_id, unnest({_STEMS}) AS stem FROM documents), q AS (SELECT item_id, {_STEMS} AS s FROM benchmark), qs AS (SELECT item_id, len(s) AS n, unnest(s) AS stem FROM q WHERE len(s) >= 3), h AS (SELECT item_id, doc_id, count(*)::DOUBLE / any_value(n) AS r FROM qs JOIN ds USING (stem) GROUP BY ALL) SELECT item_id, count(*) AS documents, round_even(max(r), 4) AS best FROM h WHERE r >= 0.5 GROUP BY item_id",
        "copied_items": f"WITH q AS (SELECT item_id, {_STEMS} AS s FROM benchmark), k AS (SELECT a.item_id, max(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) END) AS nearest FROM q a JOIN q b ON a.item_id <> b.item_id GROUP BY a.item_id) SELECT item_id, round_even(coalesce(nearest, 0), 4) AS nearest, coalesce(nearest, 0) >= 0.7 AS copy FROM q LEFT JOIN k USING (item_id)",
        "latest_attempts": f"WITH {_ATT} SELECT question, section, id, awarded FROM l",
        "due_retries": f"WITH {_ATT} SELECT question, section, id, awarded FROM l WHERE awarded < most AND due_at <= TIMESTAMP '{NOW}'",
        "section_mastery": f"WITH {_ATT} SELECT * FROM m",
        "weak_topics": f"WITH {_ATT} SELECT section, score, 1.0::DOUBLE AS weight, round_even(1 - score, 4) AS priority FROM m WHERE round_even(1 - score, 4) > 0 ORDER BY priority DESC, section LIMIT 3",
        "exam_blueprint": f"WITH {_BLUE} SELECT * FROM b",
        "chapter_rollup": f"WITH {_BLUE} SELECT CASE WHEN regexp_matches(split_part(sid, '.', 1), '^[0-9]+$') THEN split_part(sid, '.', 1) ELSE sid END AS chapter, round_even(sum(share), 4) AS share FROM b GROUP BY 1",
        "label_rates": "SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round_even(avg(quality), 4) AS quality, round_even(avg(toxic), 4) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), ())",
        "chat_window": "SELECT * FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 12",
        "item_text_error_rates": "WITH s AS (SELECT item_id, trim(regexp_replace(translate(lower(text), '²³', '23'), '[^a-z0-9]+', ' ', 'g')) AS x FROM benchmark) SELECT a.item_id, round_even(least(1.0, levenshtein(a.x, b.x)::DOUBLE / greatest(length(b.x), 1)), 6) AS cer FROM s a JOIN s b ON b.item_id = a.item_id + 1",
        "hit_rates_by_parity": f"WITH {_BM25}, g AS (SELECT item_id, doc_id, doc_id // 100 AS chapter, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT g.item_id, any_value(g.kind) AS kind, min(bm.rank) AS r FROM g LEFT JOIN bm ON bm.item_id = g.item_id AND bm.doc_id = g.doc_id AND bm.rank <= 10 GROUP BY 1), n AS (SELECT DISTINCT g.item_id FROM g JOIN bm ON bm.item_id = g.item_id AND bm.doc_id // 100 = g.chapter AND bm.rank <= 5) SELECT coalesce(kind, 'all') AS kind, count(*) AS queries, round_even(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_1, round_even(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_at_5, round_even(avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END), 4) AS mrr_at_10, round_even(avg(CASE WHEN n.item_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS chapter_at_5 FROM f LEFT JOIN n USING (item_id) GROUP BY GROUPING SETS ((kind), ())",
        "label_catch_rates": "SELECT round_even(avg((quality = 0)::INT::DOUBLE) FILTER (toxic = 1), 4) AS catch, round_even(avg((quality = 0)::INT::DOUBLE) FILTER (toxic = 0), 4) AS false_drop FROM labels",
        "event_threshold": "WITH t AS (SELECT x::DOUBLE AS threshold FROM range(0, 101, 5) r(x)), c AS (SELECT threshold, round_even(avg((value < threshold)::INT::DOUBLE) FILTER (event_type = 'error'), 4) AS catch, round_even(avg((value < threshold)::INT::DOUBLE) FILTER (event_type <> 'error'), 4) AS false_drop FROM events, t GROUP BY threshold) SELECT threshold, catch, false_drop FROM c ORDER BY catch - false_drop DESC, threshold LIMIT 1",
        "leak_check": f"WITH {_BM25}, n AS (SELECT doc_id, count(*) AS n FROM bm WHERE rank = 1 GROUP BY doc_id) SELECT round_even(max(n) / sum(n)::DOUBLE, 4) AS share, max(n) / sum(n)::DOUBLE > 0.2 AS leak FROM n",
        "event_rates": "SELECT event_type, round_even(avg((value > 1)::INT::DOUBLE), 4) AS above_one, round_even(avg((user_id % 2 = 0)::INT::DOUBLE), 4) AS even_user, round_even(sum(event_id)::DOUBLE / sum(event_id + user_id)::DOUBLE, 4) AS share, round_even(quantile_cont(value, 0.5), 4) AS median FROM events GROUP BY event_type",
        "call_scores": "SELECT n_nationkey, 1::BIGINT AS calls, true AS tools, contains(lower(n_name), 'a') AND n_regionkey BETWEEN 1 AND 3 AS arguments FROM nation",
        "refusals": "WITH s AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS x FROM conversations), r AS (SELECT *, starts_with(x, 'the') AS refused, NOT starts_with(x, 'the') AND contains(x, 'the') AS mixed FROM s) SELECT conv_id, turn, refused, mixed, CASE WHEN turn % 2 = 0 THEN NOT refused AND NOT mixed AND contains(x, 'a') ELSE refused END AS correct FROM r",
        "item_error_rates": "WITH s AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS x FROM benchmark) SELECT a.item_id, round_even(least(1.0, levenshtein(a.x, b.x)::DOUBLE / greatest(length(b.x), 1)), 6) AS cer FROM s a JOIN s b ON b.item_id = a.item_id + 1",
    } | catalog_state.oracle_sql(_BM25)


def queries():
    names = (content_ids, search_bm25, search_cosine, search_fused, search_hybrid, search_stemmed, item_blueprint, formula_values, hit_rates, chunk_stats, sentence_counts, source_support, copied_items, latest_attempts, due_retries, section_mastery, weak_topics, exam_blueprint, chapter_rollup, label_rates, chat_window, item_error_rates, item_text_error_rates, hit_rates_by_parity, label_catch_rates, event_threshold, leak_check, event_rates, call_scores, refusals, retry_schedule, nation_mindmap, deck_ids, tool_faults, diagram_problems, calculations, question_shares, marked_answers, cleaned_readings, note_pages)
    return {f.__name__: f for f in names} | catalog_state.queries()
