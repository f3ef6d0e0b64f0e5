"""Languages of mixed texts: script ranges narrow the candidates, Viterbi labels the spans.

A word is a run of letters (with their marks). It is scored for each language by the letter
trigrams of the lower-cased word with its ends marked: the sum over its trigrams of
log (n + 1/2) - log (N + V/2), where n counts the trigram in texts of the language, N all of
them, and V is the number of trigrams that any language has; trigrams that none has say
nothing. Before that, the script ranges (``RANGES``) of its letters narrow the candidates
to the languages that use all of them, with a thousandth of their own letters or more;
where none uses all, to those that use any; where none uses any, the word says nothing.
A language that is no candidate gets ``EXCLUDED`` less than the best one.

The languages of a text's words are the path of highest sum of scores less ``PENALTY`` for
every change of language; ties go to the language of more labelled texts, then to the
smaller name. Runs of one language are the spans. The text's language is the one of most
letters on the path, and its score the share of letters in its words that say anything.

The fit takes at most ``sample`` labelled texts of each language, whole, in the order of a hash
of doc_id and text; counting runs in Spark, and a language's counts are no more than those
texts hold. All texts are labelled, whole. Texts of a batch go through the path side by
side; the score of a word is calculated once for a worker's bounded memory of words.

Null texts and texts without letters are "und", with score 0 and no spans. Without
any labelled text all are "und". Repeated rows get equal results; a null doc_id is kept and is not
held out. An empty table gives an empty result. Only doc_id and text (and lang, to learn from)
are read, so other columns may have any names.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_batches, row_key, staged

#: Ranges of scripts by their first code points; what follows the last letter of a script is "other".
RANGES = (
    (0x0000, "latin"), (0x0080, "latin-1"), (0x0100, "latin extended"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"),
    (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin extended"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "hiragana"), (0x30A0, "katakana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x323B0, "other"),
)
_FIRST = np.array([a for a, _ in RANGES], np.int64)
SCRIPTS = sorted({name for _, name in RANGES})
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in RANGES])
PENALTY, EXCLUDED = 12.0, 30.0
#: The least share of a language's letters with which it uses a script.
USES = 1e-3


def _class(*kinds: str) -> str:
    """The body of a character class of all code points of the general categories ``kinds``."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in kinds]
    runs = [list(g) for _, g in groupby(enumerate(found), lambda x: x[1] - x[0])]
    return "".join(f"{re.escape(chr(r[0][1]))}-{re.escape(chr(r[-1][1]))}" for r in runs)


_words: list = []


def words(text: str | None) -> list[str]:
    """The lower-cased words of a text."""
    if not _words:
        _words.append(re.compile(f"[{_class('L')}][{_class('L', 'M')}]*").findall)
    return _words[0]((text or "").lower())


def fold(folds: int = 3) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def trigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of all words in order, how many each word has): three code points in a number."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    points = np.frombuffer("".join(f" {w} " for w in found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    key = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:] if len(points) > 2 else np.empty(0, np.int64)
    ends = np.cumsum(size + 2)
    keep = np.ones(len(key), bool)
    for back in (2, 1):  # those over the border of two words
        at = ends[:-1] - back
        keep[at[at < len(keep)]] = False
    return key[keep], size


def scripts_of(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(script of each letter of all words, its word)."""
    points = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return _SCRIPT[np.searchsorted(_FIRST, points, side="right") - 1], np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))


class Languages:
    """Names, trigram scores and scripts of the learned languages."""

    def __init__(self, names: list[str], counts: dict[str, dict[int, int]], letters: dict[str, np.ndarray]):
        """``names`` in the order in which ties go; ``letters``: by language, the letters of each script."""
        self.names = names
        self.keys = np.array(sorted({t for c in counts.values() for t in c}), np.int64)
        n = np.zeros((len(self.keys), len(names)))
        for j, name in enumerate(names):
            got = counts.get(name, {})
            at = np.fromiter(got, np.int64, len(got))
            n[np.searchsorted(self.keys, at), j] = np.fromiter(got.values(), np.float64, len(got))
        self.log = (np.log(n + 0.5) - np.log(n.sum(0) + 0.5 * len(self.keys))).astype(np.float32)
        share = np.array([letters[x] / max(letters[x].sum(), 1) for x in names]).reshape(len(names), len(SCRIPTS))
        self.uses = share.T >= USES  # script, language

    def score(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, language) scores, and whether each word says anything."""
        k = len(self.names)
        key, size = trigrams(found)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        # one row of zeros at the end stands for an unknown trigram
        rows = np.concatenate([self.log, np.zeros((1, k), np.float32)])[np.where(known, at, len(self.keys))]
        out = np.add.reduceat(rows, np.cumsum(size) - size, axis=0) if len(found) else np.empty((0, k), np.float32)
        script, word = scripts_of(found)
        pairs = np.unique(word * len(SCRIPTS) + script)
        w, s = pairs // len(SCRIPTS), pairs % len(SCRIPTS)
        every, some = np.ones((len(found), k), bool), np.zeros((len(found), k), bool)
        np.logical_and.at(every, w, self.uses[s])
        np.logical_or.at(some, w, self.uses[s])
        may = np.where(every.any(1)[:, None], every, some)
        says = np.zeros(len(found), bool)
        np.logical_or.at(says, np.repeat(np.arange(len(found)), size), known)
        says &= may.any(1)
        best = np.where(may, out, -np.inf).max(1, initial=-np.inf)[:, None]
        out = np.where(may, out, np.where(np.isfinite(best), best - EXCLUDED, 0))
        return np.where(says[:, None], out - out.max(1, initial=-np.inf)[:, None], 0).astype(np.float32), says


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word. ``scores``: words of text after text; ``lengths``: words of each text. All texts go side by side."""
    n, k = scores.shape
    path = np.zeros(n, np.int16)
    by = np.argsort(-lengths, kind="stable")
    size, start = lengths[by], (np.cumsum(lengths) - lengths)[by]
    if not n:
        return path
    live = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")  # texts of more than t words
    v = scores[start[: live[0]]].astype(np.float64)
    turned, source = np.zeros((n, k), bool), np.zeros(n, np.int16)
    for t in range(1, size[0]):
        m = live[t]
        now, row = v[:m], start[:m] + t
        best = now.argmax(1)
        now -= now[np.arange(m), best][:, None]
        turned[row], source[row] = now < -penalty, best
        np.maximum(now, -penalty, out=now)
        now += scores[row]
    state = v.argmax(1)
    for t in range(size[0] - 1, -1, -1):
        m = live[t]
        row = start[:m] + t
        path[row] = state[:m]
        if t:
            state[:m] = np.where(turned[row, state[:m]], source[row], state[:m])
    return path


class _Memory(dict):
    """word -> row of its scores; new words are scored together."""

    def __init__(self, model: Languages, most: int):
        self.model, self.most, self.new = model, most, []
        self.scores, self.says = np.empty((0, len(model.names)), np.float32), np.empty(0, bool)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def of(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
            self.scores, self.says = self.scores[:0], self.says[:0]
        rows = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.new:
            scores, says = self.model.score(self.new)
            self.scores, self.says, self.new = np.concatenate([self.scores, scores]), np.concatenate([self.says, says]), []
        return self.scores[rows], self.says[rows]


def labelled(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text): at most ``sample`` different labelled texts of each language."""
    rows = docs.where((F.coalesce(fold(), F.lit(0)) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", row_key().alias("key"), "lang", "text")
    per = rows.groupBy("lang").count().collect()  # a row for each language
    if not per:
        return rows.select("lang", "text").limit(0)
    # a hash lets through twice the sample or all, so few ids travel; repeated rows count once
    share = F.create_map(*[x for r in per for x in (F.lit(r.lang), F.lit(min(1.0, 2.0 * sample / r["count"])))])
    h = F.xxhash64("doc_id", "key")
    some = rows.where(F.pmod(h, F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * (1 << 40)).select("doc_id", "key", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(h, "doc_id", "key")
    picked = staged(some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).drop("_r"))
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.lang") == F.col("b.lang"))
    # at most ``sample`` short rows for each language
    found = rows.alias("a").join(F.broadcast(picked.alias("b")), same, "left_semi")
    return staged(found.groupBy("doc_id", "key", "lang").agg(F.min("text").alias("text")).select("lang", "text"))


def fit_languages(docs: DataFrame, sample: int = 2000) -> Languages | None:
    """Learn from at most ``sample`` texts of each language of ``docs`` (doc_id, text, lang) whose crc32(doc_id) mod 3 is not 1."""
    texts = labelled(docs, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in doc_batches(batches):
            names = np.array(batch.column(0).to_pylist(), object)
            for name in sorted(set(names)):
                found = [w for t in np.array(batch.column(1).to_pylist(), object)[names == name] for w in words(t)]
                key, n = np.unique(trigrams(found)[0], return_counts=True)
                letters = np.bincount(scripts_of(found)[0], minlength=len(SCRIPTS))
                # letters of scripts travel as negative keys
                keys, times = np.concatenate([-1 - np.arange(len(SCRIPTS)), key]), np.concatenate([letters, n])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(times.astype(np.int64))], ["lang", "t", "n"])

    got = texts.mapInArrow(count, "lang string, t long, n long").groupBy("lang", "t").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    counts: dict[str, dict[int, int]] = {}
    for name, t, n in zip(got["lang"].to_pylist(), got["t"].to_pylist(), got["n"].to_pylist(), strict=True):
        counts.setdefault(name, {})[t] = n
    sizes = {r.lang: r["count"] for r in texts.groupBy("lang").count().collect()}
    letters = {name: np.array([c.pop(-1 - i, 0) for i in range(len(SCRIPTS))]) for name, c in counts.items()}
    return Languages(sorted(counts, key=lambda x: (-sizes[x], x)), counts, letters)


SPANS = "array<struct<lang:string,first:int,words:int>>"


def language_spans(docs: DataFrame, model: Languages | None, memory: int = 150_000, spans: bool = True, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; a span is its language, first word and number of words. Without ``spans`` the column is left out."""
    if model is None:
        empty = [F.array().cast(SPANS).alias("spans")] if spans else []
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), *empty)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        seen, names, k = _Memory(model, memory), model.names, len(model.names)
        for batch in doc_batches(batches, most_bytes=max(1 << 18, (16 << 20) // max(k, 2))):
            found = [words(t.as_py()) for t in batch.column(1)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat = [w for ws in found for w in ws]
            scores, says = seen.of(flat)
            path = viterbi(scores, lengths, penalty)
            size, doc = np.fromiter(map(len, flat), np.int64, len(flat)), np.repeat(np.arange(len(found)), lengths)
            letters, sure = np.zeros((len(found), k)), np.zeros((len(found), k))
            np.add.at(letters, (doc, path), size)
            np.add.at(sure, (doc, path), size * says)
            best, rows = letters.argmax(1), np.arange(len(found))
            score = np.where(lengths > 0, sure[rows, best] / np.maximum(letters.sum(1), 1), 0.0)
            columns = [batch.column(0), pa.array([names[b] if n else "und" for b, n in zip(best, lengths, strict=True)], pa.string()), pa.array(score, pa.float64())]
            if spans:
                ends = np.cumsum(lengths)
                each = []
                for a, b in zip(ends - lengths, ends, strict=True):
                    p = path[a:b]
                    cut = np.append(np.nonzero(np.append(True, p[1:] != p[:-1])[: len(p)])[0], len(p))
                    each.append([{"lang": names[p[i]], "first": i, "words": j - i} for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
                columns.append(pa.array(each, kind))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(label, "doc_id long, lang_pred string, score double" + (f", spans {SPANS}" if spans else ""))


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_spans(docs, fit_languages(docs), spans=False)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
