"""Language-model scores by stupid backoff, computed by joins of count tables.

The score of a text is the mean, over its words, of log S(w | v), v being the word
before (a start mark before the first):

    S(w | v) = c'(v w) / c(v)      if c'(v w) > 0
             = 0.4 * c(w) / N      otherwise

c counts over the whole corpus (c of the start mark: texts with words), N is the
number of words, and c' leaves out what the text itself holds, so a text is no
evidence for its own pairs. Words are lower-cased (A-Z) and split at ASCII white space.

1. Word counts: summed by hash, over all texts, written to the shared folder. The
   ``HEAD`` most frequent words, a bounded table, are sent to the tasks.
2. Each block of texts becomes its distinct (text, pair) rows with their frequency,
   dealt out by hash: pairs of two head words by the pair, others by their rarer
   (non-head) word, so that the count of that word, which is dealt out by the same
   hash, is at hand. Rows travel as packed bytes. Rows of pairs of two rare words go
   to both words' places: one adds what a seen pair counts, the other the backoff.
3. A place counts its pairs over all texts, joins the counts with the rows and words
   that came, and returns sums for each text of each block.
4. The sums of each text are added up.

With order 3, a word with two before it (u v; u may be the start mark) is first tried as

    S(w | u v) = c'(u v w) / c(u v)   if c'(u v w) > 0
               = 0.4 * S(w | v)       otherwise

Rows are then distinct (text, triple). Each goes, besides its pair's place, to the place
of its context u v, which counts the triples and the context and adds what seen triples
count; a pair's place holds all triples that end in the pair, so it leaves those out.

No word or pair is dropped. No pair holds more rows than there are texts; frequent
pairs are spread by the hash of both their words. Hashes are of 64 bits.

Null and empty texts have no words and score null. Rows are scored one by one,
repeated ids and texts too; a null doc_id is kept. An empty table gives an empty result.
Only doc_id and text are read, so other columns may have any names. Workers hold a block
of texts or the rows of one place, both of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, doc_batches, mix, staged, threshold

ALPHA = 0.4
HEAD = 100_000
#: Texts in a block at most; a block holds ``BLOCK_BYTES`` of text or one text.
BLOCK, BLOCK_BYTES = 1000, 4 << 20
#: Rows a place is meant to hold.
ROWS = 500_000
#: Blocks of one partition at most: a block's number is that of the partition, times this, and on.
BLOCKS = 1 << 20
_C = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): every word's hash and count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in doc_batches(batches, BLOCK, BLOCK_BYTES):
            got = [hashes.of((x.as_py() or b"").lower().split()) for x in batch.column(0)]
            h, n = np.unique(np.concatenate([*got, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return staged(docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))


def _cut(place: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(place, columns as bytes) for each place."""
    if not len(place):
        return
    order = np.argsort(place, kind="stable")
    place = place[order]
    columns = [c[order] for c in columns]
    cuts = np.nonzero(np.diff(place, prepend=-1))[0]
    for i, j in zip(cuts, np.append(cuts[1:], len(place)), strict=True):
        yield int(place[i]), *(c[i:j].tobytes() for c in columns)


_KIND = "place long, block long, kind string, a binary, b binary, doc binary, tf binary, c binary"
_NAMES = ["place", "block", "kind", "a", "b", "doc", "tf", "c"]
#: Stands for a text where a context ends it.
_END = 65535


def _pairs(pair: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """c' of each row: the count of its pair over all rows, without its own."""
    _, inverse = np.unique(pair, return_inverse=True)
    return np.bincount(inverse, weights=tf)[inverse] - tf


def _others(gram: np.ndarray, text: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """c' of each row where a text may have several rows of a gram."""
    _, inverse = np.unique(gram, return_inverse=True)
    _, own = np.unique(mix(gram) ^ (text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True)
    return np.bincount(inverse, weights=tf)[inverse] - np.bincount(own, weights=tf)[own]


def lm_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """(doc_id, n_words, score) for every row of ``docs`` (doc_id, text); ``order`` is 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    counts = word_counts(docs)
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    rows = docs.count()
    texts = docs.where(F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))).count() if total else 0
    head = threshold(counts, "n", HEAD).collect()
    known = np.sort(np.array([r.h for r in head], np.int64).view(np.uint64))
    by = {r.h & ((1 << 64) - 1): r.n for r in head}
    if not len(known):  # too many words of one count: none is sent, and 0 stands for no word
        known, by = np.zeros(1, np.uint64), {0: 1}
    start = len(known)  # the id of the start mark
    logs = np.log(np.array([by[int(h)] for h in known] + [max(texts, 1)], np.float64))
    log_n = float(np.log(total or 1))
    places = max(64, int((total or 0) * (order - 1) // ROWS))
    sent = docs.sparkSession.sparkContext.broadcast((known, logs))
    alpha = float(np.log(ALPHA))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, known = WordHash(), sent.value[0]
        block = TaskContext.get().partitionId() * BLOCKS
        for batch in doc_batches(batches, BLOCK, BLOCK_BYTES):
            block += 1
            out: list[tuple] = []
            words = [hashes.of((x.as_py() or b"").lower().split()) for x in batch.column(1)]
            n = np.array([len(w) for w in words], np.int64)
            ids = batch.column(0)
            out.append((-1 - block % places, block, "D", ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), n.tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), None, None))
            cur = np.concatenate([*words, np.empty(0, np.uint64)])
            if len(cur):
                doc = np.repeat(np.arange(len(n), dtype=np.uint16), n)
                _, at, inverse = np.unique(cur, return_index=True, return_inverse=True)
                distinct = cur[at]
                found = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                of = np.where(known[found] == distinct, found, -1)
                i_cur = of[inverse]
                first = np.ones(len(cur), bool)
                first[1:] = doc[1:] != doc[:-1]
                prev, i_prev = np.roll(cur, 1), np.roll(i_cur, 1)
                prev[first], i_prev[first] = np.uint64(1), start
                gram = mix(mix(prev) + cur * _C)
                if order == 3:
                    second = np.roll(first, 1) & ~first
                    before = np.roll(cur, 2)
                    before[second] = np.uint64(1)
                    context = mix(mix(before) + prev * _C)
                    triple = np.where(first, np.uint64(0), mix(context + cur * _C) | np.uint64(1))
                    ends = gram[np.append(np.nonzero(first)[0][1:], len(cur)) - 1]
                    gram = np.where(first, gram, triple)
                _, at, tf = np.unique(gram ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True, return_counts=True)
                v, w, i, j, doc, tf = prev[at], cur[at], i_prev[at], i_cur[at], doc[at], tf.astype(np.uint32)
                hh, ht, th, tt = (i >= 0) & (j >= 0), (i >= 0) & (j < 0), (i < 0) & (j >= 0), (i < 0) & (j < 0)
                two = (mix(i[hh].astype(np.uint64) * _C + j[hh].astype(np.uint64)) >> np.uint64(20)) % np.uint64(places)
                c = triple[at] if order == 3 else None
                spot = lambda h: (h >> np.uint64(20)).astype(np.int64) % places
                for kind, place, a, b, m in (
                    ("HH", two.astype(np.int64), i[hh].astype(np.uint32), j[hh].astype(np.uint32), hh),
                    ("HT", spot(w[ht]), w[ht], i[ht].astype(np.uint32), ht),
                    ("TH", spot(v[th]), v[th], j[th].astype(np.uint32), th),
                    ("TV", spot(v[tt]), v[tt], w[tt], tt),
                    ("TW", spot(w[tt]), w[tt], v[tt], tt),
                ):
                    if m.any():
                        out += [(p, block, kind, *x[:4], x[4] if order == 3 else None) for p, *x in _cut(place, a, b, doc[m], tf[m], *([c[m]] if order == 3 else []))]
                if order == 3:
                    m = c != 0
                    x = context[at][m], c[m], doc[m], tf[m]
                    x = [np.concatenate(y) for y in zip(x, (ends, np.zeros(len(ends), np.uint64), np.full(len(ends), _END, np.uint16), np.ones(len(ends), np.uint32)), strict=True)]
                    out += [(p, block, "UV", *y, None) for p, *y in _cut(spot(x[0]), *x)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 5), strict=True)], _NAMES)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value[0]
        for batch in batches:
            h, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            keep = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
            h, n = h[keep], n[keep]
            out = [(p, None, "U", *x, None, None, None) for p, *x in _cut((h >> np.uint64(20)).astype(np.int64) % places, h, n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 5), strict=True)], _NAMES)

    def join(t: pa.Table) -> pa.Table:
        cols = {c: t[c].to_pylist() for c in _NAMES}
        at = {k: [i for i, x in enumerate(cols["kind"]) if x == k] for k in ("D", "U", "HH", "HT", "TH", "TV", "TW", "UV")}
        out = [(cols["block"][i], True, cols["a"][i], cols["b"][i], cols["doc"][i]) for i in at["D"]]
        get = lambda kind, c, d: np.frombuffer(b"".join(cols[c][i] for i in at[kind]), d)
        logs = sent.value[1]
        uh, un = get("U", "a", np.uint64), get("U", "b", np.int64)
        ranked = np.argsort(uh)
        uh, ul = uh[ranked], np.log(un[ranked].astype(np.float64))
        blocks, docs_, gains = [], [], []
        for kind in ("HH", "HT", "TH", "TV", "TW"):
            if not at[kind]:
                continue
            a = get(kind, "a", np.uint32 if kind == "HH" else np.uint64)
            b = get(kind, "b", np.uint64 if kind[0:2] in ("TV", "TW") else np.uint32)
            tf = get(kind, "tf", np.uint32).astype(np.float64)
            pair_hash = mix(mix(a.astype(np.uint64)) + b.astype(np.uint64) * _C)
            sizes = [len(cols["doc"][i]) // 2 for i in at[kind]]
            block, doc = np.repeat(np.array([cols["block"][i] for i in at[kind]], np.int64), sizes), get(kind, "doc", np.uint16)
            if order == 3:
                c, text = get(kind, "c", np.uint64), block * 65536 + doc
                rest = _others(pair_hash, text, tf)
                longer, less = (c != 0) & (_others(c, text, tf) > 0), np.where(c != 0, alpha, 0.0)
            else:
                rest, longer, less = _pairs(pair_hash, tf), False, 0.0
            seen = rest > 0
            log_a = logs[a] if kind == "HH" else ul[np.searchsorted(uh, a)]
            log_b = logs[b] if kind in ("HH", "HT", "TH") else 0.0
            log_v, log_w = (log_a, log_b) if kind in ("HH", "TH", "TV") else (log_b, log_a)
            pair = np.log(np.maximum(rest, 1.0)) - log_v
            back = alpha + log_w - log_n
            gain = np.where(longer, 0.0, np.where(seen, pair + less if kind != "TW" else 0.0, back + less if kind != "TV" else 0.0)) * tf
            blocks.append(block)
            docs_.append(doc)
            gains.append(gain)
        if at["UV"]:
            a, b, doc, tf = get("UV", "a", np.uint64), get("UV", "b", np.uint64), get("UV", "doc", np.uint16), get("UV", "tf", np.uint32).astype(np.float64)
            block = np.repeat(np.array([cols["block"][i] for i in at["UV"]], np.int64), [len(cols["doc"][i]) // 2 for i in at["UV"]])
            _, inverse = np.unique(a, return_inverse=True)
            total = np.bincount(inverse, weights=tf)[inverse]
            rest = _others(b, block * 65536 + doc, tf)
            m = (doc != _END) & (rest > 0)
            blocks.append(block[m])
            docs_.append(doc[m])
            gains.append((np.log(rest[m]) - np.log(total[m])) * tf[m])
        if blocks:
            key, inverse = np.unique(np.concatenate(blocks) * 65536 + np.concatenate(docs_), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(gains))
            out += [(p, False, x, y, None) for p, x, y in _cut(key >> 16, (key & 65535).astype(np.uint16), total)]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["block", "head", "a", "b", "none"])

    def add(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        top = next(r for r in rows if r["head"])
        ids, n, none = np.frombuffer(top["a"], np.int64), np.frombuffer(top["b"], np.int64), np.frombuffer(top["none"], np.uint8)
        total = np.zeros(len(ids))
        # in a fixed order, so reruns agree to the last bit
        for r in sorted((r for r in rows if not r["head"]), key=lambda r: (len(r["a"]), r["a"], r["b"])):
            total[np.frombuffer(r["a"], np.uint16)] += np.frombuffer(r["b"], np.float64)
        score = pa.array(total / np.maximum(n, 1), pa.float64(), mask=n == 0)
        return pa.table({"doc_id": pa.array(ids, mask=none == 1), "n_words": pa.array(n), "score": score})

    if not total:
        return docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("double").alias("score"))
    dealt = docs.select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(deal, _KIND)
    dealt = dealt.union(counts.mapInArrow(rare, _KIND))
    sums = dealt.groupBy("place").applyInArrow(join, "block long, head boolean, a binary, b binary, none binary")
    return sums.groupBy("block").applyInArrow(add, "doc_id long, n_words long, score double")


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", F.bround("score", 6).alias("score"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS w, unnest(list_concat(['<s> '], w[:len(w) - 1])) AS v FROM d WHERE len(w) > 0),
c AS (SELECT w, count(*) AS n FROM t GROUP BY w UNION ALL SELECT '<s> ', count(*) FROM d WHERE len(w) > 0),
k AS (SELECT count(*) AS n FROM t),
p AS (SELECT doc_id, v, w, count(*) AS tf FROM t GROUP BY ALL),
q AS (SELECT *, sum(tf) OVER (PARTITION BY v, w) - tf AS other FROM p),
s AS (SELECT doc_id, sum(tf * CASE WHEN other > 0 THEN ln(other / cv.n::DOUBLE) ELSE ln(0.4) + ln(cw.n / k.n::DOUBLE) END) / sum(tf) AS score
      FROM q JOIN c cv ON cv.w = q.v JOIN c cw ON cw.w = q.w, k GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(s.score, 6) AS score FROM d LEFT JOIN s USING (doc_id)
"""
