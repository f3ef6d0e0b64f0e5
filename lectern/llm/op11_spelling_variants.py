"""Spelling variants: words one edit apart, found by a rare-first filter on positional bigrams.

1. Words are counted over all whole texts in the JVM, with partial sums before the shuffle.
2. Bigrams are counted over the words. There are no more of them than pairs of letters
   (8,100), so their order of frequency, rarest first, is a table of bounded size.
3. A word's *prefix* is its three rarest bigrams (of equal ones the first). One edit
   destroys two bigrams at most and makes two at most, so two words one edit apart share
   a bigram of their prefixes that the edit left whole. It stands at the same place in
   words of equal length, and at the same place or one further in the longer of two
   words whose lengths differ by one. So a word enters three *cells* (bigram, place,
   length) as itself, and six as a word one letter short, and near words share a cell.
4. Beside the bigram they share, one side of near words is equal, and of the other side
   one half, as there is one edit. Within a cell only words that are alike in that way
   are compared, exactly, by the lengths of their equal beginnings and ends. A pair counts
   at the first bigram both share in that way, so once, and no list of pairs leaves the
   task: it returns, for each word, how many near ones it met and the most frequent of
   them. A cell of more than ``LARGE`` words is dealt to tasks by the parts in which its
   words may be alike, others go whole, several to a task; the comparisons are the same,
   and are made in runs of bounded size.
5. A word's form has at least twice its uses, so following forms doubles the uses at each
   step; roots are found by pointer doubling, in as many rounds as the logarithm of the longest chain.

Order by bigram, not by bigram and place: an insertion moves places, so only the order of
the bigrams themselves is the same in both words.

The planted slips (a letter deleted where crc32 of "<doc_id>:<word>" is divisible by 97)
are part of the reading of texts, ``variant_words``; ``slips=0`` reads texts as they are.
Null and empty texts have no words. A null doc_id is read as an empty string. Repeated rows
count as often as they stand. Words of any length are compared. An empty table, or one
without frequent words, gives an empty result. Only doc_id and text are read, so other
columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, attach, doc_batches, dropped, mix, staged

RUN = "[A-Za-zÀ-ÿ]"
#: A cell of more words than this is dealt out by the ways in which its words may be alike.
LARGE = 20_000
#: Rows that share a task's group.
GROUP = 20_000


def variant_words(docs: DataFrame, least_length: int = 5, least: int = 3, slips: int = 97, flush: int = 150_000) -> DataFrame:
    """(word, n): words of ``least_length`` letters or more that occur ``least`` times or more.

    A worker holds at most ``flush`` words and a bounded batch of texts; partial sums go on in Spark.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, fold, seen = re.compile(f"{RUN}{{{least_length},}}").findall, str.maketrans(UPPER, LOWER), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in doc_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                head = crc32(f"{'' if doc is None else doc}:".encode())
                for run, k in Counter(runs(text.as_py() or "")).items():
                    w = run.lower() if run.isascii() else run.translate(fold)
                    if slips:
                        h = crc32(w.encode(), head)
                        if h % slips == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1 :]
                            if len(w) < least_length:
                                continue
                    seen[w] += k
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    each = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, letters as a matrix) of the words of each length."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(length):
        at = np.nonzero(length == size)[0]
        yield int(size), at, np.frombuffer(b"".join([words[i] for i in at]), np.uint8).reshape(len(at), size)


def _grams(letters: np.ndarray) -> np.ndarray:
    return letters[:, :-1].astype(np.int64) * 256 + letters[:, 1:]


def _letters(column: pa.Array) -> list[bytes]:
    """One byte a letter: all letters are below U+0100."""
    return [w.encode("latin-1") for w in column.to_pylist()]


def bigram_order(words: DataFrame) -> np.ndarray:
    """The place of each bigram (first letter * 256 + second) in the order from rare to frequent, ties by code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for batch in batches:
            for _, _, letters in _by_length(_letters(batch.column(0))):
                total += np.bincount(_grams(letters).ravel(), minlength=65536)
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["g", "n"])

    found = words.select("word").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()  # 8,100 rows at most
    order = np.full(65536, 65535, np.int64)
    for i, r in enumerate(sorted(found, key=lambda r: (r.n, r.g))):
        order[r.g] = i
    return order


def prefix(letters: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigrams, places) of the three rarest of each word."""
    grams = _grams(letters)
    size = grams.shape[1]
    rank = order[grams] * size + np.arange(size)
    place = np.argpartition(rank, 2, axis=1)[:, :3] if size > 3 else np.tile(np.arange(size), (len(letters), 1))
    return np.take_along_axis(grams, place, 1), place


OWN, BEFORE, AFTER = 0, 1, 2
_CELLS = "word string, n long, role int, gram int, place int, cell long"


def cells(words: DataFrame, order: np.ndarray) -> DataFrame:
    """A row for each cell (bigram, place, length) that a word enters: as itself, or as one a letter short
    whose missing letter stands after the bigram (``BEFORE``) or before it (``AFTER``)."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, letters in _by_length(_letters(batch.column(0))):
                grams, places = prefix(letters, order)
                part, of = batch.take(pa.array(at)), lambda x: pa.array(np.asarray(x, np.int32))
                for gram, place in zip(grams.T, places.T, strict=True):
                    for role, there, length in ((OWN, place, size), (BEFORE, place, size + 1), (AFTER, place + 1, size + 1)):
                        cell = mix(mix(gram.astype(np.uint64) + np.uint64(65536) * there.astype(np.uint64)) + np.uint64(length))
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), of(np.full(len(at), role)), of(gram), of(place), pa.array(cell.view(np.int64))], ["word", "n", "role", "gram", "place", "cell"])

    return words.mapInArrow(enter, _CELLS)


#: Ways in which two words of a cell can be alike: bit 0, the half of the rest that is equal; bit 1, the
#: side of the bigram that is equal (0 before it, 1 after it); bit 2, whether one word is a letter longer.
WAYS = range(8)


def alike(role, place, size, way, pick, half):
    """Where the equal parts of a word lie: (begin, end) of the side with its bigram, (begin, end) of a half of the rest, and whether there are such.

    The edit lies in the rest, on the other side of the bigram, and leaves one half of it
    as it is; a long word's letter at the cut belongs to neither half. Takes numpy arrays or
    Columns; ``pick(condition, x, y)`` chooses, ``half`` halves and rounds down.
    """
    after, longer, second, none = bit(way, 2), bit(way, 4), bit(way, 1), place * 0
    begin, end = pick(after, none, place + 2), pick(after, place, size)
    extra = pick((role == OWN) & longer, none + 1, none)
    cut = begin + half(end - begin - extra)
    fits = pick(role == OWN, end - begin >= 1, longer & (role == pick(after, none + AFTER, none + BEFORE)))
    return (pick(after, place, none), pick(after, size, place + 2)), (pick(second, cut + extra, begin), pick(second, end, cut)), fits


def bit(x, which: int):
    return (x.bitwiseAND(which) if isinstance(x, Column) else x & which) > 0


#: Pairs that are compared at once.
PAIRS = 1 << 20


def pairs_of(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each run (start, size), of at most about ``PAIRS`` at a time."""
    # row i of a run meets the rows after it
    run = np.repeat(np.arange(len(sizes)), sizes)
    row = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first, after = starts[run] + row, sizes[run] - 1 - row
    ends = np.cumsum(after)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        k = after[at:to]
        a = np.repeat(first[at:to], k)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
        at = to


_BASE = np.uint64(0x9E3779B97F4A7C15)


class Letters:
    """The words of a group as one flat array of letters, with running hashes."""

    def __init__(self, words: list[bytes]):
        self.flat = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.sums = np.zeros(len(self.flat) + len(words), np.uint64)
        at, done = np.arange(len(words)), 0
        while len(at := at[self.size[at] > done]):
            h = self.start[at] + at + done
            self.sums[h + 1] = self.sums[h] * _BASE + self.flat[self.start[at] + done] + np.uint64(1)
            done += 1
        self.power = np.cumprod(np.append(np.uint64(1), np.full(done, _BASE)))

    def hash(self, word: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        at = self.start[word] + word
        return self.sums[at + end] - self.sums[at + begin] * self.power[end - begin]

    def rows(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.flat[self.start[at, None] + np.arange(size)]

    def near(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words ``p`` and ``q`` (as long, or one longer): whether they are one edit apart, and how long their equal beginnings and ends are."""
        yes, lead, tail = np.zeros(len(p), bool), np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        kind = self.size[p] * 2 + (self.size[q] > self.size[p])
        for k in np.unique(kind):
            some, size, longer = np.nonzero(kind == k)[0], int(k) // 2, int(k) % 2
            step = max(1, PAIRS * 16 // (size + 1))
            for at in range(0, len(some), step):
                i = some[at : at + step]
                x, y = self.rows(p[i], size), self.rows(q[i], size + longer)
                same, back = x == y[:, :size], (x == y[:, longer:])[:, ::-1]
                lead[i] = np.where(same.all(1), size, same.argmin(1))
                tail[i] = np.where(back.all(1), size, back.argmin(1))
                yes[i] = lead[i] + tail[i] >= size if longer else lead[i] + tail[i] == size - 1
        return yes, lead, tail


def _ways(letters: Letters, word: np.ndarray, role: np.ndarray, place: np.ndarray, cell: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, way) of every way in which each row may be like another; ``only`` names one way, or -1 for all."""
    out, size = [], letters.size[word]
    base = mix(cell.view(np.uint64))
    for way in WAYS:
        (a, b), (c, d), fits = alike(role, place, size, np.full(len(word), way), np.where, lambda x: x // 2)
        row = np.nonzero(fits & ((only == way) | (only < 0)))[0]
        key = mix(letters.hash(word[row], a[row], b[row]) + mix(letters.hash(word[row], c[row], d[row]) ^ mix(np.full(len(row), way + 1, np.uint64))))
        out.append((key ^ base[row], row, np.full(len(row), way)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _meeting(order: np.ndarray):
    """The task that compares the words of cells."""

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        words, which = np.unique(np.array(_letters(t["word"]), object), return_inverse=True)  # by code point, as Latin-1 sorts
        letters, n = Letters(list(words)), np.zeros(len(words), np.int64)
        n[which] = t["n"].to_numpy()
        role, gram, place, cell, only = (t[c].to_numpy() for c in ("role", "gram", "place", "cell", "way"))
        place = place.astype(np.int64)
        key, row, way = _ways(letters, which, role, place, cell, only)
        by = np.argsort(key, kind="stable")
        key, row, way = key[by], row[by], way[by]
        starts = np.nonzero(np.append(True, key[1:] != key[:-1])[: len(key)])[0]
        sizes = np.diff(np.append(starts, len(key)))
        found: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        for p, q in pairs_of(starts[sizes > 1], sizes[sizes > 1]):
            longer, second = way[p] >= 4, way[p] % 2 == 1
            same = way[p] == way[q]
            p, q = row[p], row[q]
            # a short word with a long one, or two of a length; keys that are equal by chance are left to the comparison
            ok = same & (which[p] != which[q]) & (gram[p] == gram[q]) & (~longer | ((role[p] == OWN) != (role[q] == OWN)))
            p, q, longer, second = p[ok], q[ok], longer[ok], second[ok]
            flip = longer & (role[p] == OWN)
            p, q = np.where(flip, q, p), np.where(flip, p, q)
            shift = place[q] - place[p]
            ok = (letters.size[which[q]] - letters.size[which[p]] == longer) & (shift == np.where(role[p] == AFTER, 1, 0))
            p, q, longer, second, shift = p[ok], q[ok], longer[ok], second[ok], shift[ok]
            yes, lead, tail = letters.near(which[p], which[q])
            # found by the second half only where the first is not equal too
            begin = np.where(shift == 1, 0, place[p] + 2)
            cut = begin + (np.where(shift == 1, place[p], letters.size[which[p]]) - begin) // 2
            yes &= ~second | ~longer | (lead < cut)
            p, q, lead, tail = p[yes], q[yes], lead[yes], tail[yes]
            found.append(np.column_stack([which[p], which[q]])[_first_shared(letters, which[p], which[q], gram[q], place[q], place[q] - place[p], lead, tail, order)])
        a, b = np.concatenate(found).T
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        by = np.lexsort([b, -n[b], a])
        a, b = a[by], b[by]
        lead = np.nonzero(np.append(True, a[1:] != a[:-1])[: len(a)])[0]
        text = lambda at: pa.array([words[r].decode("latin-1") for r in at], pa.string())
        return pa.table({"word": text(a[lead]), "k": pa.array(np.diff(np.append(lead, len(a))), pa.int64()), "near_n": pa.array(n[b[lead]], pa.int64()), "near": text(b[lead])})

    return meet


def _first_shared(letters: Letters, p: np.ndarray, q: np.ndarray, gram: np.ndarray, place: np.ndarray, shift: np.ndarray, lead: np.ndarray, tail: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether (gram, place) is the first that the prefixes of ``p`` and ``q`` share beside an equal side: each pair counts there alone."""
    out = np.zeros(len(p), bool)
    kind = letters.size[p] * 2 + (letters.size[q] > letters.size[p])
    for k in np.unique(kind):
        some, size, longer = np.nonzero(kind == k)[0], int(k) // 2, int(k) % 2
        (gp, tp), (gq, tq) = prefix(letters.rows(p[some], size), order), prefix(letters.rows(q[some], size + longer), order)
        step = tq[:, None, :] - tp[:, :, None]
        before, after = tp + 2 <= lead[some, None], size - tp <= tail[some, None]
        side = np.where(step == 0, (before if longer else before | after)[:, :, None], after[:, :, None])
        shared = (gp[:, :, None] == gq[:, None, :]) & ((step == 0) | ((step == 1) & bool(longer))) & side
        number = (gq[:, None, :] * (size + 2) + tq[:, None, :]) * 2 + step
        least = np.where(shared, number, np.iinfo(np.int64).max).min((1, 2))
        out[some] = least == (gram[some].astype(np.int64) * (size + 2) + place[some]) * 2 + shift[some]
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of the words with near ones; ``words`` (word, n) is read several times."""
    order = bigram_order(words)
    rows = staged(cells(words, order))
    groups = max(64, rows.count() // GROUP)
    large = staged(rows.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > LARGE))
    sized = attach(rows, large, "cell", salt="word", how="left")
    # a large cell is dealt out by the ways in which its words may be alike; others go whole, several to a group
    (a, b), (c, d), fits = alike(F.col("role"), F.col("place"), F.length("word"), F.col("way"), lambda c, x, y: F.when(c, x).otherwise(y), lambda x: F.floor(x / 2).cast("int"))
    part = lambda x, y: F.substring("word", x + 1, y - x)
    dealt = sized.where("size is not null").withColumn("way", F.explode(F.array(*map(F.lit, WAYS)))).where(fits).withColumn("grp", F.xxhash64("cell", "way", part(a, b), part(c, d)))
    whole = sized.where("size is null").withColumn("way", F.lit(-1)).withColumn("grp", F.xxhash64("cell"))
    met = whole.union(dealt).select("word", "n", "role", "gram", "place", "cell", "way", F.pmod("grp", F.lit(groups)).alias("grp"))
    met = staged(met.groupBy("grp").applyInArrow(_meeting(order), "word string, k long, near_n long, near string"))
    least = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    found = staged(met.groupBy("word").agg(F.sum("k").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.near").alias("near")))
    dropped(rows, large, met)
    return found


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) for the rows of ``forms`` (word, form), following forms to a word that has none; no chain may be closed.

    Only words that are forms themselves are gone through in rounds; all others ask once.
    """
    at = staged(forms.join(forms.select(F.col("form").alias("word")).distinct(), "word", "left_semi").select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = staged(attach(at, step, "root", salt="word", salts=8, how="left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        done = not new.where("moved").limit(1).count()
        dropped(at)
        at = new.select("word", "root")
        if done:
            return attach(forms, at.toDF("form", "root"), "form", salt="word", salts=8, how="left").select(forms["word"], F.coalesce("root", "form").alias("root"))
    raise RuntimeError(f"roots: not settled after {rounds} rounds")


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n)."""
    words = staged(words)
    found = near_words(words)
    joined = words.join(found, "word", "left")
    has = F.col("near_n") >= F.col("n") * factor
    each = staged(joined.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")))
    dropped(words, found)
    out = each.join(roots(each.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(variant_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))


ORACLE = """
WITH RECURSIVE table_ AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
run AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
kind AS (SELECT d, w, count(*) AS n FROM run WHERE length(w) >= 5 GROUP BY ALL),
summed AS (SELECT w, n, xor(list_reduce(list_transform(range(octet_length(encode(d || ':' || w))), lambda i: ('0x' || substr(hex(encode(d || ':' || w)), (2 * i + 1)::INTEGER, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM kind, table_),
word AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INTEGER) || substr(w, (h % length(w) + 2)::INTEGER) ELSE w END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM word WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, substr(word, 1, i::INTEGER) || substr(word, i::INTEGER + 2) AS rest FROM words, unnest(range(length(word))) AS g(i)),
pair AS (SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
         UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word),
near AS (SELECT a, count(*) AS n_near, min(struct_pack(m := -w.n, b := b)) AS best FROM pair JOIN words w ON w.word = b GROUP BY a),
each AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * w.n THEN best.b END AS form, CASE WHEN -best.m >= 2 * w.n THEN -best.m END AS form_n FROM words w LEFT JOIN near ON a = w.word),
walk AS (SELECT word, word AS at, form FROM each UNION ALL SELECT walk.word, e.word, e.form FROM walk JOIN each e ON e.word = walk.form)
SELECT each.word, each.form, walk.at AS root, n, n_near, form_n::BIGINT AS form_n FROM each JOIN walk ON walk.word = each.word WHERE walk.form IS NULL
"""
