"""Token counts from distinct pre-tokens.

The unit ("pre-token") is a run of white space with the run of other characters
after it. A byte-level BPE of this kind never merges across such a boundary: its
own splitting pattern has no alternative in which white space follows another
character, and what it does with a run of white space depends on that run and on
the next character only. So the pieces of a text are the pieces of its units, and
each distinct unit is encoded once for the whole corpus.

1. Units are counted inside each batch, summed by Spark, and each distinct unit is
   encoded once: the table (unit, uses, pieces), written to the shared folder.
2. The most used units (at most ``head`` of at most ``head_chars`` characters, so of
   bounded size) travel to the tasks; a document's frequencies of those are summed in
   place.
3. The frequencies of all other units are joined to the table by a shuffle and
   summed per document. No list of ids is ever built.

Workers hold at most ``flush`` units or ``head`` pieces and encode ``CHUNK`` units at a
time, so their memory doesn't grow with the corpus.

Null and empty texts have 0 tokens. Rows are kept as they are, repeated ids too. A null
doc_id is kept. An empty table gives an empty result. Only doc_id and text are read, so
other columns may have any names. Files of tokenizers (.json) of the byte-level kind are
taken; others raise, as their pieces may span units.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_batches, row_key, staged, threshold

#: The characters with the Unicode property White_Space.
WHITE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


CHUNK = 1000


def _tokenizer(path: str):
    if not path.endswith(".json"):
        raise ValueError(f"{path}: a tokenizers file (.json) is needed")
    # threads of its own would only cost memory: each task has one core
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _load(path: str):
    """A function from a list of texts to numbers of pieces."""
    t = _tokenizer(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for at in range(0, len(texts), CHUNK) for x in t.encode_batch(texts[at : at + CHUNK], add_special_tokens=False)]


def special_strings(path: str) -> list[str]:
    """Strings which the library takes for special tokens inside a text."""
    return sorted(x.content for x in _tokenizer(path).get_added_tokens_decoder().values())


def splitter(path: str):
    """A function from a text to its units; special strings are units of their own, as the library splits there first."""
    special = special_strings(path)
    if not special:
        return UNIT.findall
    at = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    plain = UNIT.findall

    def units(text: str) -> list[str]:
        if not any(x in text for x in special):
            return plain(text)
        return [u for part in at.split(text) if part for u in ([part] if part in special else plain(part))]

    return units


def unit_table(docs: DataFrame, path: str, flush: int = 120_000) -> DataFrame:
    """(unit, uses, pieces): each distinct unit of all texts, encoded once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, seen = splitter(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])

        for batch in doc_batches(batches):
            for text in batch.column(0):
                seen.update(units(text.as_py() or ""))
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces(batch.column(0).to_pylist()), pa.int64())], ["unit", "uses", "pieces"])

    used = docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("uses"))
    return staged(used.mapInArrow(encode, "unit string, uses long, pieces long"))


def token_counts(docs: DataFrame, tokenizer: str, head: int = 120_000, head_chars: int = 48) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; ``tokenizer`` is the path of a vocabulary file."""
    spark = docs.sparkSession
    special_strings(tokenizer)  # raises here for files of other kinds
    table = unit_table(docs, tokenizer)
    top = threshold(table.where(F.length("unit") <= head_chars), "uses", head)
    known = spark.sparkContext.broadcast({r.unit: r.pieces for r in top.select("unit", "pieces").collect()})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, pieces = splitter(tokenizer), known.value
        for batch in doc_batches(batches, 1000):
            total, rest, times = [], [], []
            for text in batch.column(2):
                n, names, counts = 0, [], []
                for unit, k in Counter(units(text.as_py() or "")).items():
                    p = pieces.get(unit)
                    if p is None:
                        names.append(unit)
                        counts.append(k)
                    else:
                        n += p * k
                total.append(n)
                rest.append(names)
                times.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(total, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "key", "n_bytes", "known", "rest", "times"],
            )

    each = docs.select("doc_id", row_key().alias("key"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    each = staged(each.mapInArrow(sums, "doc_id long, key long, n_bytes long, known long, rest array<string>, times array<int>"))
    # equal rows ask for the same: one of them is enough, and their answer is theirs
    rest = each.where(F.size("rest") > 0).select("doc_id", "key", F.explode(F.arrays_zip("rest", "times")).alias("x"))
    rest = rest.groupBy("doc_id", "key", F.col("x.rest").alias("unit")).agg(F.max("x.times").alias("times")) if _repeats(each) else rest.select("doc_id", "key", F.col("x.rest").alias("unit"), F.col("x.times").alias("times"))
    extra = rest.join(table.select("unit", "pieces"), "unit").groupBy("doc_id", "key").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    joined = each.drop("rest", "times").alias("e").join(extra.alias("x"), F.col("e.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("e.key") == F.col("x.key")), "left")
    return joined.select("e.doc_id", "e.n_bytes", (F.col("e.known") + F.coalesce("x.more", F.lit(0))).cast("long").alias("n_tokens"))


def _repeats(each: DataFrame) -> bool:
    """Whether any (doc_id, key) occurs twice."""
    return bool(each.groupBy("doc_id", "key").count().where("count > 1").limit(1).count())


def op7_token_counts(spark, sf_dir: str, limit: int = 1024) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
