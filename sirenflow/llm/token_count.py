"""Token counts of whole texts under a word-level BPE tokenizer, without token ids of any text.

For a tokenizer that drops white space, the words of a text (and a closing punctuation mark after an ASCII letter) are
pre-tokens that it treats apart. The pieces of each distinct pre-token of the corpus are counted once, by the tokenizer's
own library; a text's count is the sum over its pre-token frequencies. The most frequent pre-tokens, up to a bound in
bytes, are joined where the text is read; the frequencies of the others are joined by pre-token.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import batches_of, saved

#: What a task may hold of the frequent pre-tokens, counted as UTF-8 bytes and 100 more a pre-token.
HEAD_BYTES = 32 << 20
#: Longer pre-tokens are always joined by shuffle.
HEAD_WORD = 256
#: A task passes its distinct pre-tokens on when it holds so many bytes of them.
HELD_BYTES = 64 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 500
_LETTER, _MARK, _WHITE, _UPPER = 1, 2, 4, 8


def _kinds() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
    out[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER | _UPPER
    out[list(b".,;:!?")] = _MARK
    out[list(b" \t\n\v\f\r")] = _WHITE
    return out


_KINDS = _kinds()


def words_of(texts: pa.BinaryArray) -> Iterator[list[bytes]]:
    """Pre-tokens of each text of an Arrow array of UTF-8 bytes (null: none).

    Cut at ASCII white space; a mark of ``.,;:!?`` that ends a word after an ASCII letter is cut off; capital ASCII letters
    become small unless a non-ASCII byte follows (a combining mark could make one character of both) or the text
    has the opening ``<|`` of special tokens, which are matched before letters are made small.
    """
    texts = texts.fill_null(b"")
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or off[-1] == off[0]:
        yield from ([] for _ in range(len(texts)))
        return
    d = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    kind = _KINDS[d]
    full = off[:-1] < off[1:]
    ends = np.append((kind[1:] & _WHITE) > 0, True)
    ends[off[1:][full] - 1] = True
    after = np.append(False, (kind[:-1] & _LETTER) > 0)
    after[off[:-1][full]] = False
    marks = np.flatnonzero(((kind & _MARK) > 0) & ends & after)
    wide = np.append(d[1:] >= 128, False)
    wide[off[1:][full] - 1] = False  # a text's words depend on no other text
    small = np.where(((kind & _UPPER) > 0) & ~wide, d | 32, d)
    out = np.insert(small, marks, 32).tobytes()
    at = off + np.searchsorted(marks, off)
    whole = d.tobytes()
    special = b"<|" in whole
    for k in range(len(texts)):
        raw = whole[off[k] : off[k + 1]] if special else b""
        yield raw.split() if b"<|" in raw else out[at[k] : at[k + 1]].split()


@lru_cache(2)
def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(spec: str, words: list[bytes]) -> list[int]:
    """Tokens of each pre-token, as the library gives them without added begin and end tokens."""
    return [len(x.ids) for x in _tokenizer(spec).encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]


def _drops_white_space(spec: str) -> bool:
    one, both, gap = pieces(spec, [b"some"])[0], pieces(spec, [b"some  Some.\n\tsome"])[0], pieces(spec, [b" \t\n"])[0]
    return gap == 0 and both == 3 * one + pieces(spec, [b"."])[0]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()
    grown = 0

    def out() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], ["word", "n"])

    for b in batches:
        before = len(held)
        for words in words_of(b.column(0)):
            held.update(words)
        grown += 100 * (len(held) - before) + b.column(0).nbytes // 8
        if grown > HELD_BYTES:
            yield from out()
            held.clear()
            grown = 0
    yield from out()


def word_pieces(docs: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """(word binary, n long, pieces int): each distinct pre-token of the corpus, its occurrences, and its tokens."""
    seen = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(_distinct, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces(spec, b.column(0).to_pylist()), pa.int32())], ["word", "n", "pieces"])

    return seen.mapInArrow(run, "word binary, n long, pieces int")


def _head(table: DataFrame, most: int) -> dict[bytes, int]:
    """Pieces of the most frequent pre-tokens, of at most ``most`` bytes with 100 a pre-token; a bound by counts, so no sort."""
    short = table.where(F.octet_length("word") <= HEAD_WORD)
    # classes of counts, eight to a doubling: at most some 500 rows
    size = short.groupBy(F.floor(F.log2("n") * 8).alias("c")).agg(F.sum(F.octet_length("word") + 100).alias("bytes")).collect()
    least, total = None, 0
    for r in sorted(size, key=lambda r: -r["c"]):
        total += r["bytes"]
        if total > most:
            break
        least = r["c"]
    if least is None:
        return {}
    return {bytes(r["word"]): r["pieces"] for r in short.where(F.floor(F.log2("n") * 8) >= least).select("word", "pieces").toLocalIterator()}  # bounded by ``most``


def token_counts(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", limit: int = 2048, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """One row per input row: ``key``, n_bytes, n_tokens, over_limit.

    ``spec`` is the content of a tokenizer file that drops white space (an error otherwise). Null texts are empty and
    have no tokens; repeated rows are counted each; null and repeated keys stay; other columns are not read. Special
    tokens' strings in a text count as the library has it by default. An empty table gives no rows. A word of any
    length is one pre-token; neither texts nor ids are shuffled, only the rarer pre-tokens of each row.
    """
    if not _drops_white_space(spec):
        raise ValueError("the tokenizer does not drop white space: words cannot be counted apart")
    spark = docs.sparkSession
    with batches_of(spark, BATCH_ROWS):
        table = saved(word_pieces(docs, spec, text))
        head = spark.sparkContext.broadcast(_head(table, head_bytes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = head.value
            for b in batches:
                sums, words, counts, ends = [], [], [], [0]
                for ws in words_of(b.column("text")):
                    total = 0
                    for w, n in Counter(ws).items():
                        p = known.get(w)
                        if p is None:
                            words.append(w)
                            counts.append(n)
                        else:
                            total += n * p
                    sums.append(total)
                    ends.append(len(words))
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"]))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_bytes"), pa.array(sums, pa.int64()), rest], ["key", "n_bytes", "common", "rest"])

        kind = docs.schema[key].dataType
        cols = [F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).cast("binary").alias("text")]
        out = docs.select(*cols).mapInArrow(run, f"key {kind.simpleString()}, n_bytes long, common long, rest array<struct<word:binary,n:long>>")
        per_doc = saved(out.withColumn("row", F.monotonically_increasing_id()))
    rare = per_doc.select("row", F.explode("rest").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("k"))
    rare = rare.join(table.select("word", "pieces"), "word").groupBy("row").agg(F.sum(F.col("k") * F.col("pieces")).alias("more"))
    done = per_doc.select("row", "key", "n_bytes", "common").join(rare, "row", "left")
    n = F.col("common") + F.coalesce("more", F.lit(0))
    return done.select(F.col("key").alias(key), "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
