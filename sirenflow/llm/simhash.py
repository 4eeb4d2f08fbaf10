"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of the segments' bit
counts (0, 1 or 2). The Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints, so it filters pairs before the exact test. A count is stored in unary (0 = 00, 1 = 01,
2 = 11), which turns the Manhattan distance into ``bit_count(x ^ y)``.

Grid: the 32 counts form six blocks. Two vectors at distance 3 or less agree on at least three whole blocks,
so each vector enters the 20 grid cells named by three of its blocks, and every pair within range meets in a
cell. Only distinct fingerprints enter the grid; copies never multiply. A cell keeps a minimum spanning
forest of its links rather than all its pairs. Cells above ``cell_limit`` members (dense groups of near copies) are not
compared there: their members enter a finer grid of the same embedding (8, then 11 blocks, any 5 or 8 equal), and
what is dense even there a last, exact one on the bits themselves (16 nibbles, any 13 equal), whose cells
hold at most 4096 distinct fingerprints by construction.

Near copies (``near_dedup``) are searched by the same grid, in several fingerprints of each text's distinct words at once: at
Jaccard similarity 0.8 of the shingles one fingerprint often differs in more than three bits. Inside each component of
fingerprints the shingle sets are compared exactly. ``similar_links`` is the exact join on all texts by shingle prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sirenflow.llm.common import KeyFilter, batches_of, cut, saved, text_key
from sirenflow.llm.components import components

MAX_BITS = 3
EVEN = 0x5555555555555555
LINK = "s int, a long, b long"
#: Blocks of the embedding's grids, the next for what is dense in the one before; three blocks are left free.
GRIDS = (6, 8, 11)
#: Of near_dedup: fingerprints a text, words of the texts of a block that are compared with another block's, rows of a call on average.
FINGERPRINTS, BLOCK_WORDS, CALL_ROWS = 8, 500_000, 500
#: Of similar_links: texts sampled for the order of shingles, shingles in that order, least and most bits of a text's parity sketch (two a shingle
#: between; near_dedup's too), rows of an Arrow batch, nodes of a block whose pairs are tested together, pairs of a
#: call on average.
SAMPLE_TEXTS, COMMON_SHINGLES, LEAST_SKETCH, MOST_SKETCH, BATCH_ROWS, BLOCK_NODES, GROUP_PAIRS = 5_000, 100_000, 512, 1 << 17, 1_000, 1_000, 5_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(n: int, free: int, unit: int) -> list[int]:
    """All masks over ``n`` blocks of about equal size (in ``unit``-bit fields) that leave ``free`` blocks out."""
    edge = [round(i * 64 / unit / n) * unit for i in range(n + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edge, edge[1:], strict=False)]
    return [_signed(sum(block) ^ sum(c)) for c in combinations(block, free)]


def shingle_hashes(words: list[bytes], k: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``k`` words, space-joined; the whole sequence when there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if k == 1:
        return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))
    buf = b" ".join(words)
    if len(words) <= k:
        return np.array([h(buf, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-k] + 1)) if k < len(words) else np.array([0])
    return np.fromiter((h(buf[s:e], seed) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash: a bit is set if more than half of the hashes set it; zero for none."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536].astype("<u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, keep: list[str], text: str = "text", k: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """``keep`` columns and one fingerprint column ``fp<i>`` per seed. Null text has no words: fingerprint 0."""
    schema = docs.select(*keep).schema
    for i in range(len(seeds)):
        schema = schema.add(f"fp{i}", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("__text")
            out = [[] for _ in seeds]
            for t in texts:
                words = t.encode().lower().split() if isinstance(t, str) else []
                for col, seed in zip(out, seeds, strict=True):
                    col.append(fingerprint(shingle_hashes(words, k, seed)))
            yield pdf.assign(**{f"fp{i}": np.array(col, np.int64) for i, col in enumerate(out)})

    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)


def embed(fp):
    """Unary segment counts of a fingerprint column, two bits a segment."""
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(F.lit(EVEN)).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(EVEN)), 1))


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Minimum spanning forest of the links (exact distance <= max_bits) among the fingerprints of one cell."""
    x = np.sort(fps.astype(np.uint64))
    half = x >> np.uint64(1)
    even = np.uint64(EVEN)
    e = ((x | half) & even) | (((x & half) & even) << np.uint64(1))
    n, rows, cols, dist = len(x), [], [], []
    for i in range(0, n, 256):
        i_s, j_s = np.nonzero(np.bitwise_count(e[i : i + 256, None] ^ e[None, :]) <= max_bits)
        i_s = i_s + i
        i_s, j_s = i_s[j_s > i_s], j_s[j_s > i_s]
        d = np.bitwise_count(x[i_s] ^ x[j_s])
        ok = d <= max_bits
        rows.append(i_s[ok]), cols.append(j_s[ok]), dist.append(d[ok])
    i_s, j_s = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(np.concatenate(dist), kind="stable")
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out, signed = [], x.view(np.int64)
    for i, j in zip(i_s[order].tolist(), j_s[order].tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(signed[i]), int(signed[j])))
            if len(out) == n - 1:
                break
    return out


def _cell_links(cells: DataFrame, max_bits: int) -> DataFrame:
    """Links inside cells given as (s, fps array<long>); one forest a cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(s, *p) for s, fps in zip(pdf["s"], pdf["fps"], strict=True) for p in _forest(np.asarray(fps, np.int64), max_bits)]
            yield pd.DataFrame(out, columns=["s", "a", "b"], dtype="int64").astype({"s": "int32"})

    return cells.mapInPandas(run, LINK)


def _cells(fps: DataFrame, masks: list[int], value) -> DataFrame:
    """(s, key, fp): grid cells that several fingerprints may share, by a hash of the part of the vector that a mask keeps.

    A cell costs its key alone until another fingerprint has it too.
    """
    keys = [F.xxhash64("s", F.lit(c), value.bitwiseAND(F.lit(m))).alias(f"k{c}") for c, m in enumerate(masks)]
    often = saved(fps.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").count().where("count > 1").select("key"))
    shared = KeyFilter(often, "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key = pdf[[f"k{c}" for c in range(len(masks))]].to_numpy(np.int64)
            at, cell = np.nonzero(shared.may_hold(key))
            yield pd.DataFrame({"s": pdf["s"].to_numpy(np.int32)[at], "key": key[at, cell], "fp": pdf["fp"].to_numpy(np.int64)[at]})

    return saved(fps.select("s", "fp", *keys).mapInPandas(run, "s int, key long, fp long"))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, cell_limit: int = 256) -> DataFrame:
    """Links (s, a, b) of distinct fingerprints (s int, fp long), within each s; enough to span every component exactly."""
    if max_bits != 3:
        raise ValueError("the grid is laid out for 3 bits")
    cell = ["s", "key"]
    rest, parts = fps, []
    for blocks in GRIDS:
        cells = _cells(rest, _masks(blocks, 3, 2), embed(F.col("fp")))
        sizes = saved(cells.groupBy(*cell).count().where("count > 1"))
        parts.append(cells.join(sizes.where(F.col("count") <= cell_limit), cell).groupBy(*cell).agg(F.collect_set("fp").alias("fps")).select("s", "fps"))
        rest = saved(cells.join(sizes.where(F.col("count") > cell_limit), cell, "left_semi").select("s", "fp").distinct())
        if rest.isEmpty():
            break
    else:
        parts.append(_cells(rest, _masks(16, 3, 4), F.col("fp")).groupBy(*cell).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1).select("s", "fps"))
    return _cell_links(reduce(DataFrame.union, parts), max_bits).distinct()


def fingerprint_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id (smallest id in its component).

    Null or empty text: fingerprint zero, linked like any other. Null ids keep their row and never become a
    component id unless the component has no other. Repeated rows give repeated results. Other columns,
    whatever their names, are not read.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    fps = cut(with_fingerprints(src, ["id"], k=k, seeds=(seed,)).withColumnRenamed("fp0", "fp"))
    by_fp = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    found = components(fingerprint_links(by_fp.select(F.lit(0).alias("s"), "fp")))
    linked = by_fp.join(found, by_fp.fp == found.node).select("fp", "root", "low")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component"))
    moved = cut(linked.join(lowest, "root").select("fp", "component"))
    named = cut(by_fp.join(moved, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id")))
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a text."""
    return np.unique(shingle_hashes(text.encode().lower().split() if isinstance(text, str) else [], k, 7).view(np.int64))


def _fresh(pdf: pd.DataFrame, seen: set[int]) -> pd.DataFrame:
    """The rows of nodes that the task has not seen yet."""
    new = pdf[~pdf["node"].isin(seen) & ~pdf["node"].duplicated()]
    seen.update(new["node"].tolist())
    return new


def _shingle_sets(nodes: DataFrame, k: int) -> DataFrame:
    """(node, sh): the sorted distinct hashes of the ``k``-word shingles of each text; one row a node and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            pdf = _fresh(pdf, seen)
            yield pd.DataFrame({"node": pdf["node"].to_numpy(np.int64), "sh": [_shingle_set(t, k) for t in pdf["text"]]})

    return nodes.mapInPandas(run, "node long, sh array<long>")


def _packed_texts(nodes: DataFrame, wanted: KeyFilter) -> DataFrame:
    """(node, z): the texts of nodes that may be wanted, compressed: a third of what their shingle hashes take."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, pack = set(), zstandard.ZstdCompressor(level=6)
        for pdf in batches:
            pdf = _fresh(pdf[wanted.may_hold(pdf["node"].to_numpy(np.int64))], seen)
            yield pd.DataFrame({"node": pdf["node"].to_numpy(np.int64), "z": [pack.compress((t or "").encode()) for t in pdf["text"]]})

    return nodes.mapInPandas(run, "node long, z binary")


def _tested(pairs: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of packed texts (a, za, b, zb) whose shingle sets have the wanted Jaccard similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, sets = zstandard.ZstdDecompressor(), {}

        def of(node: int, z: bytes) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 200:
                    sets.clear()
                sets[node] = _shingle_set(unpack.decompress(z).decode(), k)
            return sets[node]

        for pdf in batches:
            ok = []
            for a, za, b, zb in zip(pdf["a"], pdf["za"], pdf["b"], pdf["zb"], strict=True):
                x, y = of(a, za), of(b, zb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield pdf.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _common_shingles(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several texts of a sample share, sorted, and their counts. They only order prefixes: any order gives the same pairs."""
    every = max(1, rows.count() // SAMPLE_TEXTS)
    some = rows.where(F.pmod("node", F.lit(every)) == 0)
    found = _shingle_sets(some, k).dropDuplicates(["node"]).select(F.explode("sh").alias("h")).groupBy("h").count().where("count > 1")
    top = found.orderBy(F.desc("count"), "h").limit(COMMON_SHINGLES).toPandas().sort_values("h")  # bounded
    return top["h"].to_numpy(np.int64), top["count"].to_numpy(np.int64)


def _sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set of hashes, a power of two of them: bit j is the parity of the hashes that end in j."""
    bits = min(MOST_SKETCH, max(LEAST_SKETCH, 1 << (2 * max(1, len(s)) - 1).bit_length()))
    return np.packbits(np.bincount(s & (bits - 1), minlength=bits) & 1 == 1).view(np.int64)


def _prefixes(rows: DataFrame, k: int, similarity: float, common: np.ndarray, count: np.ndarray) -> DataFrame:
    """(node, n, sketch, prefix) of each text: size of its shingle set, parity bits, and its first shingles in the global order; one row a node and task.

    The order is by count in the sample, then hash. Two sets of the wanted similarity share a shingle of both
    prefixes: each prefix leaves out fewer shingles than the two must share. Sets without a shingle share the prefix [0].
    """

    def one(s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(1, np.int64)
        size = len(s) - int(np.ceil(similarity * len(s) - 1e-6)) + 1
        if not len(common):
            return s[:size]
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        return s[np.lexsort((s, np.where(common[at] == s, count[at], 0)))[:size]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            pdf = _fresh(pdf, seen)
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                sets = [_shingle_set(t, k) for t in part["text"]]
                yield pd.DataFrame({"node": part["node"].to_numpy(np.int64), "n": np.array([len(s) for s in sets], np.int32), "sketch": [_sketch(s) for s in sets], "prefix": [one(s) for s in sets]})

    return rows.mapInPandas(run, "node long, n int, sketch array<long>, prefix array<long>")


def _blocks(pairs: DataFrame) -> DataFrame:
    """(node, block): nodes that meet a common smallest node share a block, of about ``BLOCK_NODES`` nodes; larger groups have several."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("label")).groupBy("node").agg(F.min("label").alias("label"))
    size = met.groupBy("label").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK_NODES))
    return met.join(size, "label").select("node", F.xxhash64("label", part).alias("block"))


def _unlike(similarity: float):
    """Of some block pairs' pairs (a, b) and their nodes' sketches (node, n, sketch): the pairs whose sizes and parity bits allow the similarity."""

    def run(pairs: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(nodes["node"].tolist(), nodes["n"].tolist(), strict=True))
        bits = {k: np.asarray(v, np.int64) for k, v in zip(nodes["node"].tolist(), nodes["sketch"], strict=True)}
        ok = []
        for a, b in zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True):
            fits = n[a] >= similarity * n[b] - 1e-6 and n[b] >= similarity * n[a] - 1e-6
            if fits:
                x, y = (bits[a], bits[b]) if len(bits[a]) <= len(bits[b]) else (bits[b], bits[a])
                while len(y) > len(x):  # the longer sketch folds to the shorter one's length
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                fits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) * (1 + similarity) <= (n[a] + n[b]) * (1 - similarity) + 1e-6
            ok.append(fits)
        return pairs.loc[ok, ["a", "b"]]

    run.__annotations__ = {}
    return run


def similar_pairs(pairs: DataFrame, texts: DataFrame, sizes: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of distinct nodes whose shingle sets have the wanted Jaccard similarity.

    ``sizes``: node, n, sketch, one row a node. Sizes that differ too much reject a pair, and so do differing parity
    bits, which never outnumber the shingles in which two sets differ; a sketch goes once to each pair of blocks that
    needs it, not along with each pair. The rest are compared exactly.
    """
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    blocks = saved(_blocks(pairs))
    side = lambda c: blocks.select(F.col("node").alias(c), F.col("block").alias(f"k{c}"))
    groups = max(1, pairs.count() // GROUP_PAIRS)  # small block pairs share a call
    own = F.pmod(F.xxhash64(F.least("ka", "kb"), F.greatest("ka", "kb")), F.lit(groups))
    placed = saved(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", own.alias("x")))
    needs = placed.select(F.col("x").alias("u"), F.explode(F.array("a", "b")).alias("node")).distinct().join(sizes, "node").select("u", "node", "n", "sketch")
    near = saved(placed.groupBy("x").cogroup(needs.groupBy("u")).applyInPandas(_unlike(similarity), "a long, b long"))
    if near.isEmpty():
        return near
    wanted = KeyFilter(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    packed = _packed_texts(texts, wanted).dropDuplicates(["node"])
    both = near.join(packed.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(packed.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    return saved(_tested(both.select("a", "za", "b", "zb"), k, similarity))


def similar_links(texts: DataFrame, k: int = 5, similarity: float = 0.8, posting_limit: int = 64) -> DataFrame:
    """Verified links (a, b) among texts (node long, text); they span the components of all pairs of the wanted similarity.

    Every pair of that similarity meets in the posting of a prefix shingle. Pairs are tested in three rounds: each text
    with the smallest it meets; each posting's smallest with its others; all pairs of a posting. Postings up to
    ``posting_limit`` are tested whole at once. A later round tests the pairs that the links so far left in different
    components, so a large group of near copies costs a few pairs a text; one end of such a pair is
    outside the posting's largest component.
    """
    prefix = saved(_prefixes(texts, k, similarity, *_common_shingles(texts, k)))
    sizes = prefix.select("node", "n", "sketch").dropDuplicates(["node"])
    posting = prefix.select(F.explode("prefix").alias("h"), "node")
    many = posting.groupBy("h").agg(F.count("*").alias("m"), F.min("node").alias("first"), F.max("node").alias("other")).where("first < other").select("h", "m", "first")
    hits = saved(posting.join(many, "h").distinct())
    side = lambda df, c: df.select("h", F.col("node").alias(c))
    short = hits.where(F.col("m") <= posting_limit)
    inside = side(short, "a").join(side(short, "b"), "h").where(F.col("a") < F.col("b")).select("a", "b")
    long = hits.where(F.col("m") > posting_limit)
    lowest = long.where("node != first").groupBy("node").agg(F.min("first").alias("first")).select(F.col("first").alias("a"), F.col("node").alias("b"))
    good = similar_pairs(inside.union(lowest), texts, sizes, k, similarity)
    for whole in (False, True):
        if long.isEmpty():
            break
        rooted = saved(long.join(components(good), "node", "left").withColumn("root", F.coalesce("root", "node")))
        split = rooted.groupBy("h", "root").agg(F.count("*").alias("c"), F.min("node").alias("low"))
        split = split.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.min_by("root", "low").alias("of_first"), F.count("*").alias("roots")).where("roots > 1").select("h", "most", "of_first")
        long = saved(rooted.join(split, "h").select("h", "node", "m", "first", "root", "most", "of_first"))
        if whole:
            rside = lambda df, c: df.select("h", F.col("node").alias(c), F.col("root").alias(f"r{c}"))
            rest = rside(long.where("root != most"), "a").join(rside(long, "b"), "h").where("ra != rb").select("a", "b")
        else:
            rest = long.where("root != of_first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        long = long.select("h", "node", "m", "first")
        good = saved(good.union(similar_pairs(rest, texts, sizes, k, similarity)))
    return good


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """``n`` independent 64-bit hashes from each hash."""
    odd = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    x = h[None, :] * odd[:, None]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def word_fingerprints(text: str | None, n: int) -> tuple[np.ndarray, int]:
    """``n`` signed SimHashes of the distinct words of a text, and its number of words; zeros without a word."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    h = np.unique(shingle_hashes(list(set(words)), 1, 42))
    counts = np.zeros((n * 8, 256))
    lane = (np.arange(n * 8, dtype=np.int64) * 256).reshape(n, 1, 8)
    for i in range(0, len(h), 8192):  # a histogram of each byte tells how often its bits are set
        part = np.ascontiguousarray(_mixed(h[i : i + 8192], n).astype("<u8"))
        counts += np.bincount((part.view(np.uint8).reshape(n, -1, 8) + lane).ravel(), minlength=n * 2048).reshape(n * 8, 256)
    ones = (counts @ _BYTE_BITS).reshape(n, 64)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view("<i8")[:, 0].astype(np.int64), len(words)


def _node_fingerprints(nodes: DataFrame, n: int) -> DataFrame:
    """(node, words, f0, f1, ...): fingerprints of each text; one row a node and task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            pdf = _fresh(pdf, seen)
            found = [word_fingerprints(t, n) for t in pdf["text"]]
            fps = np.array([f for f, _ in found], np.int64).reshape(-1, n)
            yield pd.DataFrame({"node": pdf["node"].to_numpy(np.int64), "words": np.array([w for _, w in found], np.int64), **{f"f{i}": fps[:, i] for i in range(n)}})

    return nodes.mapInPandas(run, "node long, words long, " + ", ".join(f"f{i} long" for i in range(n)))


def fingerprint_classes(nodes: DataFrame, n: int = FINGERPRINTS) -> DataFrame:
    """(node, words, class) of the texts (node long, text) that another text's fingerprints lead to.

    Texts are linked if one of their ``n`` fingerprints differs in at most 3 bits; a class is a component of all such
    links. A fingerprint is a vertex of its own between its texts and its links.
    """
    fps = saved(_node_fingerprints(nodes, n))
    flat = fps.select("node", F.posexplode(F.array(*[f"f{i}" for i in range(n)])).alias("s", "fp"))
    by_fp = saved(flat.groupBy("s", "fp").agg(F.min("node").alias("low"), F.max("node").alias("high")))
    links = saved(fingerprint_links(by_fp.select("s", "fp")))
    used = by_fp.where("low < high").select("s", "fp").union(links.select("s", F.col("a").alias("fp"))).union(links.select("s", F.col("b").alias("fp"))).distinct()
    vertex = lambda fp: F.xxhash64("s", fp)
    tied = saved(flat.join(saved(used), ["s", "fp"]).select("node", vertex("fp").alias("v")).distinct())
    found = components(tied.select(F.col("node").alias("a"), F.col("v").alias("b")).union(links.select(vertex("a").alias("a"), vertex("b").alias("b"))))
    size = fps.join(tied.select("node").distinct(), "node").groupBy("node").agg(F.max("words").alias("words"))
    return size.join(found, "node").select("node", "words", F.col("root").alias("class"))


def _similar_forest(nodes: list[int], side: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of the wanted Jaccard similarity among some sets, enough to span the components of all such links.

    With two sides only pairs of one with the other are compared. Sizes and parity bits reject most pairs; the rest are
    compared exactly unless links found already join them.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    nodes, side, sets = [nodes[k] for k in order], side[order], [sets[k] for k in order]
    size = np.array([len(x) for x in sets], np.int64)
    stop = np.searchsorted(size, size / similarity + 1e-6, "right")
    sketches = [_sketch(x) for x in sets]
    length = np.array([len(x) for x in sketches], np.int64)
    two = bool((side != side[0]).any())
    root, out, rows, first = list(range(len(sets))), [], None, 0

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for a in range(len(sets)):
        if rows is None or rows.shape[1] != length[a]:  # all that this length is compared with, folded to it
            first, last = a, int(stop[np.flatnonzero(length == length[a])[-1]])
            rows = np.stack([_folded(x, length[a]) for x in sketches[first:last]]).view(np.uint64)
        for i in range(a + 1, int(stop[a]), 4096):
            b = np.arange(i, min(i + 4096, int(stop[a])))
            unlike = np.bitwise_count(rows[a - first] ^ rows[b - first]).sum(axis=1, dtype=np.int64)
            ok = unlike * (1 + similarity) <= (size[a] + size[b]) * (1 - similarity) + 1e-6
            if two:
                ok &= side[b] != side[a]
            for c in b[ok].tolist():
                x, y = find(a), find(c)
                if x != y:
                    both = len(np.intersect1d(sets[a], sets[c], assume_unique=True))
                    if both >= similarity * (size[a] + size[c] - both):
                        root[max(x, y)] = min(x, y)
                        out.append((nodes[a], nodes[c]))
    return out


def _folded(sketch: np.ndarray, length: int) -> np.ndarray:
    while len(sketch) > length:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _class_links(k: int, similarity: float):
    """Of some block pairs (class, i, j) and their packed texts (block, node, z): links (a, b) that span those of each block pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack, out = zstandard.ZstdDecompressor(), []
        for (_, i, j), part in pdf.groupby(["class", "i", "j"], sort=False):
            if len(part) > 1 and (i == j or part["block"].nunique() > 1):
                sets = [_shingle_set(unpack.decompress(z).decode(), k) for z in part["z"]]
                out += _similar_forest(part["node"].tolist(), part["block"].to_numpy(), sets, similarity)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    run.__annotations__ = {}
    return run


def near_links(texts: DataFrame, k: int = 5, similarity: float = 0.8, fingerprints: int = FINGERPRINTS) -> DataFrame:
    """Links (a, b) among texts (node long, text) of one class of fingerprints whose shingle sets have the wanted Jaccard
    similarity; they span the components of all such pairs.

    The texts of a class are dealt over blocks of about ``BLOCK_WORDS`` words, and each pair of blocks is compared in one
    call, so a large class is compared by many tasks and none holds more than two blocks of it.
    """
    member = saved(fingerprint_classes(texts, fingerprints))
    blocks = member.groupBy("class").agg(F.ceil(F.sum(F.col("words") + 50) / BLOCK_WORDS).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = member.join(blocks, "class").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = own.select("node", "class", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = saved(other.select("node", "class", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    calls = F.pmod(F.xxhash64("class", "i", "j"), F.lit(max(1, placed.count() // CALL_ROWS)))  # small classes share a call
    packed = _packed_texts(texts, KeyFilter(member.select("node"), "node")).dropDuplicates(["node"])
    return saved(placed.withColumn("x", calls).join(packed, "node").groupBy("x").applyInPandas(_class_links(k, similarity), "a long, b long"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, fingerprints: int = FINGERPRINTS) -> DataFrame:
    """``docs`` with one row of each group of exact or near copies: the one with the smallest id (nulls last).

    A link is an exact Jaccard similarity of the sets of ``k``-word shingles of at least ``similarity`` between two texts
    of one class of SimHash fingerprints (``fingerprint_classes``); groups are the components of all such links. Equal texts are one node, so copies cost nothing more; texts
    without a word (null, empty, blank) form one group. Repeated rows collapse to one. Rows without a copy or
    link are kept where they are read; only the others are shuffled.
    """
    if not docs.columns:
        return docs
    row_key = lambda i, tk: F.md5(F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), F.coalesce(tk, F.lit("null"))).cast("binary"))
    low = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("tk"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), text_key(text).alias("tk")).withColumn("node", F.coalesce(F.xxhash64("tk"), F.lit(0)))
    with batches_of(docs.sparkSession, BATCH_ROWS):
        found = saved(components(near_links(rows.select("node", "text"), k, similarity, fingerprints)))
    heads = rows.groupBy("node").agg(F.min(low).alias("low"), F.count("*").alias("n")).join(found, "node", "left").where("n > 1 or root is not null")
    heads = saved(heads.select("node", "low", F.coalesce("root", "node").alias("root")))
    best = heads.groupBy("root").agg(F.min("low").alias("low")).select("root", row_key(F.col("low.id"), F.col("low.tk")).alias("best"))
    ruled = rows.select("node", row_key(F.col("id"), F.col("tk")).alias("__key")).join(heads.join(best, "root").select("node", "best"), "node")
    ruled = saved(ruled.select("__key", (F.col("__key") == F.col("best")).alias("__head")).distinct())
    keyed = docs.withColumn("__key", row_key(F.col(id_col), text_key(text)))
    keyed = keyed.withColumn("__in", KeyFilter(ruled.select(F.xxhash64("__key").alias("key")), "key").column(F.xxhash64("__key")))
    alone = keyed.where(~F.col("__in"))
    among = keyed.where("__in").join(ruled, "__key", "left").where("__head is null or __head").dropDuplicates(["__key"])
    return alone.select(*docs.columns).union(among.select(*docs.columns))
