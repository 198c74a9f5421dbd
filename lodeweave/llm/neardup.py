"""Near-duplicate chunks: rare-first prefix filtering on word 5-shingles, verified once per pair.

Words are the maximal runs of [a-z0-9_] of the lower-cased text without its `N: ` line prefixes;
a chunk is the set of its runs of ``SHINGLE`` consecutive words, and two chunks are neighbours if
the Jaccard index of their sets reaches the threshold.  Chunks with fewer than ``MIN_WORDS``
words, a null id or a null text don't take part; repeated rows count once; ties keep the smaller
id as representative.  Extra columns are ignored and an empty table gives empty results.

Plan: (1) one pass over the texts writes each chunk's shingle hashes and a fixed-size frequency
sketch; (2) each set's rarest shingles, as many as the threshold needs, go to hash buckets as
packed blocks, copies dropped before the shuffle; (3) inside a bucket chunks that share a prefix
shingle become candidates if length and position allow, and the list of a shingle in more than
``HEAVY`` prefixes is cut into blocks, each pair of which meets in a group of its own; (4) distinct candidates meet their two
sets once, pass a suffix filter and are verified.  Chunks with equal sets share one key from (2)
on, so groups of copies cost one member.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import written

SHINGLE, MIN_WORDS = 5, 40
#: Bytes kept of a shingle's hash. Two shingles of a pair of chunks fall together once in 10^12 times the product of their sizes.
HASH_BYTES = 5
#: Records of one shingle that a group pairs; longer lists are split.
HEAVY = 2_000
SKETCH_BITS = 22
SKETCH_PARTS = 64
_PREFIX = re.compile(r"(?m)^\d+: ?")
_WORDS = re.compile(rb"[a-z0-9_]+")
_MASK = np.uint64((1 << (8 * HASH_BYTES)) - 1)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, size: int = SHINGLE, least: int = MIN_WORDS) -> np.ndarray | None:
    """Sorted distinct shingle hashes, or None for too few words."""
    words = _WORDS.findall(_PREFIX.sub("", text).lower().encode("utf-8", "replace"))
    if len(words) < max(least, size):
        return None
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    x = h[:n].copy()
    for k in range(1, size):
        x ^= x >> np.uint64(29)
        x *= _P
        x += h[k : k + n]
    x ^= x >> np.uint64(32)
    x *= _P
    return np.unique((x ^ (x >> np.uint64(29))) & _MASK)


def pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, HASH_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :HASH_BYTES] = raw
    return out.view("<u8").ravel()


#: Shingles that two prefixes, longer by as many less one, must share: a true pair can't have fewer, others seldom have as many.
SHARED = 4


def prefix_size(n: int, threshold: float) -> int:
    return min(n, n - math.ceil(threshold * n - 1e-9) + SHARED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    low = np.uint64((1 << SKETCH_BITS) - 1)
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingles(text.as_py())
            if s is not None:
                np.add.at(sketch, (s & low).astype(np.int64), 1)
                blob = pack(s)
                rows.append((i, xxhash.xxh3_64_intdigest(blob) - (1 << 63), len(s), blob))
        if rows:
            yield out(rows)
    if sketch.any():
        for k, piece in enumerate(np.split(sketch, SKETCH_PARTS)):
            yield out([(None, k, None, zlib.compress(piece.astype("<u4").tobytes(), 1))])


def shingle_sets(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, sketches): sets (id, key, n, blob) with one row per chunk row; sketches (part, blob) with one row per part and task."""
    texts = chunks.where("id is not null and text is not null").select("id", "text")
    both = written(texts.mapInArrow(_sets, "id bigint, key bigint, n int, blob binary"), "sets")
    return both.where("id is not null"), both.where("id is null").select(F.col("key").alias("part"), "blob")


def summed_sketch(sketches: DataFrame) -> np.ndarray:
    """The corpus-wide counts of shingle hash classes: 2**SKETCH_BITS numbers whatever the corpus's size, 16 MB."""

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(b), "<u4").astype(np.uint64) for b in pdf["blob"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "blob": [zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)]})

    # two levels, so that no group holds the pieces of all tasks
    first = sketches.withColumn("_s", F.pmod(F.xxhash64("blob"), F.lit(16))).groupBy("part", "_s").applyInPandas(lambda pdf: add(pdf), "part bigint, blob binary")
    rows = first.groupBy("part").applyInPandas(lambda pdf: add(pdf), "part bigint, blob binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint32)
    return np.concatenate([np.frombuffer(zlib.decompress(r.blob), "<u4") for r in sorted(rows)])


_RECORD = np.dtype([("hash", "<u8"), ("key", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _encode(r: np.ndarray) -> bytes:
    """Records of one bucket: keys listed once, hashes in HASH_BYTES, local key numbers and positions in the fewest bytes."""
    keys, local = np.unique(r["key"], return_inverse=True)
    sizes = np.zeros(len(keys), "<u4")
    sizes[local] = r["n"]
    wide_key, wide_pos = ("<u2" if len(keys) < 65536 else "<u4"), ("<u2" if r["pos"].max() < 65536 else "<u4")
    head = np.array([len(r), len(keys), int(wide_key[-1]), int(wide_pos[-1])], "<u4")
    return b"".join([head.tobytes(), pack(r["hash"]), keys.tobytes(), sizes.tobytes(), local.astype(wide_key).tobytes(), r["pos"].astype(wide_pos).tobytes()])


def _decode(blob: bytes) -> np.ndarray:
    count, keys, wk, wp = np.frombuffer(blob, "<u4", 4).tolist()
    at = 16
    out = np.zeros(count, _RECORD)
    out["hash"] = unpack(blob[at : at + HASH_BYTES * count])
    at += HASH_BYTES * count
    k = np.frombuffer(blob, "<i8", keys, at)
    at += 8 * keys
    n = np.frombuffer(blob, "<u4", keys, at)
    at += 4 * keys
    local = np.frombuffer(blob, f"<u{wk}", count, at)
    at += wk * count
    out["key"], out["n"], out["pos"] = k[local], n[local], np.frombuffer(blob, f"<u{wp}", count, at)
    return out


def prefix_blocks(sets: DataFrame, sketch: np.ndarray, threshold: float, buckets: int) -> DataFrame:
    """(bucket, blob): the rarest shingles of each set, packed per bucket; equal sets of a task count once."""
    shared = sets.sparkSession.sparkContext.broadcast(sketch)  # 16 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low = shared.value, np.uint64((1 << SKETCH_BITS) - 1)
        held: list[np.ndarray] = []
        size, done = 0, set()
        schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

        def flush() -> pa.RecordBatch:
            r = np.concatenate(held)
            b = ((r["hash"] * _P) >> np.uint64(40)).astype(np.int64) % buckets
            order = np.argsort(b, kind="stable")
            r, b = r[order], b[order]
            cut = np.flatnonzero(np.diff(b)) + 1
            parts = np.split(r, cut)
            firsts = b[np.concatenate(([0], cut))]
            return pa.RecordBatch.from_arrays([pa.array(firsts.astype(np.int32)), pa.array([_encode(p) for p in parts], pa.binary())], schema=schema)

        for batch in batches:
            for key, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key in done:
                    continue
                if len(done) > 1_000_000:
                    done.clear()
                done.add(key)
                h = unpack(blob.as_py())
                p = prefix_size(n, threshold)
                rank = np.lexsort((h, counts[(h & low).astype(np.int64)]))[:p]
                r = np.zeros(p, _RECORD)
                r["hash"], r["key"], r["n"], r["pos"] = h[rank], key, n, np.arange(p)
                held.append(r)
                size += p
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return sets.select("key", "n", "blob").mapInArrow(run, "bucket int, blob binary")


def pairs_in_bucket(r: np.ndarray, threshold: float, side: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs (key_a, key_b, least overlap, shared) of one bucket's records, block by block; a pair may come in several blocks.

    With ``side`` only records of different sides pair.

    Records of a shingle are sorted by set size; each meets those after it while the length filter
    allows.  The smaller set must hold the shingle in its index prefix, and the positions must leave
    enough shingles before and after them.
    """
    order = np.lexsort((r["key"], r["n"], r["hash"]))
    r = r[order]
    if side is not None:
        side = side[order]
    edges = np.flatnonzero(np.diff(r["hash"])) + 1
    start = np.concatenate(([0], edges))
    end = np.concatenate((edges, [len(r)]))
    keep = end - start > 1
    start, end = start[keep], end[keep]
    if not len(start):
        return
    length = end - start
    rows = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
    stop = np.repeat(end, length)
    n, pos = r["n"].astype(np.int64), r["pos"].astype(np.int64)
    index = n[rows] - np.ceil(2 * threshold / (1 + threshold) * n[rows] - 1e-9).astype(np.int64) + SHARED
    ok = pos[rows] < index
    rows, stop = rows[ok], stop[ok]
    ahead, alive = 1, np.arange(len(rows))
    found: list[np.ndarray] = []
    size = 0
    while len(alive):
        a, b = rows[alive], rows[alive] + ahead
        inside = b < stop[alive]
        alive, a, b = alive[inside], a[inside], b[inside]
        fits = n[a] >= threshold * n[b] - 1e-9
        alive, a, b = alive[fits], a[fits], b[fits]
        need = np.ceil(threshold / (1 + threshold) * (n[a] + n[b]) - 1e-9).astype(np.int64)
        good = np.minimum(pos[a], pos[b]) + 1 + np.minimum(n[a] - pos[a] - 1, n[b] - pos[b] - 1) >= need
        if side is not None:
            good &= side[a] != side[b]
        if good.any():
            x, y = r["key"][a[good]], r["key"][b[good]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y), need[good], np.ones(len(x), np.int64)], axis=1))
            size += len(x)
            if size > 4_000_000:
                yield _summed(found)
                found, size = [], 0
        ahead += 1
    if found:
        yield _summed(found)


def _summed(found: list[np.ndarray]) -> np.ndarray:
    """Rows of equal pairs added up."""
    p = np.concatenate(found)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    first = np.flatnonzero(np.concatenate(([True], (p[1:, :2] != p[:-1, :2]).any(axis=1))))
    out = p[first]
    out[:, 3] = np.add.reduceat(p[:, 3], first)
    return out


_PAIRS = "key_a bigint, key_b bigint, need bigint, shared bigint"


def _frame(found: list[np.ndarray]):
    import pandas as pd

    both = _summed(found) if found else np.zeros((0, 4), np.int64)
    return pd.DataFrame({"key_a": both[:, 0], "key_b": both[:, 1], "need": both[:, 2], "shared": both[:, 3]})


def candidates(blocks: DataFrame, threshold: float, heavy: int = HEAVY) -> DataFrame:
    """Distinct candidate pairs (key_a < key_b, need): pairs whose prefixes share enough shingles over all buckets.

    A bucket's task pairs the records of its shingles.  A shingle with more than ``heavy`` of them
    leaves the task as blocks of that size; each pair of blocks becomes a group, so that no task has
    more than 2 * ``heavy`` records of a shingle to pair, and every pair is still met once.
    """

    def run(pdf):
        import pandas as pd

        r = np.unique(np.concatenate([_decode(b) for b in pdf["blob"]]))  # by hash, then key: copies from several tasks fall together
        cuts = np.flatnonzero(np.diff(r["hash"])) + 1
        lists = [x for x in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(r)]))) if x[1] - x[0] > heavy]
        light, rows = np.ones(len(r), bool), []
        for a, b in lists:
            light[a:b] = False
            parts = -(-(b - a) // heavy)
            rows += [(int(r["hash"][a]), k, parts, _encode(r[a + k * heavy : min(b, a + (k + 1) * heavy)])) for k in range(parts)]
        out = _frame(list(pairs_in_bucket(r[light], threshold)))
        pair = np.repeat([True, False], [len(out), len(rows)])  # keys are too large for the floats that missing numbers would make of them
        columns = {c: pd.arrays.IntegerArray(np.concatenate([out[c].to_numpy(), np.zeros(len(rows), np.int64)]), ~pair) for c in out.columns}
        for k, c in enumerate(("hash", "part", "parts")):
            columns[c] = pd.arrays.IntegerArray(np.array([0] * len(out) + [x[k] for x in rows], np.int64), pair.copy())
        return pd.DataFrame({**columns, "blob": [None] * len(out) + [x[3] for x in rows]})

    def across(pdf):
        pdf = pdf.sort_values("part")
        lists = [_decode(b) for b in pdf["blob"]]
        side = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if len(lists) > 1 else None
        return _frame(list(pairs_in_bucket(np.concatenate(lists), threshold, side)))

    met = written(blocks.groupBy("bucket").applyInPandas(run, f"{_PAIRS}, hash bigint, part bigint, parts bigint, blob binary"), "met")
    split = met.where("hash is not null").select("hash", "part", "blob", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("_o"))
    met_blocks = split.groupBy("hash", F.least("part", "_o").alias("_lo"), F.greatest("part", "_o").alias("_hi")).applyInPandas(across, _PAIRS)
    every = met.where("key_a is not null").select("key_a", "key_b", "need", "shared").unionByName(met_blocks)
    added = every.groupBy("key_a", "key_b", "need").agg(F.sum("shared").alias("shared"))
    return added.where(F.col("shared") >= F.least(F.lit(SHARED), F.col("need"))).drop("shared")


def suffix_allows(a: np.ndarray, b: np.ndarray, need: int, depth: int = 2) -> bool:
    """Whether an upper bound of the overlap of two sorted sets, got by halving them, still reaches what is needed."""

    def bound(x: np.ndarray, y: np.ndarray, d: int) -> int:
        if d == 0 or len(x) < 8 or len(y) < 8:
            return min(len(x), len(y))
        mid = x[len(x) // 2]
        cut = int(np.searchsorted(y, mid))
        return bound(x[: len(x) // 2], y[:cut], d - 1) + bound(x[len(x) // 2 :], y[cut:], d - 1)

    return bound(a, b, depth) >= need


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(key_a, key_b, similarity) of the candidates that reach the threshold; each pair meets its sets once."""
    wanted = pairs.select(F.col("key_a").alias("key")).union(pairs.select("key_b")).distinct()
    one = sets.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("blob").alias("blob"))
    one = written(one, "candidates")
    both = pairs.join(one.select(F.col("key").alias("key_a"), F.col("blob").alias("blob_a")), "key_a").join(one.select(F.col("key").alias("key_b"), F.col("blob").alias("blob_b")), "key_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("similarity", pa.float64())])
        for batch in batches:
            rows = []
            for ka, kb, xa, xb in zip(*(batch.column(i) for i in range(4))):
                a, b = unpack(xa.as_py()), unpack(xb.as_py())
                need = math.ceil(threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9)
                if not suffix_allows(a, b, need):
                    continue
                at = np.searchsorted(a, b)
                shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                if shared >= need:
                    rows.append((ka.as_py(), kb.as_py(), shared / (len(a) + len(b) - shared)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return both.select("key_a", "key_b", "blob_a", "blob_b").mapInArrow(run, "key_a bigint, key_b bigint, similarity double")


def near_duplicates(chunks: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes (id, key) puts each chunk in the class of its set; links (key_a, key_b, similarity) join classes."""
    sets, sketches = shingle_sets(chunks)
    total = sets.agg(F.sum("n")).first()[0] or 0
    records = int(total * (1 - threshold)) + 1
    spark = chunks.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), records // 1_500_000 + 1)
    sketch = summed_sketch(sketches)
    blocks = prefix_blocks(sets, sketch, threshold, buckets)
    pairs = written(candidates(blocks, threshold), "pairs")
    links = written(verified(pairs, sets, threshold), "links")
    return sets.select("id", "key").distinct(), links


def near_duplicate_pairs(chunks: DataFrame, threshold: float) -> DataFrame:
    """All pairs (id_a < id_b) of chunks, members of equal sets included."""
    classes, links = near_duplicates(chunks, threshold)
    a = classes.select(F.col("id").alias("x"), F.col("key").alias("key_a"))
    b = classes.select(F.col("id").alias("y"), F.col("key").alias("key_b"))
    across = links.join(a, "key_a").join(b, "key_b").select("x", "y")
    many = classes.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    copies = classes.join(many, "key", "left_semi")
    within = copies.select(F.col("id").alias("x"), "key").join(copies.select(F.col("id").alias("y"), "key"), "key").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(chunks: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, group_id, links): per chunk its class (smallest id with an equal set), its group, and how many classes its class is linked with."""
    classes, links = near_duplicates(chunks, threshold)
    names = classes.groupBy("key").agg(F.min("id").alias("class_id"))
    edges = links.join(names.select(F.col("key").alias("key_a"), F.col("class_id").alias("a")), "key_a").join(names.select(F.col("key").alias("key_b"), F.col("class_id").alias("b")), "key_b").select("a", "b")
    edges = written(edges, "edges")
    degree = edges.select(F.col("a").alias("class_id")).union(edges.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    groups = connected_components(edges, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    named = names.join(degree, "class_id", "left").join(groups, "class_id", "left").select("key", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return classes.join(named, "key").select("id", "class_id", "group_id", "links")
