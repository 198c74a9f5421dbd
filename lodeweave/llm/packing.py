"""Documents put into containers of a fixed number of tokens: optimal length buckets, then batches inside them.

Sizes are token counts by a public byte-level BPE vocabulary (a path parameter).  A dynamic
programme over the global length histogram chooses bucket bounds that minimise padding; inside a
bucket documents form batches within the token budget.  A document larger than a container is
split into full containers and a rest; only such documents are split.

How space is kept: an item padded to its bucket's bound takes what capacity // bound items leave
each other, and the bounds that waste least of that decide how many items a batch has.  The padding
is not left empty: a completing step gives it, by real sizes, to items of smaller buckets, whose own
batches form only afterwards.

Null ids or texts are left out; empty texts take no space and stay out; repeated doc_ids count
once; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The word pattern of the byte-level BPE vocabularies (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items that one packing task takes; groups larger than this are dealt out at random into several.
GROUP = 50_000
_MEMO = 500_000


class TokenCounter:
    """Counts tokens word by word; words are few and repeat, so their counts are kept."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        memo, total = self.memo, 0
        for w in self.words.findall(text):
            n = memo.get(w)
            if n is None:
                if len(memo) > _MEMO:
                    memo.clear()
                n = memo[w] = len(self.encoding.encode_ordinary(w))
            total += n
        return total


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document with text."""
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return docs.mapInArrow(run, "doc_id bigint, tokens bigint").dropDuplicates(["doc_id"])


def bucket_bounds(histogram: np.ndarray, buckets: int = 24, step: int = 8) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets that minimise the padding of items up to their bucket's bound.

    histogram[n] is the number of items of n tokens.  The programme runs over lengths in steps, so
    its cost is fixed by the capacity: O(buckets * (capacity / step)^2).
    """
    capacity = len(histogram) - 1
    points = np.arange(0, capacity + 1, step)
    if points[-1] != capacity:
        points = np.append(points, capacity)
    count = np.concatenate(([0], np.cumsum(histogram[1:])))  # items up to n
    mass = np.concatenate(([0], np.cumsum(histogram[1:] * np.arange(1, capacity + 1))))
    c, m, k = count[points].astype(float), mass[points].astype(float), len(points)
    # a bound's items are padded to what 1/floor(capacity/bound) of a container is
    share = np.zeros(k)
    share[1:] = capacity / (capacity // points[1:])
    cost = share[None, :] * (c[None, :] - c[:, None]) - (m[None, :] - m[:, None])
    cost[np.tril_indices(k)] = np.inf
    best, choice = cost[0].copy(), []
    best[0] = 0
    for _ in range(1, buckets):
        total = best[:, None] + cost
        pick = total.argmin(axis=0)
        new = np.minimum(best, total[pick, np.arange(k)])
        choice.append(np.where(total[pick, np.arange(k)] < best, pick, -1))
        best = new
    out, at, level = [], k - 1, len(choice)
    while at > 0:
        out.append(int(points[at]))
        while level > 0 and choice[level - 1][at] < 0:
            level -= 1
        if level == 0:
            break
        at, level = int(choice[level - 1][at]), level - 1
    return sorted(set(out) | {capacity})


def fill(sizes: np.ndarray, bounds: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container of each item, and the bound of the bucket whose batch it is part of.

    Buckets go from the largest to the smallest.  A batch of a bucket takes as many of its items,
    largest first, as the token budget holds when each is padded to the bucket's bound: capacity //
    bound.  What the batch leaves free by real sizes is completed with items of smaller buckets, the
    largest that fits first, and then with further items of its own bucket.
    """
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        waiting[sizes[i]].append(i)
    bits = sum(1 << s for s, x in enumerate(waiting) if x)  # bit s is set while items of s tokens wait
    box, batch = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    opened = 0

    def take(mask: int, bound: int) -> int:
        """Puts the largest waiting item under the mask into the open container; its size."""
        nonlocal bits
        s = (bits & mask).bit_length() - 1
        i = waiting[s].pop()
        if not waiting[s]:
            bits &= ~(1 << s)
        box[i], batch[i] = opened, bound
        return s

    def up_to(n: int) -> int:
        return (1 << (n + 1)) - 1

    for low, bound in zip(reversed([0, *bounds[:-1]]), reversed(bounds)):
        own = up_to(bound) ^ up_to(low)
        while bits & own:
            free, room = capacity, capacity // bound
            while room and bits & own:
                free -= take(own, bound)
                room -= 1
            while bits & up_to(min(free, low)):
                free -= take(up_to(min(free, low)), bound)
            while bits & own & up_to(free):
                free -= take(own & up_to(free), bound)
            opened += 1
    return box, batch


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, group: int = GROUP) -> DataFrame:
    """(container, doc_id, part, tokens, bucket, batch): every token of every document once, no container over capacity.

    batch is the bound of the bucket that the container's batch was formed in, bucket that of the
    item's own; it is smaller where the item completes a batch of another bucket.  Bounds come from the whole corpus's histogram (capacity + 1 numbers).  Items are dealt into
    groups of about ``group`` items at random, each with the corpus's mix of lengths, and a group is
    packed in one task.
    """
    counts = written(token_counts(documents, vocabulary).where("tokens > 0"), "tokens")
    full = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    items = counts.withColumn("_full", full).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("_full"))).alias("part"), "tokens", "_full")
    items = items.select("doc_id", "part", F.when(F.col("part") < F.col("_full"), F.lit(capacity)).otherwise(F.col("tokens") - F.col("_full") * capacity).cast("bigint").alias("tokens"))
    whole = items.where(F.col("tokens") == capacity).select(F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("container"), "doc_id", "part", "tokens", F.lit(capacity).alias("bucket"), F.lit(capacity).alias("batch"))
    rest = items.where(F.col("tokens") < capacity)
    rows = rest.groupBy("tokens").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for r in rows:
        histogram[r.tokens] = r.n
    bounds = bucket_bounds(histogram)
    groups = int(histogram.sum() // group + 1)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "part"])
        sizes = pdf["tokens"].to_numpy()
        bucket = np.array(bounds)[np.searchsorted(bounds, sizes)]
        box, batch = fill(sizes, bounds, capacity)
        name = "g" + str(pdf["_g"].iloc[0]) + "-"
        return pd.DataFrame({"container": [name + str(b) for b in box], "doc_id": pdf["doc_id"], "part": pdf["part"], "tokens": sizes, "bucket": bucket, "batch": batch})

    mixed = rest.withColumn("_g", F.pmod(F.xxhash64("doc_id", "part"), F.lit(groups)).cast("int"))
    boxed = mixed.groupBy("_g").applyInPandas(run, "container string, doc_id bigint, part int, tokens bigint, bucket int, batch int")
    return whole.unionByName(boxed)


def packing_summary(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, items, items that complete batches of larger buckets, tokens and unused share per bucket of the batches, one more row for all."""
    boxes = containers.groupBy("container").agg(F.max("batch").alias("bucket"), F.count("*").alias("items"), F.sum((F.col("bucket") < F.col("batch")).cast("bigint")).alias("completing"), F.sum("tokens").alias("tokens"))
    return boxes.rollup("bucket").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("completing").alias("completing"), F.sum("tokens").alias("tokens")).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * capacity))
