"""Subject areas of documents: bisecting k-means over normalised term vectors, leaves named by labelled documents, sentences put on leaves by the leaves' discriminative terms, subjects by a document's mixture of leaves.

Null texts give no subject; a document whose sentences hold no known term takes the most frequent
subject of the labels; repeated rows come out once (the clusters see them as often as they occur); extra columns are ignored; without documents or
labels the result is empty.  Every statistic (term counts, inverse document frequencies, clusters)
covers all documents.  Labelled documents name the leaves: at most ``LABELLED`` of them are read.

Texts are read twice, once to count terms and once to turn sentences into term numbers; all later
passes run over those numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Terms of the vectors, leaves of the tree, labelled documents that may be read: all fixed, whatever the corpus's size.
TERMS, LEAVES, LABELLED = 8192, 32, 20_000
#: Passes over the documents per level of the tree.
ROUNDS = 2
#: Terms in a larger share of the documents than this say nothing of their subject.
MAX_SHARE = 0.3
#: A leaf tells a subject if that has so many times the labelled weight of the next one there.
PURE = 3
#: Weight that a sentence's terms must reach together for the sentence to lie on a leaf.
SPEAKS = 0.6
#: Words of at least three letters, not part of register names and numbers; ends of sentences.
_WORD = re.compile(r"[a-zà-öø-ÿœß]{3,}")
_RUNS = re.compile(r"\w+|\x00")
_OTHER_SPACE = re.compile(r"[\t\v\f\r\x1c-\x1f]")
_STOP = re.compile(r"[.!?](?=\s)|\n")
#: The mark of a sentence's end among the tokens; other signs of ASCII texts are blanks.
_END = "\x00"
_BLANKS = {k: " " for k in range(128) if k and not (chr(k).isalnum() or chr(k) == "_")}
#: Distinct tokens that a task remembers.
REMEMBERED = 1_000_000


def tokens(text: str, ends: bool) -> list[str]:
    """Runs of word signs in the lower-case text and, if wanted, the marks of the ends of sentences."""
    text = text.lower().replace(_END, "(")
    if not text.isascii():
        return _RUNS.findall(_STOP.sub(" \x00 ", text) if ends else text)
    if ends:
        text = text.replace("\n", " \x00 ")
        if _OTHER_SPACE.search(text):
            text = _OTHER_SPACE.sub(" ", text)
        for sign in (". ", "! ", "? "):
            text = text.replace(sign, "\x00 ")
        text = text.replace(_END, " \x00 ")
    return text.translate(_BLANKS).split()


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order and how often each occurs; sorts the array in place, which beats numpy.unique."""
    codes.sort()
    start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[start], np.diff(start, append=len(codes))


class Numbers(dict):
    """Number of each word met so far; tokens that are no words have -1."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[str] = []

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self.names) if _WORD.fullmatch(token) else -1
        if n >= 0:
            self.names.append(token)
        return n


class Known(dict):
    """Numbers of the words that vocabularies have; other words have -1 and tokens that are no words -2."""

    def __missing__(self, token: str) -> int:
        n = -1 if _WORD.fullmatch(token) else -2
        if len(self) < REMEMBERED:
            self[token] = n
        return n


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a batch's words take, and the bits of a row number."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents each word and each pair of neighbours occurs; tasks add up before the shuffle.

    A task numbers the words it meets; pairs are counted as numbers and spelt out once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, counts = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            start = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            return codes[start], np.add.reduceat(counts, start)

        def out() -> pa.RecordBatch:
            codes, counts = merged()
            names = np.array(known.names, object)
            first, second = names[codes >> 24], (codes & 0xFFFFFF) - 1
            spelt = [a if k < 0 else f"{a} {names[k]}" for a, k in zip(first, second)]
            return pa.RecordBatch.from_arrays([pa.array(spelt, pa.string()), pa.array(counts, pa.int64())], names=["term", "n"])

        for batch in sliced(batches):
            found: list[str] = []
            lengths: list[int] = []
            for text in batch.column(0).to_pylist():
                runs = tokens(text, False)
                found += runs
                lengths.append(len(runs))
            x = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
            word = x >= 0
            x, owner = x[word], np.repeat(np.arange(len(lengths)), lengths)[word]
            if not len(x):
                continue
            pair = (x[:-1] << 24) | (x[1:] + 1)
            pair = pair[owner[:-1] == owner[1:]]
            codes = np.concatenate([x << 24, pair])
            owners = np.concatenate([owner, owner[:-1][owner[:-1] == owner[1:]]])
            each, _ = counted((owners << 48) | codes)  # once per document
            c, n = counted(each & 0xFFFFFFFFFFFF)
            held.append((c, n))
            size += len(c)
            full = len(known) > REMEMBERED
            if size > 3_000_000 or full:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_500_000 or full:
                    yield out()
                    held, size = [], 0
                    known = Numbers()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Terms by number, set up for looking up whole batches of words."""

    def __init__(self, terms: list[str], idf: np.ndarray) -> None:
        self.idf = idf
        names = sorted({w for t in terms for w in t.split(" ")})
        self.words = Known({w: i + 1 for i, w in enumerate(names)} | {_END: 0})
        self.single = np.full(len(names) + 1, -1, np.int64)
        pairs = []
        for k, t in enumerate(terms):
            a, _, b = t.partition(" ")
            if b:
                pairs.append((self.words[a] * (len(names) + 1) + self.words[b], k))
            else:
                self.single[self.words[a]] = k
        pairs.sort()
        self.codes = np.array([c for c, _ in pairs] or [-1], np.int64)
        self.numbers = np.array([k for _, k in pairs] or [-1], np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
        """Per text: term numbers sentence by sentence, ends of the sentences, terms and weights of the unit tf-idf vector."""
        found: list[str] = []
        lengths = []
        for t in texts:
            runs = tokens(t, True)
            found += runs
            lengths.append(len(runs))
        x = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        word = x > -2
        x, owner = x[word], np.repeat(np.arange(len(texts)), lengths)[word]
        lengths = np.bincount(owner, minlength=len(texts))
        doc_ends = np.cumsum(lengths)
        stop = x == 0
        stop[doc_ends[lengths > 0] - 1] = True
        sentence = np.cumsum(stop) - stop
        known = np.flatnonzero(x > 0)
        single = known[self.single[x[known]] >= 0]
        left = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0) & (sentence[:-1] == sentence[1:])) if len(x) > 1 else np.zeros(0, np.int64)
        code = x[left] * len(self.single) + x[left + 1]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = self.codes[at] == code
        terms = np.concatenate([self.single[x[single]], self.numbers[at[hit]]])
        places = np.concatenate([single, left[hit]])
        order = np.argsort(sentence[places], kind="stable")
        terms, places = terms[order], places[order]
        docs, sents = owner[places], sentence[places]
        cut = np.searchsorted(docs, np.arange(len(texts) + 1))
        last = np.concatenate((np.diff(sents) != 0, [True])) if len(sents) else np.zeros(0, bool)
        where = np.flatnonzero(last) + 1
        bounds = np.searchsorted(where, cut, side="right")
        keys, tf = counted(docs * TERMS + terms)
        vec_docs, vec_terms = keys // TERMS, keys % TERMS
        v = tf * self.idf[vec_terms] if len(keys) else np.zeros(0)
        norm = np.sqrt(np.bincount(vec_docs, weights=v * v, minlength=len(texts)))
        v = (v / np.maximum(norm[vec_docs], 1e-12)).astype("<f2")
        vec_cut = np.searchsorted(vec_docs, np.arange(len(texts) + 1))
        terms, vec_terms, where = terms.astype("<u2"), vec_terms.astype("<u2"), where.astype(np.int64)
        for k in range(len(texts)):
            a, b, c, d = cut[k], cut[k + 1], vec_cut[k], vec_cut[k + 1]
            yield terms[a:b].tobytes(), (where[bounds[k] : bounds[k + 1]] - a).astype("<u4").tobytes(), vec_terms[c:d].tobytes(), v[c:d].tobytes()


def encoded(docs: DataFrame, vocabulary: list[str], idf: np.ndarray) -> DataFrame:
    """(doc_id, ids, ends, vec_ids, vec): see ``Vocabulary.encode``."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary, idf))  # at most TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            if batch.num_rows:
                cols = list(zip(*shared.value.encode(batch.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["doc_id", "ids", "ends", "vec_ids", "vec"])

    return docs.mapInArrow(run, "doc_id bigint, ids binary, ends binary, vec_ids binary, vec binary")


def vectors(documents: DataFrame) -> tuple[DataFrame, list[str], np.ndarray]:
    """The encoded documents, the vocabulary, and the inverse document frequencies."""
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    total = docs.count()
    known = term_counts(docs).where((F.col("n") >= min(3, total)) & (F.col("n") <= max(1, MAX_SHARE * total)))
    rows = known.orderBy(F.desc("n"), "term").limit(TERMS).collect()  # the vocabulary's size is fixed
    vocabulary = [r.term for r in rows]
    idf = np.log((total + 1) / (np.array([r.n for r in rows], float) + 1))
    return written(encoded(docs, vocabulary, idf), "encoded"), vocabulary, idf


class Tree:
    """Nodes of the bisection: unit centres by node, children of split nodes."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres, self.children = centres, {}

    def descend(self, ids: np.ndarray, vals: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Leaf of each vector; vectors are flat, one after the other."""
        node = np.zeros(len(ends), np.int64)
        if not self.children:
            return node
        # one row for each node: second child's centre less the first's, zeros for leaves
        terms = self.centres.shape[1]
        pair = np.repeat(np.arange(len(self.centres))[:, None], 2, axis=1)
        for k, c in self.children.items():
            pair[k] = c
        steps = self.centres[pair[:, 1]] - self.centres[pair[:, 0]]
        lengths = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(ends)), lengths)
        while True:
            side = np.bincount(owner, weights=steps.take(np.repeat(node * terms, lengths) + ids) * vals, minlength=len(ends))
            after = pair[node, (side > 0).astype(np.int64)]
            if (after == node).all():
                return node
            node = after


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, ends = _joined(batch.column("vec_ids"))
    vals, _ = _joined(batch.column("vec"))
    return np.frombuffer(ids, "<u2").astype(np.int64), np.frombuffer(vals, "<f2").astype(np.float64), ends // 2


def _joined(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes of a column without nulls, and where each value ends."""
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_binary(column.type)
    cut = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return memoryview(data or b"")[cut[0] : cut[-1]], cut[1:] - cut[0]


def _sums(points: DataFrame, tree: Tree, terms: int) -> dict[int, tuple[int, np.ndarray]]:
    """Per leaf the number and the sum of its vectors: one pass over all documents, one row per task and leaf."""
    shared = points.sparkSession.sparkContext.broadcast(tree)  # at most 2 * LEAVES * TERMS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        count = np.zeros(len(t.centres), np.int64)
        total = np.zeros((len(t.centres), terms))
        for batch in batches:
            if batch.num_rows:
                ids, vals, ends = _flat(batch)
                node = t.descend(ids, vals, ends)
                count += np.bincount(node, minlength=len(count))
                owner = np.repeat(node, np.diff(np.concatenate(([0], ends))))
                total += np.bincount(owner * terms + ids, weights=vals, minlength=total.size).reshape(total.shape)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(count[used], pa.int64()), pa.array([total[k].astype("<f4").tobytes() for k in used], pa.binary())], names=["leaf", "n", "total"])

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(b, "<f4").astype(float) for b in pdf["total"])
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "n": [pdf["n"].sum()], "total": [total.astype("<f4").tobytes()]})

    parts = points.select("vec_ids", "vec").mapInArrow(run, "leaf bigint, n bigint, total binary")
    halves = parts.withColumn("_s", F.pmod(F.xxhash64("total"), F.lit(8))).groupBy("leaf", "_s").applyInPandas(lambda pdf: add(pdf), "leaf bigint, n bigint, total binary") if int(points.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) > 64 else parts
    return {r.leaf: (r.n, np.frombuffer(r.total, "<f4").astype(float)) for r in halves.groupBy("leaf").applyInPandas(lambda pdf: add(pdf), "leaf bigint, n bigint, total binary").collect()}


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


def leaves(points: DataFrame, terms: int, most: int = LEAVES, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres of the leaves: all leaves that are large enough split at once, largest first, until there are ``most``.

    A split starts from the parent's centre with its terms weighed up and down at random, and
    settles in ``rounds`` passes.
    """
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, terms)))
    sums = _sums(points, tree, terms)
    if not sums:
        return np.zeros((0, terms))
    total = sum(n for n, _ in sums.values())
    tree.centres = _unit(sums[0][1])[None, :]
    while True:
        room = most - len(sums)
        large = sorted((k for k, (n, _) in sums.items() if n >= max(4, total // (4 * most))), key=lambda k: (-sums[k][0], k))[:room]
        if not large:
            break
        for k in large:
            sign = rng.choice([-0.5, 0.5], terms)
            base = len(tree.centres)
            tree.centres = np.concatenate([tree.centres, _unit(np.stack([sums[k][1] * (1 + sign), sums[k][1] * (1 - sign)]))])
            tree.children[k] = (base, base + 1)
        for _ in range(rounds):
            sums = _sums(points, tree, terms)
            for k, (n, v) in sums.items():
                tree.centres[k] = _unit(v)
    return tree.centres[sorted(sums)]


def discriminative(centres: np.ndarray) -> np.ndarray:
    """A leaf's weight of each term against the mean of all leaves, below zero cut off, rows of unit length."""
    d = np.maximum(centres - centres.mean(axis=0), 0)
    return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)


def leaf_subjects(points: DataFrame, labels: DataFrame, centres: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Subjects, and per leaf the share of each among the labelled documents near it, every subject weighing the same."""
    named = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    some = named.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    some = some.orderBy(F.xxhash64("doc_id")).limit(LABELLED)  # a documented bound on what names the leaves
    rows = points.select("doc_id", "vec_ids", "vec").join(some, "doc_id").collect()
    names = sorted({s for r in rows for s in r.subjects})
    near = np.full((len(centres), len(names)), 1e-3)
    for r in rows:
        d = centres[:, np.frombuffer(r.vec_ids, "<u2")] @ np.frombuffer(r.vec, "<f2").astype(float)
        w = np.where(d >= 0.5 * d.max(), d, 0) ** 4
        if w.sum() > 0:
            for s in r.subjects:
                near[:, names.index(s)] += w / w.sum() / len(r.subjects)
    near /= near.sum(axis=0, keepdims=True)
    return names, near / near.sum(axis=1, keepdims=True)


def leaf_terms(centres: np.ndarray, near: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Terms by leaves: how much a term tells a leaf from the mean of all and from the leaves of other subjects.

    A leaf has the subject that is nearest to it; leaves whose nearest subject is not clear tell
    nothing, and a term speaks for the leaves of one subject only.
    """
    w = discriminative(centres).T
    ranked = np.sort(near, axis=1)[:, ::-1]
    if near.shape[1] > 1:
        w[:, ranked[:, 0] < PURE * ranked[:, 1]] = 0
    label = near.argmax(axis=1)
    best = np.stack([w[:, label == k].max(axis=1, initial=0) for k in range(near.shape[1])], axis=1)
    top = np.sort(best, axis=1)[:, ::-1]
    others = np.where(best.argmax(axis=1)[:, None] == np.arange(near.shape[1]), top[:, 1:2] if near.shape[1] > 1 else 0, top[:, :1])
    return np.maximum(w - others[:, label], 0) * idf[:, None]


def mixtures(ids: list[bytes], ends: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Documents by leaves: a document's mixture is the mean of its sentences', each spread over the leaves by what its terms weigh for them; zeros if no sentence has such terms."""
    out = np.zeros((len(ids), weights.shape[1]), np.float32)
    terms = np.array([len(x) // 2 for x in ids])
    sentences = np.array([len(x) // 4 for x in ends])
    if not sentences.sum() or not weights.shape[1]:
        return out
    stops = np.frombuffer(b"".join(ends), "<u4").astype(np.int64) + np.repeat(np.cumsum(terms) - terms, sentences)
    score = np.add.reduceat(weights[np.frombuffer(b"".join(ids), "<u2")], np.concatenate(([0], stops[:-1])), axis=0)
    owner = np.repeat(np.arange(len(ids)), sentences)
    total = score.sum(axis=1)
    tells = total >= SPEAKS
    if not tells.any():
        return out
    score, owner = score[tells] / total[tells, None], owner[tells]
    docs, first, n = np.unique(owner, return_index=True, return_counts=True)
    out[docs] = np.add.reduceat(score, first, axis=0) / n[:, None]
    return out


#: Share of the sentences that makes a subject one of the document's.
LEAST_SHARE = 0.23


class Model:
    """What the scoring of documents needs; its size is fixed by ``TERMS``, ``LEAVES`` and the number of subjects."""

    def __init__(self, names: list[str], weights: np.ndarray, label: np.ndarray) -> None:
        tells = weights.any(axis=0)  # leaves that tell nothing take no part
        self.names, self.weights = names, weights[:, tells].astype(np.float32)
        self.of_subject = (label[tells][:, None] == np.arange(len(names))).astype(np.float32)

    def subjects(self, ids: list[bytes], ends: list[bytes], least: float = LEAST_SHARE) -> list[list[tuple[str, float]]]:
        """Per document the subjects of the leaves in its mixture that reach the least share, the largest if none does; three at most, as the task defines."""
        share = mixtures(ids, ends, self.weights) @ self.of_subject
        out = []
        for row, order in zip(share.tolist(), np.argsort(-share, axis=1, kind="stable")[:, :3].tolist()):
            best = [(self.names[i], row[i]) for i in order if row[i] >= least]
            out.append(best or [(self.names[i], row[i]) for i in order[:1] if row[i] > 0])
        return out


def fit(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str], Model]:
    """The encoded documents, the vocabulary and the model."""
    points, vocabulary, idf = vectors(documents)
    centres = leaves(points, len(vocabulary))
    names, near = leaf_subjects(points, labels, centres)
    if not len(names) or not len(centres):
        return points, vocabulary, Model(names, np.zeros((len(vocabulary), 0)), np.zeros(0, np.int64))
    return points, vocabulary, Model(names, leaf_terms(centres, near, idf), near.argmax(axis=1))


def assigned(documents: DataFrame, labels: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, subject, share), one to three rows per document with text."""
    points, _, model = fit(documents, labels)
    common = labels.where("subject is not null").groupBy("subject").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "subject").first()
    rest = [(common.subject, 0.0)] if common else []
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in sliced(batches, 256):
            keys, ids, ends = (c.to_pylist() for c in batch.columns)
            rows = [(i, s, x) for i, found in zip(keys, m.subjects(ids, ends, least)) for s, x in found or rest]
            if rows:
                a, b, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.float64())], names=["doc_id", "subject", "share"])

    return points.select("doc_id", "ids", "ends").mapInArrow(run, "doc_id bigint, subject string, share double").dropDuplicates(["doc_id", "subject"])


def composition(subjects: DataFrame) -> DataFrame:
    """Documents and share of the corpus per subject; a document counts in equal parts for its subjects."""
    parts = subjects.withColumn("_w", 1 / F.count("*").over(Window.partitionBy("doc_id")))
    total = parts.agg(F.countDistinct("doc_id").alias("_n"))
    return parts.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("_w").alias("weight")).crossJoin(F.broadcast(total)).select("subject", "documents", (F.col("weight") / F.col("_n")).alias("share"))
