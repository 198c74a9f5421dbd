"""Evaluation passages inside documents: q-gram lemma filter in overlapping diagonal bands, then banded alignment.

Texts become their words (maximal runs of [a-z0-9_] of the lower-cased text) with one blank between.
A document that shares a passage of ``RUN`` words with an item, but for k edits, shares, in a band of
diagonals, at least L + 1 - q - k q of its q-grams, where L is the length of the passage.  Steps for
a document: (1) stretches with that many q-grams of any item, by one bit per q-gram; (2) of every
stretch of an item's q-grams as long as its shortest passage the k q + ``LEFT`` rarest are seeds, of
which the edits must leave ``LEFT`` in a band: they name items and diagonals; (3) the q-grams that document and item
share in the band are counted, regions below the bound dropped; (4) the rest is aligned: stretches
of equal letters are chained over the band's diagonals and what lies between them is aligned within
``k`` edits.  A region stays if a passage of ``RUN`` words lies on its alignment with at most k edits.

Null ids or texts and items of fewer than ``RUN`` words are left out; repeated rows count once; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, Q, EDITS = 13, 8, 2
#: Diagonals of a band; bands overlap by half.
BAND = 16
#: Size of an index block, and blocks that travel to the executors for one pass over the documents; more items take further passes.
BLOCK_ITEMS, BLOCK_CHARS, BLOCKS = 20_000, 4_000_000, 4
#: Seeds of a passage that the edits leave, and q-grams up to which all of a block's are seeds. Both weigh the index's size against bands named by chance; the result is the same.
LEFT, ALL = 10, 1_000_000
_WORDS = re.compile(rb"[a-z0-9_]+")
_P = np.uint64(0x9E3779B97F4A7C15)
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("doc_end", pa.int64()), ("item_start", pa.int64()), ("item_end", pa.int64()), ("edits", pa.int32()), ("run_words", pa.int32())]
)
REGIONS = "doc_id bigint, item_id bigint, doc_start bigint, doc_end bigint, item_start bigint, item_end bigint, edits int, run_words int"


def normal(text: str) -> bytes:
    return b" ".join(_WORDS.findall(text.lower().encode("utf-8", "replace")))


def grams(text: bytes) -> np.ndarray:
    """The q-gram that starts at each byte, as a number."""
    if len(text) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", text, strides=(1,)).copy()


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, edits: int = EDITS) -> None:
        self.run, self.edits = run, edits
        self.ids, self.texts, self.need = [], [], []
        for item_id, text in items:
            t = normal(text)
            words = t.split(b" ")
            if len(words) < run or not t:
                continue
            ends = np.cumsum([len(w) + 1 for w in words])
            spans = ends[run - 1 :] - np.concatenate(([0], ends[: len(ends) - run])) - 1
            self.ids.append(item_id)
            self.texts.append(t)
            self.need.append(max(1, int(spans.min()) + 1 - Q - edits * Q))
        #: Places of the q-grams of the shortest passage, and how many of them the edits leave: holds for any stretch of any passage.
        self.least = min(self.need, default=1)
        self.width = self.least + edits * Q
        every = [grams(t) for t in self.texts]
        flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
        self.bits = max(16, int(16 * len(flat)).bit_length())  # 16 to 32 bits a q-gram, whatever the number of items
        self.seen = np.zeros(1 << (self.bits - 3), np.uint8)
        slot = self._slot(flat)
        np.bitwise_or.at(self.seen, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        self._seeds(every, flat)

    def _seeds(self, every: list[np.ndarray], flat: np.ndarray) -> None:
        """Of every ``width`` q-grams in a row the rarest that the edits can't all spoil, in one order for all items."""
        known, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((known * _P, counts))
        rank = np.empty(len(known), np.int64)
        rank[order] = np.arange(len(known))
        rank = rank[inverse]
        values, owners, places, at = [], [], [], 0
        self.left = self.least if len(flat) <= ALL else min(LEFT, self.least)
        enough = self.edits * Q + self.left
        for k, g in enumerate(every):
            mine = rank[at : at + len(g)]
            at += len(g)
            n = min(self.width, len(mine))
            windows = np.lib.stride_tricks.sliding_window_view(mine, n)
            last = np.partition(windows, min(enough, n) - 1, axis=1)[:, min(enough, n) - 1]
            # a place is a seed if some window over it ranks it among its rarest: the most tolerant window counts
            padded = np.concatenate([np.full(n - 1, -1), last, np.full(n - 1, -1)])
            best = np.lib.stride_tricks.sliding_window_view(padded, n).max(axis=1)
            seeds = np.flatnonzero(mine <= best)
            values.append(g[seeds])
            owners.append(np.full(len(seeds), k, np.int32))
            places.append(seeds.astype(np.int32))
        v = np.concatenate(values) if values else np.zeros(0, np.uint64)
        order = np.argsort(v, kind="stable")
        self.values = v[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int32))[order]
        self.places = (np.concatenate(places) if places else np.zeros(0, np.int32))[order]

    def _slot(self, v: np.ndarray) -> np.ndarray:
        return ((v * _P) >> np.uint64(64 - self.bits)).astype(np.int64)

    def regions(self, doc: bytes, g: np.ndarray | None = None) -> list[tuple]:
        """(item, doc_start, doc_end, item_start, item_end, edits, run_words) of the regions that pass the filter and the alignment."""
        g = grams(doc) if g is None else g
        if not len(g) or not len(self.values):
            return []
        slot = self._slot(g)
        seen = (self.seen[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        if len(g) > self.width:
            total = np.concatenate(([0], np.cumsum(seen)))
            dense = np.flatnonzero(total[self.width :] - total[: -self.width] >= self.least)
            if not len(dense):
                return []
            cover = np.zeros(len(g) + 1, np.int32)
            np.add.at(cover, dense, 1)
            np.add.at(cover, dense + self.width, -1)
            seen &= np.cumsum(cover[:-1]) > 0
        at = np.flatnonzero(seen)
        if not len(at):
            return []
        lo, hi = np.searchsorted(self.values, g[at], "left"), np.searchsorted(self.values, g[at], "right")
        hits = hi - lo
        if not hits.any():
            return []
        d = np.repeat(at, hits)
        k = np.repeat(lo - np.concatenate(([0], np.cumsum(hits)[:-1])), hits) + np.arange(hits.sum())
        owner, p = self.owners[k].astype(np.int64), self.places[k].astype(np.int64)
        code = owner << np.int64(42) | (d - p + (1 << 40)) // (BAND // 2)
        order = np.argsort(code, kind="stable")
        d, p, code = d[order], p[order], code[order]
        # seeds of each half band; a band is two neighbouring halves, and lies in a row
        starts = np.flatnonzero(np.concatenate(([True], np.diff(code) != 0)))
        halves, ends = code[starts], np.append(starts[1:], len(code))
        after = np.append(halves[1:] == halves[:-1] + 1, False)
        ends = np.where(after, np.append(ends[1:], len(code)), ends)
        out: list[tuple] = []
        for j in np.flatnonzero(ends - starts >= self.left).tolist():
            item, low = int(halves[j]) >> 42, ((int(halves[j]) & ((1 << 42) - 1)) - (1 << 40) // (BAND // 2)) * (BAND // 2)
            if self.left < self.least:
                out += self._band_regions(doc, item, *self._shared(g, item, low))
            elif ends[j] - starts[j] >= self.need[item]:
                mine = np.argsort(d[starts[j] : ends[j]], kind="stable") + starts[j]
                out += self._band_regions(doc, item, d[mine], p[mine])
        return out

    def _shared(self, g: np.ndarray, item: int, low: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the q-grams that document and item share in the band that begins at ``low``."""
        own = grams(self.texts[item])
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        a, b = max(0, low), min(len(g), low + BAND + len(own))
        lo, hi = np.searchsorted(ranked, g[a:b], "left"), np.searchsorted(ranked, g[a:b], "right")
        n = hi - lo
        d = np.repeat(np.arange(a, b), n)
        p = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        inside = (d - p >= low) & (d - p < low + BAND)
        return d[inside], p[inside]

    def _band_regions(self, doc: bytes, item: int, d: np.ndarray, p: np.ndarray) -> list[tuple]:
        """Regions of one item in a band, by its shared q-grams in the document's order."""
        need, out = self.need[item], []
        if len(d) < need:
            return out
        # a gap in the document longer than what the edits can explain starts another region
        cuts = np.flatnonzero(np.diff(d) > Q + self.edits + BAND) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(d)]):
            if b - a >= need and 1 + np.count_nonzero(np.diff(d[a:b])) >= need:
                out += [(self.ids[item], *r) for r in aligned(doc, self.texts[item], d[a:b], p[a:b], self.run, self.edits, need + Q - 1 + self.edits * Q)]
        return out


def stretches(d: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int]]:
    """(document place, item place, letters) of the stretches of equal letters that the shared q-grams make up, by document place."""
    diagonal = d - p
    order = np.lexsort((d, diagonal))
    d, p, diagonal = d[order], p[order], diagonal[order]
    cuts = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(d) != 1)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(d)]))
    return sorted((int(d[a]), int(p[a]), int(b - a) + Q - 1) for a, b in zip(starts, ends))


def chain(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The stretches, cut where they overlap, that follow each other in both texts and hold most letters; each diagonal's last one may go before."""
    best: list[tuple[int, int, int]] = []  # letters so far, stretch before, letters cut off
    last: dict[int, int] = {}
    for k, (d, p, n) in enumerate(found):
        choice = (n, -1, 0)
        for j in last.values():
            dj, pj, nj = found[j]
            cut = max(0, dj + nj - d, pj + nj - p)
            if cut < n and best[j][0] + n - cut > choice[0]:
                choice = (best[j][0] + n - cut, j, cut)
        best.append(choice)
        last[d - p] = k
    out, k = [], max(range(len(found)), key=lambda i: best[i][0])
    while k >= 0:
        d, p, n = found[k]
        cut = best[k][2]
        out.append((d + cut, p + cut, n - cut))
        k = best[k][1]
    return out[::-1]


def aligned(doc: bytes, item: bytes, d: np.ndarray, p: np.ndarray, run: int, edits: int, shortest: int = 0) -> list[tuple]:
    """(doc_start, doc_end, item_start, item_end, edits, run_words) of the alignments of a region that hold a passage of ``run`` words, of ``shortest`` letters at least.

    edits is the cost of the cheapest such passage, run_words the most whole words in a row without
    an edit.  The chain is cut where what lies between two stretches takes more than ``edits`` edits.
    """
    found = stretches(d, p)
    exact = max(found, key=lambda x: x[2])
    pieces: list[list[tuple]] = []
    for x in chain(found):
        if pieces:
            dj, pj, nj = pieces[-1][-1][:3]
            cost = banded_distance(doc[dj + nj : x[0]], item[pj + nj : x[1]], edits)
        if not pieces or cost > edits:
            pieces.append([(*x, 0)])
        else:
            pieces[-1].append((*x, cost))
    if not any(exact[0] >= x[0] and exact[0] + exact[2] <= x[0] + x[2] and exact[0] - exact[1] == x[0] - x[1] for piece in pieces for x in piece):
        pieces.append([(*exact, 0)])  # a chain may cut the longest stretch; alone it is an alignment too
    out = []
    for piece in pieces:
        (a, x, _, _), (dz, pz, nz, _) = piece[0], piece[-1]
        if pz + nz - x + 2 * edits * (Q + 1) < shortest:
            continue
        words = max(whole_words(doc, item, *s[:3]) for s in piece)
        cost = 0 if words >= run else cheapest_passage(doc, item, piece, run, edits)
        if cost <= edits:
            out.append((a, dz + nz, x, pz + nz, cost, words))
    return out


def whole_words(doc: bytes, item: bytes, d: int, p: int, n: int) -> int:
    """Whole words of both texts in a stretch of equal letters."""
    words = doc[d : d + n].split(b" ")
    count = len(words)
    if words[0] and not ((d == 0 or doc[d - 1 : d] == b" ") and (p == 0 or item[p - 1 : p] == b" ")):
        count -= 1
    if count > 0 and words[-1] and not ((d + n == len(doc) or doc[d + n : d + n + 1] == b" ") and (p + n == len(item) or item[p + n : p + n + 1] == b" ")):
        count -= 1
    return count - (not words[0]) - (len(words) > 1 and not words[-1])


def cheapest_passage(doc: bytes, item: bytes, piece: list[tuple], run: int, edits: int) -> int:
    """Least edits of a passage of ``run`` words of the item on an alignment, edits + 1 if none is within the budget.

    A passage may begin before or end after the alignment by what the edits can hide.
    """
    (a, x, _, _), (dz, pz, nz, _) = piece[0], piece[-1]
    b, y, slack = dz + nz, pz + nz, edits * (Q + 1)
    lead = max(0, item.rfind(b" ", 0, max(0, x - slack)) + 1)
    starts = [lead] + [i + 1 for i in range(lead, min(len(item), y)) if item[i] == 32]
    ends = [s - 1 for s in starts[1:]]
    while len(ends) < len(starts) or ends[-1] < min(len(item), y + slack):
        more = item.find(b" ", ends[-1] + 1 if ends else lead)
        ends.append(more if more >= 0 else len(item))
        if more < 0:
            break
    best = edits + 1
    for k, u in enumerate(starts):
        if k + run > len(ends):
            break
        v = ends[k + run - 1]
        if u < x - slack or v > y + slack:
            continue
        cost = sum(c for _, p, _, c in piece if u < p and c) - sum(c for _, p, _, c in piece if p >= v and c)
        if cost < best and u < x:
            cost += min(banded_distance(doc[max(0, a - (x - u) - k) : a][::-1], item[u:x][::-1], edits) for k in range(-edits, edits + 1))
        if cost < best and v > y:
            cost += min(banded_distance(doc[b : b + (v - y) + k], item[y:v], edits) for k in range(-edits, edits + 1))
        best = min(best, cost)
    return best


def _same(x: bytes, y: bytes) -> int:
    """Letters that two texts begin with alike."""
    n = min(len(x), len(y))
    off = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
    return n if off == 0 else ((off & -off).bit_length() - 1) >> 3


def banded_distance(x: bytes, y: bytes, edits: int) -> int:
    """Edit distance of two texts inside the band of ``edits`` diagonals on either side, or edits + 1 where it is larger.

    Row e holds how far each diagonal of the band gets with e edits.
    """
    if x == y:
        return 0
    if abs(len(x) - len(y)) > edits:
        return edits + 1
    goal, far = len(y) - len(x), {0: _same(x, y)}  # diagonal: letters of x used
    for e in range(1, edits + 1):
        new = {}
        for diagonal in range(-e, e + 1):
            i = max(far.get(diagonal, -2) + 1, far.get(diagonal - 1, -2), far.get(diagonal + 1, -2) + 1)
            i = min(i, len(x), len(y) - diagonal)
            if i >= 0 and i + diagonal >= 0:
                new[diagonal] = i + _same(x[i:], y[i + diagonal :])
        far = new
        if far.get(goal, -1) >= len(x):
            return e
    return edits + 1


def leaked_regions(documents: DataFrame, items: DataFrame, run: int = RUN, edits: int = EDITS) -> DataFrame:
    """Regions of documents that hold a passage of an item, one row each.

    The items are the stated query set: their index goes to the executors in blocks of at most
    ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, ``BLOCKS`` of them for one pass over the
    texts.  No shuffle but the last one, of the rows found.
    """
    held = items.where("item_id is not null and text is not null").select("item_id", "text").dropDuplicates(["item_id", "text"])
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    parts, shared, block, size = [], [], [], 0
    context = docs.sparkSession.sparkContext

    def close() -> None:
        nonlocal block, size
        shared.append(context.broadcast(Index(block, run, edits)))  # bounded by BLOCK_ITEMS and BLOCK_CHARS
        block, size = [], 0
        if len(shared) == BLOCKS:
            parts.append(_search(docs, shared[:]))
            shared.clear()

    for r in held.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(r.text) > BLOCK_CHARS):
            close()
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block or not parts and not shared:
        close()
    if shared:
        parts.append(_search(docs, shared[:]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _search(docs: DataFrame, shared: list) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc = normal(text.as_py())
                g = grams(doc)
                for index in shared:
                    rows += [(i, *r) for r in index.value.regions(doc, g)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)

    return docs.mapInArrow(search, REGIONS)


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id) of documents and items that share at least ``run`` words in a row: the aligned regions whose alignment has that many without an edit."""
    return leaked_regions(documents, items, run).where(F.col("run_words") >= run).select("doc_id", "item_id").distinct()
