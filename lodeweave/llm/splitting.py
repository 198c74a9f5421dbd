"""Oversized chunks cut into overlapping pieces at natural boundaries, by agglomerative merging.

A text is first cut into atomic segments (lines; sentences, words or plain pieces of a line that
is too long).  Adjacent segments are held in a heap and merged across the weakest boundary first
while their size plus the overlap fits, so that the boundaries left over are the strongest ones.

Null ids or texts are left out, repeated rows count once, texts within the limit come out as they
are only where ``keep_small`` is set; null line numbers and pages stay null; extra columns are
ignored; an empty table gives an empty result.  Sizes are in Unicode characters.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 200
PIECES = (
    "id bigint, document_id bigint, piece int, pieces int, text string, char_start bigint, char_end bigint, overlap int, line_start int, line_end int, page int"
)
_SCHEMA = pa.schema(
    [("id", pa.int64()), ("document_id", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("overlap", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("page", pa.int32())]
)
_STORED = re.compile(r"^\d+: ?")


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments, and the strength of the boundary at each end (0 weakest)."""
    ends: list[int] = []
    strength: list[int] = []
    at = 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        stop = at + len(line) + (k + 1 < len(lines))
        if stop == at:
            continue
        if stop - at > most:
            for m in re.finditer(r"[.!?;:](?:\s+|$)|\s+", line):
                end = at + m.end()
                last = ends[-1] if ends else 0
                while end - max(last, at) > most:
                    last = max(last, at) + most
                    ends.append(last)
                    strength.append(0)
                if end < stop and end > (ends[-1] if ends else 0):
                    ends.append(end)
                    strength.append(3 if m[0][0] in ".!?" else 2 if m[0][0] in ";:" else 1)
            last = max(ends[-1] if ends else 0, at)
            while stop - last > most:
                last += most
                ends.append(last)
                strength.append(0)
        body = _STORED.sub("", line).rstrip("\r")
        following = _STORED.sub("", lines[k + 1]) if k + 1 < len(lines) else ""
        if not body.strip():
            power = 7
        elif re.match(r"[})\]]+;?\s*$", body) and not body[:1].isspace():
            power = 7 if not following.strip() else 6
        elif not following.strip():
            power = 5
        elif re.search(r"[.!?;}]\s*$", body):
            power = 5 if not following[:1].isspace() else 4
        else:
            power = 4 if body[:1].strip() and following[:1].strip() else 3
        ends.append(stop)
        strength.append(power)
        at = stop
    return ends, strength


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces without their overlaps; each is at most limit - overlap characters long."""
    most = limit - overlap
    if most <= 0:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    ends, strength = atoms(text, most)
    n = len(ends)
    starts = [0, *ends[:-1]]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    size = [e - s for s, e in zip(starts, ends)]
    alive = [True] * n
    heap = [(strength[i], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        power, total, i, j = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j]) or right[i] != j or size[i] + size[j] != total:
            continue
        if total > most:
            continue
        ends[i], size[i], strength[i], alive[j] = ends[j], total, strength[j], False
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            heapq.heappush(heap, (strength[i], size[i] + size[right[i]], i, right[i]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (strength[k], size[k] + size[i], k, i))
    return [(starts[i], ends[i]) for i in range(n) if alive[i]]


def _pieces(row: tuple, limit: int, overlap: int) -> Iterator[tuple]:
    id_, document_id, text, first, last, page = row
    spans = cut(text, limit, overlap)
    lines_before, at = 0, 0
    for k, (start, end) in enumerate(spans):
        begin = max(0, start - overlap) if k else 0
        lines_before += text.count("\n", at, begin) if begin >= at else -text.count("\n", begin, at)
        at = begin
        piece = text[begin:end]
        one = None if first is None else first + lines_before
        inner = piece.count("\n") - piece.endswith("\n")
        yield id_, document_id, k, len(spans), piece, begin, end, start - begin, one, None if one is None else one + max(inner, 0) if last is None else min(max(last, one), one + max(inner, 0)), page


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, keep_small: bool = False) -> DataFrame:
    """Pieces of the chunks longer than ``limit`` (of all chunks with ``keep_small``).  No shuffle but that of the oversized rows, to count repeated ones once."""
    rows = chunks.where("id is not null and text is not null").select("id", "document_id", "text", "line_start", "line_end", "page")
    if not keep_small:
        rows = rows.where(F.length("text") > limit)
    rows = rows.dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out += _pieces(row, limit, overlap)
                if len(out) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SCHEMA.types)], schema=_SCHEMA)

    return rows.mapInArrow(run, PIECES)
