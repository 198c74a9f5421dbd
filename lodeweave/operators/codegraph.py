"""Deterministic code graph: facts of each source file by a scanner on executors, edges by joins.

One pass over the chunks, sorted by file, gives facts: functions, calls, register accesses, callback
slots of table initialisers and calls through slots.  Calls resolve to a function of their own file or
to the only function of that name; calls through a slot resolve to the callbacks of the slot, those of
the receiver's table type first.

Null ids, documents and texts are left out, repeated chunks count once, files without functions give
no facts, extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vocab as V
from .resolver import ACCESS_RELATION, DEFAULT, PYTHON, closing, resolve

FACTS = "document_id bigint, path string, fact string, function string, name string, detail string, kind string, line int, line_end int"
_SCHEMA = pa.schema([("document_id", pa.int64()), ("path", pa.string()), ("fact", pa.string()), ("function", pa.string()), ("name", pa.string()), ("detail", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("line_end", pa.int32())])
_STORED = re.compile(r"(?m)^\d+: ?")
_TEXT = re.compile(r"//[^\n]*|/\*(?:[^*]*\*+(?:[^/*][^*]*\*+)*/|.*\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+'", re.S)
_HEADER = re.compile(r"(?m)^[ \t]*(?:[A-Za-z_][\w:]*[ \t*&]+)*\n?[ \t]*([A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)[ \t]*\(([^;{}]*)\)[^;{}=()]*\{")
_CONTROL = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case"}
_TABLE = re.compile(r"\b(?:struct\s+)?(\w+)\s+(\w+)\s*(?:\[\s*\w*\s*\])?\s*=\s*\{")
_SLOT = re.compile(r"\.\s*([A-Za-z_]\w*)\s*=\s*&?\s*([A-Za-z_]\w*)\s*(?=[,}\n])")
_SLOT_CALL = re.compile(r"\b([A-Za-z_]\w*(?:(?:->|\.)[A-Za-z_]\w*)*)(?:->|\.)([A-Za-z_]\w*)\s*\(")


def _branch(kind: str, rest: str, defined: frozenset) -> bool:
    """Whether a conditional branch is read: conditions that nothing is known of are, CONFIG_ names count as defined only if named."""
    rest = rest.strip()
    if kind in ("ifdef", "ifndef", "elifdef", "elifndef"):
        word = re.match(r"\w+", rest)
        name = word[0] if word else ""
        known = name in defined or not name.startswith("CONFIG_") and kind in ("ifdef", "elifdef")
        return known == (kind in ("ifdef", "elifdef"))
    while rest.startswith("(") and closing(rest, 0) == len(rest) - 1:
        rest = rest[1:-1].strip()
    m = re.fullmatch(r"(!?)\s*(?:(?:defined|IS_ENABLED|IS_BUILTIN|IS_REACHABLE|IS_MODULE)\b\s*\(?\s*)?(CONFIG_\w+)\s*\)?", rest)
    if m:
        return (m[2] in defined) != bool(m[1])
    return not re.fullmatch(r"0[uUlL]*|0x0+[uUlL]*|false", rest)


def masked(text: str, defined: frozenset = frozenset()) -> str:
    """Comments, literals, directives and the branches that are not read blanked, offsets and lines kept.

    Of the branches of one condition only the first that holds is read, whatever follows it.
    """
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    out: list[str] = []
    stack: list[list[bool]] = []  # read now, some branch was read
    directive, goes_on = "", False
    for line in _TEXT.sub(blank, text).split("\n"):
        if not goes_on and not re.match(r"\s*#", line):
            out.append(line if all(x[0] for x in stack) else " " * len(line))
            continue
        out.append(" " * len(line))
        directive = directive + " " + line.rstrip("\\") if goes_on else line.rstrip("\\")
        goes_on = line.rstrip().endswith("\\")
        m = re.match(r"\s*#\s*(\w+)\s*(.*)", directive)
        if goes_on or not m:
            continue
        if m[1] in ("if", "ifdef", "ifndef"):
            on = _branch(m[1], m[2], defined)
            stack.append([on, on])
        elif m[1] in ("else", "elif", "elifdef", "elifndef") and stack:
            on = not stack[-1][1] and (m[1] == "else" or _branch("if" if m[1] == "elif" else m[1], m[2], defined))
            stack[-1] = [on, stack[-1][1] or on]
        elif m[1] == "endif" and stack:
            stack.pop()
    return "\n".join(out)


def scan_c(text: str) -> Iterator[tuple]:
    """(fact, function, name, detail, kind, line, line_end) of one C or C++ text."""
    bare = masked(text)
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    at = 0
    while m := _HEADER.search(bare, at):
        name = m[1].split("::")[-1]
        end = closing(bare, m.end() - 1)
        if name in _CONTROL or re.fullmatch("[A-Z][A-Z0-9_]+", name) or end < 0:
            at = m.end()
            continue
        body = bare[m.end() : end]
        yield "function", name, name, m[1], None, line(m.start(1)), line(end)
        seen = set()
        for c in re.finditer(r"(?<![\w.>])([A-Za-z_]\w*)\s*\(", body):
            if c[1] not in seen and c[1] != name and c[1] not in _CONTROL and not re.fullmatch("[A-Z][A-Z0-9_]+", c[1]):
                seen.add(c[1])
                yield "call", name, c[1], None, None, line(m.end() + c.start()), None
        for wrapper, symbol, access, fld, off in resolve(body, DEFAULT):
            yield "access", name, symbol, fld, access, line(m.end() + off), None
        for c in _SLOT_CALL.finditer(body):
            yield "slot_call", name, c[2], c[1], None, line(m.end() + c.start()), None
        at = end
    for m in _TABLE.finditer(bare):
        end = closing(bare, m.end() - 1)
        for s in _SLOT.finditer(bare[m.end() : end if end > 0 else m.end()] + "\n"):
            yield "slot", s[2], s[1], m[2], m[1], line(m.end() + s.start()), None


def scan_python(text: str) -> Iterator[tuple]:
    for wrapper, symbol, access, fld, off in resolve(text, PYTHON):
        yield "access", "", symbol, fld, access, text.count("\n", 0, off) + 1, None


def file_facts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts of all C, C++ and Python files but register headers. One shuffle, on the document."""
    paths = documents.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("document_id")).agg(F.max("path").alias("path"))
    paths = paths.where(V.language(F.col("path")).isin("c", "cpp", "python") & (V.source_type(F.col("path")) == "code"))
    heads = paths.select("document_id", F.lit(0).alias("kind"), F.lit(0).alias("line_start"), F.lit(0).cast("bigint").alias("id"), F.col("path").alias("text"))
    pieces = chunks.where("id is not null and document_id is not null and text is not null").select("document_id", F.lit(1).alias("kind"), F.coalesce("line_start", F.lit(0)).alias("line_start"), "id", "text")
    stream = heads.unionByName(pieces).repartition("document_id").sortWithinPartitions("document_id", "kind", "line_start", "id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, path, parts, last = None, None, [], None

        def done() -> Iterator[tuple]:
            if path and parts:
                text = "\n".join(parts).replace("\r", "")
                for f in (scan_python if path.lower().endswith(".py") else scan_c)(text):
                    yield (current, path, *f)

        for batch in batches:
            ids, kinds, chunk_ids = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for k, (doc, kind, chunk) in enumerate(zip(ids, kinds, chunk_ids)):
                if doc != current:
                    yield from done()
                    current, path, parts, last = doc, None, [], None
                if kind == 0:
                    path = batch.column(4)[k].as_py()
                elif path and chunk != last:
                    last = chunk
                    parts.append(_STORED.sub("", batch.column(4)[k].as_py()))
        yield from done()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for r in rows(batches):
            held.append(r)
            if len(held) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)

    return stream.mapInArrow(run, FACTS)


def call_edges(facts: DataFrame) -> DataFrame:
    """(src_document, src, dst_document, dst, line, confidence): calls to a function of the same file, else to the only one of that name."""
    functions = facts.where("fact = 'function'").select("document_id", "name").distinct()
    alone = functions.groupBy("name").agg(F.count("*").alias("_n"), F.min("document_id").alias("only")).where("_n = 1").select("name", "only")
    calls = facts.where("fact = 'call'").select("document_id", "function", "name", "line")
    local = functions.select(F.col("document_id"), "name", F.lit(True).alias("_local"))
    both = calls.join(local, ["document_id", "name"], "left").join(alone, "name", "left")
    target = F.when(F.col("_local"), F.col("document_id")).otherwise(F.col("only"))
    found = both.withColumn("dst_document", target).where("dst_document is not null")
    return found.groupBy(F.col("document_id").alias("src_document"), F.col("function").alias("src"), "dst_document", F.col("name").alias("dst")).agg(F.min("line").alias("line"), F.max(F.when(F.col("_local"), 0.84).otherwise(0.82)).alias("confidence"))


def access_edges(facts: DataFrame) -> DataFrame:
    """(document_id, src, dst, relation, field, line): register accesses of functions, first line of each."""
    relation = F.coalesce(F.create_map(*[F.lit(x) for kv in ACCESS_RELATION.items() for x in kv])[F.col("kind")], F.lit("relates_to"))
    a = facts.where("fact = 'access' and function <> ''").select("document_id", F.col("function").alias("src"), V.canonical_register(F.col("name")).alias("dst"), relation.alias("relation"), F.col("detail").alias("field"), "line")
    return a.groupBy("document_id", "src", "dst", "relation", "field").agg(F.min("line").alias("line"))


def dispatch_edges(facts: DataFrame) -> DataFrame:
    """(document_id, src, slot, receiver, dst_document, dst, scope, candidates): calls through slots and the callbacks they may reach.

    The tier is chosen per call: callbacks of tables whose type or name the receiver's last part
    tells (matched_slot), else all callbacks of the slot (generic_slot); ambiguous if several are left.
    """
    slots = facts.where("fact = 'slot'").select(F.col("document_id").alias("dst_document"), F.col("function").alias("dst"), F.col("name").alias("slot"), F.col("detail").alias("table"), F.col("kind").alias("type")).distinct()
    known = facts.where("fact = 'function'").select(F.col("name").alias("dst")).distinct()
    slots = slots.join(known, "dst", "left_semi")
    calls = facts.where("fact = 'slot_call'").select("document_id", F.col("function").alias("src"), F.col("name").alias("slot"), F.col("detail").alias("receiver")).distinct()
    leaf = F.regexp_extract("receiver", r"(\w+)$", 1)
    pair = calls.join(slots, "slot").withColumn("_tier", F.when(F.col("type").contains(leaf) | F.col("table").contains(leaf), 0).otherwise(1))
    call = W.partitionBy("document_id", "src", "slot", "receiver")
    best = pair.withColumn("_m", F.min("_tier").over(call)).where("_tier = _m").withColumn("candidates", F.count("*").over(call))
    scope = F.when(F.col("candidates") > 1, "ambiguous").when(F.col("_tier") == 0, "matched_slot").otherwise("generic_slot")
    return best.select("document_id", "src", "slot", "receiver", "dst_document", "dst", scope.alias("scope"), "candidates")
