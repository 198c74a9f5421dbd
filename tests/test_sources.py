import re
import zlib

import pytest
from lodeweave.operators import codegraph, resolver, semantic
from lodeweave.sources import files, pdf, sinks
from pyspark.sql import functions as F


def test_globs():
    hit = lambda g, p: bool(re.search(files.glob_pattern(g), p))
    assert hit("**/*.c", "a.c") and hit("**/*.c", "x/y/a.c") and hit("drivers/*.c", "src/drivers/a.c")
    assert not hit("*.c", "a.cc") and not hit("drivers/*.c", "drivers/x/a.c") and hit("[ab].h", "x/a.h") and not hit("[!ab].h", "x/a.h")


def test_unsafe_folders():
    for bad in ("/etc:*.c", "~/x", "a/../b", "a:b:c"):
        with pytest.raises(ValueError):
            files.safe_subfolder(bad)
    assert files.safe_subfolder("drivers/gpu/:*.c,*.h") == ("drivers/gpu", ["*.c", "*.h"])


def test_scan_and_pages(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "ucode").mkdir()
    for name, content in {"a.c": b"int x;", "b.py": b"", ".git/c.c": b"", "ucode/d.h": b"", "notes.MD": b"# T"}.items():
        (tmp_path / name).write_bytes(content)
    body = zlib.compress(b"BT (Hello \\(you\\)) Tj T* [(wor) 3 (ld)] TJ ET")
    (tmp_path / "p.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Length 9 /Filter /FlateDecode >>\nstream\n" + body + b"\nendstream\n")
    (tmp_path / "broken.pdf").write_bytes(b"<< /Filter /FlateDecode >>\nstream\nxx\nendstream")
    df = files.scan(spark, str(tmp_path))
    assert {(r.path, r.source_type) for r in df.collect()} == {("a.c", "code"), ("notes.MD", "doc"), ("p.pdf", "pdf"), ("broken.pdf", "pdf")}
    assert [tuple(r) for r in pdf.pdf_pages(df).collect()] == [("p.pdf", 1, "Hello (you)\nworld")]


def test_upsert_and_delete(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int").write.parquet(path)
    sinks.upsert_table(spark, spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "id int, v string, seq int"), path, "id", F.col("seq"))
    assert {(r.id, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_resolver():
    got = resolver.resolve("tmp = REG_SET_FIELD(RREG32(mmA_CNTL), GC_CNTL, FIELD, 1); WREG32(SOC(x, regB), f(1, 2)); WREG32(lower, 1);")
    assert [(w, s, a, f) for w, s, a, f, _ in got] == [("REG_SET_FIELD", "GC_CNTL", "field_set", "FIELD"), ("RREG32", "mmA_CNTL", "read", ""), ("WREG32", "regB", "write", "")]
    assert resolver.arguments('a, (b, c), "x,y"') == ["a", "(b, c)", '"x,y"'] and resolver.arguments("") == []


CODE = """1: struct ops my_ops = {
2: \t.hw_init = my_init,
3: };
4: static int my_init(struct dev *d)
5: {
6: \t/* call_me(); */
7: \tWREG32(mmX_CNTL, 1);
8: \thelper(d);
9: \treturn 0;
10: }
11: #if 0
12: int gone(void) { return 1; }
13: #endif
14: int start(struct dev *d) {
15: \treturn d->ops->hw_init(d);
16: }"""


def test_code_graph(spark):
    chunks = spark.createDataFrame([(1, 1, CODE, 1), (1, 1, CODE, 1), (2, 2, "1: int helper(struct dev *d) {\n2: \treturn 1;\n3: }", 1), (3, None, "x", 1), (4, 9, "x", None)], "id bigint, document_id bigint, text string, line_start int")
    docs = spark.createDataFrame([(1, "a.c"), (2, "b.c"), (None, "c.c")], "id bigint, path string")
    facts = codegraph.file_facts(chunks, docs).cache()
    assert {(r.name, r.line) for r in facts.where("fact = 'function'").collect()} == {("my_init", 4), ("start", 14), ("helper", 1)}
    assert {(r.src, r.dst, r.confidence) for r in codegraph.call_edges(facts).collect()} == {("my_init", "helper", 0.82)}
    assert {(r.src, r.dst, r.relation) for r in codegraph.access_edges(facts).collect()} == {("my_init", "X_CNTL", "writes")}
    assert {(r.src, r.slot, r.dst, r.scope) for r in codegraph.dispatch_edges(facts).collect()} == {("start", "hw_init", "my_init", "matched_slot")}
    assert codegraph.file_facts(chunks.limit(0), docs.limit(0)).count() == 0


def test_generated_edges(spark):
    g = spark.createDataFrame([("a", "b", "Field-Read", 0.5), ("a", "b", "reads", 0.9), ("a", "a", "calls", 1.0), ("a", "z", "calls", 1.0), (None, "b", "calls", 1.0), ("a", "b", "wraps", 1.0)], "src string, dst string, relation string, confidence double")
    ok = spark.createDataFrame([("a",), ("b",)], "n string")
    assert [tuple(r) for r in semantic.persistable(g, ok).collect()] == [("a", "reads", "b", 0.9)]


def test_backfill_halves_what_the_provider_refuses(spark):
    def embed(batch):
        if any(len(t) > 4 for t in batch):
            raise ValueError("too long")
        return [[float(len(t))] for t in batch]

    chunks = spark.createDataFrame([(1, "abcdefgh"), (2, "ab"), (3, "ab"), (4, None), (5, "x")], "id bigint, text string")
    have = spark.createDataFrame([(5,)], "id bigint")
    assert {r.id: r.vector for r in semantic.backfill(chunks, have, embed).collect()} == {1: [4.0], 2: [2.0], 3: [2.0]}
