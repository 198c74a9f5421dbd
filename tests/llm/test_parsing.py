"""Grammars against known valid and invalid texts, and files against a brute-force reading."""

import ast
import json
import random

import pytest
from lodeweave.llm import codefiles
from lodeweave.llm.lexing import language, parser

VALID = {
    "c": [
        "",
        "int x;",
        "static __maybe_unused int f(struct d *v, u32 m) /* it's */\n{\n\tu32 t = 0;\n\tint i, r = 0;\n\tfor (i = 0; i < 3; i++) {\n\t\tif (R(i) & 1)\n\t\t\tbreak;\n\t}\n\tswitch (t & 3) {\n\tcase 0:\n\t\tW(a, 1);\n\t\tbreak;\n\tdefault:\n\t\tr = -1;\n\t}\n\treturn r;\n}\n",
        "#if 0\nint f( {\n#endif\nint y;",
        "#ifdef CONFIG_A\nint f(int a) {\n#else\nint f(void) {\n#endif\nreturn 0;\n}",
        "static const u32 t[] = { 1, 0x2UL, [3] = 4, };\nenum e { A = 1, B };\nstruct s { u32 a : 3; int (*f)(struct s *); };\nMODULE_LICENSE(\"x\");",
        "int f(void) { list_for_each_entry(a, b, c) { x(a); } do { y++; } while (y < 3); goto out; out: return (u8)x ? -1 : sizeof(int *); }",
        "#define X(a) \\\n  do { a; } while (0)\nint z;",
        "typedef unsigned long ulong_t;\nextern int a, *b, c[3];\nint (*g(int))(void);",
    ],
    "c++": [
        "namespace a { class B : public C { public: int f(u32 i) const { return i; } private: std::vector<std::map<int, int>> m_; }; }",
        "template <typename T> T max(T a, T b) { auto g = [&](int x) { return x; }; return a > b ? a : b; }\nint A::f() { for (auto &x : v) { delete x; } try { throw 1; } catch (...) { } return static_cast<int>(2); }",
        "class A { public: A() : b_(1) {} virtual ~A() = default; int operator+(const A &o) override; };",
    ],
    "python": ["", "def f(a, *b, c=1, **d) -> int:\n    'doc'\n    return {k: v for k, v in a if k}\n", "class A(B, metaclass=M):\n\n    @p\n    async def g(self):\n        async with a as b, c:\n            await x\n        x: int = 3\n        print(f'{x!r}', *a, sep='')\n        lambda: (yield)\n", "match = 1\nmatch x:\n    case [1, *r] if r:\n        pass\n    case {'a': B(c=1)} | None:\n        pass\n", "x = (1 +\n  2)\nif (n := f()) > 1: pass\nelse:\n\ty = '''a\nb'''\n"],
    "json": ['{"a": [1, -2.5e3, "\\u00e9", null, true], "b": {}}', " [ ] ", '"x"', "0"],
}
INVALID = {
    "c": ["int f(void) {", "int f(void) { a = ; }", "int f(void) { a = 1 b = 2; }", "<<<<<<< HEAD\nint x;", "int f(void) { return 0; }}", "#if 1\nint x;", "#endif\n", "/* open", "int x\nint y;", "int f(int a int b) { }", 'char *s = "open;\n', "class A { public: int b; };", "# Title\nint x;", "x = 'ab\n';", "int f(void) { if (a { } }", "int f(void) { else { } }", "import os\n"],
    "c++": ["class A { int x }", "namespace a {", "template <typename T T f();", "int f() { =======\n }", "class A : { };"],
    "python": ["def f(:\n    pass\n", "if x\n    y\n", "x = (1\n", "def f():\nreturn 1\n", "  x = 1\n y = 2\n", "print 'x'\n", "<<<<<<< a\nx = 1\n", "x = 'a\n", "for x in y:\n", "/*\n*/\n", "a = = 1\n", "class A\n    pass\n", "x = '''a\n"],
    "json": ["", "{", '{"a": 1,}', "[1,]", "{'a': 1}", "// x\n{}", "NaN", "01", '{"a" 1}', '"a\nb"', "[1] 2", '{"a": 1}}', "-", "1.", '"\\x"'],
}


def check(lang, text, size=2):
    p = parser(lang)
    lines = text.split("\n")
    for i in range(0, len(lines), size):
        p.feed(lines[i : i + size])
    return p.finish()


@pytest.mark.parametrize("size", [1, 2, 80])
@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid(lang, size):
    for text in VALID[lang]:
        assert check(lang, text, size) is None, (text, check(lang, text, size))


@pytest.mark.parametrize("size", [1, 2, 80])
@pytest.mark.parametrize("lang", sorted(INVALID))
def test_invalid(lang, size):
    for text in INVALID[lang]:
        assert check(lang, text, size) is not None, text


def test_python_grammar_agrees_with_the_interpreter():
    """Random deletions: the grammar never accepts less than the interpreter's parser, and more only for repeated stars of parameters.

    What stands inside the braces of f-strings is not looked at, so the source has none.
    """
    rng = random.Random(5)
    source = VALID["python"][1] + VALID["python"][2].replace("f'{x!r}'", "'x'")
    more = less = 0
    for _ in range(300):
        cut = rng.randrange(len(source))
        text = source[:cut] + source[cut + rng.randrange(1, 4) :]
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        found = check("python", text) is None
        more += found and not ok
        less += ok and not found
    assert less == 0 and more <= 3, (less, more)


def test_json_grammar_agrees_with_the_library():
    rng = random.Random(6)
    source = VALID["json"][0]
    for _ in range(500):
        cut = rng.randrange(len(source))
        text = source[:cut] + rng.choice(["", ",", "}", "]", '"', "1", " "]) + source[cut + rng.randrange(0, 3) :]
        try:
            json.loads(text, parse_constant=lambda c: 1 / 0)
            ok = True
        except (ValueError, ZeroDivisionError):
            ok = False
        assert (check("json", text) is None) == ok, text


def test_missing_semicolons_and_brackets_are_found():
    """One `;`, `)` or `}` taken from a statement: nearly all are errors."""
    source = VALID["c"][2]
    places = [i for i, ch in enumerate(source) if ch in ";){}" and "it's" not in source[i - 6 : i + 6]]
    missed = [source[i - 12 : i + 8] for i in places if check("c", source[:i] + source[i + 1 :]) is None]
    assert len(missed) <= 1, missed


def test_files(spark):
    chunk = "id bigint, document_id bigint, text string, line_start int, page int, extra string"
    rows = [(2, 1, "81: }", 81, None, "x"), (1, 1, "1: int f(void) {\r\n2: \treturn 0;\r", 1, None, "x"), (1, 1, "1: int f(void) {\r\n2: \treturn 0;\r", 1, None, "x")]
    rows += [(3, 2, "1: {", 1, None, None), (4, 3, "1: x =", None, None, None), (5, None, "1: (", 1, None, None), (6, 9, "1: (", 1, None, None), (7, 2, None, 2, None, None), (8, 5, "1: a", 1, None, None)]
    docs = spark.createDataFrame([(1, "a/B.C", "r.git"), (1, "a/B.C", "r.git"), (2, "b.json", None), (3, "c.PY", " "), (4, "d.c", "q"), (5, "e.txt", "q"), (None, "f.c", "q")], "id bigint, path string, repo string")
    chunks = spark.createDataFrame(rows, chunk)
    files = codefiles.parse_files(chunks, docs)
    assert {(r.document_id, r.language, r.valid) for r in files.collect()} == {(1, "c", True), (2, "json", False), (3, "python", False)}
    rates = {(r.repo, r.language): (r.files, r.invalid, r.rate) for r in codefiles.parse_rates(files, docs).collect()}
    assert rates == {("r", "c"): (1, 0, 0.0), ("unknown", "json"): (1, 1, 1.0), ("unknown", "python"): (1, 1, 1.0)}
    assert codefiles.parse_files(chunks.limit(0), docs).count() == 0


def test_languages():
    assert [language(p) for p in ("a.C", "x/y.hpp", "b.txt", None, "noext", "a.Json")] == ["c", "c++", None, None, None, "json"]
