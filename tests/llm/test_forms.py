"""Forms of the languages: none of the valid ones may be rejected, none of the invalid ones accepted."""

import ast
import random

import pytest
from lodeweave.llm import lr
from lodeweave.llm.lexing import condition, parser
from syntax_forms import INVALID, VALID


def check(lang, text, size=80):
    p = parser(lang)
    lines = text.split("\n")
    for i in range(0, len(lines), size):
        p.feed(lines[i : i + size])
    return p.finish()


def test_enough_forms():
    assert sum(map(len, VALID.values())) >= 200 and sum(map(len, INVALID.values())) >= 200


@pytest.mark.parametrize("size", [1, 80])
@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_forms(lang, size):
    assert [x for x in VALID[lang] if check(lang, x, size) is not None] == []


@pytest.mark.parametrize("size", [1, 80])
@pytest.mark.parametrize("lang", sorted(INVALID))
def test_invalid_forms(lang, size):
    assert [x for x in INVALID[lang] if check(lang, x, size) is None] == []


def test_the_interpreter_agrees_on_the_python_forms():
    for x in VALID["python"]:
        ast.parse(x)
    for x in INVALID["python"]:
        with pytest.raises(SyntaxError):
            compile(x, "x", "exec")


def test_edited_python_agrees_with_the_interpreter():
    rng = random.Random(11)
    wrong = []
    for _ in range(4000):
        text = "".join(rng.sample(VALID["python"], 3))
        cut = rng.randrange(len(text))
        text = text[:cut] + rng.choice(["", "", "=", "*", ",", "(", ":", "{", "S "]) + text[cut + rng.randrange(3) :]
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if (check("python", text) is None) != ok:
            wrong.append(text)
    assert len(wrong) <= 40, wrong[:3]


@pytest.mark.parametrize("lang", ["c", "python"])
def test_a_full_memo_starts_afresh_inside_a_file(lang, monkeypatch):
    monkeypatch.setattr(lr, "MEMO_LIMIT", 50)
    for x in VALID[lang]:
        assert check(lang, x, 1) is None
    for x in INVALID[lang]:
        assert check(lang, x, 1) is not None


def test_conditions_of_any_length():
    long = " || ".join(f"defined(A{i})" for i in range(400))
    assert not condition(long, False, {}) and condition(long, False, {"A399": ""})
    for text, value in (("1 << 4 > 15", True), ("(2 > 1) - 1", False), ("3 % 2 == 1 && !0", True), ("1 / 0", True), ("0 ? 1 : 0 ? 1 : 2", True), ("CONFIG_X", False), ("1 +", False), ("__import__('os')", False), ("-1 >> 1 == -1", True), ("010 == 8", True)):
        assert condition(text, False, {}) is value, text
    assert condition("IS_ENABLED(CONFIG_X) && CONFIG_Y", True, {}) and condition("B == 3", False, {"A": "3", "B": "A"}) and not condition("A", False, {"A": "B", "B": "A"})
