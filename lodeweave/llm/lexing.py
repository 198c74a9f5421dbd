"""Line-wise lexers for the recognisers of ``lr.py``.

Each parser takes a file piece by piece (``feed``), so that a file of any length is checked in
the memory of one piece, and reports the first line that no derivation of the grammar accepts.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .lr import recogniser

#: Every alternative starts with a literal, which lets the search skip to it; a quote without its partner comes last.
_C_TEXT = re.compile(
    r"""//(?:\\\n|[^\n])*|/\*(?:[^*]*\*+(?:[^/*][^*]*\*+)*/|.*\Z)|"(?:[^"\\\n]|\\.)*"(?:[A-Za-z_]\w*)?|'(?:[^'\\\n]|\\.)+'|["']""",
    re.S,
)
#: Numbers with digit separators, whose marks are no character constants.
_C_SEPARATED = re.compile(r"(?<![\w'])\.?\d[\w.]*(?:'\w+)+")
#: Other spellings of keywords.
_C_ALIASES = re.compile(r"\b__(asm|volatile|inline|const|restrict|signed|alignof|typeof|thread)(?:__)?\b")
_C_SAME = {"restrict": "restrict", "alignof": "_Alignof", "thread": "_Thread_local"}
_C_RAW = re.compile(r'\b(?:u8|[uUL])?R"([^(\s\\]{0,16})\(.*?\)\1"', re.S)
_C_PREFIX = re.compile(r"""\b(?:u8|[uUL])\b ?(?=["'] )""")
_C_NUMBER = re.compile(r"(?<![\w$])\.?\d(?:[eEpP][+-]|[\w.]|'(?=\w))*")
_C_MACRO = re.compile(r"\b(?:__(?!attribute__\b|int128\b|extension__\b)\w+|[A-Z](?=[A-Z0-9_])[A-Z0-9_]*|(?:PRI|SCN)[diouxX]\w*)\b")
#: Names with a digit, an underscore or an upper-case letter inside: no keyword but the few excepted has one.
_C_PLAIN = re.compile(
    r"\b(?!wchar_t\b|char8_t\b|char16_t\b|char32_t\b|static_cast\b|dynamic_cast\b|const_cast\b|reinterpret_cast\b|static_assert\b|thread_local\b|co_await\b|co_yield\b|co_return\b|typeof_unqual\b)[a-z]+[A-Z_0-9]\w*"
)
_C_SIGN = re.compile(r"\w+|<<=|>>=|\.\.\.|->\*|<=>|\.\*|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|::|##|\S")
_SPLICE = re.compile(r"(?:[^\n]*\\\n)+[^\n]*")
_DIRECTIVE = re.compile(r"\s*#\s*(\w*)\s*(.*)", re.S)
#: Directives that neither open nor close a condition.
_PLAIN = {"include", "include_next", "define", "undef", "pragma", "error", "warning", "line", "ident", "import", "embed", ""}


#: Sign of a quote without its partner; no grammar has it.
STRAY = "\x15"


def _c_text(m: re.Match) -> str:
    s = m[0]
    if s[0] == "/":
        return " " + "\n" * s.count("\n")
    if len(s) == 1:
        return STRAY
    glued = m.start() and (m.string[m.start() - 1].isalnum() or m.string[m.start() - 1] == "_")
    return (" " if glued else "") + s[0] + " " + "\n" * s.count("\n")


@lru_cache(maxsize=None)
def _c_words(cpp: bool) -> re.Pattern:
    tokens = recogniser(*(("c", "cpp") if cpp else ("c",))).table.tokens
    fixed = {t for t in tokens if t.isidentifier()}
    return re.compile(r"\b(?!(?:" + "|".join(sorted(fixed, key=lambda t: (-len(t), t))) + r")\b)[A-Za-z_$][\w$]*")


_CONDITION_SIGN = re.compile(r"\d[\w.']*|[A-Za-z_]\w*|<<|>>|<=|>=|==|!=|&&|\|\||'(?:[^'\\]|\\.)+'|\S")
#: Binary operators of conditions by how tightly they bind.
_BINDING = {s: k for k, signs in enumerate((("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))) for s in signs}
_APPLY = {
    "||": lambda a, b: int(bool(a or b)), "&&": lambda a, b: int(bool(a and b)), "|": int.__or__, "^": int.__xor__, "&": int.__and__, "==": lambda a, b: int(a == b), "!=": lambda a, b: int(a != b),
    "<": lambda a, b: int(a < b), ">": lambda a, b: int(a > b), "<=": lambda a, b: int(a <= b), ">=": lambda a, b: int(a >= b), "<<": lambda a, b: a << (b & 63), ">>": lambda a, b: a >> (b & 63),
    "+": int.__add__, "-": int.__sub__, "*": int.__mul__, "/": lambda a, b: abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1), "%": lambda a, b: abs(a) % abs(b) * (1 if a >= 0 else -1),
}


class _Condition:
    """A preprocessor condition, read by operator precedence; values wrap at 64 bits."""

    def __init__(self, text: str, config: bool, defined: dict[str, str], open_: frozenset = frozenset()) -> None:
        self.signs, self.at, self.config, self.defined, self.open = _CONDITION_SIGN.findall(text), 0, config, defined, open_

    def peek(self) -> str:
        return self.signs[self.at] if self.at < len(self.signs) else ""

    def take(self, want: str = "") -> str:
        sign = self.peek()
        if not sign or want and sign != want:
            raise ValueError(want or "end")
        self.at += 1
        return sign

    def value(self) -> int:
        found = self.choice()
        if self.peek():
            raise ValueError(self.peek())
        return found

    def choice(self) -> int:
        test = self.binary(0)
        if self.peek() != "?":
            return test
        self.take()
        yes = self.choice()
        self.take(":")
        no = self.choice()
        return yes if test else no

    def binary(self, least: int) -> int:
        left = self.unary()
        while _BINDING.get(self.peek(), -1) >= least:
            sign = self.take()
            right = self.binary(_BINDING[sign] + 1)
            if sign in "/%" and right == 0:
                right = 1
            left = (_APPLY[sign](left, right) + (1 << 63)) % (1 << 64) - (1 << 63)
        return left

    def unary(self) -> int:
        sign = self.take()
        if sign in ("!", "~", "-", "+"):
            x = self.unary()
            return int(not x) if sign == "!" else ~x if sign == "~" else -x if sign == "-" else x
        if sign == "(":
            x = self.choice()
            self.take(")")
            return x
        if sign[0].isdigit():
            digits = sign.replace("'", "").rstrip("uUlLzZ")
            return int(digits, 8 if re.fullmatch(r"0\d+", digits) else 0)
        if sign[0] == "'":
            return ord(sign[1]) if len(sign) == 3 else 1
        if not (sign[0].isalpha() or sign[0] == "_"):
            raise ValueError(sign)
        return self.name(sign)

    def name(self, name: str) -> int:
        if name == "defined":
            inner = self.take()
            if inner == "(":
                inner = self.take()
                self.take(")")
            return self.known(inner)
        arguments: list[str] = []
        if self.peek() == "(":
            depth = 0
            while True:
                sign = self.take()
                depth += (sign == "(") - (sign == ")")
                arguments.append(sign)
                if depth == 0:
                    break
        if name in ("IS_ENABLED", "IS_BUILTIN", "IS_REACHABLE", "IS_MODULE"):
            return self.known(arguments[1]) if len(arguments) > 2 else 0
        if name.startswith("CONFIG_"):
            return int(self.config)
        text = self.defined.get(name, "").strip()
        if arguments or not text or name in self.open:
            return 0  # a function-like macro, a name without value, or one that names itself
        try:
            return _Condition(text, self.config, self.defined, self.open | {name}).value()
        except (ValueError, RecursionError):
            return 0

    def known(self, name: str) -> int:
        return int(self.config if name.startswith("CONFIG_") else name in self.defined)


def condition(text: str, config: bool, defined: dict[str, str]) -> bool:
    """Value of a preprocessor condition; a name that is not known counts as 0, and a condition that can't be read as false."""
    try:
        return bool(_Condition(text, config, defined).value())
    except (ValueError, RecursionError):
        return False


class Conditions:
    """The #if stack of one configuration."""

    def __init__(self, config: bool) -> None:
        self.config, self.stack, self.kept, self.defined = config, [], True, {}

    def directive(self, name: str, rest: str) -> str:
        """Follows one directive; returns what is wrong with it, or ''."""
        if name in ("if", "ifdef", "ifndef"):
            if not self.kept:
                self.stack.append([False, True, False])  # kept, some branch taken, else seen
            else:
                word = re.match(r"\w+", rest)
                if name != "if" and not word:
                    return f"#{name} without a name"
                if name == "if" and not rest.strip():
                    return "#if without a condition"
                if name == "if":
                    on = condition(rest, self.config, self.defined)
                else:
                    on = self.config if word[0].startswith("CONFIG_") else word[0] in self.defined
                    on = on == (name == "ifdef")
                self.stack.append([on, on, False])
        elif name in ("elif", "else", "endif", "elifdef", "elifndef"):
            if not self.stack:
                return f"#{name} without #if"
            top = self.stack[-1]
            if name == "endif":
                self.stack.pop()
            elif top[2]:
                return f"#{name} after #else"
            elif name == "else":
                top[0], top[1], top[2] = not top[1], True, True
            else:
                outer = all(x[0] for x in self.stack[:-1])
                on = outer and not top[1] and condition(rest if name == "elif" else f"{'!' * (name == 'elifndef')}defined({rest})", self.config, self.defined)
                top[0], top[1] = on, top[1] or on
        elif self.kept:
            if name == "define":
                if m := re.match(r"(\w+)(?:\([^)]*\))?\s*(.*)", rest):
                    self.defined[m[1]] = m[2]
                else:
                    return "#define without a name"
            elif name == "undef":
                self.defined.pop(rest.strip(), None)
            elif name not in _PLAIN and not name.isdigit():
                return f"unknown directive #{name}"
        self.kept = all(x[0] for x in self.stack)
        return ""


class CParser:
    """C or C++, checked with no CONFIG_ name defined and with all defined."""

    def __init__(self, cpp: bool = False) -> None:
        self.cpp = cpp
        self.r = recogniser(*(("c", "cpp") if cpp else ("c",)))
        self.configs = [self.r.start, self.r.start]
        self.conditions = [Conditions(False), Conditions(True)]
        self.n, self.error, self.in_comment, self.carry = 0, None, False, ""
        self.shapes: dict[str, tuple] = _SHAPES_CPP if cpp else _SHAPES_C

    def _tokens(self, shape: str) -> tuple:
        t = self.shapes.get(shape)
        if t is None:
            signs = _C_SIGN.findall(shape)
            if self.cpp:
                signs = [x for s in signs for x in ((">", ">") if s == ">>" else (s,))]
            t = self.shapes[shape] = tuple(signs)
        return t

    def _fail(self, line: int, why: str) -> None:
        if self.error is None:
            self.error = (line, why)

    def feed(self, lines: list[str]) -> None:
        if self.error or not lines:
            return
        if len(self.shapes) > SHAPES_LIMIT:
            self.shapes.clear()
        self.configs = self.r.tidy(*self.configs)
        text = "\n".join(lines)
        if self.carry:
            text, self.carry = self.carry + text, ""
        base = self.n - text.count("\n") + len(lines) - 1
        if text.endswith("\\"):
            self.carry = text + "\n"
            self.n += len(lines)
            return
        if "\\\n" in text:
            text = _SPLICE.sub(lambda m: m[0].replace("\\\n", " ") + "\n" * m[0].count("\\\n"), text)
        lead = ""
        if self.in_comment:
            at = text.find("*/")
            if at < 0:
                self.n += len(lines)
                return
            lead, text, self.in_comment = "\n" * text.count("\n", 0, at), text[at + 2 :], False
        # an open comment is the last match and has no end
        last = None

        def strip(m: re.Match) -> str:
            nonlocal last
            last = m
            return _c_text(m)

        if 'R"' in text and self.cpp:
            text = _C_RAW.sub(lambda m: '""' + "\n" * m[0].count("\n"), text)
        if "'" in text:
            text = _C_SEPARATED.sub("0", text)
        clean = _C_TEXT.sub(strip, text)
        if last is not None and last[0].startswith("/*") and (len(last[0]) < 4 or not last[0].endswith("*/")):
            self.in_comment = True
        clean = lead + clean
        if "#" not in clean:
            shape = self._shape(clean)
            for i, line in enumerate(shape.split("\n")):
                if line and not line.isspace():
                    self._line(line, base + i + 1)
                    if self.error:
                        return
        else:
            raw = clean.split("\n")
            code = ["" if line.lstrip().startswith("#") else line for line in raw]
            shapes = self._shape("\n".join(code)).split("\n") if any(code) else code
            for i, line in enumerate(raw):
                if not code[i] and line:
                    m = _DIRECTIVE.match(line)
                    for c in self.conditions:
                        if why := c.directive(m[1], m[2]):
                            self._fail(base + i + 1, why)
                elif line and not line.isspace():
                    self._line(shapes[i].rstrip(), base + i + 1)
                if self.error:
                    return
        self.n += len(lines)

    def _shape(self, clean: str) -> str:
        if "__" in clean:
            clean = _C_ALIASES.sub(lambda m: _C_SAME.get(m[1], m[1]), clean)
        clean = _C_PREFIX.sub("", _C_NUMBER.sub("0", clean))
        if "or" in clean and "each" in clean:
            clean = re.sub(r"\b\w*for_?each\w*\b", "F", clean)
        clean = _C_PLAIN.sub("I", _C_MACRO.sub("M", clean))
        return _c_words(self.cpp).sub("I", clean)

    def _line(self, shape: str, number: int) -> None:
        shape = shape.strip()
        a, b = self.conditions
        if a.kept:
            after, bad = self.r.line(self.configs[0], self._tokens(shape))
            if bad >= 0:
                return self._fail(number, f"unexpected {self._tokens(shape)[bad]}")
            if b.kept and self.configs[0] == self.configs[1]:
                self.configs = [after, after]
                return None
            self.configs[0] = after
        if b.kept:
            after, bad = self.r.line(self.configs[1], self._tokens(shape))
            if bad >= 0:
                return self._fail(number, f"unexpected {self._tokens(shape)[bad]}")
            self.configs[1] = after
        return None

    def finish(self) -> tuple[int, str] | None:
        if self.carry and not self.error:
            last, self.carry = self.carry.rstrip("\n").rstrip("\\"), ""
            self.n -= last.count("\n") + 1
            self.feed(last.split("\n"))
        if self.error is None:
            if self.in_comment:
                self._fail(self.n, "comment without end")
            elif self.conditions[0].stack or self.conditions[1].stack:
                self._fail(self.n, "#if without #endif")
            elif not all(self.r.accepts_end(c) for c in self.configs):
                self._fail(self.n, "unexpected end of file")
        return self.error


_SHAPES_C: dict[str, tuple] = {}
_SHAPES_CPP: dict[str, tuple] = {}
_SHAPES_PY: dict[str, tuple] = {}
SHAPES_LIMIT = 200_000

_JSON_SIGN = re.compile(
    r'(?P<s>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<n>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![\w.])|\w+|[^ \t\r\n]'
)


class JsonParser:
    """Strict JSON."""

    def __init__(self) -> None:
        self.r = recogniser("json")
        self.config, self.n, self.error = self.r.start, 0, None

    def feed(self, lines: list[str]) -> None:
        (self.config,) = self.r.tidy(self.config)
        for line in lines:
            self.n += 1
            if self.error:
                return
            signs = tuple('"' if m.lastgroup == "s" else "0" if m.lastgroup == "n" else m[0] if m[0] not in ('"', "0") else STRAY for m in _JSON_SIGN.finditer(line))
            if signs:
                after, bad = self.r.line(self.config, signs)
                if bad >= 0:
                    self.error = (self.n, f"unexpected {signs[bad]}"[:60])
                    return
                self.config = after

    def finish(self) -> tuple[int, str] | None:
        if self.error is None and not self.r.accepts_end(self.config):
            self.error = (self.n, "unexpected end of file")
        return self.error


_PY_TEXT = re.compile(
    r"""#[^\n]*|(?:\b(?P<prefix>[rR][bBfF]?|[bBfF][rR]?|[uU]))?(?:(?P<q>\"{3}|'{3})(?:(?:\\.|[^\\])*?(?P=q)|(?P<open>.*\Z))|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|\\\n|["']""",
    re.S,
)
_PY_FORMATTED = re.compile(r"""\b(?:[fF][rR]?|[rR][fF])(?=["'])""")
_PY_NUMBER = re.compile(
    r"(?<![\w])(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*)(?:(?!\w)|(?=(?:and|else|for|if|in|is|not|or)\b))"
)
_PY_WORDS = re.compile(
    r"\b(?!(?:False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield)\b)[^\W\d]\w*"
)
_PY_BAD_ESCAPE = (re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{\w))"), re.compile(r"\\x(?![0-9a-fA-F]{2})"))
_PY_SIGN = re.compile(r"\w+|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|\S")
_PY_NAMES = {"and": "AND", "or": "OR", "not": "NOT"}
_PY_SOFT = re.compile(r"^(match|case)\b(?=\s*(?:[^\s=.,):\]]|\.\.\.).*:\s*$)|^(type)\b(?=\s+\w+\s*[=\[])")


def _py_text(m: re.Match) -> str:
    s = m[0]
    if s[0] == "#":
        return ""
    if s == "\\\n":
        return " \x01"
    if len(s) == 1 or "\\" in s and _bad_escape(s, (m["prefix"] or "").lower()):
        return STRAY + "\x01" * s.count("\n")
    glued = m.start() and (m.string[m.start() - 1].isalnum() or m.string[m.start() - 1] == "_")
    return (" " if glued else "") + ("` " if "b" in (m["prefix"] or "").lower() else '" ') + "\x01" * s.count("\n")


def _bad_escape(literal: str, prefix: str) -> bool:
    if "r" in prefix:
        return False
    bad = _PY_BAD_ESCAPE["b" in prefix]
    return any(bad.match(m[0]) for m in re.finditer(r"\\(?:([xuUN]).{0,8}|.)", literal, re.S) if m[1])


class _OpenField(Exception):
    """A formatted string goes on after the text's end."""


def _formatted(text: str, at: int) -> tuple[int, list[str]]:
    """End of the formatted string whose quote is at ``at``, and its replacement fields; ValueError if it is none."""
    quote = text[at] * 3 if text.startswith(text[at] * 3, at) else text[at]
    raw = "r" in text[max(0, at - 2) : at].lower()
    fields: list[str] = []
    end = _literal(text, at + len(quote), quote, raw, fields, False)
    return end + len(quote), fields


def _literal(text: str, i: int, quote: str, raw: bool, fields: list[str], spec: bool) -> int:
    """Reads literal text up to its quote, or as a format up to its closing brace."""
    while i < len(text):
        ch = text[i]
        if text.startswith(quote, i):
            if spec:
                raise ValueError("field without end")
            return i
        if ch == "\\" and not spec and i + 1 < len(text) and (not raw or text[i + 1] in "\"'\\\n"):
            i += 2
        elif ch == "\n" and len(quote) == 1 and not spec:
            raise ValueError("string without end")
        elif ch == "{":
            if not spec and text.startswith("{{", i):
                i += 2
            else:
                i = _field(text, i + 1, quote, raw, fields)
        elif ch == "}":
            if spec:
                return i
            if not text.startswith("}}", i):
                raise ValueError("single brace")
            i += 2
        else:
            i += 1
    raise _OpenField


def _field(text: str, i: int, quote: str, raw: bool, fields: list[str]) -> int:
    """Reads one replacement field from behind its brace; returns the place after its end."""
    depth, parts, start = 0, [], i
    while i < len(text):
        ch = text[i]
        m = _PY_FORMATTED.match(text, i)
        if m:
            end, inner = _formatted(text, m.end())
            parts += [text[start:i], '""']
            fields += inner
            i = start = end
        elif ch in "\"'" or ch == "#":
            m = _PY_TEXT.match(text, i)
            if m["open"] is not None:
                raise _OpenField
            if len(m[0]) == 1 and ch != "#":
                raise ValueError("quote in a field")
            i = m.end()
            if ch == "#":
                parts.append(text[start : m.start()])
                start = i
        elif ch in "([{":
            depth, i = depth + 1, i + 1
        elif ch in ")]" or ch == "}" and depth:
            depth, i = depth - 1, i + 1
        elif depth == 0 and (ch in "}:" or ch == "!" and not text.startswith("!=", i)) and not (ch == ":" and re.search(r"\blambda\b[^:]*$", text[start:i])):
            body = "".join([*parts, text[start:i]])
            m = re.search(r"(?<![=!<>:])=\s*$", body)
            body = body[: m.start()] if m else body
            if not body.strip():
                raise ValueError("empty field")
            fields.append(body)
            if ch == "!":
                m = re.match(r"!\s*[rsa]\s*(?=[:}])", text[i:])
                if not m:
                    if i + 3 >= len(text):
                        raise _OpenField
                    raise ValueError("conversion")
                i += m.end()
                ch = text[i]
            return (_literal(text, i + 1, quote, raw, fields, True) if ch == ":" else i) + 1
        else:
            i += 1
    raise _OpenField


class PythonParser:
    """Python 3."""

    def __init__(self) -> None:
        self.r = recogniser("python")
        self.config, self.n, self.error = self.r.start, 0, None
        self.indents, self.depth, self.carry, self.spliced = [(0, 0)], 0, "", False

    def feed(self, lines: list[str]) -> None:
        if self.error or not lines:
            return
        if len(_SHAPES_PY) > SHAPES_LIMIT:
            _SHAPES_PY.clear()
        (self.config,) = self.r.tidy(self.config)
        text = "\n".join(lines)
        if self.n == 0 and not self.carry:
            text = text.removeprefix("\ufeff")
        if self.carry:  # the head of a string or statement that goes on in this piece
            text, self.carry = self.carry + "\n" + text, ""
            self.n -= self.held
        clean, opened = self._masked(text)
        self.spliced = opened is None and text.endswith("\\")
        if self.spliced:
            opened = text.rfind("\n") + 1
        if opened is not None:
            head = text.rfind("\n", 0, opened) + 1
            self.carry = text[head:]
            self.held = self.carry.count("\n") + 1
            before = text[: head - 1] if head else None
            if before is not None:
                self._lines(self._masked(before)[0])
            self.n += self.held
            return
        self._lines(clean)

    def _masked(self, text: str) -> tuple[str, int | None]:
        """The text with strings and comments as signs, and where a string begins that doesn't end in it."""
        opened = None

        def strip(m: re.Match) -> str:
            nonlocal opened
            if m["open"] is not None:
                opened = m.start()
            return _py_text(m)

        if not _PY_FORMATTED.search(text):
            return _PY_TEXT.sub(strip, text), opened
        out, at = [], 0
        while m := _PY_TEXT.search(text, at):
            out.append(text[at : m.start()])
            if "f" in (m["prefix"] or "").lower():
                try:
                    end, fields = _formatted(text, m.end("prefix"))
                    good = all(map(self._expression, fields))
                    glued = m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")
                    out.append((" " if glued else "") + ('" ' if good else STRAY) + "\x01" * text.count("\n", m.start(), end))
                    at = end
                except _OpenField:
                    return "".join(out), m.start()
                except (ValueError, RecursionError):
                    out.append(STRAY)
                    at = m.end()
            else:
                out.append(strip(m))
                at = m.end()
        return "".join([*out, text[at:]]), opened

    def _expression(self, field: str) -> bool:
        """Whether a replacement field of a formatted string is an expression."""
        clean = _PY_TEXT.sub(_py_text, field).replace("\n", " ")
        signs = _py_signs(_PY_WORDS.sub("I", _PY_NUMBER.sub("0 ", clean)).strip())
        config, bad = self.r.line(self.r.start, ("(", *signs, ")", "NL"))
        return bad < 0

    def _lines(self, clean: str) -> None:
        shape = _PY_WORDS.sub("I", _PY_NUMBER.sub("0 ", _soft(clean)))
        for line in shape.split("\n"):
            self.n += 1
            body = line.strip()
            if body.strip("\x01 "):
                self._line(line, body)
                if self.error:
                    return
            self.n += line.count("\x01")

    def _line(self, line: str, body: str) -> None:
        known = _SHAPES_PY.get(body)
        if known is None:
            signs = _py_signs(body)
            if body[0] == "\x03":
                signs[:2] = [{"m": "match", "c": "case", "t": "type"}[body[2]]]
            rise = sum(s in "([{" for s in signs) - sum(s in ")]}" for s in signs)
            known = _SHAPES_PY[body] = (tuple(signs), rise)
        signs, rise = known
        if self.depth <= 0:
            # columns with tab stops of eight and of one: both must agree on what is deeper
            width = other = 0
            for ch in line:
                if ch == " ":
                    width, other = width + 1, other + 1
                elif ch == "\t":
                    width, other = width // 8 * 8 + 8, other + 1
                elif ch == "\f":
                    width = other = 0
                else:
                    break
            if width > self.indents[-1][0]:
                if other <= self.indents[-1][1]:
                    self._fail("tabs and spaces")
                self.indents.append((width, other))
                self._take(("INDENT",))
            else:
                while width < self.indents[-1][0]:
                    self.indents.pop()
                    self._take(("DEDENT",))
                if width != self.indents[-1][0]:
                    self._fail("unindent to no outer level")
                elif other != self.indents[-1][1]:
                    self._fail("tabs and spaces")
        self.depth = max(0, self.depth + rise)
        self._take(signs)
        if self.depth == 0:
            self._take(("NL",))

    def _take(self, signs: tuple) -> None:
        if self.error is None:
            self.config, bad = self.r.line(self.config, signs)
            if bad >= 0:
                self._fail(f"unexpected {signs[bad]}")

    def _fail(self, why: str) -> None:
        if self.error is None:
            self.error = (self.n, why)

    def finish(self) -> tuple[int, str] | None:
        if self.carry and not self.error:
            self.n -= self.held
            self._lines(self._masked(self.carry)[0] if self.spliced else STRAY)
        if self.error is None:
            for _ in self.indents[1:]:
                self._take(("DEDENT",))
        if self.error is None and not self.r.accepts_end(self.config):
            self._fail("unexpected end of file")
        return self.error


def _py_signs(body: str) -> list[str]:
    return [_PY_NAMES.get(s, s) for s in _PY_SIGN.findall(body.replace("\x01", " "))]


def _soft(clean: str) -> str:
    """match, case and type are keywords only at the head of some lines."""
    if "match" not in clean and "case" not in clean and "type" not in clean:
        return clean
    out = []
    for line in clean.split("\n"):
        body = line.lstrip()
        m = _PY_SOFT.match(body)
        word = m and (m[1] or m[2])
        out.append(line if not m else line[: len(line) - len(body)] + f"\x030{word[0]} " + body[len(word) :])
    return "\n".join(out)


LANGUAGES = {".c": "c", ".h": "c", ".cc": "c++", ".cpp": "c++", ".hpp": "c++", ".py": "python", ".json": "json"}


def language(path: str | None) -> str | None:
    dot = (path or "").rfind(".")
    return LANGUAGES.get((path or "")[dot:].lower()) if dot >= 0 else None


def parser(lang: str):
    return {"c": lambda: CParser(False), "c++": lambda: CParser(True), "python": PythonParser, "json": JsonParser}[lang]()
