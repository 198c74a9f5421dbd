"""Register resolver: wrapper calls of source text and the symbols they access.

Pure functions over one text, run on executors by ``codegraph.file_facts`` and ``resolved_symbols``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: What an access stands for as a graph relation.
ACCESS_RELATION = {"read": "reads", "write": "writes", "read_modify_write": "sets_field", "field_set": "sets_field", "field_get": "reads"}


@dataclass(frozen=True)
class Wrapper:
    """Arguments that name symbols, and the access they get; field_arg names a register's field."""

    symbol_args: tuple[int, ...]
    access: str
    field_arg: int | None = None


@dataclass(frozen=True)
class Profile:
    """A language's wrappers; configuration that callers may replace."""

    id: str
    wrappers: dict[str, Wrapper]
    prefixes: tuple[str, ...] = ("reg", "mm", "smn")
    extractors: tuple[str, ...] = field(default=())


DEFAULT = Profile(
    "cpp",
    {
        "WREG32": Wrapper((0,), "write"),
        "RREG32": Wrapper((0,), "read"),
        "WREG32_SOC15": Wrapper((2,), "write"),
        "RREG32_SOC15": Wrapper((2,), "read"),
        "REG_SET_FIELD": Wrapper((1,), "field_set", 2),
        "REG_GET_FIELD": Wrapper((1,), "field_get", 2),
    },
)
PYTHON = Profile("python", {}, extractors=("read_reg", "write_reg"))

_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")


def closing(text: str, at: int) -> int:
    """Offset of the bracket that closes the one at ``at``, quotes skipped; -1 if there is none."""
    depth, quote = 0, ""
    i = at
    while i < len(text):
        ch = text[i]
        if quote:
            if ch == "\\":
                i += 1
            elif ch == quote:
                quote = ""
        elif ch in "\"'":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def arguments(text: str) -> list[str]:
    """Parts of an argument list, cut at the commas outside any bracket."""
    out, depth, at, quote = [], 0, 0, ""
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote and text[i - 1] != "\\" else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "," and depth == 0:
            out.append(text[at:i].strip())
            at = i + 1
    tail = text[at:].strip()
    return out + [tail] if tail or out else []


def wrapper_calls(text: str, profile: Profile = DEFAULT) -> Iterator[tuple[str, int, list[str]]]:
    """(wrapper, offset, arguments) of each call of a configured wrapper, nested ones too."""
    for m in _CALL.finditer(text):
        if m[1] in profile.wrappers:
            end = closing(text, m.end() - 1)
            if end >= 0:
                yield m[1], m.start(), arguments(text[m.end() : end])


def symbol_of(argument: str, profile: Profile = DEFAULT) -> str | None:
    """The symbol an argument names: of a nested wrapper call, else a prefixed identifier, else a bare one that isn't all lower case."""
    for wrapper, _, args in wrapper_calls(argument, profile):
        for k in profile.wrappers[wrapper].symbol_args:
            if k < len(args) and (s := symbol_of(args[k], profile)):
                return s
    names = re.findall(r"[A-Za-z_]\w*", argument)
    for n in names:
        for p in profile.prefixes:
            if n.startswith(p) and n[len(p) : len(p) + 1].isupper():
                return n
    if len(names) == 1 and names[0] == argument.strip() and not names[0].islower():
        return names[0]
    return None


def resolve(text: str, profile: Profile = DEFAULT) -> list[tuple[str, str, str, str, int]]:
    """(wrapper, symbol, access, field, offset), each combination once, in order of appearance."""
    out: dict[tuple, int] = {}
    for wrapper, at, args in wrapper_calls(text, profile):
        w = profile.wrappers[wrapper]
        name = args[w.field_arg] if w.field_arg is not None and w.field_arg < len(args) else ""
        for k in w.symbol_args:
            if k < len(args) and (s := symbol_of(args[k], profile)):
                out.setdefault((wrapper, s, w.access, name if re.fullmatch(r"\w+", name) else ""), at)
    for extractor in profile.extractors:
        for m in re.finditer(rf"\b{re.escape(extractor)}\s*\(\s*(['\"])(\w+)\1", text):
            out.setdefault((extractor, m[2], "write" if "write" in extractor else "read", ""), m.start())
    return [(*k, v) for k, v in out.items()]
