"""Table-driven generalised LR recogniser.

A grammar file (``grammars/*.bnf``) is turned into an SLR(1) table.  Where the table has
conflicts the recogniser follows every alternative (generalised LR): a configuration is a set of
parse stacks.  Stacks are interned nodes, and the effect of a whole line of tokens on a
configuration is memoised, so that source code, whose lines have few shapes, costs one
dictionary lookup per line.
"""

from __future__ import annotations

import pkgutil
from functools import lru_cache

END = "$end"
#: Signs that stand for strings, bytes and character constants in token streams: none can be a name.
CODES = {"S": '"', "B": "`", "Q": "'"}
MEMO_LIMIT = 400_000  # entries kept per grammar and process before the memo starts afresh


def read_grammar(*names: str) -> tuple[str, list[tuple[str, tuple[str, ...]]]]:
    """Rules of the named grammar files; a later file adds alternatives to the same left side."""
    rules: list[tuple[str, tuple[str, ...]]] = []
    start = ""
    for name in names:
        lhs = ""
        for line in pkgutil.get_data(__package__, f"grammars/{name}.bnf").decode().splitlines():
            line = line.split("%%")[0].rstrip()
            if not line.strip():
                continue
            words = line.split()
            if not line[0].isspace():
                lhs, words = words[0], words[2:]
                start = start or lhs
            elif words[0] == "|":
                words = words[1:]
            alt: list[str] = []
            for w in words:
                if w == "|":
                    rules.append((lhs, tuple(alt)))
                    alt = []
                elif w != "%empty":
                    alt.append(w.replace("BAR", "|") if w.startswith("BAR") else CODES.get(w, w))
            rules.append((lhs, tuple(alt)))
    return start, list(dict.fromkeys(rules))


class Table:
    """LR(0) automaton with SLR(1) lookahead, conflicts kept."""

    def __init__(self, *names: str) -> None:
        start, rules = read_grammar(*names)
        self.rules = [("$start", (start,)), *rules]
        by_lhs: dict[str, list[int]] = {}
        for i, (lhs, _) in enumerate(self.rules):
            by_lhs.setdefault(lhs, []).append(i)
        self.tokens = {s for _, rhs in self.rules for s in rhs if s not in by_lhs}
        first, nullable = self._first(by_lhs)
        follow = self._follow(by_lhs, first, nullable)
        states: dict[frozenset, int] = {}
        kernels: list[frozenset] = []

        def state(kernel: frozenset) -> int:
            if kernel not in states:
                states[kernel] = len(kernels)
                kernels.append(kernel)
            return states[kernel]

        state(frozenset([(0, 0)]))
        self.shift: list[dict[str, int]] = []
        self.reduce: list[dict[str, list[tuple[int, str]]]] = []
        at = 0
        while at < len(kernels):
            items, todo = set(kernels[at]), list(kernels[at])
            while todo:
                r, d = todo.pop()
                rhs = self.rules[r][1]
                if d < len(rhs):
                    for k in by_lhs.get(rhs[d], ()):
                        if (k, 0) not in items:
                            items.add((k, 0))
                            todo.append((k, 0))
            moves: dict[str, set] = {}
            reduce: dict[str, list[tuple[int, str]]] = {}
            for r, d in items:
                lhs, rhs = self.rules[r]
                if d < len(rhs):
                    moves.setdefault(rhs[d], set()).add((r, d + 1))
                else:
                    for t in follow[lhs]:
                        reduce.setdefault(t, []).append((len(rhs), lhs))
            self.shift.append({s: state(frozenset(k)) for s, k in sorted(moves.items())})
            self.reduce.append({t: sorted(set(v)) for t, v in reduce.items()})
            at += 1

    def _first(self, by_lhs: dict) -> tuple[dict[str, set], set]:
        first: dict[str, set] = {n: set() for n in by_lhs}
        nullable: set[str] = set()
        changed = True
        while changed:
            changed = False
            for lhs, rhs in self.rules:
                before = len(first[lhs]), lhs in nullable
                for s in rhs:
                    first[lhs] |= first.get(s, {s})
                    if s not in nullable:
                        break
                else:
                    nullable.add(lhs)
                changed |= before != (len(first[lhs]), lhs in nullable)
        return first, nullable

    def _follow(self, by_lhs: dict, first: dict, nullable: set) -> dict[str, set]:
        follow: dict[str, set] = {n: set() for n in by_lhs}
        follow["$start"].add(END)
        changed = True
        while changed:
            changed = False
            for lhs, rhs in self.rules:
                tail = set(follow[lhs])
                for s in reversed(rhs):
                    if s in by_lhs:
                        n = len(follow[s])
                        follow[s] |= tail
                        changed |= n != len(follow[s])
                        tail = (tail | first[s]) if s in nullable else set(first[s])
                    else:
                        tail = {s}
        return follow


class Recogniser:
    """Feeds lines of tokens to configurations of a ``Table``; immutable configurations are tuples of node ids."""

    def __init__(self, table: Table) -> None:
        self.table = table
        self._reset()

    def _reset(self) -> None:
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.ids: dict[tuple[int, int], int] = {(0, -1): 0}
        self.steps: dict[tuple, tuple] = {}
        self.lines: dict[tuple, tuple[tuple, int]] = {}

    @property
    def start(self) -> tuple[int, ...]:
        return (0,)

    def tidy(self, *configs: tuple) -> list[tuple]:
        """Bounds the memo's memory, also inside a file: past the limit it starts afresh with the stacks of the given configurations."""
        if len(self.lines) + len(self.steps) <= MEMO_LIMIT and len(self.nodes) <= MEMO_LIMIT:
            return list(configs)
        nodes, fresh = self.nodes, {0: 0}
        self._reset()
        out = []
        for config in configs:
            for n in config:
                path = []
                while n not in fresh:
                    path.append(n)
                    n = nodes[n][1]
                for k in reversed(path):
                    fresh[k] = self._node(nodes[k][0], fresh[nodes[k][1]])
            out.append(tuple(sorted(fresh[n] for n in config)))
        return out

    def _node(self, state: int, parent: int) -> int:
        key = (state, parent)
        n = self.ids.get(key)
        if n is None:
            n = self.ids[key] = len(self.nodes)
            self.nodes.append(key)
        return n

    def step(self, config: tuple, token: str) -> tuple:
        key = (config, token)
        known = self.steps.get(key)
        if known is not None:
            return known
        shift, reduce, nodes = self.table.shift, self.table.reduce, self.nodes
        seen, todo, out = set(config), list(config), set()
        while todo:
            n = todo.pop()
            s = nodes[n][0]
            if token in shift[s]:
                out.add(self._node(shift[s][token], n))
            for size, lhs in reduce[s].get(token, ()):
                below = n
                for _ in range(size):
                    below = nodes[below][1]
                if lhs == "$start":
                    if token == END:
                        out.add(0)
                    continue
                m = self._node(shift[nodes[below][0]][lhs], below)
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        result = self.steps[key] = tuple(sorted(out))
        return result

    def line(self, config: tuple, tokens: tuple[str, ...]) -> tuple[tuple, int]:
        """The configuration after the tokens, and the index of the token that no stack accepts, or -1."""
        key = (config, tokens)
        known = self.lines.get(key)
        if known is None:
            known = (config, -1)
            for i, t in enumerate(tokens):
                config = self.step(config, t)
                if not config:
                    known = ((), i)
                    break
            else:
                known = (config, -1)
            self.lines[key] = known
        return known

    def accepts_end(self, config: tuple) -> bool:
        return bool(self.step(config, END))


@lru_cache(maxsize=None)
def recogniser(*names: str) -> Recogniser:
    """One per grammar and process."""
    return Recogniser(Table(*names))
