"""Secret scans: all rules in one pass over the bytes of a text.

The rules' regular expressions become one non-deterministic automaton, which
subset construction and minimisation turn into transition arrays: one for the
search (rules may begin anywhere), whose states say which rules end here, and
one for each rule and direction to settle a match's start and end. The arrays
are built once from the rules alone and do not grow with the data.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

ALL = frozenset(range(256))


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of a match, the part after ``head`` (a byte pattern) must have ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    any_case: str = ""  # letters of these words match in either case


# The base kinds, in the order that ties are listed in.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 6,
         r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""", "password passwd secret token api key"),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
# Public formats of further secrets.
MORE = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9\-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9_.\-]+", 20, r"[Bb]earer\x20+"),
)
# A run this long is needed before the search reports a rule that begins anywhere.
RUNS = {"hex": 24}


# --- regular expressions -> trees -> automata --------------------------------


def _parse(pattern: str) -> tuple:
    """Alternation, groups, classes, escapes and ``? * +`` as a tree of bytes."""
    at = 0

    def escape() -> frozenset:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return frozenset([int(pattern[at - 2 : at], 16)])
        return frozenset(c.encode())

    def one_class() -> frozenset:
        nonlocal at
        found: set[int] = set()
        while pattern[at] != "]":
            c = pattern[at]
            at += 1
            low = escape() if c == "\\" else frozenset(c.encode())
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 2
                low = frozenset(range(min(low), ord(pattern[at - 1]) + 1))
            found |= low
        at += 1
        return frozenset(found)

    def either() -> tuple:
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence() -> tuple:
        nonlocal at
        items = []
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            at += 1
            if c == "(":
                item = either()
                at += 1
            elif c == "[":
                item = ("set", one_class())
            else:
                item = ("set", escape() if c == "\\" else frozenset(c.encode()))
            if at < len(pattern) and pattern[at] in "?*+":
                item = (pattern[at], item)
                at += 1
            items.append(item)
        return ("and", items)

    return either()


def _cased(tree: tuple, letters: frozenset) -> tuple:
    kind, body = tree
    if kind == "set":
        if len(body) == 1 and body <= letters:
            return (kind, frozenset(chr(next(iter(body))).upper().encode()) | body)
        return tree
    return (kind, [_cased(t, letters) for t in body] if isinstance(body, list) else _cased(body, letters))


def _reversed(tree: tuple) -> tuple:
    kind, body = tree
    if kind == "set":
        return tree
    if isinstance(body, list):
        return (kind, [_reversed(t) for t in (body[::-1] if kind == "and" else body)])
    return (kind, _reversed(body))


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Adds the tree from ``start``; the state it ends in."""
        kind, body = tree
        if kind == "set":
            end = self.state()
            self.moves[start].append((body, end))
            return end
        if kind == "and":
            for item in body:
                start = self.add(item, start)
            return start
        end = self.state()
        if kind == "or":
            for item in body:
                self.free[self.add(item, start)].append(end)
            return end
        inner = self.state()
        self.free[start].append(inner)
        last = self.add(body, inner)
        self.free[last].append(end)
        if kind in "*+":
            self.free[last].append(inner)
        if kind in "?*":
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass
class Automaton:
    """``step[state * width + classes[byte]]`` is the next state times ``width``; 0 is the state of no hope."""

    classes: bytes
    width: int
    step: list[int]
    start: int
    accepts: list[int]  # bit set of rules, by state
    hot: int  # states from here on accept


def _classes(nfa: _Nfa) -> tuple[bytes, int]:
    """Bytes that no move tells apart share a class."""
    seen: dict[tuple, int] = {}
    sets = list({m for moves in nfa.moves for m, _ in moves})
    table = bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256))
    return table, len(seen)


def _determine(nfa: _Nfa, start: frozenset, ends: dict[int, int], again: frozenset = frozenset()) -> Automaton:
    """Subset construction, then minimisation by splitting until nothing differs."""
    classes, width = _classes(nfa)
    example = [classes.index(c) for c in range(width)]
    states: dict[frozenset, int] = {frozenset(): 0, start: 1}
    order, rows, at = [frozenset(), start], [], 0
    while at < len(order):
        row = []
        for byte in example:
            to = {t for s in order[at] for moved, t in nfa.moves[s] if byte in moved}
            target = nfa.closed(to | again)
            if target not in states:
                states[target] = len(order)
                order.append(target)
            row.append(states[target])
        rows.append(row)
        at += 1
    accepts = [sum({1 << ends[s] for s in state if s in ends}) for state in order]
    names: dict = {}
    block = [names.setdefault(a, len(names)) for a in accepts]
    while True:
        names = {}
        fresh = [names.setdefault((block[i], *[block[t] for t in rows[i]]), len(names)) for i in range(len(rows))]
        if len(names) == len(set(block)):
            break
        block = fresh
    bits = {fresh[i]: accepts[i] for i in range(len(rows))}
    place = {b: n for n, b in enumerate(sorted(bits, key=lambda b: (bits[b] != 0, b)))}
    step, kept = [0] * (len(names) * width), [0] * len(names)
    for i, row in enumerate(rows):
        own = place[fresh[i]]
        kept[own] = accepts[i]
        for c, t in enumerate(row):
            step[own * width + c] = place[fresh[t]] * width
    return Automaton(classes, width, step, place[fresh[1]] * width, kept, kept.count(0) * width)


def _tree(rule: Rule, counted: bool = False) -> tuple:
    tree = _cased(_parse(rule.pattern), frozenset(rule.any_case.encode()) - {32})
    if counted and rule.kind in RUNS:
        one = tree[1][0][1]  # the pattern is one class and ``+``
        tree = ("and", [one] * (RUNS[rule.kind] - 1) + [("+", one)])
    return tree


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    search: Automaton
    forward: list[Automaton]
    backward: list[Automaton]
    single: list[Automaton]  # each rule's own search, begun anew behind a match


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    nfa = _Nfa()
    root = nfa.state()
    ends = {nfa.add(_tree(rule, counted=True), root): i for i, rule in enumerate(rules)}
    begin = nfa.closed([root])
    search = _determine(nfa, begin, ends, again=begin)

    def alone(tree: tuple, anywhere: bool = False) -> Automaton:
        one = _Nfa()
        first = one.state()
        end = one.add(tree, first)
        opening = one.closed([first])
        return _determine(one, opening, {end: 0}, again=opening if anywhere else frozenset())

    return Scanner(
        rules, search, [alone(_tree(r)) for r in rules], [alone(_reversed(_tree(r, counted=True))) for r in rules],
        [alone(_tree(r, counted=True), anywhere=True) for r in rules],
    )


# --- scanning ----------------------------------------------------------------


def _longest(machine: Automaton, data: bytes, at: int, stop: int, by: int) -> int:
    """The farthest place reached from ``at`` by steps of ``by`` where the automaton accepts, or -1."""
    state, best, step, classes, width = machine.start, -1, machine.step, machine.classes, machine.width
    while at != stop:
        state = step[state + classes[data[at if by > 0 else at - 1]]]
        if not state:
            break
        at += by
        if machine.accepts[state // width]:
            best = at
    return best


def scan(data: bytes, found_by: Scanner) -> list[tuple[int, int, int]]:
    """Spans (start, end, rule) in bytes: per rule, of matches from the left that do not overlap.

    The pass over all rules also accepts what begins inside a rule's last match. So
    behind a match the rule's own search is begun anew and moved up to each place
    that the pass accepts; it reads no byte twice, and only where it accepts too is a
    start looked for. All in all a text is read a few times for each rule at most.
    """
    search = found_by.search
    seen, states = [0] * len(found_by.rules), [machine.start for machine in found_by.single]
    step, width = search.step, search.width
    hot, accepts = search.hot, search.accepts
    last = [0] * len(found_by.rules)
    spans = []
    state = search.start
    for at, c in enumerate(data.translate(search.classes), 1):
        state = step[state + c]
        if state >= hot:
            bits = accepts[state // width]
            while bits:
                k = (bits & -bits).bit_length() - 1
                bits &= bits - 1
                if at <= last[k]:
                    continue
                if last[k]:
                    own = found_by.single[k]
                    if seen[k] < last[k]:
                        seen[k], states[k] = last[k], own.start
                    now = states[k]
                    for byte in data[seen[k] : at]:
                        now = own.step[now + own.classes[byte]]
                    seen[k], states[k] = at, now
                    if not own.accepts[now // own.width]:
                        continue
                start = _longest(found_by.backward[k], data, at, last[k], -1)
                if start < 0:
                    continue
                end = _longest(found_by.forward[k], data, start, len(data), 1)
                last[k] = end
                rule = found_by.rules[k]
                body = start + re.match(rule.head.encode(), data[start:end]).end() if rule.head else start
                if end - body >= rule.least:
                    spans.append((start, end, k))
    return spans


def _places(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code point spans."""
    if data.isascii() or not spans:
        return spans
    place, at, seen = {}, 0, 0
    for p in sorted({p for s, e, _ in spans for p in (s, e)}):
        seen += len(data[at:p].decode("utf-8", "surrogatepass"))
        place[p], at = seen, p
    return [(place[s], place[e], k) for s, e, k in spans]


def find_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Spans of secrets in every whole text.

    Needs ``doc_id`` and ``text``; other columns are not read. Returns
    ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans``; places are code points, the end is exclusive. A null text is
    empty. Repeated rows are scanned each; nothing is shuffled. An empty table
    gives an empty result. Spans of different kinds may overlap.
    """
    rules = (*BASE, *more)
    base = len(BASE)
    # A few MB that depend on the rules alone, so every task may have a copy.
    sent = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = sent.value
        names = [r.kind for r in rules]
        for frame in frames:
            rows = []
            for text in frame.column("text"):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                spans = sorted(_places(data, scan(data, found_by)), key=lambda s: (s[0], s[2]))
                said = [f"{names[k]}:{s}:{e}" for s, e, k in spans]
                plain = ",".join(t for t, (_, _, k) in zip(said, spans) if k < base)
                counts = [sum(k == i for _, _, k in spans) for i in range(base)]
                rows.append((*counts, hashlib.sha256(plain.encode()).hexdigest(), ",".join(said)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
