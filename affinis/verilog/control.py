"""Conditions and state machines: paths through driver trees, ranges of a state variable, transitions and loops."""

from __future__ import annotations

from affinis.verilog.dataflow import sources
from affinis.verilog.elaborate import Bind, Design, is_reset
from affinis.verilog.syntax import Node, written
from affinis.verilog.values import evaluate, optimised, same

# Parts of names that mark a state variable.
STATE_NAMES = ["fsm", "state", "count", "cnt", "step", "mode"]
Ranges = list[tuple[int, int]]
FLIPPED = {"LessThan": "GreaterThan", "GreaterThan": "LessThan", "LessEq": "GreaterEq", "GreaterEq": "LessEq"}


def is_state(name: str) -> bool:
    return any(s in name.rsplit(".", 1)[-1].lower() for s in STATE_NAMES)


def paths(tree: Node) -> list[tuple[list[tuple[Node, bool]], Node]]:
    """(conditions with whether they hold, leaf) of every way through the branches of a tree, true ways first."""
    out, todo = [], [([], tree)]
    while todo:
        way, at = todo.pop()
        if at.kind == "cond":
            test, yes, no = at.children
            todo += [([*way, (test, False)], no), ([*way, (test, True)], yes)]
        else:
            out.append((way, at))
    return out


def without_reset(found: list[tuple[list, Node]]) -> list[tuple[list, Node]]:
    """Paths without the conditions that name a reset; one that has none left goes if there are others."""
    cut = [([c for c in way if not any(is_reset(s) for s in sources(c[0]))], leaf) for way, leaf in found]
    some = [(way, leaf) for way, leaf in cut if way]
    return some or cut


def united(a: Ranges) -> Ranges:
    out: Ranges = []
    for low, high in sorted(a):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def common(a: Ranges, b: Ranges) -> Ranges:
    return united([(max(x[0], y[0]), min(x[1], y[1])) for x in a for y in b if max(x[0], y[0]) <= min(x[1], y[1])])


def others(a: Ranges, top: int) -> Ranges:
    out, at = [], 0
    for low, high in united(a):
        if low > at:
            out.append((at, low - 1))
        at = high + 1
    return out + [(at, top)] if at <= top else out


def compared(op: str, value: int, top: int) -> Ranges:
    """The values v with v op value."""
    found = {"Eq": (value, value), "Eql": (value, value), "LessThan": (0, value - 1), "LessEq": (0, value), "GreaterThan": (value + 1, top), "GreaterEq": (value, top)}
    if op in ("NotEq", "NotEql"):
        return others([(value, value)], top)
    low, high = found[op]
    low, high = max(0, low), min(top, high)
    return [(low, high)] if low <= high else []


def states(test: Node, holds: bool, name: str, top: int, params: dict[str, int]) -> tuple[Ranges, Node | None]:
    """The values of a state variable under which a condition can hold (or not), and what it asks of other signals
    (None: nothing). AND cuts ranges, OR unites them, NOT takes the rest; what doesn't name the variable asks for all."""
    every: Ranges = [(0, top)]
    if test.kind == "op":
        c, op = test.children, test.value
        if op in ("Ulnot", "Unot") and name in sources(test):
            return states(c[0], not holds, name, top, params)
        if op in ("Land", "And", "Lor", "Or"):
            (a, x), (b, y) = (states(v, holds, name, top, params) for v in c)
            if (op in ("Land", "And")) == holds:
                rest = [v for v in (x, y) if v is not None]
                return common(a, b), rest[0] if len(rest) == 1 else Node("op", "Land", rest) if rest else None
            if x is None and y is None:
                return united(a + b), None
            return united(a + b), test if holds else Node("op", "Ulnot", [test])
        if op in ("Eq", "NotEq", "Eql", "NotEql", *FLIPPED):
            for left, right, sign in ((c[0], c[1], op), (c[1], c[0], FLIPPED.get(op, op))):
                value = evaluate(optimised(right, params), params)
                if left.kind == "id" and left.value == name and value is not None:
                    found = compared(sign, value, top)
                    return found if holds else others(found, top), None
    if test.kind == "id" and test.value == name:
        return (others([(0, 0)], top) if holds else [(0, 0)]), None
    return every, test if holds else Node("op", "Ulnot", [test])


def transitions(design: Design, bind: Bind) -> list[tuple[int, int, str | None]]:
    """(from, to, condition) of a state register; a condition of None always holds. Conditions of one pair are joined
    by ||."""
    top = (1 << min(design.terms[bind.dest].width, 16)) - 1
    held: dict[tuple[int, int], set[str | None]] = {}
    for way, leaf in without_reset(paths(optimised(bind.tree, design.params))):
        to = evaluate(optimised(leaf, design.params), design.params)
        if to is None:
            continue
        ranges, asks = [(0, top)], []
        for test, holds in way:
            found, rest = states(test, holds, bind.dest, top, design.params)
            ranges = common(ranges, found)
            asks += [written(rest)] if rest is not None else []
        if ranges == [(0, top)] and top > 63:
            continue  # any state: no machine over so many
        for low, high in ranges:
            for at in range(low, min(high, low + 4096) + 1):
                held.setdefault((at, to), set()).add(" && ".join(asks) or None)
    return [(a, b, None if None in asks else " || ".join(sorted(asks))) for (a, b), asks in sorted(held.items())]


def machines(design: Design) -> dict[str, list[tuple[int, int, str | None]]]:
    """State machines: clocked registers with a state's name and constant targets. Where a register takes over a next
    state that is worked out by logic, that logic is put in its place."""
    from affinis.verilog.dataflow import inlined

    out = {}
    for b in design.binds:
        if b.kind == "clockedge" and b.msb is None and b.index is None and is_state(b.dest):
            found = transitions(design, b) or transitions(design, Bind(b.dest, inlined(design, b.dest, stop={b.dest}), b.kind))
            if found:
                out[b.dest] = found
    return out


def size(moves: list[tuple[int, int, str | None]]) -> int:
    return len(moves)


def label_range(moves: list[tuple[int, int, str | None]]) -> tuple[int, int]:
    every = [s for a, b, _ in moves for s in (a, b)]
    return min(every), max(every)


def loops(moves: list[tuple[int, int, str | None]], depth: int = 50) -> list[tuple[int, ...]]:
    """Simple cycles of at most ``depth`` states, each from its smallest state on."""
    after: dict[int, list[int]] = {}
    for a, b, _ in moves:
        if b not in after.setdefault(a, []):
            after[a].append(b)
    out = []
    for start in sorted(after):
        todo = [(start,)]
        while todo:
            way = todo.pop()
            for n in after.get(way[-1], ()):
                if n == start:
                    out.append(way)
                elif n > start and n not in way and len(way) < depth:
                    todo.append((*way, n))
    return sorted(out)


def active_conditions(bind: Bind, value: Node | None = None, changes: bool | None = None) -> list[str]:
    """The path conditions under which a signal takes a value (value), takes a new one (changes) or keeps its own (not
    changes)."""
    out = []
    for way, leaf in paths(bind.tree):
        keeps = leaf.kind == "id" and leaf.value == bind.dest
        if (value is None or same(leaf, value)) and (changes is None or changes != keeps):
            out.append(" && ".join(written(t) if holds else f"(!{written(t)})" for t, holds in way) or "1")
    return out


def kept_assignments(found: list[tuple[list, Node]], dest: str, which: str) -> list[tuple[list, Node]]:
    """Paths whose leaf is a constant (active), another value than the signal's own (modifying) or its own
    (unmodifying)."""

    def keeps(leaf: Node) -> bool:
        return leaf.kind == "id" and leaf.value == dest

    tests = {"active": lambda leaf: evaluate(leaf) is not None, "modifying": lambda leaf: not keeps(leaf), "unmodifying": keeps}
    return [(way, leaf) for way, leaf in found if tests[which](leaf)]
