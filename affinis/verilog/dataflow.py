"""Data flow of an elaborated design: graphs of driver trees, slices, sources, inlined trees."""

from __future__ import annotations

from affinis.verilog.elaborate import Bind, Design
from affinis.verilog.syntax import Node, written
from affinis.verilog.values import optimised

_SLOTS = {"cond": ["COND", "TRUE", "FALSE"], "part": ["VAR", "MSB", "LSB"], "pointer": ["VAR", "PTR"]}


def sources(tree: Node) -> set[str]:
    """The signals a tree reads."""
    out, todo = set(), [tree]
    while todo:
        n = todo.pop()
        if n.kind == "id":
            out.add(n.value)
        todo += n.children
    return out


def graph(design: Design, identical: bool = False) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str | None]]]:
    """Nodes (name, label, type) and edges (from a destination towards what drives it, with its label).

    Operators and constants are nodes of their own (label and a number); signals are shared by name, unless identical,
    which gives every read its own node.
    """
    nodes: dict[str, tuple[str, str]] = {}
    edges: list[tuple[str, str, str | None]] = []
    widths = {t.name: t.width for t in design.terms.values()}

    def node(e: Node) -> str:
        if e.kind == "id" and not identical:
            nodes.setdefault(e.value, (e.value, "signal"))
            return e.value
        label = {"op": e.value, "cond": "Branch", "concat": "Concat", "repeat": "Repeat", "part": "Partselect", "pointer": "Pointer", "call": e.value}.get(e.kind, e.value)
        kind = {"op": str(e.value).lower(), "const": "numeric", "string": "numeric", "id": "signal"}.get(e.kind, label.lower())
        name = f"{label}_graphrename_{len(nodes)}"
        nodes[name] = (label, kind)
        return name

    def walk(e: Node) -> str:
        top = node(e)
        todo = [(e, top)]
        while todo:
            at, name = todo.pop()
            labels = _SLOTS.get(at.kind, [None] * len(at.children))
            for c, label in zip(at.children, labels, strict=True):
                below = node(c)
                edges.append((name, below, label))
                todo.append((c, below))
        return top

    for b in sorted(design.binds, key=lambda b: b.dest.lower()):
        if b.kind in ("parameter", "localparam"):
            continue
        nodes.setdefault(b.dest, (b.dest, "signal"))
        edges.append((b.dest, walk(optimised(b.tree, design.params, widths)), None if b.msb is None else f"[{b.msb}:{b.lsb}]"))
    return [(n, label, kind) for n, (label, kind) in nodes.items()], edges


def aliases_merged(nodes: list[tuple], edges: list[tuple]) -> list[tuple]:
    """Edges in which a node whose label with '_' read as '.' is a root's label stands for that root."""
    below = {b for _, b, *_ in edges}
    roots = {label: n for n, label, *_ in nodes if n not in below}
    to = {n: roots[label.replace("_", ".")] for n, label, *_ in nodes if label not in roots and label.replace("_", ".") in roots}
    return [(to.get(a, a), to.get(b, b), *rest) for a, b, *rest in edges]


def slice_of(design: Design, targets: list[str]) -> list[Bind]:
    """All binds that the targets depend on, their clocks and resets included."""
    seen, todo, out = set(), list(targets), []
    while todo:
        name = todo.pop()
        if name in seen:
            continue
        seen.add(name)
        for b in design.drivers(name):
            out.append(b)
            todo += [*sources(b.tree), *(sources(b.index) if b.index else ()), *(x for x in (b.clock, b.reset) if x)]
    return out


def slice_kinds(binds: list[Bind]) -> dict[str, list[Bind]]:
    """Binds of a slice by what they are: parameter, assign, clockedge (by clock, edge, reset) or combination."""
    out: dict[str, list[Bind]] = {}
    for b in binds:
        key = {"localparam": "parameter"}.get(b.kind, b.kind)
        if key == "clockedge":
            key = f"clockedge {b.edge} {b.clock}" + (f" {b.reset_edge} {b.reset}" if b.reset else "")
        out.setdefault(key, []).append(b)
    return out


def inlined(design: Design, name: str, steps: int = 1000, stop: set[str] | None = None) -> Node:
    """The tree of a signal in terms of inputs and registers: what drives it is put in its place, as long as the budget
    of steps lasts; a signal that would contain itself, is clocked or stands in ``stop`` stays."""
    left = [steps]

    def put(e: Node, inside: frozenset) -> Node:
        if e.kind == "id":
            own = [b for b in design.drivers(e.value) if b.msb is None and b.index is None]
            if e.value in inside or e.value in (stop or ()) or len(own) != 1 or own[0].kind == "clockedge" or left[0] <= 0:
                return e
            left[0] -= 1
            return put(own[0].tree, inside | {e.value})
        return Node(e.kind, e.value, [put(c, inside) for c in e.children], e.line)

    own = [b for b in design.drivers(name) if b.msb is None and b.index is None]
    return optimised(put(own[0].tree, frozenset([name])), design.params) if len(own) == 1 else Node("id", name)


def generated(binds: list[Bind]) -> str:
    """Binds as Verilog text: assigns, and one always block for each clock."""
    out = []
    for key, some in slice_kinds(binds).items():
        if key.startswith("clockedge"):
            words = key.split()[1:]
            out.append(f"always @({' or '.join(' '.join(words[k : k + 2]) for k in range(0, len(words), 2))}) begin")
            out += [f"  {_left(b)} <= {written(b.tree)};" for b in some] + ["end"]
        else:
            out += [f"{'localparam' if key == 'parameter' else 'assign'} {_left(b)} = {written(b.tree)};" for b in some]
    return "\n".join(out)


def _left(b: Bind) -> str:
    if b.index is not None:
        return f"{b.dest}[{written(b.index)}]"
    return b.dest if b.msb is None else f"{b.dest}[{b.msb}:{b.lsb}]"
