"""Elaboration: the instance hierarchy of a design, its terms (declared signals), and its binds.

A bind gives one destination (or a range of its bits) the tree that drives it. Inside an always block, statements are
executed on trees: a blocking assignment is seen by later reads, a non-blocking one is not; branches fold into one
conditional tree per destination, in which a signal that a branch leaves alone keeps its value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from affinis.verilog.syntax import Node, VerilogError, number
from affinis.verilog.values import constant, evaluate, optimised

CLOCK, RESET = re.compile("clk|clock", re.I), re.compile("reset|rst", re.I)
#: Turns of a loop that is unrolled.
TURNS = 4096


def is_clock(name: str) -> bool:
    return bool(CLOCK.search(name))


def is_reset(name: str) -> bool:
    return bool(RESET.search(name))


@dataclass
class Term:
    name: str
    kinds: set[str]
    msb: int | None = None
    lsb: int | None = None

    @property
    def width(self) -> int:
        return 1 if self.msb is None else abs(self.msb - self.lsb) + 1


@dataclass
class Bind:
    dest: str
    tree: Node
    kind: str  # assign, combination, clockedge, parameter or localparam
    msb: int | None = None
    lsb: int | None = None
    index: Node | None = None
    clock: str | None = None
    edge: str | None = None
    reset: str | None = None
    reset_edge: str | None = None


@dataclass
class Design:
    terms: dict[str, Term] = field(default_factory=dict)
    binds: list[Bind] = field(default_factory=list)
    instances: list[tuple[str, str]] = field(default_factory=list)  # path, module
    params: dict[str, int] = field(default_factory=dict)

    def drivers(self, name: str) -> list[Bind]:
        return [b for b in self.binds if b.dest == name]


class _Frame:
    """One always block or subroutine: what each signal holds so far, by blocking and by non-blocking assignments."""

    def __init__(self, now: dict | None = None, later: dict | None = None):
        self.now, self.later = dict(now or {}), dict(later or {})

    def copy(self) -> _Frame:
        return _Frame(self.now, self.later)


class _Elaborator:
    def __init__(self, modules: dict[str, Node]):
        self.modules, self.design = modules, Design()

    def module(self, node: Node, path: str, given: dict[str, Node], ports: dict[str, Node] | None) -> None:
        self.design.instances.append((path, node.value))
        routines = {c.value: c for c in node.children if c.kind in ("function", "task")}
        scope = _Scope(self, path, routines)
        for item in node.children[1:]:
            scope.declare(item, given)
        directions = {t.name.rsplit(".", 1)[1]: t.kinds for t in self.design.terms.values() if t.name.rsplit(".", 1)[0] == path}
        for port, outer in (ports or {}).items():
            inner = Node("id", f"{path}.{port}")
            if "input" in directions.get(port, ()):
                self.design.binds.append(Bind(inner.value, outer, "assign"))
            else:
                for b in scope.targets(outer, inner, resolved=True):
                    self.design.binds.append(b)
        for item in node.children[1:]:
            scope.item(item)


class _Scope:
    def __init__(self, owner: _Elaborator, path: str, routines: dict[str, Node], values: dict[str, int] | None = None, outer: _Scope | None = None):
        self.owner, self.path, self.routines, self.values, self.outer = owner, path, routines, values or {}, outer

    # names and expressions

    def full(self, name: str) -> str:
        scope: _Scope | None = self
        while scope:
            if f"{scope.path}.{name}" in self.owner.design.terms:
                return f"{scope.path}.{name}"
            scope = scope.outer
        return f"{self.path}.{name}"

    def value_of(self, name: str) -> int | None:
        scope: _Scope | None = self
        while scope:
            if name in scope.values:
                return scope.values[name]
            scope = scope.outer
        return None

    def tree(self, e: Node, frame: _Frame | None = None) -> Node:
        """An expression with full names, constants of this scope in place, and what ``frame`` holds."""
        if e.kind == "id":
            value = self.value_of(e.value)
            if value is not None:
                return constant(value)
            name = self.full(e.value)
            return frame.now.get(name, Node("id", name)) if frame else Node("id", name)
        if e.kind == "call" and e.value in self.routines:
            return self.called(self.routines[e.value], [self.tree(c, frame) for c in e.children])
        if e.kind == "call" and e.value in ("$signed", "$unsigned") and e.children:
            return self.tree(e.children[0], frame)
        if e.kind in ("part", "pointer"):
            base = e.children[0]
            whole = Node("id", self.full(base.value)) if base.kind == "id" and self.value_of(base.value) is None else self.tree(base, frame)
            if frame and whole.kind == "id" and whole.value in frame.now:
                whole = frame.now[whole.value]
            return Node(e.kind, None, [whole, *(self.tree(c, frame) for c in e.children[1:])], e.line)
        return Node(e.kind, e.value, [self.tree(c, frame) for c in e.children], e.line)

    def number(self, e: Node, frame: _Frame | None = None) -> int:
        tree = optimised(self.tree(e, frame), self.owner.design.params)
        value = evaluate(tree, self.owner.design.params)
        if value is None:
            raise VerilogError(f"line {e.line}: not constant")
        return value

    def called(self, routine: Node, args: list[Node]) -> Node:
        inner = _Scope(self.owner, f"{self.path}.{routine.value}", self.routines, {}, self)
        frame, given = _Frame(), iter(args)
        for c in routine.children[1:]:
            for d in c.children if c.kind == "decls" else [c] if c.kind == "decl" else []:
                name = f"{inner.path}.{d.value[2]}"
                self.owner.design.terms.setdefault(name, Term(name, {"function"}))
                if d.value[0] == "input":
                    frame.now[name] = next(given, constant(0))
        result = f"{inner.path}.{routine.value}"
        self.owner.design.terms.setdefault(result, Term(result, {"function"}))
        for c in routine.children[1:]:
            if c.kind not in ("decl", "decls"):
                inner.run(c, frame)
        return frame.now.get(result, Node("id", result))

    # declarations and items

    def declare(self, item: Node, given: dict[str, Node] | None = None) -> None:
        if item.kind != "decls":
            return
        design = self.owner.design
        for d in item.children:
            kind, also, name, _, spanned, valued = d.value
            full = f"{self.path}.{name}"
            term = design.terms.setdefault(full, Term(full, set()))
            term.kinds |= {kind} | ({also} if also else set())
            if spanned:
                term.msb, term.lsb = self.number(d.children[0]), self.number(d.children[1])
            elif kind in ("integer", "genvar", "parameter", "localparam") and term.msb is None:
                term.msb, term.lsb = 31, 0
            if kind in ("parameter", "localparam") and valued:
                tree = given[name] if given and kind == "parameter" and name in given else self.tree(d.children[-1])
                value = evaluate(optimised(tree, design.params), design.params)
                if value is not None:
                    design.params[full] = value
                design.binds.append(Bind(full, tree, kind))
            elif kind in ("supply0", "supply1"):
                design.binds.append(Bind(full, constant(int(kind[-1]), term.width), "assign"))
            elif valued:
                design.binds.append(Bind(full, self.tree(d.children[-1]), "assign"))

    def item(self, item: Node) -> None:
        design = self.owner.design
        if item.kind == "assigns":
            for a in item.children:
                design.binds += self.targets(a.children[0], self.tree(a.children[1]))
        elif item.kind == "always":
            self.always(item)
        elif item.kind == "instances":
            self.instances(item)
        elif item.kind in ("generate", "scope"):
            inner = _Scope(self.owner, f"{self.path}.{item.value}", self.routines, {}, self) if item.kind == "scope" and item.value else self
            for c in item.children:
                inner.declare(c)
            for c in item.children:
                inner.item(c)
        elif item.kind == "genif":
            self.item(item.children[1] if self.number(item.children[0]) else item.children[2])
        elif item.kind == "genfor":
            first, test, step, body = item.children
            name = first.children[0].value
            inner = _Scope(self.owner, self.path, self.routines, {name: self.number(first.children[1])}, self)
            for _ in range(TURNS):
                if not inner.number(test):
                    return
                at = inner.values[name]
                block = _Scope(self.owner, f"{self.path}.{body.value or 'genblk'}_{at}", self.routines, {name: at}, self)
                for c in body.children if body.kind == "scope" else [body]:
                    block.declare(c)
                for c in body.children if body.kind == "scope" else [body]:
                    block.item(c)
                inner.values[name] = inner.number(step.children[1])
            raise VerilogError(f"line {item.line}: a loop that doesn't end")

    def instances(self, item: Node) -> None:
        module = self.owner.modules.get(item.value)
        for inst in item.children[1:]:
            copies = [""]
            if inst.children[0].children:
                high, low = (self.number(c) for c in inst.children[0].children)
                copies = [f"_{k}" for k in range(min(high, low), max(high, low) + 1)]
            for suffix in copies:
                path = f"{self.path}.{inst.value or item.value}{suffix}"
                if module is None:
                    self.owner.design.instances.append((path, item.value))
                    continue
                names = module.children[0].value
                params = [d.value[2] for c in module.children if c.kind == "decls" for d in c.children if d.value[0] == "parameter"]
                given = {p.value or params[k]: self.tree(p.children[0]) for k, p in enumerate(item.children[0].children) if p.children}
                ports = {p.value or names[k]: self.tree(p.children[0]) for k, p in enumerate(inst.children[1:]) if p.children}
                self.owner.module(module, path, given, ports)

    def targets(self, left: Node, tree: Node, kind: str = "assign", resolved: bool = False, **clocked) -> list[Bind]:
        """Binds of a left side, which may be a concatenation, a part or one bit."""
        if left.kind == "concat":
            out, low = [], 0
            for c in reversed(left.children):
                width = self.bits(c, resolved)
                out += self.targets(c, Node("part", None, [tree, constant(low + width - 1), constant(low)]), kind, resolved, **clocked)
                low += width
            return out
        name = left.value if left.kind == "id" else left.children[0].value
        name = name if resolved else self.full(name)
        if left.kind == "part":
            return [Bind(name, tree, kind, *(self.number(c) if not resolved else evaluate(c, self.owner.design.params) for c in left.children[1:]), **clocked)]
        if left.kind == "pointer":
            at = left.children[1] if resolved else self.tree(left.children[1])
            value = evaluate(optimised(at, self.owner.design.params), self.owner.design.params)
            return [Bind(name, tree, kind, value, value, None if value is not None else at, **clocked)]
        return [Bind(name, tree, kind, **clocked)]

    def bits(self, e: Node, resolved: bool) -> int:
        if e.kind == "pointer":
            return 1
        if e.kind == "part":
            high, low = (evaluate(c if resolved else self.tree(c), self.owner.design.params) for c in e.children[1:])
            return abs(high - low) + 1
        term = self.owner.design.terms.get(e.value if resolved else self.full(e.value))
        return term.width if term else 1

    # always blocks

    def always(self, item: Node) -> None:
        sens, body = item.children[:-1], item.children[-1]
        edges = [s for s in sens if s.value != "level"]
        if edges and len(edges) != len(sens):
            raise VerilogError(f"line {item.line}: edges and levels in one list")
        clocked: dict = {}
        for s in edges:
            name = self.full(s.children[0].value if s.children[0].kind == "id" else s.children[0].children[0].value)
            if is_reset(name.rsplit(".", 1)[1]) or (clocked.get("clock") and not is_clock(name.rsplit(".", 1)[1])):
                clocked |= {"reset": name, "reset_edge": s.value}
            else:
                clocked |= {"clock": name, "edge": s.value}
        frame = _Frame()
        self.run(body, frame)
        kind = "clockedge" if edges else "combination"
        for held in (frame.now, frame.later):
            for dest, tree in held.items():
                if isinstance(dest, tuple):
                    name, left = dest
                    self.owner.design.binds += [Bind(name, tree, kind, *left[:2], index=left[2], **clocked)]
                elif ".for-loop." not in dest:
                    self.owner.design.binds.append(Bind(dest, tree, kind, **clocked))

    def run(self, s: Node, frame: _Frame) -> None:
        c = s.children
        if s.kind == "block":
            inner = _Scope(self.owner, f"{self.path}.{s.value}", self.routines, {}, self) if s.value else self
            for x in c:
                if x.kind == "decls":
                    inner.declare(x)
                else:
                    inner.run(x, frame)
        elif s.kind in ("blocking", "nonblocking"):
            self.store(s, frame)
        elif s.kind == "if":
            self.branch(self.tree(c[0], frame), c[1], c[2], frame)
        elif s.kind == "case":
            self.case(s.children[0], s.children[1:], frame)
        elif s.kind == "for":
            self.unrolled(s, frame)
        elif s.kind == "while":
            for _ in range(TURNS):
                if not self.number(c[0], frame):
                    return
                self.run(c[1], frame)
            raise VerilogError(f"line {s.line}: a loop that doesn't end")
        elif s.kind == "taskcall" and s.value in self.routines:
            self.task(self.routines[s.value], c, frame)

    def store(self, s: Node, frame: _Frame) -> None:
        value = self.tree(s.children[1], frame)
        held = frame.now if s.kind == "blocking" else frame.later
        for b in self.targets(s.children[0], value):
            whole = b.msb is None and b.index is None
            held[b.dest if whole else (b.dest, (b.msb, b.lsb, b.index))] = value if s.children[0].kind != "concat" else b.tree

    def branch(self, test: Node, yes: Node, no: Node, frame: _Frame) -> None:
        value = evaluate(optimised(test, self.owner.design.params), self.owner.design.params)
        if value is not None:
            return self.run(yes if value else no, frame)
        left, right = frame.copy(), frame.copy()
        self.run(yes, left)
        self.run(no, right)
        for name in ("now", "later"):
            x, y, old = getattr(left, name), getattr(right, name), getattr(frame, name)
            for dest in [*x, *(d for d in y if d not in x)]:
                keep = old.get(dest, Node("id", dest if isinstance(dest, str) else dest[0]))
                a, b = x.get(dest, keep), y.get(dest, keep)
                old[dest] = a if a is b else Node("cond", None, [test, a, b])

    def case(self, subject: Node, arms: list[Node], frame: _Frame) -> None:
        if not arms:
            return
        arm, rest = arms[0], arms[1:]
        labels = arm.children[:-1]
        if not labels:  # the default arm comes last, wherever it stands
            return self.case(subject, [*rest, arm], frame) if rest else self.run(arm.children[-1], frame)
        tests = [Node("op", "Eq", [self.tree(subject, frame), self.tree(x, frame)]) for x in labels]
        test = tests[0]
        for t in tests[1:]:
            test = Node("op", "Lor", [test, t])
        left, right = frame.copy(), frame.copy()
        self.run(arm.children[-1], left)
        self.case(subject, rest, right)
        for name in ("now", "later"):
            x, y, old = getattr(left, name), getattr(right, name), getattr(frame, name)
            for dest in [*x, *(d for d in y if d not in x)]:
                keep = old.get(dest, Node("id", dest if isinstance(dest, str) else dest[0]))
                a, b = x.get(dest, keep), y.get(dest, keep)
                old[dest] = a if a is b else Node("cond", None, [test, a, b])

    def unrolled(self, s: Node, frame: _Frame) -> None:
        first, test, step, body = s.children
        if first.kind != "blocking" or step.kind != "blocking":
            raise VerilogError(f"line {s.line}: a loop variable is set without waiting")
        name = first.children[0].value
        inner = _Scope(self.owner, self.path, self.routines, {name: self.number(first.children[1], frame)}, self)
        for _ in range(TURNS):
            if not inner.number(test, frame):
                return
            inner.run(body, frame)
            inner.values[name] = inner.number(step.children[1], frame)
        raise VerilogError(f"line {s.line}: a loop that doesn't end")

    def task(self, routine: Node, args: list[Node], frame: _Frame) -> None:
        inner = _Scope(self.owner, f"{self.path}.{routine.value}", self.routines, {}, self)
        outs, given = [], iter(args)
        for c in routine.children[1:]:
            for d in c.children if c.kind == "decls" else [c] if c.kind == "decl" else []:
                name = f"{inner.path}.{d.value[2]}"
                self.owner.design.terms.setdefault(name, Term(name, {"task"}))
                if d.value[0] in ("input", "output", "inout"):
                    arg = next(given)
                    if d.value[0] != "output":
                        frame.now[name] = self.tree(arg, frame)
                    if d.value[0] != "input":
                        outs.append((arg, name))
        for c in routine.children[1:]:
            if c.kind not in ("decl", "decls"):
                inner.run(c, frame)
        for arg, name in outs:
            value = frame.now.pop(name, Node("id", name))
            for b in self.targets(arg, value):
                frame.now[b.dest] = value
        for name in [n for n in frame.now if isinstance(n, str) and n.startswith(inner.path + ".")]:
            del frame.now[name]


def elaborate(modules: list[Node], top: str | None = None) -> Design:
    """The design under ``top`` (by default the last module that no other one instantiates)."""
    by_name = {m.value: m for m in modules}
    if top is None:
        used = {i.value for m in modules for i in _instances(m)}
        free = [m.value for m in modules if m.value not in used]
        if not free:
            raise VerilogError("no module is on top")
        top = free[-1]
    e = _Elaborator(by_name)
    e.module(by_name[top], top, {}, None)
    return e.design


def _instances(node: Node):
    if node.kind == "instances":
        yield node
    for c in node.children:
        yield from _instances(c)


def bit_ranges(binds: list[Bind], width: int) -> list[tuple[int, int, Bind | None]]:
    """Who drives which bits of a signal, high to low: later binds win where ranges overlap; None is undefined."""
    owner: list[Bind | None] = [None] * width
    for b in binds:
        high, low = (width - 1, 0) if b.msb is None else (max(b.msb, b.lsb), min(b.msb, b.lsb))
        for k in range(low, min(high, width - 1) + 1):
            owner[k] = b
    out: list[tuple[int, int, Bind | None]] = []
    for k in range(width - 1, -1, -1):
        if out and out[-1][2] is owner[k]:
            out[-1] = (out[-1][0], k, owner[k])
        else:
            out.append((k, k, owner[k]))
    return out


def width_of_literal(text: str) -> int:
    return number(text)[1]
