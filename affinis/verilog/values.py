"""Values of expression trees: every operator on bit vectors, constant folding and small algebraic rules."""

from __future__ import annotations

from affinis.verilog.syntax import Node, number


def constant(value: int, width: int = 32) -> Node:
    return Node("const", str(value) if width == 32 else f"{width}'d{value & ((1 << width) - 1)}")


def apply(op: str, x: list[int], width: int = 32) -> int | None:
    """One operator on numbers; None where Verilog gives x. ``width`` masks the complements and reductions."""
    full = (1 << width) - 1
    a, b = x[0], x[1] if len(x) > 1 else 0
    ones = bin(a & full).count("1")
    one_operand = {"Uminus": -a, "Ulnot": int(not a), "Unot": ~a & full, "Uand": int(a & full == full), "Unand": int(a & full != full), "Uor": int(a & full != 0), "Unor": int(a & full == 0), "Uxor": ones % 2, "Uxnor": 1 - ones % 2}
    if op in one_operand:
        return one_operand[op]
    if op in ("Divide", "Mod"):
        if b == 0:
            return None
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return q if op == "Divide" else a - q * b
    if op == "Power":
        return a**b if b >= 0 else (None if a == 0 else int(a**b))
    if op in ("Sll", "Srl", "Sra"):
        if b < 0 or b > 4096:
            return 0
        return {"Sll": a << b, "Srl": (a & full if a < 0 else a) >> b, "Sra": a >> b}[op]
    return {"Times": a * b, "Plus": a + b, "Minus": a - b, "LessThan": int(a < b), "GreaterThan": int(a > b), "LessEq": int(a <= b), "GreaterEq": int(a >= b), "Eq": int(a == b), "NotEq": int(a != b), "Eql": int(a == b), "NotEql": int(a != b), "And": a & b, "Xor": a ^ b, "Xnor": ~(a ^ b) & full, "Or": a | b, "Land": int(bool(a) and bool(b)), "Lor": int(bool(a) or bool(b))}[op]


def width(e: Node, widths: dict[str, int] | None = None) -> int:
    """Bits of an expression: of its widest operand, 1 of a test, the sum of a concatenation."""
    c = e.children
    if e.kind == "const":
        return number(e.value)[1]
    if e.kind == "id":
        return (widths or {}).get(e.value, 32)
    if e.kind == "concat":
        return sum(width(x, widths) for x in c)
    if e.kind == "repeat":
        return (evaluate(c[0]) or 1) * width(c[1], widths)
    if e.kind == "part":
        high, low = evaluate(c[1]), evaluate(c[2])
        return 32 if high is None or low is None else abs(high - low) + 1
    if e.kind == "pointer":
        return 1
    if e.kind == "cond":
        return max(width(c[1], widths), width(c[2], widths))
    if e.kind == "op":
        if e.value in ("Ulnot", "Uand", "Unand", "Uor", "Unor", "Uxor", "Uxnor", "LessThan", "GreaterThan", "LessEq", "GreaterEq", "Eq", "NotEq", "Eql", "NotEql", "Land", "Lor"):
            return 1
        return width(c[0], widths) if e.value in ("Sll", "Srl", "Sra", "Power") else max(width(x, widths) for x in c)
    return 32


def evaluate(e: Node, known: dict[str, int] | None = None, widths: dict[str, int] | None = None) -> int | None:
    """The number that a tree stands for, if it is constant."""
    if e.kind == "const":
        return number(e.value)[0]
    if e.kind == "id":
        return (known or {}).get(e.value)
    if e.kind in ("string", "call"):
        return None
    x = [evaluate(c, known, widths) for c in e.children]
    if e.kind == "cond":
        return None if x[0] is None else x[1] if x[0] else x[2]
    if any(v is None for v in x):
        return None
    if e.kind == "op":
        return apply(e.value, x, width(e.children[0], widths))
    if e.kind == "concat":
        out = 0
        for c, v in zip(e.children, x, strict=True):
            n = width(c, widths)
            out = out << n | v & ((1 << n) - 1)
        return out
    if e.kind == "repeat":
        n, out = width(e.children[1], widths), 0
        for _ in range(x[0]):
            out = out << n | x[1]
        return out
    if e.kind == "part":
        return x[0] >> min(x[1:]) & ((1 << abs(x[1] - x[2]) + 1) - 1)
    return x[0] >> x[1] & 1


def optimised(e: Node, known: dict[str, int] | None = None, widths: dict[str, int] | None = None) -> Node:
    """Constants folded; neutral and absorbing operands, equal branches, double negations and nested parts removed."""
    c = [optimised(x, known, widths) for x in e.children]
    out = Node(e.kind, e.value, c, e.line)
    if e.kind in ("const", "string"):
        return out
    value = evaluate(out, known, widths)
    if value is not None:
        n = width(out, widths)
        return constant(value, n) if value >= 0 else constant(value)
    if e.kind == "cond":
        test = evaluate(c[0], known, widths)
        if test is not None:
            return c[1] if test else c[2]
        return c[1] if same(c[1], c[2]) else out
    if e.kind == "op" and len(c) == 2:
        x, y = (evaluate(v, known, widths) for v in c)
        if e.value in ("Plus", "Or", "Xor") and x == 0 or e.value == "Times" and x == 1 or e.value == "Land" and x not in (None, 0) and width(c[1], widths) == 1 or e.value == "Lor" and x == 0 and width(c[1], widths) == 1:
            return c[1]
        if e.value in ("Plus", "Minus", "Or", "Xor", "Sll", "Srl", "Sra") and y == 0 or e.value in ("Times", "Divide", "Power") and y == 1 or e.value == "Land" and y not in (None, 0) and width(c[0], widths) == 1 or e.value == "Lor" and y == 0 and width(c[0], widths) == 1:
            return c[0]
        if e.value in ("Times", "And", "Land") and 0 in (x, y):
            return constant(0, width(out, widths))
        if e.value == "Lor" and (x not in (None, 0) or y not in (None, 0)):
            return constant(1, 1)
        if e.value in ("And", "Or", "Land", "Lor") and same(*c):
            return c[0]
    if e.kind == "op" and e.value in ("Ulnot", "Unot") and c[0].kind == "op" and c[0].value == e.value and (e.value == "Unot" or width(c[0].children[0], widths) == 1):
        return c[0].children[0]
    if e.kind == "part" and c[0].kind == "part":
        bounds = [evaluate(v, known, widths) for v in (*c[1:], *c[0].children[1:])]
        if None not in bounds:
            base = min(bounds[2:])
            return Node("part", None, [c[0].children[0], constant(bounds[0] + base), constant(bounds[1] + base)], e.line)
    if e.kind == "concat" and len(c) == 1:
        return c[0]
    return out


def same(a: Node, b: Node) -> bool:
    return a.kind == b.kind and a.value == b.value and len(a.children) == len(b.children) and all(same(x, y) for x, y in zip(a.children, b.children, strict=True))
