"""Lexer, parser and printer of a synthesisable subset of Verilog.

A syntax tree is made of Node(kind, value, children, line). Expressions use the kinds of EXPRESSIONS; statements and
module items the others. Comments and directives that have not been expanded (see text.py) are skipped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

EXPRESSIONS = ["id", "const", "string", "op", "cond", "concat", "repeat", "part", "pointer", "call"]
DECLARATIONS = ["input", "output", "inout", "reg", "wire", "tri", "integer", "real", "parameter", "localparam", "supply0", "supply1", "genvar"]

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|`\w+[^\n]*|\(\*\s*[A-Za-z_][^)]*?\*\))
      |(?P<number>(?:\d[\d_]*)?\s*'[sS]?[bBoOdDhH]\s*[0-9a-fA-FxXzZ?_]+|\d[\d_]*(?:\.\d+)?)
      |(?P<string>"(?:\\.|[^"\\])*")
      |(?P<name>\\[^\s]+|\$?[A-Za-z_][\w$]*)
      |(?P<sign><<<|>>>|===|!==|\*\*|<<|>>|<=|>=|==|!=|&&|\|\||~&|~\||~\^|\^~|\+:|-:|->|[-+*/%&|^~!<>=?:;,.#@(){}\[\]])""",
    re.VERBOSE | re.DOTALL,
)
# Binary operators from the loosest to the tightest.
_LEVELS = [["||"], ["&&"], ["|"], ["^", "~^", "^~"], ["&"], ["==", "!=", "===", "!=="], ["<", "<=", ">", ">="], ["<<", ">>", "<<<", ">>>"], ["+", "-"], ["*", "/", "%"], ["**"]]
_BINARY = {"||": "Lor", "&&": "Land", "|": "Or", "^": "Xor", "~^": "Xnor", "^~": "Xnor", "&": "And", "==": "Eq", "!=": "NotEq", "===": "Eql", "!==": "NotEql", "<": "LessThan", "<=": "LessEq", ">": "GreaterThan", ">=": "GreaterEq", "<<": "Sll", ">>": "Srl", "<<<": "Sll", ">>>": "Sra", "+": "Plus", "-": "Minus", "*": "Times", "/": "Divide", "%": "Mod", "**": "Power"}
_UNARY = {"-": "Uminus", "!": "Ulnot", "~": "Unot", "&": "Uand", "~&": "Unand", "|": "Uor", "~|": "Unor", "^": "Uxor", "~^": "Uxnor", "^~": "Uxnor"}
SIGNS = {v: k for k, v in _BINARY.items()} | {v: k for k, v in _UNARY.items()} | {"Xnor": "~^", "Uxnor": "~^", "Sll": "<<"}


@dataclass
class Node:
    kind: str
    value: object = None
    children: list = field(default_factory=list)
    line: int = 0


class VerilogError(ValueError):
    """A text that the subset has no rule for."""


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(class, text, line) of each token."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise VerilogError(f"line {line}: {text[at:at + 20]!r}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), line))
        line += m.group().count("\n")
        at = m.end()
    return out


def number(text: str) -> tuple[int | None, int]:
    """Value (None with x or z digits) and width in bits of a literal."""
    if "'" not in text:
        return int(float(text.replace("_", ""))), 32
    size, digits = text.split("'")
    digits = digits.lstrip("sS").replace("_", "").strip()
    base = {"b": 2, "o": 8, "d": 10, "h": 16}[digits[0].lower()]
    value = None if re.search("[xXzZ?]", digits[1:]) else int(digits[1:].strip(), base)
    return value, int(size.replace("_", "")) if size.strip() else 32


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text), 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    @property
    def line(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)][2] if self.tokens else 0

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise VerilogError(f"line {self.line}: {want or 'more'} expected, {got or 'the end'} found")
        self.at += 1
        return got

    def accept(self, *some: str) -> str | None:
        return self.take() if self.peek() in some and self.peek() else None

    def listed(self, rule, end: str, sep: str = ",") -> list:
        out = []
        while self.peek() != end:
            out.append(rule())
            if not self.accept(sep):
                break
        self.take(end)
        return out

    # expressions

    def expression(self) -> Node:
        line, test = self.line, self.binary(0)
        if self.accept("?"):
            yes = self.expression()
            self.take(":")
            return Node("cond", None, [test, yes, self.expression()], line)
        return test

    def binary(self, level: int) -> Node:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            line, sign = self.line, self.take()
            left = Node("op", _BINARY[sign], [left, self.binary(level + 1)], line)
        return left

    def unary(self) -> Node:
        line = self.line
        if self.accept("+"):
            return self.unary()
        if self.peek() in _UNARY:
            return Node("op", _UNARY[self.take()], [self.unary()], line)
        return self.primary()

    def primary(self) -> Node:
        line = self.line
        if self.accept("("):
            inner = self.expression()
            self.take(")")
            return inner
        if self.accept("{"):
            first = self.expression()
            if self.accept("{"):
                inner = Node("concat", None, self.listed(self.expression, "}"), line)
                self.take("}")
                return Node("repeat", None, [first, inner], line)
            self.accept(",")
            return Node("concat", None, [first, *self.listed(self.expression, "}")], line)
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else ""
        text = self.take()
        if kind == "number":
            return Node("const", text, [], line)
        if kind == "string":
            return Node("string", text[1:-1], [], line)
        if kind != "name":
            raise VerilogError(f"line {line}: {text!r} begins no expression")
        if self.peek() == "(":
            self.take()
            return Node("call", text, self.listed(self.expression, ")"), line)
        while self.peek() == "." and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "name":
            self.take()
            text += "." + self.take()
        out = Node("id", text, [], line)
        while self.accept("["):
            high = self.expression()
            if self.peek() in (":", "+:", "-:"):
                sign, low = self.take(), self.expression()
                one = Node("const", "1")
                if sign == "+:":
                    high, low = Node("op", "Minus", [Node("op", "Plus", [high, low]), one]), high
                elif sign == "-:":
                    low = Node("op", "Plus", [Node("op", "Minus", [high, low]), one])
                out = Node("part", None, [out, high, low], line)
            else:
                out = Node("pointer", None, [out, high], line)
            self.take("]")
        return out

    # statements

    def statement(self) -> Node:
        line = self.line
        if self.accept(";"):
            return Node("block", "", [], line)
        if self.accept("begin"):
            name = self.take() if self.accept(":") else ""
            body = []
            while not self.accept("end"):
                body.append(self.item() if self.peek() in DECLARATIONS else self.statement())
            return Node("block", name, body, line)
        if self.accept("if"):
            self.take("(")
            test = self.expression()
            self.take(")")
            yes = self.statement()
            return Node("if", None, [test, yes, self.statement() if self.accept("else") else Node("block", "", [])], line)
        if kind := self.accept("case", "casex", "casez"):
            self.take("(")
            out = Node("case", kind, [self.expression()], line)
            self.take(")")
            while not self.accept("endcase"):
                if self.accept("default"):
                    self.accept(":")
                    labels = []
                else:
                    labels = self.listed(self.expression, ":")
                out.children.append(Node("arm", None, [*labels, self.statement()], line))
            return out
        if self.accept("for"):
            self.take("(")
            first = self.assignment()
            self.take(";")
            test = self.expression()
            self.take(";")
            step = self.assignment()
            self.take(")")
            return Node("for", None, [first, test, step, self.statement()], line)
        if self.accept("while"):
            self.take("(")
            test = self.expression()
            self.take(")")
            return Node("while", None, [test, self.statement()], line)
        if self.accept("#"):
            self.primary()
            return self.statement()
        if self.accept("@"):
            self.sensitivity()
            return self.statement()
        if self.peek().startswith("$") or self.peek(1) in (";", "("):
            name = self.take()
            args = self.listed(self.expression, ")") if self.accept("(") else []
            self.take(";")
            return Node("syscall" if name.startswith("$") else "taskcall", name, args, line)
        out = self.assignment()
        self.take(";")
        return out

    def assignment(self) -> Node:
        line, left = self.line, self.primary()
        sign = self.take()
        if sign not in ("=", "<="):
            raise VerilogError(f"line {line}: {sign!r} in an assignment")
        if self.accept("#"):
            self.primary()
        return Node("blocking" if sign == "=" else "nonblocking", None, [left, self.expression()], line)

    def sensitivity(self) -> list[Node]:
        if self.accept("*"):
            return []
        self.take("(")
        if self.accept("*"):
            self.take(")")
            return []
        out = []
        while not self.accept(")"):
            edge = self.accept("posedge", "negedge") or "level"
            out.append(Node("sens", edge, [self.expression()], self.line))
            self.accept(",", "or")
        return out

    # items

    def width(self) -> list[Node]:
        if not self.accept("["):
            return []
        high = self.expression()
        self.take(":")
        low = self.expression()
        self.take("]")
        return [high, low]

    def declaration(self, end: tuple[str, ...] = (";",)) -> list[Node]:
        line, kind = self.line, self.take()
        also = self.accept("reg", "wire", "tri", "integer", "logic")
        self.accept("signed")
        span, out = self.width(), []
        while True:
            name = self.take()
            memory = self.width()
            init = [self.expression()] if self.accept("=") else []
            out.append(Node("decl", (kind, also, name, bool(memory), bool(span), bool(init)), [*span, *init], line))
            if self.peek() in end:
                return out
            if self.peek() == "," and self.peek(1) in (*DECLARATIONS, "."):
                return out
            self.take(",")

    def item(self) -> Node:
        line, word = self.line, self.peek()
        if word in DECLARATIONS:
            out = Node("decls", None, self.declaration(), line)
            self.take(";")
            return out
        if self.accept("assign"):
            if self.accept("#"):
                self.primary()
            out = Node("assigns", None, [], line)
            while True:
                left = self.primary()
                self.take("=")
                out.children.append(Node("assign", None, [left, self.expression()], line))
                if not self.accept(","):
                    break
            self.take(";")
            return out
        if self.accept("always", "always_ff", "always_comb"):
            sens = self.sensitivity() if self.accept("@") else []
            return Node("always", None, [*sens, self.statement()], line)
        if self.accept("initial"):
            return Node("initial", None, [self.statement()], line)
        if self.accept("generate"):
            out = Node("generate", None, [], line)
            while not self.accept("endgenerate"):
                out.children.append(self.generated())
            return out
        if kind := self.accept("function", "task"):
            self.accept("automatic")
            self.accept("signed", "integer")
            span = self.width()
            name, body = self.take(), []
            if self.accept("("):
                while not self.accept(")"):
                    body += self.declaration((")",))
                    self.accept(",")
            self.take(";")
            while not self.accept("end" + kind):
                body.append(self.item() if self.peek() in DECLARATIONS else self.statement())
            return Node(kind, name, [Node("span", None, span), *body], line)
        if word in ("for", "if", "begin"):
            return self.generated()
        if word == "defparam":
            while self.take() != ";":
                pass
            return Node("block", "", [], line)
        return self.instances()

    def generated(self) -> Node:
        line = self.line
        if self.accept("begin"):
            name = self.take() if self.accept(":") else ""
            out = Node("scope", name, [], line)
            while not self.accept("end"):
                out.children.append(self.generated())
            return out
        if self.accept("for"):
            self.take("(")
            self.accept("genvar")
            first = self.assignment()
            self.take(";")
            test = self.expression()
            self.take(";")
            step = self.assignment()
            self.take(")")
            return Node("genfor", None, [first, test, step, self.generated()], line)
        if self.accept("if"):
            self.take("(")
            test = self.expression()
            self.take(")")
            yes = self.generated()
            return Node("genif", None, [test, yes, self.generated() if self.accept("else") else Node("scope", "", [])], line)
        return self.item()

    def connections(self) -> list[Node]:
        def one() -> Node:
            if self.accept("."):
                name = self.take()
                self.take("(")
                inner = [] if self.peek() == ")" else [self.expression()]
                self.take(")")
                return Node("named", name, inner, self.line)
            return Node("named", None, [self.expression()], self.line)

        return self.listed(one, ")")

    def instances(self) -> Node:
        line, module = self.line, self.take()
        params = []
        if self.accept("#"):
            self.take("(")
            params = self.connections()
        out = Node("instances", module, [Node("params", None, params)], line)
        while True:
            name = "" if self.peek() == "(" else self.take()
            span = self.width()
            self.take("(")
            out.children.append(Node("instance", name, [Node("span", None, span), *self.connections()], line))
            if not self.accept(","):
                break
        self.take(";")
        return out

    def module(self) -> Node:
        line = self.line
        self.take("module")
        out = Node("module", self.take(), [], line)
        out.children.append(Node("ports", [], []))
        if self.accept("#"):
            self.take("(")
            while not self.accept(")"):
                if self.peek() != "parameter":
                    self.tokens.insert(self.at, ("name", "parameter", self.line))
                out.children.append(Node("decls", None, self.declaration((")",)), line))
                self.accept(",")
        if self.accept("("):
            while not self.accept(")"):
                if self.peek() in DECLARATIONS:
                    decls = self.declaration((")",))
                    out.children.append(Node("decls", None, decls, line))
                    out.children[0].value += [d.value[2] for d in decls]
                else:
                    out.children[0].value.append(self.take())
                self.accept(",")
        self.take(";")
        while not self.accept("endmodule"):
            out.children.append(self.item())
        return out


def parse(text: str) -> list[Node]:
    """The modules of a text."""
    p, out = _Parser(text), []
    while p.at < len(p.tokens):
        out.append(p.module())
    return out


def parse_expression(text: str) -> Node:
    return _Parser(text).expression()


def flat(root: Node) -> list[tuple[int, int | None, int, str, str | None, int]]:
    """(id, parent, slot, kind, value, line) of a tree in preorder."""
    out, todo = [], [(root, None, 0)]
    while todo:
        node, parent, slot = todo.pop()
        n = len(out)
        value = node.value if node.value is None or isinstance(node.value, str) else " ".join(str(v) for v in node.value if v not in (None, True, False))
        out.append((n, parent, slot, node.kind, value, node.line))
        todo += [(c, n, k) for k, c in reversed(list(enumerate(node.children)))]
    return out


def written(e: Node) -> str:
    """An expression as Verilog text, fully parenthesised."""
    parts = [written(c) for c in e.children]
    if e.kind in ("id", "const"):
        return str(e.value)
    if e.kind == "string":
        return f'"{e.value}"'
    if e.kind == "op":
        return f"({SIGNS[e.value]}{parts[0]})" if len(parts) == 1 else f"({parts[0]} {SIGNS[e.value]} {parts[1]})"
    if e.kind == "cond":
        return f"({parts[0]} ? {parts[1]} : {parts[2]})"
    if e.kind == "concat":
        return "{" + ", ".join(parts) + "}"
    if e.kind == "repeat":
        return "{" + parts[0] + parts[1] + "}"
    if e.kind == "part":
        return f"{parts[0]}[{parts[1]}:{parts[2]}]"
    if e.kind == "pointer":
        return f"{parts[0]}[{parts[1]}]"
    return f"{e.value}({', '.join(parts)})"


def written_statement(s: Node, indent: int = 0) -> str:
    """A statement or module item as Verilog text."""
    pad, inner = "  " * indent, lambda c, k=1: written_statement(c, indent + k)
    c = s.children
    if s.kind in ("blocking", "nonblocking", "assign"):
        sign = "<=" if s.kind == "nonblocking" else "="
        return f"{pad}{'assign ' if s.kind == 'assign' else ''}{written(c[0])} {sign} {written(c[1])};"
    if s.kind in ("assigns", "decls", "generate", "instances"):
        if s.kind == "decls":
            return "\n".join(pad + _declared(d) + ";" for d in c)
        if s.kind == "instances":
            params = f" #({', '.join(_connected(p) for p in c[0].children)})" if c[0].children else ""
            return "\n".join(f"{pad}{s.value}{params} {i.value} ({', '.join(_connected(p) for p in i.children[1:])});" for i in c[1:])
        body = "\n".join(inner(x, 1 if s.kind == "generate" else 0) for x in c)
        return f"{pad}generate\n{body}\n{pad}endgenerate" if s.kind == "generate" else body
    if s.kind in ("block", "scope"):
        label = f" : {s.value}" if s.value else ""
        return "\n".join([f"{pad}begin{label}", *(inner(x) for x in c), f"{pad}end"])
    if s.kind in ("if", "genif"):
        return f"{pad}if ({written(c[0])})\n{inner(c[1])}\n{pad}else\n{inner(c[2])}"
    if s.kind == "case":
        arms = [f"{pad}  {', '.join(written(x) for x in a.children[:-1]) or 'default'}:\n{inner(a.children[-1], 2)}" for a in c[1:]]
        return "\n".join([f"{pad}{s.value} ({written(c[0])})", *arms, f"{pad}endcase"])
    if s.kind in ("for", "genfor"):
        first, step = (written_statement(x).rstrip(";") for x in (c[0], c[2]))
        return f"{pad}for ({first}; {written(c[1])}; {step})\n{inner(c[3])}"
    if s.kind == "while":
        return f"{pad}while ({written(c[0])})\n{inner(c[1])}"
    if s.kind == "always":
        sens = " or ".join((x.value + " " if x.value != "level" else "") + written(x.children[0]) for x in c[:-1]) or "*"
        return f"{pad}always @({sens})\n{inner(c[-1])}"
    if s.kind == "initial":
        return f"{pad}initial\n{inner(c[0])}"
    if s.kind in ("syscall", "taskcall"):
        return f"{pad}{s.value}({', '.join(map(written, c))});"
    if s.kind in ("function", "task"):
        span = f"[{written(c[0].children[0])}:{written(c[0].children[1])}] " if c[0].children else ""
        body = "\n".join(pad + "  " + _declared(x) + ";" if x.kind == "decl" else inner(x) for x in c[1:])
        return f"{pad}{s.kind} {span}{s.value};\n{body}\n{pad}end{s.kind}"
    raise VerilogError(f"no text for {s.kind}")


def _declared(d: Node) -> str:
    kind, also, name, _, spanned, valued = d.value
    span = f" [{written(d.children[0])}:{written(d.children[1])}]" if spanned else ""
    return f"{kind}{' ' + also if also else ''}{span} {name}{' = ' + written(d.children[-1]) if valued else ''}"


def _connected(p: Node) -> str:
    inner = written(p.children[0]) if p.children else ""
    return f".{p.value}({inner})" if p.value else inner


def written_module(m: Node) -> str:
    """A module as Verilog text; parse() of it gives the same tree but for lines."""
    return "\n".join([f"module {m.value} ({', '.join(m.children[0].value)});", *(written_statement(i, 1) for i in m.children[1:]), "endmodule"])
