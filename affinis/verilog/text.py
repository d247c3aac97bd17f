"""Verilog as text: comments, macros, the top module, names and signals by pattern."""

from __future__ import annotations

import re

_COMMENT = re.compile(r'"(?:\\.|[^"\\\n])*"|//(?P<line>[^\n]*)|/\*(?P<block>.*?)(?:\*/|\Z)', re.DOTALL)
# Words that stand where an instance's module could.
KEYWORDS = ["module", "input", "output", "inout", "wire", "reg", "assign", "always", "if", "else", "case", "begin", "end", "for", "while", "function", "task", "initial", "parameter", "localparam", "generate", "endmodule"]


def comments(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, line, column, text) of comments; what stands in a string is none. Lines and columns count from 1."""
    out = []
    for m in _COMMENT.finditer(text):
        kind = m.lastgroup
        if kind:
            before = text[: m.start()]
            out.append((kind, before.count("\n") + 1, m.start() - (before.rfind("\n") + 1) + 1, m.group(kind)))
    return out


def without_comments(text: str) -> str:
    return _COMMENT.sub(lambda m: m.group() if not m.lastgroup else "\n" * m.group().count("\n"), text)


def preprocessed(text: str, defines: dict[str, str] | None = None, files: dict[str, str] | None = None) -> str:
    """`define, `undef, `ifdef, `ifndef, `else, `elsif, `endif and `include done, macros replaced (with arguments)."""
    known: dict[str, tuple[list[str] | None, str]] = {k: (None, v) for k, v in (defines or {}).items()}
    out, active = [], []

    def expand(line: str, depth: int = 0) -> str:
        if depth > 64:
            raise ValueError("a macro that names itself")
        at, parts = 0, []
        for m in re.finditer(r"`(\w+)", line):
            if m.start() < at or m.group(1) not in known:
                continue
            names, body = known[m.group(1)]
            end = m.end()
            if names is not None:
                args, level, end, start = [], 0, line.index("(", end), line.index("(", end) + 1
                for k in range(end, len(line)):
                    level += (line[k] in "([{") - (line[k] in ")]}")
                    if level == 0 or line[k] == "," and level == 1:
                        args.append(line[start:k].strip())
                        start = k + 1
                    if level == 0:
                        end = k + 1
                        break
                for n, a in zip(names, args, strict=False):
                    body = re.sub(rf"\b{re.escape(n)}\b", lambda _, a=a: a, body)
            parts += [line[at : m.start()], expand(body, depth + 1)]
            at = end
        return "".join(parts) + line[at:]

    for line in without_comments(text).replace("\\\n", " ").split("\n"):
        m = re.match(r"\s*`(\w+)\s*(.*)", line)
        word, rest = (m.group(1), m.group(2).strip()) if m else ("", "")
        on = all(a[0] for a in active)
        if word in ("ifdef", "ifndef"):
            hit = (rest in known) == (word == "ifdef")
            active.append([hit, hit])
        elif word == "elsif":
            hit = not active[-1][1] and rest in known
            active[-1] = [hit, active[-1][1] or hit]
        elif word == "else":
            active[-1] = [not active[-1][1], True]
        elif word == "endif":
            active.pop()
        elif not on:
            pass
        elif word == "define":
            d = re.match(r"(\w+)(?:\(([^)]*)\))?\s*(.*)", rest)
            known[d.group(1)] = ([n.strip() for n in d.group(2).split(",")] if d.group(2) is not None else None, d.group(3))
        elif word == "undef":
            known.pop(rest, None)
        elif word == "include":
            out.append(preprocessed((files or {}).get(rest.strip('"<>'), ""), None, files))
        elif word in ("timescale", "default_nettype", "resetall", "celldefine", "endcelldefine"):
            pass
        else:
            out.append(expand(line))
    return "\n".join(out)


def flattened(text: str) -> str:
    """Values of `define and parameter put in place of their names, whole words, longest first; a name that `ifdef asks
    for stays. `ifdef 0 and 1 are resolved."""
    values = dict(re.findall(r"`define\s+(\w+)\s+([^\s/]+)", text))
    values |= dict(re.findall(r"\bparameter\s+(?:\[[^]]*\]\s*)?(\w+)\s*=\s*([^,;\s)]+)", text))
    kept = set(re.findall(r"`ifn?def\s+(\w+)", text)) - {"0", "1"}
    text = re.sub(r"`ifdef\s+([01])\b(.*?)(?:`else\b(.*?))?`endif", lambda m: m.group(2) if m.group(1) == "1" else m.group(3) or "", text, flags=re.DOTALL)
    names = sorted((n for n in values if n not in kept), key=lambda n: (-len(n), n))
    declared = re.compile(r"(`define\s+\w+\s+|\bparameter\s+(?:\[[^]]*\]\s*)?\w+\s*=)")
    for _ in range(8):  # values may name other ones
        before, parts = text, declared.split(text)
        for k in range(0, len(parts), 2):
            for n in names:
                parts[k] = re.sub(rf"`?\b{re.escape(n)}\b", lambda _, n=n: values[n], parts[k])
        text = "".join(parts)
        if text == before:
            break
    return text


def top_module(text: str) -> str | None:
    """Of the modules whose name stands in the text once only, the last declared."""
    clean = without_comments(text)
    names = re.findall(r"\bmodule\s+(\w+)", clean)
    words: dict[str, int] = {}
    for w in re.findall(r"\w+", clean):
        words[w] = words.get(w, 0) + 1
    once = [n for n in names if words[n] == 1]
    return once[-1] if once else None


def with_top(text: str) -> str:
    """The text with its top module renamed to top."""
    name = top_module(text)
    return re.sub(rf"\b{re.escape(name)}\b", "top", text) if name else text


def hierarchy(text: str) -> tuple[str | None, list[tuple[str, str]]]:
    """The first module's name, and its instances (name, module)."""
    clean = without_comments(text)
    first = re.search(r"\bmodule\s+(\w+)", clean)
    found = re.findall(r"^\s*(\w+)\s+(?:#\s*\([^;]*?\)\s*)?(\w+)\s*\(", clean, re.MULTILINE)
    return first.group(1) if first else None, [(i, m) for m, i in found if m.lower() not in KEYWORDS and i.lower() not in KEYWORDS]


def qualified(module: str, signals: list[str], instances: list[tuple[str, str]]) -> list[str]:
    """module.signal, and module.instance.signal where one of the two names holds the other."""
    out = {f"{module}.{s}" for s in signals}
    out |= {f"{module}.{i}.{s}" for s in signals for i, _ in instances if i.lower() in s.lower() or s.lower() in i.lower()}
    return sorted(out)
