"""Personal data in texts: validated base patterns, and candidates selected by boosted trees. DataFrame functions only.

High-recall generators, several a kind, propose spans that may overlap each other. Boosted trees score each by format
and context features; a threshold calibrated to a precision selects, and of selected candidates of a kind that overlap
the best stays. The trees are fitted on the driver, once, on labelled candidates that a seeded rule writes (the tables
have no labels for personal data) and calibrated on candidates of other shapes; they run as Column expressions.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: Kinds that only the method finds, behind the others.
MORE_KINDS = ["secret", "account"]

# Base patterns. Each begins where a run of its first characters begins, or where the match before ended (\G), and takes
# that run whole: starts further inside the run would find the same or nothing, so long runs cost no square time.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

_SPAN = "s:int,e:int,m:string,near:string"
_EMPTY = f"array<struct<{_SPAN}>>"
#: Matches that are placed at once; see _matches.
_CHUNK = 256
#: Code points before a candidate that are its context.
NEAR = 28


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, m, near): code points, end exclusive, and what stands before. What
    stands between two matches comes from a split by the same pattern, so the places are sums of lengths. They are
    summed up in chunks and then over chunks, so that a text with very many matches doesn't copy them all for each."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("n"), m.alias("m"), F.right(p, F.lit(NEAR)).alias("near")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("out"))

    def placed(s: Column, x: Column, e: Column) -> Column:
        return F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), x["near"].alias("near"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["n"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(placed(s, x, e))).alias("out"))

    def joined(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: placed(x["s"] + acc["at"], x, x["e"] + acc["at"]))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    starts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(_CHUNK))
    chunks = F.transform(starts, lambda k: F.aggregate(F.slice(pairs, k, F.lit(_CHUNK)), empty, step))
    return F.aggregate(chunks, empty, joined, lambda acc: acc["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(k % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The valid base spans of a kind; failing matches are dropped without a retry."""
    need = _NEEDS[kind]
    has = text.contains(need) if need else text.rlike("[0-9][ -]?[0-9]")
    return F.when(has, F.filter(_matches(text, _BASE[kind]), lambda x: _valid(kind, x["m"]))).otherwise(F.array().cast(_EMPTY))


# --- candidates ------------------------------------------------------------------------------------------------

# Generators: per kind, wide patterns, and for each one of some strings and a pattern that a text must hold for it to be
# tried (DIGITS: two digits side by side, tested once for all). Their matches may overlap.
DIGITS = ["00-99"]
WORDS = [w for x in ("token", "secret", "passw", "key") for w in (x, x.capitalize(), x.upper())]
_DOT = r"(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}|\[\.\]) ?| dot )"
_WIDE = {
    "email": [
        (r"[A-Za-z0-9._%+-]{2,64} ?(?:\(at\)|\[at\]|\{at\}|\[@\]) ?[A-Za-z0-9-]{1,64}(?:" + _DOT + r"[A-Za-z0-9-]{2,64}){1,6}", ["(at)", "[at]", "{at}", "[@]", "(AT)", "[AT]"], None),
        (r"[A-Za-z0-9._%+-]{2,64} at [A-Za-z0-9-]{1,64}(?: dot [A-Za-z0-9-]{2,64}){1,6}", [" dot "], None),
        (r"[A-Za-z0-9._%+-]{2,64} @ ?[A-Za-z0-9-]{1,64}(?:\.[A-Za-z0-9-]{2,64}){1,6}", [" @"], None),
    ],
    "ip": [
        (r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Fa-f:])", [":"], "[0-9A-Fa-f]:[0-9A-Fa-f:]"),
        (r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)) ?[0-9]{1,3}){3}(?![0-9])", ["[.]", "(.)", "[dot]", "(dot)"], None),
    ],
    "card": [
        (r"(?<![0-9])[0-9]{4}(?:[._/] ?[0-9]{4}){2}[._/] ?[0-9]{1,7}(?![0-9])", DIGITS, r"[0-9]{4}[._/] ?[0-9]{4}"),
        (r"(?<![0-9])[0-9]{4}(?: {2,3}[0-9]{4}){3}(?![0-9])", DIGITS, "[0-9]{4} {2,3}[0-9]{4}"),
    ],
    "phone": [
        (r"(?<![0-9.+-])\(?0?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}(?![0-9])", DIGITS, r"[0-9]\)?[ ./-]{1,2}[0-9]{3}[ ./-][0-9]{4}"),
        (r"(?<![0-9.+-])0[0-9]{1,4}(?:[ ./-]{1,2}[0-9]{2,4}){2,5}(?![0-9])", DIGITS, r"(?<![0-9])0[0-9]{1,4}[ ./-]{1,2}[0-9]{2}"),
        (r"(?<![0-9.+-])00[1-9][0-9]{0,2}(?:[ ./()-]{1,3}[0-9]{2,5}){2,5}(?![0-9])", DIGITS, "(?<![0-9])00[1-9]"),
        (r"(?<![0-9A-Za-z.+-])[0-9]{9,13}(?![0-9A-Za-z])", DIGITS, "[0-9]{9}"),
    ],
    "secret": [
        (r"(?i)(?<=(?:token|secret|passwd|password|api_key|apikey|api-key|access_key|key)[\"']? ?[=:] ?[\"'])[^\s\"']{6,200}", WORDS, r"(?i)(?:token|secret|passw|key)\w{0,4}[\"']? ?[=:] ?[\"']"),
        (r"(?i)(?<=(?:token|secret|passwd|password|api_key|apikey|api-key|access_key|key) ?[=:] ?)[^\s\"',;]{6,200}", WORDS, r"(?i)(?:token|secret|passw|key)\w{0,4} ?[=:] ?[^\s\"']"),
        (r"(?<![0-9A-Za-z+/=_-])(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|pk_|glpat-|AIza)[0-9A-Za-z_-]{12,120}", ["AKIA", "ASIA", "ghp_", "gho_", "xox", "sk-", "pk_", "glpat-", "AIza"], None),
        (r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])", DIGITS, "[0-9a-f]{32}"),
        (r"(?<![0-9A-Za-z+/=_.-])eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", ["eyJ"], None),
    ],
    "account": [
        (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", DIGITS, "[A-Z]{2}[0-9]{2} ?[0-9A-Z]{4}"),
        (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", DIGITS, "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ],
}
_CONTEXT = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|reach|courriel|schreib|correo)[^\n]{0,16}$",
    "ip": r"(?i)(?:ip|address|host|server|from|peer|adresse|direcci)[^\n]{0,16}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta|pay)[^\n]{0,16}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|contact|ring|whatsapp|telefon|téléphone|appel|anruf|llama)[^\n]{0,16}$",
    "secret": r"(?i)(?:token|secret|passw\w*|key|bearer|credential|auth)[^\n]{0,12}$",
    "account": r"(?i)(?:iban|account|konto|compte|cuenta|ssn|social|bank)[^\n]{0,16}$",
}
_ORDER = [*KINDS, *MORE_KINDS]
_DATE = r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2})$"
_SHIELD = r"(?i)\(at\)|\[at\]|\{at\}|\(dot\)|\[dot\]|\[\.\]| at .* dot "
_PREFIX = "^(?:AKIA|ASIA|ghp_|gho_|xox|sk-|pk_|glpat-|AIza|eyJ)"
FEATURES = ["kind", "n_digits", "n_parts", "parens", "one_separator", "date_like", "context", "shielded", "longest", "shortest", "length", "variety", "mixed", "hexadecimal", "luhn", "prefix", "quoted"]


def _features(kind: str, m: Column, near: Column) -> list[Column]:
    parts = F.filter(F.split(m, "[^0-9]+"), lambda p: p != "")
    lengths = F.transform(parts, F.length)
    digits = _digits(m)
    return [
        F.lit(_ORDER.index(kind)),
        F.length(digits),
        F.size(parts),
        m.rlike(r"\([0-9]+\)").cast("int"),
        (F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(m, "[0-9A-Za-z]", ""), ""), lambda c: c != ""))) == 1).cast("int"),
        m.rlike(_DATE).cast("int"),
        near.rlike(_CONTEXT[kind]).cast("int"),
        m.rlike(_SHIELD).cast("int"),
        F.coalesce(F.array_max(lengths), F.lit(0)),
        F.coalesce(F.array_min(lengths), F.lit(0)),
        F.length(m),
        F.size(F.array_distinct(F.filter(F.split(m, ""), lambda c: c != ""))),
        (m.rlike("[A-Za-z]") & m.rlike("[0-9]")).cast("int"),
        m.rlike("^[0-9a-f]+$").cast("int"),
        F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False)).cast("int"),
        m.rlike(_PREFIX).cast("int"),
        near.rlike("[\"'=:] ?$").cast("int"),
    ]


def _features_of(kind: str, m: str, near: str) -> list[float]:
    """The same features of a text in Python, for fitting."""
    parts = re.findall("[0-9]+", m)
    lengths, digits = [len(p) for p in parts], "".join(parts)
    marks = set(re.sub("[0-9A-Za-z]", "", m))
    found = [re.search(p, x) for p, x in ((r"\([0-9]+\)", m), (_DATE, m), (_CONTEXT[kind], near), (_SHIELD, m), ("^[0-9a-f]+$", m), (_PREFIX, m), ("[\"'=:] ?$", near))]
    paren, date, context, shield, hexa, prefix, quoted = map(bool, found)
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    luhn = 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    mixed = bool(re.search("[A-Za-z]", m) and parts)
    return [_ORDER.index(kind), len(digits), len(parts), paren, len(marks) == 1, date, context, shield, max(lengths, default=0), min(lengths, default=0), len(m), len(set(m)), mixed, hexa, luhn, prefix, quoted]


def _labelled(n: int, seed: int, held: bool) -> tuple[np.ndarray, np.ndarray]:
    """Candidates as a rule writes them: personal ones (1) and look-alikes such as dates, sums, versions, names of files,
    checksums (0). ``held`` ones have other separators, lengths and words than those that are fitted."""
    r = random.Random(seed)

    def some(k: int, of: str = "0123456789") -> str:
        return "".join(r.choice(of) for _ in range(k))

    def card(sep: str) -> str:
        body = "4" + some(14)
        last = next(c for c in "0123456789" if sum(int(x) * 2 - 9 if k % 2 and int(x) > 4 else int(x) * (1 + k % 2) for k, x in enumerate(reversed(body + c))) % 10 == 0)
        return sep.join((body + last)[k : k + 4] for k in range(0, 16, 4))

    hexa, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    x, y = [], []
    for _ in range(n):
        sep = r.choice(["/", ". "][:1] if held else [" ", "-", "."])
        told = {k: r.choice(v[1::2] if held else v[::2]) for k, v in {"phone": ["call ", "tel: ", "phone ", "mobile no ", "fax ", "contact me: "], "secret": ['token = "', 'api_key: "', 'password = "', "secret=", "bearer ", "key: "], "ip": ["from ", "server ", "host ", "address: "], "card": ["visa ", "card no ", "credit card: ", "pay with "], "account": ["IBAN ", "account ", "SSN: ", "bank "], "email": ["mail ", "contact ", "write to ", "e-mail: "]}.items()}
        plain = r.choice(["sur ", "für ", "page ", "build "] if held else ["the ", "in ", "on ", "of ", "version ", "order ", ""])
        dot = r.choice([" (dot) ", "[dot]", "."]) if held else r.choice([" dot ", "(dot)", "."])
        good = [
            ("phone", f"({some(3)}) {some(3)}-{some(4)}", r.choice([told["phone"], plain])),
            ("phone", sep.join([some(3), some(3), some(4)]), told["phone"]),
            ("phone", sep.join(["0" + some(r.choice([2, 3])), some(3), some(4)]), told["phone"]),
            ("phone", sep.join(["0" + some(1), *[some(2) for _ in range(4)]]), told["phone"]),
            ("phone", some(r.choice([10, 11])), told["phone"]),
            ("email", f"{some(6, letters)} (at) mail{some(1)}{dot}example", r.choice([told["email"], plain])),
            ("email", f"{some(8, letters)}[at]example.org", r.choice([told["email"], plain])),
            ("email", f"{some(7, letters)} at example{dot if 'dot' in dot else ' dot '}org", r.choice([told["email"], plain])),
            ("ip", ":".join(some(r.randrange(1, 5), hexa) for _ in range(8)), r.choice([told["ip"], plain])),
            ("ip", "[.]".join(str(r.randrange(256)) for _ in range(4)), r.choice([told["ip"], plain])),
            ("card", card(r.choice("./_")), r.choice([told["card"], plain])),
            ("secret", some(40, hexa), told["secret"]),
            ("secret", some(r.randrange(16, 44), letters), told["secret"]),
            ("secret", r.choice(["AKIA", "ghp_", "sk-"]) + some(r.randrange(16, 40), letters), r.choice([told["secret"], plain])),
            ("account", r.choice(["DE", "FR", "ES"]) + some(2) + "".join(" " + some(4) for _ in range(r.choice([4, 5]))), r.choice([told["account"], plain])),
            ("account", f"{some(3)}-{some(2)}-{some(4)}", told["account"]),
        ]
        bad = [
            ("phone", f"20{some(2)}{sep}{r.randrange(10, 13)}{sep}{r.randrange(10, 29)}", r.choice([plain, told["phone"]])),
            ("phone", sep.join([some(3), some(3), some(4)]), plain),
            ("phone", "0" + some(1) + "".join(sep + some(r.choice([2, 3])) for _ in range(r.randrange(2, 5))), plain),
            ("phone", some(r.choice([9, 10, 12, 13])), plain),
            ("email", f"meet @ place.{some(3, letters)}", plain),
            ("email", "stayed at home dot com", plain) if not held else ("email", "look at this dot thing", plain),
            ("ip", ":".join(some(2) for _ in range(3)), r.choice([plain, told["ip"]])),
            ("ip", "[.]".join(str(r.randrange(256, 999)) for _ in range(4)), plain),
            ("card", sep.join(some(4) for _ in range(4)) if sep in "./_" else ".".join(some(4) for _ in range(4)), plain),
            ("secret", some(r.choice([32, 40, 64]), hexa), plain),
            ("secret", r.choice(["required", "missing", "default", "changed", "expired", "undefined"]), told["secret"]),
            ("account", "ISO" + some(4), plain),
            ("account", f"{some(3)}-{some(2)}-{some(4)}", plain),
        ]
        for label, (kind, m, near) in ((1, r.choice(good)), (0, r.choice(bad))):
            x.append(_features_of(kind, m, near))
            y.append(label)
    return np.array(x, float), np.array(y, float)


def _tree(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int):
    """A regression tree: a leaf's value (one Newton step), or (feature, cut, left, right)."""
    leaf = float(residual.sum() / max(weight.sum(), 1e-6))
    if depth == 0 or len(x) < 20:
        return leaf
    best, choice = residual.sum() ** 2 / (weight.sum() + 1.0) + 1e-6, None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            gain = sum(residual[s].sum() ** 2 / (weight[s].sum() + 1.0) for s in (left, ~left))
            if gain > best:
                best, choice = gain, (f, float(cut), left)
    if choice is None:
        return leaf
    f, cut, left = choice
    return f, cut, _tree(x[left], residual[left], weight[left], depth - 1), _tree(x[~left], residual[~left], weight[~left], depth - 1)


def _tree_value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, a, b = tree
    return np.where(x[:, f] <= cut, _tree_value(a, x), _tree_value(b, x))


@cache
def boosted_trees(rounds: int = 16, depth: int = 3, rate: float = 0.4, precision: float = 0.97, seed: int = 5) -> tuple[list, float]:
    """Trees for the log odds, and the lowest threshold from which on candidates of other shapes reach the precision."""
    x, y = _labelled(3000, seed, False)
    score, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, y - p, p * (1 - p), depth)
        trees.append(tree)
        score += rate * _tree_value(tree, x)
    apart, label = _labelled(3000, seed + 1, True)
    held = sum(rate * _tree_value(t, apart) for t in trees)
    order = np.argsort(-held, kind="stable")
    right = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
    last = np.append(held[order][1:] < held[order][:-1], True)  # candidates of one score stand or fall together
    good = held[order][last & (right >= precision)]
    return [(rate, t) for t in trees], float(good.min()) if len(good) else float("inf")


def _tree_column(tree, x: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, a, b = tree
    return F.when(x[f] <= cut, _tree_column(a, x)).otherwise(_tree_column(b, x))


def _overlap(x: Column, y: Column) -> Column:
    return (x["s"] < y["e"]) & (y["s"] < x["e"])


def _tried(text: Column, digits: Column, some: list[str], pattern: str | None) -> Column:
    out = digits
    if some is not DIGITS:
        out = text.contains(some[0])
        for s in some[1:]:
            out = out | text.contains(s)
    return out & text.rlike(pattern) if pattern else out


def selected(text: Column, kind: str, base: Column, digits: Column) -> Column:
    """Candidates of a kind, with scores, that the trees select and that overlap no base span of any kind."""
    trees, threshold = boosted_trees()
    names = [f"f{k}" for k in range(len(FEATURES))]
    none = F.array().cast(_EMPTY)
    wide = F.concat(*[F.when(_tried(text, digits, some, need), _matches(text, pattern)).otherwise(none) for pattern, some, need in _WIDE[kind]])

    def described(c: Column) -> Column:
        values = [v.cast("double").alias(n) for n, v in zip(names, _features(kind, c["m"], c["near"]), strict=True)]
        return F.struct(c.alias("c"), *values)

    def scored(d: Column) -> Column:
        score = F.lit(0.0)
        for rate, tree in trees:
            score = score + rate * _tree_column(tree, [d[n] for n in names])
        return F.struct(d["c"]["s"].alias("s"), d["c"]["e"].alias("e"), d["c"]["m"].alias("m"), d["c"]["near"].alias("near"), score.alias("score"))

    free = F.filter(F.array_distinct(wide), lambda c: ~F.exists(base, lambda b: _overlap(b, c)))
    kept = F.filter(F.transform(F.transform(free, described), scored), lambda x: x["score"] >= threshold)
    return kept


def best_of(kept: Column) -> Column:
    """Of candidates that overlap, the best: by score, then length, then start."""

    def better(y: Column, x: Column) -> Column:
        n, m = y["e"] - y["s"], x["e"] - x["s"]
        return (y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((n > m) | ((n == m) & (y["s"] < x["s"]))))

    best = F.filter(kept, lambda x: ~F.exists(kept, lambda y: _overlap(x, y) & better(y, x)))
    return F.transform(best, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["near"].alias("near")))


def find_personal_data(docs: DataFrame, *, base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with text (null: empty) and two more columns: base and spans, arrays of (kind, s, e) in code points, end
    exclusive, by kind (KINDS, then MORE_KINDS) and then start. spans holds every base span and what the method adds.

    One row per row, no shuffle, no Python on executors. Empty tables and empty or long texts need no special case;
    rows may repeat. Columns of docs keep their values; two that are called as the new ones raise an error.
    """
    if {base, spans} & set(docs.columns):
        raise ValueError(f"columns {sorted({base, spans} & set(docs.columns))} are there already; name the new ones otherwise")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = "_spans"
    while held in docs.columns:
        held = "_" + held
    found = F.struct(*[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    out = docs.withColumn("text", text).withColumn(held, found)
    every = F.concat(*[F.col(held)[k] for k in KINDS])
    out = out.withColumn(held, F.struct(*[F.col(held)[k].alias(k) for k in KINDS], every.alias("all"), F.col("text").rlike("[0-9][0-9]").alias("digits")))
    none = F.array().cast(_EMPTY)
    out = out.withColumn(held, F.struct(*[F.col(held)[k].alias(k) for k in KINDS], *[selected(F.col("text"), k, F.col(held)["all"], F.col(held)["digits"]).alias(f"kept_{k}") for k in _ORDER]))
    out = out.withColumn(held, F.struct(*[F.col(held)[k].alias(k) for k in KINDS], *[best_of(F.col(held)[f"kept_{k}"]).alias(f"added_{k}") for k in _ORDER]))

    def named(kind: str, some: Column) -> Column:
        return F.transform(some, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    def ordered(some: Column) -> Column:
        return F.array_sort(F.transform(some, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"))))

    def all_of(kind: str) -> Column:
        return F.concat(F.col(held)[kind] if kind in KINDS else none, F.col(held)[f"added_{kind}"])

    out = out.withColumn(base, F.concat(*[named(k, F.col(held)[k]) for k in KINDS]))
    return out.withColumn(spans, F.concat(*[named(k, ordered(all_of(k))) for k in _ORDER])).drop(held)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, [EMAIL] and so on; spans that overlap become one,
    named by the first. A null text becomes empty. The columns stay the same, whatever their names."""
    base, spans = "_base", "_spans_found"
    while {base, spans} & set(docs.columns):
        base, spans = "_" + base, "_" + spans
    found = find_personal_data(docs, base=base, spans=spans)
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))
        fresh = F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), label))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), fresh.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))
    return found.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
