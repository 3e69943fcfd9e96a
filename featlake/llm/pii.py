"""Personal data, in DataFrame operations only: high-recall generators, boosted trees, calibrated thresholds.

Generators propose spans, which may overlap: the four base kinds (email, ip, card, phone), which stay whenever their
own checks pass, and three further ones: `account` (numbers of 12 to 19 digits, in groups or not, whatever their check
digit), `secret` (long runs of letters and digits) and `mailbox` (addresses with the at and dot spelled out). A gradient
boosted ensemble over format and context features gives each further candidate a probability; those at or above their
kind's threshold become spans. The ensemble is trained here on generated examples with a fixed seed, its thresholds are
the least that keep the wanted precision on generated examples held out, and it is applied as SQL expressions.

Positions are code points, ends exclusive. A position is the summed length of what splitting at the pattern leaves
before the match and of the matches before it. Patterns start only where a run starts (or the last match ended) and
use possessive repeats, so that a text of one long run costs time in proportion to its length.

Defined cases: null counts as empty; repeated rows get the same result; an empty table gives an empty result; further
columns stay out of `spans` and untouched in `redact`.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import replaced, unused

BASE = ("email", "ip", "card", "phone")
FURTHER = ("account", "secret", "mailbox")
KINDS = BASE + FURTHER
#: What the generators look for, and a text without which a pattern cannot match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9])(?<![0-9][ -]))[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "account": r"(?<![A-Za-z0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9]|[A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
    "mailbox": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?i:dot)[\])] ?[A-Za-z0-9-]{1,63}+)++",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]", "account": r"[0-9](?:[ -]?[0-9]){11}", "secret": r"[A-Za-z0-9_-]{20}", "mailbox": r"(?i)[\[(]at[\])]"}
#: Words in the CONTEXT code points before a candidate that speak for it.
CONTEXT = 24
CUES = {"account": r"(?i)card|account|iban|acct|konto|cuenta|compte|pay|number", "secret": r"(?i)key|token|secret|passw|pwd|auth|bearer|credential", "mailbox": r"(?i)mail|contact|write|reach"}
PRECISION = 0.99

FEATURES = ("length", "digits", "letters", "upper", "changes", "separators", "groups4", "cue", "quoted", "luhn")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text pass Luhn's check."""
    d = F.reverse(_digits(text))
    one = lambda i: F.substr(d, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, one(i)).otherwise(F.when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)))
    return (F.length(d) > 0) & (total % 10 == 0)


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        small = lambda p: F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255
        return F.forall(F.split(text, r"\."), lambda p: part(p) & small(p))
    if kind == "card":
        return n.between(14, 19) & luhn(text)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _matches(kind: str, text: Column) -> Column:
    """(start, end, m, before) of each match of the kind's pattern, empty where it cannot match."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    left = F.split(text, PATTERNS[kind], -1)

    def place(both: Column) -> Column:
        m, p = both["m"], both["p"]
        reach = F.aggregate(
            F.sequence(F.lit(0), F.size(m) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
            lambda a, i: F.struct(
                (a["at"] + F.length(F.get(p, i)) + F.length(F.get(m, i))).alias("at"),
                F.array_append(a["out"], F.struct((a["at"] + F.length(F.get(p, i))).alias("start"), (a["at"] + F.length(F.get(p, i)) + F.length(F.get(m, i))).alias("end"))).alias("out"),
            ),
        )["out"]
        rows = F.transform(reach, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(m, i).alias("m"), F.right(F.get(p, i), F.lit(CONTEXT)).alias("before")))
        return F.when(F.size(m) > 0, rows)

    # the lambda binds the matches, so that the patterns run once
    placed = F.get(F.transform(F.array(F.struct(found.alias("m"), left.alias("p"))), place), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string>>")
    return F.when(F.rlike(text, F.lit(NEEDS[kind])), F.coalesce(placed, none)).otherwise(none)


def features(kind: str, text: str, before: str) -> list[float]:
    """The features of a candidate; _features has the same as expressions."""
    digits = re.sub("[^0-9]", "", text)
    total = sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return [
        float(len(text)),
        len(digits) / max(1, len(text)),
        len(re.sub("[^A-Za-z]", "", text)) / max(1, len(text)),
        len(re.sub("[^A-Z]", "", text)) / max(1, len(text)),
        len(re.findall("[A-Za-z][0-9]|[0-9][A-Za-z]", text)) / max(1, len(text)),
        float(len(re.sub("[^ -]", "", text))),
        float(bool(re.search("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -]", text))),
        float(bool(re.search(CUES[kind], before))),
        float(bool(re.search("[\"'=:] ?$", before))),
        float(bool(digits) and total % 10 == 0),
    ]


def _features(kind: str, text: Column, before: Column) -> dict[str, Column]:
    n = F.greatest(F.lit(1), F.length(text)).cast("double")
    kept = lambda p: F.length(F.regexp_replace(text, p, "")).cast("double")
    flag = lambda c: c.cast("int").cast("double")
    return {
        "length": F.length(text).cast("double"),
        "digits": kept("[^0-9]") / n,
        "letters": kept("[^A-Za-z]") / n,
        "upper": kept("[^A-Z]") / n,
        "changes": F.size(F.regexp_extract_all(text, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0))).cast("double") / n,
        "separators": kept("[^ -]"),
        "groups4": flag(F.rlike(text, F.lit("^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -]"))),
        "cue": flag(F.rlike(before, F.lit(CUES[kind]))),
        "quoted": flag(F.rlike(before, F.lit("[\"'=:] ?$"))),
        "luhn": flag(luhn(text)),
    }


TREES, DEPTH, SHRINK, SEED = 30, 2, 0.4, 5


def _examples(kind: str, rng: random.Random, n: int) -> tuple[list[list[float]], list[int]]:
    """Generated candidates with their contexts and whether they are personal data or secrets."""
    syllables = [a + b for a in "bdfghklmnprst" for b in ("a", "e", "i", "o", "u", "an", "er")]
    word = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    plain = lambda: " ".join(word(rng.randint(1, 3)) for _ in range(4)) + " "
    x, y = [], []
    for i in range(n):
        good = i % 2
        before = plain()
        if kind == "account":
            if good:
                size = rng.choice([13, 14, 15, 16, 16, 16, 16, 19])
                d = rng.choice("3456") + "".join(rng.choices("0123456789", k=size - 1))
                text = d if rng.random() < 0.6 else rng.choice(" -").join(d[j : j + 4] for j in range(0, size, 4))
                if rng.random() < 0.3:
                    before += rng.choice(["card ", "card: ", "account ", "pay with "])
            else:
                form = rng.random()
                if form < 0.4:  # a list of numbers
                    text = rng.choice(" -").join(str(rng.randint(1, 999)) for _ in range(12))[:40].rstrip(" -")
                elif form < 0.7:  # dates
                    text = rng.choice(" -").join(f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" for _ in range(2))
                else:  # padded or round counters
                    text = "0" * rng.randint(6, 10) + str(rng.randint(10**5, 10**8))
        elif kind == "secret":
            if good:
                abc = rng.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
                text = rng.choice(["", "", "sk_live_", "AKIA", "ghp_"]) + "".join(rng.choices(abc, k=rng.choice([20, 24, 32, 40, 40, 64])))
                if rng.random() < 0.6:
                    before += rng.choice(['token = "', "key: ", 'secret="', "password=", "Bearer "])
            else:
                form = rng.random()
                if form < 0.4:
                    text = word(10) if form < 0.25 else word(10).upper()
                elif form < 0.6:
                    text = "-".join(word(2) for _ in range(6))
                elif form < 0.7:  # numbers and dates run together
                    text = "".join(rng.choices("0123456789", k=rng.randint(20, 90))) if form < 0.65 else "-".join(str(rng.randint(1, 2030)) for _ in range(8))
                elif form < 0.8:  # a word with a number
                    text = word(10) + str(rng.randint(1, 10**6))
                else:
                    text = rng.choice("_-xoA") * rng.randint(20, 60)
                if rng.random() < 0.2:
                    before += '"'
        else:
            user, host = word(2) + str(rng.randint(0, 99)), word(2)
            text = f"{user} [at] {host} [dot] com" if good else f"{word(1)} (at) {word(3)} (dot) {word(4)}"
            if rng.random() < (0.5 if good else 0.05):
                before += rng.choice(["mail ", "contact: ", "write to "])
        x.append(features(kind, text, before[-CONTEXT:]))
        y.append(good)
    return x, y


Tree = tuple  # (feature, threshold, left, right) or a leaf's value


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree | float:
    value = float(-SHRINK * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 8:
        return value
    best = (1e-6, None, None)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19)))
        for c in cuts:
            m = x[:, f] <= c
            if 0 < m.sum() < len(m):
                gain = g[m].sum() ** 2 / (h[m].sum() + 1.0) + g[~m].sum() ** 2 / (h[~m].sum() + 1.0) - base
                if gain > best[0]:
                    best = (gain, f, float(c))
    if best[1] is None:
        return value
    _, f, c = best
    m = x[:, f] <= c
    return f, c, _grow(x[m], g[m], h[m], depth - 1), _grow(x[~m], g[~m], h[~m], depth - 1)


def _value(tree: Tree | float, row: np.ndarray) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.cache
def model(kind: str) -> tuple[tuple, float]:
    """Trees of a kind's ensemble and the threshold on its margin, the same on every call."""
    rng = random.Random(SEED + KINDS.index(kind))
    x, y = (np.array(v, float) for v in _examples(kind, rng, 1200))
    xv, yv = (np.array(v, float) for v in _examples(kind, rng, 600))
    margin, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, p - y, p * (1 - p), DEPTH)
        trees.append(tree)
        margin += np.array([_value(tree, r) for r in x])
    mv = np.array([sum(_value(t, r) for t in trees) for r in xv])
    order = np.argsort(-mv)
    precision = np.cumsum(yv[order]) / np.arange(1, len(yv) + 1)
    fine = np.flatnonzero(precision >= PRECISION)
    return tuple(trees), float(mv[order[fine[-1]]] if len(fine) else np.inf)


def _margin(kind: str, of: Column) -> Column:
    """The ensemble's margin over a struct of features."""

    def expression(t: Tree | float) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(of[FEATURES[t[0]]] <= t[1], expression(t[2])).otherwise(expression(t[3]))

    total = F.lit(0.0)
    for t in model(kind)[0]:
        total = total + expression(t)
    return total


def _kept(kind: str, text: Column) -> Column:
    """Spans (start, k, end) of a kind."""
    m = _matches(kind, text)
    if kind in BASE:
        m = m if kind == "email" else F.filter(m, lambda s: _valid(kind, s["m"]))
    else:
        low = model(kind)[1]
        score = lambda s: F.get(F.transform(F.array(F.struct(*(c.alias(n) for n, c in _features(kind, s["m"], s["before"]).items()))), lambda f: _margin(kind, f)), F.lit(0))
        m = F.filter(m, lambda s: score(s) >= low)
    return F.transform(m, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), s["end"].alias("end")))


def with_spans(documents: DataFrame, name: str) -> DataFrame:
    """The documents with one column more, `name`: a struct of each kind's spans in order."""
    text = F.coalesce("text", F.lit(""))
    return documents.withColumn(name, F.struct(*(_kept(k, text).alias(k) for k in KINDS)))


def _ordered(of: Column, kinds: tuple[str, ...]) -> Column:
    return F.array_sort(F.concat(*(of[k] for k in kinds)))


def _joined(of: Column, kinds: tuple[str, ...]) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(_ordered(of, kinds), lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(documents: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base kinds, and all spans (the columns of the contract)."""
    d = with_spans(documents.select("doc_id", "text"), "found")
    of = F.col("found")
    counts = [F.size(of[k]).cast("long").alias(f"n_{k}") for k in BASE]
    return d.select("doc_id", *counts, F.sha2(_joined(of, BASE).cast("binary"), 256).alias("base_sha256"), _joined(of, KINDS).alias("spans"))


def redact(documents: DataFrame) -> DataFrame:
    """The documents with each span, overlapping ones as one, replaced by the first one's kind in brackets."""
    found, new = unused(documents, "found"), unused(documents, "redacted")
    d = with_spans(documents, found)
    ordered = _ordered(F.col(found), KINDS)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.array_append(F.array_append(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"])), F.get(names, s["k"])).alias("out"))
    )
    done = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    return replaced(d.withColumn(new, F.when(F.size(ordered) > 0, done).otherwise(F.col("text"))), documents, F.col(new))
