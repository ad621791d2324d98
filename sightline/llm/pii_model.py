"""Boosted trees over candidate spans, trained on made candidates and turned into SQL.

The same FEATURES are computed twice: in Python over the training table, in SQL over the candidates.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, RATE, UNIT = 40, 0.3, 1000
#: A generator's threshold is the least at which so much of the calibration half is right.
PRECISION = 0.99

#: Features by pattern: found in the span (hit) or in the text before it, lower-cased.
SHAPES = {
    "assigned": r"^[A-Za-z_-]+ ?[=:]",
    "hex": r"(?:^|[=:\"' ])[0-9a-f]{12,}$",
    "upper_key": r"^[A-Z]{4}[A-Z0-9]{12,28}$",
    "triple_phone": r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$",
    "social": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$",
    "date": r"(?:^|[^0-9])(?:1[0-9]{3}|20[0-9]{2})[-. ](?:0?[1-9]|1[0-2])[-. ](?:[0-2]?[0-9]|3[01])(?:[^0-9]|$)",
    "plain": r"^[0-9]+(?:[. ][0-9]{3})*$",
    "slug": r"[a-z]{3}[-_/][a-z]{2}",
}
BEFORE = {
    "says_secret": r"(?:password|passwd|pwd|token|secret|key|credential|bearer)[^a-z]*$",
    "says_contact": r"(?:tel|phone|call|fax|mobile|cell|text)[^a-z]*(?:us|me|at|no|number)?[^a-z]*$",
    "says_person": r"(?:ssn|social|security|iban|account|passport|licen[cs]e no|tax id|acct)[^a-z]*(?:no|number|is)?[^a-z]*$",
    "says_mail": r"(?:mail|contact|write|reach|address)[^a-z]*(?:to|at|is|me)?[^a-z]*$",
    "says_address": r"(?:https?:|www\.|/)\S*$",
}
COUNTS = {"digits": r"[0-9]", "upper": r"[A-Z]", "lower": r"[a-z]", "marks": r"[-. ()/_]", "turns": r"[A-Za-z][0-9]|[0-9][A-Za-z]"}
FEATURES = ("length", *COUNTS, *SHAPES, *BEFORE)


def features(hit: str, before: str) -> list[int]:
    out = [len(hit)] + [len(re.findall(p, hit)) for p in COUNTS.values()]
    return out + [int(bool(re.search(p, hit))) for p in SHAPES.values()] + [int(bool(re.search(p, before.lower()))) for p in BEFORE.values()]


def made(seed: int = 11, each: int = 60) -> list[tuple[str, str, str, int]]:
    """generator, hit, text before, whether it is personal data or a secret."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, num, up = string.hexdigits[:16], string.digits, string.ascii_uppercase
    word = lambda: pick(string.ascii_lowercase, rng.randint(3, 9))
    prose = lambda: f"{word()} {word()} "[-24:]
    rows = []
    for _ in range(each):
        name = rng.choice(["password", "token", "secret", "api_key", "pwd", "Password", "API-KEY"])
        eq = rng.choice(["=", " = ", ": ", "=\"", " = \"", "='"])
        rows += [
            ("secret", name + eq + pick(hexa, rng.randint(12, 40)), prose(), 1),
            ("secret", name + eq + pick(string.ascii_letters + num, rng.randint(8, 32)) + pick(num, 2), prose(), 1),
            ("secret", name + rng.choice([": ", " = "]) + word(), prose(), 0),
            ("secret", name + ": " + rng.choice(["string", "required", "none", "optional", "see", "bearer"]), prose(), 0),
            ("key", "AKIA" + pick(up + num, 15) + pick(num, 1), prose(), 1),
            ("key", pick(hexa, rng.choice([32, 40, 64])), rng.choice(["token ", "key: ", prose()]), 1),
            ("key", pick(string.ascii_letters + num, rng.randint(24, 48)) + pick(num, 3), prose(), 1),
            ("key", f"{word()}-{word()}-{word()}-{pick(num, 4)}", prose(), 0),
            ("key", f"{word()}_{word()}{word()}{pick(num, 2)}", prose(), 0),
            ("key", f"{word()}{word()}{word()}{pick(num, 1)}", prose(), 0),
            ("key", f"2{pick(num, 3)}-0{rng.randint(1, 9)}-1{pick(num, 1)}_{word()}{word()}", prose(), 0),
            ("key", f"{word()}/{word()}/{pick(num, 4)}/{word()}", rng.choice(["https:", "www.", prose()]), 0),
            ("number", f"{rng.choice(['({})', '{}'])}".format(pick("23456789", 3)) + rng.choice([" ", "-", "."]) + pick(num, 3) + "-" + pick(num, 4), rng.choice(["call ", "tel: ", prose()]), 1),
            ("number", f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}", rng.choice(["ssn ", "social security no ", prose()]), 1),
            ("number", rng.choice(["DE", "FR", "GB", "ES"]) + pick(num, 2) + "".join(rng.choice(["", " "]) + pick(num, 4) for _ in range(4)), rng.choice(["iban ", prose()]), 1),
            ("number", pick("123456789", 1) + pick(num, rng.randint(8, 15)), prose(), 0),
            ("number", f"20{pick('012', 1)}{pick(num, 1)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)} {pick('01', 1)}{pick(num, 1)}", prose(), 0),
            ("number", " ".join(pick(num, rng.randint(1, 3)) for _ in range(rng.randint(4, 7))), prose(), 0),
            ("number", "1." + ".".join(pick("123456789", 1) for _ in range(5)), "version ", 0),
            ("number", f"{pick('123456789', 2)}.{pick(num, 3)}.{pick(num, 3)}.{pick(num, 3)}", prose(), 0),
            ("number", f"{pick('123456789', 3)}-{pick(num, 5)}-{pick(num, 3)}", prose(), 0),
            ("masked", f"{word()}{rng.choice([' (at) ', '[at]', ' [at] '])}{word()}{rng.choice([' (dot) ', '.', '[dot]'])}com", rng.choice(["mail ", prose()]), 1),
            ("masked", f"{word()} (at) {word()}. {word()}. {word()}", prose(), 0),
        ]
    return rows


def _tree(x: np.ndarray, r: np.ndarray, h: np.ndarray, depth: int):
    """Nested (feature, threshold, below, above) or a leaf; Newton gains over a few thresholds a feature."""
    best = (1e-6, None)
    for f in range(x.shape[1]) if depth else ():
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9)).astype(int)):
            low = x[:, f] <= t
            if 5 <= low.sum() <= len(low) - 5:
                gain = sum(r[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, ~low)) - r.sum() ** 2 / (h.sum() + 1)
                if gain > best[0]:
                    best = (gain, (f, int(t), low))
    if best[1] is None:
        return round(UNIT * RATE * r.sum() / (h.sum() + 1))
    f, t, low = best[1]
    return f, t, _tree(x[low], r[low], h[low], depth - 1), _tree(x[~low], r[~low], h[~low], depth - 1)


def value(tree, row) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache
def trained() -> tuple[list, dict[str, int]]:
    """Trees with whole-numbered leaves, and each generator's threshold."""
    rows = made()
    x, y = np.array([features(h, b) for _, h, b, _ in rows]), np.array([r[3] for r in rows])
    learn = np.arange(len(rows)) % 2 == 0
    s, trees = np.zeros(len(rows)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-s / UNIT))
        tree = _tree(x[learn], (y - p)[learn], (p * (1 - p))[learn], 3)
        trees.append(tree)
        s += [value(tree, row) for row in x]
    limits = {}
    for kind in dict.fromkeys(r[0] for r in rows):
        own = ~learn & np.array([r[0] == kind for r in rows])
        limits[kind] = next((int(t) for t in np.unique(s[own]) if y[own][s[own] >= t].mean() >= PRECISION), int(s.max()) + 1)
    return trees, limits


def accepts(kind: str, x: Column) -> Column:
    """Whether the trees put candidate x of a generator at its threshold or above."""
    trees, limits = trained()
    hit, before = x["hit"], F.lower(x["before"])
    names = {"length": F.length(hit)} | {k: F.regexp_count(hit, F.lit(p)) for k, p in COUNTS.items()}
    names |= {k: F.regexp_like(hit, F.lit(p)).cast("int") for k, p in SHAPES.items()}
    names |= {k: F.regexp_like(before, F.lit(p)).cast("int") for k, p in BEFORE.items()}
    packed = F.array(F.struct(*(c.alias(k) for k, c in names.items())))  # one element: features are computed once

    def case(tree, f: Column) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(f[FEATURES[tree[0]]] <= tree[1], case(tree[2], f)).otherwise(case(tree[3], f))

    def total(f: Column) -> Column:
        out = F.lit(0)
        for tree in trees:
            out = out + case(tree, f)
        return out

    return F.get(F.transform(packed, lambda f: total(f) >= limits[kind]), F.lit(0))
