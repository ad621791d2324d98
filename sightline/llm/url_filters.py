"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

Rules go first: a rule fits its host and all subdomains if the path starts with the rule's path; the
longest rule wins. Where none fits, the verdict is the model's: 3-grams of host and path are hashed to
BUCKETS; the model, trained on a small labelled URL table, gives each bucket a whole-numbered weight
(thousandths), so that sums are exact in any order. Everything over the pages is made of SQL functions.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule and the verdict
allow; a repeated row is judged as often as it is there; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import LOWER, UPPER, ascii_lower

GRAM, BUCKETS, UNIT = 3, 2048, 1000

#: Verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The labelled URL table: hosts' names to block and to allow; each is seen under several shapes of URL.
BLOCKED = (
    "casino casino-win online-casino slots jackpot poker-room free-bets bet-now sports-bets betting bingo-win "
    "cheap-pills pills-shop viagra-store pharma-deal diet-pills ads-track ad-server click-track tracker popads "
    "banner-ads adult-cams xxx-tube porn-videos sex-chat hot-singles loan-fast payday-loans quick-cash "
    "free-money win-prize lottery-win crypto-double replica-watch cheap-meds torrent-crack warez-keygen "
    "spam-offers best-deals-now"
).split()
ALLOWED = (
    "news library museum university science history travel cooking garden school research weather health "
    "journal archive books music theater city council forum recipes football photography astronomy biology "
    "chemistry physics mathematics language dictionary encyclopedia mail maps software docs support wiki "
    "community parliament court hospital station national regional another thornton harrington bather hither"
).split()
TOPS = ("example.com", "example.org", "example.net")
FRONTS = ("", "www.", "m.", "blog.")
PATHS = ("/en/4033.html", "/de/17/", "/fr/7376", "/es/12", "/", "")


def gram_hash(s: str) -> list[int]:
    return [(ord(s[i]) * 961 + ord(s[i + 1]) * 31 + ord(s[i + 2])) % BUCKETS for i in range(len(s) - GRAM + 1)]


@lru_cache
def train() -> tuple[int, tuple[int, ...]]:
    """Bias and weights in thousandths, by gradient descent on the labelled table."""
    table = [(1, h) for h in BLOCKED] + [(0, h) for h in ALLOWED]
    rows = [
        (y, f"{FRONTS[(i + k) % 4]}{h}.{TOPS[k % 3]}{PATHS[(i + k) % 6]}") for i, (y, h) in enumerate(table) for k in range(12)
    ]
    x, y = np.zeros((len(rows), BUCKETS)), np.array([r[0] for r in rows], float)
    for i, (_, s) in enumerate(rows):
        np.add.at(x[i], gram_hash(s), 1)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(600):
        e = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight / len(y)
        w -= 2.0 * (x.T @ e + 2e-4 * w)
        b -= 2.0 * e.sum()
    return round(b * UNIT), tuple(np.round(w * UNIT).astype(int).tolist())


def parts(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def judge(pages: DataFrame) -> DataFrame:
    bias, weights = train()
    host, path = parts(pages["url"])
    rows = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    rows = rows.withColumns({"rule": rule, "named": verdict, "grams": F.concat("host", "path")})
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")

    # one pass over the characters, with the two before in hand: a long url costs its length
    codes = F.transform(F.split("grams", ""), lambda c: F.ascii(c))

    def step(acc: Column, c: Column) -> Column:
        weight = F.get(table, ((acc["a"] * 961 + acc["b"] * 31 + c) % BUCKETS).cast("int"))
        return F.struct(acc["b"].alias("a"), c.alias("b"), (acc["total"] + F.when(acc["a"] >= 0, weight).otherwise(0)).alias("total"))

    start = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(bias).cast("long").alias("total"))
    total = F.aggregate(codes, start, step, lambda acc: acc["total"])
    own = F.when((F.length("grams") >= GRAM) & (total > 0), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("named", own).alias("verdict"))


def oracle() -> str:
    bias, weights = train()
    arms = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in arms]
    code = "unicode(substr(g, i + {}, 1))"
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM r),
g AS (SELECT *, host || path AS g FROM p),
s AS (SELECT *, {bias} + coalesce(list_sum(list_transform(range(1, length(g) - {GRAM - 2}),
        lambda i: ([{",".join(map(str, weights))}])[1 + ({code.format(0)} * 961 + {code.format(1)} * 31 + {code.format(2)}) % {BUCKETS}])), 0) AS total FROM g)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, arms))} END AS rule,
       CASE {" ".join(f"WHEN {f} THEN '{k}'" for f, (k, _, _) in zip(fits, arms))}
            WHEN length(g) >= {GRAM} AND total > 0 THEN 'block' ELSE 'allow' END AS verdict FROM s"""
