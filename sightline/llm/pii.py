"""Personal data: fixed patterns, then candidate gradient boosting; all in SQL functions.

Base kinds (email, ip, card, phone) are found by pattern and check. Beyond them, generators of high recall
propose overlapping spans; boosted trees score each from its format and from the text around it, and the
spans above their generator's calibrated threshold are added. The trees are trained on a table of made
candidates (see `pii_model`) and become CASE expressions over the candidates.

Positions are code points, end exclusive. They come from the lengths of what a pattern matches and of what
lies between, summed in blocks, so that a text of n matches costs about n steps.

Defined cases: null text counts as empty (and stays null where it is redacted); a text without findings has
an empty spans string; repeated rows are treated each on their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import pii_model
from sightline.llm.common import texts

#: What the base kinds match. Possessive where no shorter match could succeed; a run that a
#: match has not ended begins only where its class begins, which keeps long runs linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators and the kind that their spans get. Only an account number's length is bounded: the standard
#: allows 34 characters at most.
GENERATORS = {
    "secret": r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?[^\x20\x09-\x0D\"']{4,}+",
    "key": r"(?<![A-Za-z0-9+/_=.@-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9@])",
    "number": r"(?<![A-Za-z0-9.+-])(?:[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{10,30}[0-9]|\(?[0-9][0-9\x20().-]{7,}[0-9])(?![A-Za-z0-9])",
    "masked": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]++)++",
}
_PLAIN = r"(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![A-Za-z0-9])"
_GROUP = rf"(?:\x20(?![A-Z]{{2}}[0-9]{{2}}|{_PLAIN}))?"
#: Further candidates of a generator, which may overlap its own: numbers of a known shape. A greedy run over several
#: numbers is one candidate of "number", of no shape at all.
INSIDE = {
    "number": rf"(?<![A-Za-z0-9.+-])(?:{_PLAIN}|[A-Z]{{2}}[0-9]{{2}}(?:{_GROUP}[A-Z0-9]{{4}}){{3,7}}(?:{_GROUP}[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]|-[0-9]))",
}
BLOCK, AROUND = 256, 24


def _found(text: str, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)


def _runs(parts: Column, begin: Column) -> Column:
    """Starts and ends of parts (gap, hit, ...) laid end to end from begin."""
    empty = F.array().cast("array<struct<s:int,e:int,hit:string,before:string,after:string>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + x["gap"]
        e = s + F.length(x["hit"])
        row = F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(parts, F.struct(begin.cast("int").alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])


def spans(hits: str, gaps: str) -> Column:
    """array of (s, e, hit, before, after) from a pattern's matches and the pieces between them."""

    def part(hit: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        return F.struct(F.length(gap).alias("gap"), hit.alias("hit"), F.right(gap, F.lit(AROUND)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"))

    parts = F.transform(F.col(hits), part)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, BLOCK))
    width = lambda block: F.aggregate(block, F.lit(0), lambda acc, x: acc + x["gap"] + F.length(x["hit"]))
    laid = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<pos:int,parts:array<struct<gap:int,hit:string,before:string,after:string>>>>").alias("out")),
        lambda acc, b: F.struct(
            (acc["pos"] + width(b)).alias("pos"), F.concat(acc["out"], F.array(F.struct(acc["pos"].alias("pos"), b.alias("parts")))).alias("out")
        ),
        lambda acc: acc["out"],
    )
    whole = F.flatten(F.transform(laid, lambda b: _runs(b["parts"], b["pos"])))
    empty = F.array().cast("array<struct<s:int,e:int,hit:string,before:string,after:string>>")
    return F.when(F.size(hits) > BLOCK, whole).when(F.size(hits) > 0, _runs(parts, F.lit(0))).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass: every second one from the right counts twice, less 9 above 9."""
    turned = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(turned.substr(i, F.lit(1))) - 48
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    digits = _digits(x["hit"])
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.regexp_like(x["hit"], F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _kept(kind: str) -> Column:
    test = _valid if kind in BASE else pii_model.accepts
    kept = [F.filter(a, lambda x: test(kind, x)) for a in (f"a_{kind}", *([f"a_{kind}_inside"] if kind in INSIDE else []))]
    if len(kept) == 1:
        return kept[0]
    # as whole numbers, of which distinct ones are found by hash
    places = F.array_sort(F.array_distinct(F.transform(F.concat(*kept), lambda x: F.shiftleft(x["s"].cast("long"), 32) + x["e"])))
    return F.transform(places, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("s"), (x % (1 << 32)).cast("int").alias("e")))


def _tagged(kind: str) -> Column:
    return F.transform(f"k_{kind}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.upper()}>").alias("tag")))


def _marks(kind: str, column: str) -> Column:
    return F.transform(F.col(column), lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"]))


def find(rows: DataFrame) -> DataFrame:
    """rows (with a non-null column text) and, for each kind, its spans as column k_<kind>."""
    patterns, own = BASE | GENERATORS | {f"{k}_inside": rx for k, rx in INSIDE.items()}, rows.columns
    rows = rows.select(*own, *(c.alias(f"{p}_{k}") for k, rx in patterns.items() for p, c in zip("hg", _found("text", rx))))
    rows = rows.select(*own, *(spans(f"h_{k}", f"g_{k}").alias(f"a_{k}") for k in patterns))
    return rows.select(*own, *(_kept(k).alias(f"k_{k}") for k in BASE | GENERATORS))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows = find(texts(docs))
    base = F.concat_ws(",", *(_marks(k, f"k_{k}") for k in BASE))
    every = F.concat_ws(",", *(_marks(k, f"k_{k}") for k in (*BASE, *GENERATORS)))
    return rows.select(
        "doc_id", *(F.size(f"k_{k}").cast("long").alias(f"n_{k}") for k in BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans")
    )


PAGE = 4096


def redacted(rows: DataFrame) -> DataFrame:
    """rows with column text (null stays null) in which every found span is replaced by its kind in angle
    brackets; of overlapping spans the first, widened over the others, counts. The text is cut into pages first,
    so that a long text's pieces are reached directly. A row travels as one struct beside its text, so that none of
    its columns can clash with those made here; n_chars, if there, follows where the text changed."""
    own = {c: rows[f"`{c}`"] for c in rows.columns}
    found = find(rows.select(F.struct(*(x.alias(c) for c, x in own.items())).alias("row"), F.coalesce(own["text"], F.lit("")).alias("text")))
    tagged = [_tagged(k) for k in (*BASE, *GENERATORS)]
    found = found.withColumn("all_spans", F.array_sort(F.concat(*tagged)))
    found = found.select("row", "text", "all_spans", F.when(F.size("all_spans") > 0, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))).alias("pages"))

    def piece(a: Column, b: Column) -> Column:
        p, q = F.floor(a / PAGE).cast("int"), F.floor(b / PAGE).cast("int")
        here = F.coalesce(F.get("pages", p), F.lit(""))
        same = here.substr(a % PAGE + 1, b - a)
        last = F.coalesce(F.get("pages", q), F.lit("")).substr(F.lit(1), b % PAGE)
        return F.when(b <= a, "").when(p == q, same).otherwise(
            F.concat(here.substr(a % PAGE + 1, F.lit(PAGE)), F.array_join(F.slice("pages", p + 2, q - p - 1), ""), last)
        )

    # each span with the furthest end before it: the furthest of each block of spans first, then within the block
    spans_of = "array<struct<s:int,e:int,tag:string>>"
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("all_spans") - 1) / BLOCK).cast("int")), lambda i: F.slice("all_spans", i * BLOCK + 1, BLOCK))
    furthest = lambda a: F.array_max(F.transform(a, lambda x: x["e"]))
    laid = F.aggregate(
        blocks, F.struct(F.lit(0).alias("m"), F.array().cast(f"array<struct<m:int,parts:{spans_of}>>").alias("out")),
        lambda acc, b: F.struct(F.greatest(acc["m"], furthest(b)).alias("m"), F.concat(acc["out"], F.array(F.struct(acc["m"].alias("m"), b.alias("parts")))).alias("out")),
        lambda acc: acc["out"],
    )
    reached = "array<struct<s:int,e:int,tag:string,from:int>>"

    def reaches(b: Column) -> Column:
        return F.aggregate(
            b["parts"], F.struct(b["m"].alias("m"), F.array().cast(reached).alias("out")),
            lambda acc, x: F.struct(
                F.greatest(acc["m"], x["e"]).alias("m"),
                F.concat(acc["out"], F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["tag"].alias("tag"), acc["m"].alias("from")))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    found = found.withColumn("reach", F.when(F.size("all_spans") > 0, F.flatten(F.transform(laid, reaches))))
    bits = F.transform("reach", lambda x: F.when(x["s"] >= x["from"], F.concat(piece(x["from"], x["s"]), x["tag"])).otherwise(""))
    tail = piece(furthest(F.col("all_spans")), F.length("text"))
    clean = F.when(F.size("all_spans") == 0, F.col("row")["text"]).otherwise(F.concat(F.array_join(bits, ""), tail))
    found = found.select("row", F.when(F.col("row")["text"].isNotNull(), clean).alias("clean"))
    types, out = dict(rows.dtypes), []
    for c in own:
        was = F.col("row").getField(c)
        if c == "n_chars":
            was = F.when(F.col("clean").eqNullSafe(F.col("row")["text"]), was).otherwise(F.length("clean")).cast(types[c])
        out.append((F.col("clean") if c == "text" else was).alias(c))
    return found.select(*out)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row, with texts without personal data; n_chars follows where the text changed."""
    return redacted(docs)
