"""Text keys, n-grams, similarities of sets and the small parsers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form, trimmed; Spark has no function for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip())


def squeeze(s: Column) -> Column:
    """Lower case, wide blanks as blanks, runs of white space as one."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(s, F.lit(""))), "\u3000", " "), r"\s+", " "))


def text_key(s: Column) -> Column:
    """What two texts must share to count as one: Chinese characters, letters and digits."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^\u4e00-\u9fffa-z0-9]+", " "))


def char_ngrams(s: Column, n: int) -> Column:
    """Distinct n-grams; a shorter non-empty text is its own."""
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - (n - 1)))
    return F.when(F.length(s) > 0, F.array_distinct(F.transform(places, lambda i: F.substring(s, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, empty_both: float = 1.0) -> Column:
    """Of two arrays of distinct values."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(float(empty_both))).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


#: Weights of the typed parts of a view's signature.
SIGNATURE = {"ISSUE": 0.45, "PHEN_DIAG": 0.30, "ELEM_MOD": 0.20, "OP": 0.05}


def weighted_jaccard(a: dict[str, Column], b: dict[str, Column], empty_both: float = 1.0) -> Column:
    out = F.lit(0.0)
    for part, weight in SIGNATURE.items():
        out = out + F.lit(weight) * jaccard(a[part], b[part], empty_both)
    return out


def signature_text(concept: Column, definition: Column, examples: Column) -> Column:
    """concept。definition。ex1；ex2；ex3 from the examples fit to show."""
    fit = F.filter(examples, lambda x: (F.trim(x) != "") & ~x.rlike("[()（）]|未明确|未提及|未具体"))
    return F.concat_ws("。", F.nullif(F.trim(concept), F.lit("")), F.nullif(F.trim(definition), F.lit("")), F.nullif(F.array_join(F.slice(fit, 1, 3), "；"), F.lit("")))


def plus_minus(s: Column) -> Column:
    """mean and deviation of "a±b"."""
    number = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"
    return F.struct(
        F.regexp_extract(s, rf"^\s*({number})", 1).try_cast("double").alias("mean"),
        F.regexp_extract(s, rf"±\s*({number})\s*$", 1).try_cast("double").alias("std"),
    )


def schedule(spec: Column) -> Column:
    """Costs of "a:b:step,c": ranges include their ends; sorted, distinct."""

    def values(part: Column) -> Column:
        bits = F.transform(F.split(part, ":"), lambda x: F.trim(x).cast("double"))
        step = F.coalesce(F.get(bits, F.lit(2)), F.lit(1.0))
        n = F.floor((F.get(bits, F.lit(1)) - F.get(bits, F.lit(0))) / step + 1e-9).cast("int")
        return F.when(F.size(bits) == 1, bits).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: F.get(bits, F.lit(0)) + i * step))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(F.split(spec, ","), lambda x: F.trim(x) != ""), values))))


def path_name(name: str) -> str:
    """A folder name with every other character as #U and four hex digits at least."""
    return "".join(c if c.isascii() else f"#U{ord(c):04x}" for c in name)


def tokens_estimate(s: Column) -> Column:
    """Two tokens for three Chinese characters, one for four others."""
    wide = F.regexp_count(s, F.lit("[\u4e00-\u9fff]"))
    return F.ceil(wide / F.lit(1.5) + (F.length(s) - wide) / F.lit(4.0)).cast("bigint")
