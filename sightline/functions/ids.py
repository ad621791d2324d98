"""Report-id strings: splitting, normal form, ordering, application codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_ids(s: Column) -> Column:
    """Distinct ids of a delimited string, in order; null and blanks give an empty array."""
    parts = F.filter(F.split(F.coalesce(F.trim(s), F.lit("")), r"[|,;\s]+"), lambda x: x != "")
    return F.array_distinct(parts)


def normal_id(s: Column) -> Column:
    """Whole numbers lose a fraction of zeros or an exponent ("12.00", "1e2"); nan and blanks are null."""
    t = F.trim(s)
    number = F.when(t.rlike(r"^[+-]?[0-9]+(\.0+)?$") | t.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+]?[0-9]+$"), t.try_cast("double"))
    whole = F.when(number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string"))
    return F.when(t.isNull() | (t == "") | (F.lower(t) == "nan"), None).otherwise(F.coalesce(whole, t))


def parse_ids(s: Column) -> Column:
    """Split, then bring each id to normal form."""
    inner = F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), r"""^\s*[\[({]|[\])}]\s*$""", ""), r"""['"]""", "")
    return F.array_distinct(F.filter(F.transform(split_ids(inner), normal_id), lambda x: x.isNotNull()))


def order_key(s: Column) -> Column:
    """Numeric ids first, by number; then the others, by text."""
    return F.struct(*order_columns(s))


def order_columns(s: Column) -> list[Column]:
    """The same order as columns: whether it is text, a number's length and digits, the id."""
    number, bare = s.rlike("^[0-9]+$"), F.regexp_replace(s, "^0+", "")
    return [(~number).alias("text_last"), F.when(number, F.length(bare)).otherwise(0).alias("digits"), F.when(number, bare).otherwise("").alias("bare"), s.alias("text")]


def sort_key(s: Column) -> Column:
    """The same order as one string, compared by its bytes; id_of() gives the id back."""
    bare = F.regexp_replace(s, "^0+", "")
    return F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 10, "0"), bare, s)).otherwise(F.concat(F.lit("1"), s))


def id_of(key: Column) -> Column:
    """The id of a sort key."""
    skip = F.when(key.startswith("0"), F.substring(key, 2, 10).cast("int") + 12).otherwise(F.lit(2))
    return key.substr(skip, F.length(key))


def app_code(app: Column) -> Column:
    """1000 to 9999 from the app's md5."""
    return (1000 + F.pmod(F.conv(F.substring(F.md5(app), 1, 8), 16, 10).cast("bigint"), F.lit(9000))).cast("bigint")
