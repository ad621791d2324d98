"""What language models return: cleaning, repair, flattening and the line formats."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TRIPLES = "array<struct<subject:string,subject_type:string,relation:string,object:string,object_type:string>>"


def clean_json(s: Column) -> Column:
    """The outermost array or object without code fences and trailing commas; null if there is none."""
    bare = F.regexp_replace(F.coalesce(s, F.lit("")), r"```[A-Za-z]*", "")
    body = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.nullif(F.regexp_replace(body, r",\s*([\]}])", "$1"), F.lit(""))


def repair(text: str | None) -> str | None:
    """The first of a ladder of readings that parses, as JSON; null if none does."""
    if not text:
        return None
    s = unicodedata.normalize("NFKC", text)
    s = re.sub(r"```[A-Za-z]*", "", s).translate(str.maketrans("“”‘’", "\"\"''"))
    start = min((i for i in (s.find("["), s.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    s = s[start:].strip()
    end = max(s.rfind("]"), s.rfind("}"))
    whole = s[: end + 1] if end >= 0 else s
    ladder = [lambda x: x, lambda x: re.sub(r",\s*([\]}])", r"\1", x)]
    ladder.append(lambda x: re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", x))))
    ladder.append(lambda x: re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', x))
    ladder.append(lambda x: re.sub(r"'([^'\"]*)'", r'"\1"', x))
    ladder.append(_closed)
    now, tried = [s, whole], set()
    for fix in ladder:
        now = [fix(x) for x in now]
        for out in now:
            if out not in tried:
                tried.add(out)
                try:
                    return json.dumps(json.loads(out), ensure_ascii=False)
                except ValueError:
                    continue
    return None


#: What opens or closes a string or bracket, and what a backslash hides.
MARKS = re.compile(r"""\\.|["\[\]{}]""", re.DOTALL)


def _closed(s: str) -> str:
    """s with its open strings and brackets closed."""
    stack, quoted = [], False
    for c in MARKS.findall(s):
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "[{":
            stack.append("]" if c == "[" else "}")
        elif not quoted and c in "]}" and stack:
            stack.pop()
    return re.sub(r",\s*$", "", s + '"' * quoted) + "".join(reversed(stack))


@F.pandas_udf(StringType())
def repair_json(s: pd.Series) -> pd.Series:
    return s.map(repair)


def flatten_triples(df: DataFrame, column: str) -> DataFrame:
    """A row for each triple of a JSON array; rows with a blank subject, relation or object are skipped."""
    parsed = F.from_json(F.col(column), TRIPLES)
    out = df.withColumn("triple", F.explode(parsed)).drop(column)
    fine = [F.coalesce(F.trim(F.col(f"triple.{k}")), F.lit("")) != "" for k in ("subject", "relation", "object")]
    return out.where(fine[0] & fine[1] & fine[2]).select(*[c for c in out.columns if c != "triple"], "triple.*")


def legacy_triples(s: Column) -> Column:
    """Five-part records between ### marks, parts split by ￨; a type loses its ending 实体."""
    rows = F.filter(F.transform(F.split(s, "###"), lambda r: F.split(F.trim(r), "￨")), lambda p: F.size(p) == 5)
    bare = lambda x: F.regexp_replace(F.trim(x), "实体$", "")
    return F.transform(
        rows,
        lambda p: F.struct(
            F.trim(p[0]).alias("subject"), bare(p[1]).alias("subject_type"), F.trim(p[2]).alias("relation"), F.trim(p[3]).alias("object"), bare(p[4]).alias("object_type")
        ),
    )


def between_pluses(s: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(s, r"(?s)\+{3,}(.*?)\+{3,}", 1)), F.lit(""))


def cluster_lines(s: Column) -> Column:
    """Arrays of numbers of "Cluster n {a, b}" lines."""
    return F.transform(
        F.regexp_extract_all(s, F.lit(r"Cluster\s+\d+\s*\{([^}]*)\}"), F.lit(1)),
        lambda body: F.transform(F.regexp_extract_all(body, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")),
    )
