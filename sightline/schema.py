"""Column sets, closed type and relation vocabularies, and the column-resolution helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ("id", "name", "type", "source_row_index")
EDGE = ("id", "source_id", "target_id", "relation", "source_type", "target_type", "source_row_index")
TRIPLE = ("subject", "subject_type", "relation", "object", "object_type", "source_row_index")

#: Entity types as extractors write them, and their short names.
TYPES = {"功能模块": "MOD", "用户操作": "OP", "影响元素": "ELEM", "用户感知现象": "PHEN", "系统诊断信息": "DIAG", "问题陈述": "ISSUE"}
#: Relation -> the type pairs it may connect.
RELATIONS = {
    "located_in": (("ELEM", "MOD"),),
    "performs_on": (("OP", "ELEM"),),
    "triggers": (("OP", "MOD"),),
    "results_in": (("OP", "PHEN"),),
    "accompanied_by": (("PHEN", "DIAG"), ("DIAG", "PHEN")),
    "reported_in": (("DIAG", "MOD"),),
    "concerns": (("ISSUE", "MOD"), ("ISSUE", "ELEM")),
}
UNIVERSE = ("PHEN", "DIAG", "ISSUE")


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with exactly these columns; an error that lists what is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def first_present(df: DataFrame, names: Sequence[str]) -> str:
    """The first of names that df has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    found = next((have[n.lower()] for n in names if n.lower() in have), None)
    if found is None:
        raise ValueError(f"none of these columns: {', '.join(names)}")
    return found


def canonical_type(raw: Column) -> Column:
    """Short name of an entity type; short names stay, anything else is UNK."""
    text = F.trim(raw)
    out = F.when(F.upper(text).isin(*TYPES.values()), F.upper(text))
    for name, short in TYPES.items():
        out = out.when(text == name, short)
    return out.otherwise("UNK")


def valid_edge(relation: Column, source: Column, target: Column) -> Column:
    """Whether the relation may connect these types."""
    out = F.lit(False)
    for name, pairs in RELATIONS.items():
        for a, b in pairs:
            out = out | ((relation == name) & (source == a) & (target == b))
    return F.coalesce(out, F.lit(False))
