"""Model-backed operators over a pluggable backend: batches of rows in, JSON out, defaults on failure."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from sightline.functions.jsonx import repair


class Backend(Protocol):
    """complete(task, items): one JSON text for a batch of items, each a dict with an id."""

    def complete(self, task: str, items: list[dict]) -> str: ...


class RuleBackend:
    """A deterministic stand-in that works without a network."""

    def complete(self, task: str, items: list[dict]) -> str:
        return json.dumps([{"id": x["id"], "value": getattr(self, task)(x)} for x in items], ensure_ascii=False)

    def extract(self, item: dict) -> list[dict]:
        """A triple for each pair of neighbouring capitalised words of a sentence."""
        out = []
        for sentence in re.split(r"[.!?。\n]", item["text"]):
            names = re.findall(r"\b[^\W\d_a-z]\w{3,}", sentence)
            out += [{"subject": a, "subject_type": "ISSUE", "relation": "concerns", "object": b, "object_type": "ELEM"} for a, b in zip(names, names[1:])]
        return out

    def concept(self, item: dict) -> str:
        words = item["text"].split()
        return words[-1].lower() if words else "未归类"

    def validate(self, item: dict) -> str:
        a, b = (set(item[k].lower().split()) for k in ("a", "b"))
        return "通过" if a & b else "否决"

    def pairs(self, item: dict) -> list[dict]:
        """Members of which half of the words are shared."""
        words = [(m, set(m.lower().split())) for m in item["members"]]
        scored = ((a, b, len(x & y) / len(x | y)) for i, (a, x) in enumerate(words) for b, y in words[i + 1 :] if x | y)
        return [{"a": a, "b": b, "score": s} for a, b, s in scored if s >= 0.5]

    def merges(self, item: dict) -> list[list[str]]:
        """Members whose concepts have the same first two words."""
        out: dict[str, list[str]] = {}
        for member, concept in zip(item["members"], item["concepts"], strict=True):
            out.setdefault(" ".join(concept.lower().split()[:2]), []).append(str(member))
        return [group for group in out.values() if len(group) > 1]

    def summary(self, item: dict) -> str:
        return " / ".join(sorted(item["members"])[:8])


def with_retries(call: Callable[[], str], attempts: int = 3, wait: float = 0.0) -> str:
    for n in range(attempts):
        try:
            return call()
        except Exception:
            if n + 1 == attempts:
                raise
            time.sleep(wait * 2**n)
    raise AssertionError


def model_column(df: DataFrame, task: str, make: Callable[[], Backend] = RuleBackend, batch: int = 20, default: str | None = None) -> DataFrame:
    """df (with a column id) plus value (JSON) and status: success, empty or failed. Rows of a batch are matched
    by id; a failed batch, or a row that is missing in the answer, gets the default."""
    schema = StructType([*df.schema.fields, StructField("value", StringType()), StructField("status", StringType())])

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make()
        for pdf in pdfs:
            values, states = [], []
            rows = pdf.to_dict("records")
            for i in range(0, len(rows), batch):
                part, found = rows[i : i + batch], None
                try:
                    fixed = repair(with_retries(lambda part=part: backend.complete(task, part)))
                    found = {str(x["id"]): x["value"] for x in json.loads(fixed)} if fixed else None
                except Exception:
                    found = None
                for row in part:
                    value = None if found is None else found.get(str(row["id"]))
                    states.append("failed" if found is None or str(row["id"]) not in found else "success" if value else "empty")
                    values.append(json.dumps(value, ensure_ascii=False) if value else default)
            yield pdf.assign(value=values, status=states)

    return df.mapInPandas(run, schema)
