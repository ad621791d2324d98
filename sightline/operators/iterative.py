"""Clusters grown in batches by a model that sees the clusters so far.

An app's reports come in an order by hash, some a batch; the model answers with a cluster for each, an old one or a new
name. A batch that is too long for the model is halved; what it leaves out, or answers with an unknown cluster, is asked
about once more and then stands alone; clusters of one summary are made one when there are too many. The state of an
app is its clusters' summaries and sizes alone. cluster_apps() takes a table; streaming.clusters keeps the same state
between micro-batches and after a restart.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import md5
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

ASSIGNED = "app string, id string, cluster_id string, batch_no int"


class TooLong(Exception):
    """A model's context can't hold the batch."""


class Model(Protocol):
    """assign(state, items): for each item's id the number of a cluster of the state, or a summary for a new one. A model
    that looks at less than text and label of an item says so in reads; only that is sent to it."""

    def assign(self, state: dict[str, str], items: list[dict]) -> dict[str, str]: ...


class ByLabel:
    """A stand-in that clusters by an item's label. It knows the answer: a bound on what a model could reach."""

    reads = ("label",)

    def assign(self, state: dict[str, str], items: list[dict]) -> dict[str, str]:
        known = {summary: number for number, summary in state.items()}
        return {str(x["id"]): known.get(x["label"], x["label"]) for x in items}


def empty_state() -> dict:
    return {"clusters": {}, "sizes": {}, "names": {}, "next": 1, "batches": 0}


def _ask(model: Model, state: dict, items: list[dict]) -> dict[str, str]:
    """The model's answer; in halves where the batch is too long."""
    try:
        return {str(k): str(v) for k, v in model.assign(dict(state["clusters"]), items).items() if v}
    except TooLong:
        if len(items) == 1:
            return {}
        half = len(items) // 2
        first = _ask(model, state, items[:half])
        _take(state, items[:half], first)
        return first | _ask(model, state, items[half:])


def _take(state: dict, items: list[dict], answer: dict[str, str]) -> None:
    """Open the clusters that an answer names newly, and write their numbers into it."""
    for x in items:
        said = answer.get(str(x["id"]))
        if said is not None and said not in state["clusters"]:
            if said not in state["names"]:
                number = str(state["next"])
                state["clusters"][number], state["sizes"][number], state["names"][said] = said, 0, number
                state["next"] += 1
            answer[str(x["id"])] = state["names"][said]


def compact(state: dict, most: int) -> dict[str, str]:
    """Old number -> number that stays, of clusters of one summary, where there are more than most."""
    if len(state["clusters"]) <= most:
        return {}
    first: dict[str, str] = {}
    gone = {}
    for number in sorted(state["clusters"], key=int):
        key = " ".join(state["clusters"][number].lower().split())
        if key in first:
            gone[number] = first[key]
            state["sizes"][first[key]] += state["sizes"].pop(number)
            state["names"][state["clusters"].pop(number)] = first[key]
        else:
            first[key] = number
    return gone


def batches(items: list[dict], size: int) -> list[list[dict]]:
    """Batches of a size; a rest of under a tenth joins the one before."""
    out = [items[i : i + size] for i in range(0, len(items), size)]
    if len(out) > 1 and len(out[-1]) < 0.1 * size:
        out[-2:] = [out[-2] + out[-1]]
    return out


def grow(items: list[dict], state: dict, model: Model, size: int = 50, most: int = 400) -> list[tuple[str, str, int]]:
    """(id, cluster, batch) of the items, in an order by hash; the state grows with them."""
    out: list[tuple[str, str, int]] = []
    for batch in batches(sorted(items, key=lambda x: (md5(str(x["id"]).encode()).hexdigest(), str(x["id"]))), size):
        state["batches"] += 1
        answer = _ask(model, state, batch)
        _take(state, batch, answer)
        left = [x for x in batch if str(x["id"]) not in answer]
        if left:  # once more, then each by itself
            again = _ask(model, state, left)
            _take(state, left, again)
            answer |= again
        for x in batch:
            number = answer.get(str(x["id"]))
            if number is None:
                number = str(state["next"])
                state["clusters"][number], state["sizes"][number] = f"report {x['id']}", 0
                state["next"] += 1
            state["sizes"][number] += 1
            out.append((str(x["id"]), number, state["batches"]))
        gone = compact(state, most)
        out = [(i, gone.get(c, c), b) for i, c, b in out] if gone else out
    return out


def cluster_apps(reports: DataFrame, make: Callable[[], Model] = ByLabel, size: int = 50, most: int = 400) -> DataFrame:
    """app, id, cluster_id ("app__Cn"), batch_no. reports: app, id, text, label; an app is one sequence, as every batch
    sees the clusters of those before. One task gets an app's ids and what the model reads of its items."""
    read = ["id", *getattr(make(), "reads", ("text", "label"))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        app = pdf["app"].iloc[0]
        rows = grow(pdf[read].to_dict("records"), empty_state(), make(), size, most)
        return pd.DataFrame([(app, i, f"{app}__C{c}", b) for i, c, b in rows], columns=["app", "id", "cluster_id", "batch_no"])

    return reports.select("app", *read).groupBy("app").applyInPandas(run, ASSIGNED)


def packed(state: dict) -> str:
    return json.dumps(state, ensure_ascii=False)
