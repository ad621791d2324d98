"""Clusters in batches: overflow, repair, compaction, and a stream that starts again from its state."""

from sightline.operators import iterative as it
from sightline.streaming import clusters


def items(n, labels):
    return [{"id": str(i), "text": "t", "label": f"L{i % labels}"} for i in range(n)]


def groups(rows):
    out = {}
    for i, c, *_ in rows:
        out.setdefault(c, set()).add(i)
    return {frozenset(x) for x in out.values()}


def test_batches_and_labels():
    assert [len(b) for b in it.batches(items(104, 3), 50)] == [50, 54] and [len(b) for b in it.batches(items(105, 3), 50)] == [50, 50, 5] and it.batches([], 50) == []
    rows = it.grow(items(120, 7), it.empty_state(), it.ByLabel(), 20)
    assert groups(rows) == {frozenset(str(i) for i in range(120) if i % 7 == k) for k in range(7)} and max(b for *_, b in rows) == 6


def test_overflow_is_halved_and_gaps_are_repaired():
    class Short(it.ByLabel):
        def __init__(self):
            self.sizes, self.asked = [], {}

        def assign(self, state, batch):
            if len(batch) > 6:
                raise it.TooLong
            self.sizes.append(len(batch))
            for x in batch:
                self.asked[x["id"]] = self.asked.get(x["id"], 0) + 1
            # leaves out every fifth the first time, number 3 always
            return {k: v for k, v in super().assign(state, batch).items() if k != "3" and (int(k) % 5 or self.asked[k] > 1)}

    model = Short()
    rows = it.grow(items(40, 4), it.empty_state(), model, 20)
    want = {frozenset(str(i) for i in range(40) if i % 4 == k and i != 3) for k in range(4)} | {frozenset({"3"})}
    assert groups(rows) == want and max(model.sizes) <= 6

    class Never(it.ByLabel):
        def assign(self, state, batch):
            raise it.TooLong

    assert len(groups(it.grow(items(5, 1), it.empty_state(), Never(), 2))) == 5


def test_compaction_unites_clusters_of_one_summary():
    class Loud(it.ByLabel):
        def assign(self, state, batch):
            return {x["id"]: x["label"].upper() if int(x["id"]) % 2 else x["label"].lower() for x in batch}

    state = it.empty_state()
    rows = it.grow(items(40, 2), state, Loud(), 10, most=2)
    assert len(groups(rows)) == 2 and len(state["clusters"]) == 2 and sum(state["sizes"].values()) == 40


def test_table_and_stream_agree_and_the_stream_goes_on(spark, tmp_path):
    schema = "app string, id string, text string, label string"
    row = lambda app, x: (app, x["id"], x["text"], x["label"])
    first = spark.createDataFrame([row(a, x) for a in ("p", "q") for x in items(30, 3)], schema)
    later = spark.createDataFrame([row("p", {"id": f"9{i}", "text": "", "label": f"L{i % 4}"}) for i in range(12)], schema)
    src, out, checkpoint = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for rows in (first, later):
        rows.coalesce(1).write.mode("append").parquet(src)
        clusters.keep_clusters(spark.readStream.schema(schema).parquet(src), out, checkpoint, size=10).awaitTermination(120)
    got = {(r["app"], r["id"]): (r["cluster_id"], r["batch_no"]) for r in spark.read.parquet(out).collect()}
    assert len(got) == 72
    table = {(r["app"], r["id"]): (r["cluster_id"], r["batch_no"]) for r in it.cluster_apps(first, size=10).collect()}
    assert {k: got[k] for k in table} == table
    old = {label: got["p", str(label)][0] for label in range(3)}
    for i in range(12):
        cluster, batch = got["p", f"9{i}"]
        assert (cluster == old.get(i % 4) if i % 4 < 3 else cluster not in old.values()) and batch > 3
    assert it.cluster_apps(first.where("false")).count() == 0
