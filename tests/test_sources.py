"""Locating inputs, settings, raw scans and the sinks behind them."""

import json

import pytest
from pyspark.sql import functions as F

from sightline.operators import backend
from sightline.sources import locate, readers, sinks


def test_app_folders(spark, tmp_path):
    for name in ("plain", "#U6caaapp", "#U00e9t", "#Ue8s"):
        (tmp_path / name).mkdir()
    (tmp_path / "file").write_text("x")
    found = [locate.app_folder(spark, f"{tmp_path}/", app).rsplit("/", 1)[1] for app in ("plain", "沪app", "ét", "ès")]
    assert found == ["plain", "#U6caaapp", "#U00e9t", "#Ue8s"]
    for app in ("file", "other", ""):
        with pytest.raises(FileNotFoundError):
            locate.app_folder(spark, str(tmp_path), app)


def test_clusters_file(spark, tmp_path):
    deep = tmp_path / "run" / "a" / "b"
    deep.mkdir(parents=True)
    assert locate.clusters_file(spark, str(tmp_path / "run" / "a"), 20) is None
    own = tmp_path / "run" / "clusters"
    own.mkdir()
    name = lambda: (locate.clusters_file(spark, str(deep), 20) or "").rsplit("/", 1)[-1]
    assert name() == ""
    for new, want in (("clusters_x.csv", "clusters_x.csv"), ("clusters_llm_K20.csv", "clusters_llm_K20.csv"), ("clusters_SBERT_K9.csv", "clusters_llm_K20.csv"), ("clusters_tfidf_K20.csv", "clusters_tfidf_K20.csv"), ("clusters_tfidfb_K20.csv", "clusters_tfidfb_K20.csv"), ("clusters_sbert_K20.csv", "clusters_sbert_K20.csv")):
        (own / new).write_text("app,id\n")
        assert name() == want


def test_few_shot_and_settings(spark, tmp_path):
    good, bad, empty = tmp_path / "a.json", tmp_path / "b.json", tmp_path / "c.json"
    good.write_text(json.dumps({"model": {"key": "k", "name": "m", "timeout": "7"}}))
    bad.write_text("{")
    empty.write_text(json.dumps({"model": {"name": "m"}}))
    load = lambda p: locate.ModelSettings.load(spark, str(p))
    assert locate.few_shot(spark, str(good))["model"]["name"] == "m"
    assert [locate.few_shot(spark, p) for p in (None, "", str(bad), str(tmp_path / "none.json"))] == [{}] * 4
    assert load(good) == locate.ModelSettings("k", "m", timeout=7)
    for path in (bad, empty, tmp_path / "none.json"):
        with pytest.raises(ValueError, match="settings"):
            load(path)


def test_raw_scan_and_sheets(spark, tmp_path):
    rows = [(" ", "1.0", " k ", "one"), ("app", "2", None, None), (None, None, "k", " two ")]
    df = spark.createDataFrame(rows, "app string, id string, issue_key string, text string").withColumn("sheet", F.lit("old"))
    raw = readers.raw_scan(df, F.lit("s"))
    got = [tuple(r) for r in raw.select("app", "sheet", "id_norm", "issue_key_norm", "text_used", "text_col_used").collect()]
    assert sorted(got, key=str) == sorted([("s", "s", "1", "k", "one", "text"), ("app", "s", "2", "", "", "text"), ("s", "s", None, "k", "two", "text")], key=str)
    sinks.write_sheets(raw, raw.where("id_norm = '1'"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert [r.asDict() for r in back.collect()] == [{"app": "s", "id": "1.0", "issue_key": " k ", "text": "one", "sheet": "s"}]
    with pytest.raises(ValueError, match="missing columns"):
        readers.raw_scan(df.drop("issue_key"), F.lit("s"))
    assert readers.raw_scan(df.limit(0), F.lit("s")).count() == 0


def test_defects_are_optional(spark, tmp_path):
    assert readers.FileProvider(spark, "n", "e").defects() is None
    assert readers.FileProvider(spark, "n", "e", str(tmp_path / "none.csv")).defects() is None
    (tmp_path / "d.csv").write_text("id,description,more\n1,broken,x\n")
    assert [tuple(r) for r in readers.FileProvider(spark, "n", "e", str(tmp_path / "d.csv")).defects().collect()] == [("1", "broken")]


def test_log_of_calls(spark, tmp_path):
    rows = spark.createDataFrame([("1", "Login Button."), ("2", "none")], "id string, text string")
    for _ in range(2):
        sinks.append_log(backend.model_column(rows, "extract"), "extract", str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and {(r["conversation_id"], r["success"], r["task"]) for r in log.collect()} == {("1", True, "extract"), ("2", True, "extract")}
    assert json.loads(log.where("conversation_id = '1'").first()["request"]) == {"id": "1", "text": "Login Button."}
