"""Where the inputs of a run lie: folders of applications, files of clusters, settings. Paths are those of any store that
Spark can read; only names and small settings files come to the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

#: Fixed value: kinds of clusters, the most wanted first.
CLUSTER_KINDS = ("sbert", "tfidf", "llm")
LEVELS = 6


class Folder:
    """The entries of a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, spark._jvm.org.apache.hadoop.fs.Path(path)
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.store.exists(self.path)

    def names(self, folders: bool | None = None) -> list[str]:
        """Sorted names; of folders or of files alone where asked for."""
        if not self.exists():
            return []
        found = self.store.listStatus(self.path)
        return sorted(s.getPath().getName() for s in found if folders is None or s.isDirectory() == folders)

    def child(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path.toString().rstrip('/')}/{name}")

    def parent(self) -> Folder | None:
        above = self.path.getParent()
        return None if above is None else Folder(self.spark, above.toString())

    def text(self) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(self.path.toString(), wholetext=True).collect())


def escaped(name: str, digits: int = 4) -> str:
    """A name as archives write it: characters beyond ASCII as #U and at least so many hexadecimal digits."""
    return "".join(c if c.isascii() else f"#U{ord(c):0{digits}x}" for c in name)


def app_folder(spark: SparkSession, root: str, app: str) -> str:
    """The folder of an application: under its own name, or under its escaped one, whose digits may be padded or not."""
    have = set(Folder(spark, root).names(folders=True))
    for name in (app, escaped(app), escaped(app, 1)):
        if name in have:
            return f"{root.rstrip('/')}/{name}"
    raise FileNotFoundError(f"no folder for {app!r} under {root}")


def clusters_file(spark: SparkSession, start: str, k: int) -> str | None:
    """The clusters of a run, from any folder within it: clusters/clusters_*_K{k}.csv, else clusters/clusters_*.csv, of
    the most wanted kind and, of these, the last by name; None if there is none."""
    here: Folder | None = Folder(spark, start)
    for _ in range(LEVELS):
        if here is None or here.child("clusters").exists():
            break
        here = here.parent()
    names = here.child("clusters").names(folders=False) if here else []
    names = [n for n in names if n.startswith("clusters_") and n.endswith(".csv")]
    names = [n for n in names if n.endswith(f"_K{k}.csv")] or names
    wanted = lambda n: next((len(CLUSTER_KINDS) - i for i, kind in enumerate(CLUSTER_KINDS) if kind in n.lower()), 0)
    return here.child("clusters").child(max(names, key=lambda n: (wanted(n), n))).path.toString() if names else None


def few_shot(spark: SparkSession, path: str | None) -> dict:
    """Examples for a model from a JSON file; none where it is missing or no JSON object."""
    if not path or not Folder(spark, path).exists():
        return {}
    try:
        found = json.loads(Folder(spark, path).text())
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


@dataclass(frozen=True)
class ModelSettings:
    """How to reach a model. The defaults are fixed values."""

    key: str
    name: str
    temperature: float = 0.2
    max_tokens: int = 5000
    concurrency: int = 5
    timeout: int = 30
    max_retries: int = 2

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ModelSettings:
        """From the section `model` of a JSON or, where the library is installed, YAML file; ValueError says what is wrong."""
        if not Folder(spark, path).exists():
            raise ValueError(f"no settings at {path}")
        text = Folder(spark, path).text()
        try:
            if path.endswith(".json"):
                found = json.loads(text)
            else:
                import yaml

                found = yaml.safe_load(text)
            model = (found or {}).get("model") or {}
            given = {f.name: type(f.default)(model[f.name]) for f in fields(cls) if f.name in model and f.name not in ("key", "name")}
        except ImportError:
            raise
        except Exception as wrong:
            raise ValueError(f"settings at {path} can't be read: {wrong}") from wrong
        if not model.get("key") or not model.get("name"):
            raise ValueError(f"settings at {path} need a key and a name")
        return cls(key=str(model["key"]), name=str(model["name"]), **given)
