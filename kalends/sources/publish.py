"""Publishing a catalog of several tables at once: staged and checked in the same jobs, then shown by one commit, which can be taken back."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Published:
    """What became of a candidate: its version if it is the current one now, and its faults by table and rule with their numbers of rows."""

    version: str | None
    faults: dict[str, int] = field(default_factory=dict)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, root: str) -> list[dict]:
    """The commits of a catalog, oldest first; there is one for each publication, so that they are few."""
    place, files = _place(spark, f"{root}/commits")
    if not files.exists(place):
        return []
    names = sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().endswith(".json"))
    texts = spark.read.text([f"{root}/commits/{n}" for n in names], wholetext=True).withColumn("n", F.element_at(F.split(F.input_file_name(), "/"), -1)).orderBy("n").collect() if names else []
    return [json.loads(r["value"]) | {"n": int(r["n"].removesuffix(".json"))} for r in texts]


def _commit(spark: SparkSession, root: str, version: str, tables: list[str], seen: int) -> None:
    """Shows a version: a file of the next number, put in place by one rename. A number that is taken by now is another's publication."""
    text = json.dumps({"version": version, "tables": sorted(tables)})
    (staged, files), (target, _) = _place(spark, f"{root}/commits/.{uuid.uuid4().hex}"), _place(spark, f"{root}/commits/{seen + 1:012d}.json")
    out = files.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(target) or not files.rename(staged, target):
        files.delete(staged, True)
        raise RuntimeError(f"{root} has been published by another since")


def stage(tables: dict[str, DataFrame], root: str, rules: dict[str, dict[str, Column]]) -> tuple[str, dict[str, int]]:
    """(version, faults): writes tables to a version's own folder, which no reader sees yet; rows that break rules are counted as they are written."""
    version, faults = uuid.uuid4().hex, {}
    for name, df in tables.items():
        seen, checks = Observation(), rules.get(name, {})
        counts = [F.count(F.when(~F.coalesce(rule, F.lit(True)), 1)).alias(rule_name) for rule_name, rule in checks.items()]
        (df.observe(seen, *counts) if counts else df).write.parquet(f"{root}/versions/{version}/{name}")
        faults |= {f"{name}.{rule}": n for rule, n in (seen.get if counts else {}).items() if n}
    return version, faults


def _load(spark: SparkSession, root: str, version: str, tables: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/versions/{version}/{name}") for name in tables}


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, rules: dict[str, dict[str, Column]] | None = None, between: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None) -> Published:
    """Makes tables the current catalog if none of them has a fault; otherwise every table stays as it was.

    `rules` are columns by table and name that hold for every row (null holds), counted in the job that writes the table.
    `between` gives faulty rows by name from all tables together, such as references that lead nowhere; it reads what was
    staged, so what is checked is what will be shown. A job that dies before the commit leaves only a folder that nothing refers
    to (`clean`). Two publications at once don't mix: the later commit fails.
    """
    commits = _commits(spark, root)
    version, faults = stage(tables, root, rules or {})
    if not faults and between:
        faults = {name: n for name, df in between(_load(spark, root, version, list(tables))).items() if (n := df.count())}
    if faults:
        place, files = _place(spark, f"{root}/versions/{version}")
        files.delete(place, True)
        return Published(None, faults)
    _commit(spark, root, version, list(tables), commits[-1]["n"] if commits else 0)
    return Published(version)


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the current catalog, of one version; none before the first publication."""
    commits = _commits(spark, root)
    return _load(spark, root, commits[-1]["version"], commits[-1]["tables"]) if commits else {}


def roll_back(spark: SparkSession, root: str) -> str:
    """Shows the version before the current one again, all tables together; the commits stay as a record. Gives that version."""
    commits = _commits(spark, root)
    shown = commits[-1]["version"] if commits else None
    first = next((n for n, c in enumerate(commits) if c["version"] == shown), 0)
    if not first:
        raise ValueError(f"{root} has no earlier version")
    before = commits[first - 1]
    _commit(spark, root, before["version"], before["tables"], commits[-1]["n"])
    return before["version"]


def clean(spark: SparkSession, root: str) -> list[str]:
    """Deletes the folders of versions that no commit names, as failed publications leave; not to be run beside one."""
    known = {c["version"] for c in _commits(spark, root)}
    place, files = _place(spark, f"{root}/versions")
    found = sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []
    gone = [v for v in found if v not in known]
    for v in gone:
        files.delete(_place(spark, f"{root}/versions/{v}")[0], True)
    return gone
