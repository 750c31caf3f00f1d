"""Catalogs of several tables: all or nothing, one version for readers, and the way back."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kalends.sources import publish as P

def rules():
    return {"events": {"has-title": F.col("title").isNotNull(), "short": F.length("title") < 20}}


def tables(spark, title="Fest", place=1):
    return {"events": spark.createDataFrame([(1, title, place), (2, "Møde", 1)], "id int, title string, place int"), "places": spark.createDataFrame([(1, "Hall")], "id int, name string")}


def orphans(t):
    return {"unknown-place": t["events"].join(t["places"].select(F.col("id").alias("place")), "place", "left_anti")}


def shown(spark, root):
    return {name: sorted(map(tuple, df.collect())) for name, df in P.load(spark, root).items()}


def test_a_faulty_candidate_leaves_every_table_as_it_was(spark, tmp_path):
    root = str(tmp_path)
    assert P.load(spark, root) == {}
    assert P.publish(spark, tables(spark), root, rules(), orphans).version
    before = shown(spark, root)
    assert P.publish(spark, tables(spark, None), root, rules(), orphans).faults == {"events.has-title": 1}
    assert P.publish(spark, tables(spark, "x" * 30), root, rules()).faults == {"events.short": 1}
    assert P.publish(spark, tables(spark, "New", 9), root, rules(), orphans).faults == {"unknown-place": 1}
    assert shown(spark, root) == before
    assert len(os.listdir(f"{root}/versions")) == 1


def test_a_crash_between_stage_and_commit_shows_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = P.publish(spark, tables(spark), root).version

    def crash(*a):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(P, "_commit", crash)
        with pytest.raises(OSError, match="gone"):
            P.publish(spark, tables(spark, "New"), root)
    assert shown(spark, root)["events"][0][1] == "Fest"
    assert len(P.clean(spark, root)) == 1
    assert os.listdir(f"{root}/versions") == [first]


def test_versions_can_be_taken_back_together(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no earlier"):
        P.roll_back(spark, root)
    one = P.publish(spark, tables(spark, "One"), root).version
    two = P.publish(spark, tables(spark, "Two"), root).version
    assert (one != two, shown(spark, root)["events"][0][1]) == (True, "Two")
    assert P.roll_back(spark, root) == one
    assert shown(spark, root)["events"][0][1] == "One"
    with pytest.raises(ValueError, match="no earlier"):
        P.roll_back(spark, root)
    P.publish(spark, tables(spark, "Three"), root)
    assert P.roll_back(spark, root) == one


def test_a_publication_beside_another_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    P.publish(spark, tables(spark, "One"), root)
    stage = P.stage

    def slow(*a):
        with monkeypatch.context() as m:
            m.setattr(P, "stage", stage)
            P.publish(spark, tables(spark, "Other"), root)
        return stage(*a)

    monkeypatch.setattr(P, "stage", slow)
    with pytest.raises(RuntimeError, match="another"):
        P.publish(spark, tables(spark, "Mine"), root)
    assert shown(spark, root)["events"][0][1] == "Other"
