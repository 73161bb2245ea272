"""State tables: only touched parts are rewritten, lost writers leave nothing, numbers count once."""

import os

from pyspark.sql import functions as F

from linkloom.sources.statetables import StateTable

SCHEMA = "k string, v long"


def put(table, rows, **options):
    def newest(old, changes):
        both = old.unionByName(changes)
        return both.groupBy("k").agg(F.max("v").alias("v")).filter("v >= 0")

    return table.upsert(table.spark.createDataFrame(rows, SCHEMA), newest, **options)


def content(table, version=None):
    return {r.k: r.v for r in table.read(version).collect()}


def test_only_touched_parts_are_written(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/t", "k", SCHEMA, parts=32)
    assert content(table) == {} and table.versions() == []
    put(table, [(f"k{i}", i) for i in range(500)])
    before = table.manifest()["parts"]
    put(table, [("k7", 700), ("new", 1)])
    after = table.manifest()["parts"]
    changed = {p for p in after if after[p] != before.get(p)}
    assert len(changed) <= 2 and len(after) == 32
    want = {f"k{i}": i for i in range(500)} | {"k7": 700, "new": 1}
    assert content(table) == want
    near = table.near(spark.createDataFrame([("k7", 0)], SCHEMA)).count()
    assert 0 < near < 100


def test_an_emptied_part_is_gone(spark, tmp_path):
    def drop(old, changes):
        return old.join(changes.select("k"), "k", "left_anti")

    table = StateTable(spark, f"{tmp_path}/t", "k", SCHEMA, parts=4)
    put(table, [("a", 1)])
    table.upsert(spark.createDataFrame([("a", 0)], SCHEMA), drop)
    assert content(table) == {} and table.manifest()["parts"] == {}


def test_numbers_count_once_per_job(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/t", "k", SCHEMA)
    for job, number, v in (("x", 0, 1), ("x", 0, 5), ("y", 0, 2), ("x", 1, 3), ("x", 0, 9)):
        put(table, [(job, v)], job=job, number=number)
    assert content(table) == {"x": 3, "y": 2} and table.manifest()["version"] == 3
    assert (table.applied("x"), table.applied("y"), table.applied("z")) == (1, 0, -1)


def test_nothing_to_change(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/t", "k", SCHEMA)
    put(table, [("a", 1)])
    put(table, [(None, 4)], job="x", number=3)
    assert content(table) == {"a": 1} and table.applied("x") == 3


def test_a_writer_that_comes_second_tries_again(spark, tmp_path):
    table, other = (StateTable(spark, f"{tmp_path}/t", "k", SCHEMA) for _ in range(2))
    put(table, [("a", 1)])
    calls = []

    def interrupted(old, changes):
        if not calls:
            put(other, [("b", 2)])  # commits while this one is at work
        calls.append(1)
        return old.unionByName(changes)

    table.upsert(spark.createDataFrame([("c", 3)], SCHEMA), interrupted)
    assert len(calls) == 2 and content(table) == {"a": 1, "b": 2, "c": 3}


def test_lost_writers_and_old_versions_leave_nothing(spark, tmp_path):
    table = StateTable(spark, f"{tmp_path}/t", "k", SCHEMA, parts=2, keep=2)
    put(table, [("a", 1)])
    spark.createDataFrame([("lost", 1)], SCHEMA).write.parquet(f"{tmp_path}/t/data/{1:020d}-lost/part=0")
    for v in range(2, 6):
        put(table, [("a", v)])
    assert content(table) == {"a": 5} and content(table, table.versions()[0]) == {"a": 4}
    assert len(table.versions()) == 2 and len(os.listdir(f"{tmp_path}/t/data")) == 2
