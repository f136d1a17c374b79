"""Operators that go by blocks of ids give what a window over the whole key gives, across many blocks, null keys and null values."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.operators import frames as f


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(f, "BLOCK_IDS", 4)
    rng = random.Random(5)
    ids = rng.sample(range(-20, 200), 90)
    data = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1, 2, 30])) for i in ids] + [(999, "alone", None)]
    return spark.createDataFrame(data, "id long, key string, v long").repartition(5)


def same(got, want):
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


def test_previous(rows):
    want = rows.withColumn("p", F.lag("v").over(Window.partitionBy("key").orderBy("id")))
    same(f.previous(rows, ["key"], f.id_block(F.col("id")), "id", "v", "p"), want)


def test_running_sum(rows):
    v = F.coalesce("v", F.lit(0))
    want = rows.withColumn("total", F.sum(v).over(Window.partitionBy("key"))).withColumn("run", F.sum(v).over(Window.partitionBy("key").orderBy("id")))
    same(f.running_sum(rows, ["key"], f.id_block(F.col("id")), "id", "v", "run"), want)


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_numbered(rows, keys):
    """Falling by hundreds, then by id; both levels of blocks are crossed."""
    tier, order = -F.floor(F.col("id") / 50), [F.col("id").desc()]
    want = rows.withColumn("total", F.count("*").over(Window.partitionBy(*keys))).withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    same(f.numbered(rows, tier, order, keys=keys, inner=-f.id_block(F.col("id"))), want)


def test_empty(spark):
    none = spark.createDataFrame([], "id long, key string, v long")
    block = f.id_block(F.col("id"))
    assert f.previous(none, ["key"], block, "id", "v", "p").count() == 0
    assert f.running_sum(none, ["key"], block, "id", "v", "run").count() == 0
    assert f.numbered(none, block, [F.col("id")], keys=("key",)).count() == 0
