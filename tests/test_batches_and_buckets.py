"""Batches by a keyed permutation, and logits in buckets."""

import pytest
from pyspark.sql import functions as F

from loomwright.operators import corpus, distill


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 99, 100, 101, 1000, 4097])
def test_every_epoch_is_a_permutation(spark, n):
    rows = spark.range(n).select("id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(9))).alias("epoch"))
    got = rows.select("epoch", "id", corpus.permuted_place(F.col("id"), n, F.col("epoch"), 3).alias("at")).collect()
    orders = {}
    for r in got:
        orders.setdefault(r["epoch"], {})[r["id"]] = r["at"]
    assert all(sorted(o.values()) == list(range(n)) for o in orders.values())
    if n >= 99:
        for o in orders.values():
            mean = (n - 1) / 2
            together = sum((i - mean) * (at - mean) for i, at in o.items()) / sum((i - mean) ** 2 for i in o)
            assert abs(together) < 4 / n**0.5
        assert sum(orders[0][i] == orders[1][i] for i in range(n)) < 12


def test_resumed_batches_and_no_exchange(spark):
    indexed = spark.range(103).select(F.col("id").alias("key"), F.col("id").alias("idx"))
    whole = corpus.permuted_batches(indexed, 103, "key", 3, 10, seed=1)
    rest = corpus.permuted_batches(indexed, 103, "key", 3, 10, seed=1, done=14)
    assert {tuple(r) for r in whole.collect() if r["epoch"] * 10 + r["batch_id"] >= 14} == set(map(tuple, rest.collect()))
    assert whole.count() == 300
    assert corpus.permuted_batches(indexed, 103, "key", 3, 10, drop_last=False).count() == 309
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert corpus.permuted_batches(indexed.limit(0), 0, "key", 2, 10).collect() == []


def test_bucketed_join_has_no_exchange(spark, tmp_path):
    rows = [(b, e, p, [float(b), float(e), float(p)]) for b in range(3) for e in range(4) for p in range(5)]
    logits = spark.createDataFrame(rows, "batch_id long, example_id long, pos int, logits array<double>")
    for name in ("one", "two"):
        distill.write_bucketed(logits, f"bucketed_{name}", str(tmp_path / name), 4)
    joined = distill.student_teacher_join(spark.table("bucketed_one"), spark.table("bucketed_two"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {(*r[:3], *r["student"], *r["teacher"]) for r in joined.collect()} == {(*r[:3], *r[3], *r[3]) for r in rows}
    for name in ("one", "two"):
        spark.sql(f"DROP TABLE bucketed_{name}")
