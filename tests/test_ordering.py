import random

from pyspark.sql import functions as F

from loomwright.operators import corpus, monitor
from loomwright.operators.ordering import ordered_index, overlapping_chunks


def rows(n, hot, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else f"g{rng.randrange(5)}", i, rng.randrange(50)) for i in rng.sample(range(10 * n), n)]


def test_index_and_offset_match_a_plain_loop(spark):
    data = rows(3000, 0.4)
    df = spark.createDataFrame(data, "g string, k long, w long")
    got = {(r.g, r.k): (r.idx, r.offset) for r in ordered_index(df, ["k"], ["g"], weight="w").collect()}
    seen, total, want = {}, {}, {}
    for g, k, w in sorted(data):
        want[g, k] = (seen.get(g, 0), total.get(g, 0))
        seen[g] = seen.get(g, 0) + 1
        total[g] = total.get(g, 0) + w
    assert got == want


def test_global_index_with_null_group_and_weight(spark):
    df = spark.createDataFrame([(None, 1, 2), (None, 2, None), ("a", 1, 5)], "g string, k long, w long")
    got = {(r.g, r.k): (r.idx, r.offset) for r in ordered_index(df, ["k"], ["g"], weight="w").collect()}
    assert got == {(None, 1): (0, 0), (None, 2): (1, 2), ("a", 1): (0, 0)}
    flat = spark.range(1000).withColumn("k", 999 - F.col("id"))
    assert all(r.idx == r.k for r in ordered_index(flat, ["k"]).collect())


def test_chunks_carry_the_rows_before(spark):
    df = spark.createDataFrame([("a", i) for i in range(25)] + [("b", i) for i in range(3)], "g string, k long")
    chunks, part = overlapping_chunks(df, ["k"], ["g"], lookback=2, chunk_rows=10)
    assert part == ["g", "_chunk"]
    found = {}
    for r in chunks.collect():
        found.setdefault((r.g, r._chunk), []).append((r.k, r._lead))
    assert sorted(found["a", 1]) == [(8, True), (9, True)] + [(i, False) for i in range(10, 20)]
    assert sorted(k for k, lead in sum(found.values(), []) if not lead) == sorted([*range(25), *range(3)])


def test_shards_are_even_and_may_be_empty(spark):
    def sizes(n, shards):
        df = corpus.contiguous_shard(spark.range(n).withColumnRenamed("id", "idx"), F.lit(n), shards)
        return [r["count"] for r in df.groupBy("shard").count().orderBy("shard").collect()]

    assert sizes(10, 4) == [3, 3, 2, 2]
    assert sizes(3, 5) == [1, 1, 1]


def test_blocks_hold_the_whole_stream(spark):
    rng = random.Random(3)
    seqs = [[rng.randrange(100) for _ in range(rng.choice([1, 2, 7, 40]))] for _ in range(60)]
    df = spark.createDataFrame(
        [(i % 2, f"c{i % 2}", i // 2, s, len(s)) for i, s in enumerate(seqs)],
        "corpus_ord int, corpus string, idx long, input_ids array<int>, length long",
    )
    stream = [t for half in (0, 1) for s in seqs[half::2] for t in s]
    for size in (1, 8, 33):
        got = {r.block_id: r.input_ids for r in corpus.pack_blocks(df, size).collect()}
        assert got == {b: stream[b * size : (b + 1) * size] for b in range(len(stream) // size)}
    assert corpus.pack_blocks(df, len(stream) + 1).count() == 0


def test_batches_differ_by_epoch_and_drop_the_rest(spark):
    df = spark.range(25).withColumnRenamed("id", "k")
    got = corpus.shuffled_batches(df, "k", epochs=2, batch_size=4, seed=1).collect()
    assert len(got) == 48
    order = [[r.k for r in sorted(got, key=lambda r: (r.batch_id, r.pos)) if r.epoch == e] for e in (0, 1)]
    assert order[0] != order[1]
    assert corpus.training_plan(25, 4, 2, 0.05) == {"total_steps": 14, "warmup_steps": 1}


def test_exact_quantiles(spark):
    """Places as the definition gives them, for sizes around the steps, ties, NULLs, and one group with nearly all rows."""
    rng = random.Random(6)
    groups = {f"g{n}": [rng.choice([0.5, rng.random()]) for _ in range(n)] for n in (1, 2, 3, 10, 19, 20, 21, 2_000)} | {"none": []}
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.low, r.half, r.high) for r in monitor.exact_quantiles(df, "g", "v", {"low": 0.0, "half": 0.5, "high": 0.95}).collect()}
    at = lambda values, q: sorted(values)[max(len(values) - int(len(values) - q * len(values)), 1) - 1]
    assert got == {g: tuple(at(v, q) for q in (0.0, 0.5, 0.95)) if v else (None,) * 3 for g, v in groups.items()}
