import math
import random
import time

import pytest
from pyspark.sql import functions as F

from loomwright.functions.arrays import position_ids
from loomwright.functions.schedule import step_weight
from loomwright.operators import corpus, distill, evaluate, features, monitor

BOS, EOS, PAD = 1, 2, 0


def examples(spark, pairs):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(pairs)], "k int, prefix_ids array<int>, target_ids array<int>")


def test_features_around_the_limit(spark):
    # with the marks: 7, 8 and 9 ids; the limit is 8
    df = examples(spark, [([10, 11], [20, 21, 22]), ([10, 11, 12], [20, 21, 22]), ([10, 11, 12, 13], [20, 21, 22]), ([], [])])
    got = features.features_train(df, 8, BOS, EOS, PAD).orderBy("k").collect()
    assert got[0].input_ids == [1, 10, 11, 20, 21, 22, 2, 0] and got[0].attention_mask == [1] * 7 + [0]
    assert got[0].labels == [-100] * 3 + [20, 21, 22, 2, -100]
    assert got[1].input_ids == [1, 10, 11, 12, 20, 21, 22, 2] and got[1].labels == [-100] * 4 + [20, 21, 22, 2]
    assert got[2].input_ids == [1, 11, 12, 13, 20, 21, 22, 2] and got[2].labels == [-100] * 4 + [20, 21, 22, 2]
    assert got[3].input_ids == [1, 2, 0, 0, 0, 0, 0, 0]
    assert all(len(r[c]) == 8 for r in got for c in ("input_ids", "attention_mask", "labels"))
    left = features.features_ppo(df, 8, BOS, EOS, PAD).orderBy("k").collect()
    assert left[0].input_ids == [0] * 5 + [1, 10, 11] and left[0].attention_mask == [0] * 5 + [1] * 3
    assert left[0].response == [0] * 4 + [20, 21, 22, 2] and left[2].response == [20, 21, 22, 2]
    only = features.features_eval(df, 4, BOS).orderBy("k").collect()
    assert [r.input_ids for r in only] == [[1, 10, 11], [1, 10, 11, 12], [1, 11, 12, 13], [1]]
    assert only[0].attention_mask == [1, 1, 1]


def softmax(z):
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def kl(p, q):
    return sum(a * math.log(a / b) for a, b in zip(p, q))


@pytest.mark.parametrize("alpha", [0.0, 0.3])
def test_losses_by_hand(spark, alpha):
    rng = random.Random(5)
    rows = [(b, e, p, [rng.gauss(0, 2) for _ in range(5)], [rng.gauss(0, 2) for _ in range(5)]) for b in range(2) for e in range(3) for p in range(2)]
    pairs = spark.createDataFrame(rows, "batch_id long, example_id long, pos int, student array<double>, teacher array<double>")
    temp = 2.0
    got = {r.batch_id: r for r in distill.kd_losses(pairs, alpha=alpha, temperature=temp, weighted=True).collect()}
    for b in range(2):
        mine = [(s, t) for bb, _, _, s, t in rows if bb == b]
        ps = [softmax([x / temp for x in s]) for s, _ in mine]
        pt = [softmax([x / temp for x in t]) for _, t in mine]
        pm = [softmax([((1 - alpha) * x + alpha * y) / temp for x, y in zip(s, t)]) for s, t in mine]
        pa = [softmax([(1 - alpha) * x / temp for x in s]) for s, _ in mine]
        w = sum(a / c for s, m in zip(ps, pm) for a, c in zip(s, m)) / (len(mine) * 5) if alpha else 1.0
        mid = [[(a + c) / 2 for a, c in zip(s, t)] for s, t in zip(ps, pt)]
        want = {
            "fkl": w * sum(map(kl, pt, pm)) / 3 * 4,
            "revkl": w * sum(map(kl, pm, pt)) / 3 * 4,
            "ce": -sum(c * math.log(a) for s, t in zip(ps, pt) for a, c in zip(s, t)) / 6,
            "mse": sum((x - y) ** 2 for s, t in mine for x, y in zip(s, t)) / 30,
            "pmse": sum((x - y) ** 2 for s, t in zip(ps, pt) for x, y in zip(s, t)) / 30,
            "js": (sum(map(kl, mid, ps)) + sum(map(kl, mid, pt))) / 2 / 3,
            "mixkl": w * sum(map(kl, pa, pt)) / 3 - w * alpha * sum(map(kl, pt, pa)) / 3,
            "imp_weight": w,
        }
        for name, value in want.items():
            assert got[b][name] == pytest.approx(value, rel=1e-9), name
        assert got[b].fkl >= 0


def test_total_loss_without_a_teacher(spark):
    clm = spark.createDataFrame([(1, 2.0)], "batch_id long, clm_loss double")
    none = spark.createDataFrame([], "batch_id long, kd_loss double")
    assert distill.kd_total_loss(clm, none, 1.0).collect()[0].total_loss == 2.0
    kd = spark.createDataFrame([(1, 6.0)], "batch_id long, kd_loss double")
    assert distill.kd_total_loss(clm, kd, 0.25).collect()[0].total_loss == 5.0
    s = spark.createDataFrame([(1, 1, 0, [1.0, 2.0])], "batch_id long, example_id long, pos int, logits array<double>")
    t = spark.createDataFrame([(1, 1, 0, [1.0])], "batch_id long, example_id long, pos int, logits array<double>")
    with pytest.raises(Exception, match="vocabularies differ"):
        distill.student_teacher_join(s, t).collect()


def test_schedule(spark):
    total, size, start = 10, 3, 0.2
    want = {
        "linear": lambda s: start * (total - s) / total,
        "exponential": lambda s: start * math.exp(math.log(0.01) * s / total),
        "step": lambda s: start * (int((total - s) / size) / int(total / size)),
        "cos": lambda s: start / 2 * (1 + math.cos(size * math.pi * s / total)),
        "const": lambda s: start,
    }
    for kind, fn in want.items():
        got = [r[0] for r in spark.range(11).select(step_weight("id", total, kind, start, size)).collect()]
        assert got == pytest.approx([fn(s) for s in range(11)])
    with pytest.raises(ValueError):
        step_weight("id", total, "other")


def test_tokens_and_slices(spark):
    df = spark.createDataFrame([(0, "pure_sql", i, t) for i, t in enumerate(["a b a", "", "A c", "?!"])], "corpus_ord int, corpus string, idx long, sequence string")
    vocab = corpus.vocabulary(df, size=corpus.FIRST_WORD_ID + 2)  # the blank and the letter a
    got = [r.input_ids for r in corpus.tokenize(df, vocab, ["corpus_ord", "corpus", "idx"]).orderBy("idx").collect()]
    assert got == [[259, 258, 100, 258, 259, 0], [0], [67, 258, 101, 0], [65, 35, 0]]
    real = corpus.tokenize_with(df, lambda texts: [[len(t)] for t in texts], ["idx"], eos=9).orderBy("idx").collect()
    assert [r.input_ids for r in real] == [[5, 9], [0, 9], [3, 9], [2, 9]] and real[0].length == 2
    five = spark.createDataFrame([(0, "pure_sql", i, 1) for i in range(5)] + [(1, "text2code", i, 1) for i in range(5)], "corpus_ord int, corpus string, idx long, length long")
    counts = {(r.corpus, r.slice): r["count"] for r in corpus.corpus_slices(five).groupBy("corpus", "slice").count().collect()}
    assert counts == {("pure_sql", 0): 4, ("pure_sql", 1): 2, ("text2code", 0): 2, ("text2code", 1): 1}


def test_tokens_give_the_text_again(spark):
    texts = ["", " a\t\n b  ", "für 12 Straßen, 日本語😀 ١٢ e\u0301!", "long" * 100, "x" * 64 + " " + "x" * 65, None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, sequence string")
    for size in (corpus.FIRST_WORD_ID, corpus.FIRST_WORD_ID + 3, corpus.VOCABULARY_SIZE):
        vocab = corpus.vocabulary(df, size=size)
        back = corpus.detokenize(corpus.tokenize(df, vocab, ["k"]), vocab, ["k"])
        assert [r.sequence for r in back.orderBy("k").collect()] == [t or "" for t in texts]


def test_every_position_and_example_has_logits(spark):
    logits = spark.createDataFrame([(0, 0, p, [1.0, 2.0], 1) for p in range(2)], "batch_id long, example_id long, pos int, logits array<float>, label int")
    for student, teacher in ((logits, logits.where("pos = 0")), (logits.where("pos = 0"), logits)):
        with pytest.raises(Exception, match="without"):
            distill.student_teacher_join(student, teacher.drop("label")).collect()
    assert distill.student_teacher_join(logits, logits.drop("label")).count() == 2
    taught = spark.createDataFrame([(0, 0, [1.0])], "k int, pos int, logits array<float>")
    with pytest.raises(Exception, match="without"):
        features.features_kd(examples(spark, [([1], [2]), ([3], [4])]), taught, 8, BOS, EOS, PAD, "k").collect()


def test_convergence_over_chunks(spark):
    rng = random.Random(2)
    losses = [rng.choice([1.0, 1.0, 1.00001, 2.0]) for _ in range(60)]
    df = spark.createDataFrame([("r", 3 * i, v) for i, v in enumerate(losses)], "run_id string, step long, value double")
    got = [r.converged for r in monitor.convergence(df, 2, 1e-4, chunk_rows=7).orderBy("step").collect()]
    want = [i >= 2 and all(abs(losses[j] - losses[j - 1]) < 1e-4 for j in (i, i - 1)) for i in range(60)]
    assert got == want and any(want)


def test_resume_and_checkpoints(spark):
    batches = spark.createDataFrame([(e, b) for e in range(3) for b in range(4)], "epoch int, batch_id int")
    left = {tuple(r) for r in monitor.resume_filter(batches, 3, 2, 4).collect()}
    assert left == {(1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)}
    quirk = {tuple(r) for r in monitor.resume_filter(batches, 3, 2, 4, skip_every_epoch=True).collect()}
    assert quirk == {(1, 2), (1, 3), (2, 2), (2, 3)}
    steps = spark.createDataFrame([("r", e, 5 * e + s) for e in range(2) for s in range(1, 6)], "run_id string, epoch int, step int")
    assert sorted(r.step for r in monitor.checkpoint_steps(steps, 4).collect()) == [4, 5, 8, 10]


ROWS = {1: ("ok", [(1, "x")], [(1, "x"), (1, "x")]), 2: ("ok", [], []), 3: ("ok", [(1, None)], [(1, None)]), 4: ("ok", [(1, "x")], [(2, "x")]), 5: ("error", [], [(1, "x")]), 6: ("gold_error", [], [])}


def test_result_sets(spark):
    items = spark.createDataFrame([(i, s) for i, (s, _, _) in ROWS.items()], "item_id long, status string")
    kinds = "item_id long, row_no long, a {}, b string"

    def side(which, at, number):
        rows = [(i, n, r[0], r[1]) for i, v in ROWS.items() for n, r in enumerate(v[at])]
        df = spark.createDataFrame(rows, kinds.format("int")).withColumn("a", F.col("a").cast(number))
        return evaluate.result_rows(df, which, F.col("item_id"), F.col("row_no"), ["a", "b"])

    results = side("pred", 1, "double").unionByName(side("gold", 2, "int"))  # 1.0 equals 1
    scored = evaluate.result_set_equality(items, results)
    assert {r.item_id: r.correct for r in scored.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: None}
    total = evaluate.execution_accuracy(scored).collect()[0]
    assert (total.accuracy, total.n_items, total.n_scored, total.n_errors, total.n_gold_errors) == (0.6, 6, 5, 1, 1)
    one, text = spark.sql("select 1 a"), spark.sql("select '1' a")
    assert evaluate.same_rows(one, spark.sql("select 1.0D z union all select 1")) and not evaluate.same_rows(one, text)
    assert not evaluate.same_rows(one, spark.sql("select 1 a, 1 b")) and not evaluate.same_rows(spark.sql("select 'a' x, 'bc' y"), spark.sql("select 'ab' x, 'c' y"))


def test_queries_are_run_and_failures_kept(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    todo = [
        {"item_id": 1, "pred_sql": "select id from numbers order by id desc", "gold_sql": "select id from numbers"},
        {"item_id": 2, "pred_sql": "select nothing from nowhere", "gold_sql": "select 1"},
        {"item_id": 3, "pred_sql": "select 1", "gold_sql": "selec 1"},
        {"item_id": 4, "pred_sql": "select id from numbers where id > 2", "gold_sql": "select id from numbers"},
    ]
    status, rows = evaluate.run_queries(spark, todo, parallel=2)
    scored = evaluate.result_set_equality(status, rows)
    assert {r.item_id: (r.status, r.correct) for r in scored.collect()} == {1: ("ok", 1), 2: ("error", 0), 3: ("gold_error", None), 4: ("ok", 0)}
    report = evaluate.mismatch_report(scored, rows)
    assert report.count() == 8  # five gold and two predicted rows of item 4, the gold row of item 2
    assert {"question", "pred_sql", "gold_sql"} <= set(report.columns)


def test_slow_queries_are_cut_off(spark):
    slow = "select count(*) from range(3000000) a join range(3000000) b on a.id % 2 = b.id % 2"
    todo = [{"item_id": i, "pred_sql": slow, "gold_sql": "select 1"} for i in range(2)]
    todo.append({"item_id": 2, "pred_sql": "select 1", "gold_sql": "select 1"})
    began = time.monotonic()
    status, rows = evaluate.run_queries(spark, todo, time_limit=3)
    assert time.monotonic() - began < 40
    scored = evaluate.result_set_equality(status, rows)
    assert {r.item_id: (r.status, r.correct) for r in scored.collect()} == {0: ("timeout", 0), 1: ("timeout", 0), 2: ("ok", 1)}


def test_numbers_are_compared_exactly(spark):
    def same(x, y):
        return evaluate.same_rows(spark.sql(f"select {x}"), spark.sql(f"select {y}"))

    assert same("1", "1.0D") and same("cast(1e18 as bigint)", "1e18D") and same("1.50BD", "1.5D") and same("-0.0D", "0")
    assert same("cast('1180591620717411303424' as decimal(38,0))", "1180591620717411303424D")
    assert same("4611686018427387904", "4611686018427387904D") and not same("4611686018427387905", "4611686018427387904D")
    close = "cast('12345678901234567890.0{}' as decimal(38,2))"
    assert not same(close.format(1), close.format(2)) and same(close.format(1), close.format(1))
    assert same("cast('0.0000000001' as decimal(20,10))", "1e-10D") and not same("1e-10D", "1e-11D")
    assert same("double('NaN')", "float('NaN')") and not same("double('inf')", "double('-inf')") and not same("'1'", "1")
    assert same("1e300D", "1e300D") and not same("1e300D", "1e299D") and same("true", "1") and same("1000", "1e3D")


def test_sweep(spark):
    grid = spark.createDataFrame([(0.1, 1), (0.1, 1), (0.2, 1)], "alpha double, ckpt int")
    board = evaluate.sweep_leaderboard(grid, spark.createDataFrame([(0.1, 1, 0.5), (0.1, 1, 0.7)], "alpha double, ckpt int, value double"))
    assert {(r.alpha, r.score and round(r.score, 6), r.n_results) for r in board.collect()} == {(0.1, 0.6, 2), (0.2, None, 0)}
    assert evaluate.best_run(board).collect()[0].alpha == 0.1


def test_scheduled_losses_are_those_of_each_step(spark):
    draw = random.Random(4)
    rows = [(b, b * 2 + e, p, [draw.gauss(0, 1) for _ in range(5)], [draw.gauss(0, 1) for _ in range(5)])
            for b in range(4) for e in range(2) for p in range(3)]
    pairs = spark.createDataFrame(rows, "batch_id long, example_id long, pos int, student array<double>, teacher array<double>")
    clm = spark.createDataFrame([(b, 1.0 + b) for b in range(4)], "batch_id long, clm_loss double")
    steps = [(0, 0.0, 1.0), (1, 0.2, 0.5), (2, 0.9, 0.0)]  # batch 3 has no step
    schedule = spark.createDataFrame(steps, "batch_id long, alpha double, beta double")
    for kind in ("fkl", "mixkl"):
        got = {r.batch_id: r for r in distill.kd_scheduled(pairs, clm, schedule, kind, 2.0, weighted=True).collect()}
        assert sorted(got) == [0, 1, 2]
        for b, alpha, beta in steps:
            one = distill.kd_losses(pairs.where(F.col("batch_id") == b), (kind,), alpha, 2.0, weighted=True).first()[kind]
            assert math.isclose(got[b].kd_loss, one, rel_tol=1e-12) and got[b].alpha == alpha
            assert math.isclose(got[b].total_loss, beta * (1.0 + b) + (1 - beta) * one, rel_tol=1e-12)
    assert distill.kd_scheduled(pairs, clm, schedule.limit(0)).collect() == []


def test_running_sums_and_position_ids(spark):
    for n in (0, 1, 2, 3, 7, 64, 65, 100_000):
        mask = [int(i % 5 > 0) for i in range(n)]
        df = spark.createDataFrame([(mask,)], "m array<int>")
        want, seen = [], 0
        for m in mask:
            seen += m
            want.append(seen - 1 if m else 1)
        assert df.select(position_ids(F.col("m"))).first()[0] == want


def test_every_slice_is_packed_on_its_own(spark):
    rows = [(0, "a", i, [10 * i + k for k in range(i % 4)], i % 4) for i in range(12)]
    tokens = spark.createDataFrame(rows, "corpus_ord int, corpus string, idx long, input_ids array<int>, length long")
    cuts = spark.createDataFrame([(0, 12), (1, 7), (2, 0)], "slice int, cut long")
    sliced = tokens.join(cuts, F.col("idx") < F.col("cut")).drop("cut")
    got = {(r.slice, r.block_id): r.input_ids for r in corpus.pack_blocks(sliced, 4, ["slice"]).collect()}
    for s, cut in ((0, 12), (1, 7), (2, 0)):
        stream = [x for r in rows[:cut] for x in r[3]]
        blocks = {(s, k): stream[4 * k : 4 * k + 4] for k in range(len(stream) // 4)}
        assert {k: v for k, v in got.items() if k[0] == s} == blocks
