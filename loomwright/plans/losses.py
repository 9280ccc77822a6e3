"""Queries: losses from logged logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions.logits import as_doubles, log_softmax, masked_softmax, mix_logits, softmax
from loomwright.functions.schedule import KINDS as SCHEDULES
from loomwright.functions.schedule import step_weight
from loomwright.operators import distill, features
from loomwright.plans import inputs
from loomwright.plans.corpora import BOS, MAX_TOKENS, PAD, _example_with, _examples, _TRAIN_COLUMNS, joined
from loomwright.plans.profiling import scratch_path
from loomwright.plans.registry import ORACLES, query
from loomwright.operators.corpus import EOS
from loomwright.sources.tables import scan_table

T, ALPHA, BETA = 2.0, 0.2, 0.3
_Z = inputs.LOGITS_SQL
# per element: log-probabilities of student (ls), teacher (lt), mixed student (lm) and shrunk student (la)
_LOG = f"""(SELECT *, zs - ln(sum(exp(zs)) OVER w) AS ls, zt - ln(sum(exp(zt)) OVER w) AS lt, zm - ln(sum(exp(zm)) OVER w) AS lm,
        za - ln(sum(exp(za)) OVER w) AS la FROM (
    SELECT *, s / {T} AS zs, t / {T} AS zt, ({1 - ALPHA} * s + {ALPHA} * t) / {T} AS zm, {1 - ALPHA} * s / {T} AS za FROM {_Z})
    WINDOW w AS (PARTITION BY vec_id))"""


def _loss_sql(value: str, name: str, outer: str = "") -> str:
    return f"SELECT batch_id, round({value}, 6) AS {name} FROM {_LOG} GROUP BY batch_id"


def pairs(spark, sf):
    return distill.student_teacher_join(
        inputs.student_logits(spark, sf), inputs.teacher_logits(spark, sf).drop("label")
    )


def _rounded(df, *names):
    return df.select("batch_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "student_teacher_join",
    f"SELECT batch_id, example_id, CAST(pos AS INT) AS pos, round(sum(s * t), 6) AS dot, count(*) AS n FROM {_Z} GROUP BY ALL",
)
def student_teacher_join(spark, sf):
    dot = F.aggregate(
        F.zip_with(as_doubles("student"), as_doubles("teacher"), lambda s, t: s * t), F.lit(0.0), lambda a, x: a + x
    )
    return pairs(spark, sf).select(
        "batch_id", "example_id", "pos", F.round(dot, 6).alias("dot"), F.size("student").cast("bigint").alias("n")
    )


LOGIT_BUCKETS = 16


def bucketed_logits(spark, sf):
    """Student's and teacher's logits, written in buckets by position and read again."""
    found = []
    for name, logits in (("student", inputs.student_logits(spark, sf)), ("teacher", inputs.teacher_logits(spark, sf).drop("label"))):
        path = scratch_path(spark, name)
        table = "logits_" + path.split("/")[-2].replace("-", "_") + "_" + name
        distill.write_bucketed(logits, table, path, LOGIT_BUCKETS)
        found.append(spark.table(table))
    return found


@query("bucketed_logits_join", ORACLES["student_teacher_join"])
def bucketed_logits_join(spark, sf):
    dot = F.aggregate(
        F.zip_with(as_doubles("student"), as_doubles("teacher"), lambda s, t: s * t), F.lit(0.0), lambda a, x: a + x
    )
    return distill.student_teacher_join(*bucketed_logits(spark, sf)).select(
        "batch_id", "example_id", "pos", F.round(dot, 6).alias("dot"), F.size("student").cast("bigint").alias("n")
    )


def _elements(df, column):
    return df.select("batch_id", "example_id", "pos", F.posexplode(column).alias("i", "x")).withColumn("x", F.round("x", 6))


_POSITION_SQL = "batch_id, example_id, CAST(pos AS INT) AS pos, CAST(i - 1 AS INT) AS i"


@query("mixin", f"SELECT {_POSITION_SQL}, round({1 - ALPHA} * s + {ALPHA} * t, 6) AS x FROM {_Z}")
def mixin(spark, sf):
    return _elements(distill.mixin(pairs(spark, sf), ALPHA), "mixed")


@query("softmax", f"SELECT {_POSITION_SQL}, round(exp(ls), 6) AS x FROM {_LOG}")
def softmax_query(spark, sf):
    return _elements(pairs(spark, sf).withColumn("p", softmax(as_doubles("student"), T)), "p")


@query("log_softmax", f"SELECT {_POSITION_SQL}, round(ls, 6) AS x FROM {_LOG}")
def log_softmax_query(spark, sf):
    return _elements(pairs(spark, sf).withColumn("p", log_softmax(as_doubles("student"), T)), "p")


@query(
    "masked_softmax",
    f"""SELECT {_POSITION_SQL}, round(CASE WHEN t > 0 THEN exp(s) / sum(CASE WHEN t > 0 THEN exp(s) END) OVER (PARTITION BY vec_id)
        ELSE 0 END, 6) AS x FROM {_Z}""",
)
def masked_softmax_query(spark, sf):
    keep = F.transform("teacher", lambda t: t > 0)
    return _elements(pairs(spark, sf).withColumn("p", masked_softmax(as_doubles("student"), keep)), "p")


def _kind(name: str, sql_value: str):
    @query(f"kd_{name}", _loss_sql(sql_value, name))
    def run(spark, sf):
        return _rounded(distill.kd_losses(pairs(spark, sf), (name,), ALPHA, T), name)


_kind("fkl", f"sum(exp(lt) * (lt - lm)) / count(DISTINCT example_id) * {T * T}")
_kind("revkl", f"sum(exp(lm) * (lm - lt)) / count(DISTINCT example_id) * {T * T}")
_kind("ce", "-sum(exp(lt) * ls) / count(DISTINCT vec_id)")
_kind("mse", "avg((s - t) * (s - t))")
_kind("pmse", "avg((exp(ls) - exp(lt)) * (exp(ls) - exp(lt)))")
_M = "((exp(ls) + exp(lt)) / 2)"
_kind("js", f"0.5 * (sum({_M} * (ln({_M}) - ls)) + sum({_M} * (ln({_M}) - lt))) / count(DISTINCT example_id)")
_kind(
    "mixkl",
    f"avg(exp(ls) / exp(lm)) * (sum(exp(la) * (la - lt)) - {ALPHA} * sum(exp(lt) * (lt - la))) / count(DISTINCT example_id)",
)


@query("kd_importance_weight", _loss_sql("avg(exp(ls) / exp(lm))", "imp_weight"))
def kd_importance_weight(spark, sf):
    return _rounded(distill.importance_weight(pairs(spark, sf), ALPHA, T), "imp_weight")


@query(
    "kd_all",
    f"""SELECT batch_id, round(avg(exp(ls) / exp(lm)) * sum(exp(lt) * (lt - lm)) / count(DISTINCT example_id) * {T * T}, 6) AS fkl,
        round(avg(exp(ls) / exp(lm)) * sum(exp(lm) * (lm - lt)) / count(DISTINCT example_id) * {T * T}, 6) AS revkl,
        round(-sum(exp(lt) * ls) / count(DISTINCT vec_id), 6) AS ce, round(avg((s - t) * (s - t)), 6) AS mse,
        round(avg(exp(ls) / exp(lm)), 6) AS imp_weight FROM {_LOG} GROUP BY batch_id""",
)
def kd_all(spark, sf):
    """All losses from one pass, weighted by importance."""
    kinds = ("fkl", "revkl", "ce", "mse")
    return _rounded(distill.kd_losses(pairs(spark, sf), kinds, ALPHA, T, weighted=True), *kinds, "imp_weight")


# targets: the next position's label inside an example, and the log-sum of the position's logits
_CLM_SQL = """(SELECT a.vec_id // 8 AS batch_id, b.label, ln(list_sum(list_transform(a.embedding, lambda x: exp(x::DOUBLE))))
    - a.embedding[b.label + 1]::DOUBLE AS nll FROM embeddings a
    JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND b.vec_id // 2 = a.vec_id // 2 WHERE b.label <> 0)"""


@query(
    "clm_loss",
    f"""SELECT batch_id, round(avg(nll), 6) AS clm_loss, round(exp(avg(nll)), 6) AS perplexity, count(*) AS n_tokens
    FROM {_CLM_SQL} GROUP BY batch_id""",
)
def clm_loss(spark, sf):
    loss = distill.clm_loss(inputs.student_logits(spark, sf))
    return _rounded(loss, "clm_loss", "perplexity").join(loss.select("batch_id", "n_tokens"), "batch_id")


@query(
    "kd_total_loss",
    f"""SELECT batch_id, round({BETA} * clm + {1 - BETA} * kd, 6) AS total_loss FROM
        (SELECT batch_id, avg(nll) AS clm FROM {_CLM_SQL} GROUP BY batch_id)
        LEFT JOIN (SELECT batch_id, sum(exp(lm) * (lm - lt)) / count(DISTINCT example_id) * {T * T} AS kd FROM {_LOG}
            GROUP BY batch_id) USING (batch_id)""",
)
def kd_total_loss(spark, sf):
    clm = distill.clm_loss(inputs.student_logits(spark, sf))
    kd = distill.kd_losses(pairs(spark, sf), ("revkl",), ALPHA, T)
    return _rounded(distill.kd_total_loss(clm, kd, BETA, "revkl"), "total_loss")


# every batch is one training step; alpha falls exponentially, beta rises as a cosine
_SCHEDULED = f"""(SELECT *, zs - ln(sum(exp(zs)) OVER w) AS ls, zt - ln(sum(exp(zt)) OVER w) AS lt, zm - ln(sum(exp(zm)) OVER w) AS lm
    FROM (SELECT z.*, alpha, beta, s / {T} AS zs, t / {T} AS zt, ((1 - alpha) * s + alpha * t) / {T} AS zm FROM {_Z} z
        JOIN plan USING (batch_id)) WINDOW w AS (PARTITION BY vec_id))"""


@query(
    "kd_scheduled",
    f"""WITH plan AS MATERIALIZED (SELECT batch_id, 0.2 * exp(ln(0.01) * batch_id / n) AS alpha,
            0.3 - 0.15 * (1 + cos(3 * pi() * batch_id / n)) AS beta
        FROM (SELECT batch_id, CAST(count(*) OVER () AS DOUBLE) AS n FROM (SELECT DISTINCT vec_id // 8 AS batch_id FROM embeddings))),
    kd AS (SELECT batch_id, avg(exp(ls) / exp(lm)) * sum(exp(lt) * (lt - lm)) / count(DISTINCT example_id) * {T * T} AS kd_loss
        FROM {_SCHEDULED} GROUP BY batch_id),
    clm AS (SELECT batch_id, avg(nll) AS clm_loss FROM {_CLM_SQL} GROUP BY batch_id)
    SELECT batch_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(kd_loss, 6) AS kd_loss,
        round(CASE WHEN beta = 1 THEN clm_loss ELSE beta * clm_loss + (1 - beta) * kd_loss END, 6) AS total_loss
    FROM clm JOIN plan USING (batch_id) LEFT JOIN kd USING (batch_id)""",
)
def kd_scheduled(spark, sf):
    """Total losses in which every batch has the weights of its own step."""
    student = inputs.student_logits(spark, sf)
    steps = student.select("batch_id").distinct()
    total = F.lit(float(steps.count()))
    schedule = steps.select(
        "batch_id",
        step_weight("batch_id", total, "exponential", 0.2).alias("alpha"),
        step_weight("batch_id", total, "cos", 0.3, 3, "inverse").alias("beta"),
    )
    made = distill.kd_scheduled(pairs(spark, sf), distill.clm_loss(student), schedule, "fkl", T, weighted=True)
    return _rounded(made, "alpha", "beta", "kd_loss", "total_loss")


@query(
    "shift_labels",
    """SELECT batch_id, example_id, CAST(pos AS INT) AS pos, label, next_label FROM (
        SELECT *, lead(label) OVER (PARTITION BY example_id ORDER BY pos) AS next_label FROM (
            SELECT vec_id // 8 AS batch_id, vec_id // 2 AS example_id, vec_id % 2 AS pos,
                CASE WHEN label = 0 THEN -100 ELSE label END AS label FROM embeddings)) WHERE next_label IS NOT NULL""",
)
def shift_labels(spark, sf):
    logged = inputs.student_logits(spark, sf).drop("logits")
    return features.shift_labels(logged, ("batch_id", "example_id")).where("next_label is not null")


# ---------------------------------------------------------------------------------------------------------------------
# Classifier losses: ten vectors make an example; the first two elements are the logits of a two-class decision

_FA, _FG = 0.75, 2.0


def _focal_sql(label: str, first: int, second: int) -> str:
    return f"""(SELECT example_id, -sum(w * (1 - p) ** {_FG} * ln(p + 1e-8)) / sum(w) AS loss FROM (
        SELECT example_id, CASE WHEN y = 1 THEN {_FA} ELSE {1 - _FA} END AS w,
            CASE WHEN y = 1 THEN exp(b) ELSE exp(a) END / (exp(a) + exp(b)) AS p FROM (
            SELECT vec_id // 10 AS example_id, {label} AS y, embedding[{first}]::DOUBLE AS a, embedding[{second}]::DOUBLE AS b
            FROM embeddings)) GROUP BY example_id)"""


_TABLE_FOCAL = _focal_sql("label % 2", 1, 2)
_COLUMN_FOCAL = _focal_sql("CASE WHEN label < 3 THEN 1 ELSE 0 END", 3, 4)


def _decisions(spark, sf, label: str, first: int):
    return scan_table(spark, sf, "embeddings").select(
        F.expr("vec_id div 10").alias("example_id"),
        F.slice("embedding", first, 2).alias("logits"),
        F.expr(label).cast("int").alias("label"),
    )


@query("focal_loss", f"SELECT example_id, round(loss, 6) AS focal_loss FROM {_TABLE_FOCAL}")
def focal_loss(spark, sf):
    loss = distill.focal_loss(_decisions(spark, sf, "label % 2", 1), _FA, _FG)
    return loss.select("example_id", F.round("focal_loss", 6).alias("focal_loss"))


@query(
    "classifier_total_loss",
    f"""SELECT round(t, 6) AS table_loss, round(c, 6) AS column_loss, round(t + c, 6) AS total_loss FROM
        (SELECT avg(loss) AS t FROM {_TABLE_FOCAL}), (SELECT avg(loss) AS c FROM {_COLUMN_FOCAL})""",
)
def classifier_total_loss(spark, sf):
    made = distill.classifier_total_loss(
        _decisions(spark, sf, "label % 2", 1), _decisions(spark, sf, "if(label < 3, 1, 0)", 3), _FA, _FG
    )
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])


# ---------------------------------------------------------------------------------------------------------------------
# Schedules and distillation features

_SCHEDULE_SQL = {
    "linear": "0.2 * (n - s) / n",
    "exponential": "0.2 * exp(ln(0.01) * s / n)",
    "step": "0.2 * (trunc((n - s) / 3) / trunc(n / 3))",
    "cos": "0.1 * (1 + cos(3 * pi() * s / n))",
    "const": "CAST(0.2 AS DOUBLE)",
}


@query(
    "alpha_schedule",
    "SELECT at_step, "
    + ", ".join(f"round({v}, 6) AS {k}" for k, v in _SCHEDULE_SQL.items())
    + ", round(0.2 - 0.1 * (1 + cos(3 * pi() * s / n)), 6) AS inverse"
    + " FROM (SELECT event_id AS at_step, CAST(event_id AS DOUBLE) AS s, CAST(count(*) OVER () AS DOUBLE) AS n FROM events)",
)
def alpha_schedule(spark, sf):
    events = scan_table(spark, sf, "events")
    total = float(events.count())
    made = {k: F.round(step_weight("event_id", total, k, 0.2, 3), 6) for k in SCHEDULES}
    made["inverse"] = F.round(step_weight("event_id", total, "cos", 0.2, 3, "inverse"), 6)
    return events.select(F.col("event_id").alias("at_step"), *[c.alias(k) for k, c in made.items()])


@query(
    "features_kd",
    f"""{_example_with()}, l AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings),
        e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY example) - 1 AS r FROM n)
    SELECT input_ids, attention_mask, labels, example, teacher_sum FROM (SELECT {_TRAIN_COLUMNS} FROM n) JOIN (
        SELECT example, round(sum(list_sum(list_transform(embedding, lambda q: q::DOUBLE))), 6) AS teacher_sum
        FROM e CROSS JOIN (VALUES (0), (1)) AS two(pos) JOIN l ON l.r = (2 * e.r + pos) % (SELECT count(*) FROM l)
        GROUP BY example) USING (example)""",
)
def features_kd(spark, sf):
    """Two logged positions per example; when there are more examples, the log starts again."""
    from loomwright.operators.corpus import row_index

    examples = _examples(spark, sf)
    numbered = row_index(examples.select("example"), ["example"])
    logged = row_index(scan_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("logits")), ["vec_id"])
    count = logged.agg(F.count(F.lit(1)).alias("n"))  # one row
    places = numbered.select("example", "idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).join(F.broadcast(count))
    places = places.select("example", "pos", ((F.col("idx") * 2 + F.col("pos")) % F.col("n")).alias("idx"))
    teacher = places.join(logged, "idx")
    made = features.features_kd(examples, teacher, MAX_TOKENS, BOS, EOS, PAD, "example")
    total = F.aggregate(F.flatten("teacher_logits").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return made.select(
        "example",
        *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")],
        F.round(total, 6).alias("teacher_sum"),
    )
