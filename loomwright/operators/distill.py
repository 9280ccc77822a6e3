"""Losses of a student against a teacher, from logged logits.

Rows are positions: ``batch_id, example_id, pos, student, teacher`` with logit arrays. Each position is reduced to a few
numbers by array functions, and the batches are ordinary aggregates of those, so a batch of any size is combined map-side
and the arrays never move after the join.

``batchmean`` sums over positions and vocabulary and divides by the number of examples in the batch. Positions under
padding count unless ``mask_padding`` drops them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.logits import (
    array_sum,
    as_doubles,
    log_normaliser,
    log_softmax,
    mix_logits,
    softmax,
)
from loomwright.operators.features import IGNORED_LABEL, shift_labels

POSITION = ["batch_id", "example_id", "pos"]
KINDS = ("fkl", "revkl", "ce", "mse", "pmse", "js", "mixkl")


def write_bucketed(logits: DataFrame, table: str, path: str, buckets: int) -> None:
    """Save ``logits`` as ``table`` (its files under ``path``), in ``buckets`` buckets by position, one file each.

    Two tables written with the same number of buckets join by position without an exchange. Choose it so that a bucket fits a task.
    """
    dealt = logits.repartition(buckets, *POSITION)
    dealt.write.bucketBy(buckets, *POSITION).sortBy(*POSITION).option("path", path).format("parquet").saveAsTable(table)


def student_teacher_join(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """Both models' logits per position. Fails when the vocabularies differ or a position has the logits of one model only.

    At scale keep both tables as :func:`write_bucketed` writes them: the join then needs no shuffle.
    """
    t = teacher.select(*POSITION, F.col("logits").alias("teacher"))
    joined = student.withColumnRenamed("logits", "student").join(t, POSITION, "full")
    paired = F.assert_true(
        F.col("student").isNotNull() & F.col("teacher").isNotNull(), F.lit("a position is without logits of one model")
    )
    joined = joined.withColumn("student", F.when(paired.isNull(), F.col("student")))
    same = F.assert_true(F.size("student") == F.size("teacher"), F.lit("student and teacher vocabularies differ"))
    # assert_true gives NULL when it holds, so coalesce only makes sure that it is evaluated
    return joined.withColumn("teacher", F.when(same.isNull(), F.col("teacher")))


def mixin(pairs: DataFrame, alpha: float | Column) -> DataFrame:
    """Add ``mixed`` logits."""
    return pairs.withColumn("mixed", mix_logits(as_doubles("student"), as_doubles("teacher"), F.lit(alpha)))


def _divergence(log_p: Column, log_q: Column) -> Column:
    """``Σ p·(ln p − ln q)`` of two arrays of log-probabilities."""
    return array_sum(F.zip_with(log_p, log_q, lambda p, q: F.exp(p) * (p - q)))


def _share(alpha: float | str) -> Column:
    return F.col(alpha).cast("double") if isinstance(alpha, str) else F.lit(float(alpha))


def _prepared(pairs: DataFrame, alpha: float | str, temperature: float, kinds: set[str], mask_padding: bool) -> DataFrame:
    """Log-probabilities per position, as far as ``kinds`` need them."""
    rows = pairs.where(F.col("label") != IGNORED_LABEL) if mask_padding else pairs
    s, t = as_doubles("student"), as_doubles("teacher")
    rows = rows.withColumn("_s", s).withColumn("_t", t)
    made = {}
    if kinds & {"fkl", "revkl", "ce", "pmse", "js", "mixkl"}:
        made["_lt"] = log_softmax(F.col("_t"), temperature)
    if kinds & {"ce", "pmse", "js", "weight"} or (alpha == 0 and kinds & {"fkl", "revkl"}):
        made["_ls"] = log_softmax(F.col("_s"), temperature)
    if alpha != 0 and kinds & {"fkl", "revkl", "weight"}:
        made["_lm"] = log_softmax(mix_logits(F.col("_s"), F.col("_t"), _share(alpha)), temperature)
    if "mixkl" in kinds:
        made["_la"] = log_softmax(F.transform("_s", lambda x: x * (1 - _share(alpha))), temperature)
    return rows.withColumns(made) if made else rows


def _position_terms(kind: str, alpha: float | str) -> dict[str, Column]:
    """The numbers one position adds to a batch."""
    mixed = "_lm" if alpha != 0 else "_ls"
    if kind == "fkl":
        return {"fkl": _divergence(F.col("_lt"), F.col(mixed))}
    if kind == "revkl":
        return {"revkl": _divergence(F.col(mixed), F.col("_lt"))}
    if kind == "ce":
        return {"ce": -array_sum(F.zip_with("_lt", "_ls", lambda t, s: F.exp(t) * s))}
    if kind == "mse":
        return {"mse": array_sum(F.zip_with("_s", "_t", lambda s, t: (s - t) * (s - t)))}
    if kind == "pmse":
        gap = F.zip_with("_ls", "_lt", lambda s, t: F.exp(s) - F.exp(t))
        return {"pmse": array_sum(F.transform(gap, lambda d: d * d))}
    if kind == "js":
        # divergences from the middle m, in this order of arguments: KL(m‖s) + KL(m‖t)
        def term(s: Column, t: Column) -> Column:
            m = (F.exp(s) + F.exp(t)) / 2
            return m * (2 * F.ln(m) - s - t)

        return {"js": array_sum(F.zip_with("_ls", "_lt", term))}
    if kind == "mixkl":
        return {"mixkl_1": _divergence(F.col("_la"), F.col("_lt")), "mixkl_2": _divergence(F.col("_lt"), F.col("_la"))}
    if kind == "weight":
        return {"weight": array_sum(F.zip_with("_ls", "_lm", lambda s, m: F.exp(s - m)))}
    raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")


def kd_losses(
    pairs: DataFrame,
    kinds: tuple[str, ...] = KINDS,
    alpha: float | str = 0.2,
    temperature: float = 2.0,
    weighted: bool = False,
    mask_padding: bool = False,
) -> DataFrame:
    """One row per batch with a column per kind, all from one pass over the logits.

    ``alpha`` is the teacher's share in the mixed student: a number, or the name of a column that holds one number per batch, which
    the result keeps. ``weighted`` multiplies ``fkl`` and ``revkl`` by the importance
    weight (``mixkl`` always is). ``imp_weight`` is 1 where it is not used.
    """
    for kind in kinds:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    needed = set(kinds)
    use_weight = alpha != 0 and (weighted and bool(needed & {"fkl", "revkl"}) or "mixkl" in needed)
    if use_weight:
        needed.add("weight")
    terms: dict[str, Column] = {}
    for kind in sorted(needed):
        terms.update(_position_terms(kind, alpha))
    rows = _prepared(pairs, alpha, temperature, needed, mask_padding)
    share = [alpha] if isinstance(alpha, str) else []
    positions = rows.select("batch_id", *share, "example_id", F.size("_s").alias("_v"), *[c.alias(n) for n, c in terms.items()])
    batches = positions.groupBy("batch_id", *share).agg(
        F.countDistinct("example_id").alias("_examples"),
        F.count(F.lit(1)).alias("_positions"),
        F.sum("_v").alias("_elements"),
        *[F.sum(n).alias(n) for n in terms],
    )
    examples, n_pos, elements = F.col("_examples"), F.col("_positions"), F.col("_elements")
    weight = F.col("weight") / elements if use_weight else F.lit(1.0)
    kl_weight = weight if weighted else F.lit(1.0)
    squared = float(temperature) ** 2
    finals = {
        "fkl": lambda: kl_weight * F.col("fkl") / examples * squared,
        "revkl": lambda: kl_weight * F.col("revkl") / examples * squared,
        "ce": lambda: F.col("ce") / n_pos,
        "mse": lambda: F.col("mse") / elements,
        "pmse": lambda: F.col("pmse") / elements,
        "js": lambda: F.col("js") / 2 / examples,
        "mixkl": lambda: weight * F.col("mixkl_1") / examples - weight * _share(alpha) * F.col("mixkl_2") / examples,
    }
    out = [finals[k]().alias(k) for k in kinds]
    return batches.select("batch_id", *share, *out, weight.alias("imp_weight"))


def importance_weight(pairs: DataFrame, alpha: float, temperature: float) -> DataFrame:
    """Mean ratio of plain to mixed student probabilities per batch."""
    rows = _prepared(pairs, alpha, temperature, {"weight"}, False)
    ratio = _position_terms("weight", alpha)["weight"] if alpha != 0 else F.size("_s").cast("double")
    return (
        rows.select("batch_id", F.size("_s").alias("_v"), ratio.alias("_r"))
        .groupBy("batch_id")
        .agg((F.sum("_r") / F.sum("_v")).alias("imp_weight"))
    )


def clm_loss(logged: DataFrame, group: str | None = "batch_id") -> DataFrame:
    """Next-token cross-entropy per batch (or in all), with the number of counted tokens and the perplexity.

    ``logged(batch_id, example_id, pos, logits, label)``: the logits of a position are judged by the next position's label.
    Only the label of each position takes part in the window; the arrays stay out of it.
    """
    example = ("batch_id", "example_id")
    targets = (
        shift_labels(logged.select(*POSITION, "label"), example)
        .where(F.col("next_label").isNotNull() & (F.col("next_label") != IGNORED_LABEL))
        .select(*POSITION, "next_label")
    )
    z = as_doubles("logits")
    judged = logged.select(*POSITION, "logits").join(targets, POSITION)
    nll = judged.select("batch_id", (log_normaliser(z) - F.get(z, F.col("next_label"))).alias("_nll"))
    grouped = nll.groupBy(group) if group else nll.groupBy()
    loss = F.avg("_nll")
    return grouped.agg(loss.alias("clm_loss"), F.exp(loss).alias("perplexity"), F.count(F.lit(1)).alias("n_tokens"))


def kd_total_loss(clm: DataFrame, kd: DataFrame, beta: float | Column, kd_column: str = "kd_loss") -> DataFrame:
    """``beta·clm + (1 − beta)·kd`` per batch. Where ``beta`` is 1 the teacher does not count, and need not be there."""
    b = F.lit(beta).cast("double")
    joined = clm.join(kd.select("batch_id", F.col(kd_column).alias("_kd")), "batch_id", "left")
    total = F.when(b == 1, F.col("clm_loss")).otherwise(b * F.col("clm_loss") + (1 - b) * F.col("_kd"))
    return joined.withColumn("total_loss", total).drop("_kd")


def kd_scheduled(
    pairs: DataFrame, clm: DataFrame, schedule: DataFrame, kind: str = "fkl", temperature: float = 2.0, weighted: bool = False
) -> DataFrame:
    """Losses where every batch has the weights of its own training step.

    ``schedule`` holds one row per ``batch_id`` with ``alpha``, the teacher's share in the mixed student, and ``beta``, the share of the
    plain loss ``clm_loss`` of ``clm``. Returns ``batch_id, alpha, beta, kd_loss, total_loss`` for the scheduled batches that ``clm`` holds. The
    schedule is one narrow row per batch, so the choice how to join it to the logits is left to Spark, which goes by bytes.
    """
    shares = pairs.drop("alpha", "beta").join(schedule.select("batch_id", "alpha"), "batch_id")
    kd = kd_losses(shares, (kind,), "alpha", temperature, weighted).withColumnRenamed(kind, "kd_loss")
    plain = clm.select("batch_id", "clm_loss").join(schedule.select("batch_id", "beta"), "batch_id")
    totals = kd_total_loss(plain, kd, F.col("beta")).select("batch_id", "beta", "total_loss")
    return totals.join(kd, "batch_id", "left").select("batch_id", "alpha", "beta", "kd_loss", "total_loss")


def focal_loss(rows: DataFrame, alpha: float = 0.75, gamma: float = 2.0, keys: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """Weighted focal loss per example from ``logits`` (two classes) and ``label`` 0 or 1."""
    p = softmax(as_doubles("logits"))
    scored = rows.withColumn("_p", F.get(p, F.col("label").cast("int"))).withColumn(
        "_w", F.when(F.col("label") == 1, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    )
    term = F.col("_w") * F.pow(1 - F.col("_p"), F.lit(gamma)) * F.ln(F.col("_p") + 1e-8)
    return scored.groupBy(*keys).agg((-F.sum(term) / F.sum("_w")).alias("focal_loss"))


def classifier_total_loss(tables: DataFrame, columns: DataFrame, alpha: float = 0.75, gamma: float = 2.0) -> DataFrame:
    """Mean focal loss over examples of the table rows, plus that of the column rows; both divided by the number of
    examples with table rows."""

    parts = tables.select(F.lit("table").alias("part"), "example_id", "logits", "label").unionByName(
        columns.select(F.lit("column").alias("part"), "example_id", "logits", "label")
    )
    per_example = focal_loss(parts, alpha, gamma, ("part", "example_id"))
    is_table = F.col("part") == "table"
    n = F.count(F.when(is_table, 1))
    return per_example.agg(
        (F.sum(F.when(is_table, F.col("focal_loss"))) / n).alias("table_loss"),
        (F.sum(F.when(~is_table, F.col("focal_loss"))) / n).alias("column_loss"),
        (F.sum("focal_loss") / n).alias("total_loss"),
    )
