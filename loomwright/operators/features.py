"""Training examples: prefix and target ids joined, padded or cut to one length, with mask and labels.

Inputs are ``prefix_ids`` and ``target_ids`` arrays as a tokenizer gives them, without begin and end marks. All operators are
projections: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.arrays import last_elements, pad_left, pad_right, repeat

# Fixed value: positions with this label do not count in a loss.
IGNORED_LABEL = -100


def tail_truncate(ids: Column, max_tokens: int, bos: int) -> Column:
    """The begin mark and the last ``max_tokens - 1`` ids."""
    return F.concat(F.array(F.lit(bos)), last_elements(ids, max_tokens - 1))


def _marked(df: DataFrame, bos: int, eos: int) -> DataFrame:
    return df.withColumn("_prefix", F.concat(F.array(F.lit(bos)), F.col("prefix_ids"))).withColumn(
        "_target", F.concat(F.col("target_ids"), F.array(F.lit(eos)))
    )


def _finish(df: DataFrame, source: DataFrame, drop: tuple[str, ...] = ("prefix_ids", "target_ids"), **made: Column) -> DataFrame:
    kept = [c for c in source.columns if c not in drop]
    return df.select(*kept, *[c.alias(name) for name, c in made.items()])


def features_train(df: DataFrame, max_tokens: int, bos: int, eos: int, pad: int) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` of length ``max_tokens``; only target ids carry labels."""
    marked = _marked(df, bos, eos)
    ids = F.concat("_prefix", "_target")
    n = F.size(ids)
    labels = F.concat(repeat(IGNORED_LABEL, F.size("_prefix")), F.col("_target"))
    fits = n <= max_tokens
    return _finish(
        marked,
        df,
        input_ids=F.when(fits, pad_right(ids, pad, max_tokens)).otherwise(tail_truncate(ids, max_tokens, bos)),
        attention_mask=pad_right(repeat(1, F.least(n, F.lit(max_tokens))), 0, max_tokens),
        labels=F.when(fits, pad_right(labels, IGNORED_LABEL, max_tokens)).otherwise(last_elements(labels, max_tokens)),
    )


def features_kd(df: DataFrame, teacher_logits: DataFrame, max_tokens: int, bos: int, eos: int, pad: int, key: str) -> DataFrame:
    """:func:`features_train` with the teacher's logits of the example, an array of one logit array per position.

    ``teacher_logits(key, pos, logits)`` holds at most ``max_tokens`` rows per example. Fails when an example has none.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "logits"))), lambda p: p["logits"])
    per_example = teacher_logits.groupBy(key).agg(ordered.alias("teacher_logits"))
    made = features_train(df, max_tokens, bos, eos, pad).join(per_example, key, "left")
    there = F.assert_true(F.col("teacher_logits").isNotNull(), F.lit("an example is without teacher logits"))
    return made.withColumn("teacher_logits", F.when(there.isNull(), F.col("teacher_logits")))


def features_ppo(df: DataFrame, max_tokens: int, bos: int, eos: int, pad: int) -> DataFrame:
    """Prefix and response padded on the left. When both together are too long, the ids are cut as in training and the
    response stays as it is."""
    marked = _marked(df, bos, eos)
    ids = F.concat("_prefix", "_target")
    fits = F.size(ids) <= max_tokens
    return _finish(
        marked,
        df,
        input_ids=F.when(fits, pad_left(F.col("_prefix"), pad, max_tokens)).otherwise(tail_truncate(ids, max_tokens, bos)),
        attention_mask=F.when(fits, pad_left(repeat(1, F.size("_prefix")), 0, max_tokens)).otherwise(
            repeat(1, F.lit(max_tokens))
        ),
        response=F.when(fits, pad_left(F.col("_target"), pad, max_tokens)).otherwise(F.col("_target")),
    )


def features_eval(df: DataFrame, max_prefix: int, bos: int) -> DataFrame:
    """Prefix only, cut to ``max_prefix`` from the left, not padded."""
    ids = F.concat(F.array(F.lit(bos)), F.col("prefix_ids"))
    cut = F.when(F.size(ids) > max_prefix, tail_truncate(ids, max_prefix, bos)).otherwise(ids)
    made = df.withColumn("_ids", cut)
    return _finish(made, df, input_ids=F.col("_ids"), attention_mask=repeat(1, F.size("_ids")))


def seqkd_target_join(examples: DataFrame, teacher_outputs: DataFrame, key: str, target: str = "target") -> DataFrame:
    """Replace the gold target by the teacher's output for the same example."""
    outputs = teacher_outputs.select(key, F.col("teacher_target").alias(target))
    return examples.drop(target).join(outputs, key)


def features_seqkd(
    examples: DataFrame, teacher_ids: DataFrame, key: str, max_tokens: int, bos: int, eos: int, pad: int
) -> DataFrame:
    """:func:`features_train` on the teacher's output. ``teacher_ids(key, teacher_target)`` holds token ids."""
    return features_train(seqkd_target_join(examples, teacher_ids, key, "target_ids"), max_tokens, bos, eos, pad)


def shift_labels(logged: DataFrame, example: tuple[str, ...] = ("example_id",)) -> DataFrame:
    """Add ``next_label``: the label of the following position, NULL at the last. A group is one sequence."""
    return logged.withColumn("next_label", F.lead("label").over(Window.partitionBy(*example).orderBy("pos")))
