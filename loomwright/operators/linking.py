"""Value linking: which cell values of which columns does a question mention, exactly or nearly.

A value is compared with the question as follows. The longest text both share is taken (earliest in the question on a tie)
and widened to whole words of the question, of which at most two letters may lie outside the shared text (a plural). That
span of the question is the *source*. It must start with the same letter as the value, and the score is the Indel
similarity ``2·LCS/(len(value)+len(source))`` of the two.

Candidates come from an equi-join, never from pairing all questions with all values. The source is a run of whole words, and
all but its last two characters lie in the shared text. So for a source of length ``s``

* the value contains ``source[0 : s-2]``, at a place where the value has its own first letter, and
* the value's length ``v`` satisfies ``theta/(2-theta)·s <= v <= s·(2-theta)/theta``.

Both sides therefore spell out ``(s, source[0 : s-2])`` for every possible ``s``: the question for every run of whole words,
the value for every place with its first letter. Short sources, for which two free characters say little, admit at most
one inserted or dropped character; there the keys are the text and its one-character deletions. Long ones share one key of
``KEY_CHARS`` characters. Candidates are a superset of the matches; the exact rules decide in :func:`score_pairs`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import (
    COMMON_WORDS,
    DATABASE_TERMS,
    SEPARATORS,
    STOPWORDS,
    strip,
)

KEY_CHARS = 32
COLUMN = ["db_id", "table_name", "column_name"]
_FLOAT_SLACK = 1e-9


# ---------------------------------------------------------------------------------------------------------------------
# The exact rules, as expressions over a pair of texts

_SEPARATOR_CLASS = "[" + "".join("\\" + ch for ch in SEPARATORS) + "]"
_FAR = 1 << 30


def _longest_shared(asked: Column, offered: Column) -> Column:
    """Length of the longest text both hold. If they share one of some length they share shorter ones too, so the length is found
    by halving: every power of two is added if a piece that long can still be found."""
    n = F.least(F.length(asked), F.length(offered))
    powers = F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0))

    def shares(size: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(offered) - size + 1)
        return F.exists(starts, lambda i: F.contains(asked, F.substring(offered, i, size)))

    def add(size: Column, power: Column) -> Column:
        longer = size + F.pow(F.lit(2), power).cast("int")
        return F.when((longer <= n) & shares(F.least(longer, n)), longer).otherwise(size)

    return F.aggregate(powers, F.lit(0), add)


def _first_place(asked: Column, offered: Column, size: Column) -> Column:
    """``struct<at, from>``: where the shared text of this length stands (from 1) in the question and in the value, the earliest
    in the question and then in the value."""
    starts = F.sequence(F.lit(1), F.length(offered) - size + 1)
    places = F.transform(
        starts, lambda i: F.struct(F.position(F.substring(offered, i, size), asked).alias("at"), i.alias("from"))
    )
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))


# Characters of one text that a row of bits holds; the 64th bit of a long is left free for the carry.
_ROW_BITS = 62


def _bit_rows(text: Column, letters: Column) -> Column:
    """For each of ``letters`` the places where it stands in ``text``, as the bits of a whole number."""
    chars = F.split(text, "")
    places = F.sequence(F.lit(0), F.length(text) - 1)

    def row(letter: Column) -> Column:
        return F.aggregate(
            places, F.lit(0).cast("long"), lambda bits, i: F.when(F.get(chars, i) == letter, bits + F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(bits)
        )

    return F.transform(letters, row)


def _common_by_bits(a: Column, b: Column) -> Column:
    """``common_length`` for an ``a`` of at most ``_ROW_BITS`` characters.

    A row of bits, one per character of ``a``, is carried along the characters of ``b``: a bit is zero where the common subsequence of what was read
    grows by one. A character's own places are added to the row, so that the carry of the sum clears the first place of each run of ones;
    the other ones stay. Each character of ``b`` is one look-up, one sum and two masks; at the end the zeros are counted.
    """
    letters = F.array_distinct(F.split(a, ""))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(a)) - 1

    def step(state: Column, letter: Column) -> Column:
        at = F.array_position(state["letters"], letter).cast("int")
        own = F.when(at > 0, F.get(state["rows"], at - 1)).otherwise(F.lit(0).cast("long")).bitwiseAND(state["row"])
        row = (state["row"] + own).bitwiseOR(state["row"] - own).bitwiseAND(state["full"])
        return F.struct(state["letters"].alias("letters"), state["rows"].alias("rows"), state["full"].alias("full"), row.alias("row"))

    start = F.struct(letters.alias("letters"), _bit_rows(a, letters).alias("rows"), full.alias("full"), full.alias("row"))
    return F.aggregate(F.split(b, ""), start, step, lambda state: F.bit_count(state["full"]) - F.bit_count(state["row"]))


def _common_by_places(a: Column, b: Column) -> Column:
    """``common_length`` for texts of any length.

    Along the characters of ``b`` a list is kept that says how much of ``a`` is needed to hold a common subsequence of 0, 1, 2, ... characters.
    A further character can lengthen the one before at its next place in ``a``.
    """
    none = F.transform(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.when(k == 0, 0).otherwise(_FAR))

    def take(needed: Column, ch: Column) -> Column:
        def longer(now: Column, k: Column) -> Column:
            # Looked for in what is left of ``a`` with the character put at its end: a place beyond ``a`` means that it is not there.
            start = F.get(needed, k - 1)
            rest = F.concat(F.substring(a, start + 1, F.length(a)), ch)
            return F.least(now, start + F.position(ch, rest))

        return F.transform(needed, longer)

    needed = F.aggregate(F.split(b, ""), none.cast("array<int>"), take)
    return F.size(F.filter(needed, lambda p: p <= F.length(a))) - 1


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts: by bits if one of them fits into a row, else by places."""
    fits = F.length(a) <= _ROW_BITS
    either = fits | (F.length(b) <= _ROW_BITS)
    empty = (a == "") | (b == "")
    short, other = F.when(fits, a).otherwise(b), F.when(fits, b).otherwise(a)
    return F.when(empty, 0).when(either, _common_by_bits(short, other)).otherwise(_common_by_places(a, b))


def indel_similarity(a: Column, b: Column) -> Column:
    """``2·LCS/(len(a)+len(b))`` of two texts that are not both empty, with the last digit that comes of counting the characters that are not common."""
    both = F.length(a) + F.length(b)
    return F.lit(1.0) - (both - 2 * common_length(a, b)) / both


def _first_letter(text: Column) -> Column:
    """First character that is no separator; the last character if all are; empty for empty text."""
    letters = F.regexp_replace(text, f"^{_SEPARATOR_CLASS}+", "")
    return F.when(letters != "", F.substring(letters, 1, 1)).otherwise(F.right(text, F.lit(1)))


def _computed(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once: what comes after a generator is neither merged into it nor pushed below it, as
    filters on computed columns else would be, together with all that these are computed from."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def score_pairs(pairs: DataFrame, theta: float) -> DataFrame:
    """``(question, value)`` rows, both stripped, with ``match_str, source_str, score, match_size``; rows without a match go.

    Each step drops what cannot match before the next, dearer one. Letters whose lower case is longer than one character or depends on its
    neighbours take one form.
    """
    q, v = F.col("_asked"), F.col("_offered")
    folded = _computed(
        pairs, _folded_text(F.col("question")).alias("_asked"), _folded_text(F.col("value")).alias("_offered")
    ).where((v != "") & (q != ""))
    sized = _computed(folded, _longest_shared(q, v).alias("match_size")).where("match_size > 0")
    at, begin, size = F.col("_place.at"), F.col("_place.from"), F.col("match_size")
    shared = _computed(sized, _first_place(q, v, size).alias("_place"))
    # The shared text stands at the start of the question, or a separator is its first character or the one before it.
    opens = (at == 1) | F.substring(q, F.greatest(at - 1, F.lit(1)), F.lit(2)).rlike(_SEPARATOR_CLASS)
    # From its last character on, a separator or the end of the question comes after three characters at most.
    tail = F.substring(q, at + size - 1, F.length(q))
    closes = f"(?s)^(.{{0,3}}?)(?:{_SEPARATOR_CLASS}|\\z)"
    length = size - 1 + F.length(F.regexp_extract(tail, closes, 1))
    bounded = _computed(shared.where(opens & tail.rlike(closes)), F.substring(q, at, length).alias("_span"))
    # Separators at both ends do not belong to the source.
    blank = F.length(F.regexp_extract("_span", f"^{_SEPARATOR_CLASS}*", 0))
    inner = F.length(F.regexp_replace("_span", f"^{_SEPARATOR_CLASS}+|{_SEPARATOR_CLASS}+\\z", ""))
    named = _computed(
        bounded,
        F.substring(F.col("question"), at + blank, inner).alias("source_str"),
        F.substring(F.col("value"), begin, size).alias("match_str"),
    )
    match, source, value = (strip(_folded_text(F.col(c))) for c in ("match_str", "source_str", "value"))
    told = _computed(named, match.alias("_match"), source.alias("_source"), value.alias("_value"))
    words = [F.col("_match"), F.col("_source"), F.col("_value")]
    stopped = [w.isin(STOPWORDS) for w in words]
    told = told.where(~((words[0] == "") | words[0].isin(DATABASE_TERMS) | stopped[0] | stopped[1] | stopped[2]))
    possessive = F.endswith(words[1], F.concat(words[0], F.lit("'s")))
    comparable = (words[1] != "") & (_first_letter(words[2]) == _first_letter(words[1]))
    lengths = F.least(*map(F.length, words[1:])) * 2 >= (F.length(words[1]) + F.length(words[2])) * (theta - _FLOAT_SLACK)
    # The usual library gives the similarity in percent; going through percent keeps the same last digit.
    near = indel_similarity(words[2], words[1]) * 100 / 100
    scored = _computed(told.where(possessive | (comparable & lengths)), F.when(possessive, 1.0).otherwise(near).alias("score"))
    shouted = (F.upper("value") == F.col("value")) & (F.lower("value") != F.col("value"))
    exact_only = shouted | reduce(or_, [w.isin(COMMON_WORDS) for w in words])
    kept = scored.where((F.col("score") >= theta) & ((F.col("score") >= 1) | ~exact_only))
    return kept.select(*pairs.columns, "match_str", "source_str", "score", "match_size")


# ---------------------------------------------------------------------------------------------------------------------
# Candidate keys


def _length_rules(theta: float) -> list[tuple[int, int, int, int]]:
    """For every source length up to ``KEY_CHARS + 2``: (length, shortest value, longest value, most characters that may
    differ)."""
    rules = []
    for s in range(1, KEY_CHARS + 3):
        needed = {
            v: math.ceil(theta * (v + s) / 2 - _FLOAT_SLACK) for v in range(1, int(s * (2 - theta) / theta) + 2)
        }
        # a value of length v can reach theta only if the needed characters fit into both texts
        fits = [v for v, common in needed.items() if common <= min(v, s)]
        rules.append((s, min(fits), max(fits), max(v + s - 2 * needed[v] for v in fits)))
    return rules


def _split_rules(theta: float) -> tuple[int, int, list]:
    """``(exact, near, loose)``: sources up to length ``exact`` must equal the value, up to ``near`` one character may
    differ, and ``loose`` holds the rules of all longer ones."""
    rules = _length_rules(theta)
    exact = sum(1 for _ in itertools.takewhile(lambda r: r[3] == 0, rules))
    near = sum(1 for _ in itertools.takewhile(lambda r: r[3] <= 1, rules))
    return exact, near, rules[near:]


def _folded_text(text: Column) -> Column:
    """Lower case, character by character. Letters whose lower case depends on context or length take one form on both sides."""
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ς", "σ")


def _fold(text: Column) -> Column:
    return F.split(_folded_text(text), "")


def _part(chars: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(chars, start, length), "")


def _key(length: Column | int, kind: str, text: Column) -> Column:
    size = F.lit(str(length)) if isinstance(length, int) else length.cast("string")
    return F.concat(size, F.lit(kind), text)


def _deletions(chars: Column, n: Column) -> Column:
    """All texts with one character less."""
    return F.transform(
        F.sequence(F.lit(1), n), lambda i: F.concat(_part(chars, F.lit(1), i - 1), _part(chars, i + 1, n))
    )


def _is_separator(ch: Column) -> Column:
    return ch.isin(list(SEPARATORS))


_NO_KEYS = "array<string>"


def value_keys(values: DataFrame, theta: float) -> DataFrame:
    """Explode ``value`` into its candidate keys, column ``_key``."""
    exact, near, loose = _split_rules(theta)
    folded = (
        values.where("value != ''")
        .withColumn("_v", _fold(F.col("value")))
        .withColumn("_n", F.size("_v"))
        .withColumn("_first", F.get(F.filter("_v", lambda ch: ~_is_separator(ch)), F.lit(0)))
        .where(F.col("_first").isNotNull())
    )
    v, n = F.col("_v"), F.col("_n")
    places = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(v, i - 1) == F.col("_first"))
    whole = _part(v, F.lit(1), n)
    # "x": the source is the value; "d": the value is the source less one character; "i": the value has one more
    parts = [
        F.when(n <= near, F.array(_key(n, "x", whole))),
        F.when((n + 1 > exact) & (n + 1 <= near), F.array(_key(n + 1, "d", whole))),
        F.when((n - 1 > exact) & (n - 1 <= near), F.transform(_deletions(v, n), lambda t: _key(n - 1, "i", t))),
    ]
    if loose:
        rules = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for s, lo, hi, _ in loose])

        def spelled(rule: Column) -> Column:
            length = F.greatest(rule["s"] - 2, F.lit(1))
            room = F.filter(places, lambda i: i + length - 1 <= n)
            return F.transform(room, lambda i: _key(rule["s"], "p", _part(v, i, length)))

        fitting = F.filter(rules, lambda r: n.between(r["lo"], r["hi"]))
        parts.append(F.flatten(F.transform(fitting, spelled)))
    # sources longer than KEY_CHARS + 2
    shortest = math.floor((KEY_CHARS + 3) * theta / (2 - theta))
    room = F.filter(places, lambda i: i + KEY_CHARS - 1 <= n)
    long_keys = F.transform(room, lambda i: F.concat(F.lit("long"), _part(v, i, F.lit(KEY_CHARS))))
    parts.append(F.when(n >= shortest, long_keys))
    keys = F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast(_NO_KEYS)) for p in parts]))
    return folded.select(*values.columns, F.explode(keys).alias("_key"))


def question_keys(questions: DataFrame, theta: float) -> DataFrame:
    """Explode ``question`` into the candidate keys of its runs of whole words, column ``_key`` (the text is dropped)."""
    exact, near, loose = _split_rules(theta)
    limit = KEY_CHARS + 2
    owner = [c for c in questions.columns if c != "question"]
    folded = questions.where("question != ''").withColumn("_q", _fold(F.col("question")))
    q = F.col("_q")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(q) - 1),
        lambda i: ~_is_separator(F.get(q, i)) & ((i == 0) | _is_separator(F.get(q, i - 1))),
    )
    # one row per word start, with the characters a key can reach and one more
    windows = F.transform(starts, lambda i: F.slice(q, i + 1, F.lit(limit + 1)))
    words = folded.select(*owner, F.explode(windows).alias("_w")).withColumn("_m", F.size("_w"))
    w, m = F.col("_w"), F.col("_m")
    ends = F.filter(
        F.sequence(F.lit(1), F.least(m, F.lit(limit))),
        lambda e: ~_is_separator(F.get(w, e - 1)) & ((e == m) | _is_separator(F.get(w, e))),
    )

    def exact_keys(e: Column) -> Column:
        return _key(e, "x", _part(w, F.lit(1), e))

    def near_keys(e: Column) -> Column:
        span = F.slice(w, F.lit(1), e)
        return F.concat(
            F.array(_key(e, "i", F.array_join(span, ""))), F.transform(_deletions(span, e), lambda t: _key(e, "d", t))
        )

    def loose_key(e: Column) -> Column:
        return _key(e, "p", _part(w, F.lit(1), F.greatest(e - 2, F.lit(1))))

    parts = [F.transform(F.filter(ends, lambda e: e <= near), exact_keys)] if near else []
    if near > exact:
        parts.append(F.flatten(F.transform(F.filter(ends, lambda e: (e > exact) & (e <= near)), near_keys)))
    if loose:
        parts.append(F.transform(F.filter(ends, lambda e: e > near), loose_key))
    beyond = F.array(F.concat(F.lit("long"), _part(w, F.lit(1), F.lit(KEY_CHARS))))
    parts.append(F.when(m > limit, beyond).otherwise(F.array().cast(_NO_KEYS)))
    return words.select(*owner, F.explode(F.array_distinct(F.concat(*parts))).alias("_key"))


def _longest_value(theta: float) -> Column:
    """How long a value can be to match ``question``."""
    if not 0 < theta <= 1:
        raise ValueError("theta must be above 0 and at most 1")
    return F.length("question") * ((2 - theta) / theta) + 1


def _short_enough(questions: DataFrame, values: DataFrame, theta: float) -> DataFrame:
    """``values`` without those that are too long for every question of their database. The limits, one per database, come to the driver,
    so that the filter goes down to the scan and long texts are not shuffled."""
    limits = questions.groupBy("db_id").agg(F.max(_longest_value(theta)).alias("most")).where("db_id is not null and most is not null").collect()
    if not limits:
        return values.limit(0)
    most = F.create_map(*[F.lit(x) for r in limits for x in (r["db_id"], r["most"])])
    return values.where(F.length("value") <= F.try_element_at(most, F.col("db_id")))


def candidate_pairs(questions: DataFrame, values: DataFrame, theta: float) -> DataFrame:
    """Distinct ``(db_id, question, value)`` that may match: every true match is among them.

    ``questions(question_id, db_id, question)``. Keys travel with an id; the text joins back to the pairs that are left.
    """
    longest = _longest_value(theta)
    texts = questions.groupBy("db_id", "question").agg(F.min("question_id").alias("_text_id"))
    asked = question_keys(texts, theta)
    offered = value_keys(values.select("db_id", "value").distinct(), theta)
    pairs = asked.join(offered, ["db_id", "_key"]).select("db_id", "_text_id", "value").distinct()
    return pairs.join(texts, ["db_id", "_text_id"]).where(F.length("value") <= longest).select("db_id", "question", "value")


# ---------------------------------------------------------------------------------------------------------------------
# The operator


def value_matches(questions: DataFrame, values: DataFrame, theta: float = 0.85) -> DataFrame:
    """All matches of ``questions(question_id, db_id, question)`` with ``values(db_id, table_name, column_name, value)``.

    Texts are stripped first. Questions and values are matched as distinct texts and joined back to their owners, so
    repeated texts cost one comparison. Values too long for all questions of their database go first.
    """
    questions = questions.withColumn("question", strip("question"))
    values = values.select(*COLUMN, strip("value").alias("value")).where("value != ''")
    values = _short_enough(questions, values, theta).distinct()
    scored = score_pairs(candidate_pairs(questions, values, theta), theta)
    return (
        scored.join(values, ["db_id", "value"])
        .join(questions.select("question_id", "db_id", "question"), ["db_id", "question"])
        .select("question_id", *COLUMN, "value", "match_str", "source_str", "score", "match_size")
    )


def sort_key(score: Column, size: Column) -> Column:
    """Ranking number of a match. Its double precision is part of the rule: at score 1 small size differences vanish."""
    return F.lit(1e16) * score + F.lit(1e8) * score + size


def last_wins_dedupe(matches: DataFrame, keys: Sequence[str] = ("question_id", *COLUMN)) -> DataFrame:
    """One row per matched text: the values overwrite each other in order, so the last one stays, at the place of the first."""
    kept = F.max_by(F.struct("value", "source_str", "score", "match_size"), F.col("value"))
    return (
        matches.groupBy(*keys, "match_str")
        .agg(kept.alias("_kept"), F.min("value").alias("first_value"))
        .select(*keys, "match_str", "_kept.*", "first_value")
    )


def topk_matches(deduped: DataFrame, k: int = 2, keys: Sequence[str] = ("question_id", *COLUMN)) -> DataFrame:
    """The best ``k`` matches per question and column, with ``rank``. In columns whose name contains ``name`` only exact
    matches count."""
    exact_only = ~F.col("column_name").contains("name") | (F.col("score") >= 1)
    best = Window.partitionBy(*keys).orderBy(F.desc(sort_key(F.col("score"), F.col("match_size"))), "first_value")
    return deduped.where(exact_only).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def value_link(questions: DataFrame, values: DataFrame, top_k: int = 2, theta: float = 0.85) -> DataFrame:
    """The ``top_k`` best values of every column for every question."""
    return topk_matches(last_wins_dedupe(value_matches(questions, values, theta)), top_k)


def matched_contents(links: DataFrame) -> DataFrame:
    """Per question the ordered ``(key, values)`` entries that a prompt prints."""
    per_column = links.groupBy("question_id", *COLUMN).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda v: v["value"]).alias("values")
    )
    entry = F.struct(F.concat_ws(".", "table_name", "column_name").alias("key"), "values")
    return per_column.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("matched_contents"))
