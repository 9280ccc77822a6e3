"""Secrets in texts: fixed patterns, and strings whose letters are too evenly spread to be words.

*Patterns* (base spans): assignments of passwords and tokens, access keys, long hexadecimal runs.
*Entropy* (added spans): candidates are runs of 20 or more letters, digits and ``+/_=-`` that hold both a letter and a digit. Each belongs
to the narrowest class of characters that holds it (``entropy_hex``, ``entropy_upper``, ``entropy_mixed``), and each class has its own
limit. A window of ``WINDOW`` characters slides along the candidate; the counts of its characters, and the sum of c * log2(c) over them,
are kept up to date by the one character that leaves and the one that enters. The span reaches from the first to the last window whose
Shannon entropy (bits a character) is at or above the limit. Candidates on the allow-list or of an allowed form are suppressed, and so
are spans that hold a word for stand-ins. The work is linear in the length of a run and n * log2(n) in the findings of a text.

A text is searched twice, for assignments and for candidates; keys and hexadecimal runs consist of a candidate's characters and are no
shorter, so they lie in candidates and are looked for there. Only a text with findings is split at them, for their places.

Positions are code points, ends exclusive. Defined cases: a null text counts as empty; a text without findings has zeros, the hash of
the empty text and an empty list; every row gives one row, repeated ones too; other columns are kept by ``find``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.arrays import running_sums
from loomwright.llm.common import text_or_empty

# Patterns of the contract, fixed values: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}+", 0, 24),  # whole runs, so that shorter ones need not be collected
)
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
# The same matches, found faster: candidates begin where a run does, and an assignment's word (the first pattern) with three of few letters.
_RUN = rf"(?<![A-Za-z0-9+/_=-]){CANDIDATE}"
_ASSIGNMENT = rf"(?=[pstaPSTA][aeopAEOP][sckiSCKI]){BASE[0][1]}"
# Classes from narrow to wide: name, characters, limit in bits a character for windows of 20.
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", 3.0),
    ("entropy_upper", r"^[A-Z0-9]+$", 3.5),
    ("entropy_mixed", r"^.+$", 3.8),
)
# Known harmless strings and forms.
ALLOWED = ("0123456789abcdef0123456789abcdef", "d41d8cd98f00b204e9800998ecf8427e", "abcdefghijklmnopqrstuvwxyz0123456789")
ALLOWED_FORMS = (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",)
# A span that holds one of these is a stand-in; the same word beside a span hides nothing.
ALLOWED_WORDS = r"(?i)example|sample|placeholder|dummy"
# Counts are kept for the codes from "+" to "z", and windows are worked through in chunks.
FIRST_CODE, CODES = 43, 80
CHUNK = 480


def _struct(start: Column, order: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), order.cast("int").alias("kind"), end.cast("int").alias("end"))


_MATCHES = "array<struct<start:int,end:int,hit:string>>"


def matches(text: Column, pattern: str, hits: Column | None = None) -> Column:
    """``array<struct<start, end, hit>>`` of the leftmost non-overlapping matches. What lies between them comes from a split
    at the same pattern; ends are running sums of the lengths. ``hits`` may give the matched texts, then a text without any is not split."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) if hits is None else hits
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(between, F.lit(1), F.size(hits)).alias("gap"))
    ends = running_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])))

    def found(end: Column, hit: Column) -> Column:
        return F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit"))

    return F.when(F.size(hits) > 0, F.zip_with(ends, hits, found)).otherwise(F.array().cast(_MATCHES))


def _base(found: Column, order: int, pattern: str, group: int, least: int, offset: Column | int = 0) -> Column:
    """Spans of the matches ``found`` whose group is long enough. A matched text alone is matched in the same way."""
    long = F.filter(found, lambda m: F.length(F.regexp_extract(m["hit"], pattern, group)) >= least)
    return F.transform(long, lambda m: _struct(m["start"] + offset, F.lit(order), m["end"] + offset))


def _base_in_runs(runs: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern whose long matches lie in candidates."""

    def inside(run: Column) -> Column:
        return F.when(run["hit"].rlike(pattern), _base(matches(run["hit"], pattern), order, pattern, group, least, run["start"]))

    return F.flatten(F.filter(F.transform(runs, inside), lambda spans: spans.isNotNull()))


def _hot_in_chunk(chars: Column, limit: Column, window: int) -> Column:
    """``struct<first, last>``: places in ``chars`` (from 1) at which the first and the last hot window end; nulls if none is hot.

    The state holds the counts as a text, one letter for each code from ``FIRST_CODE`` on (A for 0, B for 1 and so on). A step changes
    the letter of the character that leaves and the letter of the one that enters; it looks at the sum that the step before left."""
    log = math.log2(window)
    weights = [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    more = F.lit([0.0] + [weights[n] - weights[n - 1] for n in range(1, window + 1)])

    def code(i: Column) -> Column:
        return F.ascii(F.get(chars, i)) - (FIRST_CODE - 1)

    def count(counts: Column, c: Column) -> Column:
        return F.ascii(F.substring(counts, c, F.lit(1))) - 65

    def put(counts: Column, c: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + 65), c, F.lit(1))

    def step(state: Column, at: Column) -> Column:
        i, into, out = at["i"], at["into"], at["out"]
        left = count(state["counts"], out)
        entered = count(state["counts"], into) + F.when(into == out, 0).otherwise(1)
        rest = F.when(out.isNull(), state["counts"]).otherwise(put(state["counts"], out, left - 1))
        # Rounded, because running sums and fresh sums differ in their last bits.
        hot = (i >= window) & (F.round(F.lit(log) - state["total"] / window, 9) >= limit)
        return F.struct(
            put(rest, into, entered).alias("counts"),
            (state["total"] - F.coalesce(F.get(more, left), F.lit(0.0)) + F.get(more, entered)).alias("total"),
            F.when(hot & state["first"].isNull(), i).otherwise(state["first"]).alias("first"),
            F.when(hot, i).otherwise(state["last"]).alias("last"),
        )

    # One place more than characters, for a look at the last sum.
    places = F.transform(
        F.sequence(F.lit(0), F.size(chars)),
        lambda i: F.struct(i.alias("i"), code(i).alias("into"), F.when(i >= window, code(i - window)).alias("out")),
    )
    start = F.struct(
        F.lit("A" * CODES).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(places, start, step, lambda s: F.struct(s["first"], s["last"]))


def hot_windows(text: Column, limit: Column, window: int = WINDOW) -> Column:
    """``struct<first, last>``: first and last position (from 1) at which a window ends whose entropy reaches ``limit``; nulls if
    none does. The text, of the characters of ``CANDIDATE`` only, is cut once into chunks of ``CHUNK`` characters, each followed by the
    ``window - 1`` characters after it, so every window lies in one chunk and no step touches the whole text."""
    chunks = F.regexp_extract_all(text, F.lit(f".{{1,{CHUNK}}}"), F.lit(0))
    after = F.regexp_extract_all(text, F.lit(f".{{1,{CHUNK}}}(?=(.{{0,{window - 1}}}))"), F.lit(1))
    chars = F.zip_with(chunks, after, lambda c, a: F.split(F.concat(c, a), ""))

    def in_text(piece: Column, k: Column) -> Column:
        # a piece bound by a lambda is cut into characters once
        return F.transform(F.array(_hot_in_chunk(piece, limit, window)), lambda h: F.struct(
            (h["first"] + k * CHUNK).alias("first"), (h["last"] + k * CHUNK).alias("last")
        ))[0]

    hot = F.transform(chars, in_text)
    return F.transform(F.array(hot), lambda h: F.struct(
        F.array_min(F.transform(h, lambda x: x["first"])).alias("first"),
        F.array_max(F.transform(h, lambda x: x["last"])).alias("last"),
    ))[0]


def _entropy(runs: Column, allowed: Sequence[str], forms: Sequence[str], words: str) -> Column:
    """Spans of the hot windows of the candidates among ``runs``. Kinds are numbered after the base kinds."""

    def suspicious(m: Column) -> Column:
        hit = m["hit"]
        ok = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~F.lower(hit).isin(*allowed)
        for form in forms:
            ok = ok & ~hit.rlike(form)
        return ok

    def classed(m: Column) -> Column:
        kind, limit = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i, (_, chars, bits) in reversed(list(enumerate(CLASSES))):
            kind = F.when(m["hit"].rlike(chars), F.lit(len(BASE) + i)).otherwise(kind)
            limit = F.when(m["hit"].rlike(chars), F.lit(bits)).otherwise(limit)
        return F.struct(m["start"].alias("start"), m["hit"].alias("hit"), kind.alias("kind"), limit.alias("limit"))

    def hot(c: Column) -> Column:
        return F.struct(c["start"], c["hit"], c["kind"], hot_windows(c["hit"], c["limit"]).alias("hot"))

    def harmful(h: Column) -> Column:
        first, last = h["hot"]["first"], h["hot"]["last"]
        return first.isNotNull() & ~F.substring(h["hit"], first - WINDOW + 1, last - first + WINDOW).rlike(words)

    def span(h: Column) -> Column:
        return _struct(h["start"] + h["hot"]["first"] - WINDOW, h["kind"], h["start"] + h["hot"]["last"])

    found = F.transform(F.transform(F.filter(runs, suspicious), classed), hot)
    return F.transform(F.filter(found, harmful), span)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*BASE, *CLASSES)])
    texts = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(texts, ",")


def find(
    docs: DataFrame,
    text: str = "text",
    allowed: Sequence[str] = ALLOWED,
    forms: Sequence[str] = ALLOWED_FORMS,
    words: str = ALLOWED_WORDS,
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``: arrays of (start, kind, end) by start, then kind; a kind is a place in
    ``BASE`` + ``CLASSES``."""
    body = text_or_empty(text)
    hits = {"__assigned": _ASSIGNMENT, "__runs": _RUN}
    searched = docs.withColumns({name: F.regexp_extract_all(body, F.lit(pattern), F.lit(0)) for name, pattern in hits.items()})
    placed = searched.withColumns({name: matches(body, pattern, F.col(name)) for name, pattern in hits.items()})
    runs = F.col("__runs")
    base = [_base(F.col("__assigned"), 0, *BASE[0][1:]), *[_base_in_runs(runs, i, *spec[1:]) for i, spec in enumerate(BASE) if i > 0]]
    return (
        placed.withColumn("base_spans", F.array_sort(F.concat(*base)))
        .withColumn("all_spans", F.array_sort(F.concat("base_spans", _entropy(runs, allowed, forms, words))))
        .drop(*hits)
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``[SECRET]``; overlapping spans become one."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, span: Column) -> Column:
        apart = span["start"] >= s["at"]
        gap = F.substring(text, s["at"] + 1, span["start"] - s["at"])
        out = F.when(apart, F.concat(s["out"], gap, F.lit("[SECRET]"))).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], span["end"]).alias("at"))

    def rest(s: Column) -> Column:
        return F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))

    return F.aggregate(spans, state, step, rest)


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    found = find(docs.select("doc_id", "text")).withColumn("spans", _joined(F.col("all_spans")))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [F.size(kinds) - F.size(F.array_remove(kinds, i)) for i in range(len(BASE))]
    base = F.sha2(_joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(n.cast("long").alias(f"n_{k[0]}") for n, k in zip(counts, BASE)), base, "spans")
