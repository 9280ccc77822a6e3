"""Pre-training corpora: text, tokens, slices, and fixed-size blocks of one continuous token stream."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import strip
from loomwright.operators.ordering import ordered_index

# Corpus order in the packed stream, and the divisors that give the slices.
CORPORA = ("pure_sql", "text2code", "text2text")
SLICE_DIVISORS = (2, 4, 6, 8)
SHARDS = 2048
# Token ids are stored in two bytes, the usual vocabulary has this many entries.
MAX_TOKEN_ID = 65535
VOCABULARY_SIZE = 49152

# Ids: the end of a sequence, one that is kept free, the 256 bytes, then words by falling frequency.
EOS, FREE, FIRST_BYTE_ID, FIRST_WORD_ID = 0, 1, 2, 258
# A word is a run of letters, a run of digits, or any other single character, so that words put together give the text again.
WORD_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}]"
# Longer words are spelled in bytes, which bounds the size of a vocabulary.
LONGEST_WORD = 64
KEY = ["corpus_ord", "corpus", "idx"]


def corpus_text(df: DataFrame, *parts: str) -> DataFrame:
    """Replace the text columns by ``sequence``: the parts on lines of their own, stripped at both ends."""
    joined = F.concat_ws("\n", *parts) if len(parts) > 1 else F.col(parts[0])
    return df.select(*[c for c in df.columns if c not in parts], strip(joined).alias("sequence"))


def corpus_union(corpora: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The corpora one after another. Each frame needs ``idx`` (its row order) and ``sequence``."""
    out = None
    for name, df in corpora:
        part = df.select(
            F.lit(CORPORA.index(name)).alias("corpus_ord"), F.lit(name).alias("corpus"), F.col("idx"), "sequence"
        )
        out = part if out is None else out.unionByName(part)
    return out


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return (F.octet_length(text) == F.length(text)) & F.is_valid_utf8(text)


# Classes of bytes: 1 letters, 2 digits, 0 others.
_CLASSES = np.array([1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 0 for i in range(128)] + [0] * 128, dtype=np.uint8)
# Bytes of texts that are taken apart at a time.
STEP_BYTES = 4_000_000


def ascii_words(texts: pa.Array) -> pa.ListArray:
    """The words of texts of ASCII characters, as :func:`words` gives them. They stand in the texts one after another, so their bytes stay where
    they are; a null has none."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    first, end = int(offsets[0]), int(offsets[-1])
    data = texts.buffers()[2].slice(first, end - first) if end > first else pa.py_buffer(b"")
    kind = _CLASSES[np.frombuffer(data, dtype=np.uint8)]
    begins = np.ones(end - first + 1, dtype=bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
    begins[offsets - first] = True
    starts = np.flatnonzero(begins).astype(np.int32)  # and the end
    found = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), data])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets - first), pa.int32()), found)


def _either(plain: pa.Array, listed: pa.Array) -> pa.ListArray:
    """The words of each text, which is given as it is or, by ``listed``, as its words."""
    split = ascii_words(plain)
    if listed.null_count == len(listed):
        return split
    sizes = [np.nan_to_num(x.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64) for x in (split, listed)]
    flat = pa.concat_arrays([split.flatten(), listed.flatten().cast(pa.string())])
    place = np.where(sizes[0] > 0, _bounds(sizes[0])[:-1], sizes[0].sum() + _bounds(sizes[1])[:-1])
    ends = _bounds(n := sizes[0] + sizes[1])
    at = np.arange(ends[-1]) + np.repeat(place - ends[:-1], n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.take(pa.array(at)))


def _steps(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of rows of about ``most`` in all."""
    start, sums = 0, np.cumsum(sizes)
    while start < len(sizes):
        stop = max(int(np.searchsorted(sums, (sums[start - 1] if start else 0) + most, "right")), start + 1)
        yield slice(start, stop)
        start = stop


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``word, n``, a word in several rows. Words of ASCII texts are found and counted in batches by Arrow functions, without a row per word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _steps(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), STEP_BYTES):
                plain, listed = (c[part] for c in batch.columns)
                found = pc.value_counts(_either(plain, listed).flatten())
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    plain = F.when(_is_ascii(F.col(text)), F.col(text))
    listed = F.when(~_is_ascii(F.col(text)), words(F.col(text)))
    return df.select(plain.alias("plain"), listed.alias("listed")).mapInArrow(counted, "word string, n bigint")


def vocabulary(df: DataFrame, text: str = "sequence", size: int = VOCABULARY_SIZE) -> DataFrame:
    """``(word, token_id)`` by falling frequency, then by word.

    ``size`` ids are given in all, with the end mark and the bytes that spell every other word, so the result has fewer than ``size`` rows of
    at most ``LONGEST_WORD`` characters and may be broadcast. These rows pass one task.
    """
    found = word_counts(df, text).where(F.length("word") <= LONGEST_WORD)
    counts = found.groupBy("word").agg(F.sum("n").alias("n"))
    kept = counts.orderBy(F.desc("n"), "word").limit(max(size - FIRST_WORD_ID, 0))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return kept.select("word", (rank + (FIRST_WORD_ID - 1)).cast("int").alias("token_id"))


def _known(vocab: DataFrame):
    """The vocabulary as a broadcast of ``(words, token ids)``. It is bounded (see :func:`vocabulary`), as for a broadcast join."""
    table = vocab.select("word", F.col("token_id").cast("int")).toArrow().combine_chunks()
    return vocab.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), table.column(1).to_numpy()))


def _bounds(lengths: np.ndarray) -> np.ndarray:
    """Where each part begins, and at last where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def ids_of_words(texts: pa.Array, words: pa.Array, token_ids: np.ndarray) -> pa.Array:
    """The ids of each row and the end mark; a row is a list of texts, each the list of its words.

    A row nearly always is one text. Of several, the words stand by their place, those of one place by their ids.
    """
    parts = texts.flatten()
    flat = parts.flatten()
    at = pc.index_in(flat, value_set=words.cast(flat.type))
    known = at.is_valid().to_numpy(zero_copy_only=False)
    spelled = flat.filter(pa.array(~known)).cast(pa.binary())
    sizes = np.ones(len(flat), dtype=np.int64)
    sizes[~known] = pc.binary_length(spelled).to_numpy(zero_copy_only=False)
    ids = np.empty(sizes.sum(), dtype=np.int32)
    of_known = np.repeat(known, sizes)
    ids[of_known] = token_ids[at.drop_null().to_numpy(zero_copy_only=False)]
    ids[~of_known] = np.frombuffer(b"".join(spelled.to_pylist()), dtype=np.uint8).astype(np.int32) + FIRST_BYTE_ID
    of_word, of_part = _bounds(sizes), _bounds(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    counts = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    of_text = _bounds(counts)
    for row in np.flatnonzero(counts > 1).tolist():
        placed = []
        for part in range(of_text[row], of_text[row + 1]):
            first, end = of_part[part], of_part[part + 1]
            placed += [(i - first, ids[of_word[i] : of_word[i + 1]].tolist()) for i in range(first, end)]
        start, end = of_word[of_part[of_text[[row, row + 1]]]]
        ids[start:end] = [i for _, word in sorted(placed) for i in word]
    ends = of_word[of_part[of_text]]
    whole = np.insert(ids, ends[1:], EOS)
    return pa.ListArray.from_arrays(pa.array(ends + np.arange(len(ends)), pa.int32()), pa.array(whole, pa.int32()))


def ids_of_texts(vocab: DataFrame):
    """The function that :func:`tokenize` applies to a column with lists of texts. ASCII texts are taken apart beside the vocabulary, others
    here, where the rules of ``WORD_PATTERN`` are at hand."""
    shared = _known(vocab)

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for plain, listed in batches:
            if not len(plain):
                yield pa.array([], pa.list_(pa.int32()))
                continue
            counts = plain.value_lengths().to_numpy()
            ends = _bounds(counts)
            texts, lists = plain.flatten(), listed.flatten()
            bytes_before = _bounds(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            done = []
            for rows in _steps(np.diff(bytes_before[ends]), STEP_BYTES):
                of = slice(int(ends[rows.start]), int(ends[rows.stop]))
                parts = _either(texts[of], lists[of])
                offsets = pa.array(ends[rows.start : rows.stop + 1] - ends[rows.start], pa.int32())
                done.append(ids_of_words(pa.ListArray.from_arrays(offsets, parts), *shared.value))
            yield pa.concat_arrays(done)

    def of(texts: Column) -> Column:
        plain = F.transform(texts, lambda t: F.when(_is_ascii(t), t))
        return ids(plain, F.transform(texts, lambda t: F.when(~_is_ascii(t), words(t))))

    return of


def tokenize(df: DataFrame, vocab: DataFrame, keys: Sequence[str], text: str = "sequence", ranges: int | None = None) -> DataFrame:
    """``input_ids`` (ids of words or, where the vocabulary lacks a word, of its bytes, and the end mark) and ``length`` per row; other
    columns are dropped. ``detokenize`` gives the text again.

    Rows are first partitioned by their key, as plain text, which is smaller than its tokens. Its words are looked up inside the row: no
    row per token is made, sorted or moved. Rows with the same key become one. With ``ranges``, so many partitions hold
    ranges of keys, in order.
    """
    ids = ids_of_texts(vocab)
    dealt = df.select(*keys, text)
    dealt = dealt.repartition(*keys) if ranges is None else dealt.repartitionByRange(ranges, *keys)
    texts = dealt.groupBy(*keys).agg(F.collect_list(text).alias("_texts"))
    tokens = texts.select(*keys, ids(F.col("_texts")).alias("input_ids"))
    tokens = tokens.withColumn("length", F.size("input_ids").cast("bigint"))
    return tokens if ranges is None else tokens.sortWithinPartitions(*keys)


def bytes_of_ids(sequences: pa.Array, words: pa.Array, token_ids: np.ndarray) -> pa.Array:
    """The bytes of each row, a list of id lists (nearly always one, see :func:`ids_of_words`)."""
    own = np.arange(FIRST_BYTE_ID, FIRST_WORD_ID)
    own = own[~np.isin(own, token_ids)]
    order = np.argsort(token_ids, kind="stable")
    spelled = pa.array([bytes([i - FIRST_BYTE_ID]) for i in own.tolist()], pa.binary())
    # marks and unknown ids are the empty text at the end
    pieces = pa.concat_arrays([words.cast(pa.binary()).take(pa.array(order)), spelled, pa.array([b""], pa.binary())])
    known = np.concatenate([token_ids[order], own])
    by_id = np.argsort(known, kind="stable")
    parts = sequences.flatten()
    flat = pc.fill_null(parts.flatten(), EOS).to_numpy(zero_copy_only=False)
    place = np.searchsorted(known[by_id], flat)
    at = np.append(by_id, len(known))[place]
    at[np.append(known, -1)[at] != flat] = len(known)
    of_part, counts = _bounds(pc.list_value_length(parts).to_numpy(zero_copy_only=False)), pc.list_value_length(sequences).to_numpy(zero_copy_only=False)
    of_row = _bounds(counts)
    taken = pieces.take(pa.array(at))
    for row in np.flatnonzero(counts > 1).tolist():
        ranges = [np.arange(of_part[p], of_part[p + 1]) for p in range(of_row[row], of_row[row + 1])]
        placed = sorted((i - r[0], taken[i].as_py(), at[i]) for r in ranges for i in r.tolist())
        at[of_part[of_row[row]] : of_part[of_row[row + 1]]] = [p[2] for p in placed]
    if (counts > 1).any():
        taken = pieces.take(pa.array(at))
    ends = _bounds(pc.binary_length(taken).to_numpy(zero_copy_only=False))[of_part[of_row]]
    data = taken.buffers()[2] or pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.array(ends, pa.int32()).buffers()[1], data])


def detokenize(tokens: DataFrame, vocab: DataFrame, keys: Sequence[str], out: str = "sequence") -> DataFrame:
    """``keys`` and the text of ``input_ids``; marks add nothing. Ids are looked up inside the row."""
    shared = _known(vocab)

    @F.arrow_udf("binary")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield bytes_of_ids(batch, *shared.value)

    whole = tokens.groupBy(*keys).agg(F.collect_list("input_ids").alias("_ids"))
    return whole.select(*keys, F.decode(spelled("_ids"), "UTF-8").alias(out))


def tokenize_with(df: DataFrame, encode, keys: Sequence[str], eos: int, text: str = "sequence") -> DataFrame:
    """As :func:`tokenize` with a real tokenizer: ``encode(list of texts) -> list of id lists`` is called per Arrow batch."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([[*found, eos] for found in encode(texts.tolist())])

    return df.select(*keys, ids(F.col(text)).alias("input_ids")).withColumn("length", F.size("input_ids").cast("bigint"))


def slice_sizes(tokens: DataFrame, divisors: Sequence[int] = SLICE_DIVISORS) -> DataFrame:
    """``(corpus, slice, divisor, cut)``: how many leading rows of each corpus belong to each slice. The SQL corpus takes
    twice its share."""
    sizes = tokens.groupBy("corpus_ord", "corpus").agg(F.count(F.lit(1)).alias("n"))
    cuts = F.array(*[F.struct(F.lit(i).alias("slice"), F.lit(d).alias("divisor")) for i, d in enumerate(divisors)])
    share = F.expr("n div divisor") * F.when(F.col("corpus") == "pure_sql", 2).otherwise(1)
    return sizes.select("corpus_ord", "corpus", "n", F.inline(cuts)).withColumn("cut", share)


def corpus_slices(tokens: DataFrame, divisors: Sequence[int] = SLICE_DIVISORS) -> DataFrame:
    """One row per (slice, sequence): the slices are prefixes of each corpus, so a row may be in several.

    ``tokens`` needs the corpus key columns with ``idx`` counting from 0. The cut table has one row per corpus and slice.
    """
    cuts = slice_sizes(tokens, divisors).select("corpus", "slice", "cut")
    return tokens.join(F.broadcast(cuts), "corpus").where(F.col("idx") < F.col("cut")).drop("cut")


def corpus_token_count(slices: DataFrame) -> DataFrame:
    """Tokens per slice and corpus, with the slice's total where ``corpus`` is NULL."""
    per_corpus = slices.groupBy("slice", "corpus").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"))
    return (
        per_corpus.rollup("slice", "corpus")
        .agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_rows").alias("n_rows"))
        .where(F.col("slice").isNotNull())
    )


def row_index(df: DataFrame, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Add ``idx``, the position by ``order``. Only the key columns take part in the ordering."""
    keys = [*group, *order]
    index = ordered_index(df.select(*keys), order, group, name="idx")
    return df.join(index, keys)


def prefix_offset(tokens: DataFrame, streams: Sequence[str] = ()) -> DataFrame:
    """``offset`` of every sequence in the stream of all corpora, in corpus order and then row order; with ``streams`` one
    stream for each of their values.

    Only keys and lengths are ordered; the result holds no token arrays.
    """
    narrow = tokens.select(*streams, *KEY, "length")
    return ordered_index(narrow, ["corpus_ord", "idx"], streams, name="seq", weight="length")


def pack_blocks(tokens: DataFrame, block_size: int, streams: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """Cut the stream of all sequences into blocks of ``block_size`` tokens; the incomplete last block is dropped.

    With ``streams`` (columns that are never null, such as ``slice``) each of their values has a stream and block numbers of its own.
    A sequence is cut where blocks end, and the pieces of a block are put together; a block has at most ``block_size``
    pieces. Attention masks are all ones and labels equal the ids. ``ordered`` says that ``tokens`` is a written copy whose rows stand in
    the order of the one stream, partition after partition: then nothing is moved, and the blocks stand in order too.
    """
    if ordered:
        return _blocks(_ordered_blocks(tokens, block_size), block_size, ())
    keys = [*streams, *KEY]
    offsets = prefix_offset(tokens, streams).select(*keys, "offset")
    pieces = _pieces(tokens.select(*keys, "input_ids", "length").join(offsets, keys), block_size, streams)
    packed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda p: p["ids"]))
    return _blocks(pieces.groupBy(*streams, "block_id").agg(packed.alias("input_ids")), block_size, streams)


def pack_slices(tokens: DataFrame, block_size: int, divisors: Sequence[int] = SLICE_DIVISORS) -> DataFrame:
    """``pack_blocks(corpus_slices(tokens), block_size, ["slice"])``, with each sequence's places in all slices in one list, so that its
    ids meet them once and not once per slice. ``tokens`` as for :func:`corpus_slices`.

    Slices are prefixes, so a sequence often has one place in several of them: its pieces move once and name their slices.
    """
    narrow = corpus_slices(tokens.select(*KEY, "length"), divisors)
    places = prefix_offset(narrow, ["slice"]).groupBy(*KEY, "offset").agg(F.collect_list("slice").alias("_slices"))
    places = places.groupBy(*KEY).agg(F.collect_list(F.struct("offset", "_slices")).alias("_places"))
    placed = tokens.select(*KEY, "input_ids", "length").join(places, KEY).select("input_ids", "length", F.inline("_places"))
    pieces = _pieces(placed, block_size, ["_slices"])
    blocks = pieces.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "_slices"))).alias("_pieces"))
    of_block = F.array_distinct(F.flatten(F.transform("_pieces", lambda p: p["_slices"])))
    of_slice = F.filter("_pieces", lambda p: F.array_contains(p["_slices"], F.col("slice")))
    blocks = blocks.select("block_id", "_pieces", F.explode(of_block).alias("slice"))
    return _blocks(blocks.withColumn("input_ids", F.flatten(F.transform(of_slice, lambda p: p["ids"]))), block_size, ["slice"])


def _flat_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).flatten().to_numpy()


def _ordered_blocks(tokens: DataFrame, block_size: int) -> DataFrame:
    """``block_id`` and ``input_ids`` of the complete blocks; each is made in the partition where it begins. What it needs from the partitions after
    that are their first ids, fewer than ``block_size``: one row per partition comes to the driver and goes out to all."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, head = 0, np.empty(0, dtype=np.int32)
        for batch in batches:
            ids = _flat_ids(batch)
            n, head = n + len(ids), np.concatenate([head, ids[: block_size - 1 - len(head)]])
        row = [[TaskContext.get().partitionId()], [n], [head.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.list_(pa.int32())))], ["part", "n", "head"])

    ids = tokens.select("input_ids")
    found = {r.part: r for r in ids.mapInArrow(heads, "part int, n bigint, head array<int>").collect()}
    starts, rests, end = {}, {}, 0
    for part in sorted(found):
        starts[part], end = end, end + found[part].n
    rest: list[int] = []  # the first ids after a partition
    for part in sorted(found, reverse=True):
        rests[part] = np.array(rest, dtype=np.int32)
        rest = [*found[part].head, *rest][: block_size - 1]
    known = tokens.sparkSession.sparkContext.broadcast((starts, rests))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rests = known.value
        part = TaskContext.get().partitionId()
        block = -(-starts[part] // block_size)
        before = block * block_size - starts[part]  # ids of a block that begins earlier
        left = np.empty(0, dtype=np.int32)

        def blocks(ids: np.ndarray) -> pa.RecordBatch:
            count = len(ids) // block_size
            lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1) * block_size, pa.int32()), pa.array(ids[: count * block_size], pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(np.arange(block, block + count), pa.int64()), lists], ["block_id", "input_ids"])

        for batch in batches:
            ids = _flat_ids(batch)
            skipped = min(before, len(ids))
            before -= skipped
            ids = np.concatenate([left, ids[skipped:]])
            yield (made := blocks(ids))
            block += made.num_rows
            left = ids[made.num_rows * block_size :]
        if len(left):
            yield blocks(np.concatenate([left, rests[part][: block_size - len(left)]]))

    return ids.mapInArrow(cut, "block_id bigint, input_ids array<int>")


def _pieces(placed: DataFrame, block_size: int, streams: Sequence[str]) -> DataFrame:
    """``streams``, ``block_id``, ``at`` and ``ids`` of the parts of sequences that know their ``offset``."""
    first = F.expr(f"offset div {block_size}")
    last = F.expr(f"(offset + length - 1) div {block_size}")
    within = (F.col("offset") % block_size).cast("int")

    def piece(block: Column) -> Column:
        # 1-based start of this block's part inside the sequence
        start = F.greatest((block - first) * block_size - within, F.lit(0)).cast("int") + 1
        stop = ((block - first + 1) * block_size - within).cast("int")
        ids = F.slice("input_ids", start, F.least(stop, F.size("input_ids")) - start + 1)
        return F.struct(block.alias("block_id"), F.when(block == first, within).otherwise(0).alias("at"), ids.alias("ids"))

    return placed.where("length > 0").select(*streams, F.inline(F.transform(F.sequence(first, last), piece)))


def _blocks(blocks: DataFrame, block_size: int, streams: Sequence[str]) -> DataFrame:
    """The complete blocks, with mask and labels."""
    return blocks.where(F.size("input_ids") == block_size).select(
        *streams,
        "block_id",
        "input_ids",
        F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask"),
        F.col("input_ids").alias("labels"),
    )


def contiguous_shard(df: DataFrame, n_rows: Column, shards: int = SHARDS, idx: str = "idx") -> DataFrame:
    """Add ``shard``: ``shards`` contiguous runs, of which the first ``n_rows mod shards`` hold one row more."""
    spare = n_rows % shards
    size = F.floor(n_rows / shards)
    i = F.col(idx)
    long_rows = spare * (size + 1)
    shard = F.when(i < long_rows, F.floor(i / (size + 1))).otherwise(spare + F.floor((i - long_rows) / size))
    return df.withColumn("shard", shard.cast("bigint"))


def shuffled_batches(
    df: DataFrame, key: str, epochs: int, batch_size: int, seed: int = 0, drop_last: bool = True
) -> DataFrame:
    """``(epoch, batch_id, pos, key)``: the keys of ``df`` in a new seeded order every epoch, cut into batches.

    The order is by a hash of seed, epoch and key, so it is the same in every run and on every cluster.
    """
    planned = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")))
    placed = ordered_index(planned.withColumn("_draw", draw), ["_draw", key], ["epoch"], name="_at")
    batches = placed.select(
        "epoch", F.expr(f"_at div {batch_size}").alias("batch_id"), (F.col("_at") % batch_size).alias("pos"), key
    )
    if not drop_last:
        return batches
    full = batches.groupBy("epoch").agg(F.expr(f"count(1) div {batch_size}").alias("_full"))
    return batches.join(F.broadcast(full), "epoch").where("batch_id < _full").drop("_full")  # one row per epoch


# Fixed values of the round function: two multipliers, and two primes below 2^31 so that no product passes 63 bits.
ROUNDS = 6
MULTIPLIERS = (1_103_515_245, 1_597_334_677)
PRIMES = (2_147_483_647, 2_147_483_629)


def permuted_place(i: Column, n: int, epoch: Column, seed: int = 0) -> Column:
    """The place of row ``i`` (from 0) among ``n`` rows in the order of an epoch: a keyed permutation, computed from ``i`` alone.

    A Feistel network over a grid of ``a * b >= n`` cells, a and b near the square root of n: in turn, the one coordinate is moved by
    a keyed hash of the other. At most a - 1 cells lie beyond n; who lands there walks on until below n, which takes at most
    as many turns as there are such cells, so the fold below never ends too early. Needs n below 2^60.
    """
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    base = F.lit(seed % PRIMES[0]).cast("bigint") * 7919 + epoch.cast("bigint") * 104_729 + 12_345
    rounds = F.array(*[
        F.struct((((base + r * 1_299_709) % PRIMES[0]) * MULTIPLIERS[1] % PRIMES[1]).alias("key"), F.lit(b if r % 2 else a).cast("bigint").alias("size")) for r in range(ROUNDS)
    ])

    def turn(cell: Column, rnd: Column) -> Column:
        # the third power, because a straight line leaves orders of small tables that go with the index
        line = (cell["y"] * MULTIPLIERS[0] + rnd["key"]) % PRIMES[0]
        cube = ((line * line) % PRIMES[0] * line + rnd["key"]) % PRIMES[0]
        hashed = F.shiftright((cube * MULTIPLIERS[1]) % PRIMES[1], 10)
        return F.struct(cell["y"].alias("x"), ((cell["x"] + hashed) % rnd["size"]).alias("y"))

    def once(at: Column) -> Column:
        start = F.struct((at % a).alias("x"), F.call_function("div", at, F.lit(a).cast("bigint")).alias("y"))
        return F.aggregate(rounds, start, turn, lambda cell: cell["y"] * a + cell["x"])

    first = once(i.cast("bigint"))
    walk = F.sequence(F.lit(1), F.lit(max(a * b - n, 1)))
    # a lambda's variable is computed once, where the column would be computed for each use
    return F.transform(
        F.array(first), lambda p: F.when(p < n, p).otherwise(F.aggregate(walk, p, lambda q, _: F.when(q < n, q).otherwise(once(q))))
    )[0]


def permuted_batches(
    indexed: DataFrame, n_rows: int, key: str, epochs: int, batch_size: int, seed: int = 0, done: int = 0, drop_last: bool = True
) -> DataFrame:
    """``(epoch, batch_id, pos, key)`` as :func:`shuffled_batches`, from the rows' index ``idx`` (0 to ``n_rows`` - 1) by arithmetic.

    No epoch is sorted or shuffled, and to resume after ``done`` batches is a filter on the computed place. An empty table gives no rows.
    """
    per_epoch = n_rows // batch_size if drop_last else -(-n_rows // batch_size)
    planned = indexed.select(key, "idx", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    placed = planned.withColumn("_at", permuted_place(F.col("idx"), n_rows, F.col("epoch"), seed))
    batches = placed.select(
        "epoch", F.expr(f"_at div {batch_size}").alias("batch_id"), (F.col("_at") % batch_size).alias("pos"), key
    )
    return batches.where((F.col("batch_id") < per_epoch) & (F.col("epoch") * F.lit(per_epoch).cast("bigint") + F.col("batch_id") >= done))


def training_plan(n_rows: int, batch_size: int, epochs: float, warmup_ratio: float) -> dict[str, int]:
    """Steps of a run over ``n_rows`` examples, and its warm-up steps."""
    total = math.ceil(epochs * math.ceil(n_rows / batch_size))
    return {"total_steps": total, "warmup_steps": max(int(total * warmup_ratio), 1)}
