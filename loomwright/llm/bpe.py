"""Byte-level BPE over a prefix-sharing trie of words.

Texts are split into words as the tokenizer's pattern does. The distinct new words of a block are put in byte order, which is the
depth-first order of their trie: neighbours share the path of their common prefix, and what was found for that path is kept on a stack.
The state of a node is the last token of the encoding of its path. It is the only token t that ends the path and that stands next to
the last token of the path before t without a merge across them, so a child's state follows from the states above it; the tokens that end a
path come from an automaton, longest first. A word's encoding is read off backwards along these states.

Vocabularies are given by path and travel to the tasks as one broadcast of fixed size. Caches of words are bounded.

Defined cases: a null text counts as empty and has no ids; the text of a special token is that token; null ids decode to an empty text,
a null id and ids that are not in the vocabulary add nothing; bytes that are no UTF-8 decode to U+FFFD; repeated rows are encoded each; other columns
are kept, one with the name of the result is replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwright.llm.common import map_in_arrow, text_blocks

# The pattern that splits text before merging. Fixed value of the vocabulary's public description.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same for texts of ASCII letters only, for the faster module.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
# Distinct words and pairs that a task remembers.
MOST_WORDS = 120_000
MOST_PAIRS = 500_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others in order from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, for decoding."""

    def __init__(self, description: str):
        spec = json.loads(description)
        byte = byte_letters()
        raw = lambda s: bytes(byte[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in byte for c in s)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(x), raw(y)): rank for rank, (x, y) in enumerate(merges)}

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes.get(i, b"") for i in ids]).decode("utf-8", "replace")


class Encoder(Vocabulary):
    """What encoding needs besides: ranks of merges, endings of paths, and the words and pairs that are remembered."""

    def __init__(self, description: str):
        super().__init__(description)
        # Of each token its first and last part, and the rank at which these become the token.
        self.parts = {self.ids[x + y]: (self.ids[x], self.ids[y], r) for (x, y), r in self.ranks.items()}
        self.joins = {(self.ids[x], self.ids[y]): r for (x, y), r in self.ranks.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.sizes = [0] * (max(self.bytes) + 1)
        for i, b in self.bytes.items():
            self.sizes[i] = len(b)
        self._index_endings()
        self.pattern, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        # Of remembered words: the ids as text, and the bytes that they decode to.
        self.faces: dict[str, tuple[bytes, bytes]] = {}
        self.pairs: dict[int, bool] = {}

    def _index_endings(self) -> None:
        """What tokens end a path: an automaton over the trie of all tokens. ``longest[node]`` is the longest token that ends the
        path of a node, ``shorter[token]`` the next one after it."""
        self.steps: dict[int, int] = {}  # node << 8 | byte -> node
        origin, depth, token = [0], [0], [-1]
        for raw, i in self.ids.items():
            node = 0
            for byte in raw:
                key = node << 8 | byte
                node = self.steps.get(key, -1)
                if node < 0:
                    node = self.steps[key] = len(origin)
                    origin.append(key)
                    depth.append(depth[key >> 8] + 1)
                    token.append(-1)
            token[node] = i
        self.back = [0] * len(origin)
        self.longest = token
        self.shorter = [-1] * len(self.sizes)
        for node in sorted(range(1, len(origin)), key=depth.__getitem__):
            above, byte = origin[node] >> 8, origin[node] & 255
            if above:
                self.back[node] = self.step(self.back[above], byte)
            ending = self.longest[self.back[node]]
            if token[node] < 0:
                token[node] = ending
            else:
                self.shorter[token[node]] = ending
        # Steps that were made over ``back``.
        self.jumps: dict[int, int] = {}

    def step(self, node: int, byte: int) -> int:
        """The node of the longest ending that the tokens' trie knows after one more byte."""
        while True:
            found = self.steps.get(node << 8 | byte)
            if found is not None:
                return found
            if not node:
                return 0
            node = self.back[node]

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of ``token`` at its left (0) or right (1) end, from the byte to the token itself, each with the rank at which
        it goes into the next one."""
        found = self.spines[side].get(token)
        if found is None:
            found = [(token, float("inf"))]
            while found[-1][0] in self.parts:
                part = self.parts[found[-1][0]]
                found.append((part[side], part[2]))
            found.reverse()
            self.spines[side][token] = found
        return found

    def beside(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow ``a`` inside a word: while both are put together in the order of ranks, no merge of what
        touches at their border comes first. Among equal ranks the merge further left is first."""
        known = self.pairs.get(a << 24 | b)
        if known is not None:
            return known
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            (x, x_at), (y, y_at) = left[i], right[j]
            across = self.joins.get((x, y))
            if across is not None and across < x_at and across <= y_at:
                known = False
                break
            if x_at <= y_at:
                i += 1
            else:
                j += 1
            if i == len(left) or j == len(right):
                known = True
                break
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[a << 24 | b] = known
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each word: a depth-first walk of the trie of all words."""
        pairs, beside, sizes, longest, shorter, jumps = self.pairs, self.beside, self.sizes, self.longest, self.shorter, self.jumps
        if len(jumps) > MOST_PAIRS:
            jumps.clear()
        found = {}
        # After n bytes of the path: the last token of their encoding, and the node of the tokens' trie.
        path, states, nodes = b"", [-1], [0]
        for word in sorted(words):  # code points stand in the order of their bytes
            raw = word.encode("utf-8", "replace")
            shared = 0
            for x, y in zip(path, raw):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for end in range(shared + 1, len(raw) + 1):
                key = node << 8 | raw[end - 1]
                node = jumps.get(key)
                if node is None:
                    node = jumps[key] = self.step(key >> 8, raw[end - 1])
                token = longest[node]
                while sizes[token] < end:
                    before = states[end - sizes[token]]
                    fits = pairs.get(before << 24 | token)
                    if fits is None:
                        fits = beside(before, token)
                    if fits:
                        break
                    token = shorter[token]
                states.append(token)
                nodes.append(node)
            path, out, end = raw, [], len(raw)
            while end:
                out.append(states[end])
                end -= sizes[states[end]]
            found[word] = tuple(out[::-1])
        return found

    def known(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of these words at least. Remembered words are kept in two generations: what has not been seen for a whole
        generation is forgotten."""
        if len(self.young) + len(words) > MOST_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for w in words.difference(young):
            ids = old.get(w)
            if ids is None:
                new.append(w)
            else:
                young[w] = ids
        young.update(self.encode_words(new))
        return young

    def pieces(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.pattern).findall(text)

    def split_words(self, text: str) -> list[str]:
        if self.split is None or not self.split.search(text):
            return self.pieces(text)
        parts = self.split.split(text)
        return list(chain.from_iterable([p] if p in self.special else self.pieces(p) for p in parts))

    def words_and_ids(self, texts: list[str]) -> tuple[list[list[str]], dict[str, tuple[int, ...]]]:
        """The words of each text, and the ids of all of them at least."""
        split = [self.split_words(t) for t in texts]
        known = self.known(set(chain.from_iterable(split)).difference(self.special))
        known.update((s, (i,)) for s, i in self.special.items())
        return split, known

    def encode(self, texts: list[str]) -> list[list[int]]:
        split, known = self.words_and_ids(texts)
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]

    def coded(self, texts: list[str]) -> Iterator[tuple[list[str], bytes, str]]:
        """Of each text: its words, its ids in decimal joined by commas, and the text that the ids decode to."""
        split, known = self.words_and_ids(texts)
        faces, of = self.faces, self.bytes
        if len(faces) > MOST_WORDS:
            faces.clear()
        for word in set(chain.from_iterable(split)).difference(faces):
            ids = known[word]
            faces[word] = ",".join(map(str, ids)).encode(), b"".join([of[i] for i in ids])
        for words in split:
            own = [faces[w] for w in words]
            yield words, b",".join([f[0] for f in own]), b"".join([f[1] for f in own]).decode("utf-8", "replace")


class _Description:
    """The description of a vocabulary, and what a Python worker has made of it: that lives as long as the worker's copy of the broadcast,
    which goes when the worker takes a task of other work."""

    def __init__(self, text: str):
        self.text, self.made = text, {}

    def __getstate__(self) -> dict:
        return {"text": self.text, "made": {}}

    def vocabulary(self, kind: type[Vocabulary]) -> Vocabulary:
        if kind.__name__ not in self.made:
            self.made[kind.__name__] = kind(self.text)
        return self.made[kind.__name__]


def _shared(spark: SparkSession, path: str) -> Broadcast[_Description]:
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(_Description(f.read()))


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array, schema: pa.Schema, drop: str | None = None) -> pa.RecordBatch:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != drop} | {name: values}
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def _with(schema: T.StructType, name: str, kind: T.DataType, drop: str | None = None) -> T.StructType:
    fields = [f for f in schema.fields if f.name not in (name, drop)]
    return T.StructType([*fields, T.StructField(name, kind)])


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``; ``tokenizer`` is the path of a byte-level BPE description on the driver."""
    shared = _shared(docs.sparkSession, tokenizer)
    schema = _with(docs.schema, out, T.ArrayType(T.IntegerType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary(Encoder)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            for block in text_blocks(texts):
                ids = vocabulary.encode([t or "" for t in texts[block]])
                ends = np.cumsum([0, *map(len, ids)]).astype("int32")
                flat = np.fromiter(chain.from_iterable(ids), dtype="int32", count=int(ends[-1]))
                yield _replaced(batch.slice(block.start, len(ids)), out, pa.ListArray.from_arrays(ends, flat), arrow)

    return map_in_arrow(docs, run, schema)


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with the text of ``ids``; special tokens are written out."""
    shared = _shared(docs.sparkSession, tokenizer)
    drop = None if keep_ids else ids
    schema = _with(docs.schema, out, T.StringType(), drop)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary(Vocabulary)
        for batch in batches:
            column = batch.column(batch.schema.names.index(ids))
            for a in range(0, len(column), 256):
                part = column.slice(a, 256)
                texts = [vocabulary.decode(row or []) for row in part.to_pylist()]
                yield _replaced(batch.slice(a, 256), out, pa.array(texts, pa.string()), arrow, drop)

    return map_in_arrow(docs, run, schema)


def round_trip(docs: DataFrame, tokenizer: str, ids: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens, ids_sha256, decoded_sha256``, and the token ids as column ``ids`` if that is given.

    One pass: the ids of a text are those of its words, so their decimal text and the bytes they decode to are made once for each word that
    the task remembers; a text's are put together from these, decoded as a whole, and hashed.
    """
    shared = _shared(docs.sparkSession, tokenizer)
    results = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    results += [(ids, T.ArrayType(T.IntegerType()))] if ids else []
    taken = {"text", *(n.lower() for n, _ in results)}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in results)])
    arrow = to_arrow_schema(schema)
    digest = lambda raw: hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary(Encoder)
        for batch in batches:
            names = batch.schema.names
            column = batch.column(names.index("text"))
            sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
            for block in text_blocks(sizes, size_of=int):
                part = column.slice(block.start, block.stop - block.start)
                n, id_hashes, text_hashes, ends, flat = [], [], [], [0], []
                for words, id_text, text in vocabulary.coded([t or "" for t in part.to_pylist()]):
                    n.append(id_text.count(b",") + 1 if id_text else 0)
                    id_hashes.append(digest(id_text))
                    text_hashes.append(digest(text.encode()))
                    if ids:
                        flat += chain.from_iterable(map(vocabulary.young.__getitem__, words))
                        ends.append(len(flat))
                made = [pa.array(n, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
                made += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))] if ids else []
                own = [batch.column(names.index(f.name)).slice(block.start, len(n)) for f in kept]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*own, *made], arrow)], schema=arrow)

    return map_in_arrow(docs, run, schema)
