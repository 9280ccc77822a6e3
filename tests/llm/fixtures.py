"""Small corpora with every odd case: nulls in each column, empty and very long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, score string, ids string, "
    "node string, shard string, n string, row string"
)


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, len(text or ""), *(["own"] * 8))


def sentence(rng: random.Random, words: int) -> str:
    parts = ["the", "on", "tree", "house", "River", "walk", "ing", "blue", "tion", "stone", "a", "of", "seven", "mor", "gen"]
    return " ".join(rng.choice(parts) + rng.choice(["", "s", "er", "x"]) for _ in range(words))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(12)]
    out = [row(i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", "s3", None])) for i, t in enumerate(base)]
    out += [row(100 + i, base[0]) for i in range(12)]  # a third of the rows are copies of one text
    out += [row(120, base[1].replace(" ", "\t\n")), row(121, base[2].upper()), row(122, base[3] + " one more")]
    words = base[4].split()
    for i in range(6):  # a chain: each differs from the one before in one word
        words[5 * i + 2] = f"new{i}"
        out.append(row(130 + i, " ".join(words)))
    out += [row(140, None), row(141, ""), row(142, " \n\t "), row(143, "two words"), row(144, "two  words"), row(145, "12 ?! 34")]
    out += [row(None, "no id at all here"), row(None, None, None, None), row(150, "same row"), row(150, "same row")]
    out += [row(151, "ünïcödé ſtraße K 日本語 😀 <|endoftext|> end"), row(152, sentence(rng, 30_000), None, "long"), row(150, "same id only")]
    return out


def corpus(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
