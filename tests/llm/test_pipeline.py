"""The pipeline, stage by stage, against brute force on each stage's own input."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from fixtures import corpus, row, rows, sentence
from test_dedup import brute_copies, brute_near
from test_mix_and_shards import brute_targets, size
from tokenizers import Tokenizer

from loomwright.llm.common import BATCH_ROWS, keep, remove_kept


def test_stages(spark):
    import random

    rng = random.Random(4)
    german = "der die und Haus Baum Straße nicht gehen wir ein".split()
    data = rows() + [row(300 + i, sentence(rng, 40), "en") for i in range(10)]
    data += [row(400 + i, " ".join(rng.choice(german) for _ in range(40)), "de", "s2") for i in range(20)]
    docs = corpus(spark, data)
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(keep(stage(spark, steps[-1], "")))
    assert all(s.columns == docs.columns for s in steps[:-1])
    read = [[tuple(r) for r in s.collect()] for s in steps]
    seen, exact, near, mixed, coded = read[1:]
    ids = lambda x: sorted(r[0] for r in x if r[0] is not None)
    assert {140, 141, 142, 145}.isdisjoint(ids(seen)) and set(range(400, 420)) <= set(ids(seen))
    assert ids(exact) == sorted(k[0] for k in brute_copies(seen).elements() if k[3] and k[0] is not None)
    assert ids(near) == sorted(k[0] for k in brute_near(exact).elements() if k[3] and k[0] is not None)
    sizes, taken = defaultdict(int), Counter()
    for r in near:
        sizes[r[3]] += size(r[1])
    for r in mixed:
        taken[r[3]] += size(r[1])
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(sizes).items())
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    want = Counter()
    for r in mixed:
        want[r[0], tuple(library.encode(r[1], add_special_tokens=False).ids), hashlib.sha256(r[1].encode()).hexdigest()] += 1
    assert Counter((r[0], tuple(r[4]), r[5]) for r in coded) == want
    remove_kept(spark)


def test_stages_send_short_batches_to_python(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    try:
        for had, most in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("7", 7)):
            for _, stage in (corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[2], corpus_pipeline.STAGES[4]):
                spark.conf.set(name, had)
                stage(spark, corpus(spark, []), "")
                found = [r.n for r in spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long").collect()]
                assert max(found) == most and sum(found) == 2500
    finally:
        spark.conf.set(name, before)


def test_no_documents(spark):
    docs = corpus(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, ""))
    assert docs.count() == 0
