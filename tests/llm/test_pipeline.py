import collections

import numpy as np
import pytest
from test_text_operators import brute_groups, brute_words, shingles

import corpus_pipeline
from ledgerlight.llm import toxicity
from ledgerlight.llm.common import table
from ledgerlight.llm.tokens import encoder, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    out = [docs.cache()]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_stages_against_brute_force(spark, stages):
    docs, clean, single, cut, packed = stages
    assert docs.columns == clean.columns == single.columns == cut.columns
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in clean.collect()} == {d for d, s in scores.items() if s < 0.5}
    texts = {r.doc_id: r.text or "" for r in clean.collect()}
    groups = brute_groups({d: shingles(t) for d, t in texts.items()})
    assert {r.doc_id for r in single.collect()} == {d for d, g in groups.items() if d == g}
    want = brute_words({r.doc_id: r.text or "" for r in single.collect()}, 20)
    after = {r.doc_id: r for r in cut.collect()}
    assert after.keys() == want.keys()
    for d, r in after.items():
        assert len(r.text.split()) == want[d][0] - want[d][1] and r.n_chars == len(r.text)
    e = encoder(vocabulary("byte_bpe_50k.json"))
    sizes = collections.Counter()
    for r in packed.collect():
        sizes[r.doc_id] += r.length
    assert sizes == {d: len(e.whole([r.text])[0]) + 1 for d, r in after.items()}


def test_run_and_edges(spark, corpus, empty):
    assert corpus_pipeline.run(spark, SF).count() > 0
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start, some in ((corpus.select(columns), True), (empty.select(columns), False), (corpus, True)):
        docs, ids = start, {r.doc_id for r in start.collect()}
        for _, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, SF)
        packed = {r.doc_id for r in docs.collect()}
        assert bool(packed) == some and packed <= ids - {None}


def test_packing_pads_little(stages):
    rows = stages[-1].collect()
    room, used = {}, collections.Counter()
    for r in rows:
        room[r.sequence_id] = r.padded_length
        used[r.sequence_id] += r.length
    assert all(used[k] <= v for k, v in room.items())
    assert 1 - sum(used.values()) / np.sum(list(room.values())) < 0.05


def test_kernels_hold_little():
    """What a worker holds beside its batch, over 7 MB of text: the pipeline's executors have little memory beside a full heap."""
    import tracemalloc

    import pyarrow as pa

    from ledgerlight.llm import common, repeats

    texts = [" ".join(f"w{i * j % 977}" for j in range(600)) for i in range(1, 2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    common.powers(10)

    def most(rows):
        tracemalloc.start()
        for _ in rows:
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak / 1e6

    assert most(repeats.anchored(repeats.Words, 20, 8)(iter([batch]))) < 40
    assert most(toxicity.sentence_words(data, offsets) for _, _, data, offsets in common.text_chunks(batch)) < 40
