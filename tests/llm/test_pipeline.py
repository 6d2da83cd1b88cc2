from __future__ import annotations

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tallyscope.llm import language_id, mixing, toxicity
from tallyscope.llm.common import n_staged, table

from .test_near_copies import brute_kept
from .test_operators import awkward_rows, multiset

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage on what the stage before kept, against what its operator says row by row."""
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "near_duplicates", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, SF).cache()
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, docs, table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, p in scores.items() if not p}
    assert 0 < kept.count() < docs.count()

    known = stages["language_id"](spark, kept, SF).cache()
    assert known.columns == docs.columns
    found = language_id.identify(kept, kept, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5}

    single = stages["near_duplicates"](spark, known, SF).cache()
    assert single.columns == docs.columns
    rows = known.collect()
    low = brute_kept([(r.doc_id, r.text) for r in rows])  # five words and a Jaccard index of 0.8
    assert multiset(map(tuple, single.collect())) == multiset(tuple(r) for r in rows if r.doc_id in low)

    mixed = stages["mixing"](spark, single, SF).cache()
    assert mixed.columns == docs.columns
    table_, c = mixing.mix(single)
    copies = {r.doc_id: r[c["copies"]] for r in table_.collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {k: n for k, n in copies.items() if n}
    assert max(copies.values()) == 2

    packed = stages["packing"](spark, mixed, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, total = [], 0
    for r in mixed.collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [corpus_pipeline.PACK_END]
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), corpus_pipeline.CAPACITY)):
            part = ids[a : a + corpus_pipeline.CAPACITY]
            want.append((r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert multiset(tuple(r)[:5] for r in packed) == multiset(want)
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= corpus_pipeline.CAPACITY
    assert len(sequences) <= -(-total // corpus_pipeline.CAPACITY) + 2


def test_run_is_the_stages_in_a_row(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    held = ("doc_id", "piece", "start", "length", "ids_crc32")
    mark = n_staged()
    got = corpus_pipeline.run(spark, SF)
    assert multiset(map(tuple, got.select(*held).collect())) == multiset(map(tuple, docs.select(*held).collect()))
    assert n_staged() - mark <= 4  # the last stage's tables: what the others needed is gone


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, name):
    """Null ids, texts, sources; empty and long texts; repeated rows; clashing columns; no rows at all."""
    rows = [(*r[:4], None if k % 2 else 3, "x", 1, 2.0, "g", "m") for k, r in enumerate(awkward_rows())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, AGAIN string, language int, `a.b` double, Component_Id string, near_set string"
    docs = spark.createDataFrame(rows, schema)
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, SF)
    found = got.collect()
    if name == "packing":
        assert collections.Counter(r.doc_id for r in found if r.piece == 0) == collections.Counter(r[0] for r in rows)
    else:
        assert got.columns == docs.columns
        kept, given = multiset(map(tuple, found)), multiset(map(tuple, docs.collect()))
        assert set(kept) <= set(given) and (name == "mixing" or kept <= given) and (kept or name == "language_id")
    if name == "language_id":
        assert all(any(c.isalpha() for c in r.text) for r in found)
    if name == "mixing":
        assert max(multiset(map(tuple, found)).values()) <= 2 * max(multiset(map(tuple, docs.collect())).values())
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0 and none.columns == got.columns


def test_registration():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {n.split("_")[0] for n in queries if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in queries and set(oracles) <= set(queries)
