from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyscope.llm import near_copies
from tallyscope.llm.common import table

WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def brute_set(text):
    w = [re.sub("[A-Z]", lambda c: c[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Places of the rows that stay: of each component of pairs with a Jaccard index of 0.8 the smallest id."""
    sets, group = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group):
        low[g] = min(low.get(g, i), i)
    return set(low.values())


def edited(rng, words, n):
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def copies():
    """Copies with some words changed, a family of them, a common passage, chains, short, blank and null texts."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (7, 40, 100, 300, 1000):
        for part in (0, 0.003, 0.01, 0.015, 0.02, 0.022, 0.025, 0.03, 0.05):
            base = fresh(n)
            texts += [" ".join(base).upper(), edited(rng, base, int(part * n))]
    base = fresh(150)
    texts += [edited(rng, base, rng.randrange(6)) for _ in range(60)]
    passage = fresh(40)
    texts += [" ".join(fresh(60) + passage) for _ in range(50)]
    chain = fresh(200)
    for k in range(6):
        texts.append(" ".join(chain[8 * k : 8 * k + 150]))
    exact = fresh(13)  # nine shingles against eight of them: 8/10 with one more, just at the limit
    texts += [" ".join(exact), " ".join(exact[1:] + ["end"]), " ".join(fresh(4)), "a b", "A  b", "", None, " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("few, sample, block, wide", [(32, 20_000, 256, 16_384), (3, 40, 8, 16_384), (1, 1, 16, 16_384), (1, 1, 4, 20), (3, 40, 8, 2)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, few, sample, block, wide):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    if wide < 1000:
        monkeypatch.setattr(near_copies, "LARGE_BLOCK", block)
    monkeypatch.setattr(near_copies.near_links, "__defaults__", (few, wide))
    monkeypatch.setattr(near_copies.common_shingles, "__defaults__", (sample,))
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, None).collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id for r in got} == brute_kept(rows)
    assert all(r.text == rows[r.doc_id][1] for r in got)


def test_tables(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == brute_kept(rows)
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1), (5, "A b c d e f", 2), (5, "a b c d e f", 3), (None, "other words", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_set int").withColumnRenamed("near_set", "NEAR_ROW").withColumn("a.b", F.lit(1)).withColumn("keep_id", F.lit(2)).withColumn("first", F.lit(3))
    got = near_copies.drop_near_copies(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "None"] and {r.NEAR_ROW for r in got} in ({2, 4}, {3, 4})


def test_blocks_give_the_components_of_their_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 57, False), rng.integers(0, 2**63, 4, dtype=np.uint64)])) for _ in range(40)]
    want = near_copies.Forest(40)
    for a in range(20):
        for b in range(20, 40):
            if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b])):
                want.join(np.array([a]), np.array([b]))
    got = near_copies.Forest(40)
    got.join(*near_copies.block_links(sets[:20], sets[20:]))
    assert (got.settle() == want.settle()).all() and len(set(want.settle())) < 40


def passage_and_families(n_passage, n_family, rng):
    """Texts with one common passage and two families of near copies; of neighbours in a family most are near, not all."""
    passage = [f"p{k}" for k in range(40)]
    texts = [" ".join([f"w{rng.randrange(10**9)}" for _ in range(40)] + passage) for _ in range(n_passage)]
    for f in range(2):
        base = [f"f{f}x{k}" for k in range(90)] + passage[:20]
        texts += [edited(rng, base, rng.randrange(1, 4)) for _ in range(n_family)]
    return texts


def test_wide_groups_are_sent_a_bounded_number_of_times(spark, monkeypatch):
    """A passage in most texts and families of copies: in blocks of 16, texts are sent less than 10 times each; what stays is that of all pairs."""
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    monkeypatch.setattr(near_copies, "LARGE_BLOCK", 16)
    monkeypatch.setattr(near_copies.near_links, "__defaults__", (4, 128))
    monkeypatch.setattr(near_copies.common_shingles, "__defaults__", (1,))  # nothing is known as common
    rng, sent, pivots = random.Random(5), [], []
    rows = list(enumerate(passage_and_families(500, 120, rng)))
    pairs_of, links_of = near_copies.block_pairs, near_copies.pivot_links

    def counted(groups, settled):
        sent.append(pairs_of(groups, settled).count())
        return pairs_of(groups, settled)

    def noted(*args):
        pivots.append(links_of(*args).count())
        return links_of(*args)

    monkeypatch.setattr(near_copies, "block_pairs", counted)
    monkeypatch.setattr(near_copies, "pivot_links", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.drop_near_copies(docs).collect()
    assert {r.doc_id for r in got} == brute_kept(rows)
    assert pivots and sum(sent) < 10 * len(rows)


def test_pivots_link_within_groups(spark, monkeypatch):
    """In a group of one family a few texts link most; every link is within a group of all pairs, and without groups there are no rows."""
    monkeypatch.setattr(near_copies, "LARGE_BLOCK", 16)
    rng = random.Random(6)
    base = [f"b{k}" for k in range(200)]
    rows = [(k, edited(rng, base, rng.randrange(1, 4)), 0) for k in range(150)] + [(150, None, 0), (151, "alone", 0)]
    groups = spark.createDataFrame(rows, "node long, text string, root long")
    none = spark.createDataFrame([], "node long, root long")
    got = near_copies.pivot_links(groups.select("node", "root"), none, groups.select("node", "text")).collect()
    sets = [brute_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    assert all(root[r.a] == root[r.b] for r in got)  # a forest: its ends are in one group, not always near themselves
    assert len({n for r in got for n in r}) > 100 and not {150, 151} & {n for r in got for n in r}
    assert near_copies.pivot_links(none, none, groups.select("node", "text")).count() == 0
