"""SimHash near-dedup with an exact check: groups of texts whose word shingles have a Jaccard index of 0.8 or more.

The Gray-order index of ``simhash`` finds fingerprints of five-word shingles within three bits;
each of its links is checked on the texts' whole shingle sets, and what passes settles most large
groups. Three bits reach only some of the pairs at 0.8, so the rest is completed by an exact
search, which looks only across what is settled: two sets that share at least four fifths share
one of the first fifth (and one more) of each in any one order of all shingles. The order
puts shingles last that a sample finds common, so a passage in many texts makes no candidates of them.

Shingles of few texts give their pairs. Texts linked by shingles of many
are grouped, and each group's blocks are compared two at a time in a task, where
only a spanning forest comes out; blocks of one settled component are not compared. A group of too
many texts isn't cut in blocks at once: the shingles of its texts are counted, all of them, and
the texts are searched anew by their first shingles in the exact order, in which a passage that they share
for other reasons comes last. What is still too large are texts that have nearly all in common: every block of it is held against a few
of them, which settles most. All ways count the shared shingles of the whole texts, so no link is missed
and none is made below the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import simhash
from .common import discard, fresh, python_ready, spread_join, staged
from .components import components
from .held import release
from .simhash import Forest, SEED, combine, grouped, keep_first, shingle_hashes

SHINGLE = 5
#: The least Jaccard index of near copies is 4 / 5, in whole numbers so that it's exact.
SHARE, WHOLE = 4, 5
#: About as many distinct texts show which shingles are common, found in as many of them.
SAMPLE, COMMON = 20_000, 2
#: A shingle in more texts than this gives groups, not pairs.
FEW = 32
#: Texts of a block, and blocks of a group before blocks grow, up to the larger size.
BLOCK, BLOCKS, LARGE_BLOCK = 256, 16, 1024
#: A group of more texts is searched anew by exact counts; of what is left of it about so many texts, chosen by hash, meet all others, in so many rounds.
WIDE, PIVOTS, ROUNDS = BLOCKS * LARGE_BLOCK, 32, 2
#: Bits of the fingerprints that the index links.
LIMIT = 3


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle))


def set_udf():
    """Arrow function: text to the hash of its shingle set and the fingerprint of its shingles, as signed longs."""

    def run(batches):
        from xxhash import xxh64_intdigest

        release()
        for column in batches:
            sets, fps = np.zeros(len(column), np.uint64), np.zeros(len(column), np.uint64)
            for k, t in enumerate(column):
                found = shingle_hashes(t.as_py(), SHINGLE)
                sets[k], fps[k] = xxh64_intdigest(np.unique(found).tobytes(), SEED), combine(found)
            yield pa.StructArray.from_arrays([pa.array(sets.view(np.int64)), pa.array(fps.view(np.int64))], ["node", "fp"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, "node long, fp long").asNondeterministic()  # so that it's never run twice for a row


def common_shingles(texts: DataFrame, total: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that several of about ``sample`` texts have; texts: node, text."""

    def explode(batches):
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], ["token"])

    chosen = texts.where(F.pmod(F.xxhash64(F.lit("common"), F.col("node")), F.lit(max(total, sample))) < sample)
    found = chosen.select("text").mapInArrow(explode, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON).toArrow()
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def prefix_size(n):
    """How many of the first of ``n`` shingles any near copy must share one of."""
    return n * (WHOLE - SHARE) // WHOLE + 1


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a shingle set, by count in the sample and hash."""
    weight = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        weight = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, weight))[: prefix_size(len(found))]]


def near(shared, a, b):
    return WHOLE * shared >= SHARE * (a + b - shared)


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the near pairs left-right, or left-left for None: places in left and then right."""
    other = left if right is None else right
    sizes, first = np.array([len(s) for s in other]), 0 if right is None else len(left)
    tokens = np.concatenate([*other, np.empty(0, np.uint64)])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], np.repeat(np.arange(len(other)), sizes)[order]
    forest = Forest(first + len(other))
    for i, s in enumerate(left):
        lo = np.searchsorted(tokens, s)
        width = np.searchsorted(tokens, s, "right") - lo
        at = np.arange(width.sum()) + np.repeat(lo - (np.cumsum(width) - width), width)
        shared = np.bincount(owner[at], minlength=len(other))
        hit = np.flatnonzero((shared > 0) & near(shared, len(s), sizes))
        forest.join(np.full(len(hit), i), hit + first)
    root = forest.settle()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return linked, root[linked]


def pair_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` that are near; ``texts``: node, text."""
    pairs = staged(pairs, "near-pairs")
    named = staged(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(texts, "node"), "near-texts")
    both = pairs.join(named.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(named.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = shingles(x.as_py()), shingles(y.as_py())
                keep[k] = near(len(np.intersect1d(x, y, True)), len(x), len(y))
            yield batch.select([0, 1]).filter(pa.array(keep))

    links = staged(both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long"), "near-links")
    for used in (pairs, named):
        discard(used)
    return links


def index_links(one: DataFrame, texts: DataFrame) -> DataFrame:
    """Near pairs (a, b) that the Gray-order index of fingerprints links; ``one``: node, fp, one row a node, no nulls. No rows: no rows."""
    heads = staged(one.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "near-heads")
    links = simhash.near_links(heads, LIMIT)
    same = spread_join(one, heads, "fp", "n", one.count()).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    ends = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    across = links.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return pair_links(same.unionByName(across), texts)


def members(stars: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``stars`` (a, b), roots included."""
    found = components(stars)  # without a row for the root itself
    return staged(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "near-members")


def pivot_links(groups: DataFrame, settled: DataFrame, texts: DataFrame, round_: int = 0) -> DataFrame:
    """Links (a, b), forests of the near pairs of the texts of ``groups`` (node, root) with about ``PIVOTS`` texts of their group that are in no settled part that fills a block.

    Groups with at most a block of such texts give none; no groups: no rows. A null text has no shingles. Only a help: what this links needs no further look, what it doesn't link is compared later. A text is sent once, a pivot to each block of its group.
    """
    parts = groups.join(settled.select("node", F.col("root").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = parts.groupBy("root", "part").agg(F.count("*").alias("n"))
    loose = F.sum(F.when(F.col("n") < LARGE_BLOCK, F.col("n")).otherwise(0)).alias("loose")
    sums = sizes.groupBy("root").agg(F.sum("n").alias("all"), loose).where(F.col("loose") > LARGE_BLOCK)
    sums = sums.withColumn("m", F.ceil(F.col("all") / LARGE_BLOCK).cast("int"))
    noted = spread_join(parts.join(sizes.where(F.col("n") >= LARGE_BLOCK).select("root", "part", F.lit(True).alias("full")), ["root", "part"], "left"), sums, "root", "all", groups.count())
    chance = F.pmod(F.xxhash64(F.lit(round_), F.col("node")), F.col("loose")) < PIVOTS
    noted = staged(noted.select("node", "root", "m", (chance & F.col("full").isNull()).alias("pivot"), F.pmod(F.xxhash64("node"), F.col("m")).cast("int").alias("block")), "near-pivots")
    each = noted.where("pivot").select("node", "root", "pivot", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("block"))
    dealt = noted.select("node", "root", F.lit(False).alias("pivot"), "block").unionByName(each).join(texts, "node")

    def link(key, table):
        node, pivot = table.column("node").to_numpy(), table.column("pivot").to_numpy(zero_copy_only=False)
        sets = [shingles(t.as_py()) for t in table.column("text")]
        one, two = np.flatnonzero(pivot), np.flatnonzero(~pivot)
        a, b = block_links([sets[k] for k in one], [sets[k] for k in two])
        node = node[np.concatenate([one, two])]
        return pa.table({"a": node[a], "b": node[b]})

    return staged(dealt.groupBy("root", "block").applyInArrow(link, "a long, b long").where("a <> b"), "near-pivot-links")


def block_pairs(groups: DataFrame, settled: DataFrame) -> DataFrame:
    """(node, root, x, y, left): the pairs of blocks that each text of ``groups`` (node, root) is in; blocks of one part of ``settled`` (node, root) don't meet."""
    known = settled.select("node", F.col("root").alias("part"))
    groups = staged(groups.join(known, "node", "left").select("node", "root", F.coalesce("part", "node").alias("part")), "near-groups")
    parts = groups.groupBy("root", "part").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGE_BLOCK), F.ceil(F.sum("n") / BLOCKS))).alias("size")
    parts = parts.join(parts.groupBy("root").agg(size), "root").withColumn("own", F.col("n") >= F.col("size"))
    owner = F.when(F.col("own"), F.col("part")).otherwise(0)
    owners = staged(parts.groupBy("root", "own", owner.alias("owner")).agg(F.ceil(F.sum("n") / F.max("size")).cast("int").alias("m")), "near-owners")
    large = parts.where("own").select("root", "part", "own")
    homes = groups.join(large, ["root", "part"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    homes = homes.withColumn("owner", F.when(F.col("own"), F.col("part")).otherwise(0)).join(owners, ["root", "own", "owner"])
    homes = homes.select("node", "root", F.struct("own", "owner", F.pmod(F.xxhash64("node"), F.col("m")).cast("int").alias("k")).alias("home"))
    blocks = owners.select("root", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.struct("own", "owner", k.alias("k")))).alias("home"))
    every = blocks.groupBy("root").agg(F.collect_list("home").alias("homes"))  # a block for LARGE_BLOCK texts
    apart = lambda x, y: ~(x["own"] & y["own"] & (x["owner"] == y["owner"]))
    meets = blocks.join(every, "root").select("root", "home", F.explode(F.filter("homes", lambda y: apart(F.col("home"), y))).alias("to"))
    dealt = homes.join(meets, ["root", "home"]).select("node", "root", "home", F.least("home", "to").alias("x"), F.greatest("home", "to").alias("y"))
    return dealt.select("node", "root", "x", "y", (F.col("home") == F.col("x")).alias("left"))


def group_links(groups: DataFrame, settled: DataFrame, texts: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the near pairs across ``settled`` (node, root) within each group of ``groups`` (node, root), by pairs of blocks.

    Nodes are distinct texts, each in ``texts``; a null text has no shingles. No groups: no rows. Within a group, a settled component that fills a block gets blocks of its own, and these aren't compared with each other.
    """
    dealt = block_pairs(groups, settled).join(texts, "node")

    def link(key, table):
        node, left = table.column("node").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        sets = [shingles(t.as_py()) for t in table.column("text")]
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        same = key[1] == key[2]
        a, b = block_links([sets[k] for k in one], None if same else [sets[k] for k in two])
        node = node[one] if same else node[np.concatenate([one, two])]
        return pa.table({"a": node[a], "b": node[b]})

    return dealt.groupBy("root", "x", "y").applyInArrow(link, "a long, b long")


def shared_firsts(postings: DataFrame) -> DataFrame:
    """Those of ``postings`` (token, node, size) whose token others have too, with how many, n, and the smallest node, low."""
    postings = staged(postings, "near-postings")
    shared = postings.groupBy("token").agg(F.count("*").alias("n"), F.min("node").alias("low")).where("n > 1")
    return staged(postings.join(shared, "token"), "near-shared")


def exact_firsts(texts: DataFrame) -> DataFrame:
    """(token, node, size): the first shingles of each of ``texts`` (node, text), those that the fewest of these texts have first. No texts: no rows."""

    def explode(batches):
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(t.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([node] * len(found), pa.int64())], ["token", "node"])

    every = staged(texts.select("node", "text").mapInArrow(explode, "token long, node long"), "near-every")
    counts = every.groupBy("token").agg(F.count("*").alias("n"))
    ranked = spread_join(every, counts, "token", "n", every.count())
    # one text's shingles in a row, the hash as in the order of unsigned numbers doesn't matter here
    sets = ranked.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("all"), F.count("*").cast("int").alias("size"))
    first = F.slice("all", 1, F.expr(f"cast(size * {WHOLE - SHARE} div {WHOLE} as int)") + 1)
    return sets.select(F.explode(first).alias("one"), "node", "size").select("one.token", "node", "size")


def few_pairs(open_: DataFrame, settled: DataFrame, few: int) -> DataFrame:
    """Pairs (a, b) across ``settled`` that share a token of at most ``few`` texts in ``open_`` and may be near by their counts."""
    known = settled.select("node", F.col("root").alias("part"))
    # how many of a text's first shingles are in many texts: as many as a pair may share besides those of few
    held = open_.groupBy("node").agg(F.count_if(F.col("n") > few).alias("many"))
    cold = open_.where(F.col("n") <= few).join(held, "node").join(known, "node", "left").withColumn("part", F.coalesce("part", "node"))
    cold = cold.select("token", F.struct("node", "size", "many", "part").alias("x"))
    both = cold.select("token", F.col("x").alias("a")).join(cold.select("token", F.col("x").alias("b")), "token")
    both = both.where((F.col("a.node") < F.col("b.node")) & (F.col("a.part") != F.col("b.part")) & (WHOLE * F.least("a.size", "b.size") >= SHARE * F.greatest("a.size", "b.size")))
    rest = lambda x: F.col(f"{x}.size") - F.expr(f"{x}.size * {WHOLE - SHARE} div {WHOLE}") - 1
    most = F.count("*") + F.min(F.least("a.many", "b.many")) + F.min(F.greatest(rest("a"), rest("b")))
    # the first shingles that both have, and all that may follow in the text whose first shingles end first
    pairs = both.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b")).agg(most.alias("most"), F.min(F.col("a.size") + F.col("b.size")).alias("sizes"))
    return pairs.where((WHOLE + SHARE) * F.col("most") >= SHARE * F.col("sizes")).select("a", "b")


def many_stars(open_: DataFrame, few: int) -> DataFrame:
    """(a, b): texts that share a token of more than ``few`` with the smallest of these texts."""
    return open_.where(F.col("n") > few).select(F.col("node").alias("a"), F.col("low").alias("b"))


def narrowed(groups: DataFrame, pairs: DataFrame, checked: DataFrame, settled: DataFrame, texts: DataFrame, few: int, wide: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``groups``, ``pairs``, ``checked`` and ``settled`` of ``near_links``, with groups of over ``wide`` texts searched anew.

    A pair that shares tokens of many texts only is within one group, so the group's own order finds it as well.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    sized = lambda g: spread_join(g, g.groupBy("root").agg(F.count("*").alias("n")), "root", "n", g.count())
    if not sizes.where(F.col("n") > wide).limit(1).count():
        return groups, pairs, checked, settled
    noted = staged(sized(groups), "near-sized")
    again = shared_firsts(exact_firsts(texts.join(noted.where(F.col("n") > wide).select("node"), "node", "left_semi")))
    pairs = pairs.unionByName(few_pairs(again, settled, few)).distinct()
    rest = members(many_stars(again, few))
    for round_ in range(ROUNDS):
        large = sized(rest).where(F.col("n") > wide).select("node", "root")
        found = pivot_links(large, settled, texts, round_)
        if not found.limit(1).count():
            break
        checked = staged(checked.unionByName(found), "near-checked")
        settled = components(checked)
    # roots are nodes of their own groups, so these of narrower and searched groups differ
    return noted.where(F.col("n") <= wide).select("node", "root").unionByName(rest), pairs, checked, settled


def near_links(one: DataFrame, texts: DataFrame, few: int = FEW, wide: int = WIDE) -> DataFrame:
    """Links (a, b) whose components are those of all near pairs; ``one``: node, fp; ``texts``: node, text, one row for each set of shingles.

    A null text is the one without shingles, near to none but itself. No rows: no rows.
    """
    checked = index_links(one, texts)
    settled = components(checked)
    common = one.sparkSession.sparkContext.broadcast(common_shingles(texts, one.count()))

    def first(batches):
        for batch in batches:
            for node, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(t.as_py())
                token = prefix(found, *common.value)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array([node] * len(token), pa.int64()), pa.array([len(found)] * len(token), pa.int32())], ["token", "node", "size"])

    open_ = shared_firsts(texts.mapInArrow(first, "token long, node long, size int"))
    groups, pairs, checked, settled = narrowed(members(many_stars(open_, few)), few_pairs(open_, settled, few), checked, settled, texts, few, wide)
    return checked.unionByName(pair_links(pairs, texts)).unionByName(group_links(groups, settled, texts))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep of each group of near copies the document with the smallest id, with all columns of ``docs``, whatever their names.

    Groups are the components of all pairs whose sets of five-word shingles have a
    Jaccard index of 0.8 or more. Null texts and texts without words are copies of each other. A null
    id counts as larger than any. Of rows that share id and shingle set one stays. No rows: no rows.
    """
    mark, row = fresh(docs, "near_set", "near_row")
    marked = docs.withColumns({mark: set_udf()(F.col(text_col)), row: F.monotonically_increasing_id()})
    marked = staged(python_ready(marked), "near-docs")
    plain = marked.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(mark)["node"].alias("fp"))
    one = marked.groupBy(F.col(mark)["node"].alias("node")).agg(F.min(row).alias("row"), F.min(id_col).alias("low"), F.min(F.col(mark)["fp"]).alias("fp"), F.count("*").alias("n"))
    one = staged(one, "near-sets")
    # row numbers differ, so copies don't meet in one task
    texts = marked.select(F.col(row).alias("row"), F.col(text_col).alias("text")).join(one.select("row", "node"), "row").select("node", "text")
    links = near_links(one.select("node", "fp"), staged(texts, "near-all-texts"))
    groups = grouped(one.select(F.col("node").alias("fp"), "low", "n"), links)
    return keep_first(marked, plain, groups, row).drop(mark, row)
