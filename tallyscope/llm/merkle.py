"""A Merkle manifest of a dataset: leaves in groups, a tree per group, a tree over the groups, proofs and folds.

Blocks of consecutive leaves are reduced where they are, on all tasks. What is left,
a node for each block, is small: the driver builds the upper tree and sends
each block's path to the root back by a broadcast, and the block's task finishes the
proofs and folds of its rows. Where the nodes are too many for the driver, they are the
leaves of blocks again, and their paths come back by a join.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fold_of, python_ready, staged

#: Nodes hashed together.
ARITY = 8
#: Levels of a block: 8^4 leaves, about 300 KB.
BLOCK_LEVELS = 4
#: Nodes that the driver builds the upper tree from; their paths, 2 KB each or less, are broadcast.
TOP_NODES = 4096
#: Leaves of one range partition.
PER_RANGE = 1 << 18
LEAST_RANGES = 32

PATH = "key string, block long, path array<struct<left: string, right: string>>, subroot string, root string"


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def levels(nodes: list[str], deep: int | None = None) -> list[list[str]]:
    """The nodes and what they become: ``deep`` times, or until one is left."""
    out = [nodes]
    while len(nodes) > 1 if deep is None else len(out) <= deep:
        nodes = [h("".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Of the leaf ``at``, level by level: the digests that stand before and after it in its run."""
    out = []
    for nodes in tree[:-1]:
        first = at - at % ARITY
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = h(left + node + right)
    return node


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Hash of the fields in a row; each is its UTF-8 length and value, or ``-`` if null."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (key, ...) with ``place``, from 0 in each key's rows by ``order``, and ``total``, how many the key has.

    A range sort deals a key with most rows to many tasks; a row's place is its place in its range and the counts of the ranges before,
    a row per key and range.
    """
    n = max(LEAST_RANGES, -(-rows.count() // PER_RANGE))
    by = [F.col(c).asc_nulls_first() for c in ("key", *order)]
    placed = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = staged(placed.withColumn("range", F.shiftright("at", 33)), "merkle-order")
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("key", "range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    bases = bases.select("key", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("n").over(Window.partitionBy("key")).alias("total"))
    joined = placed.join(bases, ["key", "range"])
    return joined.select(*rows.columns, (F.col("at") + F.col("base")).alias("place"), "total")


def blocks(nodes: DataFrame, deep: int = BLOCK_LEVELS) -> DataFrame:
    """``nodes`` (key, place, total, digest and others) by blocks: key, block, total (blocks of the key), digest and a list for each of the others.

    A key's only block is reduced to one node, others by ``deep`` levels. A task holds one block at a time.
    """
    size = ARITY**deep
    carried = [c for c in nodes.columns if c not in ("key", "place", "total", "digest")]
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    schema = ", ".join(["key string, block long, total long, digest string, digests array<string>", *(f"`{c}` array<{kinds[c].simpleString()}>" for c in carried)])

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("key", "block", "total", "digest", *carried)))

    def reduce(batches):
        for (key, block, total), found in groupby(rows(batches), key=lambda r: r[:3]):
            digests, *rest = zip(*(r[3:] for r in found))
            made = levels(list(digests), None if total == 1 else deep)[-1][0]
            values = [key, block, total, made, list(digests), *map(list, rest)]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, arrow)], names)

    names = ["key", "block", "total", "digest", "digests", *carried]
    arrow = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), *(pa.list_(to_arrow_type(kinds[c])) for c in carried)]
    dealt = nodes.withColumn("block", F.floor(F.col("place") / size).cast("long")).withColumn("total", F.ceil(F.col("total") / size).cast("long"))
    n = max(LEAST_RANGES, nodes.sparkSession.sparkContext.defaultParallelism)
    dealt = dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block", "place").select("key", "block", "total", "digest", *carried)
    return python_ready(dealt).mapInArrow(reduce, schema)


def _top(rows: list, keys_in_order: list[str]) -> list[tuple]:
    """Paths of all nodes (key, block, digest), built on the driver."""
    trees = {key: levels([r.digest for r in found]) for key, found in groupby(rows, key=lambda r: r.key)}
    upper = levels([trees[k][-1][0] for k in keys_in_order])
    over = {k: siblings(upper, j) for j, k in enumerate(keys_in_order)}
    return [(r.key, r.block, siblings(trees[r.key], r.block) + over[r.key], trees[r.key][-1][0], upper[-1][0]) for r in rows]


def paths(nodes: DataFrame, deep: int = BLOCK_LEVELS, most: int = TOP_NODES) -> tuple[DataFrame, bool]:
    """(PATH rows for ``nodes`` (key, block, total, digest), whether they are at most ``most``): each node's siblings up to its key's node and the root."""
    spark = nodes.sparkSession
    found = nodes.select("key", "block", "digest").orderBy("key", "block").limit(most + 1).collect()
    if len(found) <= most:
        return spark.createDataFrame(_top(found, list(dict.fromkeys(r.key for r in found))), PATH), True
    if nodes.where("total > 1").limit(1).count():
        ranked = nodes.withColumnRenamed("block", "place")
    else:  # one node for each key: they are the leaves of the tree over the keys
        single = nodes.select(F.lit("").alias("key"), F.col("key").alias("own"), "digest")
        ranked = numbered(single, ["own"])
    lower = staged(blocks(ranked, deep), "merkle-upper")
    upper, small = paths(lower.select("key", "block", "total", "digest"), deep, most)
    met = lower.drop("digest").join(F.broadcast(upper) if small else upper, ["key", "block"])
    over_keys, size = "own" in lower.columns, ARITY**deep

    def extend(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tree = levels(r["digests"], None if r["total"] == 1 else deep)
                above = [(p["left"], p["right"]) for p in r["path"]]
                out = []
                for at, digest in enumerate(r["digests"]):
                    path = [{"left": a, "right": b} for a, b in siblings(tree, at) + above]
                    out.append((r["own"][at], 0, path, digest, r["root"]) if over_keys else (r["key"], r["block"] * size + at, path, r["subroot"], r["root"]))
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "block", "path", "subroot", "root"), x)) for x in out], kind)

    kind = pa.schema([("key", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), ("subroot", pa.string()), ("root", pa.string())])
    return met.mapInArrow(extend, PATH), False


def manifest(docs: DataFrame, fields: list[str], group: str, id_col: str, changed: dict[str, Column] | None = None, deep: int = BLOCK_LEVELS, most: int = TOP_NODES) -> DataFrame:
    """Leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``, with its ``id_col`` as doc_id.

    A leaf hashes ``fields``. The rows of one ``group`` stand in order of id, then leaf; groups in order of
    their value, null first. Runs of eight nodes are hashed until a group has one, and groups' nodes likewise.
    ``proof_sha256`` hashes a leaf's siblings from its level up to the root; ``folded_root`` is the root that the leaf of the row as
    ``changed`` (columns by name, that of fields they replace) leads to along the original siblings.

    Nulls in any column are values of their own; equal rows are leaves of their own, side by side; empty and long texts are
    hashed whole. No rows: no rows. Only the columns named are read, so no name can clash.
    """
    own = {c: F.col(f"`{c}`") for c in fields}
    now = leaf_digest(list(own.values()))
    other = leaf_digest([(changed or {}).get(c, own[c]) for c in fields]) if changed else now
    # null groups get the empty key; bytewise order is kept
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = docs.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), now.alias("digest"), other.alias("other"))
    leaves = staged(leaves.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other"))), "merkle-leaves")
    lower = staged(blocks(numbered(leaves, ["id", "digest"]), deep), "merkle-blocks")
    upper, small = paths(lower.select("key", "block", "total", "digest"), deep, most)
    met = lower.select("key", "block", "total", "digests", "id", "other").join(F.broadcast(upper) if small else upper, ["key", "block"])
    kind = next(f.dataType for f in leaves.schema.fields if f.name == "id")
    id_type = to_arrow_type(kind)

    def finish(batches):
        for batch in batches:
            for b in range(batch.num_rows):
                r = {c: batch.column(c)[b].as_py() for c in batch.schema.names}
                tree = levels(r["digests"], None if r["total"] == 1 else deep)
                above = [(p["left"], p["right"]) for p in r["path"]]
                suffix, proofs, roots = "".join(a + b for a, b in above), [], []
                for at, (digest, changed_to) in enumerate(zip(r["digests"], r["other"])):
                    path = siblings(tree, at)
                    proofs.append(h("".join(a + b for a, b in path) + suffix))
                    roots.append(fold(fold(changed_to or digest, path), above))
                n = len(proofs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["id"], id_type), pa.array(r["digests"]), pa.array([r["subroot"]] * n), pa.array([r["root"]] * n), pa.array(proofs), pa.array(roots), pa.array([x == r["root"] for x in roots])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return met.mapInArrow(finish, f"doc_id {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def lower_cased(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> dict[str, Column]:
    """The tampering that the query looks for: A-Z of the text lower-cased where ``every`` divides the crc32 of the id's decimal text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.col(f"`{text_col}`")
    return {text_col: F.when(fold_of(F.col(f"`{id_col}`"), every) == 0, F.translate(text, upper, upper.lower())).otherwise(text)}
