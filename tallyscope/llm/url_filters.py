"""URL rules by a sort-merge range join.

A host's canonical key is its labels in reverse, each followed by a dot, so a
rule's host is a prefix of the keys of its subdomains, and a prefix is an
interval of sorted keys; intervals of rules nest. Pages and rules are sorted together in
range partitions of (key, path, id), so that a host with many pages is spread as well. The rules
that are active where a range begins are those whose key is a prefix of its first page's key;
the prefixes, a few for each range, meet the rules by an equi-join. In a range, rules and pages are
swept once with a stack of the rules that are active: those whose key is a prefix of the present one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, staged

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
PER_RANGE = 65_536
LEAST_RANGES = 16


def example_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


def sweep(rows):
    """(page number, rule or None) for rows (key, is page, host, path, verdict), sorted by key, rules first.

    The longest rule (host and path together) that fits wins; of equally long ones
    the one with the longer host, then a block.
    """
    stack: list[tuple[str, dict[str, tuple], list[int]]] = []
    for n, (key, page, host, path, verdict) in enumerate(rows):
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if not page:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            _, paths, sizes = stack[-1]
            if path not in paths or verdict == "block":
                paths[path] = (host + path, len(host), verdict)
            if len(path) not in sizes:
                sizes.append(len(path))
            continue
        best = None
        for _, paths, sizes in stack:
            for size in sizes:
                if size <= len(path) and (found := paths.get(path[:size])):
                    rank = (len(found[0]), found[1], found[2] == "block")
                    if best is None or rank > best[0]:
                        best = (rank, found)
        yield n, best and best[1]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", per_range: int = PER_RANGE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict; ``rules`` has verdict, host, path.

    Null URLs and those without :// have empty host and path, and no rule fits
    them. A page that no rule fits gets ``default`` and a null rule. Rules with a null
    part are left out; a repeated rule counts once, and as a block if the
    rules disagree. Equal rows each get a row. No pages: no rows; no rules: all default.

    The driver sees the number of pages. Rules are neither broadcast nor collected:
    each is carried to the ranges that its host's interval goes on in, for a general rule all,
    for others mostly none.
    """
    cut = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    keyed = staged(cut.withColumn("key", host_key(F.col("host"))), "urls")
    n = max(LEAST_RANGES, -(-keyed.count() // per_range))
    lower = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    listed = rules.select(lower.alias("host"), "path", "verdict").dropna().where("host <> ''").distinct().withColumn("key", host_key(F.col("host")))
    names = ["page_id", "host", "path", "key", "verdict", "page"]
    both = keyed.withColumns({"verdict": F.lit(None).cast("string"), "page": F.lit(True)}).select(names)
    both = both.unionByName(listed.withColumns({"page_id": F.lit(None).cast(dict(keyed.dtypes)["page_id"]), "page": F.lit(False)}).select(names))
    placed = staged(both.repartitionByRange(n, "key", "page", "path", "page_id").withColumn("part", F.spark_partition_id()), "url-ranges")
    parts = F.split("first", "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "."), F.lit(".")))
    firsts = placed.where("page").groupBy("part").agg(F.min("key").alias("first")).where("first <> ''").select("part", F.explode(prefixes).alias("key"))
    carried = placed.where("NOT page").drop("part").join(firsts, "key").select(*names, "part")

    def judge(key, batches):
        stream = ((b, row) for b in batches for row in zip(*(b.column(k).to_pylist() for k in ("key", "page", "host", "path", "verdict", "page_id"))))
        held: list[tuple] = []

        def rows():
            for _, (key, page, host, path, verdict, page_id) in stream:
                held.append((page_id, host, path))
                yield key, page, host, path, verdict

        out: list[tuple] = []
        for _, found in sweep(rows()):
            page_id, host, path = held[-1]
            held.clear()
            out.append((page_id, host, path, found[0] if found else None, found[2] if found else default))
            if len(out) == 4096:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 4))], ["page_id", "host", "path", "rule", "verdict"])

    def judge_task(batches):
        yield from judge(None, batches)

    # a stack that outlives a range's end only holds prefixes of the next key or is emptied by it
    swept = python_ready(placed.unionByName(carried)).repartition(n, "part").sortWithinPartitions("part", "key", "page")
    return swept.mapInArrow(judge_task, "page_id long, host string, path string, rule string, verdict string")
