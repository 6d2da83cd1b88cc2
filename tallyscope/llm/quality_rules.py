"""Host-level quality rules, DataFrame functions only.

A document fails its own rules or not; failures are summed by host, each
host's failure rate is shrunk towards an empirical beta prior, and the host's
verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, spread_join, staged, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The prior's weight in documents where the hosts' rates don't give one.
DEFAULT_STRENGTH = 10.0


def _repeat_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes.
    """

    def counted(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

        def covered(keys: Column) -> Column:
            placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("p"))))

            def spans(s: Column) -> Column:
                found = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["k"] == x["k"], F.lit(False)))
                at = F.array_sort(F.transform(found, lambda x: x["p"]))
                return let(at, lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

            return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(placed, spans))

        return let(keys, covered)

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), counted))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document with the counts that the rules read; a narrow map."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), counts.alias("c"), line_counts.alias("l"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    ).select("doc_id", "host", "c.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", F.col("l.n_lines").cast("long").alias("n_lines"))


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 10, max_repeat_pct: int = 20, max_symbol_pct: int = 10, max_dup_line_pct: int = 30, max_host_rate: float = 0.5,
) -> DataFrame:
    """Document counts, rule verdicts and the host's verdict, with the host's shrunken failure rate to six digits.

    A document fails its host's tally if it fails the base rule (too few words
    or too many repeated ones), has more than ``max_symbol_pct`` symbols per 100
    words or more than ``max_dup_line_pct`` repeated lines per 100. A host
    whose shrunken failure rate passes ``max_host_rate`` takes all its
    documents with it.

    Null or blank text: no words, so the base rule fails it. Null host: no
    host verdict, the document is judged alone. Equal rows are judged and
    counted one by one. No rows: no rows. Other columns are left out, so no
    name can clash.
    """
    counted = text_features(docs, id_col, text_col, host_col)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    failed = base | (100 * F.col("n_symbols") > max_symbol_pct * F.col("n_words")) | (100 * F.col("n_dup_lines") > max_dup_line_pct * F.col("n_lines"))
    judged = staged(counted.withColumns({"base_failed": base, "failed": failed}), "quality")
    hosts = judged.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("f"))
    rate = F.col("f") / F.col("n")
    seen = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).first()
    m, v = (0.0 if seen.m is None else seen.m), (seen.v or 0.0)
    strength = m * (1 - m) / v - 1 if v > 0 else DEFAULT_STRENGTH
    strength = strength if strength > 0 else DEFAULT_STRENGTH
    rates = hosts.select("host", "n", ((F.col("f") + m * strength) / (F.col("n") + strength)).alias("host_rate"))
    # a host with a thousandth of all documents or more is met by a broadcast
    known = spread_join(judged.where("host IS NOT NULL"), rates, "host", "n", judged.count())
    out = known.select(*judged.columns, "host_rate").unionByName(judged.where("host IS NULL").withColumn("host_rate", F.lit(None).cast("double")))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_host_rate)).alias("kept"), F.round("host_rate", 6).alias("host_rate"),
    )
