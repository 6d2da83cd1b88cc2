"""Shared pieces of the corpus operators: word splitting, staging, folds, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..staging import _written, new_path, remove, shared_dir, staged  # noqa: F401  shared with the operators

#: White space that ends a word: space and the five controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``staged`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for k, (spark, known) in enumerate(_written):
            if path.split(":", 1)[-1].replace("//", "/").endswith(known.split(":", 1)[-1].replace("//", "/")):
                remove(spark, known)
                del _written[k]
                break


def discard_since(mark: int, kept: DataFrame) -> None:
    """Remove the tables staged after the first ``mark`` of all, but for those that ``kept`` reads: what a stage needed on its way."""
    files = kept.inputFiles()
    for spark, path in _written[mark:]:
        if not any(path.split(":", 1)[-1].replace("//", "/") in f.replace("//", "/") for f in files):
            remove(spark, path)
            _written.remove((spark, path))


def n_staged() -> int:
    return len(_written)


def python_ready(df: DataFrame) -> DataFrame:
    """``df``, after the workers got this package's code."""
    ship(df.sparkSession)
    return df


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def n_words(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``, case ignored."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(rows: DataFrame, by_key: DataFrame, key: str, n: str, total: int, most: int = 1000) -> DataFrame:
    """``rows`` joined to ``by_key``, which has a row for each key and in column ``n`` how many rows have it.

    Keys that more than one in ``most`` of all ``total`` rows have, fewer than ``most`` keys, are
    broadcast, so that no task gets all rows of a heavy key; the others meet by a shuffle.
    """
    heavy, light = by_key.where(F.col(n) * most > total), by_key.where(F.col(n) * most <= total)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
