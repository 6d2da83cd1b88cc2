"""The registered queries of the engine against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from tallyscope.functions.lexer import file_facts
from tallyscope.languages import built_in
from tallyscope.plans.contract import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(row):
    return repr(tuple(("f", round(v, 9)) if isinstance(v, float) else v for v in row))


def file_by_file(spark, name):
    """What SQL can't express: the lexer on each file by itself, columns by name; its own tests hold it against lines worked out by hand."""
    table, key, text, language = {"python_string_lines": ("documents", "doc_id", "text", "Python"), "html_pages_stats": ("pages", "page_id", "html", "HTML")}[name]
    for r in spark.read.parquet(f"{SF}/{table}.parquet").collect():
        n, code, _ = file_facts(r[text], built_in()[language]) if r[text] is not None else (None, None, None)
        yield tuple(v for _, v in sorted({key: r[key], "lines": n, "code_lines": code}.items()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(plain(r[c] for c in columns) for r in got.collect())
    if name not in ORACLES:
        assert rows == sorted(map(plain, file_by_file(spark, name)))
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(plain(r[names.index(c)] for c in columns) for r in found.fetchall())
