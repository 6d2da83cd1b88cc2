"""The registered queries of the code-statistics engine and their SQL oracles.

The driver's tables stand for source trees: a document is a file, its language the
file's language, its source the target; pages are HTML files; lines of known kinds are
built from ``part`` and ``lineitem``. Each query runs the engine's own operators over
whole tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..languages import Keyword, Language, built_in, extension_owners, language_frame
from ..operators import history, lines, stats
from ..sources.code_files import list_files
from ..sources.globs import exclude_regex
from ..sources.listing import ListOptions
from ..staging import new_path
from ..streaming import growth
from . import cases, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, by: str = "lang") -> DataFrame:
    """Documents as files whose non-blank lines are all code: lines are split once, and only their count and the blank ones are looked at."""
    docs = _table(spark, sf_dir, "documents")
    facts = lines.let(lines.split_lines(F.col("text")), lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, lambda line: ~lines.blank_or_braces(line))).alias("code")))
    return docs.select(F.col(by).alias("language"), F.octet_length("text").cast("long").alias("bytes"), facts.alias("f")).select("language", "bytes", F.col("f.n").cast("long").alias("lines"), F.col("f.code").cast("long").alias("code_lines"))


# SQL of the same files
_SPLIT = "string_split(text, chr(10))"
_LINES = f"(len({_SPLIT}) - ({_SPLIT}[-1] = '')::INT)"
_CODE = f"len(list_filter({_SPLIT}, lambda x: regexp_matches(x, '\\S') AND NOT regexp_matches(x, '^\\s*(\\{{|\\}}|\\}};)\\s*$')))"


def _sql_stats(by: str = "lang") -> str:
    return f"""f AS (SELECT {by} AS language, octet_length(encode(text))::BIGINT AS bytes, {_LINES}::BIGINT AS lines, {_CODE}::BIGINT AS code_lines FROM documents),
s AS (SELECT language, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(lines)::BIGINT AS lines, sum(code_lines)::BIGINT AS code_lines, (sum(lines) - sum(code_lines))::BIGINT AS extra_lines FROM f GROUP BY language)"""


@query(f"WITH {_sql_stats()} SELECT language, files, lines, code_lines FROM s")
def lines_per_language(spark, sf_dir):
    return stats.language_stats(_files(spark, sf_dir)).select("language", "files", "lines", "code_lines")


@query(f"SELECT source, sum(len(list_filter({_SPLIT}, lambda x: regexp_matches(x, '\\S'))))::BIGINT AS nonblank FROM documents GROUP BY source")
def nonblank_lines_per_source(spark, sf_dir):
    full = F.size(F.filter(lines.split_lines(F.col("text")), lambda x: lines.trim(x) != ""))
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(full).alias("nonblank"))


@query("SELECT lang AS language, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY lang")
def file_metadata_by_language(spark, sf_dir):
    return _table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


_TOTALS = f"""WITH {_sql_stats()}, t AS (SELECT sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(code_lines)::BIGINT AS code_lines, sum(extra_lines)::BIGINT AS extra_lines, sum(bytes)::BIGINT AS bytes FROM s),
a AS (SELECT *, (bytes // files)::BIGINT AS average_bytes FROM t)
SELECT *, round(CASE WHEN bytes >= 1000000 THEN bytes / 1e6 WHEN bytes >= 1000 THEN bytes / 1e3 ELSE bytes END * 10) / 10.0 AS size, CASE WHEN bytes >= 1000000 THEN 'MBs' WHEN bytes >= 1000 THEN 'KBs' ELSE 'Bytes' END AS size_unit,
round(CASE WHEN average_bytes >= 1000000 THEN average_bytes / 1e6 WHEN average_bytes >= 1000 THEN average_bytes / 1e3 ELSE average_bytes END * 10) / 10.0 AS average_size, CASE WHEN average_bytes >= 1000000 THEN 'MBs' WHEN average_bytes >= 1000 THEN 'KBs' ELSE 'Bytes' END AS average_unit FROM a"""


@query(_TOTALS)
def totals_final_stats(spark, sf_dir):
    return stats.totals(stats.language_stats(_files(spark, sf_dir)))


@query(f"WITH {_sql_stats()} SELECT CASE WHEN grouping(language) = 1 THEN 'Total' ELSE language END AS language, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(lines)::BIGINT AS lines, sum(code_lines)::BIGINT AS code_lines, sum(extra_lines)::BIGINT AS extra_lines FROM s GROUP BY ROLLUP (language)")
def language_rollup_total(spark, sf_dir):
    return stats.with_total(stats.language_stats(_files(spark, sf_dir)))


@query(f"WITH {_sql_stats('source')} SELECT language, files, bytes, row_number() OVER (ORDER BY files * 10 + bytes DESC, language)::INT AS rank FROM s")
def language_ranking(spark, sf_dir):
    return stats.ranked(stats.language_stats(_files(spark, sf_dir, "source"))).select("language", "files", "bytes", "rank")


_TOP = f"""WITH {_sql_stats('source')}, r AS (SELECT *, row_number() OVER (ORDER BY files * 10 + bytes DESC, language) AS rn, count(*) OVER () AS n FROM s),
o AS (SELECT CASE WHEN n > 4 AND rn >= 4 THEN 4 ELSE rn END::INT AS rank, CASE WHEN n > 4 AND rn >= 4 THEN 'others' ELSE language END AS language, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(bytes)::BIGINT AS bytes FROM r GROUP BY 1, 2)"""


@query(f"{_TOP} SELECT * FROM o")
def top3_plus_others(spark, sf_dir):
    return stats.top_and_others(stats.language_stats(_files(spark, sf_dir, "source")))


def _sql_share(c: str) -> str:
    return f"CASE WHEN rank = max(rank) OVER () THEN CASE WHEN {c}_b > 99.99 THEN 0.0 ELSE round((100.0::DOUBLE - {c}_b) * 100.0) / 100.0 END ELSE {c}_p END AS {c}_pct"


@query(
    f"{_TOP}, p AS (SELECT *, " + ", ".join(f"round({c}::DOUBLE / sum({c}) OVER () * 10000.0) / 100.0 AS {c}_p" for c in ("files", "lines", "bytes")) + " FROM o), "
    "b AS (SELECT *, " + ", ".join(f"coalesce(sum({c}_p) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS {c}_b" for c in ("files", "lines", "bytes")) + " FROM p) "
    "SELECT rank, language, files, lines, bytes, " + ", ".join(map(_sql_share, ("files", "lines", "bytes"))) + " FROM b"
)
def percentages_residual(spark, sf_dir):
    return stats.percentages(stats.top_and_others(stats.language_stats(_files(spark, sf_dir, "source"))), "files", "lines", "bytes")


@query("SELECT doc_id, CASE WHEN b >= 1000000 THEN 'MBs' WHEN b >= 1000 THEN 'KBs' ELSE 'Bytes' END AS total_unit, CASE WHEN b > 1000000 THEN 'MBs' WHEN b > 1000 THEN 'KBs' ELSE 'Bytes' END AS detail_unit FROM (SELECT doc_id, octet_length(encode(text)) AS b FROM documents)")
def size_units(spark, sf_dir):
    size = F.octet_length("text")
    return _table(spark, sf_dir, "documents").select("doc_id", stats.size_unit(size).alias("total_unit"), stats.detail_size_unit(size).alias("detail_unit"))


@query(f"WITH {_sql_stats()} SELECT language, CASE WHEN lines > 0 THEN round(code_lines::DOUBLE / lines * 100.0 * 100.0) / 100.0 ELSE 0.0 END AS code_pct FROM s")
def code_percentage_by_language(spark, sf_dir):
    return stats.language_stats(_files(spark, sf_dir)).select("language", stats.code_percentage(F.col("code_lines"), F.col("lines")).alias("code_pct"))


#: Prose as a language whose string and comment symbols no text has; its keywords begin sentences, so that none touches another.
_WORDS = {"articles": ("The", "La", "Der"), "links": ("And", "Und", "Et"), "never": ("Zzzz",)}
_PROSE = Language("Prose", ("txt",), ("\x01",), ("\x02",), None, None, tuple(Keyword(k, v) for k, v in _WORDS.items()))
_KEYWORDS = f"""WITH w AS (SELECT lang AS language, list_filter(flatten(list_transform({_SPLIT}, lambda x: regexp_split_to_array(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '[ {{}},]'))), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT language, unnest(ws) AS word FROM w), k AS (SELECT unnest([{{'keyword': 'articles', 'aliases': ['The', 'La', 'Der']}}, {{'keyword': 'links', 'aliases': ['And', 'Und', 'Et']}}, {{'keyword': 'never', 'aliases': ['Zzzz']}}]) AS k),
g AS (SELECT l.language, k.keyword, (SELECT count(*) FROM c WHERE c.language = l.language AND list_contains(k.aliases, c.word))::BIGINT AS n FROM (SELECT DISTINCT language FROM w) l, k)"""


def _keyword_counts(spark, sf_dir) -> DataFrame:
    """The lexer's keyword counts of whole documents, by language."""
    docs = _table(spark, sf_dir, "documents").select("lang", "text", F.lit("Prose").alias("language"))
    found = lines.file_stats(docs, {"Prose": _PROSE}, keep=["lang"]).where("counts IS NOT NULL")
    names = F.array(*map(F.lit, _WORDS))
    return found.select(F.col("lang").alias("language"), F.posexplode("counts").alias("k", "n")).groupBy("language", F.get(names, F.col("k")).alias("keyword")).agg(F.sum("n").alias("n"))


@query(f"{_KEYWORDS} SELECT language, keyword, n FROM g")
def keyword_counts(spark, sf_dir):
    return _keyword_counts(spark, sf_dir)


@query(f"{_KEYWORDS} SELECT keyword, sum(n)::BIGINT AS n FROM g GROUP BY keyword HAVING sum(n) > 0")
def keyword_totals(spark, sf_dir):
    return stats.keyword_totals(_keyword_counts(spark, sf_dir))


#: Documents with spaces for quotes: as Python, their lines are code up to a number sign.
_UNQUOTED_LINES = """string_split(translate(text, '"''', '  '), chr(10))"""


@query(f"""SELECT doc_id, {_LINES}::BIGINT AS lines, len(list_filter(list_transform({_UNQUOTED_LINES}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
lambda x: x <> '' AND x[1] <> '#' AND NOT regexp_matches(split_part(x, '#', 1), '^(\\{{|\\}}|\\}};)\\s*$')))::BIGINT AS code_lines FROM documents""")
def hash_comment_classification(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\"'", "  ").alias("text"), F.lit("Python").alias("language"))
    return lines.file_stats(docs, built_in(), keep=["doc_id"]).select("doc_id", "lines", "code_lines")


@query()
def python_string_lines(spark, sf_dir):
    """All documents as Python, strings and comments included; tests hold it against the lexer run file by file."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("Python").alias("language"))
    return lines.file_stats(docs, built_in(), keep=["doc_id"]).select("doc_id", "lines", "code_lines")


@query()
def html_pages_stats(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"), F.lit("HTML").alias("language"))
    return lines.file_stats(pages, built_in(), keep=["page_id"]).select("page_id", "lines", "code_lines")


#: Lines of known kinds: comment, code with a keyword, brace, literal and comment, block, blank, residue of a brace, code.
_KINDS = """CASE p_partkey % 8 WHEN 0 THEN '// class ' || p_name WHEN 1 THEN '  class ' || p_brand || ' {' WHEN 2 THEN ' }; ' WHEN 3 THEN '"' || p_name || '" // x' WHEN 4 THEN '/* ' || p_name || ' */'
WHEN 5 THEN '   ' WHEN 6 THEN '"x" }' ELSE 'int y = 1; /* class */' END"""


def _part_lines(spark, sf_dir, braces: bool) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_KINDS).alias("text"), F.lit("Java").alias("language"))
    found = lines.file_stats(parts, built_in(), braces, keep=["p_partkey"])
    return found.select("p_partkey", "code_lines", F.get("counts", F.lit(0)).alias("classes"))


@query("SELECT p_partkey, (p_partkey % 8 IN (1, 3, 7))::BIGINT AS code_lines, (p_partkey % 8 = 1)::BIGINT AS classes FROM part")
def code_lines_by_construction(spark, sf_dir):
    return _part_lines(spark, sf_dir, False)


@query("SELECT p_partkey, (p_partkey % 8 IN (1, 2, 3, 6, 7))::BIGINT AS code_lines, (p_partkey % 8 = 1)::BIGINT AS classes FROM part")
def braces_as_code_toggle(spark, sf_dir):
    return _part_lines(spark, sf_dir, True)


def _case_sql(given) -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quoted(c[2])}, {quoted(c[3])}, {c[4]}, {c[5]})" for k, c in enumerate(given))
    return f"""SELECT p_partkey, replace(line, '@', p_name) AS line, replace(cleansed, '@', p_name) AS cleansed, has_literal, next_state::INT AS next_state
    FROM part JOIN (VALUES {rows}) v(k, line, cleansed, has_literal, next_state) ON k = p_partkey % {len(given)}"""


def _cases(spark, sf_dir, given) -> DataFrame:
    """Each part's line, made from its name, with the lexer's facts of it."""
    known = F.broadcast(spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(given)], "k long, language string, state int, line string"))
    parts = _table(spark, sf_dir, "part").withColumn("k", (F.col("p_partkey") % len(given)).cast("long")).join(known, "k")
    made = parts.select("p_partkey", "language", "state", F.replace("line", F.lit("@"), F.col("p_name")).alias("line"))
    return lines.line_facts(made, built_in(), ["p_partkey", "line"])


@query(_case_sql(cases.STRINGS))
def string_marks_by_construction(spark, sf_dir):
    return _cases(spark, sf_dir, cases.STRINGS)


@query(_case_sql(cases.BLOCKS))
def block_marks_by_construction(spark, sf_dir):
    return _cases(spark, sf_dir, cases.BLOCKS)


@query(_case_sql(cases.QUIRKS))
def lexer_quirks_by_construction(spark, sf_dir):
    return _cases(spark, sf_dir, cases.QUIRKS)


def _grown(spark: SparkSession, rows: DataFrame, label: str, root: str | None = None) -> str:
    """A folder of files made from ``rows`` (path, text), written by the tasks that have them; it goes when the driver ends. In a given ``root`` files are replaced, and removed if their text is null."""
    root = root or new_path(spark, label).removeprefix("file:")
    if not root.startswith("/"):
        raise RuntimeError("files are scanned where all machines mount them; set spark.checkpoint.dir to such a folder")
    root = "/" + root.lstrip("/")

    def write(given):
        for path, text in given:
            if text is None:
                os.remove(f"{root}/{path}")
                continue
            os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
            with open(f"{root}/{path}", "wb") as f:
                f.write(text.encode())

    rows.select("path", "text").foreachPartition(write)  # rows come a few MB at a time, Arrow's batches have up to 64 MB
    return root


_TREE = """CASE page_id % 6 WHEN 0 THEN 'src' WHEN 1 THEN 'src/build' WHEN 2 THEN '.dots' WHEN 3 THEN 'docs' WHEN 4 THEN 'src/lib' ELSE 'src/lib/build/deep' END || '/d' || page_id % 3
|| CASE page_id % 5 WHEN 0 THEN '/p' || page_id || '.py' WHEN 1 THEN '/_p' || page_id || '.rs' WHEN 2 THEN '/gen_' || page_id || '.py' WHEN 3 THEN '/.p' || page_id || '.py' ELSE '/p' || page_id || '.PY' END"""


@query(f"""WITH p AS (SELECT {_TREE} AS path, page_id % 5 AS k, page_id % 6 AS f, length(url)::BIGINT AS bytes, page_id % 10 AS last FROM pages),
s AS (SELECT *, CASE WHEN k = 4 THEN 'other' WHEN (k = 2 AND last <> 7) OR (k = 1 AND f IN (4, 5) AND last <> 1) OR (k = 3 AND last = 8) THEN 'excluded' ELSE 'relevant' END AS status FROM p WHERE f IN (0, 4, 5))
SELECT path, CASE k WHEN 1 THEN 'rs' WHEN 4 THEN 'PY' ELSE 'py' END AS ext, status, CASE status WHEN 'relevant' THEN bytes ELSE 0 END AS bytes FROM s
UNION ALL SELECT * FROM (VALUES ('.gitignore', 'none', 'other', 0), ('src/lib/.gitignore', 'none', 'other', 0)) v""")
def listing_of_a_page_tree(spark, sf_dir):
    """A tree grown from the pages and listed by rounds: ignore files at two levels with exceptions, exclude globs, hidden and excluded folders, names that begin with ``_`` or ``.``."""
    pages = _table(spark, sf_dir, "pages").select(F.expr(_TREE).alias("path"), F.repeat(F.lit("x"), F.length("url")).alias("text"))
    own = spark.createDataFrame([(".git/config", ""), (".gitignore", "build/\ngen_*.py\n!gen_*7.py\n"), ("src/lib/.gitignore", "*.rs\n!_p*1.rs\n!build/\n")], "path string, text string")
    root = _grown(spark, pages.unionByName(own), "page-tree")
    found, _ = list_files(spark, [root], ListOptions(frozenset({"py", "rs"}), exclude_regex(["docs", ".p*8.py"])), first_folders=1, round_folders=8)
    return found.select(F.substring("path", len(root) + 2, 10_000).alias("path"), F.coalesce("ext", F.lit("none")).alias("ext"), "status", "bytes")


@query(f"SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, {_LINES}::BIGINT AS lines, {_CODE}::BIGINT AS code_lines FROM documents WHERE text IS NOT NULL")
def scan_of_a_document_tree(spark, sf_dir):
    """Each document written as a file and the tree scanned; larger ones are shared by several tasks."""
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    root = _grown(spark, docs.select(F.concat(F.coalesce("lang", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), "text"), "document-tree")
    run = scan.scan(spark, [root], {"Prose": _PROSE}, DEFAULTS, range_bytes=4096)
    return run.files.select(F.regexp_extract("path", r"(-?[0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "bytes", "lines", "code_lines")


_EDITED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || 'one more' ELSE text END AS text FROM documents WHERE text IS NOT NULL AND doc_id % 11 <> 0)"


@query(f"""SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes, {_LINES}::BIGINT AS lines, {_CODE}::BIGINT AS code_lines, count(*) FILTER (doc_id % 7 = 0) OVER () AS n_read,
count(*) FILTER (doc_id % 7 <> 0) OVER () AS n_carried, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id % 11 = 0) AS n_gone FROM {_EDITED}""")
def growth_of_a_document_tree(spark, sf_dir):
    """A tree of all documents followed by a stream: counted, then edited, then brought up to date, where only the edited files are read again."""
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    path = F.concat(F.coalesce("lang", F.lit("none")), F.lit("/d"), F.pmod("doc_id", F.lit(256)), F.lit("/"), "doc_id", F.lit(".txt")).alias("path")
    root, folder, changes = _grown(spark, docs.select(path, "text"), "followed-tree"), new_path(spark, "followed"), []

    def follow():
        growth.follow(spark, [root], {"Prose": _PROSE}, DEFAULTS, folder, settle=0, on_change=changes.append).awaitTermination()

    follow()
    edited = F.when(F.col("doc_id") % 11 != 0, F.concat("text", F.lit("\none more")))
    _grown(spark, docs.where("doc_id % 7 = 0 OR doc_id % 11 = 0").select(path, edited.alias("text")), "", root)
    follow()
    did = changes[-1]
    counts = [F.lit(n).cast("long").alias(f"n_{c}") for c, n in (("read", did.read), ("carried", did.carried), ("gone", did.gone))]
    return growth.current(spark, folder).select(F.regexp_extract("path", r"(-?[0-9]+)\.txt$", 1).cast("long").alias("doc_id"), "bytes", "lines", "code_lines", *counts)


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"""WITH l AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS line_no, l_partkey % 7 AS kind FROM lineitem),
m AS (SELECT *, last_value(CASE WHEN kind IN (0, 1) THEN kind END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM l)
SELECT file, line_no, (CASE WHEN mark = 0 THEN 1 ELSE 0 END)::INT AS state, kind = 1 OR (kind <> 0 AND coalesce(mark, 1) <> 0) AS is_code FROM m""")
def block_comment_state_scan(spark, sf_dir):
    kind = F.col("l_partkey") % 7
    text = F.when(kind == 0, "/* open").when(kind == 1, "close */ x").otherwise("x = 1;")
    order = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(order).alias("line_no"), F.lit("Java").alias("language"), text.alias("line"))
    java = built_in()["Java"]
    return lines.line_states(lines.line_outcomes(rows, {"Java": java}), stretch=4)


@query("""WITH p AS (SELECT page_id, (['py', 'rs', 'java', 'txt', 'h'])[page_id % 5 + 1] AS ext FROM pages)
SELECT page_id, ext, CASE ext WHEN 'py' THEN 'Python' WHEN 'rs' THEN 'Rust' WHEN 'java' THEN 'Java' ELSE 'C Header' END AS language FROM p WHERE ext <> 'txt'""")
def extension_language_join(spark, sf_dir):
    names = F.array(*map(F.lit, ("py", "rs", "java", "txt", "h")))
    pages = _table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("d/"), F.col("page_id"), F.lit("."), F.get(names, (F.col("page_id") % 5).cast("int"))).alias("path"))
    pages = pages.select("page_id", F.regexp_extract(F.substring_index("path", "/", -1), r"^.+\.([^.]*)$", 1).alias("ext"))
    return pages.join(F.broadcast(extension_owners(language_frame(spark, built_in()))), "ext").select("page_id", "ext", "language")


@query("SELECT lang AS language, count(*) AS files FROM documents WHERE lower(lang) IN ('en', 'fr', 'de') AND lower(lang) NOT IN ('de') GROUP BY lang")
def include_exclude_languages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), F.lower("lang").alias("key"))
    include = spark.createDataFrame([("en",), ("fr",), ("de",)], "key string")
    exclude = spark.createDataFrame([("de",)], "key string")
    kept = docs.join(F.broadcast(include), "key", "left_semi").join(F.broadcast(exclude), "key", "left_anti")
    return kept.groupBy("language").agg(F.count("*").alias("files"))


@query("""SELECT page_id, url FROM pages WHERE NOT (regexp_matches(url, '/en/[^/]*$') OR regexp_matches(url, '\\.html$') OR regexp_matches(url, '(^|/)blog[^/]*(/[^/]*)?$'))""")
def exclude_glob_filter(spark, sf_dir):
    regex = exclude_regex(["en/*", "*.html", "blog*", "blog*/*"])
    return _table(spark, sf_dir, "pages").where(~F.col("url").rlike(regex)).select("page_id", "url")


@query("""WITH p AS (SELECT DISTINCT '/' || split_part(url, '/', 3) || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/' || split_part(url, '/', 4) ELSE '/' || split_part(url, '/', 4) || '/' || page_id END AS path FROM pages)
SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.path <> p.path AND starts_with(p.path, q.path || '/'))""")
def path_overlap_anti_join(spark, sf_dir):
    parts = F.split("url", "/")
    host, folder = F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    tail = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.lit("/"), folder)).otherwise(F.concat(F.lit("/"), folder, F.lit("/"), F.col("page_id")))
    return stats.without_overlaps(_table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), host, tail).alias("path")))


_VALID = f"""f AS (SELECT lang AS language, octet_length(encode(text))::BIGINT AS bytes, {_LINES}::BIGINT AS lines, coalesce(quality, 1) = 1 AS valid FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"WITH {_VALID} SELECT language, count(*) FILTER (valid) AS files, sum(bytes) FILTER (valid)::BIGINT AS bytes, sum(lines) FILTER (valid)::BIGINT AS lines FROM f GROUP BY language HAVING count(*) FILTER (valid) > 0")
def faulty_adjustment(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    n = F.size(lines.split_lines(F.col("text"))).cast("long")
    files = docs.join(labels, "doc_id", "left").select(F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("bytes"), F.when(F.coalesce("quality", F.lit(1)) == 1, n).alias("lines"), F.lit(0).cast("long").alias("code_lines"))
    return stats.language_stats(files).select("language", "files", "bytes", "lines")


@query("SELECT l.language, count(d.doc_id) AS files FROM (VALUES ('en'), ('fr'), ('xx')) l(language) LEFT JOIN documents d ON d.lang = l.language GROUP BY l.language HAVING count(d.doc_id) > 0")
def zero_file_having(spark, sf_dir):
    known = spark.createDataFrame([("en",), ("fr",), ("xx",)], "language string")
    # counted before the join, so that a row per language is all that moves
    counted = _table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("doc_id").alias("files"))
    return known.join(counted, "language", "left").select("language", F.coalesce("files", F.lit(0)).alias("files")).where("files > 0")


_RUNS = """WITH r AS (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(*)::BIGINT AS files, count(DISTINCT user_id)::BIGINT AS lines, count(*) FILTER (value > 50)::BIGINT AS code_lines, count(*) FILTER (value <= 50)::BIGINT AS extra_lines FROM events GROUP BY 1),
n AS (SELECT * FROM r ORDER BY ts DESC LIMIT 6), c AS (SELECT * FROM n ORDER BY ts DESC LIMIT 1)"""


def _sql_change(c: str) -> str:
    size = f"abs(c.{c} - n.{c})::DOUBLE / n.{c} * 100.0"
    return f"CASE WHEN c.{c} = n.{c} THEN 0.0 WHEN n.{c} = 0 THEN NULL ELSE sign(c.{c} - n.{c}) * CASE WHEN {size} < 0.01 THEN 0.01 ELSE round({size} * 100.0) / 100.0 END END::DOUBLE AS {c}_pct"


@query(f"{_RUNS} SELECT n.ts, n.files, n.lines, n.code_lines, n.extra_lines, {', '.join(map(_sql_change, history.COMPARED))} FROM n, c WHERE n.ts < c.ts")
def log_compare_diff(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    runs = events.groupBy(F.date_trunc("day", "ts").alias("ts")).agg(
        F.count("*").alias("files"), F.count_distinct("user_id").alias("lines"), F.count_if(F.col("value") > 50).alias("code_lines"), F.count_if(F.col("value") <= 50).alias("extra_lines")
    ).withColumn("name", F.lit(None).cast("string"))
    # a log has a row per run; its newest one stands for the present run
    current = history.latest(runs, 1)
    now = current.first()
    earlier = runs.where(F.col("ts") < F.lit(now.ts)) if now else runs
    return history.compare(earlier, current, 5, F.current_timestamp()).select("ts", *history.COMPARED, *[f"{c}_pct" for c in history.COMPARED])


@query("""WITH m AS (SELECT event_id, floor((epoch(TIMESTAMP '2030-01-01 00:00:00') - floor(epoch(ts))) / 60)::BIGINT AS m FROM events)
SELECT event_id, m // 1440 AS days, m % 1440 // 60 AS hours, m % 60 AS minutes FROM m""")
def log_age_split(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", *history.age(F.col("ts"), F.lit("2030-01-01 00:00:00").cast("timestamp")))


@query("SELECT doc_id, format('{:,}', n_chars * 1000) AS shown FROM documents")
def thousands_format(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.format_number(F.col("n_chars") * 1000, 0).alias("shown"))


@query("""SELECT count(*) AS total, count(*) FILTER (page_id % 5 <> 3 AND NOT regexp_matches(url, '\\.html$')) AS relevant, count(*) FILTER (page_id % 5 <> 3 AND regexp_matches(url, '\\.html$')) AS excluded FROM pages""")
def scan_counters(spark, sf_dir):
    known = F.col("page_id") % 5 != 3
    status = F.when(~known, "other").when(F.col("url").rlike(exclude_regex(["*.html"])), "excluded").otherwise("relevant")
    return stats.scan_summary(_table(spark, sf_dir, "pages").select(status.alias("status")))


@query("SELECT l AS language, k AS keyword, n FROM (VALUES ('Prose', 'articles', (SELECT count(*) FROM part WHERE p_partkey % 2 = 0)), ('Prose', 'never', 0)) v(l, k, n)")
def keyword_zero_fill(spark, sf_dir):
    prose = Language("Prose", ("txt",), ('"',), ("#",), None, None, (Keyword("articles", ("the",)), Keyword("never", ("zzzz",))))
    text = F.when(F.col("p_partkey") % 2 == 0, "of the,x # the").otherwise('"the" then')
    found = lines.file_stats(_table(spark, sf_dir, "part").select(F.lit("Prose").alias("language"), text.alias("text")), {"Prose": prose}, keep=["language"])
    return lines.keyword_stats(found, language_frame(spark, {"Prose": prose}))
