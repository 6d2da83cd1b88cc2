"""DuckDB SQL for the queries that SQL can express, over whole tables."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    row_number() OVER () AS rid FROM documents),
wins AS (SELECT rid, p, list_slice(w, p, p + 4) AS win FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS t(p) WHERE len(w) >= 5),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c >= 2),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, unnest(range(0, 5)) AS t(k) GROUP BY rid),
f AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines FROM d LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
j AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (failed) AS f FROM j WHERE source IS NOT NULL GROUP BY source),
mv AS (SELECT coalesce(avg(f / n), 0) AS m, coalesce(var_samp(f / n), 0) AS v FROM h),
st AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) / v - 1 > 0 THEN m * (1 - m) / v - 1 ELSE 10.0 END AS s FROM mv),
r AS (SELECT source, (f + m * s) / (n + s) AS rate FROM h, st)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM j LEFT JOIN r ON j.source = r.source
"""

OP4 = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[place % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM w),
m AS (SELECT *, max(CASE WHEN cap > w * own_level THEN own_level END) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(w * level, cap)) AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM m),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate, start,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie, d.doc_id NULLS FIRST) - 1 AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate * (k + 1) + start) - floor(rate * k + start)))::BIGINT AS taken FROM r
"""

_MARKS = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/TEXT]"]
_COUNT = lambda of, x: f"(length({of}) - length(replace({of}, '{x}', ''))) // {len(x)}"
_ESCAPED = lambda of: " + ".join([f"length({of})", *(_COUNT(of, x) for x in [chr(92), *_MARKS, "<" + chr(92), "[" + chr(92)]), f"(right({of}, 1) IN ('<', '['))::INT"])

OP11 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
o AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(role) OVER w, '<start>') AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE role WHEN 'system' THEN before = '<start>' AND place = 0 WHEN 'user' THEN before IN ('system', 'assistant') OR place = 0 WHEN 'assistant' THEN before = 'user' ELSE false END AS fits,
    CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 7 + 9 WHEN 'assistant' THEN 4 + 6 ELSE 7 + ({_ESCAPED('role')}) + 8 + 9 END + ({_ESCAPED('text')}) AS chars FROM o),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS told, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learnt,
    sum(chars)::BIGINT AS formatted_chars, min(place) FILTER (NOT fits)::BIGINT AS bad_place, arg_max(role, place) AS last_role FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, bad_place IS NULL AND last_role = 'assistant' AS valid, bad_place FROM g
"""


def _tree(name: str, levels: int) -> str:
    """CTEs of a tree over ``name``0 (key, idx, dg, n): ``name``s<k> has each node's siblings, ``name``<levels> what is left of each key."""
    return ", ".join(
        f"""{name}s{k} AS MATERIALIZED (SELECT key, idx, n, CASE WHEN n > 1 THEN coalesce(string_agg(dg, '') OVER (PARTITION BY key, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
    CASE WHEN n > 1 THEN coalesce(string_agg(dg, '') OVER (PARTITION BY key, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k}),
{name}{k + 1} AS MATERIALIZED (SELECT key, idx // 8 AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(dg, '' ORDER BY idx)) ELSE any_value(dg) END AS dg, (any_value(n) + 7) // 8 AS n FROM {name}{k} GROUP BY key, idx // 8)"""
        for k in range(levels)
    )


def _climb(name: str, levels: int, start: str) -> str:
    """CTEs that follow the rows of ``start`` (key, spot, folded, sibs) up the tree of ``name``."""
    steps = [start, *(f"{name}p{k}" for k in range(1, levels + 1))]
    return ", ".join(
        f"{b} AS MATERIALIZED (SELECT p.* REPLACE (p.spot // 8 AS spot, CASE WHEN s.n > 1 THEN sha256(s.l || p.folded || s.r) ELSE p.folded END AS folded, p.sibs || s.l || s.r AS sibs) FROM {a} p JOIN {name}s{k} s ON p.key = s.key AND p.spot = s.idx)"
        for k, (a, b) in enumerate(zip(steps, steps[1:]))
    )


_FIELDS = lambda text: "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT)"""
_LEVELS, _UPPER = 10, 4  # 8^10 documents of a language, 8^4 languages

OP12 = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS key, {_FIELDS('text')} AS leaf,
    CASE WHEN {_CRC32} % 3 = 0 THEN {_FIELDS("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM d),
a0 AS MATERIALIZED (SELECT key, place AS idx, leaf AS dg, n FROM e), {_tree('a', _LEVELS)},
b0 AS MATERIALIZED (SELECT '' AS key, row_number() OVER (ORDER BY a{_LEVELS}.key) - 1 AS idx, dg, count(*) OVER () AS n, a{_LEVELS}.key AS own FROM a{_LEVELS}), {_tree('b', _UPPER)},
ap0 AS (SELECT doc_id, leaf, key, place AS spot, coalesce(other, leaf) AS folded, '' AS sibs FROM e), {_climb('a', _LEVELS, 'ap0')},
bp0 AS (SELECT doc_id, leaf, '' AS key, b0.dg AS subroot, b0.idx AS spot, folded, sibs FROM ap{_LEVELS} p JOIN b0 ON b0.own = p.key), {_climb('b', _UPPER, 'bp0')}
SELECT doc_id, leaf, subroot, b{_UPPER}.dg AS root, sha256(sibs) AS proof_sha256, folded AS folded_root, folded = b{_UPPER}.dg AS verified FROM bp{_UPPER}, b{_UPPER}
"""

_NEAREST = lambda k: f"""a{k} AS MATERIALIZED (SELECT rid, part, entry, away FROM (SELECT p.rid, p.part, c.entry, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS away,
    row_number() OVER (PARTITION BY p.rid, p.part ORDER BY away, c.entry) AS nth FROM p JOIN c{k} c USING (part)) WHERE nth = 1)"""  # noqa: E731
_REFINED = lambda k: f"""c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
    FROM (SELECT part, entry, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{k} JOIN p USING (rid, part), unnest(range(1, len(v) + 1)) AS t(i) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry))"""  # noqa: E731

OP13 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096.0::DOUBLE * x)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS rid FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, list_slice(v, part * (len(v) // 8) + 1, (part + 1) * (len(v) // 8)) AS v FROM k, unnest(range(8)) AS t(part)),
c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v FROM p WHERE rid <= 16), {', '.join(f'{_NEAREST(k)}, {_REFINED(k)}' for k in range(6))}, {_NEAREST(6)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c6),
o AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM a6 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN k USING (rid), h
"""

ORACLES = {"op1_quality_rules": OP1, "op4_url_filters": OP4, "op8_mixing": OP8, "op11_chat_format": OP11, "op12_merkle": OP12, "op13_vector_codes": OP13}
