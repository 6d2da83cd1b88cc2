"""Every operator against brute force, on a small table with all the awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from tallyscope.llm import components, fingerprints, language_id, mixing, packing, quality_rules, simhash, token_counts, token_files, toxicity, url_filters
from tallyscope.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, n_words long, part int, component_id string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY, NO_TEXT = [], "no text"


def prose(seed: int, n: int, words: str = "the and of ing tion er an re in ha") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(words.split(), k=rng.randint(1, 3))) for _ in range(n))


def awkward_texts() -> list[str | None]:
    long = prose(1, 6000)
    near = prose(2, 60)
    return [
        None, "", " ", "\n\n", "word", "two words", "A b c", "a  b   c \n \n d\n", "\x1c a\x85b\xa0c　d", "tab\tend\r\nnext\x0bline\x0c", "été ÉTÉ naïve 日本語 テキスト 🙂 👩‍👩‍👧",
        "<|endoftext|> x <|startoftext|>", "x\0y z", "a" * 3000, long, long + " tail", near, near, near + " x", near.replace("the", "thee", 1), "one two three four five one two three four five",
        "line\nline\nline\nother", "#*$%&|<> #", "123 456 !!", "ΑΣ ΟΔΟΣ σ", "▁odd ▁▁ marks", "e\u0301 combining", prose(3, 30), prose(4, 31), prose(5, 200) + "\n" + prose(6, 200), prose(7, 12),
    ]


def awkward_rows() -> list[tuple]:
    langs, sources = ["en", "fr", None], ["a", "b", None, "", "é"]
    rows = [(k * 7 - 20, t, langs[k % 3], sources[k % 5]) for k, t in enumerate(awkward_texts())]
    rows += [(None, "null id", "en", "a"), (None, None, None, None), rows[4], rows[4], (8, "same id, other text", "fr", "b")]
    return [(*r, 1, 2, 3, 4, 5, "x", "y") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows):
    return collections.Counter(map(repr, rows))


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_quality_counts(docs, empty):
    want = []
    for i, t in texts_of(docs):
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n = len(w)
        want.append((i, n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n))
    got = quality_rules.host_quality(docs)
    assert multiset(map(tuple, got.drop("kept", "host_rate").collect())) == multiset(want)
    assert quality_rules.host_quality(empty).count() == 0


def test_quality_host_verdict(spark):
    good, bad = prose(1, 40), "too short"
    rows = [(k, bad if k % 10 else good, "rotten") for k in range(60)] + [(100 + k, good, "fine") for k in range(60)] + [(200, good, "tiny"), (201, bad, "tiny"), (202, good, None)]
    got = {r.doc_id: r.kept for r in quality_rules.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[k] for k in range(60))  # the host takes its good documents along
    assert all(got[100 + k] for k in range(60)) and got[200] and got[202] and not got[201]


def test_language_id(spark, docs, empty):
    model = public_tokenizers.path("piece_bpe_32k.model")
    parts = {"en": "the and ing tion er of", "fr": "eau que ment les ouï ère"}
    rows = [(k, prose(k, 30, parts[lang]), lang) for k in range(400) for lang in [("en", "fr")[k % 2]]]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(table, table, model).collect()
    true = {k: lang for k, _, lang in rows}
    assert {r.held_out for r in got} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = language_id.identify(docs, table, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in odd:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert language_id.identify(docs, docs, model).count() == docs.count()
    assert language_id.identify(empty, empty, model).count() == 0
    kept = language_id.keep_identified(docs, table, model)
    assert kept.columns == docs.columns


def test_language_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba"]
    lattice = language_id.Lattice(pieces)
    probs = np.array([[0.0], [0.1], [0.2], [0.05], [0.3], [0.15], [0.08], [1e-6]])
    p, logs = dict(zip(pieces, probs[1:-1, 0])), language_id.logarithms(probs)

    def total(word):
        return 1.0 if not word else sum((p.get(word[:k], 1e-6 if k == 1 else 0.0)) * total(word[k:]) for k in range(1, len(word) + 1))

    for word in ("▁abba", "▁baab", "▁abxa"):
        for got in (lattice.forward(lattice.ids([word]), len(word), logs)[-1, 0, 0], lattice.long(word, logs)[0]):
            assert np.isclose(np.exp(got), total(word))
    counts = lattice.expected(["▁ab"], np.array([2.0]), logs)
    ways = {("▁", "a", "b"): 0.3 * 0.1 * 0.2, ("▁", "ab"): 0.3 * 0.05, ("▁a", "b"): 0.15 * 0.2}
    z = sum(ways.values())
    for piece, k in lattice_rows(pieces):
        assert np.isclose(counts[k], 2 * sum(v for w, v in ways.items() if piece in w) / z)


def test_language_long_words_are_fitted_as_short_ones_are():
    pieces = ["a", "b", "ab", "▁", "▁a", "ba", "bab"]
    lattice, rng = language_id.Lattice(pieces), random.Random(1)
    logs = language_id.logarithms(np.array([[0.0], *([x] for x in (0.1, 0.2, 0.05, 0.3, 0.15, 0.08, 0.02)), [1e-6]]))
    for n in (1, 2, 5, 30, 47):
        word = "▁" + "".join(rng.choices("abx", k=n))
        out = np.zeros(lattice.rows)
        lattice.expect_long(word, 3.0, logs[:, 0], out)
        assert np.allclose(out, lattice.expected([word], np.array([3.0]), logs))


def test_language_of_texts_without_letters(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    known = [(k, prose(k, 30, "the and ing tion er of"), "en") for k in range(30)]
    odd = [(1000 + k, t, None) for k, t in enumerate(["½", "² ³", "①", "Ⅷ", "12 ٣", "_", "½a"])]
    table = spark.createDataFrame(known + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(table, table, model).collect()}
    assert all(got[1000 + k] == ("und", 0.0) for k in range(6)) and got[1006][0] == "en"


def test_language_fit_and_score_by_enumeration(spark):
    """Rounds of the fit and the score of a text, with every segmentation written out."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat", "en"), ("the that", "en"), ("le chat", "fr"), ("la", "fr"), ("cat", "en"), ("chatte", "fr")] * 3)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, pieces, probs = language_id.fit(table, model, per_language=10**9)
    at = {p: k for k, p in enumerate(pieces, 1)}

    def cuts(word):
        if not word:
            yield ()
        for k in range(1, len(word) + 1):
            if word[:k] in at or k == 1:
                for rest in cuts(word[k:]):
                    yield (at.get(word[:k], len(pieces) + 1), *rest)

    start = np.array([0.0, *[10.0 ** -(5 - min(len(p), 4) * 0.5) for p in pieces], 1e-9])
    want = np.repeat((start / start.sum())[:, None], len(langs), 1)
    for _ in range(language_id.ROUNDS):
        counts = np.zeros_like(want)
        for _, text, lang in rows:
            for word in language_id.letter_words(text):
                ways, c = list(cuts(word)), langs.index(lang)
                weights = np.array([np.prod(want[list(w), c]) for w in ways])
                for w, share in zip(ways, weights / weights.sum()):
                    np.add.at(counts[:, c], list(w), share)
        counts[1:] += 0.01
        counts[-1] = np.maximum(counts[-1], 0.1)
        want = np.maximum(counts / counts.sum(0), language_id.LEAST)
    assert np.allclose(probs, want)
    text = "the chat"
    likely = np.array([np.prod([sum(np.prod(want[list(w), c]) for w in cuts(word)) for word in language_id.letter_words(text)]) for c in range(len(langs))])
    (logs,) = language_id.Scorer(pieces, probs).score([text])
    assert np.allclose(np.exp(logs - logs.max()), likely / likely.max(), rtol=1e-4)


def test_language_id_with_runs_of_unknown_letters(spark):
    """Long runs of letters without pieces, in few or many words, leave the model finite and the rest of its verdicts as they were."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    parts = {"en": "the and ing tion er of", "fr": "eau que ment les ouï ère"}
    rows = [(k, prose(k, 30, parts[lang]), lang) for k in range(200) for lang in [("en", "fr")[k % 2]]]
    odd = [(1000 + k, "\U0001d538" * n + " " + "\U0001d539" * 40, "fr") for k, n in enumerate((30, 36, 47, 48, 60, 300, 5000))]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    *_, probs = language_id.fit(table, model)
    assert np.isfinite(probs).all() and (probs > 0).all()
    got = {r.doc_id: r for r in language_id.identify(table, table, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[k].lang_pred == lang for k, _, lang in rows) >= 0.97 * len(rows)
    assert {got[k].lang_pred for k, *_ in odd} == {"fr"}


def lattice_rows(pieces):
    return [(p, k + 1) for k, p in enumerate(pieces)]


def test_token_files(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    folder = new_path(spark, "test-files")
    token_files.write_token_files(docs, folder, path, 2)
    got = token_files.read_token_files(spark, folder).collect()
    at, want = 0, []
    for i, t in sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert multiset(map(tuple, got)) == multiset(want)
    folder = new_path(spark, "test-files")
    token_files.write_token_files(empty, folder, path, 2)
    assert token_files.read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_as_whole_texts(name):
    from tallyscope.llm.encoding import ChunkEncoder

    path = public_tokenizers.path(name)
    tokenizer, enc = Tokenizer.from_file(path), ChunkEncoder(path, name.startswith("word"), limit=50)
    rng = random.Random(5)
    alphabet = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", "a", "B", "é", "'s", "'", "1", "23", "!?", ".", "日", "\u0301", "Σ", "\0", "<|endoftext|>", "word", "İ"]
    texts = [t for t in awkward_texts() if t is not None] + ["".join(rng.choices(alphabet, k=rng.randint(1, 12))) for _ in range(3000)]
    for a in range(0, len(texts), 50):
        for t, got in zip(texts[a : a + 50], enc.encode(texts[a : a + 50])):
            assert list(np.frombuffer(got, "<u4")) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_url_filters(spark):
    urls = [None, "", "nothing", "http://", "https://example.com", "http://www.Example.COM/en/x?y", "http://a.www.example.com/en/", "http://example.com/en/q#z", "http://xexample.com/en/", "http://net/es/1", "ftp://a.net/fr/?", "a://b.com/c://net/es/", "http://example.com./en/", "http://.com/", "http://com?x", "http://com/en/"]
    rows = [(k, u) for k, u in enumerate(urls * 2)] + [(None, "http://hot.net/es/9")] + [(1000 + k, f"http://hot.net/{'es' if k % 2 else 'xx'}/{k}") for k in range(300)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, rule string")

    def judge(url, rules):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))

    more = [*url_filters.RULES, ("block", "hot.net", "/"), ("allow", "hot.net", "/es/1"), ("allow", "com", "/"), ("block", "com", "/")]
    for rules, n in ((url_filters.RULES, 65_536), (more, 8)):
        frame = spark.createDataFrame(rules + [("block", None, "/")], "verdict string, host string, path string")
        got = url_filters.judge_urls(pages, frame, per_range=n).collect()
        assert multiset(map(tuple, got)) == multiset((i, *judge(u, rules)) for i, u in rows)
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert {r.verdict for r in url_filters.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filters.judge_urls(pages.limit(0), frame).count() == 0


def test_fingerprints(docs, empty):
    units = re.compile(r"(?<![^\n])[^\n]{1,24}|[^\n]{1,128}")
    order = sorted(((i, t or "") for i, t in texts_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()), reverse=True)

    def like(a, b):
        a, b = set(units.findall(a)), set(units.findall(b))
        return 1.0 if not a | b else len(a & b) / len(a | b)

    want = []
    for k, (i, t) in enumerate(order):
        follows = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + follows[:h]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(t, edited), 9), round(like(t, follows), 9)))
    got = fingerprints.edited_likeness(docs).collect()
    assert multiset((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == multiset(want)
    by_id = {r.doc_id: r.fingerprint for r in got}
    assert len(set(by_id.values())) > 20 and all(len(x) == len(got[0].fingerprint) for x in by_id.values())
    assert fingerprints.edited_likeness(empty).count() == 0


def test_fingerprints_retry_larger(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SPREAD", 0.2)  # too small at first: peeling has to fail and grow
    sets = [(k, 0, 20.0 * k, list(range(k * 1000, k * 1000 + 90)), list(range(k * 1000 + 45, k * 1000 + 130))) for k in range(8)]
    frame = spark.createDataFrame(sets, "uid long, pair int, guess double, a array<long>, b array<long>")
    for tries in (8, 1):  # with a single try, the exact count has to step in
        got = fingerprints.differing(frame, tries=tries).collect()
        assert sorted((r.uid, r.differing) for r in got) == [(k, 85) for k in range(8)]


def test_fingerprint_cells_subtract_and_peel(spark):
    rng = random.Random(11)
    sets = []
    for k in range(300):
        common = rng.sample(range(10**6), rng.randint(0, 400))
        extra = rng.sample(range(10**6, 2 * 10**6), rng.choice((0, 1, 2, 3, 4, 5, 30, 300)))
        cut = rng.randint(0, len(extra))
        sets.append((k, common + extra[:cut], common + extra[cut:], len(extra)))
    frame = spark.createDataFrame(sets, "k int, a array<long>, b array<long>, d int")
    sub = fingerprints.subtracted(fingerprints.small_sketch(F.col("a")), fingerprints.small_sketch(F.col("b")))
    got = frame.select("d", sub.alias("s")).select("d", fingerprints.peeled(F.col("s")).alias("found"), fingerprints.expected_difference(F.col("s")).alias("about"), "s").collect()
    assert all(r.found in (None, r.d) for r in got) and all(r.found == r.d for r in got if r.d < 2)
    assert sum(r.found == r.d for r in got if r.d in (2, 3, 4)) > 0.8 * sum(r.d in (2, 3, 4) for r in got)
    assert all(r.found is None for r in got if r.d > 12)
    for d in (30, 300):
        about = [r.about for r in got if r.d == d]
        assert 0.75 * d < sum(about) / len(about) < 1.25 * d
    # the sketch is linear: a text's own sketch less nothing is its set
    r = frame.where("k = 0").select(F.size("a").alias("n"), fingerprints.small_sketch(F.col("a")).alias("s")).first()
    assert all(sum(x.n for x in r.s[t * 4 : t * 4 + 4]) == r.n for t in range(3))


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, capacity = Tokenizer.from_file(path), 256
    got = packing.pack_documents(docs, path, 1, capacity).collect()
    want, total = [], 0
    for i, t in texts_of(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    assert multiset(tuple(r)[:5] for r in got) == multiset(want)
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(held) <= -(-total // capacity) + 2
    assert packing.pack_documents(empty, path, 1, capacity).count() == 0


def test_packing_plan_uses_every_piece_once():
    rng = random.Random(3)
    for capacity, lengths in ((100, [rng.randint(1, 100) for _ in range(5000)]), (64, [7] * 1000 + [64] * 5 + [1] * 3), (50, [50, 1, 49, 26, 26])):
        counts = collections.Counter(lengths)
        runs = packing.plan_packing(counts, capacity)
        ranks, filled = collections.defaultdict(list), collections.defaultdict(list)
        for n, lo, hi, seq, at in runs:
            ranks[n] += range(lo, hi)
            for k in range(hi - lo):
                filled[seq + k].append((at, n))
        assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
        for pieces in filled.values():
            pieces.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and sum(pieces[-1]) <= capacity
        assert len(filled) <= 1.02 * -(-sum(lengths) // capacity) + 1


def brute_groups(texts):
    fps = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda c: c[0].lower(), x) for x in WORD.findall(t or "")]
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        ones = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), 42)
            for b in range(64):
                ones[b] += h >> b & 1
        fps.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)))
    return fps


def reach(fps, limit=3):
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_simhash(docs, empty):
    rows = texts_of(docs)
    fps = brute_groups([t for _, t in rows])
    group = reach(fps)
    low = {}
    for (i, _), g in zip(rows, group):
        low[g] = min((x for x in (low.get(g), i) if x is not None), default=None)
    want = multiset((i, format(f, "016x"), low[g]) for (i, _), f, g in zip(rows, fps, group))
    assert multiset(map(tuple, simhash.simhash_groups(docs).collect())) == want
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert multiset(map(tuple, kept.collect())) <= multiset(map(tuple, docs.collect()))
    assert {r.doc_id for r in kept.collect()} == set(low.values())


def test_simhash_index_finds_all_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 5), replace=False))) for b in base for _ in range(4)]
    ball = [base[0] ^ np.uint64((1 << i) | (1 << j)) for i in range(40) for j in range(i)]  # whole runs link at once
    fps = np.unique(np.concatenate([base, np.array(flips, np.uint64), np.array(ball, np.uint64)]))
    want = simhash.Forest(len(fps))
    want.join(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 3))
    place = {int(x): k for k, x in enumerate(fps)}
    own, guests = fps[::3], np.concatenate([fps[1::3], fps[2::3]])
    got = simhash.Forest(len(fps))
    for a, b in (simhash.local_links(own, guests, 3), simhash.local_links(guests, np.empty(0, np.uint64), 3)):
        got.join(np.array([place[int(x)] for x in a], int), np.array([place[int(x)] for x in b], int))
    assert (got.settle() == want.settle()).all()


def test_simhash_links_cross_partitions(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ np.uint64(1 << 63), base ^ np.uint64((1 << 62) | (1 << 40) | 1)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.near_links(frame, 3, per_part=50).collect()
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    got, want = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    got.join(np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links]))
    want.join(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 3))
    assert (got.settle() == want.settle()).all()


def test_simhash_sends_a_fingerprint_as_often_at_any_size(spark):
    rng = np.random.default_rng(6)
    for n in (2000, 8000, 32_000):
        frame = spark.createDataFrame([(int(x),) for x in rng.integers(-(2**63), 2**63, n)], "fp long")
        sent = simhash.runs(frame, n, 3, 500).groupBy("turn", "run", "x", "y").count().collect()
        assert sum(r["count"] for r in sent) == 4 * n and max(r["count"] for r in sent) <= 1100


def linked_alike(fps, links) -> bool:
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    got, want = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    got.join(np.array([place[r.a] for r in links], int), np.array([place[r.b] for r in links], int))
    for at in range(0, len(fps), 500):
        a, b = np.nonzero(np.bitwise_count(fps[at : at + 500, None] ^ fps) <= 3)
        want.join(a + at, b)
    return bool((got.settle() == want.settle()).all()) and len(set(want.settle())) > 1


def test_simhash_heavy_blocks_are_split(spark):
    rng = np.random.default_rng(7)
    near = np.uint64(0x0123456789ABCDEF) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(600)], np.uint64)
    fps = np.unique(near)
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    sent = simhash.runs(frame, len(fps), 3, 40).groupBy("key", "turn", "run", "x", "y").count().collect()
    assert max(r["count"] for r in sent) < 200 and any(r.key for r in sent)
    assert linked_alike(fps, simhash.near_links(frame, 3, per_part=40).collect())


@pytest.mark.parametrize("shared", [0, 30])
def test_simhash_sends_stay_bounded_where_blocks_are_full(spark, shared):
    """Far more fingerprints to a block than a run takes, or a third of all that begin alike: each is sent a fixed number of times, and no link is lost."""
    rng = np.random.default_rng(shared)
    made = rng.integers(0, 2**63, 4500, dtype=np.uint64)
    made[:1500] = made[:1500] >> np.uint64(shared) | np.uint64(0xABCDEF0123456789) >> np.uint64(64 - shared) << np.uint64(64 - shared) if shared else made[:1500]
    flips = [made[k] ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 4), replace=False))) for k in range(0, 4500, 3)]
    fps = np.unique(np.concatenate([made, np.array(flips, np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    assert linked_alike(fps, simhash.near_links(frame, 3, per_part=20).collect())
    times = simhash.runs(frame, len(fps), 3, 20).groupBy("fp").count().agg(F.max("count"), F.avg("count")).first()
    assert times[0] <= 40 and times[1] <= 12


def test_simhash_sends_at_many_times_the_first_level(spark):
    frame = spark.range(300_000).select(F.xxhash64("id").alias("fp"))
    times = simhash.runs(frame, 300_000, 3, 1).groupBy("fp").count().agg(F.max("count"), F.avg("count")).first()
    assert times[0] <= 32 and times[1] <= 17


@pytest.mark.parametrize("per_task", [1_000_000, 30])
def test_components(spark, per_task):
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 5), (7, 3), (3, 9), (9, 7)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), per_task).collect()}
    assert all(got[k] == 100 for k in range(101, 161)) and got[7] == got[9] == 3 and got[1099] == 1000
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(docs, empty):
    mixed, c = mixing.mix(docs)
    rows = mixed.collect()
    assert len(rows) == docs.count() and c["size"] != "size"
    assert multiset(tuple(r)[: len(docs.columns)] for r in rows) == multiset(map(tuple, docs.collect()))
    sizes = collections.defaultdict(int)
    for r in rows:
        assert r[c["size"]] == len(WORD.findall(r.text or ""))
        sizes[r.source] += r[c["size"]]
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= 2 * sizes[s]}
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    taken = collections.defaultdict(int)
    for r in rows:
        assert np.isclose(r[c["target"]], target[r.source]) and r[c["source_size"]] == sizes[r.source] and 0 <= r[c["copies"]] <= 2
        taken[r.source] += r[c["size"]] * r[c["copies"]]
    for s in names:
        largest = max(r[c["size"]] for r in rows if r.source == s)
        assert abs(taken[s] - target[s]) <= 2 * largest
    again = mixing.mix(docs.repartition(7))[0].collect()
    assert multiset(map(tuple, again)) == multiset(map(tuple, rows))
    assert mixing.mix(empty)[0].count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        words = prose(k, 40).split()
        toxic = k % 3 == 0
        for _ in range(2 if toxic else 0):
            words[rng.randrange(40)] = rng.choice(["vex", "grul"]) + rng.choice(["or", "um", "ik", "ast", "ep", "ul"])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(table, table, marks).collect()
    true = dict(labels)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == true[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = toxicity.score_documents(docs, table, marks).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in toxicity.score_documents(docs, table, marks.limit(0)).collect()} == {0.0}
    assert toxicity.score_documents(empty, empty, marks.limit(0)).count() == 0
    kept = toxicity.keep_civil(table, table, marks)
    assert kept.columns == table.columns and 380 <= kept.count() <= 420


def test_shared_backoff_gives_unknown_letters_no_evidence():
    a = toxicity.Ratio(collections.Counter(g for w in ("abc", "abd") for g in toxicity.grams(w)), collections.Counter(g for w in ("xyz", "xyw") for g in toxicity.grams(w)))
    assert a.gram("q" * toxicity.ORDER) == 0.0
    start = "^" * (toxicity.ORDER - 2)
    assert a.gram(f"{start}ab") > 0 > a.gram(f"{start}xy")
    for k in (0, 1):  # what follows a context sums to at most one
        assert sum(np.exp(a.of_class(k, f"{start}a{c}")) for c in "abcdxyzw$") <= 1 + 1e-9


def brute_kneser_ney(words, classes, gram):
    """log P(last letter | the others, toxic) less the same for ordinary, from the definition: counts on top, numbers of contexts below."""
    marked = [["^" * (toxicity.ORDER - 1) + w + "$" for w in ws] for ws in words]
    tops = [collections.Counter(s[i : i + toxicity.ORDER] for s in ss for i in range(len(s) - toxicity.ORDER + 1)) for ss in marked]

    def count(k, g):
        if len(g) == toxicity.ORDER:
            return tops[k][g]
        # a gram's continuation count: letters that stand before it, in words of the class or, for shared orders, of either
        return len({x[-len(g) - 1] for t in ([tops[k]] if len(g) > toxicity.SHARED else tops) for x in t if x.endswith(g)})

    def prob(k, g):
        if not g:
            return toxicity.FLOOR
        letters = {x[-1] for t in tops for x in t}
        each = {c: count(k, g[:-1] + c) for c in letters | {g[-1]}}
        total, types = sum(each.values()), sum(n > 0 for n in each.values())
        if not total:
            return prob(k, g[1:])
        return (max(each[g[-1]] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * types * prob(k, g[1:])) / total

    return np.log(prob(0, gram) / prob(1, gram))


def test_kneser_ney_gram_by_gram():
    rng = random.Random(12)
    words = [["".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(25)] for _ in range(2)]
    counts = [collections.Counter(g for w in ws for g in toxicity.grams(w)) for ws in words]
    ratio = toxicity.Ratio(*counts)
    for g in ["".join(rng.choices("abcde^$", k=toxicity.ORDER)) for _ in range(40)] + list(counts[0])[:60] + list(counts[1])[:60]:
        assert np.isclose(ratio.gram(g), brute_kneser_ney(words, 2, g)), g


def test_toxicity_is_per_letter():
    scorer = toxicity.Scorer(collections.Counter(toxicity.grams("vexor")), collections.Counter(g for w in ("the", "and") for g in toxicity.grams(w)), limit=2)
    strongest = scorer.evidence("the vexor vexor and the")
    w = {x: scorer.word(x) for x in ("the", "vexor", "and")}
    assert np.isclose(strongest, w["vexor"] / 6) and np.isclose(scorer.evidence("The vexor"), (w["the"] + w["vexor"]) / (4 + 6)) and np.isclose(scorer.evidence("and"), w["and"] / 4)
    assert scorer.evidence(None) == scorer.evidence("1 2") == 0.0 and len(scorer.words) <= 2
    assert np.isfinite(scorer.evidence("q" * 100_000))


def reference_unigram(pieces, bytes_too):
    vocab = [("<unk>", 0.0), *((p, s / token_counts.SCALE) for p, s in pieces)]
    return vocab + [(f"<0x{k:02X}>", 0.0) for k in range(256)] if bytes_too else vocab


def test_token_counts(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces, bytes_too = token_counts.vocabulary(path)
    tokenizer = Tokenizer(models.Unigram(reference_unigram(pieces, bytes_too), 0, byte_fallback=bytes_too))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = token_counts.count_tokens(docs, path).collect()
    want = [(i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in texts_of(docs)]
    assert multiset(map(tuple, got)) == multiset(want)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_token_counts_ties_and_unknowns():
    rng = random.Random(11)
    for case in range(60):
        found = {"".join(rng.choices("ab▁c", k=rng.randint(1, 4))) for _ in range(12)} | {"a"}
        pieces = [(p, -float(rng.choice((1, 2, 2, 3)) * token_counts.SCALE)) for p in sorted(found)]
        count = token_counts.Counter(pieces, False)
        tokenizer = Tokenizer(models.Unigram(reference_unigram(pieces, False), 0, byte_fallback=False))
        tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        for _ in range(30):
            text = "".join(rng.choices("ab cx", k=rng.randint(1, 14)))
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert count(text) == len(ids), (pieces, text)


HELPERS = (
    "simhash_fp simhash_row keep_fp keep_id near_set near_row fp low root node row id text2 first n plan_rate plan_part plan_source mix_row mix_facts mix_source size source_size target copies rate start part at range "
    "language toxic_score component_id source.x a.b doc id"
).split(" ")


@pytest.mark.parametrize("name", ["near", "simhash", "mix", "civil", "identified"])
def test_columns_of_any_name(spark, name):
    """Filters and the mix with columns named like every helper, names with dots, nulls, repeated rows, a long text, no rows."""
    from tallyscope.llm import near_copies

    parts = {"en": "the and ing tion er of", "fr": "eau que ment les ouï ère"}
    rows = [(k, prose(k, 20, parts[lang]) + (" vexor vexum" if k % 3 == 0 else ""), lang, "ab"[k % 2]) for k in range(60) for lang in [("en", "fr")[k % 2]]]
    rows += [rows[0], rows[0], (None, None, None, None), (70, "", None, "a"), (71, prose(3, 400_000), "en", "b"), (None, "null id here", "en", None)]
    extra = {c: F.lit(7) for c in HELPERS if c not in ("id",)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns(extra)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    apply = {
        "near": near_copies.drop_near_copies, "simhash": simhash.drop_near_duplicates, "mix": lambda d: mixing.mix(d)[0],
        "civil": lambda d: toxicity.keep_civil(d, docs, labels), "identified": lambda d: language_id.keep_identified(d, docs, path),
    }[name]
    got = apply(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    held = multiset(tuple(r)[: len(docs.columns)] for r in got.collect())
    assert held and held <= multiset(map(tuple, docs.collect()))
    assert apply(docs.limit(0)).count() == 0
