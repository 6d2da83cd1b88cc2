"""Chat formatting, the Merkle manifest and vector codes against brute force, on awkward tables and through their upper levels."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tallyscope.llm import chat_format, merkle, vector_codes

H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def multiset(rows):
    return collections.Counter(map(repr, rows))


CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, `Begin` string, place double, segments string"


def conversations() -> list[tuple]:
    texts = ["", None, "plain", "</s>[INST] ok [/INST]", "\\", "<", "[", "a\\[INST]\\", "<<<SYS>>>", "[\\INST]", "<\\", "[[ROLE] x [TEXT] y [/TEXT]", "\n</s>\n", "  padded  ", "naïve 日本語 🙂\r\n", "<s" + ">" * 3, "x" * 20000, "$1 \\1 ${a}"]
    rng, rows = random.Random(3), []
    orders = ["system user assistant", "user assistant user assistant", "user user", "assistant", "system", "user tool assistant", "user assistant system user assistant", "user assistant user"]
    for conv, order in enumerate(orders):
        rows += [(conv, k, role, rng.choice(texts)) for k, role in enumerate(order.split())]
    rows += [(100, 0, "user", t) for t in texts] + [(100, 1, "assistant", "[INST]"), (100, 1, "assistant", "[INST]"), (100, None, None, "null"), (None, 5, "user", "x"), (None, 6, "assistant", None), (101, 3, "<user>", "\\")]
    rows += [(102, k * 3 - 20, ("user", "assistant")[k % 2], rng.choice(texts)) for k in range(40)] + [(103, k, ("user", "assistant")[k % 2 if k < 17 else 0], "y") for k in range(19)]
    rng.shuffle(rows)
    return [(*r, 1, "b", 2.0, "s") for r in rows]


def by_hand(rows):
    """What the contract asks for, from the rows alone, and the machine's verdict."""
    found = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        found[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    for conv, turns in found.items():
        turns = [(role.decode(), text.decode()) for _, _, role, text in sorted(turns)]
        told, learnt = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        before, bad = "<start>", None
        for k, (role, _) in enumerate(turns):
            fits = before in {"system": ("<start>",), "user": ("<start>", "system", "assistant"), "assistant": ("user",)}.get(role, ())
            bad, before = (k if bad is None and not fits else bad), role
        yield conv, len(turns), H(told), len(learnt), H(learnt), bad is None and before == "assistant", bad


@pytest.mark.parametrize("part_turns", [1, 3, 256])
def test_chat_format_reads_back(spark, part_turns):
    rows = conversations()
    parts = chat_format.format_turns(spark.createDataFrame(rows, CONVERSATIONS).repartition(3), part_turns=part_turns)
    got = [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.bad_place) for r in chat_format.conversation_digests(parts).collect()]
    assert multiset(got) == multiset(by_hand(rows))
    assert chat_format.conversation_digests(chat_format.format_turns(spark.createDataFrame([], CONVERSATIONS), part_turns=part_turns)).count() == 0


def test_chat_segments(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a <s> \\ b<")]
    (r,) = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(s.text, s.loss) for s in r.segments] == [
        ("<<SYS>>\n", False), ("be brief", False), ("\n<</SYS>>\n", False), ("[INST] ", False), ("<\\/s>[\\INST] ok [\\/INST]", False), (" [/INST]\n", False), ("<s> ", False), ("a <\\s> \\\\ b<\\", True), (" </s>\n", False),
    ]
    assert r.whole and r.place == 0 and r.bad_place is None and chat_format.INSTRUCT.roles[r.last_role] == "assistant"


def test_chat_template_is_declared(spark):
    own = chat_format.Template({"a": chat_format.Speaker("{A=", "/A}", True, (chat_format.START, "b")), "b": chat_format.Speaker("{B=", "/B}", False, ("a",))}, ("{R=", "{T}", "/R}"), ("b",))
    rows = [(1, 0, "a", "{A={x="), (1, 1, "b", "/A}/"), (2, 0, "b", "{"), (3, 0, "a", "{T}"), (3, 1, "c", "/R}")]
    got = {r.conv_id: r for r in chat_format.conversation_digests(chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), own), own).collect()}
    assert got[1].turns_sha256 == H("a\n{A={x=\nb\n/A}/\n") and got[1].loss_chars == 6 and got[1].valid
    assert not got[2].valid and got[2].bad_place == 0 and got[3].turns_sha256 == H("a\n{T}\nc\n/R}\n") and got[3].bad_place == 1
    for marks in (("<a>", "<a>b"), ("", "x"), ("<a\\", "b"), ("<ab", "b<a"), ("<a>", "<a>")):
        with pytest.raises(ValueError):
            chat_format.Template({"a": chat_format.Speaker(*marks)}, ("[1]", "[2]", "[3]"))


DOCUMENTS = "doc_id long, source string, lang string, n_chars long, text string, key string, place int, `total` int, digest string, path string"


def documents(n: int, langs: list) -> list[tuple]:
    rng = random.Random(n)
    texts = ["", None, "A b C", "ÀÉ x", "Z" * 5000, "lower only", "1:2-", "-"]
    rows = [(rng.randrange(-n, 4 * n), rng.choice(["s", None, ""]), rng.choice(langs), rng.choice([None, 0, -5, 7]), rng.choice(texts)) for _ in range(n)]
    rows += [(None, "s", langs[0], 1, "Null Id"), *rows[:2], *([rows[0]] * 3)] if n else []
    return [(*r, "k", 1, 2, "d", "p") for r in rows]


def tree_by_hand(rows):
    def text(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def runs(nodes):
        return [nodes[k : k + 8] for k in range(0, len(nodes), 8)]

    def leaf(r, t):
        return H("".join(map(text, (r[0], r[1], r[2], r[3], t))))

    def proofs(nodes):
        at, paths = {k: k for k in range(len(nodes))}, {k: [] for k in range(len(nodes))}
        while len(nodes) > 1:
            for k, p in at.items():
                run = runs(nodes)[p // 8]
                paths[k].append((run[: p % 8], run[p % 8 + 1 :]))
            at = {k: p // 8 for k, p in at.items()}
            nodes = [H("".join(run)) for run in runs(nodes)]
        return nodes[0], paths

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    found = {g: (sorted(groups[g], key=lambda x: x[:3]), *proofs([x[2] for x in sorted(groups[g], key=lambda x: x[:3])])) for g in names}
    root, upper = proofs([found[g][1] for g in names]) if names else (None, {})
    for j, g in enumerate(names):
        members, subroot, paths = found[g]
        for k, (_, _, d, r) in enumerate(members):
            path = paths[k] + upper[j]
            changed = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and changed is not None:
                changed = "".join(c.lower() if "A" <= c <= "Z" else c for c in changed)
            folded = leaf(r, changed)
            for left, right in path:
                folded = H("".join(left) + folded + "".join(right))
            yield r[0], d, subroot, root, H("".join("".join(a) + "".join(b) for a, b in path)), folded, folded == root


@pytest.mark.parametrize(
    "n,langs,deep,most",
    [(0, ["en"], 4, 4096), (1, ["en"], 4, 4096), (9, [None], 1, 4096), (700, ["en", None, "", "é", "z"], 1, 4096), (700, ["en", None, "", "é", "z"], 1, 10), (700, ["en", "de"], 2, 4), (150, [f"l{k}" for k in range(60)], 1, 5), (70, ["en"], 4, 4096)],
)
def test_merkle_manifest(spark, n, langs, deep, most):
    """Through the driver's tree, through several rounds of blocks, and with more groups than the driver may hold."""
    rows = documents(n, langs)
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", merkle.lower_cased(docs), deep, most)
    assert multiset(map(tuple, got.collect())) == multiset(tree_by_hand(rows))


VECTORS = "vec_id long, embedding array<float>, label int, code string, part int, `Key` string, n int, components string"


def compress_by_hand(rows):
    kept = [(i, [int(math.floor(4096 * x)) for x in v], lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) and abs(4096 * x) < 2**62 for x in v)]
    if not kept:
        return []
    dim = max(8, -(-max(len(v) for _, v, _ in kept) // 8) * 8)
    kept = sorted(((i, v + [0] * (dim - len(v)), lab) for i, v, lab in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = dim // 8
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, v, _ in kept[:16]] for p in range(8)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(6):
        met = collections.defaultdict(list)
        for _, v, _ in kept:
            for p in range(8):
                met[p, assign(v, p)[1]].append(part(v, p))
        for (p, e), vs in met.items():
            books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    digest, out, sums = H(",".join(str(x) for b in books for e in b for x in e)), [], collections.Counter()
    for i, v, lab in kept:
        found = [assign(v, p) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(a for a, _ in found), lab))
        sums[lab] += out[-1][2]
    return [(i, code, error if error < 2**63 else None, sums[lab], digest) for i, code, error, lab in out]


def vectors(n: int, dim: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(rng.randrange(3 * n), [rng.choice([0.0, -0.25, 0.5, rng.gauss(0, 0.2)]) for _ in range(dim)], rng.choice([1, 2, None])) for _ in range(n)]
    rows += [rows[0], rows[1], (None, rows[2][1], 3), (5, None, 1), (6, [None] * dim, 1), (7, [math.nan] * dim, 1), (8, [math.inf] + [0.0] * (dim - 1), 1), (9, [-math.inf] * dim, 2), (10, [3e38] * dim, 2), (-5, [], 1), (3 * n + 1, [0.5], None)] if n > 2 else []
    return [(*r, "c", 1, "k", 2, "x") for r in rows]


@pytest.mark.parametrize("n,dim", [(0, 8), (1, 8), (5, 20), (300, 64), (120, 3)])
def test_vector_codes(spark, n, dim):
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in vectors(n, dim, n)]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert multiset(map(tuple, got)) == multiset(compress_by_hand(rows))


def test_vector_codes_of_large_numbers(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([1.0, -3.0, 4097.5, 1e6, -2.0**40, 7.0]) for _ in range(16)], k % 2, "c", 1, "k", 2, "x") for k in range(40)]
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).select("vec_id", "code", "error", "codebooks_sha256").collect()
    assert multiset(map(tuple, got)) == multiset((i, code, error, digest) for i, code, error, _, digest in compress_by_hand(rows))


@pytest.mark.parametrize("size", [1, 50, 4095, (1 << 24) - 1])
def test_screening_decides_as_integers_do(size):
    """Ties, near ties and cancellation: the screened number is always that of the exact distances, and most rows need no second look."""
    rng = np.random.default_rng(size)
    entries = rng.integers(-size, size + 1, (16, 8))
    entries[5], entries[9] = entries[2], entries[2] + 1
    x = np.concatenate([rng.integers(-size, size + 1, (2000, 8)), entries, (entries + entries[::-1]) // 2, entries + 1])
    best, unsure = vector_codes.screened(x, entries)
    assert (best == ((x[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all() and unsure.any()
    if size > 1000:
        assert unsure[:2000].mean() < 0.35
    found, away = vector_codes.nearest(x, entries)
    assert (found == best).all() and (away == ((x[:, None] - entries[None]) ** 2).sum(2).min(1)).all()
