"""Whitening, packing and the conversation trie against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfmark.llm import packing, prefix_trie, queries, whitening

VECTORS = "vec_id long, embedding array<float>, n long, component string"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_whitening(rows, k):
    """Exact covariances, and the eigenvectors of their floats."""
    width = max([0, *(len(v) for _, v in rows)])
    x = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))) for i, v in rows]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[sum((Fraction(v[i]) - Fraction(sums[i], n)) * (Fraction(v[j]) - Fraction(sums[j], n)) for v in fit) / n for j in range(width)] for i in range(width)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in r] for r in cov]))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-9 * values[0]).sum()))
    out = defaultdict(list)
    for i, v in x:
        y = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums)])
        w = y @ vectors[:, :k] / np.sqrt(values[:k])
        out[i].append((sum((n * c - s) ** 2 for c, s in zip(v, sums)), np.abs(w), values[:k] / values.sum()))
    return n, k, out


@pytest.mark.parametrize("width,count,low_rank", [(12, 150, False), (20, 9, False), (7, 60, True)])
def test_whitening_is_that_of_exact_covariances(spark, width, count, low_rank):
    rng = np.random.default_rng(width)
    data = rng.normal(size=(count, 3)) @ rng.normal(size=(3, width)) * 4 if low_rank else rng.normal(size=(count, width)) * np.linspace(5, 0.2, width)
    data[:, -1] = 0.5  # a dimension without variance
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [(count, rows[0][1]), (None, rows[1][1]), (3, rows[3][1]), (count + 1, rows[2][1][:4])] + [(900 + i, rows[4][1]) for i in range(60)]
    dropped = [(800, None), (801, [None] * width), (802, [float("nan")] * width), (803, [float("inf")] + [0.0] * (width - 1))]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + dropped], VECTORS).repartition(5)
    n, k, wanted = brute_whitening(rows, 16)
    found = whitening.whiten(df).collect()
    assert len(found) == k * len(rows) and {r["component"] for r in found} == set(range(1, k + 1))
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-8
    got = defaultdict(list)
    for r in found:
        got[r["vec_id"]].append(r)
    for i, own in wanted.items():
        for deviation, w, share in own:
            for c in range(k):
                assert any(r["component"] == c + 1 and r["n"] == n and int(r["deviation"]) == deviation and math.isclose(abs(r["whitened"]), w[c], rel_tol=1e-6, abs_tol=1e-7)
                           and math.isclose(r["explained"], share[c], rel_tol=1e-9) for r in got[i])


def test_components_have_one_sign_for_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(rng.normal(size=(80, 6)))]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS), k=3).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(found.T, bias=True) - np.eye(3)).max() < 1e-9


def test_whitening_corner_cases(spark):
    for rows in ([], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in rows], VECTORS)).count() == 0
    huge = [(1, [1e30, 1.0], 0, ""), (2, [-1e30, 2.0], 0, ""), (3, [0.0, 5.0], 0, "")]
    found = whitening.whiten(spark.createDataFrame(huge, VECTORS)).collect()
    top = 1 << 61
    assert {r["vec_id"]: int(r["deviation"]) for r in found}[1] == (3 * (top + 10**6) - 3 * 10**6) ** 2 + (3 * 64 - 8 * 64) ** 2
    # sums beyond 64 bits are exact
    x = np.array([[top, 5], [top - 1, -7], [3, 9]], dtype=np.int64)
    n, sums = 3, [int(2 * top + 2), 7]
    assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    big_n = whitening.deviations(np.array([[1_000_070, 999_990]]), 10**12, [10**18 + 3, 10**18 - 11])
    assert big_n == [(10**12 * 1_000_070 - 10**18 - 3) ** 2 + (10**12 * 999_990 - 10**18 + 11) ** 2]


def test_factor_and_rotation():
    rng = np.random.default_rng(5)
    for size, rank in ((1, 1), (2, 2), (9, 9), (16, 5)):
        a = rng.normal(size=(size, rank)) * np.logspace(0, -3, rank)
        m = a @ a.T
        factor = whitening.pivoted_cholesky(m)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, m, atol=1e-12)
        order = [int(np.flatnonzero((factor[:, k] != 0) & (factor[:, k + 1:] == 0).all(axis=1))[0]) for k in range(rank)]
        assert np.allclose(np.triu(factor[order], 1), 0)  # triangular in the order of its pivots
        values, vectors = whitening.principal(m, rank)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:rank]) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)


DOCS = "doc_id long, text string, start string, sequence_id int"


def packed(spark, texts, capacity=packing.CAPACITY, parts=3):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in texts], DOCS).repartition(parts)
    return packing.pack(df, WORDS, capacity=capacity).collect()


def check_packing(texts, found, capacity, spare):
    """Every id once and in order, sequences without gaps; returns the share of padding."""
    own = Tokenizer.from_file(WORDS)
    wanted = defaultdict(list)
    for i, t in texts:
        wanted[i].append(np.array(own.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        assert r["length"] >= 1 and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == wanted.keys()
    for i, copies in wanted.items():
        assert sorted(b"".join(copies)) == sorted(b"".join(bytes(r["ids"]) for r in by_doc[i]))
        if len(copies) == 1:
            mine = sorted(by_doc[i], key=lambda r: r["start"])
            assert b"".join(bytes(r["ids"]) for r in mine) == copies[0]
            assert [r["start"] for r in mine] == np.concatenate(([0], np.cumsum([r["length"] for r in mine])[:-1])).tolist()
            assert {r["doc_tokens"] for r in mine} == {len(copies[0]) // 4}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = padding = 0
    for rows in by_sequence.values():
        end = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
        total, padding = total + end, padding + (0 if end & (end - 1) == 0 else capacity - end)
    assert padding <= spare * total
    return total


def odd_texts(n, seed):
    rng = random.Random(seed)
    odd = ["<|endoftext|>", "it's", "ΣΑΣ Σ.", "éa", " ́b", " x y", "İstanbul", "😀😀", "　汉字", "don'T", "\x1cq\x1f", "a<|startoftext|>b", "x" * 400, "\u0085", "ﬁ"]
    texts = [(i, "\n".join(" ".join(rng.choice(["data", "The", "of", "1234", "größe", *odd]) for _ in range(rng.choice([0, 1, 3, 20, 400]))) for _ in range(3))) for i in range(n)]
    return texts + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "word " * 9000), (None, "no id here"), (3, texts[3][1])]


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_packing_holds_every_id_once(spark, capacity):
    texts = odd_texts(120 if capacity > 1 else 6, capacity)
    if capacity == 1:
        texts = texts[:9]
    # classes whose length does not divide a small capacity leave more room
    check_packing(texts, packed(spark, texts, capacity), capacity, 0.01 if capacity > 64 else 0.05)


def test_packing_corner_cases(spark):
    assert packed(spark, []) == []
    check_packing([(1, None)], packed(spark, [(1, None)]), 2048, 0)
    same = [(i, "equal text of nine words in all of these") for i in range(3000)]
    check_packing(same, packed(spark, same, parts=7), 2048, 0.01)
    with pytest.raises(ValueError):
        packed(spark, [(1, "a")], capacity=1000)


def test_cuts_take_reciprocals_of_the_capacity():
    for total in [*range(1, 600), 2047, 2048, 2049, 4095, 100_001]:
        doc, start, size = packing.cuts(np.array([total]))
        assert size.sum() == total and (start == np.cumsum(size) - size).all()
        assert all(s == 2048 // (2048 // s) or 2048 // s > 2048 // (s + 1) for s in size.tolist())
    doc, start, size = packing.cuts(np.array([1000, 1]))
    assert doc.tolist() == [0, 0, 0, 0, 1] and size.tolist() == [682, 292, 25, 1, 1]


TURNS = "conv_id long, turn long, role string, text string, depth string, n_convs int"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()[:32]
            convs[c].append((t is not None, t or 0, digest, r, x))
    convs = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    new = {c: convs.get(c - int(math.fmod(c, 20)), [])[:zlib.crc32(str(c).encode()) % 4] + v[zlib.crc32(str(c).encode()) % 4:] for c, v in convs.items()}
    members, kids = defaultdict(list), defaultdict(int)
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
            leaves[k[:d]] += not kids[k]
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(new[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def trie(spark, rows):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], TURNS).repartition(3)
    return sorted(map(tuple, prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.sequences(df))).collect()))


@pytest.mark.parametrize("size", [1 << 19, 1 << 9, 64])
def test_trie_over_ranges_of_any_size(spark, monkeypatch, size):
    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", size)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    rng = random.Random(size)
    rows = []
    for c in [*range(0, 90), *range(200, 260, 7)]:
        turns = [(rng.choice(["user", "assistant"]), rng.choice(["a b", "a\tb c", "word", ""])) for _ in range(rng.choice([1, 1, 2, 3, 6]))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(c, t, "user", "the common one") for c in range(400, 480) for t in range(3)]  # one conversation many times
    rows += [(500, None, "user", "first"), (500, 2, None, "x y"), (500, 2, "user", None), (500, 2, "user", None), (501, 1, "only", "one turn"), (None, 1, "user", "lost"), (-21, 1, "u", "v")]
    rows += [(520, t, "user", f"long {t}") for t in range(300)] + [(521, t, "user", f"long {t}") for t in range(290)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_corner_cases(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "a", "b")]) == []
    for rows in ([(7, 0, None, None)], [(c, 0, "u", "x") for c in (20, 21, 22, 23)], [(c, 0, "u", "w " * 50_000) for c in range(20, 30)]):
        assert trie(spark, rows) == brute_trie(rows)


def test_radix_tree_grows_and_compresses():
    rng = random.Random(3)
    for fan in (3, 5, 17, 49, 256):
        keys = {bytes([a]) + bytes(10) + bytes([b]) + bytes(4) for a in rng.sample(range(256), fan) for b in rng.sample(range(256), 4)} | {bytes([7]), b""}
        tree = prefix_trie.RadixTree()
        order = sorted(keys)
        rng.shuffle(order)
        for entry, key in enumerate(order):
            tree.insert(key, entry)
        found, stack = {}, [(tree.root, b"")]
        while stack:
            node, above = stack.pop()
            own = above + node.path
            if node.entry >= 0:
                found[own] = node.entry
            kids = node.children()
            assert len(kids) <= node.size and (node.entry >= 0 or len(kids) > 1)
            for b in range(256):
                if (kid := node.child(b)) is not None:
                    stack.append((kid, own + bytes([b])))
        assert found == {k: e for e, k in enumerate(order)}
        assert tree.root.size == next(s for s in (4, 16, 48, 256) if len(tree.root.children()) <= s)


def test_queries_have_the_columns_of_their_contract(spark):
    folder = "/root/testdata/sf0.001"
    wanted = {
        "op11_whitening": "vec_id component n deviation whitened explained identity_error deviation_exact", "op12_harmonic_packing":
        "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op13_prefix_trie":
        "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"}
    for name, columns in wanted.items():
        df = queries.__dict__[name.split("_")[0]](spark, folder)
        types = dict(df.dtypes)
        assert set(df.columns) == set(columns.split())
        assert all(types[c] == "bigint" for c in df.columns if c in {"n", "deviation", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "depth", "n_convs"})
