"""Vector searches, the Jaccard join and substring dedup against brute force; the pipeline's stages one by one."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import cross_polytope, forest_join, grams, line_dedup, segment_search, substring_dedup, vectors

VECTORS = "vec_id long, embedding array<float>, rank int, score int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1) for i, v in rows], VECTORS)


def odd_vectors(n=90, width=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(n)]
    rows[7] = (7, rows[10][1])  # ties
    rows += [(200, None), (201, [None] + [1.0] * 11), (202, [float("nan")] * 12), (203, [float("inf")] * 12), (204, [0.0] * 12), (205, []), (206, [1.0] * 5), (None, [1.0] * 12)]
    return rows + [(3, rows[3][1])] * 2  # repeated rows


def usable(rows, zero=True):
    out = {i: v for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))}
    width = max([0, *map(len, out.values())])
    return {i: v + [0.0] * (width - len(v)) for i, v in out.items()}


def brute_products(rows, step, k=5):
    have = {i: [math.floor(256 * x) for x in v] for i, v in usable(rows).items()}
    have = {i: [q if x != 0 else 0 for q, x in zip(v, usable(rows)[i])] for i, v in have.items()}
    out = []
    for q in (i for i in have if i % step == 0):
        best = sorted((-sum(a * b for a, b in zip(have[q], v)), i) for i, v in have.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_segment_search_is_exact(spark, monkeypatch):
    for size in (8192, 16):
        monkeypatch.setattr(vectors, "CELL_ROWS", size)
        monkeypatch.setattr(vectors, "CELL_QUERIES", size)
        rows = odd_vectors()
        found = segment_search.top_k(vectors_of(spark, rows), F.col("__id") % 5 == 0).collect()
        assert sorted(map(tuple, found)) == brute_products(rows, 5)
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0])]
    assert sorted(map(tuple, segment_search.top_k(vectors_of(spark, few), F.col("__id") % 5 == 0).collect())) == brute_products(few, 5)
    assert segment_search.top_k(vectors_of(spark, []), F.col("__id") % 5 == 0).count() == 0


def test_segment_bounds_hold_and_large_components_are_exact():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(60, 30)) * 256)
    for n in segment_search.LEVELS:
        s = segment_search.statistics(x, n)
        assert (s @ s.T >= x @ x.T - 1e-6).all()
    big = np.array([[1e30, -2.5], [3e30, 1.0], [1.0, 2.0]])
    own = [[math.floor(256 * v) if abs(v) < 1e15 else int(v) * 256 for v in r] for r in big.tolist()]
    ids = np.arange(3)
    found = segment_search.best_of(ids, segment_search.integers(big, 256), ids, segment_search.integers(big, 256), 2)
    exact = [(q, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q in range(3) for s, i in sorted(((sum(a * b for a, b in zip(own[q], own[i])), i) for i in range(3) if i != q), key=lambda t: (-t[0], t[1]))]
    assert found == exact


def brute_neighbours(rows, step, k=10):
    have = usable(rows, zero=False)
    out = {}
    for q in (i for i in have if i % step == 0):
        out[q] = sorted((math.dist(have[q], v), i) for i, v in have.items() if i != q)[:k]
    return out


def test_cross_polytope_recall_and_distances(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    wanted = brute_neighbours(rows, 100)
    got = defaultdict(list)
    for r in cross_polytope.neighbours(df, F.col("__id") % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    have = dict(rows)
    hits = 0
    for q, best in wanted.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda x: (x[2], x[1]))
        assert all(math.isclose(d, math.dist(have[q], have[i]), rel_tol=1e-12) for _, i, d in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
    assert hits / (10 * len(wanted)) >= 0.9


def test_cross_polytope_corner_cases(spark, monkeypatch):
    rows = odd_vectors(40)
    for size in (8192, 4):  # also with crowded buckets that are split
        monkeypatch.setattr(cross_polytope, "CELL_ROWS", size)
        found = cross_polytope.neighbours(vectors_of(spark, rows), F.col("__id") % 5 == 0, k=10, recall=1.0).collect()
        wanted = brute_neighbours(rows, 5)
        assert {r["query_id"] for r in found} == set(wanted) and len(found) == 10 * len(wanted)
        assert sum((r["vec_id"] in {i for _, i in wanted[r["query_id"]]}) for r in found) >= 0.95 * len(found)
    few = [(i, [1.0 + i, 2.0]) for i in range(0, 15, 5)]
    assert len(cross_polytope.neighbours(vectors_of(spark, few), F.col("__id") % 5 == 0).collect()) == 6
    assert cross_polytope.neighbours(vectors_of(spark, []), F.col("__id") % 5 == 0).count() == 0


def test_hadamard_keeps_lengths_and_own_bucket_comes_first():
    x = np.random.default_rng(0).normal(size=(20, 8))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    index = cross_polytope.make_index(5, 10**9)
    u = cross_polytope.unit(x[:, :5], index.width)
    assert index.signs.shape[1] > 1 and (cross_polytope.probed(index, u, 6)[:, :, 0] == cross_polytope.probed(index, u, 1)[:, :, 0]).all()


# the Jaccard join

def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def shingles(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_links(rows):
    sets = [shingles(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(low.get(top(i), d), d)
    return sorted(((d, low.get(top(i)) if d is not None else None, n) for i, ((d, _), n) in enumerate(zip(rows, links))), key=str)


def near_rows(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    base = [word() for _ in range(120)]
    rows = [(100 + i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(40)]
    for i in range(60):  # a crowd of near copies, each with a few words changed
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(120)] = word()
        rows.append((300 + i, rng.choice([" ", "\n"]).join(own)))
    rows += [(i, "same words here for  all") for i in range(5)] + [(10, None), (11, ""), (12, " \n"), (13, "one"), (14, "one"), (15, "one two"), (16, "x " * 9000), (17, "x " * 8000)]
    rows += [(18, rows[3][1]), (18, rows[3][1]), (None, rows[3][1]), (None, None), (19, "\x85\xa0  a b c d e f")]
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(forest_join, "BLOCK_TEXTS", block)
    monkeypatch.setattr(forest_join, "STEP", 64)
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, class_id string, count string")
    found = forest_join.similar(df).collect()
    assert sorted(map(tuple, found), key=str) == brute_links(rows)


def test_jaccard_join_of_nothing(spark):
    assert forest_join.similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_similarities_of_small_sets():
    for n in range(1, 40):
        brute = min(both / union for both in range(1, n + 1) for union in range(n, 3 * n) if both / union >= 0.8)
        assert forest_join.least_similarity(n, 0.8) == pytest.approx(brute)


def test_prefixes_of_texts_shorten_until_their_own_recall():
    """Minima of the hash space that are low, usual and high for 100 shingles end at different depths."""
    rng = np.random.default_rng(3)
    usual = rng.exponential(0.01, (400, forest_join.TREES, forest_join.DEPTH))
    minima = np.concatenate((np.full_like(usual[:1], 1e-6), usual, np.full_like(usual[:1], 0.03)))
    sizes = np.full(len(minima), 100)
    depth = forest_join.depths(minima, sizes, 0.8, forest_join.TARGET_RECALL)
    found = forest_join.recalls(minima, sizes, 0.8)
    assert depth[0] == 5 and depth[-1] < depth[0] and {4, 5} <= set(depth[1:-1].tolist())
    assert all(found[i, d - 1] >= forest_join.TARGET_RECALL for i, d in enumerate(depth) if d > 1)
    assert all(found[i, d] < forest_join.TARGET_RECALL for i, d in enumerate(depth) if d < forest_join.DEPTH)
    assert forest_join.depths(minima[:1], np.array([6]), 0.8, forest_join.TARGET_RECALL)[0] == 6
    # a part of the text agrees with the similarity itself, whatever the minima are
    assert found[0, 4] == pytest.approx(1 - (1 - 0.8**5) ** forest_join.TREES)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_branches_of_sorted_signatures_are_all_shared_prefixes(size):
    """Every prefix that texts share at a level of theirs is a branch of each, however the sorted rows are cut into batches."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted((int(rng.integers(2)), bytes(rng.integers(0, 2, 8, dtype=np.uint8)), n, int(rng.integers(2, 5))) for n in range(300))
    batches = [pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in part], pa.int32()), pa.array([r[3] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary()),
        pa.array([r[2] for r in part], pa.int64())], ["t", "d", "s", "n"]) for part in (rows[k:k + size] for k in range(0, len(rows), size))]
    members, looks = {}, set()
    for out in forest_join.branches(iter(batches), 2):
        for r in out.to_pylist():
            members.setdefault((r["__trie"], r["__prefix"]), set()).add(r["__node"])
            looks |= {(r["__trie"], r["__node"])} if r["__looks"] else set()
    brute = {}
    for tree, sig, node, depth in rows:
        for level in range(2, depth + 1):
            brute.setdefault((tree * 16 + level, sig[:2 * level]), set()).add(node)
    assert sorted(sorted(m) for m in members.values() if len(m) > 1) == sorted(sorted(m) for m in brute.values() if len(m) > 1)
    assert looks <= {(tree * 16 + depth, node) for tree, _, node, depth in rows}
    names = {node: (tree * 16 + depth, sig[:2 * depth]) for tree, sig, node, depth in rows}
    assert all((names[n][0], n) in looks for n in names if len(brute[names[n]]) > 1)


def test_whole_groups_across_batches():
    import pyarrow as pa
    table = pa.table({"k": [1, 1, 2, 2, 2, 3, 4, 4], "v": list(range(8))})
    for size in (1, 2, 3, 8):
        groups = list(grams.whole_groups(iter(table.to_batches(max_chunksize=size)), 1))
        assert [v for g in groups for v in g["v"].to_pylist()] == list(range(8))
        assert all(not set(a["k"].to_pylist()) & set(b["k"].to_pylist()) for a, b in zip(groups, groups[1:]))


def test_components_of_a_long_path(spark):
    from shelfmark.llm.components import components
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 99), (100, 101), (7, 7)]
    got = {r["__node"]: r["__label"] for r in components(spark.createDataFrame(edges, "__a long, __b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {99: 99, 100: 99, 101: 99}
    assert components(spark.createDataFrame([], "__a long, __b long")).count() == 0


# substring dedup

def brute_trim(rows, width):
    least = {}
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - width + 1) if d is not None else []:
            k = tuple(w[i:i + width])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - width + 1) if d is not None else []:
            if least[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,size", [(10, 1 << 22), (10, 900), (7, 5000)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, width, size):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", size)
    rng = random.Random(width)
    some = lambda n: [rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(n)]
    passages = [some(n) for n in (width, width + 3, 3 * width, 25)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += some(rng.randint(0, 30)) + (rng.choice(passages) if rng.random() < 0.7 else [])
        rows.append((i * 3 + 2, rng.choice([" ", "\n ", "\t"]).join(w)))
    rows += [(1, " ".join(passages[2])), (500, None), (501, ""), (502, "é \x85" * 30), (0, "x " * 400), (503, "x " * 300)]
    rows += [(504, " ".join(passages[2] + some(40))), (504, " ".join(some(20) + passages[3])), (504, rows[5][1]), (None, rows[5][1]), (None, None), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n_words string, n_removed int")
    found = substring_dedup.dedup_substrings(df, width=width).collect()
    assert sorted(map(tuple, found), key=str) == brute_trim(rows, width)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_entries_survive_packing():
    rng = np.random.default_rng(0)
    for kind in (np.uint8, np.uint32, np.uint64):
        ids = np.sort(rng.choice([-(1 << 62), -5, 0, 3, 1 << 62], 200))
        places = rng.integers(0, 1 << 31, 200)
        order = np.lexsort((places, ids))
        values = rng.integers(0, 255, 200).astype(kind)
        back = substring_dedup.unpack(substring_dedup.pack(ids, places[order], values))
        assert all((a == b).all() for a, b in zip(back, (ids, places[order], values)))
    assert all(len(x) == 0 for x in substring_dedup.unpack(substring_dedup.pack(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))))


# the pipeline

def test_pipeline_stages_on_a_fixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9000, None, "en", "src1", None), (9001, "123 ...", None, None, 7), (9002, docs.first()["text"], None, None, 1), (9002, docs.first()["text"], None, None, 1)], DOCS)
    docs = docs.union(odd).withColumn("host", F.lit("x")).cache()
    (_, by_language), (_, lines), (_, near), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    kept = by_language(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()} == {9000, 9001}
    cut = lines(spark, docs, "")
    texts = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert texts == {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()} and cut.columns == corpus_pipeline.COLUMNS
    assert all(r["n_chars"] == len(r["text"]) for r in cut.where("text is not null and doc_id < 9000").collect())
    left = near(spark, docs, "")
    wanted = [(d, c) for d, c, _ in brute_links([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect()])]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, c in wanted if d == c) and left.columns == corpus_pipeline.COLUMNS
    order = mix(spark, docs, "")
    assert sorted(map(str, order.collect())) == sorted(map(str, docs.select(*corpus_pipeline.COLUMNS).collect()))
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in tokens(spark, docs, "").collect())


def test_pipeline_runs_through(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert n * 0.7 < len(rows) < n and all(r["round_trip"] for r in rows)


def test_pipeline_near_copies_with_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long), (7, long + " more"), (7, "a text of its own that no other row holds"), (None, long + " less"), (8, "eight is like null here as well"),
            (None, "eight is like null here as well"), (None, "only rows without an id hold this"), (None, "only rows without an id hold this"), (None, "and this stands once"), (9, None), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    left = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()), key=str)
    assert left == sorted([rows[0], rows[2], rows[4], rows[6], rows[8], rows[9]], key=str)


def test_pipeline_rejects_texts_in_no_language_and_names_the_unlabelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    clean = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rng = np.random.default_rng(5)
    signs = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"), 900))
    alien = [(900001, "\u0412\u0441\u0435 \u043b\u044e\u0434\u0438 \u0440\u043e\u0436\u0434\u0430\u044e\u0442\u0441\u044f " * 20, None, "x", 1), (900002, signs, None, "x", 1), (900003, None, "en", "x", 1), (900004, "12 34", "en", "x", 1)]
    bare = docs.where("doc_id % 10 = 3").withColumn("lang", F.lit(None).cast("string"))
    given = docs.where("doc_id % 10 <> 3").union(bare).unionByName(spark.createDataFrame(alien, docs.schema))
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.by_language(spark, given, "").collect()}
    assert kept.keys() == clean.keys()
    assert all(kept[i] == lang for i, lang in clean.items() if i % 10 != 3)
    assert np.mean([kept[i] == lang for i, lang in clean.items() if i % 10 == 3]) > 0.95


def test_pipeline_without_labels_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 10), (2, "12 34", None, "a", 5), (3, None, None, "a", None), (None, "no id", None, None, 5)], DOCS)
    assert sorted(r["text"] for r in corpus_pipeline.by_language(spark, docs, "").collect()) == ["no id", "some words"]


def test_pipeline_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_words_that_polynomials_take_for_equal_are_told_apart(spark):
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one] * 60), None, None, 0), (2, " ".join([other] * 60), None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, forest_join.similar(df).collect())) == [(1, 1, 0), (2, 2, 0)]
    assert all(r["n_removed"] == 0 for r in substring_dedup.dedup_substrings(df).collect())


def test_texts_of_the_same_words_in_another_order_are_not_copies():
    words = [["x", "y"][bin(i).count("1") & 1] for i in range(2048)]
    texts = [" ".join(words), " ".join("y" if w == "x" else "x" for w in words)]
    found = grams.words_of(grams.pa.array(texts))
    assert all(half[0] != half[1] for half in grams.whole(found))
