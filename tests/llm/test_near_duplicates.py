import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glasspane.llm import embedding_dedup, simhash
from glasspane.llm.components import components


def labels(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(50, 50 + i) for i in range(1, 20)] + [(80, 81), (81, 82), (82, 80), (90, 90)]
    rng.shuffle(pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in pairs], "a long, b long")).collect()}
    want = labels(100, pairs)
    assert got == {n: want[n] for n in {x for a, b in pairs for x in (a, b) if a != b}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_with_odd_texts(spark):
    texts = ["", None, "one", "Two Words", "a b\x0bc", "É É É x", "same same same same", "w " * 5000, "A b C d E"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(rows).collect()}
    assert got == {i: f"{plain_fingerprint(t or ''):016x}" for i, t in enumerate(texts)}
    spark_hash = rows.where("doc_id = 2").select(F.xxhash64("text")).first()[0]
    assert spark_hash % (1 << 64) == xxhash.xxh64_intdigest(b"one", 42)


@pytest.mark.parametrize("group", [1024, 2])
def test_links_against_all_pairs(spark, group):
    rng = random.Random(group)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    got = {r.node: r.component for r in components(simhash.links(rows, group)).collect()}
    want = labels(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_documents_with_copies_nulls_and_repeated_rows(spark):
    rows = [(5, "the same words in a row here", 1), (3, "The same words in a row here", 2), (9, None, 3), (7, "", 4), (None, "the same words in a row here", 5), (3, "The same words in a row here", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 3), (3, 3), (3, 3), (5, 3), (7, 7), (9, 7)]
    kept = simhash.stage_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 7]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    twins = [(1, "first text of this id"), (1, "another text of this id"), (2, "alone")]
    stays = lambda rows: sorted(map(tuple, simhash.stage_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()))
    assert stays(twins) == stays(twins[::-1]) and [r[0] for r in stays(twins)] == [1, 2]


def brute(vectors, label):
    x = np.array([v if v is not None else [np.nan] * 8 for v in vectors], dtype=float)
    norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0) & np.array([v is not None for v in label])
    with np.errstate(all="ignore"):
        cosine = (x @ x.T) / norm[:, None] / norm[None, :]
    return [(i, j) for i in range(len(x)) for j in range(i) if ok[i] and ok[j] and label[i] == label[j] and cosine[i, j] >= 0.93]


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((25, 8))
    vectors = [list(map(float, (centres[i % 25] + rng.standard_normal(8) * rng.choice([0, 0.05, 0.25])).astype(np.float32))) for i in range(300)]
    label = [int(i % 3) for i in range(300)]
    vectors[10], vectors[11], vectors[12], label[13] = None, [0.0] * 8, [float("nan")] + [1.0] * 7, None
    vectors[20] = vectors[25] = vectors[30] = vectors[95]
    label[20] = label[25] = label[30] = label[95]
    rows = spark.createDataFrame([(i, v, c, "x") for i, (v, c) in enumerate(zip(vectors, label, strict=True))], "vec_id long, embedding array<float>, label int, node string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(rows, block=block).collect()}
    pairs = brute(vectors, label)
    want = labels(300, pairs)
    degree = [sum(i in p for p in pairs) for i in range(300)]
    found = sum(got[i].n_links for i in range(300))
    assert found >= 0.99 * sum(degree) and found <= sum(degree)
    assert [got[i].component_id for i in range(300)] == want
    assert [got[i].n_links for i in (10, 11, 12, 13)] == [0] * 4
    assert all(got[i].kept == (want[i] == i) for i in range(300))


def test_vectors_that_are_empty_or_odd(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    near = [(1, [1.0, 0.0], 0), (2, [0.93, (1 - 0.93**2) ** 0.5 * (1 - 1e-12)], 0), (3, [0.93, (1 - 0.93**2) ** 0.5 * (1 + 1e-12)], 0), (4, [0.0, -1.0], 0)]
    doubles = spark.createDataFrame(near, "vec_id long, embedding array<double>, label int")  # as floats, 2 and 3 would be one vector
    assert sorted(map(tuple, embedding_dedup.near_duplicates(doubles).select("vec_id", "n_links").collect())) == [(1, 1), (2, 2), (3, 1), (4, 0)]
    odd = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, [1.0, 2.0, 3.0], 0), (4, [2.0, 4.0], 0), (5, [], 0), (None, [1.0, 2.0], 0), (6, [1.0, None], 0)], kind)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(odd).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 4: (2, 1), 3: (0, 3), 5: (0, 5), 6: (0, 6), None: (None, None)}


@pytest.mark.parametrize(("paired", "piece"), [(32, 1 << 20), (2, 1 << 9)])
def test_stage_links_edited_copies_like_brute_force(spark, monkeypatch, paired, piece):
    """Copies with words replaced, at 0.8 to 0.95 and below, against all pairs of exact similarities."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4, 5, 8):
            new = list(base)
            for at in rng.sample(range(200), edits):
                new[at] = word()
            texts.append(" ".join(new))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    found = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(sets)) for j in range(i)}
    near = [p for p, x in found.items() if x >= 0.8]
    assert sum(0.8 <= found[p] <= 0.95 for p in near) > 100
    want = labels(len(texts), near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in simhash.stage_near_duplicates(spark, docs, "").collect()) == sorted(set(want))


def test_bands_of_similar_sets_meet():
    """Share of pairs at 0.8 that share a band: measured, not assumed."""
    rng = np.random.default_rng(12)
    met = 0
    for _ in range(1000):
        x = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        a, b = x[:160].copy(), x[:180].copy()
        a = np.concatenate([a, rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) == 0.8
        met += bool((simhash.band_keys(a) == simhash.band_keys(b)).any())
    assert met >= 999
