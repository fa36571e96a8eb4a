import random

import numpy as np
import pyarrow as pa

from quern.llm import minhash
from quern.llm.components import components
from quern.llm.hashing import gram_hashes, word_hashes


def words_of(text):
    return (text or "").encode().split()


def test_word_hashes_split_at_ascii_spaces():
    texts = ["a b\n\ncd", None, "", " x y  ", "\t", "b", "a b cd" * 3, "a"]
    got = [h for w in word_hashes(pa.array(texts)) for h in np.split(w.hashes, w.ends[:-1])]
    assert [len(h) for h in got] == [len(words_of(t)) for t in texts]
    by_word = {}
    for t, h in zip(texts, got, strict=True):
        for w, x in zip(words_of(t), h.tolist(), strict=True):
            assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    sliced = pa.array(["zz", *texts])[1:]
    again = [h.tolist() for w in word_hashes(sliced) for h in np.split(w.hashes, w.ends[:-1])]
    assert again == [h.tolist() for h in got]


def test_folding_and_grams():
    low, high, mixed = (next(word_hashes(pa.array([t]), fold=True)).hashes for t in ("été abc d", "été ABC D", "Été abc d"))
    assert (low == high).all() and low[0] != high[0] or low.tolist() == high.tolist()
    assert next(word_hashes(pa.array(["É"]), fold=True)).hashes[0] != next(word_hashes(pa.array(["é"]), fold=True)).hashes[0]
    assert len(mixed) == 3
    assert gram_hashes(low, 2)[0] != gram_hashes(low[::-1], 2)[0]


def brute(rows, shingle, percent):
    fold = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    sets = []
    for _, text in rows:
        w = [fold(x) for x in words_of(text)]
        n = min(shingle, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {rows[i][0]: (len(sets[i]), min(groups[find(i)])) for i in range(len(rows))}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, ids = [(7, None), (3, ""), (900, "  "), (11, "One"), (12, "one"), (13, "one two")], iter(range(20, 900))
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([20, 80, 200]))]
        for _ in range(rnd.randint(1, 12)):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((next(ids), " ".join(copy).upper() if rnd.random() < 0.2 else "\n".join(copy)))
            base = copy if rnd.random() < 0.4 else base  # chains as well as stars
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, row int, key string")
    for shingle, percent in ((3, 85), (5, 80)):
        want = brute(rows, shingle, percent)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle, percent).collect()}
        assert len(got) == len(rows)
        for d, (n, c) in want.items():
            assert got[d] == (n, c, d == c)


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "x y"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert len(got) == 6
    assert sum(r.kept for r in got if r.n_shingles == 2) == 1
    assert {r.component_id for r in got if r.n_shingles == 2} == {1}


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(c == (0 if n <= 40 else 100) for n, c in got.items()) and len(got) == 71


def test_estimate_is_near_the_similarity(spark):
    rnd = np.random.default_rng(3)
    n = 180
    for share in (0.5, 0.85):
        common, own = rnd.integers(0, 2**63, 1000, np.uint64), rnd.integers(0, 2**63, 2000, np.uint64)
        k = int(1000 * (1 / share - 1) / 2)
        a, b = (np.concatenate([common, own[:k]]), np.concatenate([common, own[k : 2 * k]]))
        sigs = [minhash.packed_bits(minhash.minima(x, n)).tolist() for x in (a, b)]
        row = spark.createDataFrame([tuple(sigs)], "a array<long>, b array<long>")
        got = row.select(minhash.estimate(minhash.F.col("a"), minhash.F.col("b"), n)).first()[0]
        assert abs(got - share) < 0.15
