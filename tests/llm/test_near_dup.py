import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from corpusloom.llm import near_dup
from corpusloom.llm.codepoints import mix

DOCS = "doc_id long, text string, uid string, id string, digest string, keys string"


def shingles(text):
    """The units of weight of each shingle: one, and one more for each doubling of its count."""
    w = (text or "").lower().split()
    times = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter({tuple(w)} - {()})
    return {(x, unit) for x, n in times.items() for unit in range(n.bit_length())}


def brute(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(r[1]) for r in rows]
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= 0.8 * len(a | b):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def corpus(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6)))
    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(30, 200))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, 4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(150)]
    for _ in range(25):  # each like the one before, the ends unlike each other
        chain = list(chain)
        chain[rnd.randrange(150)] = word()
        texts.append(" ".join(chain))
    base = [word() for _ in range(120)]
    for _ in range(60):  # a crowd whose pairs lie on either side of the threshold
        copy = list(base)
        for _ in range(rnd.randint(1, 4)):
            copy[rnd.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    base, again = [word() for _ in range(40)], [word() for _ in range(8)]
    texts += [" ".join(base + again * n) for n in (2, 3, 5, 9, 17, 33, 65)]  # equal sets of shingles, unlike counts
    texts += ["", None, " ", "one two", "one two", "One two", "a b c d", "x " * 3000, "x " * 3000, "x\n" * 2999]
    rnd.shuffle(texts)
    return [(i, t, "z", "z", "z", "z") for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, block", [(1, near_dup.BLOCK), (2, 3000)])
def test_classes_are_the_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dup.links, "__defaults__", (near_dup.SIMILARITY, block))
    rows = corpus(seed)
    got = near_dup.classes(spark.createDataFrame(rows, DOCS)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.id: r.class_id for r in got} == dict(enumerate(want))
    assert all(r.kept == (r.id == r.class_id) and r.class_size == want.count(r.class_id) for r in got)
    kept = near_dup.drop_near(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "uid", "id", "digest", "keys"]
    assert {r.doc_id for r in kept.collect()} == set(want)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g", "", "", "", "")] * 3 + [(None, "a b c d e f g", "", "", "", ""), (2, "q r s t u v", "", "", "", "")]
    got = near_dup.classes(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.id or 0, r.class_id, r.class_size) for r in got) == [(0, 1, 4), (1, 1, 4), (1, 1, 4), (1, 1, 4), (2, 2, 1)]
    assert sum(r.kept for r in got) == 2
    assert near_dup.classes(spark.createDataFrame([], DOCS)).count() == 0
    kept = near_dup.drop_near(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert near_dup.drop_near(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e f g", True, 3, 4)], "doc_id long, text string, kept boolean, i int, row int")
    assert near_dup.drop_near(clash).collect() == clash.collect()


def test_candidates_lose_no_pair():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 2**32, 60, dtype=np.uint32)
    sets = [np.unique(np.concatenate([rnd.permutation(base)[: rnd.integers(20, 61)], rnd.integers(0, 2**32, rnd.integers(0, 25), dtype=np.uint32)])) for _ in range(150)]
    ask = rnd.random(150) < 0.5
    for t in (0.5, 0.8, 1.0):
        found = {n: set(near.tolist()) for n, near in near_dup.candidates(sets, ask, t)}
        for n in np.flatnonzero(ask):
            want = {j for j in np.flatnonzero(~ask) if len(np.intersect1d(sets[n], sets[j])) >= t * len(np.union1d(sets[n], sets[j]))}
            assert want <= found[n]
    unlike = [np.concatenate([base, rnd.integers(0, 2**32, 40, dtype=np.uint32)]) for _ in range(100)]
    assert all(not len(near) for _, near in near_dup.candidates(unlike, np.arange(100) < 50, 0.8))


def test_signatures_estimate_weighted_similarity():
    rnd = np.random.default_rng(3)
    element = mix(np.arange(1, 61, dtype=np.uint64))
    for _ in range(3):
        a, b = rnd.uniform(0.05, 5, 60), rnd.uniform(0.05, 5, 60)
        sig = near_dup.dart_minhash([element, element], [a, b], k=4000)
        assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    sets = [mix(np.arange(1, n, dtype=np.uint64)) for n in (2, 3, 50, 4000)]
    sig = near_dup.dart_minhash(sets, k=160)
    assert (sig != 0).all() and len(set(sig[0].tolist())) == 160
    assert abs((near_dup.dart_minhash([sets[2], sets[2][:25]], k=4000)[0] == near_dup.dart_minhash([sets[2][:25]], k=4000)[0]).mean() - 25 / 49) < 0.03


@pytest.mark.parametrize("alike", ["an earlier band", "no other band"])
def test_links_do_not_rest_on_short_signatures(spark, alike):
    """Rows 1 and 2 share the bucket of one unlike row only; the 8 low bits of their signatures mislead."""
    keys = [[100 * uid + band for band in range(near_dup.BANDS)] for uid in range(3)]
    for k in keys:
        k[3] = 7
    low = [bytearray([uid] * 160) for uid in range(3)]
    for row in low:
        row[15:20] = bytes(5)
    if alike == "an earlier band":
        low[2] = low[1]
    shingles = [list(range(9000, 9050)), list(range(1, 51)), list(range(3, 53))]
    rows = [(uid, uid, bytearray([uid]), keys[uid], shingles[uid], low[uid]) for uid in range(3)]
    signed = spark.createDataFrame(rows, "uid long, id long, digest binary, keys array<bigint>, shingles array<int>, low binary")
    assert {(r.a, r.b) for r in near_dup.links(signed).collect()} == {(2, 1)}


def test_bands_follow_the_similarity(spark):
    assert near_dup.banding(0.8) == near_dup.banding(0.95) == (near_dup.BANDS, near_dup.ROWS)
    for s in (0.05, 0.2, 0.35, 0.5, 0.65, 0.79, 0.8):
        bands, rows = near_dup.banding(s)
        assert (1 - s**rows) ** bands <= 3.1e-6
    for s in (0, -1, 1.1):
        with pytest.raises(ValueError):
            near_dup.banding(s)
    rnd = random.Random(8)
    rows = []
    for i in range(60):  # pairs of a similarity of 0.5
        words = [f"w{rnd.random()}" for _ in range(120)]
        rows += [(2 * i, " ".join(words[:91]), "", "", "", ""), (2 * i + 1, " ".join(words[29:]), "", "", "", "")]
    got = near_dup.classes(spark.createDataFrame(rows, DOCS), similarity=0.5).collect()
    assert {r.id: r.class_id for r in got} == {i: i // 2 * 2 for i in range(120)}
