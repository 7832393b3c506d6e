import hashlib
import random
import re

import pytest
from corpusloom.llm import substring_dedup
from corpusloom.llm.automaton import SuffixAutomaton

DOCS = "doc_id long, text string, id string, key string, runs string"


def brute(rows, window):
    seen, out = {}, {}
    for n, (i, t, *_) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            else:
                seen[key] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[n] = (i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "a"]) if rnd.random() < 0.5 else "".join(rnd.choices("abcdeé\x1c", k=4))
    passages = [[word() for _ in range(rnd.randint(15, 90))] for _ in range(12)]
    hot = [word() for _ in range(40)]
    rows = []
    for i in range(160):
        w = []
        for _ in range(rnd.randint(0, 5)):
            kind = rnd.random()
            part = rnd.choice(passages) if kind < 0.4 else hot if kind < 0.7 else [word() for _ in range(rnd.randint(1, 60))]
            a = rnd.randrange(len(part))
            w += part[a if rnd.random() < 0.5 else 0 :]
        rows.append((i * 3, rnd.choice([" ", "\n", " \t"]).join(w), "", "", ""))
    rows += [(-5, None, "", "", ""), (9999, "", "", "", ""), (10000, "the " * 400, "", "", ""), (10001, "the " * 30 + "end", "", "", "")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [64, 2])
def test_removed_words(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_SPANS", most)
    rows = corpus(most)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute(rows, substring_dedup.WINDOW)


def test_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(60)))
    rows = [(1, text, "", "", ""), (1, text, "", "", ""), (None, text, "", "", ""), (2, text, "", "", "")]
    got = sorted((r.id or 0, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(0, 60), (1, 0), (1, 0), (2, 60)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_automaton_matches_brute_force():
    rnd = random.Random(9)
    for _ in range(30):
        texts = [[rnd.randint(0, 3) for _ in range(rnd.randint(1, 25))] for _ in range(rnd.randint(1, 6))]
        known = SuffixAutomaton()
        for t in texts:
            known.add(t)
        query = [rnd.randint(0, 4) for _ in range(40)]
        factors = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
        want = [max(n for n in range(k + 2) if tuple(query[k + 1 - n : k + 1]) in factors) for k in range(40)]
        assert known.matching(query) == want
        assert len(known) <= 2 * sum(map(len, texts)) + 1


def test_settling_does_not_depend_on_batches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(6)
    rows = sorted((rnd.choice([1, 1, 1, 2, 3, 4, 5, 6]), rnd.randint(0, 9), rnd.randint(0, 30), rnd.randint(0, 3)) for _ in range(400))
    rows = [(rnd.choice([0, 1, 1, 1]), a, s, d, d, p, 1) for a, s, d, p in rows]
    monkeypatch.setattr(substring_dedup, "MOST_SPANS", 6)

    def batches(size):
        for k in range(0, len(rows), size):
            cols = list(zip(*rows[k : k + size], strict=True))
            types = [np.int32, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, t)) for c, t in zip(cols, types, strict=True)], names=["kind", *substring_dedup.COLUMNS])

    def run(size):
        return sorted(tuple(r.values()) for b in substring_dedup._settle(batches(size)) for r in b.to_pylist())

    want, first, spans = [], {}, {}
    for kind, a, s, d, i, p, n in rows:
        if kind == 0:
            want.append((0, a, s, d, i, p, n))
        elif (a, s) not in first:
            first[a, s] = (i, p)
            spans.setdefault(a, []).append((a, s, d, i, p, n))
        elif first[a, s] != (i, p):
            want.append((0, a, s, d, i, p, n))
    for group in spans.values():
        want += [(2 if len(group) > 6 else 1, *r) for r in group if len(group) > 1]
    for size in (1, 2, 3, 7, 50, 1000):
        assert run(size) == sorted(want), size


@pytest.mark.parametrize("most", [64, 2])
def test_partly_shared_passages_of_repeated_ids(spark, monkeypatch, most):
    monkeypatch.setattr(substring_dedup, "MOST_SPANS", most)
    rnd = random.Random(7)
    word = lambda n: ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(n)]
    rows = []
    for _ in range(12):
        shared = word(26)
        rows.append((3, word(9) + shared + word(9)))
        twin = shared + word(30)
        rows += [(5, twin + word(3)), (5, twin + word(4)), (None, twin + word(5)), (None, word(1) + twin + word(5)), (5, word(2) + shared + word(8))]
    windows = [{} for _ in rows]
    least = {}
    for n, (i, w) in enumerate(rows):
        for k in range(len(w) - 19):
            windows[n][k] = tuple(w[k : k + 20])
            spot = (i is None, i or 0, k)
            least[windows[n][k]] = min(least.get(windows[n][k], spot), spot)
    want = []
    for n, (i, w) in enumerate(rows):
        gone = {k + j for k, x in windows[n].items() if least[x] < (i is None, i or 0, k) for j in range(20)}
        want.append((i or 0, len(w), " ".join(x for k, x in enumerate(w) if k not in gone)))
    docs = spark.createDataFrame([(i, " ".join(w), "", "", "") for i, w in rows], DOCS).repartition(3)
    got = [(r.id or 0, r.n_words, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
