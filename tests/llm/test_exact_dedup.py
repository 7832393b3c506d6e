import random
import re

from corpusloom.llm import exact_dedup
from corpusloom.llm.cuckoo import CuckooIndex

DOCS = "doc_id long, text string, digest string, kept string, uid string"


def brute(rows):
    groups = {}
    for n, (i, t, *_) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, n))
    return {min(g)[3]: len(g) for g in groups.values()}


def test_groups(spark):
    texts = ["a b", "ab", "a\tb\n", None, "", "  ", "x", "é y", "éy", "long " * 5000]
    rnd = random.Random(4)
    rows = [(i, rnd.choice(texts), "z", "z", "z") for i in range(200)] + [(7, "ab", "z", "z", "z"), (7, "ab", "z", "z", "z"), (None, "ab", "z", "z", "z")]
    got = exact_dedup.groups(spark.createDataFrame(rows, DOCS).coalesce(1)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert sorted((r.keep_id, r.group_size) for r in got if r.kept) == sorted((rows[n][0], size) for n, size in want.items())
    assert all(r.kept == (r.id == r.keep_id) for r in got if r.id not in (7, None))
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "digest", "kept", "uid"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(rows[n][0] for n in want)


def test_repeated_rows_leave_one(spark):
    rows = [(1, "same", "", "", "")] * 5 + [(2, None, "", "", "")] * 3
    assert exact_dedup.drop_copies(spark.createDataFrame(rows, DOCS)).count() == 2
    assert exact_dedup.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_small_indexes_lose_nothing(spark):
    rows = [(i % 50, f"text {i % 37}", "", "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    marks = exact_dedup.digests(docs)
    whole = {tuple(r)[:3] + (r.best_id,) for r in exact_dedup.live_index(marks).collect()}
    assert len(whole) == 37 and {tuple(r)[:3] + (r.best_id,) for r in exact_dedup.live_index(marks, 3).collect()} == whole


def test_rows_equal_in_id_keep_the_longest(spark):
    rows = [(1, "a b", "", "", ""), (1, "a  b", "", "", ""), (None, "q", "", "", ""), (None, "q", "", "", "")]
    assert sorted(r.text for r in exact_dedup.drop_copies(spark.createDataFrame(rows, DOCS)).collect()) == ["a  b", "q"]


def test_cuckoo_index():
    import hashlib

    rnd, index, live = random.Random(5), CuckooIndex(2), {}
    for n in range(6000):
        d = hashlib.sha256(str(rnd.randint(0, 900)).encode()).digest()
        if d in live and rnd.random() < 0.5:
            assert index.delete(d, 1)
            del live[d]
        elif d not in live:
            index.insert(d, 1, n)
            live[d] = n
        assert index.find(d, 1) == live.get(d)
        assert index.find(d, 2) is None
    assert index.resizes > 3 and index.size == len(live)
    assert {e[0]: e[2] for e in index.entries()} == live
    assert not index.delete(b"\0" * 32, 1)
