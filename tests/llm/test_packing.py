import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpusloom.llm import bin_plan, packing

DOCS = "doc_id long, text string, length string, uid string"


def expected_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.fixture(scope="module")
def rows():
    words = ["alpha", "beta<|endoftext|>", "don't", "Ünï", "日本", "x\x1cy", "a\x0bb", "\t\n", "9" * 80]
    out = [(1, None), (2, ""), (3, "  "), (4, " ".join(words * 900)), (5, "same text"), (6, "same text"), (7, "same text"), (7, "same text"), (None, "no id")]
    rnd = random.Random(1)
    return [(i, t, "clash", "clash") for i, t in out] + [(100 + i, " ".join(rnd.choices(words, k=rnd.randint(1, 400))), "clash", "clash") for i in range(60)]


@pytest.mark.parametrize("per_bucket", [4096, 2])
def test_pack_documents(spark, rows, per_bucket, monkeypatch):
    monkeypatch.setattr(packing.ranked, "__defaults__", (per_bucket,))
    got = [r.asDict() for r in packing.pack_documents(spark.createDataFrame(rows, DOCS), capacity=128).collect()]
    want = Counter()
    for i, t, *_ in rows:
        ids = expected_ids(t)
        for piece, at in enumerate(range(0, len(ids), 128)):
            part = np.array(ids[at : at + 128], dtype="<u4")
            want[(i, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(by) <= -(-sum(r["length"] for r in got) // 128) * 1.05 + 1


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_keeps_every_item():
    rnd = random.Random(2)
    for _ in range(80):
        h = Counter({rnd.randint(1, 100): rnd.randint(1, 60) for _ in range(rnd.randint(1, 50))})
        for share, groups in ((0.25, 5), (0.5, 48), (0.125, 8)):
            seen = Counter()
            for count, content in bin_plan.plan(h, 100, share, groups).classes():
                assert sum(n * k for n, k in content.items()) <= 100
                for n, k in content.items():
                    seen[n] += k * count
            assert +seen == +h


def test_plan_is_close_to_the_least():
    rnd = random.Random(3)
    h = Counter(min(4096, int(rnd.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    bins = sum(c for c, _ in bin_plan.best_plan(h, 4096))
    assert bins <= -(-sum(n * c for n, c in h.items()) // 4096) * 1.002 + 1
