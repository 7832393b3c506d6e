import hashlib
import random
import re

from corpusloom.llm import decontaminate

DOCS = "doc_id long, text string, items string, n_words string, hash string"
BENCH = "item_id long, text string, size string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def brute(rows, bench):
    tests = {}
    for i, t, *_ in bench:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            tests.setdefault(tuple(w[k : k + n]), set()).update([] if i is None else [str(i)])
    out = []
    for i, t, *_ in rows:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in tests}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in tests:
                    hit |= set(range(k, k + n))
                    items |= tests[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    bench = [(i, " ".join(rnd.choices(["Aa", "bb", "cc9", "dé", "ee-ff"], k=n)), "") for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 25, 40])] + [(90, None, ""), (91, "!!", ""), (None, "no id but words enough to make a window of ten", "")]
    rows = []
    for i in range(80):
        w = rnd.choices(["xx", "Yy", "zé", "9"], k=rnd.randint(0, 40))
        if rnd.random() < 0.5:
            w[3:3] = (rnd.choice(bench)[1] or "").upper().split()
        rows.append((i, ", ".join(w), "", "", ""))
    rows += [(500, None, "", "", ""), (501, "", "", "", ""), (None, "bb " * 50, "", "", ""), (502, "zé " * 20_000, "", "", ""), (502, "zé " * 20_000, "", "", "")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.op5_benchmark_decontamination(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, bench)
    docs, tests = spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, BENCH)
    clean = decontaminate.clean_documents(docs, tests)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in clean.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows if not brute([r], bench)[0][5])
    slow = decontaminate.overlap(docs, tests, most_bytes=0)  # above the limit: joined by hash
    fast = decontaminate.overlap(docs, tests)
    assert sorted(map(tuple, slow.collect()), key=repr) == sorted(map(tuple, fast.collect()), key=repr)
    spans = {r.doc_id: len(r.clean_text.split()) for r in decontaminate.clean_spans(docs, tests).collect() if r.doc_id is not None}
    assert all(spans[r[0]] == r[1] - r[2] for r in brute(rows, bench) if r[0] is not None)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b", "", "", "")], DOCS), spark.createDataFrame([], BENCH)
    assert [r.n_hit for r in decontaminate.overlap(docs, none).collect()] == [0]
    assert decontaminate.overlap(docs.limit(0), none).count() == 0
    assert decontaminate.clean_documents(docs, none).count() == 1
    assert decontaminate.clean_spans(docs, none).collect()[0].clean_text == "a b"
    assert [r.n_hit for r in decontaminate.overlap(docs, none, most_bytes=-1).collect()] == [0]


def test_rows_are_told_apart_by_text(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)), "")], BENCH)
    bad = " ".join(f"w{k}" for k in range(11))
    rows = [(7, bad, "", "", ""), (7, "clean words", "", "", ""), (None, bad, "", "", ""), (None, None, "", "", ""), (8, bad, "", "", "")]
    clean = decontaminate.clean_documents(spark.createDataFrame(rows, DOCS), bench)
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == [(0, ""), (7, "clean words")]
