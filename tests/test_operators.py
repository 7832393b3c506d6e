"""Operators against brute force."""

import random
from contextlib import contextmanager
from itertools import combinations

import pytest
from corpusloom.operators import aggregates as A
from corpusloom.operators import blocks as B
from corpusloom.operators import chat as C
from corpusloom.operators import dedup as D
from corpusloom.operators import generators as G
from corpusloom.operators import joins as J
from corpusloom.operators import plans
from corpusloom.operators import sampling as S
from pyspark.sql import functions as F


def test_pack_lengths_is_best_fit():
    rnd = random.Random(1)
    for _ in range(50):
        lengths = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 60))]
        spots = B.pack_lengths(lengths, 20)
        rooms: list[int] = []
        for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [(r, b) for b, r in enumerate(rooms) if r >= lengths[k]]
            b = min(fits)[1] if fits else len(rooms)
            if not fits:
                rooms.append(20)
            assert spots[k][0] == b and spots[k][2] == 20 - rooms[b]
            rooms[b] -= lengths[k]
        assert len(rooms) == B.count_blocks([(n, lengths.count(n)) for n in set(lengths)], 20)


def test_bucket_bounds_are_the_best():
    histogram, k = {11: 1, 2: 1, 7: 1, 3: 2, 19: 1, 5: 1, 13: 1}, 3
    sizes = sorted(histogram)

    def cost(bounds):
        total, low = 0.0, 0
        for b in bounds:
            own = [(n, histogram[n]) for n in sizes if low < n <= b]
            total += B.bucket_seconds(B.count_blocks(own, b), b, max(1, 28 * 1024 // b))
            low = b
        return total

    best = min(cost([*c, sizes[-1]]) for c in combinations(sizes[:-1], k - 1))
    assert cost(B.bucket_bounds(histogram, k, 1)) == pytest.approx(best)
    assert B.bucket_bounds({}, 2) == [] and B.bucket_bounds({5: 3}, 4, 16) == [16]


def test_pack_blocks(spark):
    rows = [(i, 1 + i * 7 % 90) for i in range(300)] + [(900, 0), (901, 101)]
    got = B.pack_blocks(spark.createDataFrame(rows, "id long, n int"), "id", "n", "id", 100, 64).collect()
    size, by = dict(rows), {}
    for r in got:
        by.setdefault((r.pack_group, r.block), []).append((r.segment, r.offset, size[r.id]))
    assert {r.id for r in got} == set(range(300))
    for parts in by.values():
        parts.sort()
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))] and sum(p[2] for p in parts) <= 100


def test_labels_and_compact_rows(spark):
    df = spark.createDataFrame([([5, 6, 7], [True, False, True], [0, 0, 1])], "ids array<int>, mask array<boolean>, seg array<int>")
    r = df.select(B.loss_labels(F.col("ids"), F.col("mask")).alias("l"), B.compact(F.col("seg"), B.loss_labels(F.col("ids"), F.col("mask"))).alias("c")).first()
    assert r.l == [-100, -100, 7] and r.c.segment_lengths == [2, 1] and r.c.loss_mask == [False, False, True]


def test_chunk_plans():
    sizes = [3, 9, 1, 1, 1, 20, 1]
    assert plans.chunk_plan(sizes, 5) == [(0, 2), (2, 6), (6, 7)]
    assert plans.chunk_plan([], 5) == [] and plans.group_plan([2, 2, 2], [4, 4, 9], 8) == [(0, 4), (4, 6)]
    assert plans.valid_bounds([2, 5], 5) and not plans.valid_bounds([5, 2], 5) and not plans.valid_bounds([], 0)
    assert plans.must_stream(10, 39) and not plans.must_stream(10, 40)


def test_evict_and_uploads(spark):
    files = spark.createDataFrame([("a", 5, 0, 1, False), ("b", 5, 0, 2, True), ("c", 5, 0, 3, False), ("d", 5, 1, 0, False)], "path string, size long, priority int, last_access long, active boolean")
    assert [r.path for r in plans.evict(files, 11).orderBy("path").collect()] == ["a", "c"] and plans.evict(files, 20).count() == 0
    chunks = spark.createDataFrame([("f", 0, 4, "x", 6), ("f", 1, 2, "y", 6), ("g", 0, 4, "x", 6), ("g", 0, 4, "z", 6)], "file string, index int, length long, sha string, total long")
    assert {r.file: (r.conflict, r.complete) for r in plans.uploads(chunks, 4).collect()} == {"f": (False, True), "g": (True, False)}


def test_budgets(spark):
    rnd = random.Random(2)
    rows = [(i, "ab"[i % 2], f"{rnd.getrandbits(64):016x}", rnd.randint(1, 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, c string, p string, n long")
    total = {r.id: r.t for r in S.running_total(df, ["c"], "p", "n", "t").collect()}
    nearest = {r.id for r in S.nearest_boundary(df, "c", "p", "n", 1000).collect()}
    greedy = {r.id for r in S.greedy_fill(df, "c", "id", "p", "n", {"a": 700, "b": 90}).collect()}
    for c, budget in (("a", 700), ("b", 90)):
        own, run, left, want, taken = sorted((r for r in rows if r[1] == c), key=lambda r: r[2]), 0, budget, set(), set()
        crossed = False
        for r in own:
            run += r[3]
            assert total[r[0]] == run
            if not crossed and (run <= 1000 or abs(run - 1000) < abs(run - r[3] - 1000)):
                taken.add(r[0])
            crossed |= run > 1000
            if r[3] <= left:
                left -= r[3]
                want.add(r[0])
        assert {i for i in greedy if rows[i][1] == c} == want and {i for i in nearest if rows[i][1] == c} == taken


def test_balanced_pairs(spark):
    make = lambda tag, n: spark.createDataFrame([(i, f"{i * 7919 % 256:02x}{tag}{i:04d}", 10) for i in range(n)], "id long, p string, n long")
    one, two = S.balanced_pairs(make("a", 100), make("b", 100), "p", "n", 30, 10, 905)
    a, b = one.count(), two.count()
    assert a - b == max(1, -(-(11 * 30 - 20 * 10) // 9)) and 895 <= 10 * (a + b) <= 915 and 2 * (10 + a) > 30 + a + b


def test_quotas_and_orders():
    got = S.quotas({"x": 50, "y": 100, "z": 100}, {"x": 0.6, "y": 0.2, "z": 0.2}, 100, ("x", "y"), 0.65)
    assert got == {"x": 50, "y": 30, "z": 20}
    with pytest.raises(ValueError):
        S.quotas({"x": 5}, {"x": 1.0}, 10, ("x",), 0.5)
    assert S.replay_rows(80, 0.2) == 20 and S.common_unit({"a": 50, "b": 29}, {"a": 5, "b": 3}) == 9 and S.shard_budget(10, 2, 3) == 10
    assert sorted(S.stride_order(74)) == list(range(74)) and S.spaced(10, 3) == [0, 3, 6] and S.spaced(4, 9, frozenset({1})) == [0, 2, 3]


def test_numbers_and_shuffles(spark):
    df = spark.range(0, 500).withColumn("v", F.col("id") * 3 % 1009)
    got = sorted((r.v, r.row_number) for r in S.numbered(df, "v").collect())
    assert [n for _, n in got] == list(range(500))
    assert [r.t for r in S.total_by_number(spark.range(30), "id", "id", "t", 7).orderBy("id").collect()] == [i * (i + 1) // 2 for i in range(30)]
    one, two = ([r.id for r in S.shuffled(spark.range(200), s, F.col("id")).collect()] for s in (1, 2))
    assert sorted(one) == sorted(two) == list(range(200)) and one != two and one == [r.id for r in S.shuffled(spark.range(200), 1, F.col("id")).collect()]


def test_keep_first_caps_components(spark):
    rows = [(i, i % 7, None if i % 5 == 0 else i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k int, g int")
    assert sorted(r.id for r in D.keep_one(df, "k", "id").collect()) == list(range(7))
    kept = D.cap(df, ["g"], ["id"], 2).collect()
    assert sum(r.g is None for r in kept) == 12 and sum(r.g == 1 for r in kept) == 2
    rnd = random.Random(3)
    edges = [(rnd.randint(0, 80), rnd.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)]
    root = list(range(200))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    spark.sparkContext.setCheckpointDir("/tmp/corpusloom-tests")
    got = D.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {n: find(n) for e in edges for n in e}


def test_patches(spark):
    edits = "array<struct<old:string,new:string>>"
    df = spark.createDataFrame([(1, "aXb"), (2, "XX"), (3, "q")], "n int, t string")
    patches = spark.createDataFrame([(1, [("X", "Y"), ("b", "b"), ("Y", "Z")]), (2, [("X", "Y"), ("", "y")])], f"n int, edits {edits}")
    assert {r.n: (r.t, r.n_applied) for r in J.apply_patches(df, patches, "n", "t").collect()} == {1: ("aZb", 2), 2: ("XX", 0), 3: ("q", 0)}


def test_aliases_and_verify(spark):
    targets = spark.createDataFrame([(1, [2, 30]), (2, [40]), (3, [50])], "id int, aliases array<int>")
    rows = spark.createDataFrame([(1,), (2,), (30,), (40,), (50,), (99,)], "key int")
    got = J.with_aliases(rows, "key", targets, "id", "aliases", targets.where("id = 3")).collect()
    assert {r.key: r.target for r in got} == {1: 1, 2: 2, 30: 1, 40: 2}
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 2)], "k int, u string, v int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "w", 0)], "k int, u string, v int")
    assert {r.k: r.difference for r in J.first_difference(a, b, "k", ["u", "v"]).collect()} == {2: "v", 3: "missing_right", 4: "missing_left"}


def test_aliases_to_every_target(spark):
    targets = spark.createDataFrame([(1, [2, 30]), (2, [30]), (3, [1]), (4, [2])], "id int, aliases array<int>")
    rows = spark.createDataFrame([(1,), (2,), (2,), (30,), (3,), (99,)], "key int")
    held = targets.where("id = 3")
    every = J.with_aliases(rows, "key", targets, "id", "aliases", held, every=True).collect()
    assert sorted((r.key, r.target) for r in every) == [(1, 1), (2, 1), (2, 1), (2, 2), (2, 2), (2, 4), (2, 4), (30, 1), (30, 2)]
    first = J.with_aliases(rows, "key", targets, "id", "aliases", held).collect()
    assert sorted((r.key, r.target) for r in first) == [(1, 1), (2, 2), (2, 2), (30, 1)]


def test_statistics(spark):
    df = spark.createDataFrame([("t", i, i < 3) for i in range(8)] + [("u", 0, True)], "task string, i int, ok boolean")
    got = {r.task: r.pass_at_k for r in A.pass_at_k(df, "task", "ok", 2).collect()}
    assert got["t"] == pytest.approx(1 - (5 / 8) * (4 / 7)) and got["u"] is None
    assert {r.v for r in A.ranked_value(spark.range(20).withColumn("g", F.lit(1)), "g", "id", 0.95, "v").collect()} == {19}
    log = spark.createDataFrame([(0, "start"), (1, "step 1 loss: 9.0"), (2, "start"), (3, "epoch 1 step 5 loss: 1.5, lr=1e-4")], "n int, line string")
    assert {(r.step, r.name): r.value for r in A.log_metrics(log, "n", "line").collect()}[5, "loss"] == 1.5


def test_chats(spark):
    chat = lambda *m: [(r, c) for r, c in m]
    rows = [(1, chat(("user", "hi there you"), ("assistant", "yes"))), (2, []), (3, chat(("assistant", "x"), ("user", "a"), ("user", " A "))), (4, chat(("user", "q"), ("assistant", "<think> </think>b")))]
    df = spark.createDataFrame(rows, "id int, m array<struct<role:string,content:string>>")
    m = F.col("m")
    got = {r.id: r for r in df.select("id", C.valid(m).alias("ok"), C.has_reasoning(m).alias("think"), C.chat_reasons(m).alias("why"), C.replay_score(m).alias("score"), C.with_system(m, "S").alias("s"), C.render(m).alias("text")).collect()}
    assert [got[i].ok for i in (1, 2, 3, 4)] == [True, False, False, True] and not got[4].think
    assert got[2].why == ["missing_user_message", "missing_assistant_message", "invalid_conversation_structure"] and "duplicate_user_turn" in got[3].why
    assert got[1].score == 5 + 1 + 1 + 2 and got[2].score is None and got[1].s[0].role == "system" and got[1].text.startswith("<|im_start|>user\nhi")


def test_generated_exercises(spark):
    rows = G.exercises(spark, 400, 5, 3).collect()
    assert len({r.id for r in rows}) == 400 and {r.family for r in rows} == set(G.FAMILIES)
    assert all(G.check(r.family, r.prompt, r.answer) for r in rows)
    assert rows == sorted(G.exercises(spark, 400, 5, 7).collect(), key=lambda r: r.id)
    assert G.anchors(spark, [("q", "a")], 3).count() == 3


def test_mixing_audit(spark):
    df = spark.range(1000).withColumn("c", F.when(F.col("id") % 2 == 0, "x").otherwise("y")).withColumn("t", F.lit(10))
    got = S.mixing_windows(df.withColumn("id", F.col("id").cast("int")), "id", "c", "t", 1000, 8, 100).collect()
    assert len(got) == 16 and all(r.share == 0.5 for r in got)
    assert plans.audit(df, {"t": F.col("t") == 10, "c": F.col("c") == "x"}) == {"t": 0, "c": 500}
    with pytest.raises(ValueError):
        plans.require(df, {"c": F.col("c") == "x"})


def test_batches_and_turns(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, 10).otherwise(20).alias("b"), F.md5(F.col("id").cast("string")).alias("h"))
    got = B.batches(df, "b", "h", 8).collect()
    by = {}
    for r in got:
        by.setdefault((r.b, r.batch, r.batch_order), []).append(r.h)
    keys = sorted(by, key=lambda k: k[2])
    assert [k[2] for k in keys] == list(range(1, len(keys) + 1)) and [k[0] for k in keys] == [20] * 9 + [10] * 5
    assert all(max(by[a]) < min(by[b]) for a, b in zip(keys, keys[1:], strict=False) if a[0] == b[0])
    turns = sorted((r.turn, r.b) for r in S.alternate(df, "b", "h", [10, 20]).collect())
    assert [b for _, b in turns[:68]] == [10, 20] * 34


def test_gram_hits_do_not_depend_on_the_limit(spark):
    rnd = random.Random(11)
    rows = [(i, " ".join(rnd.choices("ab cd ef gh".split(), k=rnd.randint(0, 40)))) for i in range(60)] + [(99, None)]
    bench = spark.createDataFrame([(i, " ".join(rnd.choices("ab cd ef gh".split(), k=9))) for i in range(20)], "item int, t string")
    docs = spark.createDataFrame(rows, "id int, text string")
    grams = J.benchmark_grams(bench, F.col("t"), 4)
    small = J.gram_hits(docs, "id", F.col("text"), grams, 4)
    large = J.gram_hits(docs, "id", F.col("text"), grams, 4, most=-1)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    known = {tuple(t.split()[k : k + 4]) for _, t in bench.collect() for k in range(6)}
    want = {i for i, t in rows if t and any(tuple(t.split()[k : k + 4]) in known for k in range(len(t.split())))}
    assert {r.id for r in small.collect()} == want


def test_greedy_fill_is_the_serial_rule(spark):
    rnd = random.Random(12)
    rows = [(i, rnd.choice("abc"), "%064x" % rnd.getrandbits(256), rnd.randint(0, 40)) for i in range(400)]
    budgets = {"a": 900, "b": 35, "c": 0}
    left, want = dict(budgets), set()
    for i, b, _, n in sorted(rows, key=lambda r: r[2]):
        if n <= left[b]:
            left[b] -= n
            want.add(i)
    got = S.greedy_fill(spark.createDataFrame(rows, "id int, b string, o string, n long"), "b", "id", "o", "n", budgets)
    assert {r.id for r in got.collect()} == want


@contextmanager
def as_on_large_tables(spark):
    """Small tables are planned as large ones: joins by hash, turned to broadcasts while they run, and a file for each task."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def serial_fill(rows, budgets):
    left, want = dict(budgets), []
    for i, b, _, n in sorted(rows, key=lambda r: r[2]):
        if n <= left[b]:
            left[b] -= n
            want.append(i)
    return sorted(want)


def test_chosen_then_rest_keeps_a_category_in_one_task(spark):
    rnd = random.Random(14)
    rows = [(i, rnd.choice("ab"), "%064x" % rnd.getrandbits(256), rnd.randint(1, 40)) for i in range(2000)]
    budgets = {"a": 919, "b": 337}
    chosen = {r[0] for r in rows if r[0] % 50 == 0}
    want = serial_fill([(i, b, ("0" if i in chosen else "f") + o, n) for i, b, o, n in rows], budgets)
    with as_on_large_tables(spark):
        df = spark.createDataFrame(rows, "id int, b string, o string, n long")
        got = S.chosen_then_rest(df, "b", "id", F.col("id") % 50 == 0, "o", "n", budgets).collect()
    assert sorted(r.id for r in got) == want


def test_greedy_fill_keeps_a_category_in_one_task(spark):
    rnd = random.Random(15)
    rows = [(i, rnd.choice("abc"), "%064x" % rnd.getrandbits(256), rnd.randint(1, 40)) for i in range(2000)]
    budgets = {"a": 919, "b": 337, "c": 0}
    with as_on_large_tables(spark):
        got = S.greedy_fill(spark.createDataFrame(rows, "id int, b string, o string, n long"), "b", "id", "o", "n", budgets).collect()
    assert sorted(r.id for r in got) == serial_fill(rows, budgets)


def test_greedy_fill_takes_rows_as_often_as_they_fit(spark):
    rnd = random.Random(16)
    rows = [(i % 90, rnd.choice("ab"), "%064x" % (i % 90 * 7919 % 90 << 249), i % 90 % 13) for i in range(270)]
    budgets = {"a": 150, "b": 61}
    got = S.greedy_fill(spark.createDataFrame(rows, "id int, b string, o string, n long"), "b", "id", "o", "n", budgets).collect()
    assert sorted(r.id for r in got) == serial_fill(rows, budgets)


def test_greedy_fill_of_odd_rows(spark):
    rnd = random.Random(17)
    odd = [-30, -3, 0, 2, 9, 40, None, 2**62]
    rows = [(i, rnd.choice(["a", "b", None]), "%064x" % rnd.getrandbits(256), rnd.choice(odd)) for i in range(300)] + [(None, "a", None, -1), (300, "b", None, -2)]
    budgets = {"a": 50, "b": 7, None: 50}
    want = serial_fill([(-1 if i is None else i, b, o or "~", n) for i, b, o, n in rows if b and n is not None], budgets)
    got = S.greedy_fill(spark.createDataFrame(rows, "id int, b string, o string, n long"), "b", "id", "o", "n", budgets).collect()
    assert sorted(-1 if r.id is None else r.id for r in got) == want


def test_answer_spans():
    import numpy as np
    from corpusloom.operators import tokens as K

    rnd = random.Random(13)
    for _ in range(300):
        ids, begin, end = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 30))], [1, 2], [3]
        want, at = [], 0
        while at < len(ids):
            if ids[at : at + 2] == begin:
                stop = next((k for k in range(at + 2, len(ids)) if ids[k : k + 1] == end), None)
                want.append((at + 2, len(ids) if stop is None else stop + 1))
                at = want[-1][1]
            else:
                at += 1
        assert K.answer_spans(np.array(ids, np.int32), np.array(begin), np.array(end)) == want


def test_tokens_of_a_file_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    from corpusloom.operators import tokens as K
    from tokenizers import Tokenizer

    where = public.path("byte_bpe_50k.json")
    texts = ["Hello there", "", None, "é ü " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.token_ids(F.col("t"), K.Vocabulary(where)).alias("ids"))
    tok = Tokenizer.from_file(where)
    assert all(r.ids == tok.encode(r.t or "", add_special_tokens=False).ids for r in df.collect())
