import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_against_the_planted_cases(spark, tmp_path):
    rnd = random.Random(4)
    words = {"en": "the of and that with this from they have were", "fr": "le la les des une dans pour que est sur"}
    make = lambda lang, n: " ".join("".join(rnd.choices(words[lang].split(), k=2)) for _ in range(n))
    rows, clean = [], set()
    for i in range(120):
        lang = "fr" if i % 3 == 0 else "en"
        rows.append([i, make(lang, rnd.randint(60, 200)), lang])
        clean.add(i)
    bench = [(1, make("en", 40)), (2, make("en", 6))]
    rows += [[200 + k, rows[k][1].replace(" ", "  "), "en"] for k in range(10)]  # equal, and longer: they stay
    clean = clean - set(range(10)) | {200 + k for k in range(10)}
    for k in range(10, 20):  # near copies of greater id go
        w = rows[k][1].split()
        w[len(w) // 2] = "changed"
        rows.append([300 + k, " ".join(w), "en"])
    rows += [[400, make("en", 50) + " " + " ".join(bench[0][1].split()[7:25]), "en"], [401, make("en", 50) + " " + bench[1][1].upper(), "en"]]
    rows += [[500, "12 34", "en"], [501, None, "en"], [502, "", None]]
    long = make("en", 9000)
    rows.append([600, long, "en"])
    clean.add(600)
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", "), name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == clean
    from corpusloom.llm.packing import tokenizer_path
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(tokenizer_path()), Counter()
    text = {i: t for i, t, _ in rows}
    for i in clean:
        ids = tok.encode(text[i], add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], dtype="<u4")
            want[i, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for _, n in sorted(parts)[:k]) for parts in by.values() for k, (o, _) in enumerate(sorted(parts)))
    assert all(sum(n for _, n in parts) <= 4096 for parts in by.values())
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 1


def test_queries_are_registered():
    import __spark_entry__
    from corpusloom.llm import queries

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_sql_gives_the_same_rows(spark):
    import duckdb
    from corpusloom.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.SQL.items():
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        want = sorted((tuple(r) for r in cur.fetchall()), key=repr)
        got = queries.QUERIES[name](spark, sf)
        assert sorted(got.columns) == sorted(cols), name
        assert sorted((tuple(r) for r in got.select(*cols).collect()), key=repr) == want, name


ODD = "doc_id long, text string, lang string, source string, n_chars long, row int, kept boolean, digest string, lang_pred int, i string"


def test_stages_bear_odd_tables(spark, tmp_path):
    """Empty tables, nulls everywhere, rows that repeat an id, and columns named like those inside."""
    words = "the of and that with this from they have were which their would there could other after first these".split()
    rnd = random.Random(5)
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(words) for _ in range(n))
    spark.createDataFrame([(None, None), (1, make(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one, two = make(80), make(80)
    rows = [(7, one), (7, two), (7, one), (None, one), (None, make(60)), (8, None), (9, ""), (None, None)]
    full = spark.createDataFrame([(i, t, None if k % 2 else "en", None, None, k, True, "d", 3, "x") for k, (i, t) in enumerate(rows)], ODD)
    for table in (full, full.limit(0), full.where("text IS NULL")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns, name
            got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
            if table is not full:
                assert len(got) <= table.count()
            elif name in ("exact", "near"):
                assert [g for g in got if g[1]] == sorted([(7, one), (7, two), (0, rows[4][1])]) and len(got) == 4, name
            elif name == "language":
                assert got == sorted((i or 0, t) for i, t in rows if t)
            else:
                assert len(got) == len(rows)
        corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect()
