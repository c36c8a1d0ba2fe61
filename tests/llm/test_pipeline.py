"""The corpus pipeline, stage by stage, on a small table."""

import random

from sparkward.llm import registry


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    text = lambda n: "\n".join(" ".join(f"word{rng.randrange(5000)}" for _ in range(12)) + "." for _ in range(n // 12))
    passage, first = text(120), text(240)
    rows = [
        (1, first), (2, first + " tail"), (3, text(240) + " " + passage), (4, passage + " " + text(240) + " mail me.too@mail.example.com"),
        (5, "menu | a | b\n" * 40), (6, None), (7, "too short")
    ]
    rows.append((8, " ".join(rows[2][1].split(" ")[10:150])))  # nothing is left of it without what document 3 has
    spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append(sorted({r.doc_id for r in docs.select("doc_id").collect()}))
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert ids == [[1, 2, 3, 4, 8], [1, 3, 4, 8], [1, 3, 4], [1, 3, 4], [1, 3, 4]]
    third = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert passage in third[3] and passage[60:] not in third[4]
    fourth = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert "me.too@mail.example.com" not in fourth[4] and fourth[3] == third[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_keeps_one_row_of_each_group_whatever_its_id(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    text = lambda: "\n".join(" ".join(f"word{rng.randrange(5000)}" for _ in range(12)) + "." for _ in range(20))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (3, b + " tail"), (4, c), (4, c), (5, d), (6, d + " tail"), (6, e), (7, f), (7, f + " tail"), (8, f)]
    spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text) for r in kept), key=key) == sorted([(None, a), (None, b), (4, c), (5, d), (6, e), (7, f)], key=key)
    assert all((r.lang, r.source, r.n_chars) == ("en", "s", len(r.text)) for r in kept)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 0, 4, 5, 6, 7]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    clashing = spark.createDataFrame([(1, None, None, None, None, 3, 4, "x")], names + ", rid int, cid int, known_lines string")
    for name, stage in corpus_pipeline.STAGES:  # with columns whose names clash, and a text that is null
        assert stage(spark, clashing, str(tmp_path)).count() == (0 if name == "quality rules" else 1)


def test_queries_have_their_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) == 10
