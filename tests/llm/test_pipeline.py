import corpus_pipeline
from tallyspark.llm.queries import QUERIES


def test_stages_keep_columns_and_take_effect(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language", "near_dedup", "personal_data", "mixing", "packing"
    ]
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    prose = "the quick brown fox of this land was in the river and the old man said that it was {} "
    rows = [(n, prose.format(f"word{n} number{n * n}") * 3, "en", f"s{n % 3}", 0) for n in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 0), (101, "mail me at a.b@example.com " + prose, "en", "s1", 0)]
    rows += [(102, None, "en", None, None), (103, "", "de", "s1", 0), (101, "mail me at a.b@example.com " + prose, "en", "s1", 0)]
    rows += [(200 + n, f"der die das und nicht ist mit dem auf eine {n} hier dort {n * n} " * 4, "de", "s2", 0) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        ids = {row["doc_id"] for row in docs.select("doc_id").collect()}
        if name == "packing":
            assert before.count() == docs.where("piece = 0").count()
            continue
        assert docs.columns == columns
        if name == "language":
            assert ids == {row[0] for row in rows} - {102, 103}
        if name == "near_dedup":
            assert 100 not in ids and 0 in ids and docs.where("doc_id = 101").count() == 1
        if name == "personal_data":
            text, size = docs.where("doc_id = 101").select("text", "n_chars").first()
            assert text.startswith("mail me at [EMAIL] the quick") and size == len(text)


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
