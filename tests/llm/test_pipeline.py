import corpus_pipeline
from blobweave.llm import jaccard_join, language_id


def test_stages_keep_the_schema_and_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12345 678", "en", "x", 9), (9002, None, None, None, None), (9003, "", "en", "x", 0), (9004, "the and of it, mail me: someone@mail.example.com", "en", "x", 50)], docs.schema)
    docs = docs.union(extra).cache()
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf).cache()
        seen[name] = after
        if name != "packing":
            assert after.columns == docs.columns
            assert after.count() <= before.count()
        before = after
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert {9001, 9002, 9003} & ids["language"] == set() and 9004 in ids["language"]
    found = jaccard_join.join(seen["near_duplicates"].select("doc_id", "text"), 5, corpus_pipeline.PERCENT)
    assert found.where("doc_id <> component_id").count() == 0
    groups = jaccard_join.join(seen["language"].select("doc_id", "text"), 5, corpus_pipeline.PERCENT)
    assert {r.component_id for r in groups.select("component_id").collect()} == ids["near_duplicates"]
    assert "someone@" not in seen["personal_data"].where("doc_id = 9004").first().text
    assert seen["personal_data"].where("n_chars <> length(text)").count() == 0
    assert ids["packing"] == ids["personal_data"]
    assert language_id.UNKNOWN == "und"


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_near_duplicates_from_four_fifths_up(spark, sf):
    words = [f"w{i}" for i in range(150)]
    copy = [f"x{i}" if i in (30, 75, 120) else w for i, w in enumerate(words)]  # 131 of 161 shingles: 0.81
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, "another text of a few words")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [1, 3]


def test_stages_with_clashing_names_and_odd_rows(spark, sf):
    from pyspark.sql import functions as F

    names = {"score": 0.5, "lang_pred": "x", "cut": "c", "_found": 1, "h": 2, "base": "b", "all": "a", "id": 7, "_id": 8, "_row": "r", "component": 3, "_c0": 4, "_doc": 5, "_text": "t"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    docs = docs.union(spark.createDataFrame([(None, "the words of a text and of it", "en", "s", 1), (None, None, None, None, None)], docs.schema)).withColumns({k: F.lit(v) for k, v in names.items()})
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns and 0 < after.count() <= before.count(), name
        assert after.where(" or ".join(f"`{k}` <> '{v}'" for k, v in names.items())).count() == 0
        before = after
    assert corpus_pipeline.packed(spark, before, sf).count() > 0
