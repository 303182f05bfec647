import re

from pyspark.sql import functions as F

import corpus_pipeline as C
from spectraloom.llm import decontamination, language_id
from tests.compare import sf_dir
from tests.llm.test_packing import check
from tests.llm import edges
from tests.llm.test_near_copies import least_of_groups

SF = sf_dir("0.001")


def test_against_plain_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    model = language_id.fit(docs)
    left = [r for r, lang in zip(rows, model.predict([r[1] for r in rows])["lang_pred"]) if lang != "und"]
    best = {}
    for r in left:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        if norm not in best or (-len(r[1]), r[0]) < (-len(best[norm][1]), best[norm][0]):
            best[norm] = r
    left = sorted(best.values())
    groups = least_of_groups([r[:2] for r in left])
    left = [r for r in left if groups[r[0]] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(SF + "/benchmark.parquet").select("item_id", "text").collect()]
    index = decontamination.Index(items, **{k: v for k, v in decontamination.SEARCH.items() if k != "block_bytes"})
    left = [r for r in left if not len(index.search(decontamination._points(decontamination.normalise(r[1])))[0])]
    pieces = C.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == {r[0] for r in left}
    check(left, pieces, 8192)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns


def test_stages_take_clashing_columns_and_nulls(spark):
    docs = edges.docs(spark)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r[0], r[1]) for r in edges.rows()}


def test_predicted_language_becomes_the_label_of_documents_without_one(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    before = {r.doc_id: r.lang for r in docs.collect()}
    after = {r.doc_id: r.lang for r in C.identify_language(spark, docs, SF).collect()}
    assert None in before.values() and None not in after.values()
    assert all(before[i] in (None, lang) for i, lang in after.items())


def test_empty_documents(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF).collect() == []
