import numpy as np
import pytest

from spectraloom.llm import language_id as L
from tests.compare import sf_dir
from tests.llm import edges


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(sf_dir("0.01") + "/documents.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(sf_dir("0.01") + "/documents.parquet")
    out = L.identify(docs, model).where(L.held_out()).select("lang", "language.lang_pred", "language.score").collect()
    assert len(out) > 150
    assert np.mean([r.lang == r.lang_pred for r in out]) >= 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_lang_and_source_are_not_inputs(spark, model):
    docs = spark.read.parquet(sf_dir("0.001") + "/documents.parquet")
    first = {r.doc_id: r.language for r in L.identify(docs, model).collect()}
    blank = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "'x' AS source")
    assert {r.doc_id: r.language for r in L.identify(blank, model).collect()} == first


def test_mixed_text_becomes_spans(spark, model):
    docs = spark.read.parquet(sf_dir("0.01") + "/documents.parquet")
    part = {lang: docs.where(f"lang = '{lang}' AND n_chars BETWEEN 400 AND 900").first()["text"] for lang in ("en", "fr")}
    row = model.predict([part["en"] + " " + part["fr"]], with_spans=True).iloc[0]
    spans = row["spans"]
    assert {s["lang"] for s in spans} == {"en", "fr"} and spans[0]["lang"] == "en" and spans[-1]["lang"] == "fr"
    border = max(s["end"] for s in spans if s["lang"] == "en")
    assert abs(border - len(part["en"])) < 40


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, text, lang, "a") for i in range(60) for text, lang in [("привет мир как дела", "ru"), ("hello world how are you", "en"), ("γειά σου κόσμε", "el")]]
    model = L.fit(edges.docs(spark, rows))
    assert model.predict(["ЖЖЖ", "zzz qqq", "ΩΩΩ"])["lang_pred"].tolist() == ["ru", "en", "el"]
    assert model.predict(["漢字"])["lang_pred"].tolist()[0] in model.langs  # nobody writes it: all stay candidates


def test_viterbi_against_plain_recursion(model):
    rng = np.random.default_rng(0)
    table = -rng.random((50, len(model.langs))).astype(np.float32) * 12
    at = [rng.integers(0, 50, n) for n in (1, 7, 30)]
    for row, path in zip(at, model._viterbi(at, table)):
        def cost(p):
            return sum(table[i, k] for i, k in zip(row, p)) - model.penalty * sum(a != b for a, b in zip(p, p[1:]))

        best = [table[row[0]].astype(float)]
        for i in row[1:]:
            best.append(np.maximum(best[-1], best[-1].max() - model.penalty) + table[i])
        assert cost(path) == pytest.approx(best[-1].max(), abs=1e-3)


def test_edges(spark, model):
    docs = edges.docs(spark)
    out = {(r.doc_id, r.text): r.found for r in L.identify(docs, model, out="found").collect()}
    for key in [(1, None), (2, ""), (3, " \t\n "), (5, "1234 !!")]:
        assert out[key].lang_pred == "und" and out[key].score == 0
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(f.lang_pred != "und" for f in [r.found for r in L.identify(docs, model, out="found").collect()])
    assert L.identify(edges.empty(spark), model).collect() == []
    nothing = L.fit(edges.empty(spark))
    assert nothing.predict(["some text"])["lang_pred"].tolist() == ["und"]


def test_settled_texts_are_what_viterbi_gives(model):
    rng = np.random.default_rng(1)
    table = -(rng.random((60, len(model.langs))) ** 4).astype(np.float32) * 9
    table[np.arange(60), rng.integers(0, 2, 60)] = 0
    at = [rng.integers(0, 60, n) for n in rng.integers(1, 40, 200)]
    settled = model._settled(at, table)
    assert 20 < (settled >= 0).sum() < 200
    for lang, path in zip(settled, model._viterbi(at, table)):
        assert lang < 0 or set(path.tolist()) == {lang}
