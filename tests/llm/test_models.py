import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendline.llm import language, quality
from mendline.llm.common import fold_of, id_fold

WORDS = {"en": "the of and house water people because under would right", "de": "der die und haus wasser leute weil unter würde rechts",
         "fr": "le les et maison eau gens parce sous serait droite"}


def sentences(n, seed=1):
    pick = random.Random(seed)
    out = []
    for i in range(n):
        lang = pick.choice(sorted(WORDS))
        out.append((i, " ".join(pick.choice(WORDS[lang].split()) for _ in range(pick.randint(5, 40))), lang))
    return out


def test_fold_matches_python(spark):
    got = spark.range(200).select("id", id_fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == fold_of(r.id, 5) for r in got)


def test_language_on_held_out_rows(docs):
    df = docs(sentences(300))
    got = language.learn_and_identify(df, id_fold(F.col("doc_id"), 3) == 1).collect()
    held = [r for r in got if fold_of(r.doc_id, 3) == 1]
    assert len(got) == 300 and sum(r.lang_pred == r.lang for r in held) > 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_mixed_document_has_both_languages(docs):
    model = language.learn(docs(sentences(300)))
    mixed = " ".join(random.Random(3).choices(WORDS["en"].split(), k=60) + random.Random(4).choices(WORDS["fr"].split(), k=30))
    row = language.identify(docs([(1, mixed), (2, "the water of people")]), model).orderBy("doc_id").collect()
    assert row[0].lang_pred == "en" and row[0].lang_set == ["en", "fr"] and 0.5 < row[0].score < 0.8
    assert row[1].lang_set == ["en"]


def test_label_is_no_input(docs):
    model = language.learn(docs(sentences(200)))
    df = docs(sentences(20, seed=9))
    a = language.identify(df, model).select("doc_id", "lang_pred", "score").collect()
    b = language.identify(df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("y")), model).select("doc_id", "lang_pred", "score").collect()
    assert a == b


def test_language_odd_rows(docs):
    model = language.learn(docs(sentences(60)))
    got = language.identify(docs().withColumn("SCORE", F.lit(1)), model).collect()
    assert len(got) == docs().count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert {r.lang_pred for r in language.identify(docs(), language.learn(docs([]))).collect()} == {"und"}


def test_proportions_rise_in_likelihood():
    pick = np.random.default_rng(0)
    chance = pick.random((3, 50))
    chance /= chance.sum(axis=1, keepdims=True)
    counts = pick.multinomial(5000, 0.7 * chance[0] + 0.3 * chance[2]).astype(float)
    share, fit = language.proportions(chance, counts)
    assert abs(share[0] - 0.7) < 0.1 and abs(share.sum() - 1) < 1e-9
    assert fit >= counts @ np.log(np.full(3, 1 / 3) @ chance)


def test_discriminant_against_direct_formula(spark, monkeypatch):
    monkeypatch.setattr(quality, "DIM", 3)
    pick = np.random.default_rng(2)
    x = np.concatenate([pick.normal(0, 1, (400, 3)), pick.normal(1, 2, (600, 3))])
    y = [0] * 400 + [1] * 600
    df = spark.createDataFrame([(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, y))], "i long, x array<double>, label int").repartition(4)
    model = quality.fit(df)
    covs = [np.cov(x[np.array(y) == k].T, bias=True) for k in (0, 1)]
    pooled = 0.4 * covs[0] + 0.6 * covs[1]
    target = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled))
    odds = np.log(0.6 / 0.4)
    for k, sign in ((0, -1), (1, 1)):
        c = 0.7 * covs[k] + 0.3 * target + 1e-6 * np.eye(3)
        d = x - x[np.array(y) == k].mean(axis=0)
        odds = odds + sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.log(np.linalg.det(c)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-odds)), atol=1e-6)
    got = quality.score(df, model).orderBy("i").collect()
    assert np.allclose([r.score for r in got], model.score(x), atol=1e-9)


def test_statistics_of_odd_texts_are_finite(docs):
    df = quality.with_statistics(docs(), "x")
    rows = df.collect()
    assert all(len(r.x) == quality.DIM and np.isfinite(r.x).all() for r in rows) and len(rows) == docs().count()
    lone = quality.fit(df.withColumn("label", F.lit(1)).limit(1))
    assert lone.score(np.zeros((2, quality.DIM))).tolist() == [1.0, 1.0]
    assert quality.fit(df.withColumn("label", F.lit(None).cast("int"))).constant == 0.5
    assert quality.score(quality.with_statistics(docs([]), "x"), lone).count() == 0


@pytest.mark.parametrize("name,right", [("op3_quality", "quality"), ("op7_language", "lang")])
def test_held_out_accuracy_of_the_queries(spark, name, right):
    from mendline.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    known = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/{'labels' if name == 'op3_quality' else 'documents'}.parquet")
             .select("doc_id", right).collect()}
    rows = [r for r in QUERIES[name](spark, folder).collect() if r.held_out and r.doc_id in known]
    hits = sum((r.predicted if name == "op3_quality" else r.lang_pred) == known[r.doc_id] for r in rows)
    assert hits >= 0.95 * len(rows) > 0


def test_rows_without_identifier_are_folded(spark):
    """A null id counts as one without digits, so that such rows are learnt from where the contract takes that fold."""
    df = spark.createDataFrame([(None,), (5,)], "doc_id long").withColumn("fold", id_fold(F.col("doc_id"), 3))
    assert {(r.doc_id, r.fold) for r in df.collect()} == {(None, 0), (5, fold_of(5, 3))}


def test_columns_named_like_results_are_replaced(docs):
    df = docs([(i, "some words " * i) for i in range(4)]).withColumnRenamed("lang", "X").withColumnRenamed("source", "Score")
    seen = quality.with_statistics(df, "x")
    scored = quality.score(seen, quality.Discriminant(None, None, 0.5))
    assert scored.columns == ["doc_id", "text", "n_chars", "x", "score"] and {r.score for r in scored.collect()} == {0.5}
