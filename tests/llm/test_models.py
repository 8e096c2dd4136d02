"""Learnt operators by held-out accuracy, mixing by its targets, and the pipeline end to end."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import catalog, mixing, quality
from scriptorium.llm.common import table
from scriptorium.llm.q_quality import THRESHOLD, held_out, op4_quality_classifier

TABLES = "/root/testdata/sf0.01"


def test_quality_on_held_out_documents(spark, sf_dir):
    scored = op4_quality_classifier(spark, TABLES).join(table(spark, TABLES, "labels"), "doc_id").filter("held_out").collect()
    assert len(scored) > 40 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= THRESHOLD) for r in scored)
    assert np.mean([r.predicted == r.quality for r in scored]) >= 0.9
    assert np.mean([r.predicted for r in scored if r.quality == 1]) >= 0.95


def test_held_out_fifth_follows_the_key(spark):
    import zlib

    ids = [0, 7, 12, 999, -3]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(held_out()).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_quality_of_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "fine words here", "s"), (3, "fine words here", "s"), (None, "x" * 5000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score
    none = quality.fit(docs, labels.limit(0))
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 5
    assert quality.score(docs.limit(0), none).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(9)
    words = {"a": [f"a{i}" for i in range(40)], "b": [f"b{i}" for i in range(40)], "c": [f"c{i}" for i in range(40)]}
    docs = []
    for i in range(300):
        d = "aaaabbc"[i % 7]
        docs.append((i, " ".join(rng.choice(words[d if rng.random() < 0.8 else rng.choice("abc")]) for _ in range(rng.randint(5, 60))), d))
    docs += [(900, None, "a"), (901, "", None), (None, "a1 a2", "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = mixing.fit_domains(df, "doc_id", "text", "lang")
    mixer = mixing.Mixer(df, model).fit(mixing.weights_of_total({"a": 1, "b": 1, "c": 1}))
    total = sum(mixer.before.values())
    assert all(abs(mixer.after[d] - total / 3) < 0.001 * total for d in "abc")
    rated = mixer.rated().withColumn("copies", mixing.copies(F.col("rate"), F.col("doc_id"))).collect()
    assert len(rated) == len(docs) and min(r.rate for r in rated) >= 0 and abs(sum(r.rate * r.tokens * r.posterior[1] for r in rated) - total / 3) < 0.001 * total
    tempered = mixing.Mixer(df, model, least_rate=1.0).fit(mixing.tempered(0.5))
    assert min(r.rate for r in tempered.rated().collect()) >= 1.0 - 1e-9
    assert mixing.Mixer(df.limit(0), model).fit(mixing.tempered(0.5)).rated().count() == 0


def test_rates_are_those_of_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(rng.choice([f"{d}{k}" for k in range(9)] + ["x", "y"], rng.integers(3, 40))), d) for i, d in enumerate("ab" * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for least, want in ((0.0, {"a": 3, "b": 1}), (1.0, {"a": 4, "b": 1})):  # in reach, and out of it
        mixer = mixing.Mixer(df, mixing.fit_domains(df, "doc_id", "text", "lang"), least_rate=least).fit(mixing.weights_of_total(want))
        rows = mixer.rated().collect()
        tokens, p = np.array([r.tokens for r in rows], float), np.array([list(r.posterior) for r in rows])
        base = tokens @ p
        a = p * tokens[:, None] / np.sqrt(base)
        goal = mixer.targets / np.sqrt(base)
        dense = np.full(len(rows), 1.0)
        for _ in range(20_000):
            dense = np.maximum(least, dense - a @ (dense @ a - goal) / np.linalg.norm(a, 2) ** 2)
        cost = lambda r: float(((r @ a - goal) ** 2).sum())
        assert mixer.converged and mixer.met == (least == 0.0)
        assert cost(np.array([r.rate for r in rows])) <= cost(dense) + 1e-4 * float((goal**2).sum())


def test_samples_hold_a_row_for_each_key(spark):
    docs = spark.createDataFrame([(7, f"w{i}", "en") for i in range(500)] + [(8, "v", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    assert quality.labelled_sample(docs, labels, "doc_id", "text", "quality", 10).count() == 2


def test_mixing_without_labels_has_one_domain(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    model = mixing.fit_domains(df, "doc_id", "text", "lang")
    assert model.domains == [""] and mixing.Mixer(df, model).fit(mixing.weights_of_total({"": 1})).rated().first().rate == pytest.approx(1.0)


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in catalog.queries()} == {f"op{i}" for i in range(1, 11)}
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracles(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)[0]
    a, b = (x.sort_values(key, ignore_index=True).astype(object).where(lambda d: d.notna(), None).values.tolist() for x in (got, want))
    assert a == b


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    seen = {"start": {r.doc_id for r in docs.select("doc_id").collect()}}
    before = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, before, sf_dir)
        assert out.columns == docs.columns
        out = out.cache()
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        before = out
    names = list(seen)
    assert all(seen[b] <= seen[a] for a, b in zip(names, names[1:], strict=False))
    assert seen["mixing to target weights"] == seen["suffix-array dedup"] == seen["n-gram Jaccard join"]
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    dropped = seen["start"] - seen["quality classifier"]
    assert np.mean([labels[d] == 0 for d in dropped if d in labels] or [1]) > 0.9
    packed = p.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {r.doc_id for r in packed} == seen["mixing to target weights"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "d " * 4000, None, "s", 1), (4, "é" * 300, "fr", None, 300), (5, "é" * 300 + "x", "fr", None, 301)]
    for n, data in (("some", rows), ("none", [])):
        d = str(tmp_path / n)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 1)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        out = p.run(spark, d).collect()
        assert (len(out) > 0) == bool(data)


def test_near_duplicates_are_judged_row_by_row(spark):
    import corpus_pipeline as p

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(None, a), (None, a + " x"), (None, a), (3, b), (None, b + " x"), (9, b + " y"), (7, c), (7, d + " x"), (2, d), (None, None), (None, ""), (None, "")]
    kept = sorted(((r.doc_id or 0, r.text or "") for r in p.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()))
    assert kept[:2] == [(0, ""), (0, "")] and kept[2] in [(0, a), (0, a + " x")] and kept[3:] == [(2, d), (3, b), (7, c)]
