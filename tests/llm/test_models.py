"""Trained models: gradients, held-out accuracy, whole texts, awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SF, TEXTS, awkward, empty, rows_of
from tidyloom.llm import language_id, quality, toxicity
from tidyloom.llm.common import labelled_texts, stratified


def read(spark, table, sf="/root/testdata/sf0.01"):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def test_language_of_held_out_documents(spark):
    docs = read(spark, "documents")
    got = language_id.learn_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and 0.2 < len(held) / len(got) < 0.45
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_ranking(spark, module, label):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    got = module.learn_and_score(docs, labels).join(labels, "doc_id").toPandas()
    assert set(got.predicted[got.score >= module.THRESHOLD]) <= {1}
    held = got[got.held_out]
    one, zero = held.score[held[label] == 1].to_numpy(), held.score[held[label] == 0].to_numpy()
    assert (one[:, None] > zero).mean() > 0.93
    assert (held.predicted == held[label]).mean() > 0.9


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs, labels = read(spark, "documents", SF), read(spark, "labels", SF)
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.learn_and_score(docs, x).orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("per_label", [1500, 20])
def test_share_of_a_label_does_not_depend_on_the_sample(spark, monkeypatch, per_label):
    """All labels of the folds give the share, whether or not each of them is drawn."""
    docs, labels = read(spark, "documents"), read(spark, "labels")
    known = labels.where(~quality.held_out()).toPandas()
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "PER_LABEL", per_label)
    monkeypatch.setattr(quality, "train", lambda *a, share=None, **k: seen.append(share) or train(*a, share=share, **k | {"steps": 1}))
    quality.learn_and_score(docs, labels)
    labelled = docs.join(labels.where(~quality.held_out()), "doc_id")
    quality.fit(labelled)
    assert seen == [pytest.approx(known.quality.mean())] * 2
    flat = [np.zeros((1, quality.CHUNK), np.uint8)] * 4
    a, b = (train(flat, np.array([0, 1, 1, 1]), steps=0, share=s)["top_bias"][0] for s in (0.5, 0.8))
    assert b - a == pytest.approx(np.log(4), rel=1e-5)


def test_toxicity_sample_is_not_cut_by_identifier(spark, monkeypatch):
    """The second draw thins out the first, and what is taken comes from all identifiers alike."""
    monkeypatch.setattr(toxicity, "PER_LABEL", 100)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append((texts, labels)))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.concat(F.lit("text "), F.col("doc_id")).alias("text"))
    toxicity.fit(labelled_texts(docs, labels, "toxic", 2 * toxicity.PER_LABEL), label_col="label")
    texts, drawn = seen[0]
    ids = np.array([int(t.split()[1]) for t in texts])
    assert 60 < (drawn == 1).sum() < 140 and 60 < (drawn == 0).sum() < 140
    assert 25 < (ids >= 3000).sum() < 75
    same = docs.where("doc_id < 2").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("k")).select("doc_id", F.concat_ws(" ", "doc_id", "k").alias("text"), F.col("doc_id").alias("label"))
    monkeypatch.setattr(toxicity, "stratified", lambda rows, *a, **k: rows)  # two identifiers, repeated: the limit acts
    toxicity.fit(same, label_col="label")
    assert len(seen[1][0]) == 400 and 120 < seen[1][1].sum() < 280


def test_gradient_through_time():
    """The hand-written gradient of the recurrent cell against differences."""
    rng = np.random.default_rng(0)
    h, codes = 3, rng.integers(0, 5, (6, 4))
    table, recur = rng.normal(0, 0.3, (2 * h, 256)).astype(np.float32), rng.normal(0, 0.3, (2 * h, h)).astype(np.float32)
    table[:h] += 0.5
    weight = rng.normal(0, 1, (6, h, 4)).astype(np.float32)

    def loss():
        return float((language_id._cell(table, recur, codes).astype(float) * weight).sum())

    keep = []
    language_id._cell(table, recur, codes, keep)
    d_table, d_recur = language_id._cell_back(recur, codes, keep, weight)
    for array, grad in ((table, d_table), (recur, d_recur)):
        for at in [(0, 1), (h + 1, 2), (2, 0)]:
            old, eps = array[at], 1e-2
            array[at] = old + eps
            up = loss()
            array[at] = old - eps
            down = loss()
            array[at] = old
            assert abs((up - down) / (2 * eps) - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_every_position_of_a_whole_text_counts():
    rng = np.random.default_rng(1)
    windows = rng.integers(97, 101, (60, 64)).astype(np.uint8)
    windows[30:] += 10
    labels = np.repeat([0, 1], 30)
    w = language_id.train(windows, labels, 2, steps=30)
    a, b = b"abcd" * 400, b"klmn" * 400
    both = language_id.pooled(w, [a, b, a + b, b""])
    assert both[0, 0] > 0.9 and both[1, 1] > 0.9 and both[3].sum() == 0
    assert abs(both[2] - (both[0] + both[1]) / 2).max() < 0.05
    assert language_id.label_positions(w, np.zeros((2, 10), np.uint8)).shape == (10, 2, 2)


def test_chunks_cover_the_text():
    for n in (0, 1, quality.CHUNK, quality.CHUNK + 1, 5000):
        data = bytes(i % 251 for i in range(n))
        chunks = quality.chunks_of(data)
        assert chunks.shape[1] == quality.CHUNK
        assert b"".join(sorted({c.tobytes() for c in chunks}))  # no chunk is empty
        starts = np.minimum(np.arange(0, max(1, n - quality.OVERLAP), quality.CHUNK - quality.OVERLAP), max(0, n - quality.CHUNK))
        assert len(chunks) == len(starts) and starts[-1] + quality.CHUNK >= n


def test_ngrams_do_not_depend_on_slices(monkeypatch):
    text = "Über die Brücke, 12 mal. " * 50
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "SLICE", 64)
    assert (toxicity.features(text) == whole).all()
    assert len(toxicity.features("")) == 0


def test_awkward_tables(spark):
    docs, none = awkward(spark), empty(spark)
    ids = rows_of(docs, "doc_id")
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (6, 1, 0), (6, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (77, 1, 0), (10, 1, 1), (11, 0, 0)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.learn_and_score(docs, labels)
        assert rows_of(got, "doc_id") == ids
        assert all(0 <= r["score"] <= 1 for r in got.collect())
        assert module.learn_and_score(none, labels).count() == 0
        assert {r["score"] for r in module.learn_and_score(docs, labels.limit(0)).collect()} == {0.5 if module is quality else 0.0}
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.learn_and_identify(docs).collect()}
    assert {i for i, name in got if name == "und"} == {1, 2, 3, 8}
    assert rows_of(language_id.learn_and_identify(docs), "doc_id") == ids
    assert language_id.learn_and_identify(none).count() == 0
    unknown = language_id.learn_and_identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in unknown.collect()} == {("und", 0.0)}
    assert len(TEXTS) == unknown.count()


def test_draw_is_bounded_by_label(spark):
    """One identifier on most rows crowds out no label, by alphabet or otherwise."""
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"), F.lit("aa").alias("lang"))
    more = spark.range(520).select("id", F.concat(F.lit("t"), "id").alias("text"), F.expr("char(97 + id % 26)").alias("lang"))
    got = stratified(rows.unionByName(more.withColumnRenamed("id", "doc_id").withColumn("doc_id", F.lit(1))), "doc_id", "lang", 5)
    assert got.columns == ["doc_id", "text", "lang"]
    counts = {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()}
    assert max(counts.values()) <= 10 and len(set(counts) - {"aa"}) == 26
