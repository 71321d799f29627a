"""Language identification and toxicity: held-out accuracy and defined results."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(9)
    stems = {k: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(300)] for k, letters in {"xx": "abcdefgo", "yy": "mnopqrsé", "zz": "tuvwaßio"}.items()}
    rows, labels = [], []
    for i in range(1500):
        lang = rng.choice(list(stems))
        text = [rng.choice(stems[lang]) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), {"xx": "badword", "yy": "vilén" + rng.choice(stems[lang]), "zz": rng.choice(("grim", "foul"))}[lang])
        rows.append((i, " ".join(text), lang if rng.random() < 0.9 else None, "s", 1))
        if rng.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    odd = [(2000, None, "xx", None, None), (2001, "", "yy", "s", 0), (2002, "12 34 !!", "zz", "s", 0), (2003, "１２…", None, None, 0), (None, rows[0][1], "xx", "s", 1), (3, rows[3][1], "xx", "s", 1), (2004, rows[5][1] * 500, "xx", "s", 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    lab = spark.createDataFrame([*labels, (2000, None, 1), (2001, 1, None), (None, 1, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, lab, {r[0]: r[2] for r in rows}, {x[0]: x[2] for x in labels}, odd


def test_language(world):
    docs, _, langs, _, odd = world
    model = langid.fit(docs, langid.fold_of(F.col("doc_id"), 4) != 2)
    rows = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(rows) == docs.select("doc_id").distinct().count()
    tested = [i for i, x in langs.items() if x and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([rows[i].lang_pred == langs[i] for i in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())
    for i in (2000, 2001, 2002, 2003):
        assert (rows[i].lang_pred, rows[i].score, rows[i].accepted) == ("und", 0.0, False)
    assert rows[2004].lang_pred in ("xx", "yy", "zz")
    sure = [i for i in tested if rows[i].accepted]
    assert len(sure) > 0.5 * len(tested) and np.mean([rows[i].lang_pred == langs[i] for i in sure]) > 0.97


def test_language_of_a_batch_is_that_of_each_text(world):
    docs = world[0]
    model = langid.fit(docs, F.lit(True), 100)
    texts = [r.text for r in docs.limit(50).collect()]
    langs, score = langid.predict_batch(model, pa.array(texts, pa.string()))
    for t, lang, s in zip(texts, langs, score):
        one = langid.predict_batch(model, pa.array([t], pa.string()))
        assert one[0][0] == lang and abs(one[1][0] - s) < 1e-5


def test_nothing_to_learn_from(spark, no_docs, world):
    docs, labels, *_ = world
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(blank, langid.fit(blank, F.lit(True))).collect()} == {"und"}
    assert langid.predict(no_docs, langid.fit(no_docs, F.lit(True))).collect() == []
    one = labels.filter("toxic = 0")
    model = toxicity.fit(docs, one, F.lit(True), F.lit(True))
    assert model is None and {(r.score, r.predicted) for r in toxicity.score(docs, model).collect()} == {(0.0, 0)}


def test_toxicity(spark, world):
    docs, labels, langs, toxic, _ = world
    fold = langid.fold_of(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs, labels, fold, fold)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    tested = [i for i in toxic if zlib.crc32(str(i).encode()) % 5 == 0]
    truth, found = np.array([toxic[i] for i in tested]), np.array([rows[i].predicted for i in tested])
    assert np.sum(truth & found) / truth.sum() > 0.9 and np.sum(truth & found) / found.sum() > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert rows[2000].score == rows[2001].score and rows[2000].predicted == 0
    clash = docs.withColumn("score", F.lit("x")).withColumn("predicted", F.lit(None).cast("int"))
    kept = toxicity.reject(clash, model)
    assert kept.columns == clash.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in toxicity.score(docs, model).filter("predicted = 0").collect())


def test_scores_of_a_batch_are_those_of_each_text(world):
    docs, labels, *_ = world
    model = toxicity.fit(docs, labels, F.lit(True), F.lit(True))
    texts = [None, "", "one", "badword", "a b", *[r.text for r in docs.limit(40).collect()]]
    together, _ = toxicity.score_batch(model, pa.array(texts, pa.string()))
    alone = [toxicity.score_batch(model, pa.array([t], pa.string()))[0][0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4)


def test_labels_and_metadata_are_no_inputs(spark, world):
    docs, labels, *_ = world
    model = toxicity.fit(docs, labels, F.lit(True), F.lit(True))
    other = docs.withColumn("lang", F.lit("q")).withColumn("source", F.lit("q"))
    assert sorted((str(r.doc_id), r.score) for r in toxicity.score(other, model).collect()) == sorted((str(r.doc_id), r.score) for r in toxicity.score(docs, model).collect())


def test_given_tables(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, SF).collect()
    assert len(rows) == len(docs)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]) > 0.97
