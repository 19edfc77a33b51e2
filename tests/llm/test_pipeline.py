import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randint(0, 3000)}" for _ in range(n))
    docs, labels = [], []
    for i in range(400):
        text = words(60)
        if i % 5 == 0:
            text += " vilewort scumbag"
        docs.append((i, text, "en" if i % 2 else None, f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000, docs[1][1], "en", "s1", 1), (1001, docs[1][1] + " more", "en", "s1", 1)]
    docs += [(1002, words(60) + " token=abcdefgh", "en", "s1", 1), (1003, None, None, None, None), (1004, "", "en", "s0", 0)]
    docs += [docs[2], (None, "no id here", "en", "s0", 10)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = {(r.doc_id, r.text, r.n_chars) for r in docs.collect()}
    ids = {name: {r[0] for r in rows} for name, rows in kept.items()}
    assert not any(i is not None and i < 400 and i % 5 == 0 for i in ids["toxicity"])
    assert len(ids["toxicity"]) == 320 + 6
    assert ids["toxicity"] - ids["near_duplicates"] == {1000, 1001}
    assert ids["secrets"] == ids["near_duplicates"]
    redacted = next(r for r in kept["secrets"] if r[0] == 1002)
    assert redacted[1].endswith(" [secret]") and redacted[2] == len(redacted[1])
    assert ids["mixing"] <= ids["secrets"] and len(ids["mixing"]) > 150


def test_run(spark, folder):
    pieces = P.run(spark, folder).collect()
    assert pieces and {"doc_id", "sequence_id", "offset"} <= set(pieces[0].asDict())
    assert all(p.doc_id is None or p.doc_id % 5 or p.doc_id >= 400 for p in pieces)
    assert P.ORACLE_SQL is None


def test_stages_of_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


CLASHING = (
    "score toxic threshold best host path rule verdict l_key l_id secret_spans removed_lines row row_key component_id "
    "n_shingles topic tokens weight probability sampled others_of_row __text __id __key"
).split()


def test_stages_keep_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 7 = 1 or doc_id >= 1000")
    for k, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.lit(k))
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns[5:] == CLASHING
        row = docs.where("doc_id = 1002").first()
        assert [row[n] for n in CLASHING] == list(range(len(CLASHING)))


def test_one_of_each_tells_rows_apart(spark, folder):
    alpha, gamma = ("alpha " * 3 + " ".join(f"{w}{k}" for k in range(30)) for w in "ag")
    rows = [(3, alpha), (5, alpha), (5, gamma), (5, gamma), (7, gamma + " x"), (None, alpha), (None, "lone words here"), (None, "lone words here"), (8, None), (9, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(map(tuple, P.one_of_each(spark, docs, folder).collect()), key=str)
    assert kept == sorted([(3, alpha), (5, gamma), (None, "lone words here"), (8, None), (9, None)], key=str)
