import numpy as np
from pyspark.sql import functions as F

from ratingloom.llm import langid

from . import odd

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    accepted = [r for r in got if not r.rejected]
    assert len(accepted) > 0.8 * len(got) and np.mean([r.lang_pred == r.lang for r in accepted]) > 0.98


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(200).cache()
    held_out = langid.is_held_out(F.col("doc_id"), 5, 0)
    other = docs.withColumn("lang", F.when(held_out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(""))
    a, b = (sorted(tuple(r) for r in langid.identify(d).collect()) for d in (docs, other))
    assert a == b and "xx" not in {r[2] for r in a}


def test_short_texts_and_calibration(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").limit(300).collect()
    pieces = [(r.lang, " ".join(r.text.split()[:6]).encode()) for r in rows]
    p = model.probabilities(model.logits([t for _, t in pieces], langid.byte_classes()))
    right = [model.languages[i] == lang for i, (lang, _) in zip(p.argmax(axis=1), pieces)]
    assert np.mean(right) > 0.85
    assert abs(np.mean(right) - p.max(axis=1).mean()) < 0.1


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = langid.identify(docs).collect()
    assert len(got) == 11
    for r in got:
        if r.doc_id in (1, 2, 3, 9):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr", "de") and 0 <= r.score <= 1
    assert langid.identify(odd.empty(spark)).count() == 0
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(blank).collect()} == {("und", 0.0)}
    one = langid.identify(docs.withColumn("lang", F.lit("en"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("en", 1.0)}


def test_subwords_have_no_space_inside_and_stay_in_their_text():
    found = {}
    for bucket, of in langid.subwords([b"Ab c", b"", b"d"], langid.byte_classes()):
        for b, o in zip(bucket, of):
            found.setdefault(o, []).append(b)
    # " a ab b  c c  " of two, " ab ab  c " of three, " ab " of four
    assert len(found[0]) == 5 + 3 + 1 and 1 not in found and len(found[2]) == 2 + 1
