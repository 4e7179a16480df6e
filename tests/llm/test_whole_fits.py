"""Fits learn from the whole table, not from a sample of it."""

import pytest

from cellscape.llm import pii, quality, toxicity


class Seen(Exception):
    pass


def told(df, name):
    raise Seen(df.count())


def test_pii_learns_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "stored", told)
    docs = spark.range(20_400).selectExpr("id doc_id", "concat('mail a', id, '@b.org now') text")
    with pytest.raises(Seen) as seen:
        pii.fit(docs)
    assert seen.value.args == (20_400,)


def test_quality_learns_from_all_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "stored", told)
    docs = spark.range(12_000).selectExpr("id doc_id", "concat('some words ', id) text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) quality")
    learned = docs.where("crc32(CAST(doc_id AS string)) % 4 <> 2").count()
    with pytest.raises(Seen) as seen:
        quality.fit(docs, labels)
    assert seen.value.args == (learned,) and learned > 8_000


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "stored", told, raising=False)
    docs = spark.range(12_000).selectExpr("id doc_id", "concat('some words ', id) text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) toxic")
    learned = docs.where("crc32(CAST(doc_id AS string)) % 4 <> 2").count()
    with pytest.raises(Seen) as seen:
        toxicity.fit(docs, labels)
    assert seen.value.args == (learned,) and learned > 8_000


def test_toxicity_trains_on_whole_texts(spark):
    """What only ordinary text says beyond its first 400 words is in the ordinary dictionary."""
    late = "late zebrafish lanterns gather"
    texts = [(i, " ".join(f"w{(i * 31 + j * 17) % 997}" for j in range(420)) + f" {late}" * 20, 0) for i in range(120)]
    told = spark.createDataFrame(texts, "doc_id long, text string, label int").select("text", "label")
    assert b"zebrafish" in toxicity.ordinary_content(told)
