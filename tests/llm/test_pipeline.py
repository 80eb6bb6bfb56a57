"""The pipeline's stages, one after another."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with a case for every stage."""
    path = str(tmp_path_factory.mktemp("corpus"))
    generator = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "le", "mi", "no", "su") for b in ("ka", "ren", "tol", "vis", "dum", "pex")]
    text = lambda n: " ".join(generator.choice(words) for _ in range(n))
    rows = {i: text(generator.randint(30, 120)) for i in range(400)}
    toxic = {i for i in range(400) if i % 5 == 1}
    for i in toxic:
        rows[i] += " you grobblefink snarkitude " + text(3)
    line = "This line of some forty characters and more is in every document here."
    for i in (10, 12, 14, 20, 22, 24):
        rows[i] += "\n" + line
    rows[30] = " ".join(generator.sample([f"{a}{b}" for a in words for b in words], 80))
    rows[300] = rows[30] + " end"
    rows[302], rows[304] = rows[32], rows[32]
    item = " ".join(f"bench{i}" for i in range(20))
    rows[40] += " " + item
    rows[42] += " " + item.replace("bench7", "other")
    extra = [(i, t, "en", "s", len(t), "keep") for i, t in rows.items()] + [(900, None, "en", None, None, None), (902, "", None, "s", 0, None), (None, "no id", "en", "s", 5, None)]
    spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(400)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, toxic, line


def test_every_stage_takes_effect(spark, folder):
    path, rows, toxic, line = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]
    clean = set(rows) - toxic
    first = seen["toxicity"]
    assert len(clean - set(first)) <= 3 and len(toxic & set(first)) <= 3 and {900, 902, None} <= set(first)
    second = seen["line dedup"]
    assert set(second) == set(first) and second[24].text == rows[24] and second[24].n_chars == len(rows[24])
    assert all(line not in second[i].text and second[i].n_chars == len(second[i].text) for i in (10, 12, 14, 20, 22))
    third = seen["simhash near-duplicates"]
    assert set(second) - set(third) == {300, 302, 304, 902}
    assert set(third) - set(seen["benchmark decontamination"]) == {40, 42}
    last = seen["sentencepiece"]
    assert set(last) == set(seen["benchmark decontamination"]) and last[900].n_pieces == 0 and last[50].n_pieces > 30


def test_run_applies_the_stages(spark, folder):
    path, rows, _, _ = folder
    found = corpus_pipeline.run(spark, path)
    assert found.columns == ["doc_id", "lang", "source", "n_pieces", "piece_ids"]
    ids = {r.doc_id for r in found.select("doc_id").collect()}
    assert not ids & {300, 302, 304, 40, 42} and len(ids) > 300
    assert found.where(F.size("piece_ids") != F.col("n_pieces")).isEmpty()


def test_empty_corpus(spark, folder, tmp_path):
    path, *_ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
