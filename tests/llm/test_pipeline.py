"""The pipeline's stages, each against a brute-force version of it on a small corpus."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wickline.llm import mixing

from .test_bpe import expected
from .test_neardup import brute
from .test_toxicity import corpus


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows = corpus(400, 9)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    docs += [(1000 + i, rows[i][1] if i % 2 else rows[i][1].replace(" ", "  "), "en", "s1", 1) for i in range(1, 40)]  # copies
    docs += [(2000, None, "en", None, None), (2001, "", "en", None, 0), (2002, "w " * 20_000, "en", "s2", 40_000)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents, and the result of each stage on that before it."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, out[-1], sf_dir)
        df.write.parquet(f"{sf_dir}/{name}")
        out.append(spark.read.parquet(f"{sf_dir}/{name}"))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "source_mixing", "bpe"]
    assert all(s.columns == stages[0].columns for s in stages[:4])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    from .test_toxicity import INSULTS

    toxic = {r.doc_id for r in stages[0].where(F.col("text").rlike("(?i)" + "|".join(INSULTS))).collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert kept == {r.doc_id for r in stages[0].collect()} - toxic


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {eval(line)[0] for line in brute(rows, 5, 80, 100) if eval(line)[3]}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want)


def test_mix_takes_each_document_as_often_as_planned(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[2]).select("doc_id", "mix.copies").collect()}
    got = {r.doc_id: r["count"] for r in stages[3].groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in copies.items() if v}


def test_tokens(spark, stages, sf_dir):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    rows = stages[4].collect()
    assert len(rows) == stages[3].count()
    for r in rows:
        ids, decoded = expected(texts[r.doc_id] or "")
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, rows))


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("some", [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None)])):
        df = spark.createDataFrame(rows, schema)
        for column in ("gone", "mix", "time", "score", "kept", "value", "sig"):
            df = df.withColumn(column, F.lit("clash"))
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, f"{tmp_path}/{name}")
            assert out.columns == docs.columns
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in found} <= {1, 2} and (found or not rows)


def test_tasks_give_memory_back_when_they_end(monkeypatch):
    from wickline.llm import common

    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append("back"))
    assert list(common.tidied(lambda batches: (told.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert told == [1, 2, "back"]
