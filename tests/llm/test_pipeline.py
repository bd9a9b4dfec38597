import random

import pytest

import corpus_pipeline
from ledgerlens.llm import registry
from tests.llm.cases import SCHEMA


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, copies, near copies, a benchmark passage and toxic ones."""
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice(["ta", "re", "on", "li", "se", "mu", "ka"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    passage = prose(40)
    clean = [(i, prose(120), "en", "ab"[i % 2], 1) for i in range(60)]
    copies = [(100 + i, clean[i][1], "en", "a", 1) for i in range(5)]
    near = [(200 + i, clean[i + 10][1] + " and one more", "en", "b", 1) for i in range(5)]
    leak = [(300, f"{prose(20)} {passage} {prose(20)}", "en", "a", 1)]
    toxic = [(400 + i, prose(50) + " idiot moron idiots", "en", "a", 1) for i in range(40)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(clean + copies + near + leak + toxic, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 400)) for r in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    columns = docs.columns
    for name, gone in (("toxicity", set(range(400, 440))), ("simhash_near_dedup", set(range(100, 105)) | set(range(200, 205))), ("benchmark_decontamination", {300})):
        stage = dict(corpus_pipeline.STAGES)[name]
        out = stage(spark, docs, folder)
        assert out.columns == columns
        assert ids(docs) - ids(out) == gone
        docs = out
    mixed = dict(corpus_pipeline.STAGES)["source_mixing"](spark, docs, folder)
    assert mixed.columns == columns
    shards = dict(corpus_pipeline.STAGES)["token_shards"](spark, mixed, folder)
    assert shards.count() == mixed.count()


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    found = sorted(out.collect(), key=lambda r: r.start)
    assert found[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(found, found[1:], strict=False))


def test_ten_operators_are_registered():
    assert [sum(q.startswith(f"op{n}_") for q in registry.QUERIES) for n in range(1, 11)] == [1] * 10
