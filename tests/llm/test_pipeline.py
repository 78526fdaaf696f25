import corpus_pipeline
from tessella.llm import toxicity


def test_stages_keep_columns_and_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(now) <= ids
        if name != "mixing":
            assert len(now) == len(set(now))
        ids = set(now)
        counts.append(len(now))
    assert counts[0] >= counts[1] >= counts[2] > 0


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.round_trip and len(r.token_ids) == r.n_tokens for r in rows)


def test_toxic_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.trained(toxicity.labelled(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    gone = {r.doc_id for r in toxicity.scored(docs, model, ["doc_id"]).where("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    assert not gone & kept and len(gone) + len(kept) == docs.count()


def test_stages_on_odd_rows(spark, sf):
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (5, "x y " * 20_000), (None, "some words here to read now and a few more of them"), (7, "tie tie tie"), (7, "tie tie tie")]
    rows += [(i, " ".join(f"word{i}x{j}" for j in range(40))) for i in range(10, 20)]
    docs = spark.createDataFrame([(i, t, "en", None if i == 4 else "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("size", "shard", "__text", "__id", "n_words", "row", "whole", "score", "node", "target", "epoch", "mix_key", "value")})
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, given, sf)
            kept = found.collect()
            assert name == "bpe" or found.columns == given.columns, name
            assert all(r.size == "own size" and r['__id'] == "own __id" for r in kept) if name != "bpe" else len(kept) == given.count()
            if name != "mixing":
                assert {r.doc_id for r in kept} >= ({*range(10, 20)} if given is docs else set()), name
