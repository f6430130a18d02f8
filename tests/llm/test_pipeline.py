import zlib

import corpus_pipeline
from schemaweave.llm import queries as Q
from schemaweave.llm import toxicity

from .test_dedup import brute_passages
from .test_simhash_wide import brute_kept


def test_stages_against_brute_force(spark, smallest, tmp_path):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, smallest).write.parquet(f"file://{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{name}")
        out[name] = (before, docs)
        if name != "encode":
            assert docs.schema == before.schema
    before, after = out["toxicity"]
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    model = toxicity.fit(before, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    scores = {r.doc_id: r.score for r in toxicity.scores(before, model).collect()}
    lang = {r.doc_id: r.lang for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == {i for i, s in scores.items() if s < model.by_language.get(lang[i], toxicity.THRESHOLD)}
    before, after = out["near_duplicates"]
    assert {r.doc_id for r in after.collect()} == brute_kept(sorted((r.doc_id, r.text or "") for r in before.collect()))
    before, after = out["passages"]
    want = brute_passages([(r.doc_id, r.text) for r in before.collect()])
    for r in after.collect():
        size, removed, _, _ = want[r.doc_id]
        assert size - removed <= len(r.text.encode()) <= size - removed + 8 * (removed > 0) * 8
    before, after = out["mixing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} and after.count() >= before.count()
    before, after = out["encode"]
    assert after.count() == before.count()
    assert Q.TARGETS and zlib.crc32(b"") == 0


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null ids and texts, repeated rows, ties, columns with clashing names, and empty tables."""
    for n, name in enumerate(("some", "none")):
        folder = f"{tmp_path}/{name}"
        rows = [(1, "a b c d e f g", "en", "x"), (2, "A b c d e f g", "en", "x"), (2, "A b c d e f g", "en", "x"), (None, "a b c d e f g", None, None), (None, None, None, None), (3, None, "de", "x"), (4, "", "de", None), (5, "word " * 3000, "fr", "y"), (6, "z" * 70_000, "es", "y")]
        rows = [(i, t, lang, source, len(t or ""), "own", 0, 1.0) for i, t, lang, source in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, node string, __h long, score double"
        spark.createDataFrame(rows[: 0 if n else 99], schema).write.parquet(f"file://{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, None, None)][: 0 if n else 9], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
        docs = spark.read.parquet(f"file://{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES:
            function(spark, docs, f"file://{folder}").write.parquet(f"file://{folder}/{stage}")
            before, docs = docs, spark.read.parquet(f"file://{folder}/{stage}")
            if stage != "encode":
                assert docs.schema == before.schema
            if stage == "near_duplicates" and not n:
                assert sorted((r.doc_id is not None, r.doc_id or 0) for r in docs.collect()) == [(False, 0), (False, 0), (True, 1), (True, 3), (True, 5), (True, 6)]
        assert bool(docs.count()) != bool(n)
        assert corpus_pipeline.run(spark, f"file://{folder}").count() == docs.count()
