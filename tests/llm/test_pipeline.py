from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from lyrebird.llm import packing, pii, quality
from tests.llm.test_groups import plain_print, smallest
from tests.llm.test_tokens_packing import WORD_BPE, best_fit, crc, plain_ids

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    keep = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").select("doc_id").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    assert 0 < len(rows) < docs.count()
    prints = [plain_print(t) for _, t in rows]
    group = smallest(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    rows = [r for i, r in enumerate(rows) if group[i] == i]
    want = Counter()
    for doc_id, text in rows:
        ids = plain_ids(WORD_BPE, pii.redacted(text))
        want.update((doc_id, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(best_fit([r.length for r in got]))


def test_stages_keep_columns(spark, odd_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "pii", "best_fit_packing"]
    clash = odd_docs.withColumn("score", F.lit(1)).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns
        assert stage(spark, clash.limit(0), SF).count() == 0
    assert corpus_pipeline.packing(spark, clash, SF).count() == packing.pieces(clash).count()
    texts = {r.doc_id: r for r in corpus_pipeline.private(spark, clash, SF).collect()}
    assert texts[14].text == "Mail: <EMAIL> or <PHONE>." and texts[14].n_chars == len(texts[14].text) and texts[0].text is None


def test_texts_of_megabytes_through_all_stages(spark, tmp_path):
    """Very long texts pass every stage whole, and so do the operators that shard, compress and pack them."""
    from lyrebird.llm.huffman import huffman_ids
    from lyrebird.llm.packing import pack, pieces
    from lyrebird.llm.sharding import hilbert_shards

    texts = ["Some plain words, and a.b@c.example.org too. " * 40_000, "x" * 1_500_000, "a." * 400_000, "short and plain"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name == "pii":
            assert {r.doc_id: r.text.count("<EMAIL>") for r in docs.collect()} == {0: 40_000, 1: 0, 2: 0, 3: 0}
    packed = docs.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert len(packed) == 4 and docs.where("length > 2048").count() == 0
    assert {r.doc_id: r["size"] for r in hilbert_shards(df).collect()} == {i: len(t) + 8 for i, t in enumerate(texts)}
    ids = {r.doc_id: r.n_tokens for r in huffman_ids(df).collect()}
    assert ids[0] > 300_000 and len(ids) == 4
    assert pack(pieces(df)).groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
