import brute
import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out)
        seen[name] = docs
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    assert all(not brute.base_quality(rows[i])[-1] for i in ids["quality"])
    groups = brute.near_groups([(i, rows[i]) for i in ids["quality"]], 5, 80)
    assert sorted(ids["near_dedup"]) == sorted(d for d, (_, c) in groups.items() if d == c)
    assert sorted(ids["decontamination"]) == sorted(i for i in ids["near_dedup"] if not brute.contaminated(rows[i], items))
    assert set(ids["mixing"]) <= set(ids["decontamination"])
    assert sorted(ids["sharding"]) == sorted(ids["mixing"])
    assert set(seen["sharding"].columns) == {*docs.columns, "size", "text_crc32", "shard", "slot"}
    total = seen["decontamination"].agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    taken = seen["mixing"].agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    assert abs(taken - total) < 0.2 * total
