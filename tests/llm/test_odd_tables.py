"""Clashing columns, nulls, repeated and very long rows, and empty tables, for operators that judge rows alone and for the pipeline."""

import random
from collections import Counter

import brute
import corpus_pipeline
import pytest
import zstandard

from cairn.llm import quality
from cairn.llm.decontam import clean_documents, contamination
from cairn.llm.langid import identify_languages
from cairn.llm.mixing import mix_sources
from cairn.llm.quality import compression_verdict, quality_rules
from cairn.llm.sharding import shard_documents
from cairn.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"
CLASH = "kept string, size string, target string, taken string, position string, n_words string, n_hit string, ratio string, shard string, slot string, held_out string, score string, predicted string, lang_pred string, th string, row string, part string, bucket string, key string, copies string, `_text` string, `_lap` string, first string, lap string, place string"
NAMES = [c.split()[0].strip("`") for c in CLASH.split(", ")]


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucmfw") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    good = quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("kept and n_repeat_words = 0 and n_dup_lines = 0 and n_words between 80 and 400")
    texts = [r.text for r in clean_documents(good.select("doc_id", "text", "n_words"), items).orderBy("doc_id").collect()]
    long = "\n".join(dict.fromkeys(texts[10:]))
    rows = [(None, texts[0], None, None), (1, None, None, "s"), (2, "", "en", "s"), (3, " \n ", "de", "t"), (4, texts[1], "en", None), (6, long, "en", "t"), (7, texts[2], "de", "u")]
    rows += [rows[4]] * 2 + [rows[0]] + [(8, rows[4][1], "de", "u")]
    assert len(long) > 100_000
    return spark.createDataFrame([(*r, *(f"own {n}" for n in NAMES)) for r in rows], f"doc_id long, text string, lang string, source string, {CLASH}").cache()


def test_operators_with_clashing_columns(spark, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.createDataFrame([(4, 1, "x"), (7, 0, "y")], "doc_id long, toxic int, score string")
    n = odd.count()
    for out in (quality_rules(odd), mix_sources(odd), contamination(odd, items), shard_documents(odd), identify_languages(odd), score_toxicity(odd, labels)):
        rows = out.collect()
        assert len(rows) == n
        assert len(set(out.columns)) == len(out.columns)
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert {r.doc_id: r.n_words for r in quality_rules(odd).collect()}[6] == len(texts[6].split())
    assert [r.doc_id for r in contamination(odd, items, keep=["doc_id"]).where("doc_id = 4").collect()] == [4, 4, 4]
    assert clean_documents(odd, items).columns == odd.columns
    assert clean_documents(odd, items).count() == n


def test_pipeline_stages_with_odd_rows(spark, odd):
    docs, left = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF))
        if name != "sharding":
            assert out.columns == odd.columns
            assert all(r[c] == f"own {c}" for r in out.collect() for c in NAMES)
        else:
            assert sorted(r.slot for r in out.collect() if r.shard == 0) == list(range(out.where("shard = 0").count()))
        docs, left[name] = out, Counter(r.doc_id for r in out.collect())
    assert left["quality"] == Counter({None: 2, 4: 3, 6: 1, 7: 1, 8: 1})
    assert left["near_dedup"] == left["decontamination"] == Counter({None: 2, 4: 3, 6: 1, 7: 1})
    assert set(left["mixing"]) <= set(left["decontamination"])
    assert left["sharding"] == left["mixing"]


def test_an_empty_table_runs_through(spark, odd):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert docs.count() == 0, name


def plain_verdict(raw):
    """The bands once more, from their statement alone."""
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    size = lambda b: len(b) / len(packer.compress(b))
    mostly_ascii = lambda b: sum(x < 128 for x in b) >= quality.ASCII_SHARE * len(b)
    wide = lambda b: (len(b) / max(1, sum(x & 0xC0 != 0x80 for x in b))) ** 0.5

    def least(b):
        n, points = len(b), list(zip(quality.LEAST_AT, quality.LEAST) if mostly_ascii(b) else zip(quality.OTHER_AT, quality.OTHER_LEAST))
        for (a, u), (c, v) in zip(points, points[1:]):
            if a <= n < c:
                return u + (v - u) * (n - a) / (c - a)
        return points[-1][1] if n >= points[-1][0] else points[0][1]

    def most(b):
        return [m for n, m in quality.DOCUMENT_MOST if n <= len(b)][-1] * wide(b)

    def recurs(b):
        pairs, ones = Counter(zip(b, b[1:])), Counter(b)
        same = sum(v * (v - 1) for v in pairs.values()) / ((len(b) - 1) * (len(b) - 2))
        chance = sum(v * (v - 1) for v in ones.values()) / (len(b) * (len(b) - 1))
        return same / chance**2 if chance else 0.0

    if not raw:
        return True
    if not least(raw) <= size(raw) <= most(raw):
        return False
    chunks = [raw[i : i + quality.CHUNK] for i in range(0, len(raw), quality.CHUNK)]
    noise = sum(len(c) for c in chunks if size(c) < least(c) or mostly_ascii(c) and len(c) >= quality.PAIRS_FROM and recurs(c) < quality.PAIR_GAIN)
    above = sum(len(c) for c in chunks if size(c) > (quality.CHUNK_MOST * wide(c) if len(c) == quality.CHUNK else most(c)))
    return noise <= quality.NOISE_SHARE * len(raw) and above <= quality.CHUNK_SHARE * len(raw)


def test_quality_verdicts_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(3)
    extra = [(10_000 + i, (prose(rng, 300) + "abcd " * rng.randint(0, 900) + rng.randbytes(rng.randint(0, 300)).hex())) for i in range(30)]
    texts |= dict(extra)
    for r in quality_rules(docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert r.kept == (plain_verdict(raw) and not brute.base_quality(texts[r.doc_id])[-1])
        assert compression_verdict(raw, zstandard.ZstdCompressor(level=quality.LEVEL))[1] == plain_verdict(raw)
