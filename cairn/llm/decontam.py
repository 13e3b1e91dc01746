"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is WINDOW consecutive item words. Both sides hash k-grams of words and keep the least
hash of each window, so an item window that occurs in a document has the same fingerprint
there: every shared span of a window or more is found. Consecutive document windows with the
same fingerprint make one row, which carries just the words that those windows span; the
rows meet the benchmark's fingerprints in a join, and hits are extended and confirmed word by
word. Texts are cut into words once: a row without a span carries each document's number of words past
the same join. Texts aren't shuffled if the benchmark's side is small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import let
from .shared import lower_ascii, materialize, table

WINDOW, GRAM = 10, 6
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprint rows and bytes of the benchmark up to which its side is broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Fixed value: the fingerprint of rows that carry a document's number of words.
COUNT_ROW = 0


def item_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS), lambda w: w != "")


def _upto(last: Column) -> Column:
    """0 .. last, empty if last < 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _span(words: Column, start: Column, n) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def window_fingerprints(words: Column) -> Column:
    """Least k-gram hash of each window of WINDOW words."""
    grams = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(
        _upto(F.size(h) - GRAM), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(GRAM)])))
    return let(grams, lambda g: F.transform(
        _upto(F.size(g) - (WINDOW - GRAM + 1)), lambda i: F.least(*[F.get(g, i + j) for j in range(WINDOW - GRAM + 1)])))


def _runs(words: Column) -> Column:
    """(fp, at, span) of each run of windows with equal fingerprint; span has all words of the run."""
    def cut(m: Column) -> Column:
        starts = F.filter(_upto(F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        return let(starts, lambda s: F.transform(s, lambda at, nth: F.struct(
            F.get(m, at).alias("fp"), at.alias("at"),
            _span(words, at, F.coalesce(F.get(s, nth + 1), F.size(m)) - at + (WINDOW - 1)).alias("span"))))

    return let(window_fingerprints(words), cut)


def _short(words: Column, length: int) -> Column:
    """(fp, at, span) of each run of `length` words, for items of so few words."""
    return F.transform(_upto(F.size(words) - length), lambda at: let(_span(words, at, length), lambda s: F.struct(
        F.xxhash64(F.lit(length), s).alias("fp"), at.alias("at"), s.alias("span"))))


def benchmark_windows(items: DataFrame) -> DataFrame:
    """Distinct (fp, item, length, window) of items(item_id, text)."""
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("words"))
    long = words.where(F.size("words") >= WINDOW).select("item", F.explode(let(F.col("words"), lambda w: let(window_fingerprints(w), lambda m: F.transform(
        m, lambda fp, at: F.struct(fp.alias("fp"), _span(w, at, WINDOW).alias("window")))))).alias("x"))
    short = words.where((F.size("words") > 0) & (F.size("words") < WINDOW)).select("item", F.size("words").alias("length"), F.array_join("words", " ").alias("window"))
    return long.select("x.fp", "item", F.lit(WINDOW).alias("length"), "x.window").unionByName(
        short.select(F.xxhash64("length", "window").alias("fp"), "item", "length", "window")).distinct()


def _covered() -> Column:
    """Words in the spans of `found`, each counted once."""
    return F.aggregate(
        F.array_sort("found"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.stop - F.greatest(acc.upto, x.start))).alias("n"), F.greatest(acc.upto, x.stop).alias("upto")),
        lambda acc: acc.n.cast("long"))


def hits(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, th, copies, n_words, n_hit, n_items, items_sha256, contaminated) for each distinct (doc_id, text) of docs; th is xxhash64 of the text."""
    windows = materialize(benchmark_windows(items))
    size = windows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("window") + F.octet_length("item") + 32), F.lit(0)).alias("bytes"),
                       F.array_sort(F.collect_set(F.when(F.col("length") < WINDOW, F.col("length")))).alias("short")).first()  # nine lengths at most
    known = windows.unionByName(docs.sparkSession.range(1).select(F.lit(COUNT_ROW).cast("long").alias("fp"), F.lit(None).cast("string").alias("item"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("window")))
    if size["rows"] <= broadcast_rows and size["bytes"] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    spans = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(let(item_words(F.coalesce("text", F.lit(""))), lambda w: F.concat(
        F.array(F.struct(F.lit(COUNT_ROW).cast("long").alias("fp"), F.size(w).alias("at"), F.lit(None).cast("string").alias("span"))),
        _runs(w), *[_short(w, n) for n in size["short"]]))).alias("x")).select("doc_id", "th", "x.*")
    starts = let(F.split("span", " "), lambda w: F.filter(
        F.transform(_upto(F.size(w) - F.col("length")), lambda i: F.when(_span(w, i, F.col("length")) == F.col("window"), F.col("at") + i)),
        lambda x: x.isNotNull()))
    counts = F.col("item").isNull()
    met = spans.join(known, "fp").where(F.col("span").isNull() == counts).select(
        "doc_id", "th", "item", "length", F.when(counts, F.col("at")).alias("words"), F.explode(F.when(counts, F.array(F.lit(None).cast("int"))).otherwise(starts)).alias("start"))
    return met.groupBy("doc_id", "th").agg(
        F.count(F.when(counts, 1)).alias("copies"), F.max("words").cast("long").alias("n_words"),
        F.collect_set(F.when(~counts, F.struct("start", (F.col("start") + F.col("length")).alias("stop")))).alias("found"), F.array_sort(F.collect_set("item")).alias("items"),
    ).select("doc_id", "th", "copies", "n_words", _covered().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
             F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("found") > 0).alias("contaminated"))


def contamination(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS, keep: list[str] | None = None) -> DataFrame:
    """docs (its columns `keep`, default all) with n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of any window of any item; an item of fewer than
    WINDOW words, but not none, is one window. Null and empty texts have no words and no hits.
    Items with a null item_id or without words are no items; rows that repeat an item_id are one
    item. Repeated documents each get a row; texts are taken whole, at any length. An empty table gives
    an empty result. Columns of docs with the names above are replaced.
    """
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = hits(docs, items, broadcast_rows)
    if keep == ["doc_id"]:
        return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *made)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns if c.lower() not in made]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("th") == F.col("text_hash"))).select("row.*", *made)


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of docs without any window of an item, with the columns of docs and their own values, whatever their names."""
    # written, so that Spark knows its size and shuffles the texts only where it is large
    bad = materialize(hits(docs, items).where("contaminated").select(F.col("doc_id").alias("id"), "th")).alias("bad")
    return docs.alias("docs").join(bad, F.col("docs.doc_id").eqNullSafe(F.col("bad.id")) & (F.xxhash64("docs.text") == F.col("bad.th")), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents (see contamination)."""
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), keep=["doc_id"])


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw))
), hit AS (
  SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), covered AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
