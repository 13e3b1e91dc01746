"""Filter interaction audit: what each of five filters removes, alone, in every order, and by Hart and Mas-Colell's potential.

A document is reduced to five bits, the filters that it fails, so each part of the corpus is a game over 32 coalitions: a
coalition's worth is the number of documents that at least one of its filters removes. The potential of a coalition is
P(S) = (worth(S) + sum of P(S without i) over i in S) / |S|, computed from the empty coalition upwards; a filter's
Shapley value is P(all) - P(all without it). It is kept 120 times as large, which makes every potential whole. The step of
an order that adds filter i to coalition S removes worth(S with i) - worth(S).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COALITIONS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"
CAPITALS, TAILS = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))  # the bytes of UTF-8 that begin no character
WHITE = b" \t\n\v\f\r"
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20


def word_counts(raw: bytes) -> tuple[int, int]:
    """(words, distinct words); holds a piece's words and the distinct words, not all words."""
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in WHITE:  # a word isn't cut
            end += 1
        found = raw[at:end].split()
        n += len(found)
        seen.update(found)
        at = end
    return n, len(seen)


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    n, distinct = word_counts(raw)
    capitals, points = len(raw) - len(raw.translate(None, CAPITALS)), len(raw.translate(None, TAILS))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT_PERCENT * n, 100 * capitals > MOST_CAPITALS_PERCENT * points, any(s in raw for s in SYMBOLS))
    return sum(bit << i for i, bit in enumerate(fails))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, masks = [], []
        for value in batch.column("raw"):
            raw = value.as_py()
            digests.append(hashlib.sha256(raw).digest())
            masks.append(failures(raw))
        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "part"]).columns, pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "digest", "mask"])


def failing_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row: bit i of mask is set if the text fails filter i of ABCDE.

    Null texts are empty, null langs the part ''. Texts are judged whole at any length. E compares the SHA-256 of whole texts: a row fails
    if the least doc_id of its text is smaller than its own, so rows that repeat a doc_id fail together, and rows without a doc_id
    never fail E and make nobody fail it. Other columns are left out, whatever their names. An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    judged = materialize(rows.mapInArrow(_judge, "doc_id long, part string, digest binary, mask int"))
    # texts that several doc_ids have; written, so that the join has a shuffle of its own, which Spark can split at a text that very many have
    shared = materialize(judged.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return judged.join(shared, "digest", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"))


def _worth(cells: Column, field: str) -> Column:
    """By coalition: documents, of those that field counts, that at least one of its filters removes."""
    failing = lambda s: F.aggregate(
        cells, F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["mask"].bitwiseAND(s) != 0, c[field]).otherwise(F.lit(0).cast("long")))
    return F.transform(F.sequence(F.lit(0), F.lit(COALITIONS - 1)), failing)


def _potential(worth: Column) -> Column:
    """120 times the potential of each coalition; coalitions come after all that they hold."""
    whole = len(ORDERS)

    def add(done: Column, s: Column) -> Column:
        without = sum((F.when(s.bitwiseAND(1 << i) != 0, F.get(done, s.bitwiseXOR(F.lit(1 << i)))).otherwise(F.lit(0).cast("long")) for i in range(len(FILTERS))), F.lit(0).cast("long"))
        value = (F.get(worth, s) * whole + without) / F.bit_count(s)
        return F.concat(done, F.array(value.cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(COALITIONS - 1)), F.array(F.lit(0).cast("long")), add)


def audit(failing: DataFrame) -> DataFrame:
    """The 600 rows of each part: one for each order of the filters and step. failing: (part, mask, quality, toxic), the last two boolean.

    The rows of a part are counted by mask before any shuffle; 32 counts of a part are all that goes on.
    """
    counted = failing.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    games = parts.select(
        "part", "cells", F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["n"]).alias("all"),
        *[_worth(F.col("cells"), field).alias(f"w_{field}") for field in ("n", "good", "toxic")],
    ).withColumn("potential", _potential(F.col("w_n")))
    steps = [(order, k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k])) for order in ORDERS for k in range(len(FILTERS))]
    taken = F.array(*[F.struct(*map(F.lit, s)) for s in steps])
    at = lambda column, s: F.get(F.col(column), s)
    before, bit, after = F.col("before"), F.col("bit"), F.col("before") + F.col("bit")
    return games.withColumn("s", F.explode(taken)).select(
        "*", F.col("s.col1").alias("filter_order"), F.col("s.col2").alias("step"), F.col("s.col3").alias("before"), F.col("s.col4").alias("bit"),
    ).select(
        "part", "filter_order", "step",
        (F.col("all") - at("w_n", after)).alias("kept"),
        (at("w_n", after) - at("w_n", before)).alias("removed"),
        (at("w_n", bit) - at("w_n", after) + at("w_n", before)).alias("redundant"),
        F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["mask"] == bit, c["n"]).otherwise(F.lit(0).cast("long"))).alias("unique_fails"),
        (at("w_good", after) - at("w_good", before)).alias("good_lost"),
        (at("w_toxic", after) - at("w_toxic", before)).alias("toxic_lost"),
        (F.get("potential", F.lit(COALITIONS - 1)) - F.get("potential", F.lit(COALITIONS - 1) - bit)).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs, see failing_filters and audit.

    labels(doc_id, quality, toxic): a document counts as good (toxic) if any row of its doc_id says 1; null doc_ids and doc_ids without
    a row count as neither.
    """
    failing = failing_filters(docs)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("quality"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    no = F.lit(False)
    return audit(failing.join(marks, "doc_id", "left").select("part", "mask", F.coalesce("quality", no).alias("quality"), F.coalesce("toxic", no).alias("toxic")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the labels of those that have some."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
with words as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), firsts as (select t, min(doc_id) as least from words group by t),
fails as (
    select doc_id, part, len(w) < 100 as A, 100 * len(list_distinct(w)) < 80 * len(w) as B,
        100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) as C, regexp_matches(t, '[#$%&*|]') as D, coalesce(doc_id > least, false) as E
    from words join firsts using (t)
), good as (select distinct doc_id from labels where quality = 1), bad as (select distinct doc_id from labels where toxic = 1),
masks as (
    select part, {'A': A, 'B': B, 'C': C, 'D': D, 'E': E} as f, count(*) as n,
        count(*) filter (doc_id in (select doc_id from good)) as g, count(*) filter (doc_id in (select doc_id from bad)) as x
    from fails group by all
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
    select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps as (select filter_order, step, filter_order[step] as own, filter_order[:step - 1] as prior from orders, (select unnest([1, 2, 3, 4, 5])::integer as step)),
judged as (
    select part, filter_order, step, own, n, g, x,
        case own when 'A' then f.A when 'B' then f.B when 'C' then f.C when 'D' then f.D else f.E end as fails,
        (f.A and contains(prior, 'A')) or (f.B and contains(prior, 'B')) or (f.C and contains(prior, 'C')) or (f.D and contains(prior, 'D')) or (f.E and contains(prior, 'E')) as gone,
        f.A::int + f.B::int + f.C::int + f.D::int + f.E::int as failed
    from masks, steps
), summed as (
    select part, filter_order, step, own, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept,
        coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed, coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant,
        coalesce(sum(n) filter (fails and failed = 1), 0)::bigint as unique_fails, coalesce(sum(g) filter (fails and not gone), 0)::bigint as good_lost,
        coalesce(sum(x) filter (fails and not gone), 0)::bigint as toxic_lost
    from judged group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from summed
"""
