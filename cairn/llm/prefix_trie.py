"""Conversation prefix trie, by truncation peeling.

A node is a distinct sequence of first turns. Its key is a chain of hashes over them, 128 bits long; the root's is empty. Equal
conversations are brought together first, with their number, their least id and the hash of all their ids; one of each
goes on. Peeling descends from the greatest depth: conversations that end at a depth are merged with the nodes that survive from
below, which gives that depth's nodes; then the last turn of each is stripped and what is left is grouped again.

Work is spread by anchors. A prefix is heavy if several different conversations begin with it and have more turns from its end on, all
together, than a bound; the first prefix of a conversation that isn't heavy is its anchor. All conversations of an anchor
are peeled down to it by one task, whatever their depth. From there on they are stripped in rounds of grouping, one for each
depth of heavy prefixes (most often the root alone), which combine what very many share before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize, table

#: Turns below an anchor that one task peels at most, if not all of one conversation.
TASK_TURNS = 1 << 16
#: Conversations of a family of five ids share up to eight first turns of its first.
FAMILY, MOST_HEAD = 5, 8
ROOT = b""
OWN = "conv_id long, nth long, said binary, bytes long"
CHAINED = "conv_id long, length long, depth long, key binary, bytes long"
NODE = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
NAMES = [c.split()[0] for c in NODE.split(", ")]
STEP = pa.struct([("key", pa.binary()), ("bytes", pa.int64())])
PEELED = f"{NODE}, path array<struct<key: binary, bytes: long>>"


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Role and text as a hash, and the text's bytes."""
    for batch in batches:
        roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
        said = [hashlib.blake2b(b"%d " % len(r) + r + t, digest_size=16).digest() for r, t in zip(roles, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.select(["conv_id", "nth"]).columns, pa.array(said, pa.binary()), pa.array(list(map(len, texts)), pa.int64())], names=["conv_id", "nth", "said", "bytes"])


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, length, depth from 1, said, bytes): the first h turns of each conversation's family, then its own after its first h.

    h is crc32(decimal conv_id) % 9 and the family's turns are those of conversation conv_id - conv_id % 5. Turns of a conversation
    are ordered by turn (null first), ties by role and text; rows that repeat are turns like others. Null roles and texts are
    empty, rows without a conv_id belong to no conversation, other columns are left out. A conversation of no turns has one row, of depth 0.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    ordered = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).cast("binary").alias(c) for c in ("role", "text")],
    ).withColumn("nth", F.row_number().over(order).cast("long"))
    own = materialize(ordered.select("conv_id", "nth", "role", "text").mapInArrow(_said, OWN))
    zero = F.lit(0).cast("long")
    counted = own.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).alias("h"))
    firsts = counted.select(F.col("conv_id").alias("first"), F.col("n").alias("first_n"))
    convs = materialize(
        counted.join(firsts, "first", "left").withColumn("taken", F.least("h", F.coalesce("first_n", zero))).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), zero)))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("nth") <= MOST_HEAD)).withColumnRenamed("conv_id", "first")
    taken = convs.where("taken > 0").join(heads, "first").where("nth <= taken").withColumn("depth", F.col("nth"))
    later = own.join(convs, "conv_id").where("nth > h").withColumn("depth", F.col("nth") - F.col("h") + F.col("taken"))
    none = convs.where("length = 0").select("*", zero.alias("depth"), F.lit(b"").alias("said"), zero.alias("bytes"))
    columns = ["conv_id", "length", "depth", "said", "bytes"]
    return taken.select(columns).unionByName(later.select(columns)).unionByName(none.select(columns))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn, with the key of all turns up to it; rows come by conversation and depth."""
    conv, key = None, ROOT
    for batch in batches:
        keys = []
        for c, depth, said in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "depth", "said")), strict=True):
            key = ROOT if c != conv else key
            conv = c
            if depth:
                key = hashlib.blake2b(key + said, digest_size=16, person=b"turns").digest()
            keys.append(key)
        yield pa.RecordBatch.from_arrays([*batch.select(["conv_id", "length", "depth"]).columns, pa.array(keys, pa.binary()), batch.column("bytes")], names=["conv_id", "length", "depth", "key", "bytes"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of one key within a batch, as text; rows come by key and id."""
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
        spans = list(zip(cuts, cuts[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[a] for a, _ in spans], pa.binary()), pa.array([ids[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, ids[a:b])).encode() for a, b in spans], pa.binary())],
            names=["key", "least", "run"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each key; its texts come in order, and one is held at a time."""
    key = digest = None

    def made(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], names=["key", "ends"])

    for batch in batches:
        done = []
        for k, run in zip(batch.column("key").to_pylist(), batch.column("run").to_pylist(), strict=True):
            if k == key:
                digest.update(b"," + run)
                continue
            if digest:
                done.append((key, digest.digest()))
            key, digest = k, hashlib.sha256(run)
        yield made(done)
    if digest:
        yield made([(key, digest.digest())])


def hashes_of_ids(rows: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the conv_ids of each key of rows(key, conv_id), rising and joined by commas.

    All tasks sort, whatever one key has; a key's task gets its ids as texts, one for each batch of them.
    """
    runs = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_joined_ids, "key binary, least long, run binary")
    return runs.repartition("key").sortWithinPartitions("key", "least").mapInArrow(_hashed_ids, "key binary, ends binary")


@dataclass
class Conversation:
    """Its keys and bytes from the anchor's depth on."""

    conv_id: int
    copies: int
    ends: bytes
    keys: list[bytes] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)


class Node:
    """A node, as conversations and nodes from below merge in it."""

    __slots__ = ("at", "children", "conv", "convs", "ends", "example", "leaves", "parent", "saved")

    def __init__(self, example: Conversation, at: int):
        self.example, self.at, self.conv = example, at, example.conv_id
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends = self.parent = None

    def add(self, convs: int, conv: int) -> None:
        self.convs, self.conv = self.convs + convs, min(self.conv, conv)


def peel(convs: list[Conversation]) -> tuple[list[Node], Node]:
    """(the nodes below the anchor, deepest first; the anchor's node, to which its own bytes aren't counted yet)."""
    by_end: dict[int, list[Conversation]] = {}
    for c in convs:
        by_end.setdefault(len(c.keys) - 1, []).append(c)
    below: list[Node] = []
    alive: list[Node] = []
    for at in range(max(by_end), -1, -1):
        nodes: dict[bytes, Node] = {}
        for c in by_end.get(at, ()):
            node = nodes.setdefault(c.keys[at], Node(c, at))
            node.add(c.copies, c.conv_id)
            node.ends = c.ends
        for child in alive:  # stripped of its last turn
            key = child.example.keys[at]
            node = nodes.get(key) or nodes.setdefault(key, Node(child.example, at))
            node.add(child.convs, child.conv)
            node.children, node.leaves, node.saved, child.parent = node.children + 1, node.leaves + child.leaves, node.saved + child.saved, node
        alive = list(nodes.values())
        if at:
            for node in alive:
                node.leaves, node.saved = node.leaves or 1, node.saved + (node.convs - 1) * node.example.sizes[at]
            below += alive
    return below, alive[0]


def _peeled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes below anchors, and a row with a path for each anchor; rows come by anchor, conversation and depth."""
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.binary(), pa.list_(STEP)]

    def table_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[*NAMES, "path"])

    def finished(start: int, path: list[dict], convs: list[Conversation]) -> list[tuple]:
        below, top = peel(convs)
        rows = [(n.example.keys[n.at], n.parent.example.keys[n.at - 1], n.conv, start + n.at, n.parent.conv, n.convs, n.children, n.leaves, n.saved, n.ends, None) for n in below]
        return [*rows, (top.example.keys[0], None, top.conv, start, None, top.convs, top.children, top.leaves, top.saved, top.ends, path)]

    anchor, start, path, convs = None, 0, [], []
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if r["anchor"] != anchor:
                if convs:
                    out += finished(start, path, convs)
                anchor, start, path, convs = r["anchor"], r["start"], [], []
            if not convs or convs[-1].conv_id != r["conv_id"]:
                convs.append(Conversation(r["conv_id"], r["copies"], r["ends"]))
            if len(convs) == 1 and 0 < r["depth"] <= start:  # the same for all of an anchor
                path.append({"key": r["key"], "bytes": r["bytes"]})
            if r["depth"] >= start:
                convs[-1].keys.append(r["key"])
                convs[-1].sizes.append(r["bytes"])
        yield table_of(out)
    if convs:
        yield table_of(finished(start, path, convs))


def _round(left: DataFrame, depth: int) -> DataFrame:
    """The nodes of a depth: all that is left of it, merged by key."""
    own = F.element_at("path", -1) if depth else None
    key: Column = own["key"] if depth else F.lit(ROOT)
    merged = left.where(F.size("path") == depth).groupBy(key.alias("key")).agg(
        F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"))
    size = own["bytes"] if depth else F.lit(0).cast("long")
    parent = F.lit(None).cast("binary") if not depth else F.lit(ROOT) if depth == 1 else F.element_at("path", -2)["key"]
    return merged.select(
        "key", parent.alias("parent"), "conv_id", F.lit(depth).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * size).alias("saved_tokens"), "ends", "path")


def prefix_trie(turns: DataFrame, task_turns: int = TASK_TURNS) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations, see rebuilt_turns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns(conv_id, turn, role, text). Texts are taken whole at any length and leave their task as hashes. An empty table has no
    conversations and so no root. One conversation's turns below its anchor, and ids of copies as text, a batch at a time, are
    what a task holds beyond the bound.
    """
    bounded_batches(turns.sparkSession)
    chained = materialize(rebuilt_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(_chained, CHAINED))
    full = chained.where("depth = length").select("key", "conv_id")
    classes = full.groupBy("key").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"))
    several = hashes_of_ids(full.join(classes.where("copies > 1").select("key"), "key"))
    own_hash = F.unhex(F.sha2(F.col("conv_id").cast("string"), 256))
    classes = materialize(classes.join(several, "key", "left").select("conv_id", "copies", F.coalesce("ends", own_hash).alias("ends")))
    rows = materialize(chained.join(classes, "conv_id"))

    prefixes = rows.groupBy("key").agg(F.sum(F.col("length") - F.col("depth") + 1).alias("weight"), F.count("*").alias("several"))
    heavy = prefixes.where((F.col("weight") > task_turns) & (F.col("several") > 1)).select("key", F.lit(True).alias("heavy"))
    here = F.struct(F.col("depth").alias("start"), F.col("key").alias("anchor"))
    anchors = rows.join(heavy, "key", "left").groupBy("conv_id").agg(F.coalesce(F.min(F.when(F.col("heavy").isNull(), here)), F.max(here)).alias("a")).select("conv_id", "a.*")
    dealt = rows.join(anchors, "conv_id").repartition("anchor").sortWithinPartitions("anchor", "conv_id", "depth")
    peeled = materialize(dealt.mapInArrow(_peeled, PEELED))

    nodes = peeled.where("path is null").select(NAMES)
    left = peeled.where("path is not null").select("path", *NAMES)
    top = left.agg(F.max(F.size("path"))).first()[0]
    rounds = None
    for depth in range(top, -1, -1) if top is not None else ():
        found = materialize(_round(left, depth))
        stripped = found.select(
            F.slice("path", 1, max(depth - 1, 0)).alias("path"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("binary").alias("ends"))
        left = left.where(F.size("path") < depth).select(stripped.columns).unionByName(stripped)
        rounds = found.select(NAMES) if rounds is None else rounds.unionByName(found.select(NAMES))
    if rounds is not None:
        parents = rounds.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        nodes = nodes.unionByName(rounds.drop("parent_conv_id").join(parents, "parent", "left").select(NAMES))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.select(*NAMES[2:-1], F.coalesce(F.lower(F.hex("ends")), nobody).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
with own as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as nth
    from conversations where conv_id is not null
), ids as (
    select conv_id as c, conv_id - conv_id % 5 as b, n, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)) as codes
    from (select conv_id, count(*) as n from own group by 1)
), heads as (
    select c, b, n, xor(list_reduce(flatten(list_transform(codes, lambda x: list_transform(range(8), lambda i: (x >> i::integer) & 1))),
        lambda r, bit: xor(r >> 1, (xor(r, bit::bigint) & 1) * 3988292384), 4294967295::bigint), 4294967295::bigint) % 9 as h
    from ids
), rebuilt as (
    select c, nth as depth, role, text from heads join own on own.conv_id = b where nth <= h
    union all
    select c, nth - h + least(h, coalesce((select max(n) from ids f where f.c = heads.b), 0)) as depth, role, text from heads join own on own.conv_id = c where nth > h
), whole as (
    select heads.c, coalesce(list(sha256(length(role)::varchar || ' ' || role || text) order by depth) filter (depth is not null), []) as seq,
        coalesce(list(strlen(text) order by depth) filter (depth is not null), []) as sizes
    from heads left join rebuilt on rebuilt.c = heads.c group by heads.c
), visits as (
    select c, d, len(seq) as length, array_to_string(seq[:d], '/') as key, case when d = 0 then null else array_to_string(seq[:d - 1], '/') end as up, case when d = 0 then 0 else sizes[d] end as size
    from whole, lateral (select unnest(range(0, len(seq) + 1)) as d)
), nodes as (
    select key, d as depth, any_value(up) as up, min(c) as conv_id, count(*) as n, any_value(size) as size,
        sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (length = d), '')) as ends
    from visits group by key, d
), kids as (select up, count(*) as n from nodes where up is not null group by up),
sub as (
    select a.key, count(*) filter (not exists (select 1 from kids k where k.up = b.key)) as leaves, sum((b.n - 1) * b.size) as saved
    from nodes b join visits v on v.c = b.conv_id and v.d <= b.depth join nodes a on a.key = v.key group by a.key
)
select a.conv_id, a.depth::bigint as depth, p.conv_id as parent_conv_id, a.n as n_convs, coalesce(k.n, 0)::bigint as n_children,
    s.leaves as n_leaves, s.saved::bigint as saved_tokens, a.ends as ends_sha256
from nodes a left join nodes p on p.key = a.up left join kids k on k.up = a.key join sub s on s.key = a.key
"""
