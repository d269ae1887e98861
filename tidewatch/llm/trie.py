"""Operator 12, the trie of conversation prefixes by vertical bitmaps.

Conversations lie in shards, runs of a bounded number of conversations in the order
of their ids. A shard's index maps (position, turn) to the bitset of the shard's
conversations that have the turn there, and (length, end) to those that end there.
Depth first, a node's bitset intersected with the postings of the next position
gives its children; popcounts give the members, the end postings the list of those
that end. A hot turn, prefix or conversation is spread over all shards that have it.

The shards' nodes are merged by the digest of their prefix. Sums over subtrees need
no walk through the levels: every conversation owns the nodes whose smallest member
it is, so a subtree's sum is the sum of what its members own, corrected for its own
top, and a second pass over the shards adds that up with the same bitmaps.

``rebuild`` gives every conversation c the first h turns of conversation
c - c % group and its own turns after the first h, h = crc32(decimal c) % heads.
Turns are ordered by (turn, role, text), null turns first; a null role or text is
empty; repeated rows are turns of their own. Rows without conv_id take no part. A
conversation without turns left belongs to the root alone. No conversations, no
nodes. A conversation may have any length; its digests (not its texts) have to fit
into one task. Turns are told apart by SHA-256, prefixes by 128-bit digests. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import materialize

GROUP, HEADS = 20, 4
SHARD_CONVERSATIONS, SHARD_TURNS = 4_096, 65_536
WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
_PARTIAL = "node binary, depth long, parent binary, conv_id long, n_convs long, words long, before long, ends string"


class Shard:
    """Conversations in ascending order of their ids: turn digests, words of every turn, and two weights."""

    def __init__(self, conversations: int = SHARD_CONVERSATIONS):
        self.most = conversations
        self.ids: list[int] = []
        self.codes: list[list[bytes]] = []
        self.words: list[list[int]] = []
        self.weights: list[tuple[int, int]] = []
        self.turns = 0

    def full(self) -> bool:
        return len(self.ids) >= self.most or self.turns >= SHARD_TURNS

    def postings(self) -> dict[tuple[int, bytes | None], int]:
        """(position, turn) to the bitset of conversations; the end of a conversation is the turn None."""
        index: dict[tuple[int, bytes | None], int] = {}
        for k, codes in enumerate(self.codes):
            bit = 1 << k
            for place in enumerate((*codes, None)):
                index[place] = index.get(place, 0) | bit
        return index

    def nodes(self) -> Iterator[tuple[bytes, int, int, int, int, int, int]]:
        """Digest, depth, number of the parent, members, ending members, words and words above, parents first."""
        index = self.postings()
        stack = [(ROOT, 0, -1, (1 << len(self.ids)) - 1, 0, 0)]
        number = 0
        while stack:
            node, depth, parent, members, words, before = stack.pop()
            ends = members & index.get((depth, None), 0)
            yield node, depth, parent, members, ends, words, before
            rest = members ^ ends
            while rest:
                first = (rest & -rest).bit_length() - 1
                code = self.codes[first][depth]
                child = members & index[depth, code]
                rest ^= child
                digest = hashlib.blake2b(node + code, digest_size=16).digest()
                stack.append((digest, depth + 1, number, child, self.words[first][depth], before + words))
            number += 1

    def positions(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(low.bit_length() - 1)
            bits ^= low
        return out


def shards(batches: Iterator[pa.RecordBatch], conversations: int = SHARD_CONVERSATIONS) -> Iterator[Shard]:
    """Rows ``conv_id, pos, code, words, own, leaf`` in order of (conv_id, pos); rows without code are no turns."""
    shard = Shard(conversations)
    for batch in batches:
        for conv, code, words, own, leaf in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "code", "words", "own", "leaf")), strict=True):
            if not shard.ids or shard.ids[-1] != conv:
                if shard.full():
                    yield shard
                    shard = Shard(conversations)
                shard.ids.append(conv)
                shard.codes.append([])
                shard.words.append([])
                shard.weights.append((0, 0))
            if code is None:
                before = shard.weights[-1]
                shard.weights[-1] = (before[0] + own, before[1] + leaf)
            else:
                shard.codes[-1].append(code)
                shard.words[-1].append(words)
                shard.turns += 1
    if shard.ids:
        yield shard


def _partial_nodes(batches, conversations):
    names = [c.split()[0] for c in _PARTIAL.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in _PARTIAL.split(", ")]
    for shard in shards(batches, conversations):
        out, digests = [], []
        for node, depth, parent, members, ends, words, before in shard.nodes():
            digests.append(node)
            ended = ",".join(str(shard.ids[k]) for k in shard.positions(ends)) or None
            least = shard.ids[(members & -members).bit_length() - 1]
            out.append((node, depth, digests[parent] if parent >= 0 else None, least, members.bit_count(), words, before, ended))
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def _subtree_sums(batches, conversations):
    """For every node the sums over its members of all words, of owned words and of owned leaves."""
    for shard in shards(batches, conversations):
        nodes, parents, sums = [], [], []
        for node, _, parent, _, ends, _, _ in shard.nodes():
            total = [0, 0, 0]
            for k in shard.positions(ends):
                total[0] += sum(shard.words[k])
                total[1] += shard.weights[k][0]
                total[2] += shard.weights[k][1]
            nodes.append(node)
            parents.append(parent)
            sums.append(total)
        for k in range(len(nodes) - 1, 0, -1):  # children come after their parents
            above, own = sums[parents[k]], sums[k]
            for i in range(3):
                above[i] += own[i]
        columns = [pa.array(nodes, pa.binary()), *(pa.array(c, pa.int64()) for c in zip(*sums, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["node", "all_words", "owned_words", "leaves"])


def _digests(batches):
    """SHA-256 of the shards' end lists of every node, joined in order; rows come sorted by (node, conv_id)."""
    node, running = None, None
    for batch in batches:
        out = []
        for key, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != node:
                if node is not None:
                    out.append((node, running.hexdigest()))
                node, running = key, hashlib.sha256(ends.encode())
            else:
                running.update(b"," + ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], ["node", "digest"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()])], ["node", "digest"])


def rebuild(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, pos, code and words of every rebuilt turn, and a row with pos 0 for every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    # Only digests go on: the length tells role and text apart.
    code = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = "row_number() over (partition by conv_id order by turn asc nulls first, role, text)"
    own = rows.withColumn("pos", F.expr(place)).select("conv_id", F.col("pos").cast("long").alias("pos"), code.alias("code"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    own = materialize(own, "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = own.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.expr(f"conv_id - conv_id % {group}"))
    first = own.where(f"conv_id % {group} = 0 and pos < {heads}").withColumnRenamed("conv_id", "base")
    given = convs.where("conv_id <> base").join(first, "base").where("pos <= h")
    kept = own.where((F.col("pos") > h) | (F.col("conv_id") % group == 0))
    columns = ["conv_id", "pos", "code", "words"]
    marks = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("words"))
    return kept.select(columns).unionByName(given.select(columns)).unionByName(marks)


def _sharded(paths: DataFrame) -> DataFrame:
    return paths.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")


def prefix_trie(paths: DataFrame, conversations: int = SHARD_CONVERSATIONS) -> DataFrame:
    """One row per node of the trie of ``paths`` (``conv_id, pos, code, words``), as the module describes."""
    zero = F.lit(0).cast("long")
    paths = materialize(paths.withColumns({"own": zero, "leaf": zero}), "paths")
    partial = materialize(_sharded(paths).mapInArrow(lambda b: _partial_nodes(b, conversations), _PARTIAL), "partial")
    merged = partial.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.first("words").alias("words"), F.first("before").alias("before"),
    )
    merged = materialize(merged, "merged")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(merged.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    # What a conversation owns: the nodes whose smallest member it is, a tail of its path.
    owned = nodes.groupBy("conv_id").agg(F.sum("words").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owned = materialize(owned, "owned")
    weights = owned.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("code"), zero.alias("words"), "own", "leaf")
    sums = _sharded(paths.unionByName(weights)).mapInArrow(lambda b: _subtree_sums(b, conversations), "node binary, all_words long, owned_words long, leaves long")
    sums = sums.groupBy("node").agg(F.sum("all_words").alias("all_words"), F.sum("owned_words").alias("owned_words"), F.sum("leaves").alias("n_leaves"))
    ended = partial.where("ends is not null").select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = ended.mapInArrow(_digests, "node binary, digest string")
    tops = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    totals = paths.groupBy("conv_id").agg(F.sum("words").alias("total")).join(owned.select("conv_id", "own"), "conv_id")
    whole = nodes.join(totals, "conv_id").join(tops, "parent", "left").join(sums, "node").join(ends, "node", "left")
    # Words of all members from the node on, less the words of the subtree's distinct nodes.
    members = F.col("all_words") - F.col("n_convs") * F.col("before")
    distinct = F.col("owned_words") - F.col("own") + F.col("total") - F.col("before")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (members - distinct).alias("saved_tokens"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, group: int = GROUP, heads: int = HEADS, conversations: int = SHARD_CONVERSATIONS) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    return prefix_trie(rebuild(turns, group, heads), conversations)


# CRC-32 bit by bit over the decimal digits; its last inversion turns the lowest bits around.
_STEP = "list_reduce([xor(a, x)] || list_transform(range(0, 8), lambda i: 0::BIGINT), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)"
_CRC = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: {_STEP}), 4294967295)"
SQL = rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT t.* FROM t JOIN c USING (conv_id) WHERE pos > h OR conv_id = base
  UNION ALL SELECT c.conv_id, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base WHERE c.conv_id <> c.base AND pos <= h),
p AS (SELECT conv_id, 0 AS depth, '' AS node, 0 AS words FROM c UNION ALL
  SELECT conv_id, row_number() OVER w, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w),
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM p),
n AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM q GROUP BY node),
k AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN (SELECT parent AS node, count(*) AS n_children FROM n GROUP BY parent) USING (node)),
s AS (SELECT DISTINCT a.node AS top, d.node FROM q a JOIN q d ON a.conv_id = d.conv_id AND d.depth >= a.depth),
u AS (SELECT top AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM s JOIN k USING (node) GROUP BY top)
SELECT k.conv_id, k.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN u USING (node) LEFT JOIN k up ON k.parent = up.node"""
