"""Prefix trie of conversations from vertical bitmaps.

A conversation is its path of turns. Paths are dealt by ranges of ids over shards of some thousand conversations. A
shard keeps, for each (position, turn), the bitset of its conversations that have that turn there. Depth first, the bitset of
a node is cut with the postings of its members' next turns: each non-empty cut is a child, its popcount the
number of conversations, and the members whose path ends there are the node's end list.

Shards see only their own conversations, so a node comes once from each shard that has it, named by two 64-bit sums over
the hashes of its (position, turn) pairs. These rows are sorted by node and folded as a stream: counts
add up, and as shards are ranges of ids, end lists follow one another in order.

What a subtree sums up needs no tree in one place. The least member of a node owns it, and whoever owns a node owns all that
follow on its path; so each conversation owns one chain. Sums along a chain come from one window; the sum of a whole chain
goes to the nodes above its top, that are prefixes of its own path, by one aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, span_index

#: A shard ends at so many conversations or turns; bitsets are no wider than the first.
SHARD, SHARD_TURNS = 4096, 200_000
_PLACE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_NODE = "h1 long, h2 long, depth long, owner long, n long, n_ends long, p1 long, p2 long, size long"


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of each conversation, null first, as structs (k1, k2, size): two hashes and the text's code points.

    A null role or text is empty. Rows without a conv_id belong to no conversation. Rows of the same turn follow in the order
    of their hashes, so that their order in the table does not matter; rows that are alike in all stay as many turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(7), text, role).alias("k2"), F.length(text).cast("long").alias("size"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    paths = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("path"))
    return paths.select("conv_id", F.transform("path", lambda t: t.dropFields("turn")).alias("path"))


def with_shared_heads(paths: DataFrame) -> DataFrame:
    """Paths rebuilt as the contract of op13 fixes it: the first turns of each hundred's first conversation, then a conversation's own."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    heads = paths.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("path", 1, 5).alias("head"))
    both = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads.hint("merge"), "base", "left")
    head = F.coalesce("head", F.array().cast(paths.schema["path"].dataType))
    return both.select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("path", h + 1, F.size("path"))).alias("path"))


class _Paths:
    """Some paths as flat arrays: turns of path i from first[i] to first[i + 1], prefix sums of path i from first[i] + i on."""

    def __init__(self, ids: np.ndarray, paths: pa.Array) -> None:
        offsets = np.asarray(paths.offsets).astype(np.int64)
        turns = paths.values.slice(offsets[0], offsets[-1] - offsets[0])
        self.ids, self.first = ids, offsets - offsets[0]
        self.sizes = np.diff(self.first)
        self.keys = [np.asarray(turns.field(c)).view(np.uint64) for c in ("k1", "k2")]
        self.n = np.asarray(turns.field("size"))
        self.place = np.arange(len(self.n)) - np.repeat(self.first[:-1], self.sizes)
        self.base = self.first[:-1] + np.arange(len(ids))
        self.prefix = []
        for key, salt in zip(self.keys, _PLACE, strict=True):
            # Each path's values stand after one place of its own, which takes the sum before it back.
            values = np.zeros(len(self.n) + len(ids), np.uint64)
            values[np.repeat(self.base, self.sizes) + self.place + 1] = mix(key + (self.place.astype(np.uint64) + np.uint64(1)) * salt)
            total = np.cumsum(values)
            self.prefix.append((total - np.repeat(total[self.base], self.sizes + 1)).view(np.int64))

    def at(self, path: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
        """The two names of the prefixes of some depths."""
        return [p[self.base[path] + depth] for p in self.prefix]

    def postings(self) -> tuple[np.ndarray, list[int]]:
        """The number of each turn's (position, turn), and the bitset of paths for each such number."""
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.lexsort((owner, *self.keys, self.place))
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in (*self.keys, self.place)])
        code = np.empty(len(order), np.int64)
        code[order] = np.cumsum(new) - 1
        bits = [0] * int(new.sum())
        for c, i in zip(code[order].tolist(), owner[order].tolist(), strict=True):
            bits[c] |= 1 << i
        return code, bits


def _members(bits: int, width: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-width // 8), "little"), np.uint8), bitorder="little"))


def _shard(paths: _Paths) -> pa.RecordBatch:
    """The nodes of one shard, depth first."""
    code, posting = paths.postings()
    code, first, sizes, ids, width = code.tolist(), paths.first.tolist(), paths.sizes.tolist(), paths.ids.tolist(), len(paths.ids)
    ending: dict[int, int] = {}
    for i, size in enumerate(sizes):
        ending[size] = ending.get(size, 0) | 1 << i
    node, depth, count, n_ends, ends, chains = [], [], [], [], [], []
    stack = [((1 << width) - 1, 0)]
    while stack:
        bits, d = stack.pop()
        least = (bits & -bits).bit_length() - 1
        if bits.bit_count() == 1:
            chains.append((least, d))
            continue
        stop = bits & ending.get(d, 0)
        node.append(least)
        depth.append(d)
        count.append(bits.bit_count())
        n_ends.append(stop.bit_count())
        ends.append(",".join(map(str, paths.ids[_members(stop, width)].tolist())) if stop else None)
        rest = bits ^ stop
        while rest:
            child = rest & posting[code[first[(rest & -rest).bit_length() - 1] + d]]
            stack.append((child, d + 1))
            rest ^= child
    # A node of one member goes on alone to the end of its path.
    alone, start = (np.array([c[j] for c in chains], np.int64) for j in (0, 1))
    length = paths.sizes[alone] - start + 1
    last = np.zeros(int(length.sum()), np.int64)
    last[np.cumsum(length) - 1] = 1
    tail = [None] * len(last)
    for at, i in zip((np.cumsum(length) - 1).tolist(), alone.tolist(), strict=True):
        tail[at] = str(ids[i])
    node = np.concatenate([np.array(node, np.int64), np.repeat(alone, length)])
    depth = np.concatenate([np.array(depth, np.int64), span_index(start, length)])
    count = np.concatenate([np.array(count, np.int64), np.ones(len(last), np.int64)])
    n_ends = np.concatenate([np.array(n_ends, np.int64), last])
    above = np.maximum(depth - 1, 0)
    size = np.append(paths.n, 0)[np.where(depth > 0, paths.first[node] + above, -1)]
    columns = [*paths.at(node, depth), depth, paths.ids[node], count, n_ends, *paths.at(node, above), size]
    names = ["h1", "h2", "depth", "owner", "n", "n_ends", "p1", "p2", "size", "ends"]
    return pa.record_batch([*(pa.array(c) for c in columns), pa.array(ends + tail, pa.string())], names=names)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, turns = [], 0, 0

    def shard() -> pa.RecordBatch:
        ids = np.concatenate([np.asarray(i) for i, _ in held])
        return _shard(_Paths(ids, pa.concat_arrays([p for _, p in held])))

    for batch in batches:
        ids, paths = (batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "path"))
        offsets = np.asarray(paths.offsets).astype(np.int64)
        lo = 0
        while lo < len(ids):
            room = int(np.searchsorted(offsets, offsets[lo] + max(0, SHARD_TURNS - turns), "right")) - 1
            hi = min(len(ids), lo + SHARD - rows, max(room, lo + (not rows)))
            if hi > lo:
                held.append((ids[lo:hi], paths[lo:hi]))
                rows, turns = rows + hi - lo, turns + int(offsets[hi] - offsets[lo])
            if rows and (rows >= SHARD or hi < len(ids)):
                yield shard()
                held, rows, turns = [], 0, 0
            lo = hi
    if rows:
        yield shard()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards sorted by node, then owner: one row a node, with the digest of its end list. Holds one open node, never its list."""
    longs = ["h1", "h2", "depth", "owner", "n", "n_ends", "p1", "p2", "size"]
    open_row, open_sha = None, None

    def out(rows: np.ndarray, digests: list[bytes | None]) -> pa.RecordBatch:
        return pa.record_batch([*(pa.array(c) for c in rows), pa.array(digests, pa.binary())], names=[*longs, "ends"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in longs])
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
        lead = np.flatnonzero(new)
        folded = rows[:, lead]
        folded[4:6] = np.add.reduceat(rows[4:6], lead, axis=1)
        run = np.cumsum(new) - 1
        shas: list = [None] * len(lead)
        if open_row is not None:
            if (folded[:3, 0] == open_row[:3]).all():
                counts = folded[4:6, 0] + open_row[4:6]
                folded[:, 0], folded[4:6, 0], shas[0] = open_row, counts, open_sha
            else:
                yield out(open_row[:, None], [open_sha and open_sha.digest()])
        ends = batch.column(batch.schema.get_field_index("ends"))
        at = np.flatnonzero(~np.asarray(ends.is_null()))
        for r, chunk in zip(run[at].tolist(), ends.take(pa.array(at)).to_pylist(), strict=True):
            if shas[r] is None:
                shas[r] = hashlib.sha256(chunk.encode())
            else:
                shas[r].update(b"," + chunk.encode())
        open_row, open_sha = folded[:, -1].copy(), shas[-1]
        if len(lead) > 1:
            yield out(folded[:, :-1], [s and s.digest() for s in shas[:-1]])
    if open_row is not None:
        yield out(open_row[:, None], [open_sha and open_sha.digest()])


def _ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the top of each chain, the names of all prefixes above it with what the chain adds to them."""
    for batch in batches:
        column = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        paths = _Paths(np.asarray(column("conv_id")), column("path"))
        depth = np.asarray(column("depth"))
        for lo in range(0, len(depth), 1000):
            mine = np.arange(lo, min(lo + 1000, len(depth)))
            owner, above = np.repeat(mine, depth[mine]), span_index(np.zeros(len(mine), np.int64), depth[mine])
            columns = [*paths.at(owner, above), above, np.asarray(column("saved"))[owner], np.asarray(column("leaf"))[owner], (above == depth[owner] - 1).astype(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["h1", "h2", "depth", "saved", "leaf", "child"])


def trie_nodes(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path): one row for each distinct sequence of first turns, the empty one included.

    conv_id is the least member, depth the number of turns; parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless
    nodes of its subtree), saved_tokens (its subtree's (n_convs - 1) times the code points of each last text) and
    ends_sha256 (of the ids of members without further turns, ascending, comma-joined). conv_ids are distinct and not null; a path without
    turns is a member of the root; no paths give no nodes. A path is held whole by a task, as one row.
    """
    name = ["h1", "h2", "depth"]
    paths = materialize(paths.select("conv_id", "path"), "paths")
    shards = paths.repartitionByRange("conv_id").sortWithinPartitions("conv_id").mapInArrow(_search, f"{_NODE}, ends string")
    nodes = shards.repartition(*name).sortWithinPartitions(*name, "owner").mapInArrow(_fold, f"{_NODE}, ends binary")
    up = Window.partitionBy("owner").orderBy(F.col("depth").desc())
    own = (F.col("n") - 1) * F.col("size")
    chained = nodes.select(
        *name,
        "owner",
        "n",
        "p1",
        "p2",
        "ends",
        F.sum(own).over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("saved"),
        F.first(F.when(F.col("n") == F.col("n_ends"), 1).otherwise(0)).over(up.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("leaf"),
        F.when(F.row_number().over(up) == 1, 0).otherwise(1).alias("below"),
        F.lead("depth").over(up).isNull().alias("top"),
    )
    chained = materialize(chained, "chains")
    tops = chained.where("top and depth > 0").select(F.col("owner").alias("conv_id"), "depth", "saved", "leaf")
    above = tops.join(paths.hint("merge"), "conv_id").select("conv_id", "path", "depth", "saved", "leaf")
    added = above.mapInArrow(_ancestors, "h1 long, h2 long, depth long, saved long, leaf long, child long").groupBy(*name)
    added = added.agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"), F.sum("child").alias("more_children"))
    whole = materialize(chained.join(added.hint("merge"), name, "left"), "nodes")
    parents = whole.where("more_children > 0").select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent"))
    hung = whole.where("top and depth > 0").join(parents.hint("merge"), ["p1", "p2", "depth"])
    inner = whole.where("not top or depth = 0").withColumn("parent", F.when(F.col("depth") > 0, F.col("owner")))
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    digest: Column = F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256))
    return inner.unionByName(hung).select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("below") + none("more_children")).alias("n_children"),
        (F.col("leaf") + none("more_leaves")).alias("n_leaves"),
        (F.col("saved") + none("more_saved")).alias("saved_tokens"),
        digest.alias("ends_sha256"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt with shared heads.

    Rows without a conv_id are left out, null roles and texts are empty, rows of one turn follow by the hashes of their role and text, an empty table gives no
    node.
    """
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie_nodes(with_shared_heads(materialize(paths_of(conversations), "paths")))


#: The order of rows of the same turn is left to chance here: the tables have none.
ORACLE_SQL = r"""
WITH own AS (SELECT conv_id, list(md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) || length(coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sums AS (SELECT conv_id, ts, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END)) % 6 AS h FROM own),
rebuilt AS (SELECT s.conv_id, list_concat(coalesce(b.ts, [])[1:s.h], s.ts[s.h + 1:]) AS ts FROM sums s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100),
member AS (SELECT conv_id, len(ts) AS l, d, md5(array_to_string(ts[1:d], '')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ts[1:d - 1], '')) END AS pk,
  CASE WHEN d > 0 THEN substr(ts[d], 33)::BIGINT ELSE 0 END AS size FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(pk) AS pk, (count(*) - 1) * any_value(size) AS saved,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE l = d), '') AS ends FROM member GROUP BY k, d),
kids AS (SELECT pk, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY pk, d),
flat AS (SELECT node.*, coalesce(kids.n, 0) AS kids FROM node LEFT JOIN kids ON kids.pk = node.k AND kids.d = node.d),
up AS (SELECT m.k, m.d, sum((f.kids = 0)::BIGINT) AS leaves, sum(f.saved) AS saved FROM flat f JOIN member m ON m.conv_id = f.conv_id AND m.d <= f.d GROUP BY m.k, m.d)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, up.leaves::BIGINT AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flat f JOIN up ON up.k = f.k AND up.d = f.d LEFT JOIN node p ON p.k = f.pk AND p.d = f.d - 1
"""

__all__ = ["ORACLE_SQL", "op13_prefix_trie", "paths_of", "trie_nodes", "with_shared_heads"]
