"""The prefix trie against nested dictionaries, with shards of a few conversations as well."""

import hashlib
import random
import zlib

import duckdb
import pytest

from ledgerlark.llm import prefix_trie as pt
from ledgerlark.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(paths):
    """Every node of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for prefix in members:
        if prefix:
            kids.setdefault(prefix[:-1], []).append(prefix)
    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = kids.get(prefix, [])
        leaves[prefix] = sum(leaves[k] for k in below) if below else 1
        saved[prefix] = (len(members[prefix]) - 1) * (len(prefix[-1][1]) if prefix else 0) + sum(saved[k] for k in below)
    out = []
    for prefix, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(m), len(prefix), parent, len(m), len(kids.get(prefix, [])), leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(own):
    out = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + path[h:]
    return out


def conversations(spark, own, extra=()):
    rows = [(c, t if t else None, r or None, x, "x", 1) for c, path in own.items() for t, (r, x) in enumerate(path)]
    return spark.createDataFrame([*rows, *extra], "conv_id long, turn long, role string, text string, path string, depth int")


def some(seed, n):
    rng = random.Random(seed)
    turns = [("user", "hi"), ("assistant", "hello"), ("", ""), ("user", ""), ("", "user"), ("user", "日本語 text"), ("user", "ab"), ("userab", "")]
    out, ids = {}, rng.sample(range(0, 40 * n), n) + [0, 100, 300, 10**15]
    for c in ids:
        out[c] = [rng.choice(turns[: rng.choice([2, 8])]) for _ in range(rng.randrange(1, 9))]
    for c in ids[: n // 3]:
        out[c] = [("user", "the same"), ("assistant", "thing"), ("user", "again")]
    out[ids[0]] = [("user", "the same"), ("assistant", "thing"), ("user", "again")] * 300
    out[ids[-2]] = [("user", "the same"), ("assistant", "thing"), ("user", "again")] * 200 + [("user", "x" * 9)]
    return out


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def key(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("shard, turns", [(4096, 200_000), (3, 200_000), (64, 40)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, shard, turns):
    monkeypatch.setattr(pt, "SHARD", shard)
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    own = some(shard, 300)
    conversations(spark, own, [(None, 0, "user", "lost", "x", 1)]).repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert key(tuple(r) for r in got.collect()) == key(brute(rebuilt(own)))


def test_operator_on_plain_paths(spark):
    own = {5: [("a", "x"), ("b", "yy")], 3: [("a", "x"), ("b", "yy")], 9: [("a", "x")], 7: [("c", None)], 8: [("c", None), ("c", None)]}
    got = pt.trie_nodes(pt.paths_of(conversations(spark, own)))
    plain = {c: [(r, x or "") for r, x in p] for c, p in own.items()}
    assert key(tuple(r) for r in got.collect()) == key(brute(plain))
    empty = pt.paths_of(conversations(spark, own)).selectExpr("conv_id", "slice(path, 1, 0) as path")
    assert [tuple(r)[:7] for r in pt.trie_nodes(empty).collect()] == [(3, 0, None, 5, 0, 1, 0)]
    assert pt.trie_nodes(empty.limit(0)).count() == 0


def test_repeated_turns_do_not_depend_on_order(spark):
    rows = [(1, 4, "u", "a"), (1, 4, "u", "b"), (1, None, "u", "c"), (1, 4, "u", "a"), (2, 4, "u", "b"), (2, 4, "u", "a"), (2, None, "u", "c"), (2, 4, "u", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (r.path for r in pt.paths_of(table).orderBy("conv_id").collect())
    assert a == b and len(a) == 4 and a[0].size == 1


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = con.execute(ORACLE_SQL["op13_prefix_trie"]).fetchall()
    assert key(tuple(r) for r in QUERIES["op13_prefix_trie"](spark, sf_dir).collect()) == key(want)
