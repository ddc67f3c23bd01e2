"""Periodic runs against all lags tried by hand, on random, periodic and awkward texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerlark.llm import periodic_runs as pr
from ledgerlark.llm.queries import QUERIES


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_runs(w, least=6, times=4):
    """Every longest stretch of each lag; the same stretch under a multiple of its period counts once."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not w:
        return w
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def expected(doc_id, text):
    w = planted(doc_id, words_of(text))
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    rng = random.Random(11)
    out = [None, "", " \n\t\v", "one", "a a a a a", "a a a a a a", "a b a b a b a", "a b a b a b a b", "x" + " a" * 9 + " y"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            q = rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 33, 64, 65, 100])
            unit = [rng.choice("abcdefg") if rng.random() < 0.5 else f"w{rng.randrange(5)}é" for _ in range(q)]
            parts += (unit * 9)[: int(q * rng.uniform(2.5, 8))] + [f"z{rng.randrange(9)}" for _ in range(rng.randrange(3))]
        out.append(" ".join(parts))
    out += [" ".join(rng.choice("ab") for _ in range(400)), "\n".join(["- item of a list"] * 50), out[20], out[20]]
    unit = [f"u{rng.randrange(3000)}" for _ in range(700)]
    return [*out, " ".join(["lead"] + unit * 5 + ["tail"]), " ".join((["x", "y"] * 40 + ["z"]) * 6), "same " * 3000]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_several_texts_at_once(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(30):
        q = int(rng.integers(1, 80))
        unit = rng.integers(0, 1 + int(rng.integers(1, 9)), q)
        rows.append(np.concatenate([rng.integers(0, 9, int(rng.integers(0, 9))), np.resize(unit, int(q * rng.uniform(1, 9))), rng.integers(0, 9, int(rng.integers(0, 9)))]))
    first = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    start, length, period = pr.find_runs(np.concatenate(rows).astype(np.uint64), first)
    got = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    assert got == [(s + int(lo), n, q) for lo, r in zip(first, rows, strict=False) for s, n, q in brute_runs(r.tolist())]
    assert len(got) > 10


def test_operator_on_awkward_rows(docs_of):
    rows = list(enumerate(texts())) + [(None, "a a a a a a"), (3, "one")]
    got = pr.periodic_runs(docs_of(rows)).select("carried.*", "runs", "collapsed").collect()
    assert len(got) == len(rows) and "places" in got[0]
    want = {}
    for i, t in rows:
        w, runs = words_of(t), brute_runs(words_of(t))
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i] = (runs, " ".join(x for k, x in enumerate(w) if k not in gone))
    for r in got:
        assert ([tuple(x) for x in r.runs], r.collapsed) == want[r.doc_id]
    assert pr.periodic_runs(docs_of([])).count() == 0


def test_query_equals_brute_force(spark, docs_of, tmp_path):
    rows = [(17 * i + 3, t) for i, t in enumerate(texts() * 3)] + [(10**12, "b " * 7)]
    docs_of([*rows, rows[5], (None, None), (None, "a a a a a a")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes[:8]] == ["bigint"] * 6 + ["string"] * 2
    want = [expected(i, t) for i, t in [*rows, rows[5]]]
    got = [tuple(r)[:8] for r in got.collect()]
    assert sorted(map(str, (r for r in got if r[0] is not None))) == sorted(map(str, want))
    assert sorted(r[1] for r in got if r[0] is None) == [0, 1]


def test_query_on_the_small_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[:8] for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        if len(t or "") < 20000:
            assert got[i] == expected(i, t)
