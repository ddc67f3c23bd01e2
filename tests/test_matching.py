"""Names in texts against a plain search, and words against every possible cut."""

import itertools
import math
import random

import pytest

from ledgerlark.operators import matching as M
from ledgerlark.operators import search as R

TEXTS = [
    (1, "my iphone broke"), (2, "老板说三文鱼Poke今天断供，饭还有"), (3, "Phone phone2 PHONE."), (4, ""), (5, None), (6, "a+b (c) a.b a\nb"), (7, "鱼"), (8, "x" * 3000 + "phone"), (9, "牛肉poke和三文鱼"), (9, "饭"), (10, "É é A-B c d"),
]
NAMES = ["phone", "iPhone", "鱼", "三文鱼", "三文鱼poke", "饭", "a.b", "a b", "(c)", "b", "é", "", None, "nowhere", "phone2", "a-b", "\\E", "c d"]


def boundary(t, p, n):
    word = lambda c: "a" <= c <= "z" or "0" <= c <= "9"
    return not (p and word(t[p - 1])) and not (p + n < len(t) and word(t[p + n]))


def plain(texts, names):
    import re

    out = []
    for i, text in texts:
        t = (text or "").lower()
        for name in {n.lower() for n in names if n}:
            places = [p for p in range(len(t)) if t.startswith(name, p)]
            if places:
                strict = [p + 1 for p in places if not re.match(M.WORDLIKE, name) or boundary(t, p, len(name))]
                out.append((i, name, places[0] + 1, strict[0] if strict else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [M.AUTOMATON, 0])
def test_contained_equals_a_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(M, "AUTOMATON", limit)
    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert sorted((tuple(r) for r in M.contained(texts, names).collect()), key=str) == plain(TEXTS, NAMES)
    assert M.contained(texts, names.limit(0)).count() == M.contained(texts.limit(0), names).count() == 0


def test_contained_over_all_documents_and_aliases(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS text_id", "text")
    names = spark.read.parquet(f"{sf_dir}/benchmark.parquet").selectExpr("explode(split(text, ' ')) AS name").where("length(name) > 0")
    got = sorted((tuple(r)[:3] for r in M.contained(docs, names).collect()), key=str)
    assert got == [r[:3] for r in plain([tuple(r) for r in docs.collect()], [r.name for r in names.collect()])]


def test_aliases_inside_words_and_of_one_character(spark):
    texts = spark.createDataFrame(TEXTS, "text_id long, text string")
    aliases = spark.createDataFrame([("Phone", "phone"), ("Fish", "鱼"), ("Fish", "三文鱼"), ("Rice", "饭")], "canonical string, alias string")
    got = sorted((r.text_id, r.canonical, r.pos) for r in R.mentions(texts, aliases).collect())
    assert got == [(1, "Phone", 5), (2, "Fish", 4), (2, "Rice", 16), (3, "Phone", 1), (7, "Fish", 1), (8, "Phone", 3001), (9, "Fish", 8), (9, "Rice", 1)]
    strict = {(r.text_id, r.canonical) for r in R.strict_mentions(texts, aliases).collect()}
    assert strict == {(i, c) for i, c, _ in got} - {(1, "Phone"), (8, "Phone")}


def every_cut(run):
    for marks in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(at)]


def test_best_path_equals_every_cut():
    import ahocorasick

    rng = random.Random(2)
    for _ in range(200):
        words = {"".join(rng.choice("天地人和") for _ in range(rng.randrange(1, 5))): -rng.uniform(1, 9) for _ in range(rng.randrange(1, 14))}
        automaton = ahocorasick.Automaton()
        for w, weight in words.items():
            automaton.add_word(w, (len(w), weight))
        automaton.make_automaton()
        run, least = "".join(rng.choice("天地人和") for _ in range(rng.randrange(1, 9))), -9.7
        weigh = lambda cut: sum(words.get(w, least if len(w) == 1 else -math.inf) for w in cut)  # noqa: E731, B023
        assert weigh(M.best_path(run, automaton, least)) == pytest.approx(max(map(weigh, every_cut(run))))


def test_dictionary_and_search_in_chinese(spark):
    rng = random.Random(4)
    nouns, verbs, others = ["三文鱼", "牛肉饭", "照烧", "冷藏柜", "营业额"], ["断供", "上涨", "下架", "检查"], list("的了在和与及也")
    lines = ["".join(rng.choice(nouns) + rng.choice(others) + rng.choice(verbs) + rng.choice(others) for _ in range(rng.randrange(1, 4))) for _ in range(600)]
    texts = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    words = M.dictionary(texts, spark.createDataFrame([("巨无霸套餐 Big",)], "name string"))
    found = {r.word for r in words.collect()}
    assert set(nouns + verbs) | {"巨无霸套餐"} <= found and not {"鱼断", "文鱼", "饭的"} & found
    cut = M.segmented(spark.createDataFrame([(1, "三文鱼断供了，巨无霸套餐 is OK2 龘"), (2, None), (3, "")], "id long, text string"), words)
    assert {r.id: r.said for r in cut.collect()} == {1: ["三文鱼", "断供", "了", "巨无霸套餐", "is", "ok2", "龘"], 2: [], 3: []}
    # A question meets whole words only: pairs of neighbours would also meet chunks that share none.
    chunks = spark.createDataFrame([("a", 1, "三文鱼断供"), ("b", 2, "文鱼的饭断"), ("c", 3, "牛肉饭上涨")], "chunk_id string, doc_id long, text string")
    question = spark.createDataFrame([(7, "三文鱼")], "query_id long, text string")
    assert {r.chunk_id for r in R.bm25(question, R.Index.build(chunks, words=words)).collect()} == {"a"}
    assert {r.chunk_id for r in R.bm25(question, chunks).collect()} == {"a", "b"}
    assert M.dictionary(texts.limit(0)).count() == 0 and M.segmented(texts.limit(3), words.limit(0)).first().said[0] in "".join(lines)


def test_top_chunks_lose_nothing(spark):
    """Against scoring every chunk: equal scores, ties, questions with few or no hits, words that stand everywhere."""
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    lines = [(f"{d}#{i}", d, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for d in range(150) for i in range(rng.randrange(1, 6))]
    lines += [(f"{d}#0", d, lines[d][2]) for d in range(150, 190)]
    chunks = spark.createDataFrame(lines, "chunk_id string, doc_id long, text string")
    asked = [(q, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for q in range(60)] + [(100, "nowhere"), (101, ""), (102, lines[3][2]), (103, "w1 w1 w2")]
    questions = spark.createDataFrame(asked, "query_id long, text string")
    index = R.Index.build(chunks)
    for k in (1, 5):
        want = R.top_k(R.best_chunks(R.with_prior(R.bm25(questions, index))), k)
        columns = ["query_id", "doc_id", "chunk_id", "score", "rank"]
        got = R.top_chunks(questions, index, k).select(*columns).collect()
        assert sorted(got) == sorted(want.select(*columns).collect()) and len(got) > 55 * k


def test_a_refreshed_index_equals_a_new_one(spark):
    rng = random.Random(9)
    line = lambda: " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(0, 9)))
    before = [(f"{d}#{i}", d, line()) for d in range(200) for i in range(rng.randrange(1, 4))]
    after = [(c, d, line() if d % 50 == 1 else t) for c, d, t in before if d % 40 != 2] + [("900#0", 900, "new words here"), ("7#9", 7, "one more chunk")]
    schema = "chunk_id string, doc_id long, text string"
    old, now = spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)
    got, want = R.Index.build(old).refreshed(now), R.Index.build(now)
    for table in ("postings", "terms", "stats", "blocks", "docs"):
        a, b = getattr(got, table), getattr(want, table)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect())), table
    # Only changed documents are tokenised: where nothing changed, a dictionary that would fail is never used.
    broken = R.Index(want.postings, want.terms, want.stats, want.blocks, want.docs, spark.createDataFrame([("w", 0.0)], "word string, weight double"))
    assert broken.refreshed(now).postings.count() == want.postings.count()
    assert R.Index.build(old).refreshed(now.limit(0)).postings.count() == 0
