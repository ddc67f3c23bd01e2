"""Every registered query of the corpus operators on small tables of awkward rows: columns, types and rows of the contracts."""

import random
import re

import pytest

from ledgerlark.llm import secrets
from ledgerlark.llm.queries import QUERIES

pipeline = pytest.importorskip("corpus_pipeline")
R = random.Random(21)
WORDS = [f"w{i}" for i in range(300)] + ["naïve", "日本", "token", "x" * 40]

CONTRACTS = {
    "op1": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4": "page_id bigint, url string, text string, n_chars bigint",
    "op5": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6": "doc_id bigint, fingerprint string, component_id bigint",
    "op7": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op8": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op11": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op13": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def tables(spark, folder, documents, pages, conversations):
    docs = [(i, t, lang, source, None if t is None else len(t), "clash", 7, [1]) for i, t, lang, source in documents]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, fp string, dk int, row array<int>").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(len(t or "") > 400), 0) for i, t, _, _ in documents if i is not None and i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", h, "clash") for i, h in pages], "page_id long, url string, html string, text string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(*c, "clash") for c in conversations], "conv_id long, turn long, role string, text string, path string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    base = [prose(R.randrange(60, 200)) for _ in range(40)]
    texts = [*base, None, "", " \n\t", "one", base[0], base[1] + " tail", base[2].upper(), "same " * 300, prose(160_000), 'password = "abcdefgh12345678" user=alice', "Released under the MIT License.", "é" * 5000]
    documents = [(i, t, R.choice(["en", "de", None]), R.choice(["a", "b", None])) for i, t in enumerate(texts)]
    documents += [documents[4], documents[4], (None, "no id", "en", "a"), (None, None, None, None), (5, "another text of an id that is taken", "en", "a")]
    pages = [(0, None), (1, ""), (2, "<p>" + prose(30)), (2, "<p>" + prose(30)), (None, "<article><p>x</p></article>"), (3, "<div>" * 3000 + prose(20))]
    conversations = [(c, t, R.choice(["user", None]), R.choice(["a", "b", None, ""])) for c in range(30) for t in (None, 0, 1)] + [(None, 0, "user", "x"), (7, 1, "user", "again"), (7, 1, "user", "again")]
    assert max(len(t or "") for t in texts) > 500_000
    return tables(spark, tmp_path_factory.mktemp("awkward"), documents, pages, conversations), len(documents), len(pages)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [], [], [])


@pytest.mark.parametrize("name", list(QUERIES))
def test_contract(spark, awkward, name):
    folder, n_docs, n_pages = awkward
    got = QUERIES[name](spark, folder)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes).startswith(CONTRACTS[name.split("_")[0]])
    n = got.count()
    if name.startswith("op2"):
        assert n > n_docs
    elif name.startswith("op13"):
        assert n > 1
    else:
        assert n == (n_pages if name.startswith("op4") else n_docs)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op9_")])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline_on_awkward_rows(spark, awkward):
    got = pipeline.run(spark, awkward[0])
    assert got.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = got.collect()
    # Rows that the base fails are gone, of copies one stays, and what is left is packed without gaps.
    ids = {r.doc_id for r in rows}
    assert ids and not ids & {40, 41, 42, 43, 44, 46, 47} and len(ids & {1, 45}) == 1
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048


def test_pipeline_on_an_empty_table(spark, empty):
    assert pipeline.run(spark, empty).count() == 0


# ---- a second scanner ------------------------------------------------------


def plain_scan(text, scope=300):
    """Kinds, starts and ends by Python's own search, parts linked by looking at every pair."""
    found = []
    for kind, (_, pattern) in enumerate(secrets.KINDS):
        for m in re.finditer(pattern, text or ""):
            least = {0: len(m.group(2)) >= 8 if kind == 0 else True, 1: m.end() - m.start() >= 16, 2: m.end() - m.start() >= 32}.get(kind, True)
            if least:
                found.append((m.start(), kind, m.end()))
    role = {k: secrets.ROLES[name] for k, (name, _) in enumerate(secrets.KINDS)}
    near = lambda a, wanted: any(role[b[1]] == wanted and b[0] <= a[2] + scope and b[2] >= a[0] - scope for b in found)
    kept = []
    for part in found:
        if part[1] < 3:
            kept.append(part)
        elif role[part[1]] == "endpoint":
            kept += [part] if near(part, "secret") and near(part, "identifier") else []
        elif near(part, {"secret": "identifier", "identifier": "secret"}[role[part[1]]]):
            kept.append(part)
    return sorted(kept)


def test_secrets_equal_a_second_scanner(docs_of):
    rng = random.Random(77)
    parts = ["user=alice", "login: bob", "client_id = 'abc'", "pwd=hunter22", "auth: tokentoken", "https://db.example.com/x", "host=db1.internal", "password = \"s3cretvalue\"", "api_key: AAAABBBBCCCC", "token=x", "AKIA" + "Q" * 16, "0123456789abcdef" * 3, "secret=" + "k" * 900]
    texts = []
    for _ in range(150):
        pieces = []
        for _ in range(rng.randrange(1, 9)):
            pieces += [rng.choice(parts), " é" * rng.choice([0, 3, 40, 149, 151, 400]) + " "]
        texts.append("".join(pieces))
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in secrets.scan(docs_of(list(enumerate([*texts, None, ""])))).select("doc_id", "found").collect()}
    for i, t in enumerate([*texts, None, ""]):
        assert got[i] == plain_scan(t)


def test_secrets_of_documents_equal_a_second_scanner(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in secrets.scan(docs).select("doc_id", "found").collect()}
    for r in docs.collect():
        assert got[r.doc_id] == plain_scan(r.text)
