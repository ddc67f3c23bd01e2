"""License scans against plain searches of the phrases and short mentions, and on edited copies of the notices."""

import random
import re

import pytest

from ledgerlark.llm import license_scan as ls
from ledgerlark.llm.queries import QUERIES


def words_of(t):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def places(w, phrase):
    p = words_of(phrase)
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def base(text):
    w = words_of(text)
    found = sorted((i, label) for label, phrase in ls.PHRASES for i in places(w, phrase))
    labels = ",".join(sorted({label for _, label in found}))
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, labels


def short_labels(text):
    """Labels of the phrases and of the templates that must be met whole."""
    w = words_of(text)
    return {label for label, t in [*ls.PHRASES, *ls.TEMPLATES] if len(words_of(t)) < ls.WHOLE and places(w, t)}


FILLER = [f"f{i}" for i in range(50)] + ["license", "software", "the", "version", "été", "公共"]
LONG = [(label, t) for label, t in ls.TEMPLATES if len(words_of(t)) >= ls.WHOLE]


def filler(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


def awkward():
    rng = random.Random(12)
    rows = [None, "", " \n,;", "cc", "CC BY", "cc-by-nc", "CC BY-NC CC_BY_NC", "cc by nc " * 400, "under the mit license " * 3]
    rows += [filler(rng, rng.randrange(60)) + rng.choice([" ", ".\n", " (", "é "]) + t + " " + filler(rng, rng.randrange(30)) for _, t in [*ls.PHRASES, *ls.TEMPLATES]]
    rows += ["GNU General Public License, version 2 or version 3", "public license version 2 gnu general public", "İ cc by nc K"]
    rows += [" ".join(filler(rng, 40) + " " + t for _, t in rng.sample(ls.TEMPLATES, 8)), filler(rng, 120000) + " Apache License, Version 2.0 " + filler(rng, 50)]
    return [*rows, rows[12]]


def test_query_on_awkward_rows(spark, docs_of, tmp_path):
    rows = [(i * 7, t) for i, t in enumerate(awkward())]
    docs_of([*rows, rows[6], (None, "cc by nc"), (None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_license_scan"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert [t for _, t in got.dtypes[:8]] == ["bigint"] * 5 + ["string"] * 2 + ["double"]
    got = got.collect()
    assert len(got) == len(rows) + 3 and sorted(r.n_base for r in got if r.doc_id is None) == [0, 1]
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None:
            assert tuple(r)[1:6] == base(texts[r.doc_id])
            labels = set(filter(None, r.labels.split(",")))
            assert r.labels == ",".join(sorted(labels)) and set(filter(None, r.base_labels.split(","))) <= labels
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)
    docs_of([]).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert QUERIES["op12_license_scan"](spark, f"{tmp_path}/empty").count() == 0


def test_short_mentions_equal_a_plain_search(docs_of):
    rng = random.Random(3)
    pieces = [*(t for _, t in [*ls.PHRASES, *ls.TEMPLATES] if len(words_of(t)) < ls.WHOLE), "public license", "version 2", "cc by", "gnu"]
    rows = [(i, " ".join(rng.choice(pieces) if rng.random() < 0.3 else filler(rng, 2) for _ in range(rng.randrange(40)))) for i in range(200)]
    for r in ls.license_spans(docs_of(rows)).select("carried.doc_id", "places", "spans").collect():
        assert {s.label for s in [*r.places, *r.spans]} == short_labels(rows[r.doc_id][1])
        assert all(a.end <= b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


@pytest.mark.parametrize("share, found", [(0.0, True), (0.03, True), (0.3, False)])
def test_edited_notices(docs_of, share, found):
    """Words changed, left out or put in at random: up to a few are found, a third of all is not."""
    rng, rows, label_of = random.Random(8), [], {}
    for label, t in LONG:
        w = [w for w in words_of(t)]
        for at in sorted(rng.sample(range(len(w)), round(share * len(w))), reverse=True):
            w[at : at + 1] = rng.choice([[], ["other"], [w[at], "extra"]])
        label_of[len(rows)] = label
        rows.append((len(rows), filler(rng, 30) + "\n * " + "\n * ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + " " + filler(rng, 30)))
    got = {r.doc_id: r for r in ls.license_spans(docs_of(rows)).select("carried.doc_id", "spans").collect()}
    for i, label in label_of.items():
        long = [s for s in got[i].spans if s.end - s.start >= ls.WHOLE]
        assert [s.label for s in long] == ([label] if found else [])
        if found:
            assert abs(long[0].start - 30) <= 3 and long[0].likeness >= (1.0 if share == 0 else 0.8)


def test_small_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_license_scan"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        assert tuple(got[i])[1:6] == base(t)
        assert set(filter(None, got[i].labels.split(","))) == short_labels(t)
