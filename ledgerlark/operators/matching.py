"""Many names in many texts: containment by one automaton or by first characters (J11, J20, T13-T14, U02), and words by the best path over a dictionary."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of so many characters in all are searched by an automaton that every task builds (some 100 bytes a character); more are met by their first characters.
AUTOMATON = 1_000_000
#: Names that stand as whole words, in the strict sense.
WORDLIKE = r"^[a-z0-9 .\-]+$"
_FOUND = "text_id {kind}, name string, pos long, word_pos long"


def _automaton(names: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for name in names:
        automaton.add_word(name, name)
    automaton.make_automaton()
    return automaton


def _wordy(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def _search(names: list[str], wordlike: set[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(names)
        for batch in batches:
            at, found, first, word = [], [], [], []
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                places: dict[str, list[int | None]] = {}
                for end, name in automaton.iter(text or ""):
                    start = end - len(name) + 1
                    own = places.setdefault(name, [start + 1, None])
                    if own[1] is None and (name not in wordlike or not (start and _wordy(text[start - 1])) and not (end + 1 < len(text) and _wordy(text[end + 1]))):
                        own[1] = start + 1
                for name, (pos, word_pos) in places.items():
                    at.append(i)
                    found.append(name)
                    first.append(pos)
                    word.append(word_pos)
            ids = batch.column(batch.schema.get_field_index("text_id")).take(pa.array(at, pa.int64()))
            yield pa.record_batch([ids, pa.array(found, pa.string()), pa.array(first, pa.int64()), pa.array(word, pa.int64())], names=["text_id", "name", "pos", "word_pos"])

    return run


def _by_first_characters(texts: DataFrame, names: DataFrame) -> DataFrame:
    """A text holds a name only if it holds the name's first three characters (all of a shorter one): they meet on those."""
    # A look-ahead finds overlapping stretches in one pass, whatever the width of the characters.
    heads = [F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 2, 3)]
    said = texts.select("text_id", "text", F.explode(F.array_distinct(F.concat(*heads))).alias("head"))
    keyed = names.withColumn("head", F.substring("name", 1, 3))
    met = said.join(keyed.hint("merge"), "head").withColumn("pos", F.instr("text", F.col("name")).cast("long")).where("pos > 0")
    quoted = F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E"))
    alone = F.concat(F.lit(r"(?<![a-z0-9])"), quoted, F.lit(r"(?![a-z0-9])"))
    word = F.when(~F.col("name").rlike(WORDLIKE), F.col("pos")).otherwise(F.expr("regexp_instr(text, _alone)"))
    placed = met.withColumn("_alone", alone).withColumn("word_pos", word.cast("long"))
    return placed.select("text_id", "name", "pos", F.when(F.col("word_pos") > 0, F.col("word_pos")).alias("word_pos"))


def contained(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text_id, name, pos, word_pos: each name (in lower case) that a text holds in lower case, with its first place.

    ``texts`` has text_id and text, ``names`` name. Any length counts, one character and places inside a longer word too. word_pos is the first
    place where no Latin letter or digit stands beside a name of such (null: nowhere), and pos for other names. Places count from 1. Null and
    empty texts and names meet nothing. Names whose characters are counted to be AUTOMATON at most are searched by an automaton in one
    pass over each text; more of them meet the texts by their first characters, in a join. Rows that repeat a text_id are each searched.
    """
    kept = names.select(F.lower("name").alias("name")).where("name <> ''").distinct()
    low = texts.select("text_id", F.lower("text").alias("text")).where("text <> ''")
    count, size = kept.agg(F.count(F.lit(1)), F.sum(F.length("name"))).first()
    if (size or 0) > AUTOMATON:
        return _by_first_characters(low, kept)
    rows = kept.select("name", F.col("name").rlike(WORDLIKE).alias("wordlike")).collect()
    schema = _FOUND.format(kind=low.schema["text_id"].dataType.simpleString())
    if not count:
        return texts.sparkSession.createDataFrame([], schema)
    return low.mapInArrow(_search([r.name for r in rows], {r.name for r in rows if r.wordlike}), schema)


# ---- words -----------------------------------------------------------------

#: Runs of characters that are written without blanks.
CJK = "[一-鿿]+"
#: The most words of a dictionary (the most frequent ones) that tasks hold; some 200 bytes each.
WORDS = 200_000


def dictionary(
    texts: DataFrame, names: DataFrame | None = None, script: str = CJK, longest: int = 4, least: int = 5, cohesion: float = 1.5, freedom: float = 0.7, limit: int = WORDS
) -> DataFrame:
    """word, weight: the words of a segmenter for runs of a ``script``, from corpus counts and a table of names.

    A stretch of 2 to ``longest`` characters is a word if it occurs ``least`` times or more; if in every cut in two its parts meet ``e ** cohesion``
    times as often as by chance; and if what stands before it and after it varies, with an entropy of ``freedom`` or more (an end of a run is a
    neighbour of its own). Single characters are words. Names (their runs of the script) are words in any case, as frequent as the most
    frequent longer stretch. Weights are logarithms of shares. Of more than ``limit`` words the most frequent are kept. Counts are
    partial before each shuffle.
    """
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(script), F.lit(0))).alias("run"))
    grams = runs.select(F.explode(F.flatten(F.array(*(F.regexp_extract_all("run", F.lit(f"(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, longest + 2))))).alias("word"))
    counts = grams.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.length("word"))
    total = counts.where("size = 1").agg(F.sum("n").alias("total"))
    long = counts.where(f"size BETWEEN 2 AND {longest} AND n >= {least}")
    cuts = long.select("word", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    halves = cuts.select("word", "n", F.expr("left(word, cut)").alias("a"), F.expr("substring(word, cut + 1)").alias("b"))
    a, b = (counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")).hint("merge") for c in ("a", "b"))
    chance = halves.join(a, "a").join(b, "b").crossJoin(F.broadcast(total)).withColumn("pmi", F.log(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))))
    held = chance.groupBy("word").agg(F.first("n").alias("n"), F.min("pmi").alias("pmi")).where(F.col("pmi") >= cohesion)

    def beside(word: str, name: str) -> DataFrame:
        more = F.sum(F.col("n") * F.log("n"))
        return counts.where("size > 1").groupBy(F.expr(word).alias("word")).agg(more.alias(name)).hint("merge")

    free = held.join(beside("left(word, size - 1)", "after"), "word", "left").join(beside("substring(word, 2)", "before"), "word", "left")
    entropy = lambda c: F.log("n") - F.coalesce(F.col(c), F.lit(0.0)) / F.col("n")
    words = counts.where("size = 1").select("word", "n").unionByName(free.where((entropy("after") >= freedom) & (entropy("before") >= freedom)).select("word", "n"))
    if names is not None:
        said = names.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit(script), F.lit(0))).alias("word")).where("length(word) > 1").distinct()
        top = counts.agg(F.coalesce(F.max(F.when(F.col("size") > 1, F.col("n"))), F.lit(1)).alias("n"))
        words = words.unionByName(said.crossJoin(F.broadcast(top))).groupBy("word").agg(F.max("n").alias("n"))
    kept = words.orderBy(F.desc("n"), "word").limit(limit)
    share = F.log(F.col("n") / F.greatest(F.col("total"), F.lit(1)))
    return kept.crossJoin(F.broadcast(total.select(F.coalesce("total", F.lit(1)).alias("total")))).select("word", share.alias("weight"))


def best_path(run: str, automaton, least: float) -> list[str]:
    """The cut of a run into words of greatest total weight; of equal cuts the one whose last word is the longest, and so on backwards.

    A character that is no word weighs ``least``.
    """
    ends: list[list[tuple[int, float]]] = [[] for _ in run]
    if automaton is not None:
        for end, (length, weight) in automaton.iter(run):
            ends[end].append((length, weight))
    total, taken = [0.0], [0]
    for end, words in enumerate(ends):
        best = max([(total[end + 1 - n] + w, n) for n, w in words] + ([] if any(n == 1 for n, _ in words) else [(total[end] + least, 1)]))
        total.append(best[0])
        taken.append(best[1])
    out, at = [], len(run)
    while at:
        out.append(run[at - taken[at] : at])
        at -= taken[at]
    return out[::-1]


def _cut(words: list[tuple[str, float]], column: str, script: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import regex

        automaton = ahocorasick.Automaton() if words else None
        for word, weight in words:
            automaton.add_word(word, (len(word), weight))
        if words:
            automaton.make_automaton()
        least = min((w for _, w in words), default=0.0) - math.log(2)
        pattern = regex.compile(f"({script})|[a-z0-9]+")
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index(column)).to_pylist():
                said = []
                for m in pattern.finditer((text or "").lower()):
                    said += best_path(m[0], automaton, least) if m[1] else [m[0]]
                out.append(said)
            names = [n for n in batch.schema.names if n != "said"]
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(out, pa.list_(pa.string()))], names=[*names, "said"])

    return run


def segmented(texts: DataFrame, words: DataFrame, column: str = "text", script: str = CJK) -> DataFrame:
    """The rows of ``texts`` with ``said``: words in the order of the text; runs of the script are cut by the best path over ``words``, Latin words and digits stay whole.

    ``words`` is a ``dictionary`` of at most WORDS rows (checked). A null or empty text has no words; a column named said is replaced.
    """
    table = words.limit(WORDS + 1).collect()
    if len(table) > WORDS:
        raise ValueError(f"a dictionary has at most {WORDS} words")
    rest = texts.drop("said")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    return rest.mapInArrow(_cut([(r.word, r.weight) for r in table], column, script), f"{schema}, said array<string>")
