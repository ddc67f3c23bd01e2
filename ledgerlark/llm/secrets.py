"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns find assignments, access identifiers and long hex strings. Weak parts - an
identifier, a short or unassigned secret, an endpoint - mean nothing alone; intervals around
them are joined within a document, and a part is reported only where complementary parts
stand within the same scope.

Positions come from text itself: each pattern's matches are fenced by two private-use marks,
the text is split at the marks, and running sums of the pieces' lengths give code points. The
exploded rows hold lengths, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: The base patterns (an assignment's value is group 2) and the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

#: Weak parts of a credential: who, what and where.
WHO = r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WHAT = r"""(?i:pass|pwd|private_?key|client_?secret|secret_?access_?key|auth|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
WHERE = r"""(?i:https?|postgres|mysql|mongodb|redis|amqp|ftp|ssh)://[A-Za-z0-9@:._/-]{4,}|(?i:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""

KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("id", WHO), ("key", WHAT), ("endpoint", WHERE)]
BASE = 3
#: Which role each kind plays in a credential.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "id": "identifier", "key": "secret", "endpoint": "endpoint"}
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ue002"


#: A text without any of a kind's words (in lower case) cannot match it; plain searches cost far less than patterns.
WORDS = {
    "assign": ["passw", "secret", "token", "api"],
    "id": ["client", "access", "account", "user", "login"],
    "key": ["pass", "pwd", "private", "client", "secret", "auth", "credential"],
    "endpoint": ["://", "host", "endpoint", "server", "url"],
}
LONG_HEX, LONG_ACCESS = f"[0-9a-f]{{{HEX_LEAST},}}", f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"


def _any(text: Column, words: list[str]) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def worth_scanning() -> Column:
    """False only for texts that no kind can match: without a separator, an access prefix and a long hex string."""
    text = F.col("text")
    return text.contains("=") | text.contains(":") | text.contains("AKIA") | text.rlike(LONG_HEX)


def _found(kind: str, pattern: str, order: int, text: Column) -> Column:
    """Pieces of a text between fences: every second one is a match. Null where the pattern finds nothing."""
    search = {"hex": LONG_HEX, "access": LONG_ACCESS}.get(kind, pattern)
    fenced = F.regexp_replace(text, search, f"{_OPEN}$0{_CLOSE}")
    pieces = F.split(fenced, f"[{_OPEN}{_CLOSE}]")

    def row(piece: Column, i: Column) -> Column:
        ok = i % 2 == 1
        if kind == "assign":
            ok = ok & (F.length(F.regexp_extract(piece, pattern, 2)) >= ASSIGN_LEAST)
        return F.struct(F.lit(order).alias("kind"), i.alias("i"), F.length(piece).cast("long").alias("n"), ok.alias("ok"))

    may = _any(F.col("lowered"), WORDS[kind]) if kind in WORDS else text.contains("AKIA") if kind == "access" else F.lit(True)
    return F.when(may, F.when(text.rlike(search), F.transform(pieces, row)))


def spans(docs: DataFrame, scope: int = 300) -> DataFrame:
    """(doc_key, kind, start, end, base): spans of secrets in each text, in code points, end exclusive.

    ``docs`` has doc_key (one value for one text) and text. ``base`` marks the three base kinds;
    of the others, a part is kept only if a part of another role lies within ``scope`` code
    points, and an endpoint only if an identifier and a secret both do. Leftmost matches of one
    kind do not overlap; kinds may. Rows with a null or empty text have none.
    """
    marks = F.col("text").contains(_OPEN) | F.col("text").contains(_CLOSE)
    safe = F.when(marks, F.translate(F.col("text"), _OPEN + _CLOSE, _OTHER * 2)).otherwise(F.col("text"))
    few = docs.where(worth_scanning()).select("doc_key", safe.alias("text")).withColumn("lowered", F.lower("text"))
    text = F.col("text")
    marked = few.select("doc_key", F.flatten(F.array_compact(F.array(*(_found(k, p, i, text) for i, (k, p) in enumerate(KINDS))))).alias("pieces"))
    rows = marked.where(F.size("pieces") > 0).select("doc_key", F.explode("pieces").alias("p")).select("doc_key", "p.*").distinct()
    before = Window.partitionBy("doc_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum("n").over(before)).where("ok").select("doc_key", "kind", (F.col("end") - F.col("n")).alias("start"), "end")
    # Written once: the joins below read the spans several times, and texts must be searched once.
    placed = materialize(placed, "spans")
    # Interval join: a part meets the buckets its scope touches, a neighbour lies in each that it touches, however long it is.
    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k, _ in KINDS)), F.col("kind") + 1)
    parts = placed.withColumn("role", role)
    touched = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    near = parts.select("doc_key", F.explode(touched).alias("bucket"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("role").alias("r")).distinct()
    in_scope = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    weak = parts.where(F.col("kind") >= BASE)
    reach = weak.withColumn("bucket", F.explode(in_scope))

    def beside(rows: DataFrame, wanted: Column) -> DataFrame:
        n = near.hint("merge")
        on = (rows["doc_key"] == n["doc_key"]) & (rows["bucket"] == n["bucket"]) & (n["s"] <= rows["end"] + scope) & (n["e"] >= rows["start"] - scope) & wanted
        return rows.join(n, on, "left_semi")

    keys = ["doc_key", "kind", "start", "end"]
    paired = beside(reach.where("role <> 'endpoint'"), F.col("r") == F.when(F.col("role") == "secret", "identifier").otherwise("secret")).select(*keys).distinct()
    hosts = reach.where("role = 'endpoint'")
    with_secret = beside(hosts, F.col("r") == "secret").select(*keys).distinct()
    with_both = beside(with_secret.withColumn("bucket", F.explode(in_scope)), F.col("r") == "identifier").select(*keys).distinct()
    every = placed.where(F.col("kind") < BASE).select(*keys).unionByName(paired).unionByName(with_both)
    return every.withColumn("base", F.col("kind") < BASE)


def _doc_key() -> Column:
    """A name of a row's id and text; 128 bits of the text, so that equal names mean equal texts in practice."""
    return F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit("second"), "text")))


def scan(docs: DataFrame, scope: int = 300) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text, ...), with ``found``: array of (start, kind, end) sorted by start, then kind.

    Kinds are numbered as in KINDS. A null or empty text finds nothing; rows that repeat a doc_id
    and a text find the same; a column of the input already named ``found`` is replaced; an empty
    table gives an empty result. Texts are not shuffled for the search, only once to meet
    their spans, and only those of documents that have any.
    """
    names = [c for c in docs.columns if c != "found"]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), _doc_key().alias("doc_key"))
    found = spans(docs.select(_doc_key().alias("doc_key"), F.col("text").cast("string").alias("text")).where("text is not null"), scope)
    lists = found.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    none = F.array().cast(lists.schema["found"].dataType)
    return keyed.join(lists.hint("merge"), "doc_key", "left").select("row.*", F.coalesce("found", none).alias("found"))


def listing(found: Column, base_only: bool) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*(F.lit(k) for k, _ in KINDS))
    kept = F.filter(found, lambda s: s["kind"] < BASE) if base_only else found
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = 300) -> DataFrame:
    """``docs`` with every span of ``scan`` replaced by ``mark`` in its text; spans that touch or overlap get one mark.

    Texts without spans stay as they are. Other columns pass through.
    """
    seen = scan(docs, scope)
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] > acc["at"]
        first = (acc["at"] == 0) & (s["start"] == 0)
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).when(first & (acc["out"] == ""), F.concat(acc["out"], F.lit(mark))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("found", empty, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.length("text"))))
    text = F.when(F.size("found") > 0, done).otherwise(F.col("text"))
    return seen.withColumn("text", text).drop("found")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document.

    A null or empty text has none, and the digest of the empty string; repeated rows, and rows without an id, are each returned; other
    columns are ignored; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = docs.select("doc_id", _doc_key().alias("doc_key"))
    found = spans(docs.select(_doc_key().alias("doc_key"), "text").where("text is not null"))
    lists = found.groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    rows = keyed.join(lists.hint("merge"), "doc_key", "left")
    count = lambda kind: F.coalesce(F.size(F.filter("found", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")
    some = F.coalesce(F.col("found"), F.array().cast(lists.schema["found"].dataType))
    rows = rows.withColumn("found", some)
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listing(F.col("found"), True), 256).alias("base_sha256"),
        listing(F.col("found"), False).alias("spans"),
    )


__all__ = ["KINDS", "listing", "op7_secret_scan", "redact", "scan", "spans"]
