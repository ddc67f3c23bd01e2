"""Document preparation."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the document rules: estimate types, types by authority, statuses, and marker words of types.
ESTIMATE_TYPES = ["周报", "会议纪要", "复盘", "活动复盘"]
NOTICE_TYPES = ["通知", "政策", "调整"]
REFERENCE_TYPES = ["参考资料", "总表", "名录", "对照表", "文档", "FAQ"]
TYPE_MARKERS = ["周报", "通知", "政策", "手册", "纪要", "报告", "FAQ", "档案", "总表", "名录", "对照表", "邮件", "Email"]
SUPERSEDED_STATUS = "已废止"
_DATE = r"(\d{4})\s*[-/年]\s*(\d{1,2})\s*[-/月]\s*(\d{1,2})"
EFFECTIVE = [r"(?:自|从)\s*" + _DATE + r"\s*日?\s*(?:起|开始)", r"生效(?:日期)?[：: ]\s*" + _DATE, r"(?:执行|实施)(?:日期)?[：: ]\s*" + _DATE, _DATE]
STATUS = r"(?:版本)?状态\s*[：:]\s*(现行|有效|生效|已废止|废止|作废|失效|停用|归档|草稿)"
STATUS_CANON = {"现行": "现行", "有效": "现行", "生效": "现行", "已废止": "已废止", "废止": "已废止", "作废": "已废止", "失效": "已废止", "停用": "已废止", "归档": "归档", "草稿": "草稿"}


@F.pandas_udf(StringType())
def nfkc_lower(text: pd.Series) -> pd.Series:
    """NFKC and lower case; no built-in does NFKC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


@F.pandas_udf(StringType())
def compare_form(text: pd.Series) -> pd.Series:
    """NFKC without white space, zero-width spaces and Markdown signs."""
    gone = re.compile(r"[\s​*`|#>]+")
    return text.map(lambda t: None if t is None else gone.sub("", unicodedata.normalize("NFKC", t)))


@F.pandas_udf(StringType())
def answer_form(text: pd.Series) -> pd.Series:
    """The comparison form, case folded."""
    gone = re.compile(r"[\s​*`|#>]+")
    return text.map(lambda t: None if t is None else gone.sub("", unicodedata.normalize("NFKC", t)).casefold())


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references of HTML."""
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")

    return content.map(one)


def decode_bytes(df: DataFrame, column: str = "content") -> DataFrame:
    """Text and encoding: UTF-8 if valid, else GB18030, else with replacement marks. Only invalid rows reach Python."""
    valid = F.is_valid_utf8(F.col(column).cast("string")) & F.col(column).isNotNull()
    good = df.where(valid).withColumn("text", F.decode(column, "UTF-8")).withColumn("encoding", F.lit("utf-8"))
    bad = df.where(~valid).withColumn("text", _decode_other(column))
    return good.unionByName(bad.withColumn("encoding", F.when(F.col("text").contains("�"), "utf-8-replace").otherwise("gb18030")))


def front_matter(text: str | Column) -> Column:
    """The header between --- lines as a map of keys to values; empty without one."""
    c = F.col(text) if isinstance(text, str) else text
    head = F.regexp_extract(c, r"^---\s*\n([\s\S]*?)\n---\s*\n?", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    return F.map_from_entries(pairs)


def body(text: str | Column) -> Column:
    """The text after the header."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(c, r"^---\s*\n[\s\S]*?\n---\s*\n?", "")


def list_field(value: Column) -> Column:
    """A header value such as [a, b] as an array."""
    return F.filter(F.transform(F.split(F.regexp_replace(value, r"[\[\]]", ""), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")


def visible_text(page: str) -> tuple[Column, Column]:
    """Title and visible text of a page: no scripts, styles and tags, references decoded, blanks joined."""
    c = F.col(page)
    title = F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style|title)[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->", " ")
    return unescape(title), F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")), r"\s+", " "))


def clean_lines(text: str) -> Column:
    """Lines without trailing blanks, empty ones out."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[ \t\r]+$", "")), lambda x: x != ""), "\n")


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams without white space; none for shorter texts."""
    bare = F.regexp_replace(text, r"\s+", "")
    return F.when(F.length(bare) >= n, F.transform(F.sequence(F.lit(1), F.length(bare) - n + 1), lambda i: F.substring(bare, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def has_table(text: str) -> Column:
    """At least two lines that start with a pipe."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.ltrim(x).startswith("|"))) >= 2


def table_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Header and cells of each Markdown table row: doc_id, line, header, cells."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    row = F.trim("raw")
    is_row = row.startswith("|")
    cells = F.transform(F.split(F.regexp_replace(row, r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    marked = lines.withColumn("is_row", is_row).withColumn("rule", row.rlike(r"^\|[\s:|-]+\|?$")).withColumn("cells", F.when(is_row, cells))
    w = Window.partitionBy("doc_id").orderBy("line")
    starts = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))
    headed = marked.withColumn("starts", starts).withColumn("header", F.last(F.when(F.col("starts"), F.col("cells")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return headed.where("is_row AND NOT starts AND NOT rule").select("doc_id", "line", "header", "cells")


def row_sentence(header: Column, cells: Column) -> Column:
    """A table row as a sentence: tick marks name their column, other cells are key: value."""
    pairs = F.arrays_zip(header.alias("h"), cells.alias("c"))
    said = F.transform(pairs, lambda p: F.when(p["c"].isin("✓", "✔", "√", "有"), p["h"]).when(p["c"].isin("×", "✗", "—", "-", "无", "N/A", ""), F.lit("")).otherwise(F.concat(p["h"], F.lit(": "), p["c"])))
    return F.array_join(F.filter(said, lambda x: x != ""), "; ")


def title_of(text: str) -> Column:
    """The first useful line, cut at 80 characters; a Subject line gives its subject."""
    useful = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^#+", ""))), lambda x: ~x.rlike(r"^[=\-*_ ]*$") & ~x.rlike(r"^(From|To|Cc|Date):"))
    first = F.get(useful, F.lit(0))
    return F.when(first.startswith("Subject:"), F.trim(F.regexp_replace(first, "^Subject:", ""))).when(first.rlike("^标题[：:]"), F.trim(F.regexp_replace(first, "^标题[：:]", ""))).otherwise(F.substring(first, 1, 80))


def type_of(text: str) -> Column:
    """The first marker word in the first 200 characters, else a plain document."""
    head, out = F.substring(text, 1, 200), None
    for word in TYPE_MARKERS:
        out = F.when(head.contains(word), word) if out is None else out.when(head.contains(word), word)
    return out.otherwise("文档")


def effective_from(text: str) -> Column:
    """The first date by the patterns in order: from ... on, effective, carried out, any."""

    def found(pattern: str) -> Column:
        parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
        return F.when(parts[0] != "", F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d"))

    return F.coalesce(*(found(p) for p in EFFECTIVE))


def status_of(text: str) -> Column:
    """An explicit status field, or a sentence that declares the version void."""
    word = F.regexp_extract(text, STATUS, 1)
    names = F.create_map(*(F.lit(x) for pair in STATUS_CANON.items() for x in pair))
    return F.when(word != "", names[word]).when(F.col(text).rlike("本(?:版本|版|文件|通知|方案)已(?:废止|作废|失效)"), SUPERSEDED_STATUS)


def successor_of(text: str) -> Column:
    """The document that replaces this one; it must be named."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"现行版本见\s*(KB-\d+)", r"已(?:被|由)\s*(KB-\d+)\s*取代")))


def stores_in(text: str) -> Column:
    """Distinct store codes in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\b(S\d{1,3})\b"), F.lit(1)), lambda x: F.upper(x))))


def declared_stores(text: str) -> Column:
    """Codes of an explicit scope field; null without one."""
    field = F.regexp_extract(text, r"(?:适用门店|适用范围)\s*[：:]\s*([^\n]*)", 1)
    return F.when(field != "", F.array_sort(F.array_distinct(F.regexp_extract_all(field, F.lit(r"\b(S\d{1,3})\b"), F.lit(1)))))


def metadata(docs: DataFrame) -> DataFrame:
    """Fields by the chain header, text, default, with the source of the chain that served."""
    m = F.col("fm")
    own = lambda k: F.nullif(m[k], F.lit(""))
    out = docs.withColumn("fm", front_matter("text")).withColumn("body", body("text"))
    source = F.when(F.size("fm") > 0, "front_matter").when(effective_from("body").isNotNull() | status_of("body").isNotNull(), "text").otherwise("default")
    return out.select(
        "doc_id",
        F.coalesce(own("title"), title_of("body")).alias("title"),
        F.coalesce(own("type"), type_of("body")).alias("doc_type"),
        F.coalesce(own("status"), status_of("body"), F.lit("现行")).alias("status"),
        F.coalesce(F.try_to_date(own("effective_from"), "yyyy-M-d"), effective_from("body")).alias("effective_from"),
        F.coalesce(own("superseded_by"), successor_of("body")).alias("superseded_by"),
        F.coalesce(list_field(own("stores")), declared_stores("body"), stores_in("body")).alias("stores"),
        (own("stores").isNotNull() | declared_stores("body").isNotNull()).alias("stores_explicit"),
        source.alias("meta_source"),
    )


def authority(doc_type: str = "doc_type", title: str = "title") -> Column:
    """The class of a source."""
    t = F.col(doc_type)
    return (
        F.when(t.isin(*ESTIMATE_TYPES), "background")
        .when(t.isin("词典", "对照表", "别名表"), "dictionary")
        .when(t.isin(*REFERENCE_TYPES), "reference")
        .when(t.isin("通知", "调整"), "notice")
        .when(t.isin("政策", "手册"), "policy")
        .when(F.col(title).rlike("周报|纪要|复盘|反馈汇总"), "background")
        .otherwise("unknown")
    )


def fingerprint(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row that changes with any row: count and the sum of 60-bit prefixes of row hashes; order does not matter."""
    text = F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    prefix = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(prefix), F.lit(0)).cast("decimal(38,0)").cast("string").alias("fingerprint"))


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Whether outputs with a stored fingerprint must be refused."""
    now = current.select(F.col("rows").alias("_r"), F.col("fingerprint").alias("_f"))
    return stored.crossJoin(F.broadcast(now)).select((~(F.col("rows").eqNullSafe(F.col("_r")) & F.col("fingerprint").eqNullSafe(F.col("_f")))).alias("stale"))


#: Versions that a manifest names: a change of rules or of tables makes what was built stale.
MANIFEST_VERSION, CLEANING_VERSION, SCHEMA_VERSION = "1", "v3", "1"


def manifest(prints: dict[str, DataFrame]) -> DataFrame:
    """One row a table of a build: table_name, rows, fingerprint, and the versions of manifest, cleaning and schema."""
    every = None
    for name, one in prints.items():
        row = one.select(F.lit(name).alias("table_name"), "rows", "fingerprint", F.lit(MANIFEST_VERSION).alias("manifest_version"), F.lit(CLEANING_VERSION).alias("cleaning_version"), F.lit(SCHEMA_VERSION).alias("schema_version"))
        every = row if every is None else every.unionByName(row)
    return every


def stale_tables(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The current manifest with whether each table's build must be refused: none is stored, or its print or a version differs."""
    old = stored.select("table_name", *(F.col(c).alias(f"_{c}") for c in ("rows", "fingerprint", "manifest_version", "cleaning_version", "schema_version")))
    same = F.lit(True)
    for c in ("rows", "fingerprint", "manifest_version", "cleaning_version", "schema_version"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return current.join(old.hint("merge"), "table_name", "left").select("table_name", "rows", "fingerprint", "manifest_version", "cleaning_version", (~same).alias("stale"))


# ---- sentences and chunks --------------------------------------------------

SENTENCE = r"[^.!?。！？；;\n]+[.!?。！？；;]*|[.!?。！？；;]+"


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line, pos, sentence: every line is cut after its terminators, blanks trimmed, empty ones out."""
    lines = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    cut = lines.select("doc_id", "line", F.posexplode(F.regexp_extract_all("raw", F.lit(SENTENCE), F.lit(0))).alias("pos", "sentence"))
    return cut.withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


#: Sentences that give orders to an assistant.
STRONG = [
    r"(忽略|无视|忘记|忘掉|放弃|不要理|不用管).{0,10}(之前|以上|上面|先前|前面|所有|一切|原有).{0,8}(指令|规则|提示|设定|要求|限制|约束|指示)",
    r"(?i:ignore\s+(all\s+|any\s+)?(previous|prior|above|earlier|preceding)\s+(instructions?|prompts?|rules?|messages?|directions?))",
    r"(?i:disregard\s+(all\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?))",
    r"(?i:(系统提示|系统指令|系统消息|开发者消息|developer\s+message|system\s*(prompt|message))\s*[:：])",
    r"无论(用户|别人|他|你|对方)?\s*(问|说|要)(什么|啥|什么问题|什么话)",
    r"(?i:whatever\s+(the\s+)?(user|they|someone)\s+(asks?|says?|wants?|requests?))",
    r"(从现在(开始|起)|从此刻(开始|起)|接下来|今后).{0,12}(只回答|只输出|只回复|只作答|只按|回答|输出|回复|作答)",
    r"(?i:from\s+now\s+on.{0,20}(answer|reply|respond|say|output|ignore))",
    r"(你必须|你应该|请你?务必|你务必).{0,8}(回答|输出|回复|作答|忽略|只回答|只输出)",
    r"(?i:(you\s+must|you\s+should|you\s+are\s+to)\s+(answer|reply|respond|output|ignore)\b)",
    r"(?i:(执行|运行|调用|请执行|去执行)\s*.{0,10}\b(drop|delete|truncate|update|insert|alter)\b)",
    r"(?i:\b(call|invoke|execute|run)\b.{0,40}\b(drop|delete|truncate|wipe)\b)",
    r"(?i:\b(drop|truncate)\s+\w*\s*table\b)",
    r"(?i:\b(drop|truncate|delete)\b.{0,30}\b(database|table|tables|records|rows)\b)",
]
#: Sentences that suppress sources, what marks them as business rules, and what takes that mark back.
SUPPRESS = [
    r"(不要|禁止|别|无需|不必|请勿).{0,8}(引用|标注|列出|给出).{0,8}(来源|出处|依据|链接|参考文献)",
    r"(?i:(do\s+not|don'?t|never)\s+(cite|reference|quote)\s+(any\s+)?(source|sources|evidence|reference))",
]
BUSINESS = r"(门店|员工|顾客|客人|商品|库存|排班|考勤|消毒|验收|营业额|销售|报表|报告|供应商|会员|收货|配送|收银|备料|出品|预订|退货|巡检)"
ASSISTANT = r"(?i:(回答|输出|回复|作答|系统提示|系统指令|系统消息|指令|你必须|你应该|ignore|instructions?|system\s+(prompt|message)))"


def instruction_like(sentence: str | Column) -> Column:
    """Strong orders, and orders to hide sources unless they are plainly business rules."""
    c = F.col(sentence) if isinstance(sentence, str) else sentence
    return c.rlike("|".join(STRONG)) | (c.rlike("|".join(SUPPRESS)) & ~(c.rlike(BUSINESS) & ~c.rlike(ASSISTANT)))


def sanitize(docs: DataFrame) -> DataFrame:
    """doc_id, kept text (lines joined) and dropped sentences; sentence order is kept within a document."""
    flagged = sentences(docs).withColumn("bad", instruction_like("sentence"))
    row = F.struct("line", "pos", "sentence")
    lists = flagged.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(~F.col("bad"), row))).alias("k"), F.sort_array(F.collect_list(F.when(F.col("bad"), row))).alias("d"))
    return lists.select("doc_id", F.array_join(F.transform("k", lambda x: x["sentence"]), " ").alias("kept"), F.transform("d", lambda x: x["sentence"]).alias("dropped"))


HARD_SIZE, MERGE_BELOW = 500, 120
#: A task hands on its chunks after so many characters of text, and takes so many documents at once, so its memory does not grow with the table.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 500
_CHUNK = pa.schema({"pos": pa.int32(), "start": pa.int64(), "end": pa.int64(), "heading": pa.string(), "kind": pa.string(), "table_header": pa.list_(pa.string()), "text": pa.string()})


def _pieces(text: str) -> list[str]:
    """Pieces that concatenate to the text: by headings, then blank lines, lines and sentences down to the size; small ones join their neighbour."""
    out: list[str] = []
    for segment in re.split(r"(?m)(?=^#{1,6} )", text):
        stack = [(segment, 0)]
        parts: list[str] = []
        while stack:
            piece, level = stack.pop()
            if len(piece) <= HARD_SIZE or level == 3:
                parts.append(piece)
                continue
            cuts = re.split((r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?。！？；;])")[level], piece)
            stack += [(c, level + 1) for c in reversed(cuts) if c]
        merged: list[str] = []
        for p in parts:
            if merged and (len(merged[-1]) < MERGE_BELOW or len(p) < MERGE_BELOW) and len(merged[-1]) + len(p) <= HARD_SIZE:
                merged[-1] += p
            else:
                merged.append(p)
        out += [m for m in merged if m]
    return out


def _chunk_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "pos", "start", "end", "heading", "kind", "table_header", "text"]
    for pdf in batches:
        rows, held = [], 0
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            at = 0
            for pos, piece in enumerate(_pieces(text or "")):
                head = re.match(r"#{1,6} +([^\n]*)", piece)
                piped = [x.strip() for x in piece.splitlines() if x.strip().startswith("|")]
                named = next((x for x in piped if x.strip("|-: \t")), "")
                header = [c.strip() for c in named.strip("|").split("|")] if named else []
                rows.append((doc_id, pos, at, at + len(piece), head[1].strip() if head else None, "table" if len(piped) > 1 else "text", header, piece))
                at += len(piece)
            held += at
            if held >= BATCH_CHARS:
                yield pd.DataFrame(rows, columns=names)
                rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)


def _chunk_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as (doc_id, chunks), each beside its own chunks; ids pass as they are."""
    names = [f.name for f in _CHUNK]
    for batch in batches:
        ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text"))

        def part(lo: int, hi: int, rows: pd.DataFrame, ids=ids, texts=texts) -> pa.RecordBatch:
            ends = np.cumsum(np.bincount(rows["doc_id"].to_numpy(np.int64) - lo, minlength=hi - lo))
            values = pa.StructArray.from_arrays([pa.array(rows[f.name].tolist(), f.type) for f in _CHUNK], names)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values, mask=texts[lo:hi].is_null())
            return pa.record_batch([ids[lo:hi], lists], names=["doc_id", "chunks"])

        # Each row is its place here: ids may be missing or stand twice.
        placed = pd.DataFrame({"doc_id": np.arange(len(texts)), "text": pd.Series(texts.to_pylist(), dtype=object)})
        lo = 0
        for rows in _chunk_rows(iter([placed])):
            hi = int(rows["doc_id"].iloc[-1]) + 1
            yield part(lo, hi, rows)
            lo = hi
        if lo < len(texts):  # the last texts have no chunks
            yield part(lo, len(texts), pd.DataFrame([], columns=["doc_id", *names]))


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id and chunks of every row: an array of pos, start, end, heading, kind, table_header, text; empty for an empty text, null for a null one."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(docs.sparkSession.conf.get(batch)) <= BATCH_ROWS:
        docs.sparkSession.conf.set(batch, str(BATCH_ROWS))  # left so: Spark reads it when the plan runs
    chunk = "array<struct<pos: int, start: bigint, end: bigint, heading: string, kind: string, table_header: array<string>, text: string>>"
    return docs.select("doc_id", "text").mapInArrow(_chunk_lists, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunks {chunk}")


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, heading, kind, table_header, text; the chunks of a document concatenate to its text.

    A chunk of two or more lines that open with a pipe is a table; its header is the first such line that is more than a rule.
    """
    return chunk_lists(docs).select("doc_id", F.inline("chunks"))


def rejoined(docs: DataFrame) -> DataFrame:
    """doc_id, the text that a row's chunks concatenate to, and where the last one ends. Rows that repeat an id, or have none, are documents of their own."""
    pieces = F.sort_array(F.transform("chunks", lambda c: F.struct(c["pos"], c["text"])))
    end = F.coalesce(F.array_max(F.transform("chunks", lambda c: c["end"])), F.when(F.col("chunks").isNotNull(), F.lit(0)))
    return chunk_lists(docs).select("doc_id", F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("joined"), end.alias("n"))


def heading_path(docs: DataFrame) -> DataFrame:
    """doc_id, line, path: the headings above each line, deeper ones cut by a shallower one."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    level = F.length(F.regexp_extract("raw", r"^(#{1,6}) ", 1))
    w = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("level", level)
    for k in range(1, 4):
        at = F.when(F.col("level") == k, F.struct("line", F.trim(F.regexp_replace("raw", r"^#+ ", "")).alias("text")))
        out = out.withColumn(f"h{k}", F.last(at, ignorenulls=True).over(w))
    shallower = lambda k: F.greatest(F.lit(-1), *(F.coalesce(F.col(f"h{j}.line"), F.lit(-1)) for j in range(1, k + 1)))
    parts = [F.when((F.col("h1.line").isNotNull()) if k == 1 else (F.col(f"h{k}.line") > shallower(k - 1)), F.col(f"h{k}.text")) for k in range(1, 4)]
    return out.select("doc_id", "line", F.concat_ws(" / ", *parts).alias("path"))
