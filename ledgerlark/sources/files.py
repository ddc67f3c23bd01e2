"""Document and question files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ["md", "markdown", "txt", "html", "htm"]
QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("points", T.DoubleType()),
        T.StructField("query", T.StringType()),
        T.StructField("top_k", T.IntegerType()),
        T.StructField("gold_all", T.ArrayType(T.StringType())),
        T.StructField("gold_any", T.ArrayType(T.StringType())),
        T.StructField("turns", T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("checks", T.MapType(T.StringType(), T.StringType()))]))),
    ]
)


def scan_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, content) of document files below a folder, hidden ones left out; and warnings for other suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    name = F.element_at(F.split("path", "/"), -1)
    seen = files.where(~name.startswith(".") & ~F.col("path").rlike(r"/\.[^/]+/"))
    good = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*SUFFIXES)
    return seen.where(good), seen.where(~good).select("path", F.lit("unsupported suffix").alias("warning"))


def first_of_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first path of each doc_id, and a warning for every other."""
    ranked = docs.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")))
    return ranked.where("_r = 1").drop("_r"), ranked.where("_r > 1").select("path", F.lit("duplicate document id").alias("warning"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """The question bank, JSON lines with a fixed schema."""
    return spark.read.schema(QUESTION_SCHEMA).json(path)


def write_index(postings: DataFrame, path: str, buckets: int = 32) -> None:
    """Postings by a bucket of their term, sorted by it, so that a query reads few files."""
    bucketed = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    bucketed.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Postings as written."""
    return spark.read.parquet(path).drop("bucket")
