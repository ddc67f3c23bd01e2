"""Connected components of a link table, as rounds of joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``links`` (a, b: longs) reaches.

    Each round lets a node and its present root take the least root among the node's
    neighbours, then halves the paths; it ends when no root changes. Roots only ever fall, so
    an unchanged sum means an unchanged table. The number of rounds grows with the logarithm of
    the longest path. A node with very many links is pre-aggregated before each shuffle; the
    joins on it are left to the skew handling of sort-merge joins.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    now = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    total = None
    while True:
        at = now.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        heard = edges.join(at.hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        both = now.join(heard.hint("merge"), "node")
        told = both.select("node", F.least("root", "seen").alias("root")).union(both.select(F.col("root").alias("node"), F.least("root", "seen").alias("root")))
        # Written, so that the join on a root that very many nodes share can be split.
        hooked = materialize(told.groupBy("node").agg(F.min("root").alias("root")), "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        now = materialize(hooked.join(up.hint("merge"), "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "roots")
        check = now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if check is None or check == total:
            return now
        total = check
