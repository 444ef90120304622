"""Exact deduplication by a heavy-hitter split (DataFrame functions only).

One narrow pass turns each text into a digest. A Misra-Gries summary of the digests (Spark's approx_top_k keeps a
bounded number of counters in each task and merges them) names at most `heavy` frequent digests. Their true sizes and
winners are counted with map-side aggregation and broadcast, so rows of large groups never meet in one task. All other
digests go through an ordinary shuffle, in which no group is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, small, without_white

#: The most digests that are broadcast, and the counters of the summary. Both bound memory, not results.
HEAVY, COUNTERS = 1000, 8192


def _ledger(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.length(text), F.lit(0)).alias("chars"),
            F.sha2(without_white(F.col(text)), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        )
    )


def _rank():
    return F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row").alias("r"))


def _verdicts(ledger: DataFrame, heavy: int, counters: int) -> DataFrame:
    top = ledger.agg(F.expr(f"approx_top_k(xxhash64(digest), {heavy}, {counters})").alias("top")).select(F.inline("top")).filter("count > 1")
    suspects = F.broadcast(top.select(F.col("item").alias("suspect")))  # `heavy` rows at most
    winners = cut(
        ledger.join(suspects, F.xxhash64("digest") == F.col("suspect"), "left_semi")
        .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_rank()).alias("best"))
    )
    hot = ledger.join(F.broadcast(winners), "digest").select(
        "doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), "digest", "row"
    )
    group = Window.partitionBy("digest")
    rest = (
        ledger.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("best", F.min(_rank()).over(group))
        .select(
            "doc_id", F.col("best.d").alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"),
            (F.col("row") == F.col("best.r")).alias("kept"), "digest", "row",
        )
    )
    return hot.unionByName(rest)


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. The row with the most code points, then the smallest doc_id,
    stays. A null text counts as empty, so null, empty and blank texts are one group. A null doc_id comes after all
    others; of rows repeated with the same doc_id exactly one stays. An empty table gives no rows. Other columns of
    the input, whatever their names, play no part.
    """
    out = _verdicts(_ledger(docs, text, doc_id), heavy, counters)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """`docs`, all columns, with one row of each group of equal texts: the one that `exact_duplicates` keeps.

    Rows are found by their doc_id and a hash of their digest; of rows that repeat both, one stays (that with the most
    code points). Columns keep their names, whatever these are. Nulls, empty texts and empty tables as in
    `exact_duplicates`. Rows to drop are narrow: up to FEW of them are broadcast, more are joined by a shuffle.
    """
    lost_id, lost_hash, nth = fresh(docs, 3)
    judged = _verdicts(_ledger(docs, text, doc_id), HEAVY, COUNTERS).filter("not kept")
    judged = cut(judged.select(F.col("doc_id").alias(lost_id), F.xxhash64("digest").alias(lost_hash), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("own")))
    lost = cut(judged.drop("own").distinct())
    twice = cut(judged.filter("own").drop("own").distinct())  # the row that stays shares its doc_id with one that goes
    digest = F.xxhash64(F.sha2(without_white(docs[text]), 256))
    here = docs[doc_id].eqNullSafe(F.col(lost_id)) & (digest == F.col(lost_hash))
    once = docs.join(small(lost), here, "left_anti")
    if twice.isEmpty():
        return once
    one = Window.partitionBy(docs[doc_id], digest).orderBy(F.length(docs[text]).desc())
    again = docs.join(small(twice), here, "left_semi").withColumn(nth, F.row_number().over(one)).filter(F.col(nth) == 1).drop(nth)
    return once.unionByName(again)
