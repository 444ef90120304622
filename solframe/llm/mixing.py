"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot k of the schedule has the golden-ratio point frac(k * phi). Points are mapped through the sources' cumulative
shares, so each source's slots are spread evenly over the schedule, and the slots of a source are ranked. Each source's
documents, in shuffled order, are laid end to end and cut into blocks of equal words; the slot of rank r takes block r,
round after round. The points so decide the order of the mix: the place of each block, and of each document by its
first one. A source's points miss its share of the slots by a few; such slots follow at the schedule's end (or are left
out), and the last block of a source stops at its target, so all of a source with less than a block is in late slots.

Ranks and running totals are taken within small buckets and joined to prefix sums of the buckets' totals, so a source
that holds a third of all rows is spread over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, n_words, prefix_sums, same

#: Weights of the sources in code-point order (null last), repeated; the share of all words to take; the most passes.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Words in a block; rows in a bucket, about; slots in a chunk of the schedule.
BLOCK, BUCKET, CHUNK = 1024, 2000, 4096
PHI = 0.6180339887498949


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Add weight and target to one row for each source (source, source_size).

    Targets share `share` of all words by weight and stop at `passes` times a source's size; the excess goes to the
    others by weight until none is above. Sorted by room for each unit of weight, the sources that stop are a prefix,
    so running sums give the level of the rest directly.
    """
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * passes).cast("double")
    t = totals.withColumn("weight", weight).withColumn("cap", cap)
    t = t.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("all_weight", F.sum("weight").over(everything))
    earlier = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("all_words") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    unfilled = F.col("all_weight") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    t = t.withColumn("left", left).withColumn("unfilled", unfilled)
    t = t.withColumn("stops", F.col("cap") * F.col("unfilled") <= F.col("weight") * F.col("left"))
    free = lambda c: F.sum(F.when(F.col("stops"), F.col(c)).otherwise(F.lit(0.0))).over(everything)
    t = t.withColumn("stopped_cap", free("cap")).withColumn("stopped_weight", free("weight"))
    level = F.try_divide(F.col("all_words") - F.col("stopped_cap"), F.col("all_weight") - F.col("stopped_weight"))
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.least(level * F.col("weight"), F.col("cap")))
    return t.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def _point(k: Column) -> Column:
    """frac(k * phi), with k in two parts to keep the fraction's digits for large k."""
    step = 1 << 20
    high = (F.floor(k / step) * F.lit(PHI * step % 1.0)) % 1.0
    return (high + (k % step) * F.lit(PHI)) % 1.0


def schedule(sources: DataFrame, block: int, n_slots: int) -> DataFrame:
    """One row for each slot that takes words: source, k (place in the schedule), rank (from 0), block_no, words, pass.

    sources: source, source_size, want (whole words to take), low and high (its interval of [0, 1)).
    """
    spark, cells = sources.sparkSession, max(16, 4 * sources.count())
    index = sources.select(
        "source", "low", "high",
        F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"),
    ).filter("low < high")
    points = spark.range(n_slots).select(F.col("id").alias("k"), _point(F.col("id")).alias("u")).withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    slots = points.join(index, (points["cell"] == index["cell"]) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("source", "k", F.floor(F.col("k") / CHUNK).alias("chunk"))
    slots = cut(slots)
    counts = prefix_sums(slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n")), ["source"], "chunk", "n", "before").select("source", "chunk", "before")
    order = Window.partitionBy("source", "chunk").orderBy("k")
    ranked = slots.withColumn("nth", F.row_number().over(order) - 1)
    ranked = ranked.join(counts, same(ranked, counts, "source") & (ranked["chunk"] == counts["chunk"])).select(ranked["source"], "k", (F.col("before") + F.col("nth")).alias("rank"))
    per_pass = F.ceil(F.col("source_size") / block).cast("long")
    need = F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.col("source_size")) * per_pass + F.ceil((F.col("want") % F.col("source_size")) / block)).otherwise(0).cast("long")
    facts = sources.select("source", "source_size", "want", per_pass.alias("per_pass"), need.alias("need"))
    had = slots.groupBy("source").agg(F.count(F.lit(1)).alias("had"))
    short = facts.join(had, same(facts, had, "source"), "left").select(facts["source"], "need", F.coalesce("had", F.lit(0)).cast("long").alias("had")).filter("need > had")
    late = short.select("source", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")).select("source", (F.lit(n_slots) + F.col("rank")).alias("k"), "rank")
    full = ranked.unionByName(late)
    full = full.join(facts, same(full, facts, "source")).filter("rank < need").select(
        full["source"], "k", "rank", "source_size", "want", (F.col("rank") % F.col("per_pass")).alias("block_no"), F.floor(F.col("rank") / F.col("per_pass")).alias("pass")
    )
    start = F.col("pass") * F.col("source_size") + F.col("block_no") * block
    length = F.least(F.lit(block), F.col("source_size") - F.col("block_no") * block, F.col("want") - start)
    return full.select("source", "k", "rank", "block_no", length.cast("long").alias("words"), "pass")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs`: doc_id, size, source_size, target, taken, first_slot, slots.

    slots are the document's places in the mix, one for each pass in which words of it are taken: the first slot of the
    schedule that does so; first_slot is the first of them, null where no slot takes words of it. taken counts the words
    that the mix takes from the document, repeats included: `PASSES` times its size at most.
    Each source's taken words add up to its target, rounded down. A null text has no words; a null source is a source
    of its own, the last; documents without words take nothing; repeated rows are documents of their own; an empty
    table gives no rows; other columns play no part. The order within a source is a hash of doc_id, so reruns agree.
    """
    return _mixed(docs, text, doc_id, source, block).select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"), "slots")


def _mixed(docs: DataFrame, text: str, doc_id: str, source: str, block: int, own: Column | None = None) -> DataFrame:
    """The columns of `mix`, and own: a hash by which the caller knows a row."""
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
            F.xxhash64(F.col(doc_id), F.lit("mix")).alias("h"), F.monotonically_increasing_id().alias("row"), (F.lit(0).cast("long") if own is None else own).alias("own"),
        )
    )
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = cut(source_targets(totals).join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    known = sources.agg(F.sum("rows").alias("rows"), F.floor(F.sum(F.floor("target") / block)).alias("slots"), F.sum("target").alias("target")).first()
    n_rows, n_slots, wanted = known["rows"] or 0, int(known["slots"] or 0) + 1, known["target"] or 0.0
    upto = Window.orderBy(F.col("source").isNull(), "source")
    share = F.col("target") / F.lit(wanted or 1.0)
    sources = cut(sources.withColumn("want", F.floor("target").cast("long")).withColumn("high", F.sum(share).over(upto)).withColumn("low", F.col("high") - share))
    slots = schedule(sources, block, n_slots).select(F.col("source").alias("slot_source"), F.col("block_no").alias("slot_block"), "words", "k", "pass")

    buckets = 1 << max(0, (n_rows // BUCKET).bit_length())
    rows = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - buckets.bit_length() + 1) if buckets > 1 else F.lit(0).cast("long"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    starts = prefix_sums(totals, ["source"], "bucket", "words", "start").select("source", "bucket", "start")
    order = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.filter("size > 0").withColumn("inside", F.coalesce(F.sum("size").over(order), F.lit(0)))
    laid = laid.join(starts, same(laid, starts, "source", "bucket")).select(laid["source"], "row", "size", (F.col("start") + F.col("inside")).alias("at"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = laid.select("source", "row", "size", "at", F.explode(F.sequence(first, last)).alias("block_no")).select(
        "source", "block_no", "row",
        F.greatest(F.col("at") - F.col("block_no") * block, F.lit(0)).alias("from"),
        F.least(F.col("at") + F.col("size") - F.col("block_no") * block, F.lit(block)).alias("to"),
    )
    took = pieces.join(slots, pieces["source"].eqNullSafe(slots["slot_source"]) & (pieces["block_no"] == slots["slot_block"]) & (pieces["from"] < slots["words"]))
    passes = took.groupBy("row", "pass").agg(F.sum(F.least("to", "words") - F.col("from")).alias("taken"), F.min("k").alias("k"))
    taken = passes.groupBy("row").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list("k")).alias("slots"))  # PASSES entries at most
    with_taken = rows.join(taken, "row", "left").select("doc_id", "own", "row", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slots")
    facts = sources.select("source", "source_size", "target")
    return with_taken.join(facts, same(with_taken, facts, "source")).select("doc_id", "own", "row", "size", "source_size", "target", "taken", "slots")


def apply_mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", block: int = BLOCK) -> DataFrame:
    """`docs`, all columns, in the order of the mix: each row as often as the mix takes its words, to the nearest whole
    number (0 to `PASSES`), each copy at its slot of the schedule.

    Rows come in range partitions of the slots, sorted within; in a slot, by a hash. Rows are known by a hash of all their
    columns that can be hashed, so rows that are equal in all of them stand for each other. Documents without words, null
    texts among them, which no mix takes, go; an empty table stays empty; columns keep their names, whatever these are.
    """
    own, times, slot, nth = fresh(docs, 4)
    key = F.xxhash64(*(docs[c] for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))))
    copies = F.round(F.try_divide("taken", "size")).cast("int")
    mixed = _mixed(docs, text, doc_id, source, block, key).withColumn("copies", copies).filter("copies > 0")
    places = cut(mixed.select(F.col("own").alias(own), F.explode(F.slice("slots", 1, F.col("copies"))).alias(slot), F.col("row").alias(times)))
    rows_of = places.select(own, times).distinct().groupBy(own).agg(F.count(F.lit(1)).alias(nth))
    equal = not rows_of.filter(F.col(nth) > 1).isEmpty()
    keyed = docs.withColumn(nth, key)
    keyed = keyed.dropDuplicates([nth]) if equal else keyed  # one of equal rows, which has the slots of all
    taken = keyed.join(places.drop(times), F.col(nth) == F.col(own))  # a row a copy: as many as there are documents
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartitionByRange(parts, slot, own).sortWithinPartitions(slot, own).select(*(docs[c] for c in docs.columns))
