"""Mixing sources to target weights by a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Fraction part of the golden ratio: its multiples modulo one spread evenly over [0, 1).
GOLDEN = 0.6180339887498949
#: Equal parts of [0, 1) by which a point finds the sources it may fall on.
CELLS = 1024
#: A block is at most so many words, and at most this part of the mix.
BLOCK, BLOCKS = 2048, 65_536
#: Slots, and parts of the hash space of a source's documents, that are ranked in one task.
SLOTS = 4096
HASH_BITS = 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row per source: sid (its place by code point, null last), source_size, target, quota, and block, the words of a block.

    Weights are repeated over the sources; the targets share the sum of all sizes by weight. A target
    stops at ``most`` times its source's size and the excess goes to the others by weight, which ends
    where all targets are w * level or at their stop. With the sources by stop / w the level is what is
    left over the weights that are left, at the first source whose stop it doesn't reach.
    The windows below are over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))) + 1))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("stop") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("stop", F.col("source_size") * F.lit(float(most))).withColumn("all", F.sum("source_size").over(whole))
    left = F.col("all") - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    per = per.withColumn("top", F.max(F.when(F.col("stop") > F.col("level") * F.col("w"), F.col("level"))).over(whole))
    target = F.least("stop", F.coalesce(F.col("top") * F.col("w"), F.col("stop")))
    per = per.withColumn("target", target).withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * most))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"sum(quota) over () div {BLOCKS}"))).cast("long")
    return per.select("sid", "source", "n_docs", "source_size", "w", "target", "quota", block.alias("block"))


def _slots(plan: DataFrame, n: int) -> DataFrame:
    """(slot, sid, k): n slots by the source their golden-ratio point falls on, ranked within it; then each source's last blocks that the points left out.

    Ranks are counted within runs of SLOTS slots and carried on by the runs' counts, so that a
    source that has most of the slots isn't ranked in one task.
    """
    spark = plan.sparkSession
    share = F.col("target") / F.sum("target").over(Window.partitionBy())
    high = F.sum("share").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    spans = plan.select("sid", share.alias("share")).select("sid", (high - F.col("share")).alias("lo"), high.alias("hi"))
    last = F.max("hi").over(Window.partitionBy())
    spans = spans.withColumn("hi", F.when(F.col("hi") >= last, F.lit(2.0)).otherwise(F.col("hi"))).where("hi > lo")
    to_cell = lambda c: F.least(F.floor(F.col(c) * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = spans.select("sid", "lo", "hi", F.explode(F.sequence(to_cell("lo"), to_cell("hi"))).alias("cell"))
    x = F.col("id") * F.lit(GOLDEN)
    points = spark.range(n).select(F.col("id").alias("slot"), (x - F.floor(x)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS).cast("int"))
    # rounding can leave a hair between two neighbouring spans: a point belongs to the last span that starts at or below it
    nxt = F.coalesce(F.lead("lo").over(Window.partitionBy("cell").orderBy("lo")), F.lit(2.0))
    spans = spans.withColumn("hi", nxt).withColumn("lo", F.when(F.row_number().over(Window.partitionBy("cell").orderBy("lo")) == 1, F.lit(0.0)).otherwise(F.col("lo")))
    hit = points.join(spans, "cell").where("x >= lo and x < hi").select("slot", "sid", F.expr(f"slot div {SLOTS}").alias("run"))
    runs = hit.groupBy("sid", "run").count()
    past = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("sid", "run", F.coalesce(F.sum("count").over(past), F.lit(0)).alias("before"), "count")
    rank = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1
    ranked = hit.withColumn("r", rank).join(runs, ["sid", "run"]).select("slot", "sid", (F.col("before") + F.col("r")).alias("k"))
    got = runs.groupBy("sid").agg(F.sum("count").alias("got"))
    wanted = plan.select("sid", F.ceil(F.col("quota") / F.col("block")).alias("blocks"))
    rest = wanted.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("blocks > got")
    rest = rest.select("sid", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("k")).select((F.lit(n) + F.col("k")).alias("slot"), "sid", "k")
    return ranked.join(wanted, "sid").where("k < blocks").select("slot", "sid", "k").union(rest)


def _placed(sizes: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Every document with ``at``: the words of its source before it, in an order shuffled by hash.

    Equal rows are one until they have their place, so that neither many copies nor one doc_id make a
    group of their own. Sums are taken in parts of the hash space and carried on by the parts' sums.
    """
    one = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    h = F.xxhash64("doc_id", "size", F.lit(seed))
    names = plan.select("sid", F.col("source").alias("name"), "source_size", "target", "quota", "block")
    one = one.join(names, one["source"].eqNullSafe(names["name"])).drop("name")
    one = one.withColumn("h", h).withColumn("part", F.shiftrightunsigned("h", 64 - HASH_BITS)).withColumn("all", F.col("n") * F.col("size"))
    parts = one.groupBy("sid", "part").agg(F.sum("all").alias("words"))
    past = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("sid", "part", F.coalesce(F.sum("words").over(past), F.lit(0)).alias("before"))
    within = Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("within", F.coalesce(F.sum("all").over(within), F.lit(0))).join(parts, ["sid", "part"])
    one = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = F.col("before") + F.col("within") + (F.col("copy") - 1) * F.col("size")
    return one.select("doc_id", "source", "size", "copy", "sid", "source_size", "target", "quota", "block", at.alias("at"))


def mix(sizes: DataFrame, weights: tuple = (5, 2, 1), most: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix of documents (doc_id, source, size) as two tables: (documents, schedule).

    The words of each source, shuffled, are cut into blocks of equally many words; the source is
    repeated as long as its quota lasts. Slots 0, 1, ... take the points of the golden-ratio sequence;
    a point falls on a source by the targets summed up, and the k-th slot of a source takes its k-th
    block. schedule: a row for each part of a document in a block (slot, sid, block, doc_id, copy,
    size, source, epoch, start, length). documents: a row for each document, with its source's size
    and target. A source takes its target to a word, a document ``most`` times its size at most.
    Null sizes count as 0. No document or no word: no schedule. Reruns agree.
    """
    sizes = sizes.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    plan = cut(targets(sizes, weights, most))
    row = plan.agg(F.sum("quota").alias("words"), F.max("block").alias("block")).first()
    n = -(-(row["words"] or 0) // (row["block"] or 1))
    docs = cut(_placed(sizes, plan, seed))
    epochs = F.explode(F.expr("sequence(0L, greatest(0L, quota - at - 1) div greatest(1L, source_size))"))
    parts = docs.where("size > 0 and at < quota").select("*", epochs.alias("epoch"))
    parts = parts.withColumn("from", F.col("at") + F.col("epoch") * F.col("source_size"))
    parts = parts.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("quota"))).where("from < to")
    parts = parts.withColumn("k", F.explode(F.expr("sequence(from div block, (to - 1) div block)")))
    start = F.greatest(F.col("from"), F.col("k") * F.col("block"))
    length = F.least(F.col("to"), (F.col("k") + 1) * F.col("block")) - start
    parts = parts.select("sid", "k", "doc_id", "copy", "size", "source", "epoch", (start - F.col("from")).alias("start"), length.alias("length"))
    schedule = parts.join(_slots(plan, n), ["sid", "k"]).withColumnRenamed("k", "block")
    return docs, schedule


def taken(sizes: DataFrame, weights: tuple = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken): a row for each row of ``sizes``; taken is the words the mix takes of it, repeats counted."""
    docs, schedule = mix(sizes, weights, most, seed)
    took = schedule.select("doc_id", "copy", "size", "source", "length")
    none = docs.select("doc_id", "copy", "size", "source", F.lit(0).cast("long").alias("length"))
    took = took.union(none).groupBy("doc_id", "copy", "size", "source").agg(F.sum("length").alias("taken"))
    plan = docs.select("source", "source_size", "target").distinct().withColumnRenamed("source", "name")
    return took.join(plan, took["source"].eqNullSafe(plan["name"])).select("doc_id", "size", "source", "source_size", "target", "taken")


def repeat(docs: DataFrame, weights: tuple = (5, 2, 1), most: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` as the mix takes them: each whole document as often as its words taken come nearest to, 0 to ``most`` times.

    Blocks cut documents at their ends, so a document taken in part is rounded. Rows equal in doc_id,
    source and size share what they take evenly.
    """
    size = n_words(F.col("text"))
    took = taken(docs.select("doc_id", "source", size.alias("size")), weights, most, seed)
    took = took.groupBy(F.col("doc_id").alias("id_"), F.col("source").alias("source_"), F.col("size").alias("size_")).agg(F.round(F.sum("taken") / (F.count("*") * F.greatest(F.first("size"), F.lit(1)))).cast("int").alias("times_"))
    same = docs["doc_id"].eqNullSafe(F.col("id_")) & docs["source"].eqNullSafe(F.col("source_")) & (size == F.col("size_"))
    out = docs.join(took.where("times_ > 0"), same)
    return out.withColumn("nth_", F.explode(F.sequence(F.lit(1), F.col("times_")))).select(*docs.columns)
