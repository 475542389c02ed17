"""Problem 9: mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots of one block of tokens each. Slot k takes the golden-ratio point frac(k * phi) and maps it
through the cumulative weights to a source; the slot's rank within its source picks a block of that source's shuffled
documents, again from the first block when all were used, as often as a record may be used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import share, spread, written
from .lookalike import with_canonical
from .tokens import encode_corpus

#: Tokens of a block; slots that are ranked together; documents, on average, of a range of the shuffled order that is summed together.
BLOCK, SLOTS, RANGE, SEED = 2048, 1 << 14, 1 << 15, 42
GOLDEN = 0.6180339887498949


def source_key(c):
    """Sources that differ in case, blanks, hyphens or underscores only are one."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s_\-]+", "_"), "^_+|_+$", "")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source_key, n_tokens) of every document; null and empty texts have 0 tokens."""
    counts = encode_corpus(spread(docs.select(key, text)), key, text, count_only=True)
    named = with_canonical(docs.select(key, source), source).select(key, source_key(F.col("canon")).alias("source_key"))
    return counts.dropDuplicates([key]).join(named.dropDuplicates([key]), key).select(F.col(key).alias("doc_id"), "source_key", "n_tokens")


def mix(sizes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schedule, report) for sizes(doc_id, source_key, n_tokens) and targets(mix_id, source_name, target_weight, max_uses).

    schedule: (mix_id, slot, source_name, use_no, doc_id, n_tokens); report: (mix_id, source_name, target_weight, max_uses,
    source_tokens, total_tokens, capacity, wanted, slots, filled, reached_tokens, reached_share, short). Documents without
    tokens or with an unknown or null source are in no slot, their tokens count in the total. A source without documents
    reaches 0. `slots` of the schedule fall to the source, `filled` of them get a block. A source is short if the schedule
    uses up its blocks (but for the few slots by which a source's number of points may differ from its weight, and the part of a block at
    the end of each use) and its tokens, counted exactly, are too few.
    """
    sizes = written(sizes, "sizes")
    total, n_docs = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    # shuffled order of each source: ranges of a hash are summed first, so no source passes through one task
    order = F.xxhash64(F.lit(SEED), "doc_id")
    docs = sizes.where("n_tokens > 0").withColumn("turn", order).withColumn("range", F.shiftrightunsigned("turn", 64 - max(1, (n_docs // RANGE).bit_length())))
    sums = docs.groupBy("source_key", "range").agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy("source_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_key", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_key", "range").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.join(sums, ["source_key", "range"]).withColumn("block", F.floor((F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))) / F.lit(BLOCK)))
    per_source = sizes.groupBy("source_key").agg(F.sum("n_tokens").alias("source_tokens"))
    plan = targets.withColumn("source_key", source_key(F.col("source_name"))).join(per_source, "source_key", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    plan = plan.withColumn("total_tokens", F.lit(total).cast("long"))
    upto = Window.partitionBy("mix_id").orderBy("source_name")
    plan = plan.withColumn("high", F.sum("target_weight").over(upto)).withColumn("low", F.coalesce(F.lag("high").over(upto), F.lit(0.0)))
    plan = plan.withColumn("blocks", F.ceil(F.col("source_tokens") / F.lit(BLOCK))).withColumn("capacity", F.col("source_tokens") * F.col("max_uses")).withColumn("wanted", F.col("target_weight") * F.col("total_tokens"))
    plan = written(plan, "plan")
    # slots, made in ranges of SLOTS so that their number needs no single task
    spans = plan.groupBy("mix_id").agg(F.max("total_tokens").alias("t")).withColumn("n", F.ceil(F.col("t") / F.lit(BLOCK))).where("n > 0")
    spans = spans.select("mix_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(SLOTS)))).alias("span"))
    slots = spans.repartition("mix_id", "span").select("mix_id", "span", F.explode(F.sequence(F.col("span") * SLOTS, F.least("n", (F.col("span") + 1) * F.lit(SLOTS)) - 1)).alias("slot"))
    slots = slots.withColumn("point", F.pmod((F.col("slot") + 1) * F.lit(GOLDEN), F.lit(1.0)))
    slots = slots.join(plan.select("mix_id", "source_name", "source_key", "low", "high", "blocks", "max_uses"), "mix_id").where("point >= low and point < high")
    local = Window.partitionBy("mix_id", "source_name", "span").orderBy("slot")
    slots = slots.withColumn("nth", F.row_number().over(local) - 1)
    counts = slots.groupBy("mix_id", "source_name", "span").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("mix_id", "source_name").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("mix_id", "source_name", "span", "c", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    fallen = counts.groupBy("mix_id", "source_name").agg(F.sum("c").alias("slots"))
    slots = slots.join(counts.select("mix_id", "source_name", "span", "offset"), ["mix_id", "source_name", "span"]).withColumn("rank", F.col("nth") + F.col("offset")).where("blocks > 0")
    slots = slots.withColumn("use_no", F.floor(F.col("rank") / F.col("blocks")) + 1).where("use_no <= max_uses").withColumn("block", F.pmod("rank", "blocks"))
    filled = slots.groupBy("mix_id", "source_name").agg(F.count("*").alias("filled"))
    schedule = slots.join(docs.select("source_key", "block", "doc_id", "n_tokens"), ["source_key", "block"]).select("mix_id", "slot", "source_name", "use_no", "doc_id", "n_tokens")
    reached = schedule.groupBy("mix_id", "source_name").agg(F.sum("n_tokens").alias("reached_tokens"))
    report = plan
    for part in (fallen, filled, reached):
        report = report.join(part, ["mix_id", "source_name"], "left")
    report = report.fillna(0, ["slots", "filled", "reached_tokens"])
    whole = F.sum("reached_tokens").over(Window.partitionBy("mix_id"))
    # golden-ratio points fall into an interval as often as its length asks for, but for a number that grows with the logarithm of all
    stray = 3 + F.log(1 + F.col("total_tokens") / F.lit(BLOCK)) + F.col("max_uses")
    used_up = F.col("filled") + stray >= F.col("blocks") * F.col("max_uses")
    report = report.withColumn("reached_share", share(F.col("reached_tokens"), whole)).withColumn("short", used_up & (F.col("capacity") < F.col("wanted")))
    return schedule, report.select("mix_id", "source_name", "target_weight", "max_uses", "source_tokens", "total_tokens", "capacity", "wanted", "slots", "filled", "reached_tokens", "reached_share", "short")
