"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order, repeated for as many epochs as its target needs. A
document's virtual finish time is the source's cumulative words divided by the source's target; the mix takes documents
in order of finish time until the total budget is reached. Built-in expressions only.

No sort or running sum sees a whole source: each is cut into chunks of a hash (or of the finish time), summed inside
the chunk and lifted by the sum of the chunks before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import WORD, stored, text_of

SEED = "mix-1"
WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Chunks of each queue (three hex digits of the hash), and of the virtual time up to the targets.
CHUNKS = 4096


def queue(docs: DataFrame) -> DataFrame:
    """One narrow row per document: doc_id, src, no_source, size, place (its shuffled order), chunk, text_key."""
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(SEED)).cast("binary"))
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),
        F.col("source").isNull().alias("no_source"),
        F.regexp_count(text_of(docs), F.lit(WORD)).cast("long").alias("size"),
        place.alias("place"),
        F.conv(F.substring(place, 1, 3), 16, 10).cast("int").alias("chunk"),
        F.xxhash64("text").alias("text_key"),
    )


def targets(queued: DataFrame) -> DataFrame:
    """One row per source: its size and target. The total of all sizes is shared by weight; what is above EPOCHS times
    a source's size goes to the others by weight, until none is above.

    In order of size per weight, the sources before some place are full and the rest share what is left; the first
    place where the share fits gives the level. One row per source, so its windows stay small.
    """
    sizes = queued.groupBy("src", "no_source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy("no_source", "src")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    weighed = sizes.withColumn("weight", weight)
    before = Window.orderBy(EPOCHS * F.col("source_size") / F.col("weight"), "no_source", "src").rowsBetween(
        Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = F.coalesce(EPOCHS * F.sum("source_size").over(before), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - full) / left
    fits = F.col("level") * F.col("weight") <= EPOCHS * F.col("source_size")
    shared = weighed.withColumn("level", level).withColumn("fits", fits)
    found = shared.withColumn("level", F.min_by(F.when(F.col("fits"), F.col("level")), F.when(
        F.col("fits"), F.struct(EPOCHS * F.col("source_size") / F.col("weight"), "no_source", "src"))).over(every))
    cap = (EPOCHS * F.col("source_size")).cast("double")
    return found.select("src", "source_size", F.least(
        F.coalesce(F.col("level") * F.col("weight"), cap), cap).alias("target"))


def finish_times(queued: DataFrame) -> DataFrame:
    """The queue with source_size, target and ``ahead``, the words of its source up to and with each document.

    The sums of the chunks carry source size and target to the rows, so rows are joined by source and chunk and a
    source with a third of all rows is spread over its chunks.
    """
    chunks = queued.groupBy("src", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        chunks.withColumn("start", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)))
        .join(targets(queued), "src").drop("chunk_size")
    )
    inside = Window.partitionBy("src", "chunk").orderBy("place", "doc_id", "size", "text_key").rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        queued.withColumn("ahead", F.sum("size").over(inside)).join(starts, ["src", "chunk"])
        .withColumn("ahead", F.col("ahead") + F.col("start")).drop("start")
    )


def _finish(epoch) -> F.Column:
    return (epoch * F.col("source_size") + F.col("ahead")) / F.col("target")


def last_finish(timed: DataFrame) -> float:
    """The finish time at which the budget, the total of all sizes, is reached; equal times are taken or left together.

    Only the documents that begin before their source's target can be in the mix. They are sorted by finish time
    within slices of it; the sums of the slices (CHUNKS + 1 at most) lift each slice.
    """
    begun = (
        timed.filter((F.col("size") > 0) & (F.col("target") > 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
        .filter(F.col("epoch") * F.col("source_size") + F.col("ahead") - F.col("size") < F.col("target"))
        .select("size", _finish(F.col("epoch")).alias("finish"))
        .withColumn("slice", F.least(F.floor(F.col("finish") * CHUNKS), F.lit(CHUNKS)).cast("int"))
    )
    sums = begun.groupBy("slice").agg(F.sum("size").alias("slice_size"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    lifts = sums.select("slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("lift"))
    upto = F.sum("size").over(Window.partitionBy("slice").orderBy("finish"))
    total = timed.agg(F.sum("size").alias("total")).first()["total"] or 0
    taken = begun.withColumn("upto", upto).join(F.broadcast(lifts), "slice").filter(F.col("upto") + F.col("lift") <= total)
    return taken.agg(F.max("finish").alias("last")).first()["last"] or 0.0


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, src, text_key, size, source_size, target, copies (epochs that take it), taken.

    Null texts and texts without a word have size 0 and are not taken. A null source is a source of its own, the last.
    Rows with equal doc_id and text are interchangeable. Other columns of ``docs`` are not read; an empty table gives an
    empty result. No document is taken more than EPOCHS times, and each source ends within one document of its target.
    """
    timed = stored(finish_times(stored(queue(docs), "mix-queue")), "mix-times")
    last = F.lit(last_finish(timed))
    copies = sum((F.when(_finish(F.lit(epoch)) <= last, 1).otherwise(0) for epoch in range(EPOCHS)), F.lit(0))
    some = (F.col("size") > 0) & (F.col("target") > 0)
    return timed.withColumn("copies", F.when(some, copies).otherwise(0)).withColumn(
        "taken", (F.col("copies") * F.col("size")).cast("long")).drop("place", "chunk", "ahead", "no_source")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their own columns, each as often as the mix takes it.

    Rows with equal doc_id and text share their copies out from the first of them.
    """
    plan = mix(docs).filter("copies > 0").groupBy("doc_id", "text_key").agg(F.sum("copies").cast("int").alias("copies"))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.xxhash64("text").alias("text_key"))
    own = F.col(f"c{names.index('doc_id')}")
    joined = keyed.join(
        plan.withColumnRenamed("doc_id", "plan_id").withColumnRenamed("text_key", "plan_key"),
        own.eqNullSafe(F.col("plan_id")) & (F.col("text_key") == F.col("plan_key")),
    )
    first = F.row_number().over(Window.partitionBy(own, "text_key").orderBy(own))
    return (
        joined.withColumn("nth", first).filter("nth = 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
        .select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    )
