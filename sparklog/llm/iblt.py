"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A digest is added to one cell of each of three tables; a cell holds the number of its digests, their exclusive or, and
that of their check hashes. Two sketches subtract cell by cell, which leaves the digests that only one text has. Cells
with a single digest are peeled until nothing is left. If something is, the pair is tried again with sketches as large
as its texts need, then with larger ones; what no sketch gives up is compared digest by digest, so that no result is
missing.

Cells are rows: a sketch is a sum and two exclusive ors by (document, cell), and a round of peeling is one more of them.
All of a document's cells share its partition, so texts are shuffled once and digests once. Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import stored, text_of

#: A paragraph is a line, or a part of one of so many words.
UNIT_WORDS = 32
UNIT = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,%d}" % UNIT_WORDS
TABLES = 3
#: Cells of each table of a fingerprint; larger sketches have so many more for each digest of the two texts.
WIDTH = 8
LARGER = (1, 4)
ROUNDS = 12
#: Buckets of the document order for each shuffle partition, and at most.
SPREAD, MOST_BUCKETS = 4, 8192


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: 63 bits of a hash, as negative numbers."""
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(
        F.rtrim(u, F.lit(" \t\n\x0b\f\r"))).bitwiseOR(F.lit(-(1 << 63)))))


def _slot(table: int, check: Column) -> Column:
    width = F.col("width").cast("long")
    return table * width + F.pmod(F.shiftrightunsigned(check, 21 * table), width)


def _cells(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (slot, n, key, check) summed into cells; empty cells go."""
    return rows.groupBy(*by, "width", "slot").agg(
        F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"),
    ).filter("n <> 0 or key <> 0 or check <> 0")


def sketch(rows: DataFrame, by: Sequence[str], salt: int = 0) -> DataFrame:
    """The cells of rows (key, n, width), for each ``by``; ``salt`` chooses the hash that places the digests."""
    check = F.xxhash64("key", F.lit(salt))
    placed = F.array(*[F.struct(
        _slot(t, F.col("check")).alias("slot"), F.col("n"), F.col("key"), F.col("check")) for t in range(TABLES)])
    return _cells(rows.withColumn("check", check).select(*by, "width", F.inline(placed)), by)


def peel(cells: DataFrame, by: Sequence[str], salt: int = 0) -> DataFrame:
    """The cells after ROUNDS of peeling. A peeled digest is a row with itself as slot (a negative number) and n of 1 or
    -1; rows with other slots are what could not be peeled.

    A round looks at one table, in which a digest has one cell, so no digest is peeled twice in it.
    """
    for round_ in range(ROUNDS):
        table = round_ % TABLES
        low, n, key, check = F.col("width") * table, F.col("n"), F.col("key"), F.col("check")
        pure = (F.col("slot") >= low) & (F.col("slot") < low + F.col("width")) & (F.abs(n) == 1) & (key < 0) & (
            check == F.xxhash64(key, F.lit(salt))) & (F.col("slot") == _slot(table, check))
        zero = F.lit(0).cast("long")
        gone = [F.struct(_slot(t, check).alias("slot"), (-n).alias("n"), key.alias("key"), check.alias("check"))
                for t in range(TABLES) if t != table]
        found = F.struct(key.alias("slot"), n.alias("n"), zero.alias("key"), zero.alias("check"))
        same = F.struct("slot", "n", "key", "check")
        cells = _cells(cells.select(*by, "width", F.inline(F.when(pure, F.array(found, *gone)).otherwise(F.array(same)))), by)
    return cells


def _signed(arrays: DataFrame) -> DataFrame:
    """(rid, pair, key, n): the digests of a document (1) against those of its edited text and of the next (-1)."""
    one = F.lit(1).cast("long")
    sides = [F.struct(F.lit(pair).alias("pair"), F.col(x).alias("keys"), (one * n).alias("n"))
             for pair, other in ((1, "b"), (2, "c")) for x, n in (("a", 1), (other, -1))]
    return arrays.select("rid", F.inline(F.array(*sides))).select("rid", "pair", "n", F.explode("keys").alias("key"))


def _outcome(peeled: DataFrame) -> DataFrame:
    """(rid, pair, differing, failed) of every pair that has a row left."""
    return peeled.groupBy("rid", "pair").agg(
        F.count_if(F.col("slot") < 0).alias("differing"), (F.count_if(F.col("slot") >= 0) > 0).alias("failed"))


def differences(arrays: DataFrame, base: DataFrame) -> DataFrame:
    """(rid, pair, differing): how many digests differ, for every pair with any; from the sketches ``base`` (rid, v, cells)
    of the three versions, and from larger ones of the digests in ``arrays`` (rid, a, b, c) where those fail."""
    by = ["rid", "pair"]
    pairs = F.when(F.col("v") == 0, F.array(
        F.struct(F.lit(1).alias("pair"), F.col("n").alias("n")), F.struct(F.lit(2).alias("pair"), F.col("n").alias("n")),
    )).otherwise(F.array(F.struct(F.col("v").alias("pair"), (-F.col("n")).alias("n"))))
    subtracted = _cells(base.select("rid", "width", "slot", "key", "check", F.inline(pairs)), by)
    last = stored(_outcome(peel(subtracted, by)), "sketch-0")
    solved = last.filter("not failed")
    for level, factor in enumerate(LARGER, 1):
        failed = last.filter("failed").select(*by)
        sizes = F.size("a") + F.when(F.col("pair") == 1, F.size("b")).otherwise(F.size("c"))
        widths = arrays.join(failed, "rid").select(*by, (WIDTH + factor * sizes).cast("long").alias("width"))
        rows = _signed(arrays).join(widths, by)
        last = stored(_outcome(peel(sketch(rows, by, level), by, level)), f"sketch-{level}")
        solved = solved.unionByName(last.filter("not failed"))
    rest = _signed(arrays).join(last.filter("failed").select(*by), by).groupBy(*by, "key").agg(F.sum("n").alias("n"))
    exact = rest.filter("n <> 0").groupBy(*by).agg(F.count("*").alias("differing"))
    return solved.select(*by, "differing").unionByName(exact)


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Shared digests of all digests of two texts; two texts without any are alike."""
    both, d = F.size(a) + F.size(b), F.coalesce(differing, F.lit(0))
    return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))


def written(v: int) -> Column:
    """A version's cells as hexadecimal text: 2 digits of the slot, 6 of n, 16 of key and of check, for each in use."""
    def digits(name: str, n: int) -> Column:
        return F.lpad(F.lower(F.hex(name)), n, "0")
    cell = F.concat(digits("slot", 2), digits("n", 6), digits("key", 16), digits("check", 16))
    return F.array_join(F.sort_array(F.collect_list(F.when(F.col("v") == v, cell))), "")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, keys (its digests) of every document with next_text and next_keys of the one that follows in
    descending doc_id; the first follows the last.

    The order is cut into buckets at quantiles of doc_id (at most MOST_BUCKETS, so their bounds are small). The first
    row of a bucket is also sent to the bucket before it, so each bucket is sorted by itself: one shuffle of the texts.
    Null ids come last; rows with equal ids follow the hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    n = min(MOST_BUCKETS, SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("x")).first()["x"] or []
    bounds = sorted(set(bounds))
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])
    above = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(
        F.col("doc_id") > F.get(cuts, at + step - 1), step).otherwise(0))
    bucket = F.coalesce(above, F.lit(0))
    tops = {r["b"]: r["top"] for r in rows.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    size = len(bounds) + 1
    top = F.get(F.array(*[F.lit(tops.get(b)).cast("long") for b in range(size)]), F.col("b"))
    to = F.get(F.array(*[F.lit(before.get(b, b)) for b in range(size)]), F.col("b"))
    here = F.struct(F.col("b").alias("bucket"), F.lit(False).alias("extra"))
    there = F.struct(to.alias("bucket"), F.lit(True).alias("extra"))
    dealt = rows.withColumn("b", bucket).withColumn("at", F.explode(
        F.when(F.col("doc_id").eqNullSafe(top), F.array(here, there)).otherwise(F.array(here))))
    moved = dealt.select("doc_id", "text", F.col("at.bucket").alias("bucket"), F.col("at.extra").alias("extra")).repartition("bucket")
    keyed = moved.withColumn("keys", digests(F.col("text"))).withColumn("text_key", F.xxhash64("text"))
    follows = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc_nulls_last(), "text_key")
    return keyed.select(
        "doc_id", "text", "keys", "extra", F.lead("text").over(follows).alias("next_text"),
        F.lead("keys").over(follows).alias("next_keys"),
    ).filter(~F.col("extra")).drop("extra")


def versions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the first floor(n_chars / 3) code points of the next document, or all of them, in place of its
    own last ones. Null texts are empty; a text without a word has an empty sketch. Equal texts have equal fingerprints.
    Extra columns are not read; an empty table gives an empty result.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    held = stored(with_next(docs).withColumn("edited", edited).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("keys").alias("a"), digests(F.col("edited")).alias("b"), F.col("next_keys").alias("c")), "sketch-digests")
    arrays = held.select("rid", "a", "b", "c").repartition("rid")
    rows = arrays.select("rid", F.posexplode(F.array("a", "b", "c")).alias("v", "keys")).select(
        "rid", "v", F.explode("keys").alias("key"), F.lit(1).cast("long").alias("n"), F.lit(WIDTH).cast("long").alias("width"))
    base = sketch(rows, ["rid", "v"])
    prints = base.filter("v < 2").groupBy("rid").agg(written(0).alias("fingerprint"), written(1).alias("edited_fingerprint"))
    near = differences(arrays, base).groupBy("rid").agg(*[
        F.max(F.when(F.col("pair") == p, F.col("differing"))).alias(f"differing_{p}") for p in (1, 2)])
    return held.join(prints, "rid", "left").join(near, "rid", "left").select(
        "doc_id", "n_chars", "edited_sha256",
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b"), F.col("differing_1")).alias("near_edited"),
        likeness(F.col("a"), F.col("c"), F.col("differing_2")).alias("near_next"))
