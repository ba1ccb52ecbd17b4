"""Substring deduplication by hashing the clauses of each line: the earliest occurrence of a clause stays, later ones go,
with their offsets in the original text retained.

A clause ends at a punctuation mark before white space, or with its line, so a passage is found from its first to its
last whole clause wherever it begins inside a line, and a changed word costs one clause. A single short clause or line
that many documents share (a heading, a licence) is no repeated passage: repeated clauses are removed only where they
follow one another for MIN_WORDS words or more, or for half as many that hold the ends of two sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import join_counted, stored

MIN_WORDS = 50
#: Rows of a batch that a task emits.
BATCH_UNITS = 100_000
#: Clauses of at least this share of all are joined where they are (100,000 at most).
COMMON_SHARE = 1e-5
CLAUSE_END = re.compile(r"[.!?,;:]+[\"')\]]*(?=\s)")
SENTENCE_END = re.compile(r"[.!?][\"')\]]*$")
UNIT_FIELDS = "text_key long, unit int, line int, start long, end long, words int, ends boolean, digest binary"


def clauses(line: str) -> Iterator[tuple[int, int, list[str]]]:
    """The clauses of a line that have a word: start and end in the line, normalised words (lower case). The first begins and
    the last ends with the line; the white space before any other belongs to none."""
    at, found = 0, []
    for end in [*(m.end() for m in CLAUSE_END.finditer(line)), len(line)]:
        words = line[at:end].lower().split()
        if words:
            start = at + len(line[at:end]) - len(line[at:end].lstrip()) if at else 0
            found.append((start, end, words))
        at = end
    if found:
        start, _, words = found[-1]
        found[-1] = (start, len(line), words)
    return iter(found)


def units_of(docs: DataFrame) -> DataFrame:
    """A row per clause: doc_id, text_key, unit (its number), line (the number of its line), start and end (code points,
    without the line break), words, ends (a sentence ends with it), digest (128 bits of the normalised clause)."""
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers = [], [[] for _ in kinds]

            def rows() -> pa.RecordBatch:
                keys = batch.select(["doc_id", "text_key"]).take(pa.array(at, pa.int64()))
                return pa.record_batch(
                    [*keys.columns, *(pa.array(c, k) for c, k in zip(numbers, kinds))],
                    names=["doc_id", "text_key", "unit", "line", "start", "end", "words", "ends", "digest"])

            for row, value in enumerate(batch.column("text")):
                start = unit = 0
                for number, line in enumerate((value.as_py() or "").split("\n")):
                    for begin, end, words in clauses(line):
                        at.append(row)
                        digest = blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        ends = SENTENCE_END.search(words[-1]) is not None
                        for column, x in zip(numbers, (unit, number, start + begin, start + end, len(words), ends, digest)):
                            column.append(x)
                        unit += 1
                    start += len(line) + 1
                if len(at) >= BATCH_UNITS:
                    yield rows()
                    at, numbers = [], [[] for _ in kinds]
            yield rows()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {UNIT_FIELDS}")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per passage to remove: doc_id, text_key, start, end (code points of the original text), words, lines
    (those it touches), kept_doc_id, kept_start (where its first clause stays).

    Clauses are ranked by (doc_id, text hash, place), null ids last, and the first of each digest stays. Rows with equal
    doc_id and text count as one document. Null and empty texts have no clauses. Extra columns are not read; an empty table
    gives an empty result. A clause that a third of all rows share is counted in each task first and joined by broadcast.
    """
    units = stored(units_of(docs), "clauses")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                    F.col("text_key").alias("key"), F.col("unit").alias("unit"), F.col("start").alias("start"))
    groups = stored(units.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("first")).filter("n > 1"), "clause-groups")
    own = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.key")) & (
        F.col("unit") == F.col("first.unit"))
    later = join_counted(units, groups, "digest", "n", units.count(), COMMON_SHARE).filter(~own).select(
        "doc_id", "text_key", "unit", "line", "start", "end", "words", "ends",
        F.col("first.id").alias("kept_id"), F.col("first.start").alias("kept_start"))
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("unit")
    once = later.withColumn("before", F.lag("unit").over(by_doc)).filter("before IS NULL OR before < unit")
    runs = once.withColumn("run", F.col("unit") - F.row_number().over(by_doc))
    first = F.min(F.struct("unit", F.col("kept_id").alias("id"), F.col("kept_start").alias("start")))
    long_enough = (F.col("words") >= min_words) | ((2 * F.col("words") >= min_words) & (F.col("ended") >= 2))
    return runs.groupBy("doc_id", "text_key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").cast("long").alias("words"),
        F.size(F.collect_set("line")).cast("long").alias("lines"), F.count_if("ends").alias("ended"), first.alias("kept"),
    ).filter(long_enough).select(
        "doc_id", "text_key", "start", "end", "words", "lines",
        F.col("kept.id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The documents with their own columns, their text without the spans and the white-space character after each.

    A line break stays where the span begins inside a line, of which a part is left. n_chars, where there is one, follows the text. A document that had words and has none left goes.
    """
    cuts = spans.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts")).select(
        F.col("doc_id").alias("cut_id"), F.col("text_key").alias("cut_key"), "cuts")
    names = docs.columns
    c = {name: F.col(f"c{i}") for i, name in enumerate(names)}
    keyed = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)], F.xxhash64("text").alias("text_key"))
    joined = keyed.join(cuts, c["doc_id"].eqNullSafe(F.col("cut_id")) & (F.col("text_key") == F.col("cut_key")), "left")
    size = F.length(c["text"]).cast("long")

    def char(at: Column) -> Column:
        return F.substring(c["text"], (at + 1).cast("int"), F.lit(1))

    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda s: s["end"] + F.when(
        (char(s["end"]) == "\n") & (s["start"] > 0) & (char(s["start"] - 1) != "\n"), 0).otherwise(1)))
    ends = F.concat(F.transform("cuts", lambda s: s["start"]), F.array(size))
    parts = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: F.substring(
        c["text"], (p["a"] + 1).cast("int"), F.greatest(p["b"] - p["a"], F.lit(0)).cast("int")))
    cut = joined.withColumn("rest", F.when(F.col("cuts").isNull(), c["text"]).otherwise(F.array_join(parts, "")))
    left = cut.filter(F.col("cuts").isNull() | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("rest"), "n_chars": F.when(F.col("cuts").isNull(), c.get("n_chars", F.lit(None))).otherwise(
        F.length("rest").cast("long"))}
    return left.select(*[new.get(n, c[n]).cast(docs.schema[n].dataType).alias(n) for n in names])


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated passages."""
    return remove_spans(docs, repeated_spans(docs, min_words))
