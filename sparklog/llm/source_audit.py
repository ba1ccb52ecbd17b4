"""Source divergence audit: how far the word use of each source of a language lies from the others and from the language.

Tasks count terms with Arrow kernels and send partial counts. The counts of a language's kept terms are dealt into columnar
shards of bounded size, and each shard computes its part of every divergence on whole columns. All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import join_counted, stored

#: Everything in ASCII but letters stands between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
#: Bytes of text that are split at once, and counts that a task holds before it sends them.
SLICE_BYTES = 4 << 20
HELD_ROWS = 1 << 20
#: Cells (sources times terms) of one columnar shard; a shard has four terms per source at least, as it sends a value for every
#: two sources.
SHARD_CELLS = 1 << 16
PARTIAL = "lang string, source string, term string, n long, docs long"
DIVERGENCE = "lang string, i int, j int, term string, value long"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about SLICE_BYTES of text; a longer text is a range of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) of a batch."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BETWEEN)
    doc, term = pc.list_parent_indices(words), pc.list_flatten(words)
    real = pc.greater(pc.binary_length(term), 0)
    doc, term = doc.filter(real), term.filter(real).dictionary_encode()
    by_doc = pa.table({"doc": doc, "code": term.indices}).group_by(["doc", "code"]).aggregate([([], "count_all")])
    by_group = pa.table({
        "lang": batch.column("lang").take(by_doc["doc"]), "source": batch.column("source").take(by_doc["doc"]),
        "code": by_doc["code"], "n": by_doc["count_all"],
    }).group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    return pa.table({
        "lang": by_group["lang"], "source": by_group["source"], "term": pa.chunked_array([term.dictionary]).take(by_group["code"]),
        "n": by_group["n_sum"].cast(pa.int64()), "docs": by_group["n_count"].cast(pa.int64()),
    })


def _merged(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return found.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(docs: DataFrame) -> DataFrame:
    """Counts per (lang, source, term), merged within each task; one group may have a row from every task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for piece in _slices(batch):
                held.append(count_terms(piece))
                rows += held[-1].num_rows
                if rows > HELD_ROWS:
                    held = [_merged(held)]
                    rows = held[0].num_rows
                    if rows > HELD_ROWS // 2:
                        yield from held[0].to_batches()
                        held, rows = [], 0
        if held:
            yield from _merged(held).to_batches()

    return docs.select("lang", "source", "text").mapInArrow(run, PARTIAL)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / total), exact; Python integers where 64 bits would not hold the product."""
    if counts.size and counts.max() > (1 << 62) // SCALE:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + SCALE * (counts + SMOOTH) // totals).astype(np.int64)


def shard_divergence(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """One shard's part of the divergence of every two sources of its language, and each source's best terms of the shard."""
    groups = groups.sort_by("no")
    lang, n_groups, n_terms = groups["lang"][0].as_py(), groups.num_rows, terms.num_rows
    vocabulary = groups["vocabulary"][0].as_py()
    totals = groups["total"].to_numpy()
    own = terms["own"].combine_chunks() if n_terms else pa.array([], terms.schema.field("own").type)
    flat = own.flatten()
    counts = np.zeros((n_groups, n_terms), np.int64)
    at = pc.index_in(flat.field("source"), groups["source"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    counts[at, pc.list_parent_indices(own).to_numpy()] = flat.field("n").to_numpy()
    p = shares(counts, (totals + SMOOTH * vocabulary)[:, None])
    q = shares(counts.sum(axis=0), np.array([totals.sum() + SMOOTH * vocabulary]))
    i, j, term, value = [], [], [], []
    for one in range(n_groups):
        rest = np.arange(one + 1, n_groups)
        i.append(np.full(len(rest), one))
        j.append(rest)
        term += [None] * len(rest)
        value.append(np.abs(p[one + 1:] - p[one]).sum(axis=1))
        over = np.flatnonzero((counts[one] > 0) & (p[one] > q))
        gain = p[one][over] - q[over]
        if len(over) > TOP_TERMS:
            least = np.partition(gain, -TOP_TERMS)[-TOP_TERMS]
            over, gain = over[gain >= least], gain[gain >= least]
        best = sorted(zip((-gain).tolist(), terms["term"].take(over).to_pylist()))[:TOP_TERMS]
        i.append(np.full(len(best), one))
        j.append(np.full(len(best), -1))
        term += [t for _, t in best]
        value.append(np.array([-g for g, _ in best], np.int64))
    j = np.concatenate(j)
    return pa.table({
        "lang": pa.array([lang] * len(j), pa.string()), "i": pa.array(np.concatenate(i), pa.int32()),
        "j": pa.array(j, pa.int32(), mask=j < 0), "term": pa.array(term, pa.string()), "value": pa.array(np.concatenate(value), pa.int64()),
    })


def divergences(docs: DataFrame) -> DataFrame:
    """Rows lang, source, part, item, value, rank: part ``pair`` compares a source with each other source of its language,
    part ``term`` names the terms that a source uses most beyond its language, at most TOP_TERMS.

    Null text, lang and source are read as ''. Repeated rows count as documents of their own; ties are ranked by item.
    A language without kept terms has pairs of value 0; an empty table gives an empty result. Extra columns are not read.
    The result itself has a row for every two sources of a language, so their number is taken to be thousands at most;
    a shard holds SHARD_CELLS counts, or four terms of each source where that is more.
    """
    rows = docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("lang", "source", "text")])
    merged = partial_counts(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = stored(merged.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("own"),
    ).filter(F.col("docs") >= MIN_DOCS).drop("docs"), "audit-terms")

    used = kept.select("lang", F.inline("own")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(rows.select("lang", "source").distinct().join(used, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"),
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("no")), "audit-groups")
    width = F.greatest(F.floor(SHARD_CELLS / F.col("sources")), 4 * F.col("sources"))
    langs = stored(groups.groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept.groupBy("lang").agg(F.count("*").alias("vocabulary")), "lang", "left").select(
        "lang", "sources", F.coalesce("vocabulary", F.lit(0).cast("long")).alias("vocabulary")).withColumn(
        "shards", F.greatest(F.lit(1), F.ceil(F.col("vocabulary") / width)).cast("int")), "audit-langs")
    dealt = join_counted(kept, langs.select("lang", "vocabulary", "shards"), "lang", "vocabulary", kept.count()).select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term", "own")
    sides = groups.join(langs, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "no", "source", "total", "vocabulary")
    parts = stored(dealt.groupBy("lang", "shard").cogroup(sides.groupBy("lang", "shard")).applyInArrow(
        shard_divergence, DIVERGENCE), "audit-parts")

    def name(index: str, alias: str) -> DataFrame:
        return groups.select("lang", F.col("no").alias(index), F.col("source").alias(alias))

    sums = parts.filter(F.col("j").isNotNull()).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    pairs = sums.join(name("i", "a"), ["lang", "i"]).join(name("j", "b"), ["lang", "j"]).select(
        "lang", F.inline(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")])), "value")
    terms = parts.filter(F.col("j").isNull()).join(name("i", "source"), ["lang", "i"]).select("lang", "source", "term", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [
        pairs.withColumn("part", F.lit("pair")).withColumn("rank", place),
        terms.withColumnRenamed("term", "item").withColumn("part", F.lit("term")).withColumn("rank", place).filter(
            F.col("rank") <= TOP_TERMS),
    ]
    return ranked[0].unionByName(ranked[1]).select("lang", "source", "part", "item", "value", "rank")
