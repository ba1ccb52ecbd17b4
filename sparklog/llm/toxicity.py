"""Toxicity by compression distance: how much shorter a window of text becomes with a dictionary of toxic text.

Both zstandard dictionaries hold ordinary text; the toxic one also holds what marks toxic text: words whose stem stands in
many different contexts of toxic documents and hardly any of ordinary ones (contexts, because copies of one document
repeat its words, but not in new contexts). The ordinary one is padded to the same length, so that matches in the common part
cost the same with both. The difference of a window's two compressed lengths is its distance; the shares
of a document's windows over several thresholds are calibrated to a probability on documents that the dictionaries had
not seen. Contexts, markers and distances are computed by tasks over whole texts of the sample; the driver receives the markers, the
windows of the ordinary dictionary and one row of numbers per sampled document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import stored, text_of

#: Bounds of the training sample: documents of each class (whole texts), and windows that the ordinary dictionary is trained on.
TOXIC_DOCS, ORDINARY_DOCS, DICTIONARY_WINDOWS = 2000, 5000, 20_000
WINDOW_BYTES = 64
ORDINARY_BYTES, MARKER_WORDS = 14_000, 400
#: A marker's stem (its first LEAST letters or more) has RATIO times the contexts in toxic text, for its size, and so many
#: contexts at least: LEAST, and SHARE of the number of toxic documents.
RATIO, SHARE, LEAST = 20, 0.005, 4
LEVEL = 5
THRESHOLDS = (2, 3, 4, 5, 6)
DECISION = 0.7
WORD = re.compile(rb"[^\x00-\x20.,;:!?\"'()#*$%&|<>]+")


def windows(text: str) -> list[bytes]:
    """A whole text, lowered, as windows of whole words, each the first to reach WINDOW_BYTES."""
    found, at = [], 0
    data = b" ".join(text.lower().encode("utf-8", "surrogatepass").split())
    while at < len(data):
        end = data.find(b" ", at + WINDOW_BYTES)
        end = len(data) if end < 0 else end
        found.append(data[at:end])
        at = end + 1
    return found


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        return [zstandard.ZstdCompressor(
            level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False,
            dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        ) for content in (self.ordinary, self.toxic)]


def train(samples: list[bytes], markers: list[bytes]) -> Dictionaries:
    """The two dictionaries, from windows of ordinary text and the markers of toxic text."""
    try:
        base = zstandard.train_dictionary(ORDINARY_BYTES + 2000, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        base = b" ".join(samples)
    base = base[-ORDINARY_BYTES:] or b"    "
    tail = b" " + b" ".join(markers) + b" "
    return Dictionaries(base + b"\x00" * len(tail), base + tail)


def features(parts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """The distances of a document's windows: shares over each threshold, the largest and the mean of the three largest."""
    if not parts:
        return np.zeros(2 * len(THRESHOLDS) + 2)
    ordinary, toxic = (c.compress for c in compressors)
    gains = np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in parts), np.int64, len(parts))
    counts = np.array([(gains >= t).sum() for t in THRESHOLDS])
    return np.concatenate([np.sqrt(counts / len(gains)), np.log1p(counts), [
        max(gains.max(), 0), max(np.sort(gains)[-3:].mean(), 0)]])


@dataclass
class Model:
    dictionaries: Dictionaries
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.centre) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrated(dictionaries: Dictionaries, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """A logistic regression of the labels on the distances. ``share`` is the toxic share of all labelled rows, to which the
    sample's is brought back."""
    share, n_toxic = float(np.clip(share, 1e-9, 1 - 1e-9)), int(y.sum())
    if n_toxic < 2 or len(y) - n_toxic < 2:
        n = 2 * len(THRESHOLDS) + 2
        return Model(dictionaries, np.zeros(n), np.ones(n), np.zeros(n), float(np.log(share / (1 - share))))
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    ridge, w = np.diag([1.0] * (x.shape[1] - 1) + [1e-6]), np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    odds = np.log(n_toxic / (len(y) - n_toxic))
    return Model(dictionaries, centre, scale, w[:-1], float(w[-1] - odds + np.log(share / (1 - share))))


def learnable(doc_id: Column) -> Column:
    """Whether a document's label may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """The training sample (toxic, half, text), stored, and the toxic share of the labelled rows.

    It holds the documents with the smallest hashes of each class; rows of an id with any toxic label are toxic, and of an id's texts the
    least is taken. Null ids and labels are left out.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = known.filter("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_DOCS).unionByName(
        known.filter("toxic = 0").orderBy(order, "doc_id").limit(ORDINARY_DOCS))
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(
        F.min("text").alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    total = sum(counts.values())
    return stored(texts.select("toxic", half, "text"), "toxic-sample"), counts.get(1, 0) / total if total else 0.0


def markers(sampled: DataFrame) -> dict[int, list[bytes]]:
    """The markers of half 0, half 1 and (under 2) of the whole sample, the strongest last; at most MARKER_WORDS each."""
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for toxic, half, text in zip(*(batch.column(c).to_pylist() for c in ("toxic", "half", "text"))):
                seen = set()
                for part in windows(text):
                    words = WORD.findall(part)
                    seen.update(zip(words, [b"", *words], [*words[1:], b""]))
                rows += [(toxic, half, word, before + b" " + after) for word, before, after in seen]
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                  names=["toxic", "half", "word", "context"])

    found = sampled.mapInArrow(contexts, "toxic int, half int, word binary, context binary")
    every = found.select("toxic", F.explode(F.array("half", F.lit(2))).alias("half"), "word", F.xxhash64("context").alias("context"))
    counts = stored(every.distinct().groupBy("half", "toxic", "word").agg(F.count("*").alias("n")), "toxic-words")
    ours, theirs = F.sum(F.col("n") * F.col("toxic")), F.sum(F.col("n") * (1 - F.col("toxic")))
    sizes = counts.groupBy("half").agg((F.greatest(theirs, F.lit(1)) / F.greatest(ours, F.lit(1))).alias("size"))
    n_docs = sampled.select("toxic", F.explode(F.array("half", F.lit(2))).alias("half")).groupBy("half").agg(F.sum("toxic").alias("n_toxic"))
    stem = F.explode(F.transform(F.sequence(F.lit(LEAST), F.octet_length("word")), lambda k: F.substring("word", F.lit(1), k))).alias("stem")
    long = counts.filter(F.octet_length("word") >= LEAST)
    stems = long.select("half", "toxic", "n", stem).groupBy("half", "stem").agg(ours.alias("many"), theirs.alias("few"))
    marks = stems.join(F.broadcast(sizes.join(n_docs, "half")), "half").filter(
        (F.col("many") >= F.greatest(F.lit(LEAST), SHARE * F.col("n_toxic"))) & (F.col("many") * F.col("size") >= RATIO * (F.col("few") + 0.5)))
    chosen = long.filter("toxic = 1").select("half", "word", "n", stem).join(marks, ["half", "stem"]).select("half", "word", "n").distinct()
    place = F.row_number().over(Window.partitionBy("half").orderBy(F.desc("n"), F.desc("word")))
    rows = chosen.withColumn("place", place).filter(F.col("place") <= MARKER_WORDS).collect()
    return {half: [bytes(r.word) for r in sorted(rows, key=lambda r: -r.place) if r.half == half] for half in (0, 1, 2)}


def ordinary_windows(sampled: DataFrame) -> dict[int, list[bytes]]:
    """The windows of ordinary text with the smallest hashes, by half (2: both), at most DICTIONARY_WINDOWS each."""
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, text in zip(batch.column("half").to_pylist(), batch.column("text").to_pylist()):
                own = windows(text)
                yield pa.record_batch({"half": pa.array([half] * len(own), pa.int32()), "part": pa.array(own, pa.binary())})

    cut = sampled.filter("toxic = 0").select("half", "text").mapInArrow(parts, "half int, part binary")
    order = (F.xxhash64("part"), "part")
    return {half: [bytes(r.part) for r in cut.filter(F.lit(half == 2) | (F.col("half") == half)).orderBy(*order).limit(
        DICTIONARY_WINDOWS).collect()] for half in (0, 1, 2)}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries of the whole sample, calibrated on halves that the other halves' dictionaries score, whole texts each."""
    sampled, share = sample(docs, labels)
    marked, samples = markers(sampled), ordinary_windows(sampled)
    trained = {half: train(samples[half], marked[half]) for half in (0, 1, 2)}

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = {half: trained[1 - half].compressors() for half in (0, 1)}
        for batch in batches:
            rows = [features(windows(text), tools[half]).tolist() for half, text in zip(
                batch.column("half").to_pylist(), batch.column("text").to_pylist())]
            yield pa.record_batch({"toxic": batch.column("toxic"), "x": pa.array(rows, pa.list_(pa.float64()))})

    found = sampled.mapInArrow(distances, "toxic int, x array<double>").collect()
    found.sort(key=lambda r: (r.toxic, r.x))  # the sums below must not depend on the order of tasks
    return calibrated(trained[2], np.array([r.x for r in found]), np.array([r.toxic for r in found], float), share)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no windows and get the score of a text without distances. Repeated rows are scored alike.
    Without labels of both classes the score is the toxic share of the labelled rows. Only text is scored; other columns
    are not read. An empty table gives an empty result. Null ids count as learnable text without a label.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.dictionaries.compressors()
        for batch in batches:
            rows = [features(windows(t.as_py() or ""), tools) for t in batch.column("text")]
            scores = model.score(np.array(rows)) if rows else np.zeros(0)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(scores),
                "predicted": pa.array((scores >= DECISION).astype(np.int32)),
            })

    rows = docs.select("doc_id", "text", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
