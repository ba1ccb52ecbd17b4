"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into bins. Document frequencies are counted over all documents that may be
learned from; the weights are trained by follow-the-regularised-leader with an elastic net (L1 and L2) on a bounded sample,
and a temperature calibrates the probabilities on a part of the sample that the weights have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 14
#: Bounds of the training sample: documents per language, and languages (those with the most documents).
DOCS_PER_LANG, LANGS = 800, 256
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.001
#: Characters that are counted at once; a longer text is counted in such blocks.
BLOCK = 1 << 20
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """How often each bin's n-grams occur in a whole text, lower-cased."""
    total = np.zeros(BINS, np.int64)
    lowered = f" {text.lower()} "
    for at in range(0, max(1, len(lowered) - 2), BLOCK):
        block = lowered[at: at + BLOCK + 2]
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = codes[:BLOCK] if at + BLOCK < len(lowered) - 2 else codes
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + codes[2:]
        for grams in (own * np.uint32(0x27D4EB2F), two[: len(own)] * np.uint32(0xC2B2AE3D), three[: len(own)] * np.uint32(0x165667B1)):
            total += np.bincount((grams ^ (grams >> np.uint32(15))) >> np.uint32(4) & np.uint32(BINS - 1), minlength=BINS)
    return total


def learnable(doc_id: Column) -> Column:
    """Whether a document may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, bins: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The TF-IDF values of the occupied bins, of length 1."""
        value = np.log1p(n) * self.idf[bins]
        return value / (np.linalg.norm(value) or 1.0)

    def logits(self, bins: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weights[:, bins] @ self.vector(bins, n)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], idf: np.ndarray) -> Model:
    """FTRL over the rows (bins, counts, language); every fifth row is kept for the temperature."""
    model = Model(langs, idf, np.zeros((len(langs), BINS)))
    z, squares = np.zeros((len(langs), BINS)), np.zeros((len(langs), BINS))
    learn, rest = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 10], [r for i, r in enumerate(rows) if i % 5 == 0]
    for _ in range(EPOCHS):
        for bins, n, lang in learn:
            x = model.vector(bins, n)
            held, square = z[:, bins], squares[:, bins]
            w = np.where(np.abs(held) <= L1, 0.0, (np.sign(held) * L1 - held) / ((BETA + np.sqrt(square)) / ALPHA + L2))
            g = np.outer(softmax(w @ x) - (np.arange(len(langs)) == lang), x)
            z[:, bins] = held + g - (np.sqrt(square + g * g) - np.sqrt(square)) / ALPHA * w
            squares[:, bins] = square + g * g
    model.weights = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(squares)) / ALPHA + L2))
    if rest and len(langs) > 1:
        logits, want = np.array([model.logits(b, n) for b, n, _ in rest]), np.array([r[2] for r in rest])
        grid = np.geomspace(0.05, 5, 60)
        losses = [-np.log(softmax(logits / t)[np.arange(len(want)), want] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def fit(docs: DataFrame) -> Model:
    """The model of the learnable rows: texts that are not null, with a language.

    Document frequencies: each task sends one row per bin at most, so what is shuffled and sent to the driver is bounded
    by BINS. Sample: the DOCS_PER_LANG smallest hashes of each of LANGS languages; the number of a language's documents tells which
    hashes can be among them, so a language's task ranks little more than the sample. Repeated rows count once, and of an id's
    texts in a language the least is taken.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                total += counts(text.as_py()) > 0
                n += 1
        used = np.flatnonzero(total)
        yield pa.record_batch({"bin": pa.array(np.append(used, -1)), "n": pa.array(np.append(total[used], n))})

    found = known.select("text").mapInArrow(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    held = {r.bin: r.n for r in found}
    n_docs = held.pop(-1, 0)
    df = np.zeros(BINS)
    df[list(held)] = list(held.values())
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    order = F.xxhash64("doc_id")
    sizes = known.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(LANGS)
    share = (DOCS_PER_LANG + 8 * DOCS_PER_LANG ** 0.5) / F.col("size")
    early = known.select("doc_id", "lang").join(F.broadcast(sizes), "lang").filter(
        order.cast("double") / 2.0 ** 64 + 0.5 < share).select("doc_id", "lang").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    picked = early.withColumn("nth", nth).filter(F.col("nth") <= DOCS_PER_LANG).drop("nth")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in batch.column("text")]
            bins = [np.flatnonzero(c) for c in found]
            yield pa.record_batch({
                "lang": batch.column("lang"), "bins": pa.array([b.tolist() for b in bins], pa.list_(pa.int32())),
                "n": pa.array([c[b].tolist() for c, b in zip(found, bins)], pa.list_(pa.int64())),
            })

    texts = known.select("doc_id", "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"]).groupBy(
        "doc_id", "lang").agg(F.min("text").alias("text")).orderBy(order, "lang")
    rows = texts.select("lang", "text").mapInArrow(vectors, "lang string, bins array<int>, n array<long>").collect()
    langs = sorted({r.lang for r in rows})
    return train([(np.array(r.bins), np.array(r.n), langs.index(r.lang)) for r in rows], langs, idf)


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (the probability of lang_pred).

    Texts that are null or have no letter are UNKNOWN with score 0, and so is every text if there is nothing to learn
    from. Repeated rows are predicted alike; only text is read for a prediction. An empty table gives an empty result.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for value in batch.column("text"):
                text = value.as_py()
                if text is None or not model.langs or not LETTER.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                n = counts(text)
                bins = np.flatnonzero(n)
                chance = softmax(model.logits(bins, n[bins]) / model.temperature)
                names.append(model.langs[int(chance.argmax())])
                scores.append(float(chance.max()))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()),
            })

    rows = docs.select("doc_id", "text", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
