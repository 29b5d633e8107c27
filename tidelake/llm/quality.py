"""Quality classifier: a linear hinge-loss model on naive-Bayes-scaled n-grams.

A text's features are the indicators of its byte 3-grams and of its word pairs, each
hashed into a fixed number of slots.  A word n times in a row (n from 2 to RUNS + 1)
counts as the same n-gram whatever the word.  Each indicator is scaled by the log ratio of its
smoothed class counts, each text's vector to length 1, and the hinge loss is
minimised by dual coordinate descent.  A sigmoid fitted on the margins of texts left
out of the fit turns margins into scores.

Only the fit sees a bounded sample: `sample` labelled rows at most, in the order of a
hash of doc_id.  Scoring maps each text on its own, so memory is bounded by a batch,
no row is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import kernels

GRAM_BITS = 15
PAIR_BITS = 14
RUNS = 12
#: Texts whose indicators are held at once, a byte for each slot; short and empty texts are many in a batch.
ROWS = 512
SLOTS = (1 << GRAM_BITS) + (1 << PAIR_BITS)
_U = np.uint64


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the distinct features, ordered by both."""
    n = len(offsets) - 1
    seen = np.zeros((n, SLOTS), dtype=bool)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) >= 3:
        low = data.astype(np.uint32)
        gram = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
        whole = owner[:-2] == owner[2:]
        seen[owner[:-2][whole], gram[whole]] = True
    h, bounds = kernels.words(data, offsets, lower=False)
    if len(h) >= 2:
        word_owner = np.repeat(np.arange(n), np.diff(bounds))
        pair = (h[:-1] * _U(0x9E3779B97F4A7C15) + h[1:]) * _U(0xD6E8FEB86659FD93)
        slot = (pair >> _U(64 - PAIR_BITS)).astype(np.int64)
        slot[slot < RUNS] += RUNS
        whole = word_owner[:-1] == word_owner[1:]
        same = whole & (h[:-1] == h[1:])
        different = whole & ~same
        seen[word_owner[:-1][different], (1 << GRAM_BITS) + slot[different]] = True
        run = same
        for k in range(RUNS):
            if not run.any():
                break
            seen[word_owner[: len(run)][run], (1 << GRAM_BITS) + k] = True
            run = run[:-1] & same[k + 1 :]
    return np.nonzero(seen)


@dataclass(frozen=True)
class QualityModel:
    """weights: of each slot, class ratio and hinge weight multiplied; the margin is
    their sum over a text's features divided by the length of its scaled vector."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        owner, slot = indicators(data, offsets)
        length = np.sqrt(np.bincount(owner, self.squares[slot], n))
        margin = np.bincount(owner, self.weights[slot], n) / np.maximum(length, 1e-12) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float, epochs: int):
    """Dual coordinate descent for the L1 hinge loss; the last weight is the bias."""
    w, alpha = np.zeros(SLOTS + 1), np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            slot, value = rows[i]
            gradient = y[i] * (w[slot] @ value + w[-1]) - 1.0
            old = alpha[i]
            alpha[i] = min(max(old - gradient / 2.0, 0.0), c)  # the vector's square plus the bias's
            if alpha[i] != old:
                step = (alpha[i] - old) * y[i]
                w[slot] += step * value
                w[-1] += step
    return w


def fit(features: list[np.ndarray], labels: np.ndarray, c: float = 4.0, epochs: int = 12) -> QualityModel:
    """Without rows of both classes, every score is the share of label 1 (0.5 if none)."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    share = float((y > 0).mean()) if len(y) else 0.5
    if not 0 < share < 1:
        flat = float(np.clip(share, 0.01, 0.99))
        none = np.zeros(SLOTS)
        return QualityModel(none, none, 0.0, 0.0, float(np.log(flat / (1 - flat))))
    good, bad = np.ones(SLOTS), np.ones(SLOTS)
    for slots, label in zip(features, y, strict=True):
        (good if label > 0 else bad)[slots] += 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    rows = []
    for slots in features:
        value = ratio[slots]
        rows.append((slots, value / max(np.linalg.norm(value), 1e-12)))
    aside = np.arange(len(rows)) % 5 == 0
    part = [r for r, out in zip(rows, aside, strict=True) if not out]
    trial = _coordinate_descent(part, y[~aside], c, epochs)
    margins = np.array([trial[s] @ v + trial[-1] for (s, v), out in zip(rows, aside, strict=True) if out])
    slope, shift = _sigmoid(margins, y[aside] > 0)
    w = _coordinate_descent(rows, y, c, epochs)
    return QualityModel(w[:-1] * ratio, ratio**2, float(w[-1]), slope, shift)


def _sigmoid(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(good) = 1 / (1 + exp(-(slope * margin + shift))), smoothed targets."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * (beta - [1.0, 0.0]))
    return float(beta[0]), float(beta[1])


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, sample: int = 6000) -> QualityModel:
    """Fit on at most `sample` labelled rows that are not held out, taken in the order
    of a hash of doc_id.  Rows without text, id or label teach nothing; an id with
    several labels counts as its smallest, one with several texts as its greatest, so the
    bound holds for rows too.  doc_id may be of any type that orders as text."""
    kernels.small_batches(documents)
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where(~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = documents.where("text is not null").select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most `sample` ids and labels
    rows = rows.groupBy("doc_id", "quality").agg(F.max("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.string_buffers(batch.column("text"))
            for i, j in kernels.slices(offsets, 1 << 18, ROWS):
                owner, slot = indicators(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cuts = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j],
                        batch.column("quality")[i:j].cast(pa.int32()),
                        pa.ListArray.from_arrays(cuts, pa.array(slot.astype(np.int32))),
                    ],
                    ["doc_id", "quality", "slots"],
                )

    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "text")
    table = rows.mapInArrow(extract, "doc_id string, quality int, slots array<int>").toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    slots = table.column("slots")
    features = [np.asarray(x.values) for x in slots] if len(slots) else []
    return fit(features, table.column("quality").to_numpy())


def score(documents: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of `documents` with `score` and `predicted` (1 if score >= threshold).

    The score depends on the text alone; a null text scores as an empty one.  Columns
    of these names in the input are replaced; all others stay as they are."""
    kernels.small_batches(documents)
    kept = [c for c in documents.columns if c.lower() not in ("score", "predicted")]
    source = documents.select(*[f"`{c}`" for c in kept])
    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType(list(source.schema.fields)).add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.string_buffers(batch.column("text"))
            parts = [
                model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for i, j in kernels.slices(offsets, 1 << 18, ROWS)
            ]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                [*kept, "score", "predicted"],
            )
        kernels.tidy()

    return source.mapInArrow(run, schema)


def classify(documents: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.3) -> DataFrame:
    """Every row of `documents` scored by a model fitted on `labels`."""
    return score(documents, train(documents, labels, sample), threshold)
