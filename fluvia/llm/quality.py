"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and lifted by random cosine features, whose inner products
approximate a Gaussian kernel.  Every partition sums its part of the normal equations, the sums are added up,
and the driver solves a system of a fixed size.  Ridge scores are counted into a fixed number of bins by label;
pool-adjacent-violators over the bins makes them probabilities.  All labelled training rows take part.

Defined cases: a null text counts as empty and gets a score like any text; labels that are null or belong to no
document are left out, several labels of one document each count; without any training row every score is 0.5;
rows with a null id are scored and never trained on; other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.llm.common import held_out_remainder, per_batch, stored, sum_vectors, vector_rows

FOURIER, RIDGE, BINS = 192, 1e-3, 4096
#: Kernel width in standard deviations of a statistic, times the root of their number.
WIDTH = 1.0
_MARKS = b"#$%&*!|<>{}@=_"


def statistics(text: str | None) -> list[float]:
    """Shares and rates over the whole text; an empty text has zeros."""
    text = text or ""
    words = text.split()
    n, k = max(1, len(text)), max(1, len(words))
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    lines = text.split("\n")
    distinct = len(set(words))
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths <= 3).mean()),
        float((lengths >= 12).mean()),
        distinct / k,
        distinct / k**0.75,
        sum(map(operator.eq, words, words[1:])) / k,
        len(set(zip(words, words[1:]))) / k,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)) / np.log1p(len(words) + 1),
        float(count[65:91].sum()),
        float(count[97:123].sum()),
        float(count[48:58].sum()),
        float(count[128:].sum()),
        float(count[32]),
        float(count[46]),
        float(count[44]),
        float(count[33]),
        float(count[124]),
        float(np.sqrt(count[list(_MARKS)].sum())),
        float((count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())),
        len(text.encode("utf-8", "replace")) / n - 1,
    ]


SIZE = len(statistics(""))


def document_statistics(df: DataFrame) -> DataFrame:
    """doc_id, stats array<float> of every row of ``doc_id, text``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float32)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), SIZE).cast(pa.list_(pa.float32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "stats"])

    rows = df.select("doc_id", "text")
    return rows.mapInArrow(per_batch(run), T.StructType([rows.schema["doc_id"], T.StructField("stats", T.ArrayType(T.FloatType()))]))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        """Cosine features and a constant."""
        rng = np.random.default_rng(11)
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        w = rng.normal(size=(stats.shape[1], FOURIER)) / (WIDTH * np.sqrt(stats.shape[1]))
        out = np.empty((len(stats), FOURIER + 1))
        np.cos(z @ w + rng.uniform(0, 2 * np.pi, FOURIER), out=out[:, :-1])
        out[:, :-1] *= np.sqrt(2 / FOURIER)
        out[:, -1] = 1
        return out

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lifted(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, SIZE)


def _summed(df: DataFrame, part, size: int) -> np.ndarray:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_stats(batch), batch.column("quality").to_numpy(zero_copy_only=False).astype(float))
        yield vector_rows(total)

    return sum_vectors(df.mapInArrow(run, "part array<double>"), size)


def pooled(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (score, rows, label sum) in score order: centres and rising levels."""
    blocks: list[list[float]] = []
    for x, n, y in bins:
        blocks.append([x * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(labelled: DataFrame) -> Model:
    """Fit on rows of ``stats, quality``; the driver receives sums of fixed size."""
    sums = _summed(labelled, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * SIZE)
    n = sums[0]
    if n == 0:
        return Model(np.zeros(SIZE), np.ones(SIZE))
    mean = sums[1 : 1 + SIZE] / n
    model = Model(mean, np.sqrt(np.maximum(sums[1 + SIZE :] / n - mean**2, 1e-8)))
    d = FOURIER + 1
    upper = np.triu_indices(d)

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        phi = model.lifted(x)
        return np.concatenate([(phi.T @ phi)[upper], phi.T @ y])

    sums = _summed(labelled, normal, len(upper[0]) + d)
    gram = np.zeros((d, d))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + gram.T - np.diag(np.diag(gram))
    model.weights = np.linalg.solve(gram / n + RIDGE * np.eye(d) / d, sums[len(upper[0]) :] / n)

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = np.clip(np.floor((model.raw(_stats(batch)) + 1) / 3 * BINS), 0, BINS - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(at), batch.column("quality").cast(pa.float64())], ["bin", "y"])

    # At most BINS rows reach the driver.
    counts = labelled.mapInArrow(per_batch(binned), "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    model.knots, model.levels = pooled(sorted(((r["bin"] + 0.5) / BINS * 3 - 1, r["n"], r["y"]) for r in counts))
    return model


def training_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats, quality of labelled documents outside the held-out third."""
    marks = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    return stats.where(held_out_remainder() != 1).join(marks, F.col("doc_id") == F.col("label_id")).select("stats", "quality")


def score_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``doc_id, text``, learnt from ``labels`` outside the held-out third."""
    stats = stored(document_statistics(df), "statistics")
    model = fit(stored(training_rows(stats, labels), "training"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_stats(batch)))], ["doc_id", "score"])

    scored = stats.mapInArrow(per_batch(run), T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    held_out = F.coalesce(held_out_remainder() == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``df`` whose text scores at least ``least``."""
    # The fit takes one pass; the decision is made on the text in the second, so no row is joined to its score.
    stats = stored(document_statistics(df), "statistics")
    model = fit(stored(training_rows(stats, labels), "training"))
    schema = df.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float32).astype(float)
        return batch.filter(pa.array(model.score(stats) >= least))

    return df.mapInArrow(per_batch(run), schema)
