"""Language identification by nearest centroid.

A text is a vector of hashed letter trigrams (lower case, UTF-8 bytes, everything but letters as a space),
weighted by TF-IDF and normalised.  Document frequencies and row counts come from all training texts, summed by
partition.  Each language gets several centroids by spherical k-means over a bounded sample of its training texts
(at most about ``SAMPLE`` of each, chosen by a hash of the id), seeded by draws that favour far texts; a cluster of few
texts gives no centroid.  A text takes the language of the centroid of largest cosine.

The fewer trigrams a text has, the further it is from any centroid.  So for each language and each length of ``LENGTHS``
as many trigrams are drawn from every text of its sample, and the cosine that 99 % of them exceed, times ``SLACK``, bounds the
texts of this length and less than the next one.  A text below the bound of its language and length is too far from everything known and is
rejected.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; rows with a null lang
teach nothing; without training rows all texts are ``und``; ties go to the language first in the alphabet; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluvia.llm.common import held_out_remainder, per_batch, sum_vectors

DIMENSIONS, CENTROIDS, SAMPLE, ROUNDS = 4096, 4, 600, 8
#: A cluster of a smaller share of its language's sample gives no centroid.
LEAST_SHARE = 0.05
#: Numbers of trigrams for which there are bounds of their own, and the part of the 1 % quantile that bounds.
LENGTHS = (1, 4, 8, 16, 32, 64, 128, 256, 512)
SLACK = 0.5

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the whole text."""
    raw = text.lower().encode("utf-8", "replace") if not text.isascii() else text.encode()
    b = _LETTER[np.frombuffer(b" " + raw + b" ", np.uint8)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(20)
    counts = np.bincount(code, minlength=DIMENSIONS).astype(np.float32)
    counts[_BLANK] = 0
    return counts


_BLANK = int((np.uint32(32 << 16 | 32 << 8 | 32) * np.array([2654435761], np.uint32) >> np.uint32(20))[0])


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    #: Least cosine by centroid and length.
    bounds: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _normal(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of whole texts."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        own = [i for i, t in enumerate(texts) if has_letter(t)]
        if not self.langs:
            return out
        for at in range(0, len(own), 256):
            part = own[at : at + 256]
            counts = np.array([trigram_counts(texts[i]) for i in part])
            cosine = self.vectors(counts) @ self.centroids.T
            best = cosine.argmax(1)
            far = cosine.max(1) < self.bounds[best, np.maximum(np.searchsorted(LENGTHS, counts.sum(1), side="right") - 1, 0)]
            for i, k, c, f in zip(part, best.tolist(), cosine.max(1).tolist(), far.tolist(), strict=True):
                out[i] = self.langs[k], float(min(1.0, max(0.0, c))), f
        return out


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of spherical k-means from seeds drawn in proportion to their distance, without those of few rows."""
    k = min(k, len(x))
    rng = np.random.default_rng(17)
    seeds = [int((x @ _normal(x.mean(0))).argmax())]
    far = 1 - x @ x[seeds[0]]
    while len(seeds) < k and (weight := np.maximum(far, 0) ** 2).sum() > 1e-9:
        seeds.append(int(rng.choice(len(x), p=weight / weight.sum())))
        far = np.minimum(far, 1 - x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        held = np.bincount(own, minlength=len(centres))
        centres = _normal(np.array([x[own == j].mean(0) for j in np.flatnonzero(held >= min(held.max(), LEAST_SHARE * len(x)))]))
    return centres


def _least_cosines(model: Model, counts: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each of ``LENGTHS`` the cosine that 99 % of the texts exceed when so many trigrams are drawn from each."""
    rng = np.random.default_rng(19)
    share = counts / counts.sum(1, keepdims=True)
    out = [np.quantile((model.vectors(np.array([rng.multinomial(n, p) for p in share], np.float32)) @ centres.T).max(1), 0.01) for n in LENGTHS]
    # A text as long as the greatest length or longer is no nearer than its whole is.
    out[-1] = min(out[-1], np.quantile((model.vectors(counts.astype(np.float32)) @ centres.T).max(1), 0.01))
    return np.array(out)


def fit(df: DataFrame) -> Model:
    """Fit on rows of ``doc_id, text, lang`` outside the held-out third."""
    train = df.where((held_out_remainder() != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    # One row a language.
    totals = {r["lang"]: r["n"] for r in df.where((held_out_remainder() != 1) & F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang")).count().withColumnRenamed("count", "n").collect()}
    share = {lang: min(1.0, SAMPLE / n) for lang, n in totals.items()}
    if not totals:
        return Model(np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, len(LENGTHS))))

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if has_letter(text):
                    total += trigram_counts(text) > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"part": pa.array([[n, *total.tolist()]], pa.list_(pa.float64()))})

    sums = sum_vectors(train.select("text").mapInArrow(frequencies, "part array<double>"), DIMENSIONS + 1)
    idf = (np.log((1 + sums[0]) / (1 + sums[1:])) + 1).astype(np.float32)
    rate = F.create_map(*[x for lang, p in share.items() for x in (F.lit(lang), F.lit(p))])[F.col("lang")]
    chosen = train.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "text")

    def sampled(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(lang, trigram_counts(t).astype("<u4").tobytes()) for lang, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if has_letter(t)]
        lang, counts = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(counts, pa.binary())], ["lang", "counts"])

    model = Model(idf, np.zeros((0, DIMENSIONS), np.float32), [], np.zeros((0, len(LENGTHS))))
    centres, langs, bounds = [], [], []
    rows = chosen.mapInArrow(per_batch(sampled), "lang string, counts binary").collect()  # about SAMPLE a language
    for lang in sorted(totals):
        own = [np.frombuffer(r["counts"], "<u4") for r in rows if r["lang"] == lang and any(r["counts"])]
        if not own:
            continue
        counts = np.array(own, float)
        c = clustered(model.vectors(counts.astype(np.float32)), CENTROIDS)
        centres += list(c)
        langs += [lang] * len(c)
        bounds += [SLACK * _least_cosines(model, counts, c)] * len(c)
    return Model(idf, np.array(centres, np.float32).reshape(-1, DIMENSIONS), langs, np.array(bounds).reshape(-1, len(LENGTHS)))


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``doc_id, text, lang``."""
    model = fit(df)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = zip(*model.predict(batch.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = df.select("doc_id", "text")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    found = rows.mapInArrow(per_batch(run), T.StructType([rows.schema["doc_id"], *fields]))
    return found.select("doc_id", F.coalesce(held_out_remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(df: DataFrame) -> DataFrame:
    """Rows of ``df`` whose text is near a known language."""
    model = fit(df)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([not r for *_, r in model.predict(batch.column("text").to_pylist())]))

    return df.mapInArrow(per_batch(run), df.schema)
