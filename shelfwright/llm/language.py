"""Language identification by string kernels: n-gram presence, Nyström landmarks, kernel ridge regression, one class against the rest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwright.llm.shared import table
from shelfwright.llm.textarrays import lower, mix, slices

#: Lengths of the blended spectrum, in bytes of the lower-cased text.
LENGTHS = (1, 2, 3, 4)
#: n-grams are told apart by so many bits of a hash.
HASH_BITS = 15
#: Labelled rows of each language that the model is fitted on, at most, and how many of them are landmarks.
PER_LANGUAGE, LANDMARKS = 600, 48
#: Rows and landmarks of all languages together: with many languages each has fewer, but at least one row.
MOST_ROWS, MOST_LANDMARKS = 128 * PER_LANGUAGE, 128 * LANDMARKS
RIDGE = 1e-3
FOLD = 2  # crc32(doc_id) mod 4 of the rows that are never learned from
ROWS = 128  # rows of a matrix product


def presence(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x 2^HASH_BITS: which n-grams a whole text holds; n-grams never cross rows."""
    out = np.zeros((len(off) - 1, 1 << HASH_BITS), np.float32)
    view, row = out.reshape(-1), np.repeat(np.arange(len(off) - 1, dtype=np.int64) << HASH_BITS, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(flat))  # bytes from here to the end of the row
    x = lower(flat).astype(np.uint64)
    h = np.zeros(len(flat), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if n > len(flat):
            break
        h = h[:len(flat) - n + 1] * np.uint64(257) + x[n - 1:] + np.uint64(1)
        if n in LENGTHS:
            ok = left[:len(h)] >= n
            key = (mix(h[ok]) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
            view[row[:len(h)][ok] + key] = 1
    return out


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


class Kernel:
    """Kernel ridge regression on Nyström features: the share of n-grams that a text has in common with each landmark text,
    |x and l| / sqrt(|x| |l|). Presence is kept as bits; only landmarks and a batch of rows are unpacked at a time."""

    def __init__(self, bits: np.ndarray, y: np.ndarray, names: list[str], landmarks: np.ndarray, ridge: float = RIDGE):
        self.names, self.landmarks, self.weights = names, bits[landmarks], None
        k = np.concatenate([self.shares(unpacked(bits[i:i + ROWS])) for i in range(0, len(bits), ROWS)]).astype(np.float64)
        order = np.argsort(y, kind="stable")
        per_name = np.add.reduceat(k[order], np.searchsorted(y[order], np.arange(len(names)))).T
        among = k[landmarks]
        self.weights = np.linalg.lstsq(k.T @ k + ridge * len(bits) * among + 1e-9 * np.eye(len(among)), per_name, rcond=None)[0]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "matrix"}

    def shares(self, x: np.ndarray) -> np.ndarray:
        if "matrix" not in self.__dict__:
            m = unpacked(self.landmarks)
            self.matrix = m.T / np.sqrt(np.maximum(1, m.sum(axis=1)))
        return (x @ self.matrix) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x) @ self.weights


def fit(docs: DataFrame, fold: int = FOLD, per_language: int = PER_LANGUAGE) -> Kernel | None:
    """Fit on text and lang of rows that are not held out: of every language the ``per_language`` ones with the smallest
    hashes, a bounded sample; fewer where all languages together would have more than MOST_ROWS. No language is left out. Rows without a letter or lang are left out; without any there is no model."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(-1)) != fold))
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id"), F.xxhash64("text")]
    slim = known.select("doc_id", "lang", F.xxhash64("text").alias("text_key"), order[0].alias("h"))
    n_languages = max(1, slim.select("lang").distinct().count())
    per_language = min(per_language, max(1, MOST_ROWS // n_languages))
    part = Window.partitionBy("lang", F.pmod("h", F.lit(64))).orderBy("h", "doc_id", "text_key")
    slim = slim.withColumn("k", F.row_number().over(part)).where(F.col("k") <= per_language)
    slim = slim.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text_key"))).where(F.col("k") <= per_language)

    def job(batches):
        for batch in batches:
            for rows, flat, off in slices(batch, "text", 1 << 18):
                for i in range(0, len(rows), ROWS):
                    o = off[i:i + ROWS + 1]
                    bits = np.packbits(presence(flat[o[0]:o[-1]], o - o[0]).astype(bool), axis=1)
                    yield pa.RecordBatch.from_arrays([*[rows.column(c).slice(i, len(o) - 1) for c in (0, 1, 2)], pa.array([b.tobytes() for b in bits])], names=["lang", "k", "doc_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = known.withColumn("text_key", F.xxhash64("text")).join(F.broadcast(slim.select("doc_id", "lang", "text_key", "k")), ["doc_id", "lang", "text_key"])
    rows = picked.select("lang", "k", "doc_id", "text").mapInArrow(job, f"lang string, k int, doc_id {kind}, bits binary").toPandas()
    if not len(rows):
        return None
    rows = rows.drop_duplicates(["lang", "k"]).sort_values(["lang", "k"], ignore_index=True)
    x = np.stack([np.frombuffer(b, np.uint8) for b in rows["bits"]])
    names = sorted(rows["lang"].unique())
    y = rows["lang"].map({n: i for i, n in enumerate(names)}).to_numpy()
    marks = np.flatnonzero(rows.groupby("lang").cumcount().to_numpy() < min(LANDMARKS, max(1, MOST_LANDMARKS // len(names))))
    if len(marks) > MOST_LANDMARKS:
        marks = marks[np.linspace(0, len(marks) - 1, MOST_LANDMARKS).astype(np.int64)]
    return Kernel(x, y, names, marks)


def identify(docs: DataFrame, model: Kernel | None, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as all are without a model. Ties go to the first name. score is the winner's
    part of the positive outputs. A very long text is worked on alone.
    """
    def job(batches):
        for batch in batches:
            for rows, flat, off in slices(batch, "text", 1 << 20):
                pred, score = np.full(len(rows), "und", object), np.zeros(len(rows))
                letter = rows.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for i in range(0, len(rows), ROWS) if model else ():
                    o = off[i:i + ROWS + 1]
                    s = np.maximum(model.scores(presence(flat[o[0]:o[-1]], o - o[0])), 1e-6)
                    best = s.argmax(axis=1)
                    pred[i:i + len(s)] = np.array(model.names, object)[best]
                    score[i:i + len(s)] = s.max(axis=1) / s.sum(axis=1)
                pred[~letter], score[~letter] = "und", 0.0
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"), "text")
    return d.mapInArrow(job, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op6(spark, sf_dir: str) -> DataFrame:
    """The language of all documents; a fourth of them is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == FOLD, F.lit(False))
    return identify(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
