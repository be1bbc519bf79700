"""Quality from compression: one zstandard dictionary per class, and a calibrated score of the size difference.

A text is compressed with a dictionary trained on good texts and with one trained on bad texts; whichever knows its
strings better gives the smaller size. The difference over the text's length, with the rate itself and the length
it holds for, goes through a logistic fit on labelled texts that no dictionary has seen.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.frames import arrow_map

#: Labelled rows of each class that are fitted on, at most; the rows with the smallest hash are taken.
SAMPLE = 2000
#: Labelled texts with more characters are not fitted on (they are scored in full like any other).
SAMPLE_CHARS = 65_536
#: Bytes of all texts that are fitted on, at most; of more, those with the smallest hash are taken.
SAMPLE_BYTES = 64 << 20
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class CompressionModel:
    """Two dictionaries and the weights of the fit; about 250 KB at any size of input."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scorer(self):
        """A function from a text's bytes to its score; build it once per task."""
        measure = _measure(self.good, self.bad)

        def score(text: bytes) -> float:
            x = (np.array(measure(text)) - self.centre) / self.scale
            return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -50, 50))))

        return score


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves as raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:]


def _measure(good: bytes, bad: bytes):
    def compressor(content: bytes):
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL)
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=held)

    with_good, with_bad = compressor(good), compressor(bad)

    def measure(text: bytes) -> tuple[float, ...]:
        g, b, n = len(with_good.compress(text)), len(with_bad.compress(text)), max(len(text), 1)
        return (b - g) / max(b, g), (b - g) / n, min(g / n, 2.0), min(b / n, 2.0), float(np.log1p(n))

    return measure


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic fit by Newton steps, rows weighted so that class 1 has its ``share`` of all labels."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - centre) / scale]
    ones = max(y.mean(), 1e-9)
    weight = np.where(y == 1, share / ones, (1 - share) / max(1 - ones, 1e-9))
    w = np.zeros(a.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learnt from: crc32 of the id as text is a multiple of 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel:
    """Fit on at most ``sample`` labelled rows of each class that are not held out.

    Half of them (by hash) build the dictionaries, the other half the calibration. The shares of the classes come
    from all labels. Several labels of one id count as its smallest; null labels count as none. With one class
    missing, the score is that of the other for every text; with no label at all it is one half.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .withColumn("turn", F.xxhash64("doc_id", F.lit(17)))
    )
    share = known.agg(F.avg("quality")).first()[0]
    if share is None or share in (0.0, 1.0):
        sure = 0.0 if share is None else (6.0 if share == 1.0 else -6.0)
        return CompressionModel(b"", b"", np.array([sure, 0, 0, 0, 0, 0]), np.zeros(5), np.ones(5))
    # ids only, at most ``sample`` of each class; then their texts by one small join
    picked = known.where("quality = 1").orderBy("turn", "doc_id").limit(sample).unionByName(
        known.where("quality = 0").orderBy("turn", "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    sample_rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality", "turn").agg(F.min("text").alias("text"))
    sizes = sample_rows.select("turn", "doc_id", F.octet_length("text").alias("size")).collect()  # numbers only
    sizes.sort(key=lambda r: (r.turn, r.doc_id))
    total = np.cumsum([r["size"] for r in sizes]) if sizes else np.zeros(0)
    if len(total) and total[-1] > SAMPLE_BYTES:
        last = sizes[max(int(np.searchsorted(total, SAMPLE_BYTES, "right")) - 1, 0)]
        sample_rows = sample_rows.where((F.col("turn") < last.turn) | ((F.col("turn") == last.turn) & (F.col("doc_id") <= last.doc_id)))
    rows = sorted(sample_rows.collect(), key=lambda r: (r.turn, r.doc_id))
    parts: dict[tuple[int, int], list[bytes]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for r in rows:
        side = parts[r.quality, 0], parts[r.quality, 1]
        side[len(side[0]) > len(side[1])].append(r.text.encode())
    good, bad = _dictionary(parts[1, 0]), _dictionary(parts[0, 0])
    measure = _measure(good, bad)
    x = np.array([measure(t) for q in (1, 0) for t in parts[q, 1]], dtype=float).reshape(-1, 5)
    y = np.array([q for q in (1, 0) for _ in parts[q, 1]], dtype=float)
    if len(set(y)) < 2:
        return CompressionModel(good, bad, np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]), np.zeros(5), np.ones(5))
    return CompressionModel(good, bad, *_logistic(x, y, float(share)))


def score(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; every row is kept and whole texts are compressed.

    A null text is scored as the empty one. Columns of ``docs`` named ``score`` or ``predicted`` are replaced. One
    pass, no shuffle; the model is sent with the tasks.
    """
    frame = docs.drop("score", "predicted")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        measure = held.value.scorer()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            scores = [measure((t or "").encode()) for t in texts]
            found = [int(s >= threshold) for s in scores]
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(found, pa.int32())], [*batch.schema.names, "score", "predicted"]
            )

        return run

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return arrow_map(frame, make, f"{kept}, score double, predicted int")


def is_held_out(doc_id: int) -> bool:
    """The rule of ``held_out`` in plain Python."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
