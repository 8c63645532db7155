"""A quality classifier made of two compression dictionaries.

One zstandard dictionary is built from texts labelled good, one from texts labelled
bad. A text that is like the good ones gets smaller with the good dictionary; the
difference of the two compressed sizes, divided by their mean, is calibrated to a
probability by logistic regression on labelled texts that built neither dictionary. The
regression also sees how far the text shrinks at all: where little is left (a few words
over and over) the difference says little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, sample_by_hash

#: Labelled texts of each class that a fit uses at most, and pieces of them that build a dictionary.
SAMPLE, SAMPLE_PIECES = 3000, 6000
#: A text is compressed in pieces of so many bytes: its own repeats then count little.
PIECE = 2048
DICTIONARY_BYTES = 96 * 1024


def pieces_of(data: bytes) -> list[bytes]:
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def train_dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from ``pieces``; their own bytes if they are too few to train one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size] or b"\n" * 8


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=3)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


class Sizes:
    """Maps a text to the normalised difference of its two compressed sizes, and the log of their mean per byte."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good).compress, _compressor(bad).compress

    def __call__(self, text: str | None) -> tuple[float, float]:
        data = (text or "").encode("utf-8", "replace")
        if not data:
            return (0.0, 0.0)
        pieces = pieces_of(data)
        good, bad = sum(len(self.good(p)) for p in pieces), sum(len(self.bad(p)) for p in pieces)
        return (2.0 * (bad - good) / (bad + good), float(np.log((bad + good) / (2 * len(data)))))


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    def probability(self, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sizes @ np.array(self.weights[:2]) + self.weights[2], -40, 40)))

    def sizes(self, text: Column) -> Column:
        """A struct of ``difference`` and ``rate``, what ``Sizes`` measures."""
        model = self

        @F.arrow_udf("struct<difference:double,rate:double>")
        def run(texts: pa.Array) -> pa.Array:
            measure = _measure(model)
            found = np.array([measure(t.as_py()) for t in texts], dtype=float).reshape(-1, 2)
            return pa.StructArray.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["difference", "rate"])

        return run(text)

    def score(self, text: Column) -> Column:
        """0 to 1, higher for better texts."""
        model = self

        @F.arrow_udf("double")
        def run(texts: pa.Array) -> pa.Array:
            measure = _measure(model)
            return pa.array(model.probability(np.array([measure(t.as_py()) for t in texts], dtype=float).reshape(-1, 2)))

        return run(text)


_MEASURES: dict[tuple[int, int], Sizes] = {}


def _measure(model: QualityModel) -> Sizes:
    key = (hash(model.good), hash(model.bad))
    if key not in _MEASURES:
        _MEASURES.clear()
        _MEASURES[key] = Sizes(model.good, model.bad)
    return _MEASURES[key]


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A weight for each column and an intercept, by Newton's method with a small ridge."""
    rows = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        gradient = rows.T @ (p - y) + 1e-3 * w
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(label, h, piece)``: all pieces of whole texts, each with a hash of the piece and its text's id."""
    for batch in batches:
        for i in range(0, batch.num_rows, 50):
            part = batch.slice(i, 50)
            out = [(label, xxhash.xxh64_intdigest(p, seed=h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), p) for label, h, text in zip(*[part.column(k).to_pylist() for k in range(3)]) for p in pieces_of(text.encode("utf-8", "replace"))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["label", "h", "piece"])


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, pieces: int = SAMPLE_PIECES) -> QualityModel:
    """Fit on the documents whose label is 0 or 1.

    ``labels`` has the id and the label of those to learn from. At most ``sample`` ids of each
    class are used, those with the smallest hash; this bound is fixed whatever the size of the
    table. They are chosen by id alone, so only their texts are shuffled. An id that is labelled
    more than once counts once, with its smallest label; of several texts under one id the
    smallest counts; null ids and null labels are left out.

    Two thirds of the ids build the dictionaries: their whole texts are cut into pieces, and
    the ``pieces`` of each class with the smallest hash come to the driver. The rest calibrates:
    their whole texts are measured on the executors, and two numbers each come back. The
    calibration weighs classes by their true counts. With no documents of a class, every score
    is the share of good ones (0.5 without any label).
    """
    unique = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    chosen, counts = sample_by_hash(unique, "id", "label", [0, 1], sample, 9)
    counts = {label: counts.get(label, 0) for label in (0, 1)}
    rows = docs.select(F.col(id_col).alias("__i"), F.coalesce(text_col, F.lit("")).alias("__t")).join(F.broadcast(chosen), F.col("__i") == F.col("__id"))
    rows = materialize(rows.groupBy(F.col("__class").alias("label"), F.xxhash64(F.lit(9), "__id").alias("h"), "__id").agg(F.min("__t").alias("text")), "labelled")
    rows = rows.select("label", "h", "text", (F.pmod(F.xxhash64(F.lit(10), "__id"), F.lit(3)) == 0).alias("rest"))
    found = {(r["label"], r["rest"]): r["count"] for r in rows.groupBy("label", "rest").count().collect()}
    if not all(found.get((label, False)) and found.get((label, True)) for label in (0, 1)):
        rows = rows.drop("rest").crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(True,), (False,)], "rest boolean")))  # too few to be divided
        found = {(r["label"], r["rest"]): r["count"] for r in rows.groupBy("label", "rest").count().collect()}
    if not all(found.get((label, True)) for label in (0, 1)):
        share = counts[1] / sum(counts.values()) if sum(counts.values()) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(b"\n" * 8, b"\n" * 8, (0.0, 0.0, float(np.log(share / (1 - share)))))
    cut = rows.filter("not rest").select("label", "h", "text").mapInArrow(_pieces, "label int, h bigint, piece binary")
    good, bad = (train_dictionary([bytes(r["piece"]) for r in cut.filter(F.col("label") == label).orderBy("h", "piece").limit(pieces).collect()]) for label in (1, 0))
    sizes = QualityModel(good, bad, (0.0, 0.0, 0.0)).sizes(F.col("text"))
    measured = sorted(tuple(r) for r in rows.filter("rest").select("label", sizes.alias("s")).select("label", "s.difference", "s.rate").collect())
    x, y = np.array([r[1:] for r in measured]), np.array([r[0] for r in measured], dtype=float)
    *weights, intercept = map(float, logistic(x, y))
    intercept += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return QualityModel(good, bad, (*weights, intercept))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row ``(id, score, predicted)`` for each row of ``docs``; no shuffle.

    A null or empty text has no size difference and gets the score at zero; a text of any
    length is read whole, piece by piece; null ids and repeated rows each get a row; other
    columns are not read. An empty table gives an empty one.
    """
    return docs.select(id_col, model.score(F.col(text_col)).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
