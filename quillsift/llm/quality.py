"""Quality classifier: naive Bayes support vectors.

Features are the distinct byte n-grams of the whole text, hashed into 2**BITS indicators. Each is scaled by its
log-count ratio between the classes, and a linear hinge loss is fitted on the scaled indicators by
dual coordinate descent; the weights are drawn towards their mean magnitude as naive Bayes support vectors are.
The score is a logistic curve of the margin, fitted on the same rows.

Fitting takes `sample_rows` labelled rows at most (those with the least hash of the id): each is sent to the
driver as a packed bitmap, of 2**BITS / 8 bytes before packing whatever its length, so 4000 rows are 64 MB at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, tidy

BITS = 17
SAMPLE_ROWS = 4000
_BLOCK = 1 << 20


@dataclass(frozen=True)
class Model:
    """weights of the indicators (log-count ratio times fitted weight), the bias and the curve's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, marks: list[np.ndarray]) -> np.ndarray:
        margins = np.array([self.weights[m].sum(dtype=np.float64) / max(1.0, np.sqrt(len(m))) + self.bias for m in marks])
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def indicators(text: str | None, flags: np.ndarray) -> np.ndarray:
    """Sorted ids of the distinct n-grams (3 and 5 bytes) of the text; `flags` is scratch of 2**BITS bools, all False."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    for at in range(0, len(raw), _BLOCK):  # long texts in blocks that overlap by n - 1 bytes
        part = raw[at : at + _BLOCK + 4].astype(np.uint64)
        if len(part) < 3:
            continue
        three = part[:-2] | part[1:-1] << np.uint64(8) | part[2:] << np.uint64(16)
        for gram in (three, three[:-2] | three[2:] << np.uint64(16) | np.uint64(1 << 41)) if len(part) > 4 else (three,):
            flags[((gram + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


def descend(rows: list[np.ndarray], values: np.ndarray, signs: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge loss by dual coordinate descent; row k has values[rows[k]] / sqrt(len)."""
    rng, w, b = np.random.default_rng(seed), np.zeros(len(values)), 0.0
    length = [max(1.0, float(np.sqrt(len(r)))) for r in rows]
    square = [float(values[r] @ values[r]) / n**2 + 1.0 for r, n in zip(rows, length)]
    dual = np.zeros(len(rows))
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            own = values[rows[k]] / length[k]
            slack = signs[k] * (w[rows[k]] @ own + b) - 1.0
            new = min(max(dual[k] - slack / square[k], 0.0), cost)
            if new != dual[k]:
                step = (new - dual[k]) * signs[k]
                w[rows[k]] += step * own
                b += step
                dual[k] = new
    return w, b


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, mix: float = 0.5) -> Model:
    """The model of indicator rows and 0/1 labels; with one class only, or no rows, the same score for every text."""
    size, positive = 1 << BITS, labels == 1
    if not positive.any() or positive.all():
        return Model(np.zeros(size), 0.0, 0.0, 4.0 if len(labels) and positive.all() else -4.0 if len(labels) else 0.0)
    counts = {True: np.full(size, smooth), False: np.full(size, smooth)}
    for r, p in zip(rows, positive):
        counts[bool(p)][r] += 1
    ratio = np.log(counts[True] / counts[True].sum()) - np.log(counts[False] / counts[False].sum())
    signs = np.where(positive, 1.0, -1.0)
    w, b = descend(rows, ratio, signs)
    mean = np.abs(w).sum() / max(1, np.count_nonzero(counts[True] + counts[False] > 2 * smooth))  # over the n-grams that are in some row
    w = ((1 - mix) * mean + mix * w) * ratio
    margins = np.array([w[r].sum() / max(1.0, np.sqrt(len(r))) + b for r in rows])
    slope, offset = _curve(margins, positive)
    return Model(w, b, slope, offset)


def _curve(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on softened targets."""
    scale = max(1e-9, float(margins.std()))
    x, (n1, n0) = margins / scale, (positive.sum(), (~positive).sum())
    goal = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = p - goal, p * (1 - p) + 1e-9
        ga, gb, haa, hab, hbb = (g * x).sum() + 1e-4 * a, g.sum(), (h * x * x).sum() + 1e-4, (h * x).sum(), h.sum()
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return a / scale, b


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on `sample_rows` labelled rows at most, none of them held out. Rows without id or label are left out; of an id's labels the least counts, and of its texts the one of the least bitmap."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            found = []
            for text in batch.column(2):
                ids = indicators(text.as_py(), flags)
                flags[ids] = True
                found.append(zlib.compress(np.packbits(flags).tobytes(), 1))
                flags[ids] = False
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "label", "marks"])

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # sample_rows ids bound what is broadcast
    met = rows.join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("doc_id", "label", "text")
    # one row an id, chosen on the executors, so that sample_rows bounds what comes to the driver
    one = met.mapInArrow(tidy(marks), "doc_id long, label int, marks binary").groupBy("doc_id", "label").agg(F.min("marks").alias("marks"))
    got = sorted(one.collect(), key=lambda r: r["doc_id"])
    unpacked = [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(r["marks"]), np.uint8))) for r in got]
    return fit_rows(unpacked, np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5). Only the text is read; null counts as empty. Columns of these two names are replaced."""
    docs = docs.drop("score", "predicted")
    ship(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.slope, model.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flags = Model(*shared.value), np.zeros(1 << BITS, bool)
        for batch in batches:
            got = own.scores([indicators(t.as_py(), flags) for t in batch.column(batch.schema.get_field_index("text"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", `score` double"
    return docs.mapInArrow(tidy(run), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`.

    Texts of under three bytes, empty and null ones get the score of no indicator. Repeated rows stay
    repeated; null ids are never learnt from; other columns (clashing names too) are ignored; without labels every score is 0.5.
    """
    model = fit(docs, labels, sample_rows=sample_rows)
    return score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
