"""Quality classifier: a factorisation machine over hashed words, text statistics and size.

A document is a sparse vector: its words hashed into WORDS slots (weighted by the logarithm of
their counts, scaled to unit length) and binned statistics of its structure, one slot for each
bin. The score is the logistic of w0 + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j; the
pair sum is taken in linear time as half of sum over factors of (sum v x)^2 - sum (v x)^2.

Training reads labelled rows only, at most ``most_rows`` of them, chosen by a hash of doc_id
(bound: a documented parameter). Their vectors are computed on the executors and the model is
fitted on the driver by minibatch Adagrad from a fixed seed; the model has a fixed size and
goes to the workers in the function that scores.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

WORDS, FACTORS, MOST_ROWS, EPOCHS, RATE, DECAY = 1 << 14, 8, 12_000, 6, 0.05, 1e-5
#: Bins of each statistic; statistics are shares (0 to 1) or logarithms of sizes (here 0 to 16).
BINS, SHARES, SIZES = 12, 9, 4
_DIGIT = re.compile("[0-9]")
WIDTH = WORDS + (SHARES + SIZES) * BINS
_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    found = _slots.get(word)
    if found is None:
        if len(_slots) > 500_000:
            _slots.clear()
        found = _slots[word] = zlib.crc32(word.encode()) % WORDS
    return found


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """SHARES shares, then SIZES logarithms, of a text's structure."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    upper = sum(map(str.isupper, words)) / m
    symbols = sum(text.count(c) for c in "#*$%&|<>!") / n
    spaces = text.count(" ") / n
    top = max(counts.values(), default=0) / m
    distinct = len(counts) / m
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    runs = sum(a == b for a, b in zip(words, words[1:])) / m
    digits = len(_DIGIT.findall(text)) / n
    ended = sum(w[-1] in ".!?" for w in words) / m
    sizes = [np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(sum(map(len, words)) / m) * 3]
    return [upper, min(1.0, symbols * 5), spaces, top, distinct, repeated, runs, min(1.0, digits * 5), ended, *sizes]


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots (rising) and values of a text; the empty text has its statistics only."""
    words = text.split()
    counts = Counter(words)
    slot = np.fromiter(map(_slot, counts), np.int64, len(counts))
    size = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    used, at = np.unique(slot, return_inverse=True)
    value = np.bincount(at, size, len(used))
    if len(used):
        value /= np.sqrt((value**2).sum())
    x = np.array(statistics(text, words, counts))
    x[SHARES:] /= 16
    bins = np.clip((x * BINS).astype(int), 0, BINS - 1) + BINS * np.arange(len(x))
    return np.concatenate([used, WORDS + bins]), np.concatenate([value, np.full(len(bins), 0.4)])


@dataclass
class Machine:
    """w0, linear weights and factors of the WIDTH slots."""

    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, slots: np.ndarray, values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """For vectors laid end to end (begins: where each starts; none is empty)."""
        vx = self.v[slots] * values[:, None]
        pairs = np.add.reduceat(vx, begins, axis=0) ** 2 - np.add.reduceat(vx * vx, begins, axis=0)
        return self.w0 + np.add.reduceat(self.w[slots] * values, begins) + 0.5 * pairs.sum(axis=1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Minibatch Adagrad on the logistic loss. Without both classes the machine gives the share of label 1."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH), rng.normal(0, 0.02, (WIDTH, FACTORS)))
    if len(set(labels.tolist())) < 2:
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            slots, values = (np.concatenate([rows[i][c] for i in some]) for c in (0, 1))
            sizes = np.array([len(rows[i][0]) for i in some])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = m.v[slots] * values[:, None]
            sums = np.add.reduceat(vx, begins, axis=0)
            z = m.w0 + np.add.reduceat(m.w[slots] * values, begins) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, begins, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            each = np.repeat(error, sizes)
            used, at = np.unique(slots, return_inverse=True)
            dw = np.bincount(at, each * values, len(used)) + DECAY * m.w[used]
            part = (each * values)[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            dv = np.stack([np.bincount(at, part[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * m.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += error.sum() ** 2
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.w0 -= RATE * error.sum() / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    """Fits on ``labels(doc_id, quality)`` joined to ``docs(doc_id, text)``: most_rows rows at most, the least by a hash of doc_id, repeated ids and labels included. Null labels are left out; doc_id is used to join and choose only."""
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "quality", "text")  # at most most_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            made = [vector(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.astype(np.int32).tobytes() for s, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())], ["_id", "quality", "slots", "values"])

    made = rows.mapInArrow(run, "_id long, quality int, slots binary, values binary")
    got = made.orderBy(F.xxhash64("_id", F.lit(11)), "_id", "slots", "quality").limit(most_rows).toArrow().sort_by([("_id", "ascending"), ("slots", "ascending")])
    vectors = [(np.frombuffer(s, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for s, v in zip(got["slots"].to_pylist(), got["values"].to_pylist())]
    return fit(vectors, np.array(got["quality"].to_pylist(), np.float64))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` for each row of ``docs(doc_id, text, ...)``; a null text is an empty one, which has a score too. Repeated rows are kept; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            made = [vector(t or "") for t in batch.column(1).to_pylist()]
            slots, values = (np.concatenate([x[c] for x in made]) for c in (0, 1))
            begins = np.concatenate([[0], np.cumsum([len(s) for s, _ in made])[:-1]]).astype(np.int64)
            z = machine.margin(slots, values, begins)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``: trained on labels whose crc32(doc_id as text) mod 5 is not 0."""
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5 == 0
    machine = train(docs, labels.where(~held("doc_id")))
    return score(docs, machine).select("doc_id", F.coalesce(held("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
