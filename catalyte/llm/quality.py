"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a sparse random index vector that only its hash decides. A word's own vector
is its index vector plus the sum of those of its neighbours in all documents, so words
of like contexts get like vectors. A document is the mean of its words' vectors and the mean
of the index vectors of its words' marks (letter case, attached signs, repetition of the
word before). A network with one hidden layer, trained in numpy, turns that into a score, and
a temperature found on rows kept out of the training makes the score a probability.

Only the network's fit is bounded: ``sample`` labelled rows at most, the first by hash of
their id. Word vectors come from every whole text, as partial sums that tasks add up, and
scoring reads every whole text where it lies; there is no shuffle of texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, kept, materialize, table, text_or_empty
from .tokens import pieces_of

WORDS, MARKS = 1 << 15, 1 << 9
WORD_DIM, MARK_DIM = 64, 32
MEMO = 100_000  # words a Python worker remembers
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RUN = re.compile(r"(.)\1+")
SAME = 0  # the mark of a word that repeats the one before
SHRINK = 12  # the mean of a few words says little: it is drawn to zero as if by so many more


def index_vectors(rows: int, dim: int, nonzero: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors, the same on every machine."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, dim), np.float32)
    at = rng.integers(0, dim, (rows, nonzero))
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (rows, nonzero)), 1)
    return out


def index_places(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the index vectors are not zero, and their signs there (zero where a vector has fewer)."""
    at = np.argsort(index == 0, axis=1, kind="stable")[:, : int((index != 0).sum(1).max())]
    return at, np.take_along_axis(index, at, 1).astype(np.int64)


@lru_cache(maxsize=1)
def fixed_vectors() -> tuple[np.ndarray, np.ndarray]:
    return index_vectors(WORDS, WORD_DIM, 4, 7), index_vectors(MARKS, MARK_DIM, 4, 11)


class _Units(dict):
    """Word as written -> word bucket * MARKS + mark bucket; bounded memo."""

    def __missing__(self, word: str) -> int:
        core = word.strip(SIGNS)
        case = "-" if not core else "D" if core[0].isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l"
        tail = RUN.sub(r"\1+", word[len(word.rstrip(SIGNS)) :])
        unit = crc32(core.lower().encode()) % WORDS * MARKS + 1 + crc32(f"{case}{tail}".encode()) % (MARKS - 1)
        if len(self) < MEMO:
            self[word] = unit
        return unit


def units(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets and mark buckets of a text."""
    words = text.split()
    both = np.fromiter(map(kept("units", _Units).__getitem__, words), np.int64, len(words))
    return both // MARKS, both % MARKS


def pooled(text: str, vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    word, mark = units(text)
    if not len(word):
        return np.zeros(WORD_DIM + MARK_DIM, np.float32)
    same = float((word[1:] == word[:-1]).sum()) / len(word)
    kinds = np.bincount(mark, minlength=MARKS).astype(np.float32) / len(word)
    kinds[SAME] = same
    total = np.zeros(WORD_DIM, np.float64)
    for at in range(0, len(word), 1 << 16):  # a very long text needs no more memory than a part of it
        total += vectors[word[at : at + (1 << 16)]].sum(0, dtype=np.float64)
    return np.concatenate([total / (len(word) + SHRINK), kinds @ marks]).astype(np.float32)


# --- the network -----------------------------------------------------------------------


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 5) -> Network:
    """Fit on four fifths of the rows, calibrate on the rest. With one class only, or hardly
    any rows, the score is a constant: the smoothed share of good labels."""
    dim = WORD_DIM + MARK_DIM
    net = Network(vectors, np.zeros(dim), np.ones(dim), np.zeros((dim, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0, 1.0)
    if len(y) < 10 or y.min() == y.max():
        net.constant = float((y.sum() + 1) / (len(y) + 1))
        return net
    rng = np.random.default_rng(seed)
    turn = rng.permutation(len(y))
    x, y = x[turn].astype(np.float64), y[turn].astype(np.float64)
    held = max(2, len(y) // 5)
    cal_x, cal_y, x, y = x[:held], y[:held], x[held:], y[held:]
    net.mean, net.spread = x.mean(0), x.std(0) + 1e-3
    net.w1, net.w2 = rng.normal(0, dim**-0.5, (dim, hidden)), rng.normal(0, hidden**-0.5, hidden)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) / net.spread
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            rows = order[at : at + 128]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -40, 40)))
            d = (p - y[rows]) / len(rows)
            back = d[:, None] * params[2] * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    raw = net.logits(cal_x)

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, raw / t) - cal_y * raw / t))

    net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


# --- fitting and scoring on Spark ------------------------------------------------------


#: The table of sums travels in so many rows.
CHUNKS = 32


def neighbour_sums(docs: DataFrame) -> np.ndarray:
    """For each word bucket the sum of its neighbours' index vectors in all texts, as integers.

    Whatever the input, a task hands on ``CHUNKS`` rows with a table of WORDS * WORD_DIM numbers,
    mostly zeros and compressed; they are added as they stream in, first in lanes, then all.
    """
    each = WORDS * WORD_DIM // CHUNKS

    def sums(batches):
        total = np.zeros(WORDS * WORD_DIM, np.int64)
        at, sign = index_places(fixed_vectors()[0])
        for batch in pieces_of(batches):
            found = [units(text)[0] for text in batch.column(0).to_pylist()]
            left = np.concatenate([np.zeros(0, np.int64), *(w[:-1] for w in found)])
            right = np.concatenate([np.zeros(0, np.int64), *(w[1:] for w in found)])
            for word, other in ((left, right), (right, left)):
                for s in range(0, len(word), 1 << 20):
                    w, o = word[s : s + (1 << 20)], other[s : s + (1 << 20)]
                    for k in range(at.shape[1]):
                        np.add(total, np.bincount(w * WORD_DIM + at[o, k], sign[o, k], len(total)), out=total, casting="unsafe")  # whole numbers
        yield from packed(dict(enumerate(total.reshape(CHUNKS, each))))

    def packed(some):
        lane = TaskContext.get().partitionId() % 64
        for chunk, part in some.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([lane], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "lane", "sums"])

    def add(batches):
        some: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                some[chunk] = some.get(chunk, 0) + np.frombuffer(zlib.decompress(raw), np.int64)
        yield from packed(some)

    schema = "chunk int, lane int, sums binary"
    parts = docs.select(text_or_empty().alias("text")).mapInArrow(sums, schema)
    parts = parts.repartition("chunk", "lane").mapInArrow(add, schema).repartition("chunk").mapInArrow(add, schema)
    out = np.zeros((CHUNKS, each), np.int64)
    for row in parts.collect():  # CHUNKS rows
        out[row["chunk"]] += np.frombuffer(zlib.decompress(row["sums"]), np.int64)
    return out.ravel()


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", key: str = "doc_id", learn=None, sample: int = 20_000) -> Network:
    """Fit on up to ``sample`` labelled rows for which ``learn`` (a condition on ``key``) holds.

    Several labels of one document count as its mean, rounded up; null labels and null keys do
    not count. Null texts are empty; texts of any length are read whole; rows with equal keys
    learn their label each; no documents give a constant score, as do labels of one class.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    chosen = chosen.filter(learn) if learn is not None else chosen
    chosen = chosen.groupBy(key).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("__y"))
    # at most ``sample`` rows of two numbers: small whatever the input
    chosen = materialize(chosen.orderBy(F.xxhash64(key), key).limit(sample).withColumnRenamed(key, "__key"), "labels")
    texts = docs.select(key, text_or_empty().alias("text")).join(F.broadcast(chosen), F.col(key) == F.col("__key"))
    texts = materialize(texts.select("text", "__y").repartition(16), "training")

    near = neighbour_sums(docs).reshape(WORDS, WORD_DIM)
    index, marks = fixed_vectors()
    vectors = (index / 2 + near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1)).astype(np.float32)

    def features(batches):
        for batch in pieces_of(batches):
            made = [pooled(t, vectors, marks).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["x", "y"])

    rows = texts.select("text", "__y").mapInArrow(features, "x binary, y int").collect()  # ``sample`` rows at most
    rows.sort(key=lambda r: (r["x"], r["y"]))  # the order of tasks must not matter
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, WORD_DIM + MARK_DIM)
    return train(vectors, x, np.array([r["y"] for r in rows], np.int64))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``score``: the probability of good quality of every whole text; no rows give no rows.

    Null and empty texts are scored as a document without words. A column ``score`` is replaced.
    """
    docs = docs.drop("score")
    model = docs.sparkSession.sparkContext.broadcast(network)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = names.index("text")

    def run(batches):
        net, (_, marks) = model.value, fixed_vectors()
        for batch in pieces_of(batches):
            x = np.array([pooled(t or "", net.vectors, marks) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(net.score(x) if len(x) else [], pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """True for the quarter of the rows that is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, sample: int = 20_000) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if the score is at least ``threshold``)."""
    network = fit(docs, labels, learn=~held_out(), sample=sample)
    found = score(docs.drop("held_out", "predicted"), network)
    return found.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, from the labels outside the held-out quarter."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op7_quality": op7_quality}
ORACLE_SQL: dict[str, str] = {}
