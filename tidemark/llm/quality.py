"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

Every bucket of the hashed vocabulary has a fixed sparse index vector. A word's vector is the sum of the index vectors
of the words around it, over all occurrences in all documents; a document's is the mean of its words' unit vectors. A
network of two layers, trained with numpy on a bounded sample of labelled documents, scores it; a temperature fitted on
documents kept apart from the training calibrates the probability. Only the text is an input. Besides words, the lexer
emits marks for symbol runs, shouted words, numbers, repeated words and repeated lines, which get vectors as words do.

Scale: the vocabulary has ``BUCKETS`` buckets, so word vectors are a table of fixed size, whatever the corpus. Each task
sums its own table and emits it in slices; slices are summed in two rounds by tasks that hold one slice at a time. What
the driver sees is the finished table (``BUCKETS`` x ``DIMENSIONS`` floats) and at most ``SAMPLE`` pooled vectors.
Texts are scored where they are read.

Nulls and ties: null counts as empty; an empty text has the zero vector and is scored like any other. Labels without a
doc_id or quality, and those of doc_ids without a document, are not used; repeated labels count as often as they occur.
If the labels hold one class only, every score is that class; without labels every score is 1 and nothing is rejected.
A null doc_id isn't held out.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, batch, texts_of
from tidemark.sources.staging import stage

BUCKETS = 1 << 14
DIMENSIONS = 48
NONZERO = 4
WINDOW = 2
SLICE = 256
SEED = 20_240_101
#: Labelled documents the network is fitted on, by smallest hash of the doc_id.
SAMPLE = 20_000
ACCEPTED = 0.7
TOKENS_AT_ONCE = 1 << 17

#: Marks take the first buckets, words the others.
MARKS = ("<edge>", "<symbols>", "<shout>", "<number>", "<again>", "<line>")
EDGE, SYMBOLS, SHOUT, NUMBER, AGAIN, LINE = range(len(MARKS))
RESERVED = 16
_TOKENS = re.compile(r"[^\W_]+|[^\w\s.,;:'\"()-]+|_+")


def tokens(text: str) -> list[int]:
    """Buckets of the text's words and marks, in order."""
    out: list[int] = []
    lines: set[str] = set()
    crc, last = zlib.crc32, ""
    for line in text.split("\n"):
        if line in lines and line.strip():
            out.append(LINE)
        lines.add(line)
        for token in _TOKENS.findall(line):
            if token == last:
                out.append(AGAIN)
                continue
            last = token
            if token[0].isalnum():
                if token.isalpha():
                    if len(token) > 1 and token.isupper():
                        out.append(SHOUT)
                    else:
                        out.append(crc(token.lower().encode()) % (BUCKETS - RESERVED) + RESERVED)
                else:
                    out.append(NUMBER)
            else:
                out.append(SYMBOLS)
    return out


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector; the mark between documents has none."""
    rng = np.random.default_rng(SEED)
    places = rng.permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    signs = rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))
    signs[EDGE] = 0
    return places, signs


def _token_rows(texts: Iterator[str]) -> Iterator[np.ndarray]:
    """Buckets of many texts with marks between them, some hundred thousand at a time; a longer text stays whole."""
    held: list[int] = []
    for text in texts:
        held += tokens(text)
        held += [EDGE] * WINDOW
        if len(held) > TOKENS_AT_ONCE:
            yield np.array(held, np.int64)
            held = []
    if held:
        yield np.array(held, np.int64)


def _context_batches():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        table = np.zeros(BUCKETS * DIMENSIONS, np.float64)
        for row in _token_rows(text for rows in batches for text in texts_of(rows.column(0))):
            for shift in range(1, WINDOW + 1):
                for words, others in ((row[shift:], row[:-shift]), (row[:-shift], row[shift:])):
                    for at in range(0, len(words), TOKENS_AT_ONCE):
                        word, near = words[at : at + TOKENS_AT_ONCE], others[at : at + TOKENS_AT_ONCE]
                        flat = (word[:, None] * DIMENSIONS + places[near]).ravel()
                        table += np.bincount(flat, signs[near].ravel(), len(table))
        sums = table.reshape(-1, SLICE * DIMENSIONS)
        names, types = ("slice", "part", "sums"), (pa.int32(), pa.int32(), pa.binary())
        part = np.full(len(sums), TaskContext.get().partitionId(), np.int32)
        yield batch(names, types, (np.arange(len(sums), dtype=np.int32), part, [s.tobytes() for s in sums]))

    return run


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by slice and part; only one sum is held at a time."""
    key, total = None, None

    def out() -> pa.RecordBatch:
        return batch(("slice", "part", "sums"), (pa.int32(), pa.int32(), pa.binary()), [[x] for x in (*key, total.tobytes())])

    for rows in batches:
        for slice_, part, sums in zip(*(rows.column(n).to_pylist() for n in ("slice", "part", "sums"))):
            if key != (slice_, part):
                if key:
                    yield out()
                key, total = (slice_, part), np.zeros(SLICE * DIMENSIONS)
            total += np.frombuffer(sums)
    if key:
        yield out()


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all buckets, from all texts of ``docs``."""
    schema = "slice int, part int, sums binary"
    sums = arrow_map(docs.select(docs["text"]), _context_batches(), schema)
    for part in (F.pmod("part", F.lit(32)).cast("int"), F.lit(0)):
        sums = sums.withColumn("part", part).repartition("slice", "part").sortWithinPartitions("slice", "part")
        sums = arrow_map(sums, _sum_batches, schema)
    table = np.zeros((BUCKETS // SLICE, SLICE * DIMENSIONS))
    for row in sums.collect():  # BUCKETS / SLICE rows
        table[row["slice"]] = np.frombuffer(row["sums"])
    vectors = table.reshape(BUCKETS, DIMENSIONS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(vectors: np.ndarray, text: str) -> np.ndarray:
    """The mean of the words' vectors, and of the marks' share, which a mean of unit vectors blurs."""
    buckets = np.array(tokens(text), np.int64)
    out = np.zeros(DIMENSIONS + RESERVED + 1, np.float32)
    if len(buckets):
        for at in range(0, len(buckets), TOKENS_AT_ONCE):
            out[:DIMENSIONS] += vectors[buckets[at : at + TOKENS_AT_ONCE]].sum(axis=0)
        out[:DIMENSIONS] /= len(buckets)
        marks = buckets[buckets < RESERVED]
        out[DIMENSIONS : DIMENSIONS + RESERVED] = np.bincount(marks, minlength=RESERVED) / len(buckets)
        out[-1] = math.log1p(len(buckets)) / 10
    return out


@dataclass(frozen=True)
class Network:
    """Two layers on standardised inputs; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        return np.tanh((inputs - self.mean) / self.scale @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(inputs), self.constant)
        return _sigmoid(self.logits(inputs) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def train(inputs: np.ndarray, labels: np.ndarray, units: int = 24, epochs: int = 80, decay: float = 1e-4) -> Network:
    """Adam on mini-batches; every fifth row is kept for the temperature."""
    width = inputs.shape[1] if inputs.ndim == 2 else 1
    blank = np.zeros(width)
    if not len(labels) or labels.min() == labels.max():
        constant = float(labels[0]) if len(labels) else 1.0
        return Network(blank, blank + 1, np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0, constant=constant)
    rng = np.random.default_rng(SEED)
    kept = np.arange(len(labels)) % 5 == 4
    if not (0 < labels[~kept].mean() < 1):
        kept[:] = False
    mean, scale = inputs[~kept].mean(axis=0), inputs[~kept].std(axis=0) + 1e-3
    x, y = (inputs[~kept] - mean) / scale, labels[~kept]
    weights = [rng.normal(0, width**-0.5, (width, units)), np.zeros(units), rng.normal(0, units**-0.5, units), np.array(0.0)]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 256):
            xs, ys = x[order[at : at + 256]], y[order[at : at + 256]]
            layer = np.tanh(xs @ weights[0] + weights[1])
            error = (_sigmoid(layer @ weights[2] + weights[3]) - ys) / len(ys)
            back = error[:, None] * weights[2] * (1 - layer**2)
            slopes = [xs.T @ back + decay * weights[0], back.sum(axis=0), layer.T @ error + decay * weights[2], error.sum()]
            step += 1
            for w, g, m, v in zip(range(4), slopes, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                weights[w] = weights[w] - 0.005 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    network = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3]))
    if not kept.any():
        return network
    logits, target = network.logits(inputs[kept]), labels[kept]
    steps = np.exp(np.linspace(math.log(0.5), math.log(20), 60))  # softer or a little sharper
    return Network(**vars(network) | {"temperature": float(min(steps, key=lambda t: _loss(logits / t, target)))})


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


_MODELS: dict[str, tuple[np.ndarray, Network | None]] = {}


def _model(key: str, shared) -> tuple[np.ndarray, Network | None]:
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = shared.value
    return _MODELS[key]


def _pooled_batches(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, _ = _model(key, shared)
        for rows in batches:
            inputs = [pooled(vectors, text) for text in texts_of(rows.column(0))]
            yield batch(("quality", "pooled"), (pa.int32(), pa.binary()), (rows.column(1), [x.tobytes() for x in inputs]))

    return run


def _scores(key: str, shared, texts: list[str]) -> np.ndarray:
    vectors, network = _model(key, shared)
    return network.scores(np.array([pooled(vectors, text) for text in texts], np.float32).reshape(len(texts), -1))


def _score_batches(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            scores = _scores(key, shared, texts_of(rows.column(1)))
            yield batch(("doc_id", "score"), (pa.int64(), pa.float64()), (rows.column(0), scores))

    return run


def _accepted_batches(key: str, shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array(_scores(key, shared, texts_of(rows.column("text"))) >= least))

    return run


class QualityModel:
    """Fitted on all texts of ``docs`` and a bounded sample of ``labels`` (doc_id, quality)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
        spark = docs.sparkSession
        vectors = word_vectors(docs)
        known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality"))
        known = known.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        drawn = stage(known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "quality").limit(sample), "quality-sample")
        texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
        drawn_texts = texts.join(F.broadcast(drawn), "doc_id").select("text", "quality")  # at most ``sample`` rows of two numbers
        shared = spark.sparkContext.broadcast((vectors, None))
        inputs = arrow_map(drawn_texts, _pooled_batches(uuid.uuid4().hex, shared), "quality int, pooled binary")
        # ordered, so that any order of tasks trains alike; bounded even where doc_ids repeat
        rows = inputs.orderBy(F.xxhash64("pooled"), "pooled", "quality").limit(sample).collect()
        inputs = np.array([np.frombuffer(row["pooled"], np.float32) for row in rows])
        self.network = train(inputs, np.array([float(row["quality"] > 0) for row in rows]))
        self._shared = spark.sparkContext.broadcast((vectors, self.network))
        self._key = uuid.uuid4().hex

    def scores(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) for each row."""
        wanted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
        return arrow_map(wanted, _score_batches(self._key, self._shared), "doc_id long, score double")

    def accepted(self, docs: DataFrame, least: float = ACCEPTED) -> DataFrame:
        """The rows of ``docs`` that score ``least`` or more, with all their columns."""
        return arrow_map(docs, _accepted_batches(self._key, self._shared, least), docs.schema)
