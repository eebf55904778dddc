"""Text quality by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Each passage becomes a vector: means of surface features of
its words, how many of its words are new in the passage and in the text, and a hashed bag of words. A
learned layer encodes it; gated attention weights the encoded passages of a text; a logistic layer scores
the weighted sum. All three are trained together on the labels of texts.

Learned from at most about SAMPLE_DOCS labelled rows, chosen by hash of the id (a documented bound); every
text is scored whole. Workers remember the features of words they have seen, in a bounded table.

Null and empty texts are a bag of one empty passage and get a score as well. Labels that are null or have
no document are not learned from; of several labels of a document the highest counts. With nothing
to learn from, or one class only, every score is the share of label 1 (0.5 if there are no labels). Repeated
rows get equal scores; columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_texts, small_batches

SAMPLE_DOCS = 4000
PASSAGE = 100
SURFACE, HASHED = 16, 256
WIDTH = SURFACE + 5 + HASHED
HIDDEN, GATE = 32, 16
EPOCHS, BAGS, RATE, DECAY = 40, 64, 0.01, 1e-4
MEMORY = 700_000
ENDS = frozenset(".,;:!?")


def word_features(word: str) -> tuple:
    """Surface features of one word; the last is its place in the hashed bag."""
    n = len(word)
    upper = sum(map(str.isupper, word))
    letters = sum(map(str.isalpha, word))
    digits = sum(map(str.isdigit, word))
    marks = n - letters - digits
    tail = word[-1]
    body = word.strip(".,;:!?\"'()").lower()
    return (
        np.log1p(n), upper / n, letters / n, digits / n, marks / n, float(upper > 1 and upper == letters), float(tail in ENDS),
        float(not tail.isalnum() and tail not in ENDS), float(marks > 1), float(letters == 0), float("|" in word), float("@" in word or "://" in word),
        float(upper == 1 and word[0].isupper()), float(not word.isascii()), float(n == 1), float(n > 20), _bucket(body or word),
    )


def _bucket(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode()) % HASHED


class Passages:
    """Turns texts into passage vectors; remembers words."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.table = np.zeros((1 << 16, SURFACE + 1), np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The vectors of all passages, and how many each text has (one at least)."""
        cut = [t.split() for t in texts]
        if len(self.words) > MEMORY:
            self.words = {}
        new = list(set().union(*cut).difference(self.words))
        base = len(self.words)
        self.words.update(zip(new, range(base, base + len(new)), strict=True))
        while base + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if new:
            self.table[base : base + len(new)] = [word_features(w) for w in new]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        total = int(sizes.sum())
        at = np.fromiter(map(self.words.__getitem__, itertools.chain.from_iterable(cut)), np.int64, total)
        counts = np.maximum(1, -(-sizes // PASSAGE))
        first = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(cut)), sizes)
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = first[text] + within // PASSAGE
        out = np.zeros((int(counts.sum()), WIDTH), np.float32)
        if total:
            n = np.bincount(passage, minlength=len(out)).astype(np.float32)
            full = np.flatnonzero(n)
            starts = np.searchsorted(passage, full)
            each = np.maximum(n, 1)
            out[full, :SURFACE] = np.add.reduceat(self.table[at, :SURFACE], starts, 0) / n[full, None]
            out[:, SURFACE] = np.log1p(n)
            _, one = np.unique(passage << 32 | at, return_index=True)
            out[:, SURFACE + 1] = np.bincount(passage[one], minlength=len(out)) / each
            _, one = np.unique(text << 32 | at, return_index=True)
            out[:, SURFACE + 2] = np.bincount(passage[one], minlength=len(out)) / each
            bag = np.bincount(passage * HASHED + self.table[at, SURFACE].astype(np.int64), minlength=len(out) * HASHED).reshape(len(out), HASHED)
            out[:, SURFACE + 5 :] = np.sqrt(bag) / np.sqrt(each)[:, None]
            out[:, SURFACE + 3] = bag.max(1) / each
        out[:, SURFACE + 4] = np.repeat(sizes == 0, counts)
        return out, counts


@dataclass
class Model:
    """Centre and scale of the vectors, and the learned layers."""

    centre: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        w = self.layers
        starts = np.cumsum(counts) - counts
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["value"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        logit = (t * g) @ w["attend"]
        e = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, 0)
        s = z @ w["out"] + w["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30))), z, a, h, t, g

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        return self.forward((x - self.centre) / self.scale, counts)[0]


def train(vectors: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the logistic loss of whole bags."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, float(labels.mean()) if len(labels) else 0.5)
    dice = np.random.default_rng(seed)
    everything = np.concatenate(vectors)
    centre, scale = everything.mean(0), everything.std(0) + 0.05
    bags = [((v - centre) / scale).astype(np.float32) for v in vectors]
    shape = {"encode": (WIDTH, HIDDEN), "encode_bias": (HIDDEN,), "value": (HIDDEN, GATE), "gate": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,), "out_bias": (1,)}
    w = {k: (dice.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) if not k.endswith("bias") else np.zeros(s, np.float32) for k, s in shape.items()}
    model = Model(centre, scale, w)
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    step, steps = 0, EPOCHS * -(-len(bags) // BAGS)
    for _ in range(EPOCHS):
        order = dice.permutation(len(bags))
        for start in range(0, len(order), BAGS):
            some = order[start : start + BAGS]
            x, counts = np.concatenate([bags[k] for k in some]), np.array([len(bags[k]) for k in some])
            p, z, a, h, t, g = model.forward(x, counts)
            ds = ((p - labels[some]) / len(some)).astype(np.float32)
            dz = np.repeat(ds[:, None] * w["out"], counts, 0)
            da = (dz * h).sum(1)
            mean = np.repeat(np.add.reduceat(a * da, np.cumsum(counts) - counts), counts)
            dl = a * (da - mean)
            dtg = dl[:, None] * w["attend"]
            dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ w["value"].T + dg @ w["gate"].T) * (1 - h * h)
            slope = {"encode": x.T @ dh, "encode_bias": dh.sum(0), "value": h.T @ dt, "gate": h.T @ dg, "attend": (t * g).T @ dl, "out": z.T @ ds, "out_bias": ds.sum(keepdims=True)}
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for k, v in slope.items():
                v = v + DECAY * w[k] if not k.endswith("bias") else v
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.999 * two[k] + 0.001 * v * v
                w[k] -= (rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


_passages: list[Passages] = []


def _shared() -> Passages:
    if not _passages:
        _passages.append(Passages())
    return _passages[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled rows of docs: labels has the id and 0 or 1."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, sample_docs / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))  # about sample_docs rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text")

    def run(batches):
        for batch in small_batches(batches, 1):
            x, counts = _shared()(python_texts(batch.column(1)))
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(np.float16).tobytes() for v in np.split(x, ends[:-1])], pa.binary())], ["y", "x"])

    found = sorted(((r["y"], bytes(r["x"])) for r in rows.mapInArrow(run, "y double, x binary").toLocalIterator()), key=lambda r: r[1])
    return train([np.frombuffer(x, np.float16).reshape(-1, WIDTH).astype(np.float32) for _, x in found], np.array([y for y, _ in found]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The id, score and predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in small_batches(batches, 1):
            s = np.clip(m.score(*_shared()(python_texts(batch.column(1)))).astype(np.float64), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
