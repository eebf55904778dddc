"""Language identification by interpolated Kneser-Ney character models.

One model for each language over the letters of words, each word with a boundary on both sides. For
each order the n-grams of all languages are one sorted array of 64-bit hashes with a column of
discounted probabilities for each language, and the contexts are another with the back-off weights,
so a look-up is one binary search for all languages. A text gets the language of the lowest
cross-entropy per character; it is *rejected* where even that is far above what texts of the language
have (calibrated on training rows that the model was not fitted to), or where it has no letter.

The model is fitted to a sample of about ``sample_docs`` labelled rows of each language, chosen by
hash of the id (a documented bound); every text is scored whole. A word's score does not depend on
its neighbours, so each worker remembers the scores of words it has seen, in a bounded table.

Null text, empty text and text without letters are ``und`` with score 0. Rows without a language,
and held-out rows, are never learned from. With nothing to learn from, everything is ``und``. Repeated rows
get equal results; columns other than id, text and language are not read.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, keep, python_texts, small_batches

ORDER = 5
SAMPLE_DOCS = 1500
REJECT_SD = 6.0
LEAST_VARIANCE = 0.09  # of cross-entropy between texts: a passage in another language is no cause for rejection
MEMORY = 300_000  # words remembered by each worker: about 60 MB
BATCH = 2 << 20  # bytes of text looked at together
STEP = np.uint64(0x9E3779B97F4A7C15)
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
HAS_LETTER = regex.compile(r"\p{L}").search


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of all predicted places in the words and their end boundaries: the word, how many symbols precede
    it in its word, and the hash of the n symbols that end there, for each n from 0 to ORDER."""
    line = np.frombuffer((" " + "".join([w + " " for w in words])).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    which = np.repeat(np.arange(len(words)), lengths)
    before = np.arange(1, len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    hashes = [np.zeros(len(line), np.uint64)]
    for _ in range(ORDER):
        shifted = np.r_[np.uint64(0), hashes[-1][:-1]]
        hashes.append(shifted * STEP + line + np.uint64(1))
    return which, before, hashes


@dataclass
class Model:
    """The languages, the sorted hash arrays with their columns, and the calibration."""

    languages: list[str]
    floor: float
    grams: list[np.ndarray] = field(default_factory=list)
    alphas: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    gammas: list[np.ndarray] = field(default_factory=list)
    sharpness: float = 1.0
    usual: np.ndarray | None = None  # for each language: mean, variance between texts, variance by character
    words: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, counts: dict[str, dict[str, int]]) -> Model:
        """counts: for each language, how often each word occurs."""
        languages = sorted(counts)
        alphabet = len(set().union(*(set(w) for words in counts.values() for w in words), " ")) + 1
        model = cls(languages, 1.0 / alphabet)
        tables = [_kneser_ney(list(counts[x]), np.fromiter(counts[x].values(), np.float64, len(counts[x]))) for x in languages]
        for n in range(ORDER):
            for keys, columns, k, default in ((model.grams, model.alphas, 0, 0.0), (model.contexts, model.gammas, 2, 1.0)):
                merged = np.unique(np.concatenate([t[n][k] for t in tables]))
                matrix = np.full((len(merged), len(languages)), default, np.float32)
                for column, t in enumerate(tables):
                    matrix[np.searchsorted(merged, t[n][k]), column] = t[n][k + 1]
                keys.append(merged)
                columns.append(matrix)
        return model

    def score_words(self, words: list[str]) -> np.ndarray:
        """For each word of letters: the log-probability under each language, then its symbols (with the end)."""
        out = np.zeros((len(words), len(self.languages) + 1))
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            which, before, hashes = _grams(part)
            p = np.full((len(which), len(self.languages)), self.floor)
            for n in range(1, ORDER + 1):
                at = np.flatnonzero(before >= n - 1)
                context, known = _find(self.contexts[n - 1], hashes[n - 1][:-1][at])
                at, context = at[known], context[known]
                gram, seen = _find(self.grams[n - 1], hashes[n][1:][at])
                q = p[at] * self.gammas[n - 1][context]
                q[seen] += self.alphas[n - 1][gram[seen]]
                p[at] = q
            ends = np.cumsum(np.bincount(which, minlength=len(part)))
            out[start : start + len(part), :-1] = np.add.reduceat(np.log(p), np.r_[0, ends[:-1]], 0)
            out[start : start + len(part), -1] = np.diff(np.r_[0, ends])
        return out

    def score_tokens(self, tokens: list[str]) -> np.ndarray:
        """The same for tokens, which may hold several words or none."""
        cut = [LETTERS(t) for t in tokens]
        flat = list(itertools.chain.from_iterable(cut))
        out = np.zeros((len(tokens), len(self.languages) + 1))
        if flat:
            np.add.at(out, np.repeat(np.arange(len(cut)), [len(c) for c in cut]), self.score_words(flat))
        return out

    def score_texts(self, texts: list[str]) -> np.ndarray:
        """For each whole text: the log-probability under each language, then its symbols."""
        cut = [t.lower().split() for t in texts]
        new = list(set().union(*cut).difference(self.words))
        fresh = self.score_tokens(new)
        base = len(self.words)
        local = dict(zip(new, range(base, base + len(new)), strict=True))
        if base + len(new) <= MEMORY:
            self.words.update(local)
            self._append(fresh, base)
            table, find = self._matrix(base + len(new)), self.words.__getitem__
        else:
            table, find = np.concatenate([self._matrix(base), fresh.astype(np.float32)]), lambda x: local[x] if x in local else self.words[x]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(find, itertools.chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        out = np.zeros((len(texts), len(self.languages) + 1))
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] = np.add.reduceat(table[at], (np.cumsum(sizes) - sizes)[full], 0, np.float64)
        return out

    def _matrix(self, n: int) -> np.ndarray:
        return self.rows[0][:n] if self.rows else np.zeros((0, len(self.languages) + 1), np.float32)

    def _append(self, fresh: np.ndarray, base: int) -> None:
        if not self.rows or base + len(fresh) > len(self.rows[0]):
            grown = np.zeros((min(max(1 << 16, 2 * (base + len(fresh))), MEMORY), fresh.shape[1]), np.float32)
            grown[:base] = self._matrix(base)
            self.rows = [grown]
        self.rows[0][base : base + len(fresh)] = fresh

    def calibrate(self, own: np.ndarray, sums: np.ndarray) -> None:
        """own: the place of each text's language; sums: its score_texts. Sets the sharpness of the
        score and what cross-entropy is usual."""
        n = len(self.languages)
        some = sums[:, -1] > 0
        own, sums = own[some], sums[some]
        size = sums[:, -1]
        entropy = -sums[:, :-1] / size[:, None]
        self.usual = np.zeros((n, 3))
        for k in range(n):
            mine, length = entropy[own == k, k], size[own == k]
            if not len(mine):
                mine, length = entropy.min(1), size
            if not len(mine):
                self.usual[k] = (np.log(1 / self.floor), 1.0, 9.0)
                continue
            long = mine[length >= np.median(length)]
            self.usual[k] = (long.mean(), max(long.var(), LEAST_VARIANCE), max(9.0, float(((mine - long.mean()) ** 2 * length).mean())))
        best = (np.inf, 1.0)
        for sharp in 2.0 ** np.arange(-8, 1.5, 0.5):
            total = sharp * sums[:, :-1]
            total = total - total.max(1, keepdims=True)
            loss = float((np.log(np.exp(total).sum(1)) - total[np.arange(len(own)), own]).mean()) if len(own) else 0.0
            best = min(best, (loss + 1e-4 * abs(np.log(sharp)), float(sharp)))
        self.sharpness = best[1]

    def decide(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of the language, the score and whether it is rejected; only of texts with symbols."""
        size = np.maximum(sums[:, -1], 1)
        entropy = -sums[:, :-1] / size[:, None]
        pick = entropy.argmin(1)
        total = self.sharpness * sums[:, :-1]
        total = np.exp(total - total.max(1, keepdims=True))
        score = total.max(1) / total.sum(1)
        mean, between, by_symbol = self.usual[pick].T
        limit = mean + REJECT_SD * np.sqrt(between + by_symbol / size)
        return pick, score, (sums[:, -1] == 0) | (entropy.min(1) > limit)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _kneser_ney(words: list[str], weight: np.ndarray) -> list[tuple]:
    """For each order: gram hashes, discounted probabilities, context hashes, back-off weights."""
    which, before, hashes = _grams(words)
    out = []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(before >= n - 1)
        h = hashes[n][1:][at]
        gram, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if n == ORDER:
            count = np.bincount(inverse, weight[which[at]], len(gram))
        else:  # kinds of left neighbours; occurrences where a boundary begins the gram
            starts = before[at] == n - 1
            count = np.bincount(inverse[starts], weight[which[at[starts]]], len(gram))
            inner = at[~starts]
            _, one = np.unique(hashes[n + 1][1:][inner], return_index=True)
            count += np.bincount(np.searchsorted(gram, hashes[n][1:][inner[one]]), minlength=len(gram))
        context = hashes[n - 1][:-1][at[first]]
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        ctx, place = np.unique(context, return_inverse=True)
        total = np.bincount(place, count, len(ctx))
        kinds = np.bincount(place, minlength=len(ctx))
        out.append((gram, np.maximum(count - discount, 0) / total[place], ctx, np.minimum(discount * kinds / total, 1.0)))
    return out


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """A calibrated model from the rows where ``learn`` holds; None if no such row has a language and text.

    About sample_docs rows of each language are learned from: the choice is by hash of id and text, and
    every fourth of the chosen rows serves the calibration only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), learn.alias("learn")).where("learn AND lang IS NOT NULL")
    shares = [(r.lang, min(1.0, sample_docs / r.n)) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not shares:
        return None
    part = F.broadcast(spark.createDataFrame(shares, "lang string, share double"))
    # by id and text: rows without an id, or with the same one, are chosen one by one
    spread = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    chosen = rows.join(part, "lang").where(spread < F.col("share")).select("lang", F.coalesce("text", F.lit("")).alias("text"), (F.pmod(F.xxhash64("id", "text", F.lit(1)), F.lit(4)) == 0).alias("calibrate"))
    chosen = keep(chosen, "language-sample")
    words = chosen.where("NOT calibrate").select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}[\\p{L}\\p{M}]*)', 1)")).alias("word"))
    counts: dict[str, dict[str, int]] = {}
    for r in words.groupBy("lang", "word").count().toLocalIterator():
        counts.setdefault(r["lang"], {})[r["word"]] = r["count"]
    if not counts:
        return None
    model = Model.fit(counts)
    places = {x: k for k, x in enumerate(model.languages)}
    scored = _score(chosen.where("calibrate"), model, "lang", "text", sums=True).collect()
    scored = [r for r in scored if r["id"] in places]
    model.calibrate(np.array([places[r["id"]] for r in scored], np.int64), np.array([r["sums"] for r in scored], np.float64).reshape(len(scored), len(places) + 1))
    return model


def _score(docs: DataFrame, model: Model, id_col: str, text_col: str, sums: bool = False) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        give_back()
        m = held.value
        for batch in small_batches(batches, 1, BATCH):
            texts = python_texts(batch.column(1))
            total = m.score_texts(texts)
            if sums:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.tolist(), pa.list_(pa.float64()))], ["id", "sums"])
                continue
            pick, score, rejected = m.decide(total)
            none = total[:, -1] == 0
            for k in np.flatnonzero(none):
                none[k] = not HAS_LETTER(texts[k])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(["und" if x else m.languages[k] for k, x in zip(pick, none, strict=True)], pa.string()),
                    pa.array(np.where(none, 0.0, score)),
                    pa.array(none | rejected),
                    pa.array(np.where(none, np.nan, -total[np.arange(len(pick)), pick] / np.maximum(total[:, -1], 1))),
                ],
                ["id", "lang_pred", "score", "rejected", "cross_entropy"],
            )
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, sums array<double>" if sums else f"id {kind}, lang_pred string, score double, rejected boolean, cross_entropy double"
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred, score, rejected and cross_entropy of every row."""
    if model is None:
        none = [F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(float("nan")).alias("cross_entropy")]
        return docs.select(id_col, *none)
    return _score(docs, model, id_col, text_col).withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        give_back()
        m = held.value
        for batch in small_batches(batches, place, BATCH):
            _, _, rejected = m.decide(m.score_texts(python_texts(batch.column(place))))
            yield batch.filter(pa.array(~rejected))
        give_back()

    return docs.mapInArrow(run, docs.schema)
