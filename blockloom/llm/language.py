"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, set_aside, texts

#: Hashed n-grams are counted in so many features; texts are looked at in slices of so many characters.
FEATURES, SLICE = 1 << 16, 1 << 20
#: Rows of the labelled sample on which the classifier is fitted, over all languages together; of each at least so many.
SAMPLE, EACH = 6000, 20
#: Follow-the-regularised-leader: step, its offset, both penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 2e-3, 1e-3, 3
#: Below this no language is sure enough for a document to be kept by `keep_known`.
LEAST = 0.35
UNKNOWN = "und"
#: A letter by its Unicode category; numerals and marks are none.
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """How often each feature, a hash of two or three neighbouring characters in lower case, occurs in the whole text."""
    found = np.zeros(FEATURES, dtype=np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), SLICE):
        u = np.frombuffer(text[at : at + SLICE + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        two = u[:-1] * np.uint32(0x9E3779B1) + u[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + u[2:]
        two = two[:SLICE]  # those that start in this slice
        for h in (two, three):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            found += np.bincount(h >> np.uint32(16), minlength=FEATURES)
    return found


def weighted(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features that occur and their TF-IDF weights, of length 1."""
    ids = np.flatnonzero(found)
    x = (1 + np.log(found[ids])) * idf[ids]
    norm = np.sqrt(x @ x)
    return ids, x / norm if norm > 0 else x


@dataclass(frozen=True)
class Model:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[ids] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*weighted(counts(text), self.idf)) / self.temperature)
        return self.names[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (class, features, weights) by FTRL-proximal with elastic-net penalties; the bias has none."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))
    bz, bn = np.zeros(classes), np.zeros(classes)

    def leader(z: np.ndarray, n: np.ndarray, l1: float, l2: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    def step(z: np.ndarray, n: np.ndarray, w: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w, n + g * g

    draw = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for k in draw.permutation(len(rows)):
            y, ids, x = rows[k]
            x = x.astype(np.float64)
            w, b = leader(z[ids], n[ids], L1, L2), leader(bz, bn, 0, 0)
            g = softmax(x @ w + b)
            g[y] -= 1
            z[ids], n[ids] = step(z[ids], n[ids], w, np.outer(x, g))
            bz, bn = step(bz, bn, b, g)
    return leader(z, n, L1, L2), leader(bz, bn, 0, 0)


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss on rows that were not fitted, by golden section over its logarithm."""
    if not len(classes):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), classes]).mean())

    low, high, cut = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE) -> Model:
    """Fits a model on the rows of (doc_id, text, lang) that learn holds for and whose text and lang are not null.

    Document frequencies come from all these rows. The classifier is fitted on a sample of at most about `sample` rows,
    as many of each language (EACH at least), chosen by a hash of doc_id and text; a fifth of it sets the temperature.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = known.where(learn) if learn is not None else known
    per_lang = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(per_lang)
    if not names:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)

    def frequencies(batches):
        total = np.zeros(FEATURES, dtype=np.int64)
        for b in batches:
            for t in texts(b.column(0)):
                total += counts(t) > 0
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["feature", "n"])

    df = np.zeros(FEATURES)
    for r in known.select(F.col("text").cast("binary")).mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r.feature] = r.n
    idf = np.log((1 + sum(per_lang.values())) / (1 + df)) + 1

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1 << 30, (max(EACH, sample // len(names)) << 30) // n))) for name, n in per_lang.items()])
    chosen = known.where(part < share).select("lang", (F.pmod(part, F.lit(5)) == 0).alias("apart"), F.col("text").cast("binary").alias("text"))

    def features(batches):
        for b in batches:
            made, values = [], []
            for t in texts(b.column(2)):
                ids, x = weighted(counts(t), idf)
                made.append(ids.astype(np.uint32).tobytes())
                values.append(x.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array(values, pa.binary())], names=["lang", "apart", "ids", "x"])

    # the sample stays in the bytes that it comes in, to spare the driver's memory
    found = sorted(chosen.mapInArrow(features, "lang string, apart boolean, ids binary, x binary").collect(), key=lambda r: (r.lang, r.ids, r.x))
    rows = [(names.index(r.lang), np.frombuffer(r.ids, np.uint32), np.frombuffer(r.x, np.float32), r.apart) for r in found]
    weights, bias = fit([r[:3] for r in rows if not r[3]], len(names))
    apart = [r for r in rows if r[3]]
    logits = np.array([x.astype(np.float64) @ weights[ids] + bias for _, ids, x, _ in apart]).reshape(-1, len(names))
    return Model(names, idf, weights, bias, temperature(logits, np.array([r[0] for r in apart], dtype=int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `_lang` and `_score`: the most probable learned language of each whole text and its probability.

    Only the text is looked at. A null text, one without a letter, and any text where nothing was learned is `und` with
    score 0. Of equally probable languages the first by name counts. Repeated rows are rows of their own, an empty table
    gives an empty one, and other columns pass through, but for those named `_lang` and `_score`, which are replaced.
    """
    docs = docs.drop("_lang", "_score")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for b in batches:
            made = [own.predict(t) for t in texts(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=[*b.schema.names, "_lang", "_score"])

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias("_lang"), F.lit(0.0).alias("_score")).schema)


def keep_known(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents in one of the languages that their labels teach."""
    rows = set_aside(docs, "doc_id", "text", "lang")
    found = predict(rows, train(rows))
    return found.where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= least)).drop("_lang", "_score").toDF(*docs.columns)


def op2_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents whose crc32 of doc_id leaves 2 by 4 are not learned from."""
    held_out = in_fold("doc_id", 4, 2)
    model = train(docs.select("doc_id", "text", "lang"), ~held_out)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
