"""Language of documents by averaged hashed subword embeddings.

A text is the mean of the embeddings of its hashed letter n-grams (within words,
with word ends), under a linear softmax over the languages seen in training.
Embeddings and softmax are trained together by stochastic gradient descent in
numpy, on a bounded, documented sample: ``PER_LANGUAGE`` labelled documents of each
language, or fewer of each where there are so many languages that they would be more than
``SAMPLED`` in all, but never fewer than ``LEAST``; chosen by a hash of id and text. The
sample comes to the driver as n-gram counts, of ``MAX_GRAMS`` different n-grams in
all and the same share for each language, of which every language has a document at
least. A part of the sample is held back to fit the temperature of the
probabilities and the rejection threshold.

Since mean and softmax input are linear, tasks get one table of n-gram bucket by
language: 128 KB for each language.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as
is every text if nothing could be learned; rows with null language are not
learned from; repeated rows get a row each; an empty table gives no rows; columns
other than id, text and language are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import keep

#: Sampled documents of a language and of all languages; the least of a language, however many there are.
PER_LANGUAGE, SAMPLED, LEAST = 300, 1 << 15, 8
#: Different n-grams of all sampled documents, of 8 bytes each.
MAX_GRAMS = 1 << 25
BUCKETS, DIMENSIONS = 1 << 15, 16
GRAMS = (2, 3, 4)
EPOCHS, RATE = 6, 1.0
#: Steps that each language is worth, within so many epochs, where there are few documents of each.
STEPS, MOST_EPOCHS = 200, 60
#: Share of right predictions on held-back documents that may be rejected.
REJECTED = 0.01
UNKNOWN = "und"
_PIECE = 1 << 20
_SPACE = 32
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else _SPACE for b in range(256)], np.uint8)
_LATIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LATIN_LETTER.search(text)) or any(c.isalpha() for c in text))


def grams(text: str):
    """Arrays of the buckets of all n-grams of a whole text, some at a time."""
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "
    for at in range(0, len(raw), _PIECE):
        b = _FOLD[np.frombuffer(raw[at : at + _PIECE + max(GRAMS) - 1], np.uint8)]
        space = b == _SPACE
        b = b[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
        h, inside = b, np.ones(len(b), bool)
        for n in range(2, max(GRAMS) + 1):
            if len(b) < n:
                break
            h = h[:-1] * np.uint32(257) + b[n - 1 :]
            if n > 2:
                inside = inside[:-1] & (b[n - 2 : -1] != _SPACE)
            else:
                inside = inside[:-1]
            if n in GRAMS:
                yield ((h[inside] + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, mean weights) of a text."""
    counts = sum((np.bincount(g, minlength=BUCKETS) for g in grams(text)), np.zeros(BUCKETS, np.int64))
    idx = np.nonzero(counts)[0]
    return idx.astype(np.int32), (counts[idx] / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for g in grams(text):
            total += self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sgd(sample: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 0) -> Model:
    """Train on (language, buckets, weights); every fifth document is held back for calibration."""
    languages = tuple(sorted({x[0] for x in sample}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = [languages.index(x[0]) for x in sample]
    back = [k for k in range(len(sample)) if k % 5 == 4]
    learn = [k for k in range(len(sample)) if k % 5 != 4]
    vectors = rng.normal(0, DIMENSIONS**-0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    epochs = max(EPOCHS, min(MOST_EPOCHS, STEPS * len(languages) // max(1, len(learn))))
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for k in rng.permutation(learn):
            _, idx, w = sample[k]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            mean = w @ vectors[idx]
            error = _softmax(mean @ weights + bias).astype(np.float32)
            error[y[k]] -= 1
            back_to = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            # each bucket's weight is small, so embeddings take a larger step
            vectors[idx] -= 16 * rate * np.outer(w, back_to)
    table = vectors @ weights
    logits = np.array([sample[k][2] @ table[sample[k][1]] + bias for k in back]).reshape(-1, len(languages))
    truth = np.array([y[k] for k in back], int)
    temperature = threshold = 0.0
    if len(back):
        loss = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
        temperature = float(min(loss, key=loss.get))
        p = _softmax(logits / temperature)
        right = p.max(1)[p.argmax(1) == truth]
        threshold = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return Model(languages, table.astype(np.float32), bias.astype(np.float64), temperature or 1.0, threshold)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(rows: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From (_id, _text, _lang) rows: count languages, draw the sample, collect its bags."""
    known = rows.where(F.col("_lang").isNotNull())
    counts = keep(known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_count")), "language-counts")  # a row for each language
    languages = counts.count()
    if not languages:
        return sgd([])
    each = max(LEAST, min(per_language, SAMPLED // languages))
    place = F.pmod(F.xxhash64(F.lit("language"), F.col("_id"), F.col("_text")), F.lit(1 << 30)) / float(1 << 30)
    # somewhat more than wanted, of which the first are taken
    sample = known.withColumn("_place", place).join(counts, "_lang").where(F.col("_place") * F.col("_count") < 2 * each + 16).drop("_count")

    def bags(batches):
        for pdf in batches:
            some = [(i, lang, place, *bag(text)) for i, lang, place, text in zip(pdf["_id"], pdf["_lang"], pdf["_place"], pdf["_text"], strict=True) if has_letter(text)]
            yield pd.DataFrame(some, columns=["_id", "_lang", "_place", "idx", "w"])

    drawn = keep(sample.mapInPandas(bags, "_id long, _lang string, _place double, idx array<int>, w array<float>"), "language-bags")
    order = Window.partitionBy("_lang").orderBy("_place", "_id")  # of some hundred rows
    drawn = drawn.withColumn("_upto", F.sum(F.size("idx")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_nth", F.row_number().over(order))
    drawn = drawn.where((F.col("_nth") == 1) | ((F.col("_nth") <= each) & (F.col("_upto") <= MAX_GRAMS // languages))).toPandas()
    drawn = drawn.sort_values(["_place", "_id"], kind="stable")
    return sgd([(lang, np.asarray(i), np.asarray(w, np.float32)) for lang, i, w in zip(drawn["_lang"], drawn["idx"], drawn["w"], strict=True)])


def detect(docs: DataFrame, model: Model, text: str = "_text") -> DataFrame:
    """``docs`` with ``_found``: lang_pred, score and rejected (below the calibrated threshold)."""

    def run(texts: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])
        return found.assign(rejected=(found["score"] < model.threshold) | (found["lang_pred"] == UNKNOWN))

    return docs.withColumn("_found", F.pandas_udf(run, "lang_pred string, score double, rejected boolean")(F.col(text)))


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, rejected. Learns only from rows not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    model = train(rows.where(~held_out(F.col("_id"))))
    found = detect(rows.select("_id", "_text"), model)
    return found.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "_found.lang_pred", "_found.score", "_found.rejected")
