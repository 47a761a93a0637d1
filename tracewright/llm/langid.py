"""Language identification with error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over hashed character n-grams says whether a text
belongs to the languages whose bit is one. A text gets the language whose codeword has the least loss, where each bit
weighs as much as its classifier is sure (loss-weighted decoding), so some wrong bits are corrected. Where the two best
codewords are nearly as good, the row is flagged as ambiguous.

The classifiers are averaged logistic regressions, trained on the driver on the n-grams of a bounded sample of whole texts
(MAX_TRAIN rows, shared evenly by the languages; the lowest hashes). Prediction is a narrow map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import as_text, session, tidy

#: The bound of the training sample, and the number of hashed n-grams.
MAX_TRAIN, FEATURES = 4000, 1 << 13
#: Languages up to which all distinct bits are used, and bits for each doubling beyond.
EXHAUSTIVE, BITS_PER_DOUBLING = 6, 12
#: Below this difference of the two best losses (of 1) a prediction is ambiguous.
MARGIN = 0.02
#: Texts are scored in runs of so many bytes.
RUN = 1 << 20

MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1, no two alike and no bit the same for all."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        bits = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, np.int8).T
    rng = np.random.default_rng(seed)
    width = int(np.ceil(np.log2(n))) * BITS_PER_DOUBLING
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)) if (np.abs(code.sum(0)) < n).all() else -1
        if apart > most:
            best, most = code, apart
    return best


def letters(text: str) -> bytes:
    """Lower-cased letters as UTF-8, other runs as one space, with a space at both ends; empty if there are no letters."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split() if not text.isascii() else text.lower().encode().translate(ASCII_LETTERS).decode().split()
    return f" {' '.join(words)} ".encode() if words else b""


ASCII_LETTERS = bytes(b if 97 <= b <= 122 else 32 for b in range(256))


def grams(raw: np.ndarray) -> np.ndarray:
    """Hashed byte n-grams of lengths 1 to 3 that start at each byte (those cut off by the end are of zeros)."""
    x = raw.astype(np.uint32) + 1
    b, c = np.append(x[1:], 0).astype(np.uint32), np.append(x[2:], [0, 0]).astype(np.uint32)[: len(x)]
    one = x * MULTIPLY[0]
    two = (one ^ b) * MULTIPLY[1]
    three = (two ^ c) * MULTIPLY[2]
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    return np.stack([one >> shift, two >> shift, three >> shift])


def features(text: bytes) -> np.ndarray:
    """Root of the share of each hashed n-gram."""
    n = np.bincount(grams(np.frombuffer(text, np.uint8)).ravel(), minlength=FEATURES).astype(np.float32)
    return n / max(1.0, n.sum())


class Model:
    """langs, their codewords, and a row of weights for each n-gram and one of biases."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.code, self.weights, self.bias = langs, code, weights, bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of bit margins: the best language, a score from 0 to 1, and whether it is ambiguous."""
        sure = np.abs(np.tanh(margins))
        loss = 1 / (1 + np.exp(np.clip(margins[:, None, :] * self.code[None], -30, 30)))
        total = (loss * sure[:, None, :]).sum(2) / np.maximum(sure.sum(1), 1e-9)[:, None]
        best = total.argmin(1)
        p = np.exp(-20 * (total - total.min(1, keepdims=True)))
        score = (p / p.sum(1, keepdims=True)).max(1)
        two = np.sort(total, 1)[:, :2]
        return best, score, (two[:, 1] - two[:, 0] < MARGIN) if total.shape[1] > 1 else np.zeros(len(total), bool)

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The mean weight of each text's n-grams, with the bias, per bit. Whole texts, in runs."""
        out = np.zeros((len(texts), self.weights.shape[1]))
        weights = self.weights.astype(float)
        for k, text in enumerate(texts):
            n = np.zeros(FEATURES, np.int64)
            for a in range(0, len(text), RUN):
                own = grams(np.frombuffer(text[a : a + RUN + 2], np.uint8))[:, :RUN]
                n += np.bincount(own.ravel(), minlength=FEATURES)
            out[k] = n @ weights
        return out / np.maximum(3 * np.array([len(x) for x in texts]), 1)[:, None] + self.bias


def fit(texts: list[str], langs: list[str], epochs: int = 25, seed: int = 3) -> Model:
    """Trains on texts and their languages; those without letters count for nothing."""
    own = [(features(x), lang) for text, lang in zip(texts, langs, strict=True) if (x := letters(text))]
    return train([(np.flatnonzero(x), x[x > 0], lang) for x, lang in own], epochs, seed)


def train(rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 25, seed: int = 3) -> Model:
    """Trains the bits' classifiers on rows of n-grams, their counts or shares, and language. Averaged stochastic gradients."""
    names = sorted({row[2] for row in rows})
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((FEATURES, code.shape[1]), np.float32), np.ones(code.shape[1]))
    x = np.zeros((len(rows), FEATURES), np.float32)  # at most MAX_TRAIN rows
    for i, (at, n, _) in enumerate(rows):
        x[i, at] = n / n.sum()
    np.sqrt(x, out=x)
    of = np.array([names.index(row[2]) for row in rows])
    y = code[of].astype(np.float32)
    share = (len(rows) / len(names) / np.bincount(of))[of].astype(np.float32)
    scale = np.float32(1 / max(1e-9, float(np.einsum("ij,ij->i", x, x).mean())))
    w, bias = np.zeros((FEATURES, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        rate = np.float32(8 * scale / (1 + 0.1 * epoch))
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            i = order[at : at + 64]
            g = -y[i] / (1 + np.exp(np.clip(y[i] * (x[i] @ w + bias), -30, 30))) * share[i][:, None]
            w -= rate * (x[i].T @ g / len(i) + np.float32(1e-6) * w)
            bias -= rate * np.float32(0.1) * g.mean(0)
    return Model(names, code, w, bias.astype(float))


def sample(labelled: DataFrame, max_train: int = MAX_TRAIN) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """N-grams, their counts and language of at most max_train distinct rows of labelled(doc_id, text, lang): of each language those
    of the lowest hashes, as many of each as there are of them, up to its even share.

    Rows up to a hash that lets about a quarter more through are counted, whole, where they are; the driver gets numbers of
    n-grams, whatever the corpus and the length of its texts.
    """
    spark = session(labelled)
    rows = labelled.selectExpr("doc_id", "cast(text as string) text", "cast(lang as string) lang").filter("lang is not null and text is not null")
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not n:
        return []
    share = max(1, max_train // len(n))
    top = spark.sparkContext.broadcast({lang: int(min(1.0, 1.25 * (share + 20) / c) * 2.0**64 - 2.0**63) for lang, c in n.items()})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, h = batch.column("lang").to_pylist(), batch.column("h").to_pylist()
            batch = batch.filter(pa.array([x <= top.value[k] for x, k in zip(h, lang, strict=True)], pa.bool_()))
            own = [np.bincount(grams(np.frombuffer(raw, np.uint8)).ravel(), minlength=FEATURES) if (raw := letters(x)) else np.zeros(0, np.int64) for x in as_text(batch.column("text"))]
            at = [np.flatnonzero(x) for x in own]
            packed = [[i.astype(np.uint32).tobytes() for i in at], [x[i].astype(np.uint32).tobytes() for x, i in zip(own, at, strict=True)]]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), *(pa.array(x, pa.binary()) for x in packed)], names=["h", "lang", "at", "n"])

    found = rows.withColumn("h", F.xxhash64("doc_id", "lang", "text")).mapInArrow(tidy(counted), "h long, lang string, at binary, n binary").filter(F.octet_length("at") > 0)
    out, taken = [], dict.fromkeys(n, 0)
    for r in sorted(found.dropDuplicates(["h"]).collect(), key=lambda r: r.h):
        if taken[r.lang] < share:
            taken[r.lang] += 1
            out.append((np.frombuffer(r["at"], np.uint32), np.frombuffer(r["n"], np.uint32), r.lang))
    return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous.

    lang_pred is `und`, with score 0, where the text is null or has no letter, or where nothing was learned. Columns of
    these names are replaced; others stay. Repeated rows each get their row.
    """
    spark = session(docs)
    own = spark.sparkContext.broadcast(model)  # FEATURES x bits numbers, whatever the corpus
    kept = docs.drop("lang_pred", "score", "ambiguous")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = own.value
        for batch in batches:
            raw = [letters(x) for x in as_text(batch.column(text))]
            names, scores, unsure = ["und"] * len(raw), [0.0] * len(raw), [True] * len(raw)
            at = [i for i, x in enumerate(raw) if x and m.langs]
            if at:
                best, score, ambiguous = m.decode(m.margins([raw[i] for i in at]))
                for i, b, s, a in zip(at, best.tolist(), score.tolist(), ambiguous.tolist(), strict=True):
                    names[i], scores[i], unsure[i] = m.langs[b], min(1.0, max(0.0, s)), a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return kept.mapInArrow(tidy(run), schema)


def lettered(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, those that predict() may give a language."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([bool(letters(x)) for x in as_text(batch.column(text))], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def identify(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 4) = 2", max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row of docs(doc_id, text, lang): doc_id, held_out, lang_pred, score, ambiguous.

    Learns from text and lang of rows that are not held out (a null doc_id is held out) and have a lang.
    """
    labelled = docs.filter(f"not coalesce({held_out}, true)")
    model = train(sample(labelled, max_train))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", f"coalesce({held_out}, true) held_out", "cast(text as string) text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
