"""Language identification with error-correcting output codes.

Every language gets a codeword: all splits of the languages where they are few, else seeded random
words chosen for distance. For each bit one logistic classifier over hashed byte n-grams (1 to 4 bytes
of the lower-case text, square roots of their shares) predicts it. A text gets the language whose
codeword has the least weighted logistic loss over all bits; bits weigh by their margin on the training
rows. Texts whose second-best codeword is nearly as near are flagged as ambiguous.

Models are fitted on a sample of at most about ``SAMPLE`` labelled texts, the same share of every
language where they are many and all of a rare one; every text is scored whole. Texts that are null or
have no letter are ``und`` with score 0. With one language all others get it with score 1; without any
label everything is ``und``. Rows are scored one by one, whatever the id; a null id is never held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as V

SAMPLE = 2400
BUCKETS = 4096
GRAMS = 4
NEAR = 0.2
STEPS = 150
_FACTOR = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit


def codewords(count: int, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``count`` classes; every bit splits them."""
    if count <= 7:
        bits = max(1, 2 ** (count - 1) - 1)
        # Bit b is the binary form of b over the classes after the first, which is always on the one side.
        return np.array([[-1 if k and b >> (k - 1) & 1 else 1 for b in range(1, bits + 1)] for k in range(count)])
    rng, bits, best = np.random.default_rng(seed), math.ceil(10 * math.log2(count)), (-1, None)
    for _ in range(64):
        code = rng.choice((-1, 1), (count, bits))
        code = code[:, np.abs(code.sum(0)) < count]
        apart = np.where(np.eye(count, dtype=bool), code.shape[1], (code.shape[1] - code @ code.T) // 2).min()
        if apart > best[0]:
            best = apart, code
    return best[1]


def profiles(part: V.Slice) -> np.ndarray:
    """Square roots of the n-gram shares of each text, by bucket; their squares sum to 1."""
    n, texts = len(part.data), len(part.offsets) - 1
    out = np.zeros(texts * BUCKETS, np.float32)
    owner = V.owners(part.offsets) * BUCKETS
    end = np.repeat(part.offsets[1:], np.diff(part.offsets))
    gram = np.zeros(n, np.uint32)
    data = part.data.astype(np.uint32)
    for size in range(1, GRAMS + 1):
        if n < size:
            break
        gram = gram[: n - size + 1] * np.uint32(256) + data[size - 1 :]
        inside = np.arange(n - size + 1) + size <= end[: n - size + 1]
        bucket = ((gram ^ (gram >> np.uint32(15))) * _FACTOR[size - 1]) >> np.uint32(20)
        out += np.bincount((owner[: n - size + 1] + bucket)[inside], minlength=len(out))
    out = out.reshape(texts, BUCKETS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in V.slices(batch.column(0)):
            rows = profiles(part).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1).slice(part.first, len(rows))], names=["profile", "lang"])


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on rows that are not held out and have a language and a text; the sample is a hash of the id, the same on every run."""
    text = F.lower(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(~held_out(F.col("_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    quota = max(20, sample // len(languages))
    share = F.lit(1.0)
    for lang in languages:
        if counts[lang] > quota:
            share = F.when(F.col("lang") == lang, quota / counts[lang]).otherwise(share)
    drawn = F.pmod(F.xxhash64("_id", F.lit("language sample")), F.lit(1 << 30)) < share * float(1 << 30)
    found = rows.filter(drawn).select("text", "lang").mapInArrow(_sampled, "profile binary, lang string").collect()
    found.sort(key=lambda r: (r.lang, r.profile))
    x = np.stack([np.frombuffer(r.profile, np.float16) for r in found]).astype(np.float32)
    code = codewords(len(languages))
    y = code[[languages.index(r.lang) for r in found]].astype(np.float32)
    balance = np.where(y > 0, 0.5 / np.maximum((y > 0).mean(0), 1e-6), 0.5 / np.maximum((y < 0).mean(0), 1e-6)).astype(np.float32) / np.float32(len(y))
    weights, bias = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(STEPS):  # accelerated gradient steps on the balanced logistic loss
        ahead_w, ahead_b = weights + 0.9 * speed_w, bias + 0.9 * speed_b
        pull = balance * y / (1 + np.exp(np.clip(y * (x @ ahead_w + ahead_b), -50, 50)))
        speed_w = 0.9 * speed_w + 4.0 * (x.T @ pull - np.float32(1e-5) * ahead_w)
        speed_b = 0.9 * speed_b + 1.0 * pull.sum(0)
        weights, bias = weights + speed_w, bias + speed_b
    margin = y * (x @ weights + bias)
    trust = np.maximum(np.tanh(margin).mean(0), 0.05)
    return Model(languages, code, weights.astype(np.float32), bias, trust / trust.sum())


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest language, its share of the soft minimum over languages, and whether another is nearly as near."""
    f = x @ model.weights + model.bias
    loss = np.stack([(np.logaddexp(0, -f * word) * model.trust).sum(1) for word in model.code], 1)
    best = loss.argmin(1)
    soft = np.exp(-(loss - loss.min(1, keepdims=True)) * model.code.shape[1])
    second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return best, 1 / soft.sum(1), second - loss.min(1) < NEAR


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in V.slices(batch.column(2)):
                n = len(part.offsets) - 1
                rows = batch.slice(part.first, n)
                known = rows.column(3).to_numpy(zero_copy_only=False) if m.languages else np.zeros(n, bool)
                best, score, near = decode(m, profiles(part)) if m.languages else (np.zeros(n, int), np.zeros(n), np.zeros(n, bool))
                names = [m.languages[b] if k else "und" for b, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(near & known)],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    return docs.select(id_.alias("doc_id"), held_out(F.col(id_col)).alias("held"), F.lower(text).alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def identify(docs: DataFrame, **columns) -> DataFrame:
    """Fit on the rows that are not held out, then predict all."""
    lang = {k: v for k, v in columns.items() if k != "lang_col"}
    return predict(docs, fit(docs, **columns), **lang)
