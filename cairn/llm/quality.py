"""Quality by co-training a text classifier and a page-metadata classifier.

The text view has word statistics and byte-class pairs of the whole text; the metadata view has the
source, the language and the length that the table states. Both are logistic. Over a few rounds each view
labels rows of an unlabelled pool; those it is sure of, by probabilities calibrated on labelled rows held
aside, join the other view's training rows (as many of each label as their share allows). At the end each view is
calibrated on the rows held aside and a third logistic combines the two; it scores every document.

Bounds: about ``SAMPLE`` labelled rows at most, drawn by a hash of the id, and a pool of about ``POOL`` unlabelled
rows drawn by a hash of id and text; both only fit the models. Null texts count as empty, null metadata as a
value of its own, a null or wrong length as the measured one. Without labels of both kinds every score is the
share of good labels (1 without any). Rows are scored one by one, so repeated rows agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import textvec as V
from cairn.llm.common import free_name, freeze
from cairn.llm.features import class_shares, ratio, word_counts

SAMPLE = 8_000
POOL = 8_000
ROUNDS = 4
SURE = 0.95
STEP_SHARE = 0.1
ACCEPT = 0.5
META = 64
FEATURE_SCHEMA = "text_view array<double>, meta_view array<double>"


class Logistic(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[1:] + self.weights[0]


class Model(NamedTuple):
    text: Logistic
    meta: Logistic
    text_scale: np.ndarray
    meta_scale: np.ndarray
    mix: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Logistic weights, the constant first; the constant is not shrunk."""
    a = np.column_stack([np.ones(len(x)), x])
    shrink = np.full(a.shape[1], ridge)
    shrink[0] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(shrink), a.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> Logistic:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    return Logistic(mean, scale, newton(np.clip((x - mean) / scale, -8, 8), y, ridge))


def calibrate(logit: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Constant and slope that turn logits into probabilities on these rows; the slope is never negative."""
    w = newton(logit[:, None], y, 0.1)
    return w if w[1] > 0 else np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 0.0])


def text_view(part: V.Slice) -> np.ndarray:
    w = V.words(part)
    c = word_counts(part, w)
    words, size = c["words"], c["bytes"]
    mean = ratio(c["letters"], words)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(ratio(c["squares"], words) - mean**2, 0)), ratio(c["long"], words), ratio(c["again"], words), ratio(c["signed"], words),
            ratio(c["distinct"], words), ratio(c["distinct"], np.sqrt(words)), *ratio(c["classes"], size[:, None]).T, class_shares(part),
        ]
    )


def meta_view(source: list, lang: list, length: np.ndarray) -> np.ndarray:
    """One-hot hashes of source and language, and the length's logarithm with its square."""
    out = np.zeros((len(source), 2 * META + 2))
    for i, (s, g) in enumerate(zip(source, lang)):
        for k, value in enumerate((s, g)):
            h = np.uint64(1469598103934665603)
            for b in (value or "\0null").encode():
                h = (h ^ np.uint64(b)) * np.uint64(1099511628211)
            out[i, k * META + int(V.mix(np.array([h]))[0] % np.uint64(META))] = 1
    out[:, -2] = np.log1p(np.maximum(length, 0))
    out[:, -1] = out[:, -2] ** 2
    return out


def views(batch: pa.RecordBatch, part: V.Slice, at: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    rows = batch.slice(part.first, len(part.offsets) - 1)
    source, lang, length = (rows.column(i).to_pylist() for i in at)
    measured = np.diff(part.offsets)
    length = np.array([n if n is not None and n >= 0 else m for n, m in zip(length, measured)], float)
    with np.errstate(over="ignore"):
        return text_view(part), meta_view(source, lang, length)


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in V.slices(batch.column(0)):
            n = len(part.offsets) - 1
            pair = views(batch, part, (1, 2, 3))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())) for x in pair]
            yield pa.RecordBatch.from_arrays([*lists, *batch.slice(part.first, n).columns[4:]], names=["text_view", "meta_view", *batch.schema.names[4:]])


def inputs(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, length_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        F.col(length_col).cast("double").alias("length"), F.col(id_col).cast("long").alias("doc_id"),
    )


def co_train(labelled: tuple[np.ndarray, np.ndarray, np.ndarray], pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Co-train on ``(text view, metadata view, label)`` and the views of the pool; the last third of the labelled rows calibrates."""
    cut = max(2, len(labelled[2]) * 2 // 3)
    while cut < len(labelled[2]) and len(set(labelled[2][:cut])) < 2:
        cut += 1
    fit_rows, aside = [x[:cut] for x in labelled], [x[cut:] for x in labelled]
    if len(aside[2]) < 2 or len(set(aside[2])) < 2:
        aside = labelled
    y = fit_rows[2].astype(float)
    rate = y.mean()
    extra: list[dict[int, int]] = [{}, {}]  # pool rows each view has been given, and their labels
    held = np.zeros(len(pool[0]), bool)
    for turn in range(rounds + 1):
        models = []
        for v in (0, 1):
            given = np.array(list(extra[v]), int)
            x = np.vstack([fit_rows[v], pool[v][given]])
            models.append(fit_logistic(x, np.concatenate([y, list(extra[v].values())])))
        scales = [calibrate(m.logit(aside[v]), aside[2].astype(float)) for v, m in enumerate(models)]
        if turn == rounds or held.all():
            break
        before = held.sum()
        for v in (0, 1):
            p = sigmoid(scales[v][0] + scales[v][1] * models[v].logit(pool[v])) if len(held) else np.zeros(0)
            for label, surety, share in ((1, p, rate), (0, 1 - p, 1 - rate)):
                open_ = np.flatnonzero(~held & (surety >= sure))
                most = int(np.ceil(STEP_SHARE * share * len(held)))
                chosen = open_[np.argsort(-surety[open_], kind="stable")][:most]
                held[chosen] = True
                extra[1 - v].update(dict.fromkeys(chosen.tolist(), label))
        if held.sum() == before:
            break
    logits = np.column_stack([s[0] + s[1] * m.logit(aside[v]) for v, (m, s) in enumerate(zip(models, scales))])
    return Model(models[0], models[1], scales[0], scales[1], newton(logits, aside[2].astype(float), 0.1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars", label_col: str = "quality") -> Model | float:
    """The co-trained model, or the share of good labels where there are not both kinds."""
    rows = inputs(docs, id_col, text_col, source_col, lang_col, length_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    share = min(1.0, SAMPLE / max(known.count(), 1))
    # About SAMPLE rows whatever the input.
    some = F.broadcast(freeze(known.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))))
    got = rows.join(some, "doc_id").select("text", "source", "lang", "length", "label", "doc_id").mapInArrow(_view_rows, FEATURE_SCHEMA + ", label int, doc_id long").toArrow()
    label = got["label"].to_numpy()
    if len(label) < 8 or len(set(label)) < 2:
        return float(label.mean()) if len(label) else 1.0
    count = rows.count()
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("quality pool")), F.lit(1 << 30)) < F.lit(int(min(1.0, POOL / count) * (1 << 30)))
    pool = rows.filter(draw).join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select("text", "source", "lang", "length", "doc_id").mapInArrow(_view_rows, FEATURE_SCHEMA + ", doc_id long").toArrow()
    return co_train((*_ordered(got), label[_order(got)]), _ordered(pool))


def _order(rows: pa.Table) -> np.ndarray:
    """The rows in an order that does not follow how Spark delivers them."""
    first = rows["text_view"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)[:, :2].T if len(rows) else np.zeros((2, 0))
    ids = rows["doc_id"].fill_null(-1).to_numpy().astype(np.int64)
    return np.lexsort((*first, ids, V.mix(ids.view(np.uint64))))


def _ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = _order(rows)
    width = len(text_view(next(V.slices(pa.array([""]))))[0]), 2 * META + 2
    return tuple(rows[n].combine_chunks().flatten().to_numpy().reshape(-1, k)[order] for n, k in zip(("text_view", "meta_view"), width))


def apply(model: Model | float, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the combination and of each view."""
    if isinstance(model, float):
        same = np.full(len(text), model)
        return same, same, same
    a = model.text_scale[0] + model.text_scale[1] * model.text.logit(text)
    b = model.meta_scale[0] + model.meta_scale[1] * model.meta.logit(meta)
    return sigmoid(model.mix[0] + model.mix[1] * a + model.mix[2] * b), sigmoid(a), sigmoid(b)


SCORES = ("score", "text_score", "meta_score")


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with the three scores; new names get underscores where taken."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [free_name(docs, n) for n in SCORES]
    at = [docs.columns.index(c) for c in (text_col, source_col, lang_col, length_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in V.slices(batch.column(at[0])):
                rows = batch.slice(part.first, len(part.offsets) - 1)
                made = apply(shared.value, *views(batch, part, (at[1], at[2], at[3])))
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, made)], names=[*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, text_score, meta_score, accepted."""
    model = fit(docs, labels)
    plain = docs.select("doc_id", "text", "source", "lang", "n_chars")
    return score(plain, model).select("doc_id", *SCORES, (F.col("score") >= ACCEPT).alias("accepted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score at least ``accept``, with their own columns."""
    made = score(docs, fit(docs, labels))
    return made.filter(F.col(free_name(docs, "score")) >= accept).select(*[F.col(f"`{c}`") for c in docs.columns])
