"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of a fixed word list and of a learned lexicon of words
and word beginnings, how close list words stand to second-person words, shares of capitals, signs and
repeats, and obfuscation rates (list words spelt with digits and signs, signs inside words, stretched
letters). The learned lexicon holds the words and beginnings whose rate among toxic training texts exceeds
that among others beyond chance. Boosted trees are fitted on four fifths of the training rows and calibrated by
isotonic regression on the rest; scores are calibrated probabilities.

Only labels of rows that are not held out are used, at most about ``SAMPLE`` of them, drawn by a hash of the
id; labels, language, source and id enter no score. Null texts count as empty and are scored as such. Without
labels of both kinds every score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import textvec as V
from cairn.llm.common import freeze
from cairn.llm.features import ratio, word_counts

SAMPLE = 20_000
LEXICON_SAMPLE = 6_000
LEXICON = 400
STEMS = (4, 5, 6, 7, 8)
TREES, DEPTH = 24, 4
CUT = 0.7
SEED = 17

# Insults and second-person words of several languages.
INSULTS = """idiot idiots moron morons stupid dumb trash scum loser losers clown pathetic worthless disgusting garbage filth
fool jerk imbecile freak creep ugly vermin dumbass bastard idiota estúpido estúpida imbécil basura asqueroso patético
inútil payaso tonto tonta idiote stupide imbécile ordure pathétique dégoûtant raté clochard débile crétin dumm blöd
dummkopf abschaum müll erbärmlich wertlos ekelhaft versager trottel vollidiot""".split()
SECOND = "you your yours yourself u ur tu te ti tú usted ustedes vosotros vous toi ton ta tes votre vos du dich dir dein deine ihr euch euer sie".split()
_SWAP = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"@4310!5$7", b"aaeioisst"):
    _SWAP[_a] = _b
FEATURES = (
    "list_density", "list_count", "list_near_second", "second_density", "learned_words", "learned_stems", "learned_count", "learned_share",
    "swapped", "inner_signs", "stretched", "upper", "upper_words", "signs", "marks", "exclaims", "digits", "beyond", "again", "signed",
    "mean_length", "distinct", "length",
)


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _stem_hashes(part: V.Slice, w: V.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have more than ``size`` characters, and hashes of those characters; continuation bytes do not count."""
    lead = (part.data & 0xC0) != 0x80
    place = np.concatenate(([0], np.cumsum(lead)))
    use = np.flatnonzero(place[w.ends] - place[w.starts] > size)
    at = np.flatnonzero(lead)
    ends = at[place[w.starts[use]] + size]
    short = V.Words(np.zeros(0, np.uint64), w.starts[use], ends, w.offsets)
    sizes = ends - short.starts
    out = np.full(len(use), np.uint64(size))
    for j in range(int(sizes.max()) if len(sizes) else 0):
        here = j < sizes
        out[here] = out[here] * np.uint64(0x100000001B3) + part.data[short.starts[here] + j]
    return use, V.mix(out)


def _marks(part: V.Slice, w: V.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(words, hashes)`` of whole words and of their beginnings of each size."""
    yield np.arange(len(w.hashes)), w.hashes
    for size in STEMS:
        yield _stem_hashes(part, w, size)


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each label each mark occurs, added up within the task."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for part in V.slices(batch.column(0)):
            w = V.words(part)
            owner = V.owners(w.offsets)
            for use, marks in _marks(part, w):
                pairs = np.unique(np.stack([marks, owner[use].astype(np.uint64)]), axis=1)
                names, inverse = np.unique(pairs[0], return_inverse=True)
                toxic = label[part.first + pairs[1].astype(np.int64)] == 1
                for name, t, n in zip(names.tolist(), np.bincount(inverse, toxic), np.bincount(inverse)):
                    if name in seen:
                        seen[name] += (t, n - t)
                    else:
                        seen[name] = np.array([t, n - t])
            if len(seen) > 500_000:
                yield _counted(seen)
                seen = {}
    yield _counted(seen)


def _counted(seen: dict[int, np.ndarray]) -> pa.RecordBatch:
    c = np.array(list(seen.values())).reshape(-1, 2).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.array(list(seen), np.uint64).view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1])], names=["mark", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> np.ndarray:
    """Marks (hashes) much commoner in toxic texts of ``sample(text, label)``, the surest ``most`` of them."""
    totals = sample.agg(F.sum(F.col("label")).alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    if not totals.t or not totals.c:
        return np.zeros(0, np.uint64)
    counts = sample.mapInArrow(_lexicon_counts, "mark long, toxic long, clean long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = (F.col("toxic") + 0.5) / (totals.t + 1), (F.col("clean") + 0.5) / (totals.c + 1)
    sure = F.log(a / b) / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = counts.filter("toxic >= 5").withColumn("sure", sure).filter((F.col("sure") > 5) & (a > 4 * b)).orderBy(F.col("sure").desc(), "mark").limit(most).collect()
    return np.sort(np.array([r.mark for r in found], np.int64).view(np.uint64))


def _known(marks: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(marks), bool)
    return table[np.minimum(np.searchsorted(table, marks), len(table) - 1)] == marks


_INSULTS = np.sort(np.array([V.word_hash(x) for x in INSULTS], np.uint64))
_SECOND = np.sort(np.array([V.word_hash(x) for x in set(SECOND)], np.uint64))


def features(part: V.Slice, cased: V.Slice, lexicon: np.ndarray) -> np.ndarray:
    """The features of each text of a slice of lower-case texts; ``cased`` has the same texts as they are."""
    w = V.words(part)
    c = word_counts(part, w)
    texts, owner = len(part.offsets) - 1, V.owners(w.offsets)
    total = lambda x: np.bincount(owner, x, texts) if len(owner) else np.zeros(texts)
    bad, second = _known(w.hashes, _INSULTS), _known(w.hashes, _SECOND)
    near = np.zeros(len(bad), bool)
    for step in range(1, 5):
        near[step:] |= second[:-step] & (owner[step:] == owner[:-step])
        near[:-step] |= second[step:] & (owner[step:] == owner[:-step])
    whole, stems = np.zeros(len(bad), bool), np.zeros(len(bad), bool)
    for k, (use, marks) in enumerate(_marks(part, w)):
        (whole if k == 0 else stems)[use] |= _known(marks, lexicon)
    # The same words after digits and signs that stand for letters are put back.
    plain = V.words(V.Slice(part.first, _SWAP[part.data], part.offsets))
    swapped = np.bincount(V.owners(plain.offsets), _known(plain.hashes, _INSULTS), texts) if len(plain.hashes) else np.zeros(texts)
    data = part.data
    text_of = V.owners(part.offsets)
    count = lambda x, size=0: np.bincount(text_of[: len(data) - size][x] if size else text_of[x], minlength=texts)
    inner, stretched = np.zeros(texts), np.zeros(texts)
    if len(data) > 2:
        word = V.WORD_BYTE[data]
        sign = ~word & (data > 32)
        joined = text_of[:-2] == text_of[2:]
        inner = count(word[:-2] & sign[1:-1] & word[2:] & joined, 2)
        stretched = count((data[:-2] == data[1:-1]) & (data[1:-1] == data[2:]) & word[:-2] & joined, 2)
    upper = cased.data[(cased.data >= 65) & (cased.data <= 90)]
    cased_of = V.owners(cased.offsets)
    is_upper = (cased.data >= 65) & (cased.data <= 90)
    uppers = np.bincount(cased_of[is_upper], minlength=texts)
    pairs = np.bincount(cased_of[1:][is_upper[1:] & is_upper[:-1] & (cased_of[1:] == cased_of[:-1])], minlength=texts) if len(upper) > 1 else np.zeros(texts)
    words, size, kinds = c["words"], c["bytes"], c["classes"]
    bads, learned = total(bad), total(whole | stems)
    return np.stack(
        [
            ratio(bads, words), np.log1p(bads), ratio(total(bad & near), bads), ratio(total(second), words), np.log1p(total(whole)), np.log1p(total(stems)), np.log1p(learned), ratio(learned, words),
            np.log1p(np.maximum(swapped - bads, 0)), ratio(inner, size), ratio(stretched, size), ratio(uppers, size), ratio(pairs, np.maximum(uppers, 1)), ratio(kinds[:, 7], size), ratio(kinds[:, 6], size),
            ratio(count(data == 33), size), ratio(kinds[:, 2], size), ratio(kinds[:, 3], size), ratio(c["again"], words), ratio(c["signed"], words),
            ratio(c["letters"], words), ratio(c["distinct"], words), np.log1p(size),
        ],
        axis=1,
    )


def with_features(rows: DataFrame, lexicon: np.ndarray, kept: str) -> DataFrame:
    """``kept`` columns (a schema text) of ``rows`` and the features of its ``text``."""
    names = [f.split()[0] for f in kept.split(", ")]
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cased = batch.column(1).cast(pa.large_string()).fill_null("")
            for part in V.slices(batch.column(0)):
                n = len(part.offsets) - 1
                same = next(V.slices(cased.slice(part.first, n), 1 << 62))
                x = features(part, same, shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(part.first, n).columns[2:], lists], names=[*names, "features"])

    return rows.select(F.lower("text").alias("_low"), "text", *names).mapInArrow(run, f"{kept}, features array<double>")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text.alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    # One label an id, toxic where they differ; the sample has about SAMPLE rows whatever the input.
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, sample / max(known.count(), 1))
    known = freeze(known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))))
    train = freeze(rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label"))
    totals = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("t")).first()
    if totals.t in (0, totals.n):
        share = totals.t / totals.n if totals.n else 0.0
        return rows.select("doc_id", "held_out", F.lit(share).alias("score"), F.lit(int(share >= cut)).alias("predicted"))
    some = train.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(min(1.0, LEXICON_SAMPLE / totals.n) * (1 << 20)))
    lexicon = learn_lexicon(some.select(F.lower("text").alias("text"), "label"))
    made = freeze(with_features(train, lexicon, "doc_id long, label int")).withColumn("features", array_to_vector("features"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    fitted, rest = made.filter(~aside), made.filter(aside)
    kinds = {r.label for r in fitted.select("label").distinct().collect()}
    if len(kinds) < 2 or rest.isEmpty():
        fitted, rest = made, made
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.25, minInstancesPerNode=5, seed=SEED, checkpointInterval=-1).fit(fitted.orderBy("doc_id"))
    raw = lambda df: trees.transform(df).withColumn("raw", vector_to_array("probability")[1])
    scale = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(rest).select("raw", F.col("label").cast("double").alias("label")))
    scored = raw(with_features(rows, lexicon, "doc_id long, held_out boolean").withColumn("features", array_to_vector("features")))
    out = scale.transform(scored.select("doc_id", "held_out", "raw")).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
