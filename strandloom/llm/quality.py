"""Quality from weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer.

Each labeller looks at one property of a text and says good, bad or nothing. How often each combination of answers occurs is
counted over all documents; from these counts expectation-maximisation finds each labeller's accuracy on good and on
bad documents and the share of good ones, without any true label. The posterior of a document's answers is then the target of
a linear scorer on hashed byte trigrams and word repetition, fitted on at most ``train_rows`` documents chosen
by hash; all documents are scored. A document is kept if its score is at least ``threshold``.

Null or blank texts get no answers, score 0 and are not kept. Rows with a null id are scored like others, and
repeated rows each. An empty table gives no rows. All columns are kept; quality_score, quality_posterior and
quality_kept replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.chunks import small_batches
from strandloom.llm.text import U, blocks, by_doc, flat, mix, trimmed, word_bounds, word_hashes

BUCKETS = 1 << 18
#: Prior share of good documents, of those a labeller objects to, and how much the priors weigh against the answers.
GOOD, OBJECTIONS, PRIOR = 0.8, 0.002, 1.0
#: Trigrams of no evidence that every text has besides: a short text says little.
SHRINK = 200
_SYMBOL, _UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: name, property, bad from, good up to; between them the labeller says nothing.
LABELLERS = (("symbols", 0, 0.03, 0.008), ("capitals", 1, 0.5, 0.2), ("shouting", 2, 0.015, 0.002), ("table", 3, 0.01, 0.002), ("stutter", 4, 0.3, 0.05), ("monotone", 5, 0.5, 0.15), ("decorated", 6, 0.3, 0.1))
_ODD = _SYMBOL.copy()
_ODD[[ord(c) for c in "!0123456789"]] = True


def properties(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of property values for each text, and its number of words."""
    size = np.diff(offsets)
    n = np.maximum(size, 1)
    words, counts = word_hashes(data, offsets)
    letters = by_doc(_LETTER[data], size)
    starts, ends, _ = word_bounds(data, offsets)
    odd = np.r_[0, np.cumsum(_ODD[data])]
    odd = odd[ends] > odd[starts]  # words with a sign in them
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[(np.cumsum(counts) - counts)[counts > 0]] = False
    doc = np.repeat(np.arange(len(counts)), counts)
    pairs = mix(words[:-1] * U(0x9E3779B97F4A7C15) + words[1:])
    pairs, doc = pairs[doc[1:] == doc[:-1]], doc[1:][doc[1:] == doc[:-1]]
    order = np.argsort(pairs)
    order = order[np.argsort(doc[order], kind="stable")]
    again = np.zeros(len(pairs), bool)
    again[1:] = (pairs[order][1:] == pairs[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    some = np.maximum(counts, 1)
    again = by_doc(again, np.maximum(counts - 1, 0)) / some
    columns = [by_doc(_SYMBOL[data], size) / n, np.where(letters >= 20, by_doc(_UPPER[data], size) / np.maximum(letters, 1), 0.3), by_doc(data == 33, size) / n, by_doc(data == 124, size) / n, by_doc(same, counts) / some, np.where(counts >= 20, again, 0.3), by_doc(odd, counts) / some]
    return np.stack(columns, 1) if len(counts) else np.zeros((0, 7)), counts


def answers(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 good, -1 bad, 0 nothing, for each text and labeller."""
    out = np.stack([np.where(values[:, k] >= bad, -1, np.where(values[:, k] <= good, 1, 0)) for _, k, bad, good in LABELLERS], 1)
    return np.where(counts[:, None] > 0, out, 0).astype(np.int8)


def code(votes: np.ndarray) -> np.ndarray:
    return ((votes.astype(np.int64) + 1) * 3 ** np.arange(votes.shape[1])).sum(1)


def accuracies(patterns: np.ndarray, counts: np.ndarray, steps: int = 300) -> tuple[float, np.ndarray]:
    """Share of good documents, and P(good answer | class, some answer) as [class, labeller], by expectation-maximisation.
    All labellers start alike: 9 good answers of 10 for a good document, 6 of 10 for a bad one, which most labellers have nothing
    against. Answers on good documents have a Beta prior with mean ``1 - OBJECTIONS`` that weighs as much as the class's own
    answers, so the estimate lies midway between the two, and so has the share of good documents: with weaker ones, the classes
    can settle on two kinds of bad documents, or on documents with and without objections the wrong way round."""
    votes = np.stack([patterns // 3**k % 3 for k in range(len(LABELLERS))], 1)
    share, table = 0.5, np.repeat([[0.6], [0.9]], len(LABELLERS), 1)
    for _ in range(steps):
        good = posterior(votes, share, table)
        for c, own in enumerate((1 - good, good)):
            mass = [((votes == v) * (own * counts)[:, None]).sum(0) + 1 for v in (0, 2)]
            table[c] = mass[1] / (mass[0] + mass[1])
        table[1] = (table[1] + PRIOR * (1 - OBJECTIONS)) / (1 + PRIOR)
        share = (float((good * counts).sum()) / max(counts.sum(), 1) + PRIOR * GOOD) / (1 + PRIOR)
    return share, table


def posterior(votes: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """P(good | answers); a labeller that says nothing counts for nothing."""
    log = [np.log(p) + ((votes == 2) * np.log(table[c]) + (votes == 0) * np.log(1 - table[c])).sum(1) for c, p in ((0, 1 - share), (1, share))]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all texts end to end, none over a boundary, and their numbers."""
    x = data.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) if len(x) >= 3 else np.zeros(0, np.uint32)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(14)
    keep = np.ones(len(h), bool)
    for back in (1, 2):
        at = offsets[1:] - back
        keep[at[(at >= 0) & (at < len(h))]] = False
    return h[keep].astype(np.int64), np.maximum(np.diff(offsets) - 2, 0)


def _extra(values: np.ndarray) -> np.ndarray:
    return np.c_[values[:, [4, 5]] * 10, np.ones(len(values))]


def scores(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    h, counts = trigrams(data, offsets)
    linear = by_doc(weights[h], counts) / (counts + SHRINK) + _extra(values) @ weights[BUCKETS:]
    return 1 / (1 + np.exp(-np.clip(linear, -30, 30)))


def fit(x: list[tuple[np.ndarray, np.ndarray]], extra: np.ndarray, target: np.ndarray, epochs: int = 150, rate: float = 1.0) -> np.ndarray:
    """Logistic weights on trigram shares and the extra columns, by full gradient steps scaled to each feature (AdaGrad)."""
    doc = np.repeat(np.arange(len(x)), [len(i) for i, _ in x])
    feature, value = np.concatenate([i for i, _ in x]).astype(np.int64), np.concatenate([v for _, v in x]).astype(float)
    weights, seen = np.zeros(BUCKETS + extra.shape[1]), np.full(BUCKETS + extra.shape[1], 1e-8)
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).mean(), 1e-3), 0.5 / max((target <= 0.5).mean(), 1e-3))
    balance = np.sqrt(balance)
    for _ in range(epochs):
        linear = np.bincount(doc, weights=weights[feature] * value, minlength=len(x)) + extra @ weights[BUCKETS:]
        error = balance * (1 / (1 + np.exp(-np.clip(linear, -30, 30))) - target) / len(x)
        gradient = np.r_[np.bincount(feature, weights=error[doc] * value, minlength=BUCKETS), extra.T @ error]
        seen += gradient**2
        weights -= rate * gradient / np.sqrt(seen)
    return weights


def quality_scores(docs: DataFrame, train_rows: int = 4000, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with quality_score, quality_posterior (of the labellers' answers) and quality_kept."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("quality_score", "quality_posterior", "quality_kept")
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for low, high in blocks(offsets):
                values, counts = properties(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                found, n = np.unique(code(answers(values, counts))[counts > 0], return_counts=True)
                for k, v in zip(found.tolist(), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pattern", "n"])

    # a row for each combination of answers: 3 ** len(LABELLERS) at most
    counted = texts.select("text").mapInArrow(trimmed(vote), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, n = np.array([r["pattern"] for r in counted], np.int64), np.array([r["n"] for r in counted], float)
    share, table = accuracies(patterns, n)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own, targets = [], [], []
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            values, counts = properties(data, offsets)
            h, sizes = trigrams(data, offsets)
            target = posterior(answers(values, counts) + 1, share, table)
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(counts > 0):
                feature, times = np.unique(h[ends[k] - sizes[k] : ends[k]], return_counts=True)
                x.append((feature.astype(np.int32), (times / (sizes[k] + SHRINK)).astype(np.float32)))
                own.append(values[k])
                targets.append(float(target[k]))
        if x:
            weights = fit(x, _extra(np.array(own)), np.array(targets))
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    weights = np.zeros(BUCKETS + 3)
    if len(n):
        part = min(1.0, 1.1 * train_rows / n.sum())
        # a limit's rows are in one task, which fits on them: the driver gets the weights alone, two megabytes
        chosen = texts.filter((F.col("h").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)) < part).orderBy("h").limit(train_rows)
        for (found,) in chosen.mapInArrow(trimmed(learn), "weights binary").collect():
            weights = np.frombuffer(found, float)
    shared = spark.sparkContext.broadcast((weights, share, table))  # two megabytes
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_posterior", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, share, table = shared.value
        for batch in batches:
            data, offsets = flat(batch.column(text_col))
            found, good = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for low, high in blocks(offsets):
                own, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                values, counts = properties(own, at)
                found[low:high] = np.where(counts > 0, scores(own, at, values, weights), 0)
                good[low:high] = np.where(counts > 0, posterior(answers(values, counts) + 1, share, table), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(good), pa.array(found >= threshold)], names=[*batch.schema.names, "quality_score", "quality_posterior", "quality_kept"])

    return docs.mapInArrow(trimmed(score), schema)
