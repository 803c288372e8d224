"""Toxicity by compression distance.

Two dictionaries are trained by zstandard's own trainer: an ordinary one on windows of ordinary texts, and a toxic one on
fragments of toxic texts, the words that toxic documents use in significantly more surroundings, each as often as it is used. The
toxic side compresses with both, so that the two differ by the toxic dictionary alone. (Trained on whole windows of toxic
texts, the trainer keeps what all texts share: see the README's figures.) Every text is cut at white space into
windows; a window that compresses to fewer bytes on the toxic side counts for toxicity. A document's gains over
all its windows (largest, how many, mean) become a probability by a logistic calibration on labelled texts that the
dictionaries have not seen, weighted to the labels' true shares.

Learning reads at most ``toxic_rows`` and ``ordinary_rows`` labelled documents, chosen by hash, one text of each id, and ``sample_bytes``
of text for each label, whatever the corpus size: texts that don't fit any more are left out. All
documents are scored whole. Null text is empty; empty texts get the calibrated score of no windows. Null ids
are scored, and not held out. A document with several labels is toxic if one says so. Without labels of both kinds every score is
the share of toxic labels. Repeated rows are scored each; empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.chunks import small_batches
from strandloom.llm.text import trimmed

WINDOWS, STEMS, LEAST, CAP = (40, 64), (4, 5, 6), 2.0, 12
#: Trainer: bytes of the dictionaries at most, segment and match length, words of a sample, samples of ordinary text. The sizes are
#: those of 12, 16, 20, 24 and 28 thousand that found most on the texts of the calibration.
TOXIC_SIZE, ORDINARY_SIZE, SEGMENT, MATCH, GRAM, FRAGMENTS, SAMPLES = 8192, 28000, 32, 6, 8, 16, 150_000
#: Bytes that both dictionaries have and every window begins with, so that each is stored compressed.
PREFIX = "\x01".join(map(chr, range(33, 73)))


def _strip(word: str) -> str:
    return word.strip(".,!?;:\"'()")


def _surroundings(texts: list[str]) -> Counter:
    """How many different words each word, and each beginning of words, follows: copies of a text add nothing."""
    pairs = set()
    for text in texts:
        words = [_strip(x) for x in text.lower().split()]
        pairs.update(zip(["", *words], words, strict=False))
    out: Counter = Counter()
    for _, word in pairs:
        out[word] += 1
        for n in STEMS:
            if len(word) > n:
                out[word[:n]] += 1
    return out


def significant(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Words and beginnings of words that toxic texts use in significantly more surroundings."""
    t, o = _surroundings(toxic), _surroundings(ordinary)
    n_t, n_o = max(sum(t.values()), 1), max(sum(o.values()), 1)

    def odds(word: str, n: int) -> float:
        return math.log((n + 0.5) / n_t) - math.log((o[word] + 0.5) / n_o) - 1.5 * math.sqrt(1 / (n + 0.5) + 1 / (o[word] + 0.5))

    return {word for word, n in t.items() if len(word) >= STEMS[0] and n >= 3 and odds(word, n) > LEAST}


def _train(size: int, samples: list[bytes]) -> bytes:
    """A dictionary trained by zstandard; of too few samples the trainer makes none, and they are the dictionary."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The toxic side's and the ordinary dictionary."""
    chosen, fragments, windows = significant(toxic, ordinary), [], []
    for text in toxic:
        for word in map(_strip, text.lower().split()):
            found = next((x for x in (word, *(word[:n] for n in STEMS[::-1])) if x in chosen), None)
            if found:
                fragments.append(f" {found} ".encode())
    for text in ordinary:
        words = text.lower().encode().split()
        windows += [b" ".join(words[i : i + GRAM]) for i in range(0, len(words), GRAM)]
    shuffle = random.Random(1).shuffle
    shuffle(fragments)
    shuffle(windows)
    samples = [b"".join(fragments[i : i + FRAGMENTS]) for i in range(0, len(fragments), FRAGMENTS)]
    total = sum(map(len, samples))
    extra = _train(min(TOXIC_SIZE, max(512, total // 4)), samples * (200 // max(len(samples), 1) or 1)) if samples else b""
    tail = _train(ORDINARY_SIZE, windows[:SAMPLES]) + f" {PREFIX}".encode()
    return extra + b" " + tail, tail


class Distance:
    """Features of a text: what the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        def compressor(content: bytes):
            params = z.ZstdCompressionParameters.from_level(9, source_size=128, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, strategy=z.STRATEGY_LAZY, min_match=5, window_log=17, search_log=6, hash_log=15, chain_log=15)
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params)

        self.toxic, self.ordinary, self.prefix = compressor(toxic).compress, compressor(ordinary).compress, PREFIX.encode()

    def gains(self, words: list[bytes], size: int) -> np.ndarray:
        out, held, n = [], [self.prefix], 0
        toxic, ordinary = self.toxic, self.ordinary
        for word in [*words, None]:
            if word is not None:
                held.append(word)
                n += len(word) + 1
            if n >= size or (word is None and n):
                held.append(b"")
                window = b" ".join(held)
                out.append(len(ordinary(window)) - len(toxic(window)))
                held, n = [self.prefix], 0
        return np.array(out or [0], float)

    def __call__(self, text: str) -> list[float]:
        words, out = text.lower().encode().split(), []
        for size in WINDOWS:
            d = np.sort(self.gains(words, size))[::-1]
            out += [min(d[0], CAP), min(d[1], CAP) if len(d) > 1 else 0.0, math.log1p((d >= 2).sum()), math.log1p((d >= 3).sum()), float((d >= 3).mean()), math.log1p(len(d)), float(d.mean())]
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights by damped Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return mean, scale, w


def every_third(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, held_out=every_third, toxic_rows: int = 2200, ordinary_rows: int = 7500, sample_bytes: int = 32 << 20, calibrate: float = 0.25, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted for every document. ``learn`` (on doc_id) says from which rows to learn."""
    spark = docs.sparkSession
    small_batches(spark)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1 if learn is None else learn
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().filter(learn).groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    model: tuple | float
    if len(shares) < 2:
        model = float(1 in shares)
    else:
        sample = None
        for y, most in ((1, toxic_rows), (0, ordinary_rows)):
            part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
            sample = part if sample is None else sample.unionByName(part)
        texts = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
        sizes = texts.groupBy("doc_id", "y").agg(F.min(F.struct("h", F.octet_length("text").alias("size"))).alias("x")).select("doc_id", "y", "x.*")
        taken, room = [], {0: sample_bytes, 1: sample_bytes}
        for r in sorted(sizes.collect(), key=lambda r: (zlib.crc32(b"%d" % r["doc_id"]), r["doc_id"])):  # some thousand numbers
            if r["size"] <= room[r["y"]]:
                room[r["y"]] -= r["size"]
                taken.append((r["doc_id"], r["h"]))
        chosen = F.broadcast(spark.createDataFrame(taken, "doc_id long, h long"))
        rows = texts.join(chosen, ["doc_id", "h"]).dropDuplicates(["doc_id"]).collect()  # sample_bytes of each label at most
        rows.sort(key=lambda r: (zlib.crc32(b"%d" % r["doc_id"]), r["doc_id"], r["text"]))
        split = [[r["text"] for r in rows if r["y"] == y] for y in (0, 1)]
        cut = [max(1, int(len(x) * (1 - calibrate))) if len(x) > 1 else 0 for x in split]
        contents = dictionaries(split[1][: cut[1] or None], split[0][: cut[0] or None])
        measure, x, y, weight = Distance(*contents), [], [], []
        for label in (0, 1):
            own = split[label][cut[label] :]
            x += [measure(t) for t in own]
            y += [label] * len(own)
            weight += [shares[label] / sum(shares.values()) * 2000 / max(len(own), 1)] * len(own)
        model = (contents, fit_logistic(np.array(x), np.array(y, float), np.array(weight))) if x else 0.0
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of some ten kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        measure = Distance(*model[0]) if isinstance(model, tuple) else None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if measure is None:
                score = np.full(len(ids), model)
            else:
                mean, scale, w = model[1]
                x = np.array([measure(t or "") for t in batch.column(1).to_pylist()]).reshape(len(ids), len(mean))
                score = 1 / (1 + np.exp(-np.clip(np.c_[(x - mean) / scale, np.ones(len(ids))] @ w, -30, 30)))
            held = [i is not None and held_out(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")
