"""Quality classifier: expectation-maximisation over heuristic labellers, then hashed linear scorers.

Labellers vote good, bad or nothing on every document, in the JVM. Their votes are counted by
pattern over all documents (3 ** labellers rows at most), which is all that the estimation needs:
each labeller's accuracy given the unknown label, and every pattern's posterior. A bounded sample
of documents with posterior labels trains a logistic regression over hashed words, on the driver;
all documents are scored. Toxicity is learned from the labels table: a second scorer, over hashed
words and beginnings of words, trains on a bounded sample of the labelled documents of all languages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import arrays as A
from seriesforge.llm.common import SPACE, runs
from seriesforge.llm.quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)

#: Name, and SQL over n_words, word_chars, n_symbols, n_stop, n_lines, n_same: 1 good, 0 bad, null no vote.
LABELLERS = (
    ("symbols", "CASE WHEN n_words = 0 OR n_symbols > 0.25 * n_words THEN 0 WHEN n_symbols < 0.05 * n_words THEN 1 END"),
    ("stop_words", "CASE WHEN n_stop < 0.02 * n_words THEN 0 WHEN n_stop > 0.08 * n_words THEN 1 END"),
    ("word_length", "CASE WHEN word_chars > 12 * n_words OR word_chars < 2.5 * n_words THEN 0 WHEN n_words > 0 THEN 1 END"),
    ("lines", "CASE WHEN 3 * n_same > n_lines THEN 0 WHEN n_same = 0 AND n_lines > 1 THEN 1 END"),
    ("length", "CASE WHEN n_words < 5 THEN 0 WHEN n_words > 100 THEN 1 END"),
    ("variety", "CASE WHEN n_words > 20 AND 4 * n_distinct < n_words THEN 0 WHEN 3 * n_distinct > n_words THEN 1 END"),
)


@dataclass(frozen=True)
class Training:
    """sample: documents that train the scorer, at most. bits: log2 of its weights.

    toxic_sample, clean_sample: documents labelled so that train the toxicity scorer, at most.
    toxic_steps: batches it trains on, at least; toxic_share: share of the weight that toxic ones have, at least.
    """

    sample: int = 4000
    bits: int = 15
    epochs: int = 12
    rate: float = 0.5
    decay: float = 1e-5
    threshold: float = 0.5
    toxic_sample: int = 2000
    clean_sample: int = 4000
    toxic_bits: int = 18
    toxic_steps: int = 1000
    toxic_rate: float = 0.3
    toxic_share: float = 0.4


def votes(docs: DataFrame) -> DataFrame:
    """doc_id and the pattern: one digit per labeller, 0 bad, 1 good, 2 no vote; a row for each row of docs, null texts as
    empty ones."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        "doc_id", text.alias("t"), F.array_remove(F.split(text, SPACE), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x != "").alias("lines"),
    ).select(
        "doc_id", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.expr(f"size(filter(w, x -> x IN ({_STOP})))").alias("n_stop"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_same"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
    )
    return cut.select("doc_id", F.concat(*[F.coalesce(F.expr(sql).cast("string"), F.lit("2")) for _, sql in LABELLERS]).alias("pattern"))


def estimate(patterns: list[str], counts: list[int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern; accuracies [labeller, label]; the prior of good.

    Starts from majority votes; smoothed by one vote. Labellers are taken as independent given the label.
    """
    v = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), -1)
    n = np.array(counts, float)
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    post = np.where(bad * 2 >= good, 0.2, 0.9)
    accuracy, prior = np.full((v.shape[1], 2), 0.7), 0.5
    for _ in range(rounds):
        prior = (n @ post + 1) / (n.sum() + 2)
        for j in range(v.shape[1]):
            for label, weight in ((1, post), (0, 1 - post)):
                cast = n * weight * (v[:, j] != 2)
                accuracy[j, label] = (cast[v[:, j] == label].sum() + 1) / (cast.sum() + 2)
        log = np.full((len(v), 2), 0.0) + np.log([1 - prior, prior])
        for j in range(v.shape[1]):
            for label in (0, 1):
                p = np.where(v[:, j] == label, accuracy[j, label], 1 - accuracy[j, label])
                log[:, label] += np.where(v[:, j] == 2, 0.0, np.log(p))
        post = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
    return post, accuracy, prior


def features(data: bytes, start: np.ndarray, h: np.ndarray, edge: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and value of hashed word counts (square roots, over the norm)."""
    doc = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    key = doc.astype(np.int64) << bits | (h >> A.U64(64 - bits)).astype(np.int64)
    key, n = np.unique(key, return_counts=True)
    doc, place = key >> bits, key & ((1 << bits) - 1)
    value = np.sqrt(n)
    norm = np.sqrt(np.bincount(doc, n, len(edge) - 1))
    return doc, place, value / norm[doc]


def _batch(texts: list[str | None], bits: int):
    raw = [(x or "").encode() for x in texts]
    data = b"\n".join(raw)
    start, _, h = A.words(data, lower=True)
    return features(data, start, h, np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in raw])), bits)


def train(texts: list[str | None], target: np.ndarray, spec: Training) -> np.ndarray:
    """Weights of a logistic regression, the last one the bias; by batches in a fixed order."""
    w = np.zeros((1 << spec.bits) + 1)
    step = 64
    parts = [(_batch(texts[i : i + step], spec.bits), target[i : i + step]) for i in range(0, len(texts), step)]
    for epoch in range(spec.epochs):
        for (doc, place, value), y in parts:
            z = np.bincount(doc, w[place] * value, len(y)) + w[-1]
            slope = (1 / (1 + np.exp(-z)) - y) * spec.rate / (1 + epoch / 4)
            np.subtract.at(w, place, slope[doc] * value)
            w[-1] -= slope.mean()
            w[:-1] *= 1 - spec.decay
    return w


#: Bytes of a word's beginning, with the blank before it, that are features of the toxicity scorer.
PREFIXES = (4, 5, 6, 7, 8)


def subwords(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document and place of each word and each beginning of a word, lower-cased; and how many each text has."""
    raw = [b" " + (x or "").lower().encode() + b" " for x in texts]
    joined = b"".join(raw)
    data = np.frombuffer(joined, np.uint8)
    of = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    values = np.where(space, 32, data).astype(A.U64) + A.U64(1)
    gap = np.flatnonzero(space)
    blank = gap[:-1][np.diff(gap) > 1]
    stop = gap[1:][np.diff(gap) > 1]
    start, _, h = A.words(joined)
    docs, hashes = [of[start]], [h]
    for k in PREFIXES:
        at = blank[blank + k <= stop]
        if len(at):
            docs.append(of[at])
            hashes.append(A.mix(A.grams(values, k)[at]))
    doc = np.concatenate(docs)
    return doc, (np.concatenate(hashes) >> A.U64(64 - bits)).astype(np.int64), np.bincount(doc, minlength=len(raw))


def train_toxicity(texts: list[str | None], target: np.ndarray, spec: Training) -> np.ndarray:
    """Weights of a logistic regression over subwords, the last one the bias; steps by AdaGrad, in a fixed order."""
    bits, step = spec.toxic_bits, 64
    parts = []
    for i in range(0, len(texts), step):
        doc, place, total = subwords(texts[i : i + step], bits)
        key, n = np.unique(doc << bits | place, return_counts=True)
        doc, place = (key >> bits).astype(np.int32), (key & ((1 << bits) - 1)).astype(np.int32)
        parts.append((doc, place, (n / np.sqrt(total[doc])).astype(np.float32), target[i : i + step]))
    w, seen = np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, 1e-3)
    w[-1] = -2.0
    share = target.mean()
    weight = max(1.0, spec.toxic_share * (1 - share) / ((1 - spec.toxic_share) * share))
    for _ in range(max(4, -(-spec.toxic_steps // len(parts)))):
        for doc, place, value, y in parts:
            z = np.bincount(doc, w[place] * value, len(y)) + w[-1]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * np.where(y > 0, weight, 1.0) / len(y)
            at, which = np.unique(place, return_inverse=True)
            slope = np.append(np.bincount(which, error[doc] * value, len(at)), error.sum())
            at = np.append(at, len(w) - 1)
            seen[at] += slope * slope
            w[at] -= spec.toxic_rate * slope / np.sqrt(seen[at])
    return w


def toxicity(texts: list[str | None], w: np.ndarray, bits: int) -> np.ndarray:
    doc, place, total = subwords(texts, bits)
    z = np.bincount(doc, w[place], len(texts)) / np.sqrt(np.maximum(total, 1)) + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn_toxicity(docs: DataFrame, labels: DataFrame, spec: Training) -> np.ndarray | None:
    """The toxicity scorer's weights, or None if the labelled documents are not of both kinds.

    Its sample is taken by a hash of doc_id, of toxic and of other documents; that is all that reaches
    the driver.
    """
    told = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    # Only labels of documents that are there; doc_ids travel, not texts.
    told = told.join(docs.select("doc_id"), "doc_id", "left_semi")
    parts = [told.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
             for kind, most in ((1, spec.toxic_sample), (0, spec.clean_sample))]
    if not all(parts):
        return None
    picked = docs.sparkSession.createDataFrame([tuple(r) for p in parts for r in p], "doc_id long, toxic int")
    sample = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return train_toxicity([r["text"] for r in sample], np.array([r["toxic"] for r in sample], float), spec)


SCORED = "doc_id long, pattern string, score double, toxicity double"


def _score(batches: Iterator[pa.RecordBatch], w: np.ndarray, bits: int, toxic_w: np.ndarray | None, toxic_bits: int) -> Iterator[pa.RecordBatch]:
    A.calm_malloc()
    for batch in batches:
        texts = batch.column("text")
        for low, high in runs(texts, 2 << 20):
            own = batch.slice(low, high - low)
            part = own.column("text").to_pylist()
            doc, place, value = _batch(part, bits)
            z = np.bincount(doc, w[place] * value, high - low) + w[-1]
            toxic = pa.nulls(len(part), pa.float64()) if toxic_w is None else pa.array(toxicity(part, toxic_w, toxic_bits))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("pattern"), pa.array(1 / (1 + np.exp(-z))), toxic],
                                             [c.split()[0] for c in SCORED.split(", ")])


def classify(docs: DataFrame, spec: Training = Training(), labels: DataFrame | None = None) -> DataFrame:
    """doc_id, pattern, posterior, score, toxicity and kept of every document.

    posterior: of good, by the labellers' votes; score: the trained scorer's. toxicity:
    by the scorer that learns from labels (doc_id, toxic), null without labels of both kinds. kept: the
    mean of posterior and score is above the threshold and toxicity is not. Null and empty
    texts get the votes of a text without words. Repeated rows stay; an empty table gives none.
    Extra columns don't matter. The training sample (spec.sample rows at most, by a hash of
    doc_id and text), that of toxicity (spec.toxic_sample + spec.clean_sample at most) and the pattern counts are
    all that reaches the driver.
    """
    spark = docs.sparkSession
    docs = docs.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    voted = votes(docs)
    found = voted.groupBy("pattern").count().orderBy("pattern").collect()  # 3 ** labellers rows at most
    if not found:
        return spark.createDataFrame([], "doc_id long, pattern string, posterior double, score double, toxicity double, kept boolean")
    patterns = [r["pattern"] for r in found]
    posterior, _, _ = estimate(patterns, [r["count"] for r in found])
    of = dict(zip(patterns, posterior.tolist(), strict=True))
    sample = _sampled(docs, sum(r["count"] for r in found), spec.sample)
    w = train([r["text"] for r in sample], np.array([of.get(r["pattern"], 0.5) for r in sample]), spec)
    toxic_w = None if labels is None else learn_toxicity(docs, labels, spec)
    shared = spark.sparkContext.broadcast((w, toxic_w))  # 2 ** bits and 2 ** toxic_bits weights
    bits, toxic_bits = spec.bits, spec.toxic_bits
    scored = _with_votes(docs).mapInArrow(lambda it: _score(it, shared.value[0], bits, shared.value[1], toxic_bits), SCORED)
    table = F.create_map(*[x for p, v in of.items() for x in (F.lit(p), F.lit(float(v)))])
    return scored.withColumn("posterior", table[F.col("pattern")]).select(
        "doc_id", "pattern", "posterior", "score", "toxicity",
        ((F.col("posterior") + F.col("score") > 2 * spec.threshold) & (F.coalesce("toxicity", F.lit(0.0)) <= spec.threshold)).alias("kept"),
    )


def _sampled(docs: DataFrame, rows: int, most: int) -> list:
    """At most so many rows with their votes: those of the least hashes of doc_id and text.

    A threshold on the hash, set for half as many rows more, is applied in the scan, so that only
    about so many texts are sorted or sent. Rows of one doc_id count each.
    """
    share = min(1.0, 1.5 * (most + 50) / max(1, rows))
    least = min(2**63 - 1, int(share * 2**64) - 2**63)
    hashed = docs.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "text")).filter(F.col("h") <= least).drop("h")
    rank = F.xxhash64(F.lit(7), "doc_id", "text")
    return _with_votes(hashed).orderBy(rank, "doc_id", "text").limit(most).collect()


def _with_votes(docs: DataFrame) -> DataFrame:
    """docs with the votes beside the text: the same projection, without a join."""
    again = docs.select("doc_id", "text")
    return votes(again.select(F.struct("doc_id", F.col("text").alias("body")).alias("doc_id"), "text")).select(
        F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.body").alias("text"), "pattern"
    )
