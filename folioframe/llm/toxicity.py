"""Operator 2, toxicity: significant toxic passages by maximal scoring segments.

Token weights are log-odds between toxic and clean labelled texts under an informative Dirichlet
prior. Tokens are hashed to ``BUCKETS`` counters, so the model has a fixed size whatever the corpus.
A linear scan (Ruzzo and Tompa) finds all maximal scoring segments of a text; their scores are judged
by extreme-value statistics (Karlin and Altschul): with ``lam`` and ``K`` from the clean token
distribution, a segment of score S in n tokens has ``lam * S - ln(K * n)`` nats of evidence. A logistic
link, fitted on out-of-fold evidence of labelled rows, turns the evidence into a score from 0 to 1.

Counting covers all labelled training rows. Only the link is fitted on a sample:
about ``calibration_rows`` rows, those of the lowest hashes. Null and empty texts have no tokens and get the
score of no evidence; a very long text is one row of numbers in the worker. Only text, id and the label are
read, so other columns cannot clash; ids may repeat, null ids are scored but not learned from. Ids with several labels count as toxic if one label says so; without any toxic
or any clean label, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_parts, chunks, lowest_share, materialize, sliced, table
from .recompression import word_names, words

BITS = 18
BUCKETS = 1 << BITS
FOLDS = 4
CALIBRATION_ROWS = 20_000
PRIOR = 200.0
#: Evidence, in nats, from which a passage is reported.
SIGNIFICANT = 2.0

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[i for i in range(128) if not chr(i).isalnum()]] = 32


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token and the first token of each text. Tokens are runs of letters, digits and non-ASCII bytes."""
    buckets, first, total = [], np.zeros(len(offsets), np.int64), 0
    for a, b in chunks(offsets, 1 << 17):
        part = _SPACE[data[offsets[a] : offsets[b]]]
        begin, end = words(part)
        at = np.searchsorted(begin, offsets[a:b] - offsets[a])
        first[a:b] = total + at
        buckets.append((word_names(part, begin, end) >> np.uint64(64 - BITS)).astype(np.int32))
        total += len(begin)
    first[-1] = total
    return (np.concatenate(buckets) if buckets else np.zeros(0, np.int32)), first


def _text(text_col: str):
    """Lower case, closed by a separator so that no token crosses into the next text of a batch."""
    return F.concat(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("\n")).cast("binary").alias("_t")


@dataclass(frozen=True)
class Model:
    """weights: of all training folds, then with each fold left out; lam, log_k and link belong to the first."""

    weights: np.ndarray
    lam: np.ndarray
    log_k: float
    link: tuple[float, ...]


def _weights(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Token scores with a negative mean on clean text, and the lam of their clean distribution."""
    both = toxic + clean
    n = max(1.0, both.sum())
    alpha = PRIOR * both / n + 0.01
    total = alpha.sum()
    t, c = toxic + alpha, clean + alpha
    odds = np.log(t / (toxic.sum() + total - t)) - np.log(c / (clean.sum() + total - c))
    z = odds / np.sqrt(1 / t + 1 / c)
    # Odds count by how sure they are; the offset makes chance segments short.
    score = np.where(both > 0, odds * z**2 / (z**2 + 4.0), 0.0) - 0.15
    p = (clean + 0.01) / (clean + 0.01).sum()
    low, high = 1e-3, 1.0
    while (p * np.exp(np.minimum(high * score, 50))).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * score, 50))).sum() < 1 else (low, mid)
    return score.astype(np.float32), low


def best_segment(score: np.ndarray) -> float:
    """Score of the best segment, 0 if none is positive."""
    if not len(score):
        return 0.0
    sums = np.concatenate(([0.0], np.cumsum(score, dtype=np.float64)))
    return float((sums - np.minimum.accumulate(sums)).max())


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time by Ruzzo and Tompa's scan."""
    found: list[list] = []  # start, end, sum before, sum after
    link: list[int] = []  # nearest earlier segment with a smaller sum before
    total = 0.0
    for i, s in enumerate(score.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        start, end, left, right = i, i + 1, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = link[j]
            if j < 0 or found[j][3] >= right:
                found.append([start, end, left, right])
                link.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], link[j:]
    return [(a, b, r - l) for a, b, l, r in found]


def _evidence(score: np.ndarray, lam: float, log_k: float) -> tuple[float, float, list]:
    """Evidence of the best segment, of all significant ones together, and these segments."""
    chance = log_k + math.log(max(1, len(score)))
    best = lam * best_segment(score) - chance
    if best < SIGNIFICANT:
        return best, 0.0, []
    found = [(a, b, lam * s - chance) for a, b, s in maximal_segments(score) if lam * s - chance >= SIGNIFICANT]
    return best, math.log1p(sum(e for _, _, e in found)), found


def _features(best: float, all_: float, n: int) -> list[float]:
    return [1.0, max(-8.0, min(best, 60.0)) / 10, all_, math.log1p(n) / 10]


def _chance(link, x) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(a * b for a, b in zip(link, x, strict=True))))))


def fit(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model | float:
    """Model from rows (_t binary, toxic, fold 0..FOLDS-1, order); a number if only one class has rows."""
    import pyarrow as pa

    def count(batches: Iterator) -> Iterator:
        sums = np.zeros((FOLDS * 2, BUCKETS), np.int64)
        for batch in sliced(batches):
            bucket, first = _tokens(*binary_parts(batch.column("_t")))
            group = np.asarray(batch.column("fold")) * 2 + np.asarray(batch.column("toxic"))
            key = np.repeat(group, np.diff(first)).astype(np.int64) * BUCKETS + bucket
            sums += np.bincount(key, minlength=sums.size).reshape(sums.shape)
        group, bucket = np.nonzero(sums)
        for at in range(0, len(group), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array((group[s] * BUCKETS + bucket[s]).astype(np.int32)), pa.array(sums[group[s], bucket[s]])], names=["k", "n"])

    # At most 2 * FOLDS * BUCKETS counters, whatever the corpus.
    got = labelled.select("_t", "toxic", "fold").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(FOLDS * 2 * BUCKETS, np.float64)
    sums[np.asarray(got["k"])] = np.asarray(got["n"])
    sums = sums.reshape(FOLDS, 2, BUCKETS)
    rows = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not (rows.get(0) and rows.get(1)):
        return 1.0 if rows.get(1) else 0.0
    whole = sums.sum(0)
    made = [_weights(whole[1], whole[0]), *(_weights(whole[1] - s[1], whole[0] - s[0]) for s in sums)]
    weights, lam = np.stack([m[0] for m in made]), np.array([m[1] for m in made])
    shared = labelled.sparkSession.sparkContext.broadcast((weights, lam))

    def judge(batches: Iterator) -> Iterator:
        weights, lam = shared.value
        for batch in sliced(batches):
            bucket, first = _tokens(*binary_parts(batch.column("_t")))
            out = []
            for i, f in enumerate(np.asarray(batch.column("fold")).tolist()):
                score = weights[f + 1][bucket[first[i] : first[i + 1]]]
                chance = math.log(max(1, len(score)))
                out.append([float(lam[f + 1]) * s - chance for _, _, s in maximal_segments(score)] or [-chance])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("order"), pa.array(out, pa.list_(pa.float64())), pa.array(np.diff(first))], names=["toxic", "order", "nats", "n"])

    share = min(1.0, calibration_rows / sum(rows.values()))
    sample = labelled.where(lowest_share(F.col("order"), share)).select("_t", "toxic", "fold", "order")
    judged = sample.mapInArrow(judge, "toxic int, order long, nats array<double>, n long")
    # Rows of one hash are equal, so the lowest hashes are the same rows each time.
    judged = materialize(judged.orderBy("order").limit(2 * calibration_rows).withColumn("best", F.array_max("nats")), "judged")
    # The Gumbel law's location: on clean rows lam * S - ln n has mean ln K + Euler's constant.
    mean = judged.where("toxic = 0").agg(F.avg("best")).first()[0]
    log_k = 0.0 if mean is None else mean - 0.5772
    sure = F.filter(F.transform("nats", lambda e: e - F.lit(log_k)), lambda e: e >= SIGNIFICANT)
    every = F.log1p(F.aggregate(sure, F.lit(0.0), lambda s, e: s + e))
    got = judged.select("toxic", "n", "best", every.alias("every")).toPandas()  # four numbers a row
    toxic = got["toxic"].to_numpy(float)
    x = np.array([_features(b - log_k, e, int(k)) for b, e, k in zip(got["best"], got["every"], got["n"], strict=True)])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (toxic - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-7:
            break
    shared.unpersist()
    return Model(weights[:1], lam[:1], log_k, tuple(float(b) for b in beta))


def _scored(rows: DataFrame, model: Model | float, fields: list[tuple[str, str]]) -> DataFrame:
    """``rows`` (_t and other columns) with score and passages instead of _t; fields are (name, type) of the others."""
    import pyarrow as pa

    plain = (0, 0, 0, model) if isinstance(model, float) else (model.weights[0], float(model.lam[0]), model.log_k, model.link)
    shared = rows.sparkSession.sparkContext.broadcast(plain)  # of a fixed size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("nats", pa.float64())]))
    names = [n for n, _ in fields]

    def emit(batches: Iterator) -> Iterator:
        weights, lam, log_k, link = shared.value
        for batch in sliced(batches):
            scores, passages = [], []
            if isinstance(link, float):
                scores, passages = [link] * batch.num_rows, [[]] * batch.num_rows
            else:
                bucket, first = _tokens(*binary_parts(batch.column("_t")))
                values = weights[bucket]
                for i in range(batch.num_rows):
                    own = values[first[i] : first[i + 1]]
                    best, every, found = _evidence(own, lam, log_k)
                    scores.append(_chance(link, _features(best, every, len(own))))
                    passages.append([{"start": a, "end": b, "nats": e} for a, b, e in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64()), pa.array(passages, kind)], names=[*names, "score", "passages"])

    schema = ", ".join(f"`{n}` {t}" for n, t in fields)
    return rows.mapInArrow(emit, f"{schema}, score double, passages array<struct<start:long,end:long,nats:double>>")


def score_toxicity(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, score, and passages: token ranges with their evidence in nats."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_d"), _text(text_col))
    return _scored(rows, model, [("_d", kind)]).withColumnRenamed("_d", id_col)


def keep_clean(docs: DataFrame, model: Model | float, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``most``."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _text(text_col))
    out = _scored(rows, model, [("_row", docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("x")).schema["x"].dataType.simpleString())])
    return out.where(F.col("score") < most).select("_row.*")


def held_out(id_col: str = "doc_id"):
    """True for ids whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows of ``fit``: documents with a label that are not held out."""
    mod = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).cast("int")
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.where(mod != 0)
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", _text("text"))
    # Labels grow with the corpus, so this is a shuffle at every size.
    return rows.join(own.hint("merge"), "doc_id").select("_t", "toxic", (mod - 1).alias("fold"), F.xxhash64("doc_id", "_t").alias("order"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: score of every document, with labels learned from the other four fifths of ids."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_rows(docs, table(spark, sf_dir, "labels")))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
