"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

Grades 0..K-1 share one weight vector over hashed features; ordered thresholds cut the score:
P(grade <= k) = logistic(threshold_k - w.x).  From them come the expected grade and the tail probability of
each grade, by which documents are chosen.  Training takes all rated documents, in shards of bounded size whose
models are averaged; scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, map_rows, settle, whole_texts

BUCKETS = 1 << 18


class Features:
    """A text's hashed features: its words, the punctuation that they end in, their case, and how often words repeat."""

    def __init__(self, buckets: int = BUCKETS, remember: int = 150_000):
        self.buckets, self.remember, self.known = buckets, remember, {}

    def _hash(self, name: str) -> int:
        return zlib.crc32(name.encode()) % self.buckets

    def of_word(self, word: str) -> tuple[int, ...]:
        core = word.strip("".join(c for c in set(word) if not c.isalnum())) if not word.isalnum() else word
        tail = word[len(word.rstrip("".join(c for c in set(word) if not c.isalnum()))) :] if not word.isalnum() else ""
        found = [self._hash("w:" + core.lower())] if core else []
        if tail and len(tail) < 8:
            found.append(self._hash("t:" + tail))
        if len(core) > 3 and core.isupper():
            found.append(self._hash("s:upper"))
        return tuple(found)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct feature ids and their values 1 + log(count)."""
        if len(self.known) > self.remember:
            self.known.clear()
        known, words = self.known, Counter(text.split())
        total: dict[int, int] = {}
        n = 0
        for word, count in words.items():
            n += count
            features = known.get(word)
            if features is None:
                features = known[word] = self.of_word(word)
            for f in features:
                total[f] = total.get(f, 0) + count
        total[self._hash(f"r:{min(9, int(10 * len(words) / n)) if n else 'none'}")] = 1
        total[self._hash(f"l:{min(12, n.bit_length())}")] = 1
        ids = np.fromiter(total.keys(), dtype=np.int32, count=len(total))
        return ids, 1 + np.log(np.fromiter(total.values(), dtype=np.float64, count=len(total)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades
    reject_below: float = 0.0  # of the expected grade

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k = 1 and above."""
        return [1 / (1 + np.exp(np.clip(t - score, -30, 30))) for t in self.thresholds]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, buckets: int = BUCKETS, steps: int = 120, rate: float = 0.05, l2: float = 20.0, balance: bool = True) -> OrdinalModel:
    """Maximum likelihood by Adam over all rows at once, rarer grades weighted up to the square root of balance.

    A step goes through the rows two thousand at a time, so that beside the rows themselves little is held.
    """
    if not rows:
        return OrdinalModel(np.zeros(buckets), np.linspace(-1, 1, grades - 1) - 4)
    length = np.array([len(f) for f, _, _ in rows])
    offset = np.concatenate(([0], np.cumsum(length)))
    seen = np.zeros(buckets, dtype=bool)
    for f, _, _ in rows:
        seen[f] = True
    ids = np.flatnonzero(seen)
    n = len(ids)
    number = np.zeros(buckets, dtype=np.int32)
    number[ids] = np.arange(n)
    place, values = np.empty(offset[-1], dtype=np.int32), np.empty(offset[-1], dtype=np.float32 if rows[0][1].dtype == np.float32 else np.float64)
    for k, (f, v, _) in enumerate(rows):
        place[offset[k] : offset[k + 1]], values[offset[k] : offset[k + 1]] = number[f], v
    y = np.array([g for _, _, g in rows])
    count = np.bincount(y, minlength=grades)
    weight = np.sqrt(len(y) / (grades * np.maximum(count, 1)))[y] if balance else np.ones(len(y))
    weight /= weight.sum()
    cut = np.linspace(-1.0, 1.0, grades - 1)
    params = np.concatenate((np.zeros(n), [cut[0]], np.log(np.diff(cut))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    at_once = range(0, len(rows), 2048)
    for step in range(1, steps + 1):
        w = params[:n]
        cut = np.cumsum(np.concatenate((params[n : n + 1], np.exp(params[n + 1 :]))))
        edge = np.concatenate(([-np.inf], cut, [np.inf]))
        g_w, g_cut = l2 * w / len(rows), np.zeros(grades + 1)
        for i in at_once:
            j = min(i + 2048, len(rows))
            x, at = values[offset[i] : offset[j]].astype(float), place[offset[i] : offset[j]]
            score = np.add.reduceat(x * w[at], offset[i:j] - offset[i])
            high, low = sigmoid(edge[y[i:j] + 1] - score), sigmoid(edge[y[i:j]] - score)
            p = np.maximum(high - low, 1e-9)
            d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
            np.add.at(g_cut, y[i:j] + 1, -weight[i:j] * d_high)
            np.add.at(g_cut, y[i:j], weight[i:j] * d_low)
            d_score = weight[i:j] * (d_high - d_low)  # of the negative log-likelihood
            g_w += np.bincount(at, x * np.repeat(d_score, length[i:j]), minlength=n)
        later = np.cumsum(g_cut[1:-1][::-1])[::-1]
        grad = np.concatenate((g_w, later[:1], later[1:] * np.exp(params[n + 1 :])))
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    full = np.zeros(buckets)
    full[ids] = params[:n]
    return OrdinalModel(full, np.cumsum(np.concatenate((params[n : n + 1], np.exp(params[n + 1 :])))))


def features(buckets: int = BUCKETS) -> Features:
    return kept(("features", buckets), lambda: Features(buckets))


RATED = "doc_id long, ids binary, vals binary, grade int"


def likely(docs: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``, and some others: ids are looked up by hash in a bitmap of at most 2 MB."""
    spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << bits))
    maps = ids.select(F.floor(spot / 32768).alias("_cell"), (spot % 32768).alias("_bit")).groupBy("_cell").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    found = docs.withColumn("_cell", F.floor(spot / 32768)).withColumn("_bit", (spot % 32768).cast("int")).join(F.broadcast(maps), "_cell")
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return found.where(F.getbit(byte, F.col("_bit") % 8) == 1).select(*docs.columns)


def rated_rows(docs: DataFrame, ratings: DataFrame, size: int) -> DataFrame:
    """Features and grades of all rated documents, dealt by their ids into shards of about ``size``: a partition, in order of ids, is a shard.

    ``ratings``: (doc_id, grade); rows with a null in either and documents without a rating are left out.  Repeated
    rows of a document become one, with the least of their texts.
    """
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").isNotNull()).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    shards = max(1, -(-rated.count() // size))
    texts = likely(whole_texts(docs), rated).join(rated, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))

    def extract(batches):
        for b in batches:
            found = [features()(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "ids": [f.tobytes() for f, _ in found], "vals": [v.astype("f4").tobytes() for _, v in found], "grade": b["grade"]}

    return settle(map_rows(texts.select("doc_id", "text", "grade"), extract, RATED).repartition(shards, "doc_id").sortWithinPartitions("doc_id"))


def shard_rows(batches) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The rows of a shard as features, values and grades."""
    return [(np.frombuffer(f, np.int32), np.frombuffer(v, "f4"), g) for b in batches for f, v, g in zip(b["ids"], b["vals"], b["grade"])]


def held_out(rows: list) -> tuple[list, list]:
    """Every fifth row, which the trial does not see, and the others."""
    return [r for i, r in enumerate(rows) if i % 5 == 4], [r for i, r in enumerate(rows) if i % 5 != 4]


#: Sums over shards are of whole numbers of this size, so that they do not depend on their order.
UNIT = 2.0**-32


def fit_shards(rated: DataFrame, grades: int, buckets: int = BUCKETS) -> tuple[OrdinalModel, OrdinalModel]:
    """The models of all rows but those held out, and of all rows: each shard's by maximum likelihood, and then their means.

    A feature's weight is the mean over the shards that have it, each counting by its rows with it, so that one that is
    rare loses nothing; a threshold's is the mean by rows.  What comes back is bounded by the number of buckets.
    """

    def each(batches):
        rows = shard_rows(batches)
        for all_rows, part in enumerate((held_out(rows)[1], rows)) if rows else ():
            m = fit(part, grades, buckets)
            n = np.bincount(np.concatenate([f for f, _, _ in part]), minlength=buckets)
            ids = np.flatnonzero(n)
            seen = np.concatenate((n[ids], np.full(grades - 1, len(part))))
            value = np.concatenate((m.weights[ids], m.thresholds))
            yield {"all_rows": np.full(len(seen), all_rows), "id": np.concatenate((ids, buckets + np.arange(grades - 1))), "total": np.rint(value * seen / UNIT).astype("i8"), "seen": seen}

    parts = map_rows(rated, each, "all_rows int, id int, total long, seen long")
    sums = parts.groupBy("all_rows", "id").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen")).toArrow()
    which, ids, total, seen = (sums.column(c).to_numpy() for c in ("all_rows", "id", "total", "seen"))
    models = []
    for k in (0, 1):
        if not (which == k).any():
            models.append(fit([], grades, buckets))
            continue
        mean = np.zeros(buckets + grades - 1)
        mean[ids[which == k]] = total[which == k] * UNIT / seen[which == k]
        models.append(OrdinalModel(mean[:buckets], mean[buckets:]))
    return models[0], models[1]


SCORES = "doc_id long, score double, expected_grade double, tail array<double>"


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score, expected grade and tail probabilities of every whole text.

    Null texts are empty; an empty text is scored by its length features alone; repeated rows repeat; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of buckets

    def score(batches):
        m = shared.value
        of = features(len(m.weights))
        for b in batches:
            points = [float(v @ m.weights[f]) for f, v in map(of, b["text"])]
            tails = [m.tails(s) for s in points]
            yield {"doc_id": b["doc_id"], "score": points, "expected_grade": [float(sum(t)) for t in tails], "tail": [[float(x) for x in t] for t in tails]}

    return map_rows(whole_texts(docs, id_col, text_col), score, SCORES)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels: 0 toxic, 1 of low quality, 2 good; null labels are left out."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def train_classifier(docs: DataFrame, ratings: DataFrame, limit: int = 8000, grades: int = 3, good: int = 2) -> OrdinalModel:
    """Fits on all rated documents, in shards of about ``limit``, and sets the rejection threshold on a held-out fifth of each.

    All but 0.2 % of the held-out good documents are kept: the threshold lies halfway between the 0.002 quantile of their
    expected grades and the highest of the other documents below that, or at the quantile where none is below it.
    """
    rated = rated_rows(docs, ratings, limit)
    trial, model = fit_shards(rated, grades)
    shared = docs.sparkSession.sparkContext.broadcast(trial)

    def expected(batches):
        m = shared.value
        held = held_out(shard_rows(batches))[0]
        yield {"expected": [float(sum(m.tails(v @ m.weights[f]))) for f, v, _ in held], "grade": [g for _, _, g in held]}

    tried = settle(map_rows(rated, expected, "expected double, grade int"))
    keep, drop = tried.where(F.col("grade") >= good), tried.where(F.col("grade") < good)
    counts = tried.groupBy().agg(F.count_if(F.col("grade") >= good), F.count_if(F.col("grade") < good)).first()
    if all(counts):
        rank = 0.002 * (counts[0] - 1)
        at = lambda k: keep.orderBy("expected").limit(k + 1).agg(F.max("expected")).first()[0]
        a, b = at(int(rank)), at(int(np.ceil(rank)))
        low = a + (b - a) * (rank - int(rank))
        below = drop.where(F.col("expected") < low).agg(F.max("expected")).first()[0]
        model.reject_below = low if below is None else (low + below) / 2
    return model


def keep_good(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of ``docs`` whose expected grade reaches the model's threshold; the text alone goes to Python."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def expected(texts: pd.Series) -> pd.Series:
        m = shared.value
        of = features(len(m.weights))
        return pd.Series([float(sum(m.tails(v @ m.weights[f]))) for f, v in map(of, texts)], dtype=float)

    return docs.where(expected(F.coalesce(F.col("text").cast("string"), F.lit(""))) >= model.reject_below)


def selected(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, score, expected grade and tail probabilities of the documents that the model keeps."""
    kept = score_documents(docs, model).where(F.col("expected_grade") >= model.reject_below)
    return kept.select("doc_id", "score", "expected_grade", *[F.col("tail")[k].alias(f"p_at_least_{k + 1}") for k in range(len(model.thresholds))])
