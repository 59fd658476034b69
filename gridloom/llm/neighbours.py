"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample; every vector is put into its leaf.  A query walks the tree through a
priority queue, best bin first, and visits as many leaves as a calibration found necessary: true neighbours
of queries that had no part in the fit are searched among all vectors, themselves left out, and leaf visits are
widened until the wanted recall is reached on them.  Small leaves share a block of vectors, crowded ones are cut into several, so a
crowded leaf is many tasks' work.  A block's vectors are held by its task while the queries that visit one of
its leaves are streamed past them; only a block that very many queries visit is held by more than one task.
Equal vectors are kept once with their smallest ids, which is exact: ties
go to smaller ids, so of equal vectors only the k + 1 smallest ids can be found.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows, settle

# ---------------------------------------------------------------- tree


@dataclass
class KMeansTree:
    centres: np.ndarray  # of all nodes
    radius: np.ndarray  # largest distance of a sample vector from its node's centre
    children: list[list[int]]
    leaf: list[int]  # number of a leaf, -1 for inner nodes
    leaves: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: from the root to the nearest child."""
        out = np.zeros(len(x), dtype=np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            near = ((c * c).sum(axis=1) - 2 * x[rows] @ c.T).argmin(axis=1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def best_bins(self, queries: np.ndarray, visits: int) -> list[list[int]]:
        """Leaves in the order of a best-bin-first walk by each query; a bin's promise is its centre's inner product with the query."""
        out = []
        for promise in (-(queries @ self.centres.T)).tolist():
            queue, found = [(0.0, 0)], []
            while queue and len(found) < visits:
                node = heapq.heappop(queue)[1]
                if not self.children[node]:
                    found.append(self.leaf[node])
                    continue
                for child in self.children[node]:
                    heapq.heappush(queue, (promise[child], child))
            out.append(found)
        return out


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Labels of Lloyd's algorithm from a spread start."""
    centres = [x[rng.integers(len(x))]]
    gap = np.full(len(x), np.inf)
    for _ in range(k - 1):
        gap = np.minimum(gap, ((x - centres[-1]) ** 2).sum(axis=1))
        total = gap.sum()
        if total <= 0:
            break
        centres.append(x[rng.choice(len(x), p=gap / total)])
    c = np.array(centres)
    label = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        new = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        if (new == label).all() and _:
            break
        label = new
        for i in range(len(c)):
            if (label == i).any():
                c[i] = x[label == i].mean(axis=0)
    return label


def fit_tree(sample: np.ndarray, leaves: int, branching: int = 8, seed: int = 3) -> KMeansTree:
    """Splits the largest node again and again until there are about so many leaves."""
    rng = np.random.default_rng(seed)
    centres, radius, children, members = [], [], [], []

    def add(rows: np.ndarray) -> int:
        x = sample[rows]
        centres.append(x.mean(axis=0) if len(x) else np.zeros(sample.shape[1]))
        radius.append(float(np.sqrt(((x - centres[-1]) ** 2).sum(axis=1).max())) if len(x) else 0.0)
        children.append([])
        members.append(rows)
        return len(centres) - 1

    queue, count = [(-len(sample), add(np.arange(len(sample))))], 1
    while queue and count < leaves:
        _, node = heapq.heappop(queue)
        rows = members[node]
        if len(rows) < 2:
            continue
        label = kmeans(sample[rows], min(branching, leaves - count + 1, len(rows)), rng)
        parts = [rows[label == i] for i in np.unique(label)]
        if len(parts) < 2:
            continue
        for part in parts:
            kid = add(part)
            children[node].append(kid)
            heapq.heappush(queue, (-len(part), kid))
        count += len(parts) - 1
    leaf, n = [], 0
    for kids in children:
        leaf.append(-1 if kids else n)
        n += not kids
    return KMeansTree(np.array(centres), np.array(radius), children, leaf, n)


# ---------------------------------------------------------------- search



def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): vectors of doubles that take part: none null, zero, or with null or non-finite components."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = "v IS NOT NULL AND vec_id IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x != 0)"
    return v.where(fine)


def exact_score(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product, correctly rounded, whatever the order of the components."""
    return math.fsum((a * b).tolist())


def _matrix(raws: list[bytes], width: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled up with zeros."""
    if all(len(r) == 8 * width for r in raws):
        return np.frombuffer(b"".join(raws), dtype=float).reshape(-1, width)
    out = np.zeros((len(raws), width))
    for row, r in zip(out, raws):
        row[: len(r) // 8] = np.frombuffer(r, dtype=float)
    return out


def _with_bytes(rows: DataFrame) -> DataFrame:
    """``v`` as bytes, zeros at its end left out, so that a vector is the same however it is filled up."""

    def run(batches):
        for b in batches:
            yield {"vec_id": b["vec_id"], "raw": [np.trim_zeros(np.array(v, dtype=float) + 0.0, "b").tobytes() for v in b["v"]]}

    return map_rows(rows, run, "vec_id long, raw binary")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 8192, leaf_size: int = 400, recall: float = 0.97, trials: int = 128, block: int = 4000, stream: int = 200_000) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with all other vectors.

    Queries are the rows whose id is divisible by ``every``.  The tree is fitted on at most ``sample``
    vectors and has at most a quarter as many leaves; every vector is indexed.  Repeated rows of one id and vector count once; one id with several
    vectors keeps each.  Null, zero and non-finite vectors take no part; an empty table gives no rows; fewer
    candidates than k give as many rows.  Shorter vectors count as filled up with zeros, so vectors of any
    length are candidates of each other.

    A task holds ``block`` vectors and streams up to ``stream`` queries; the driver holds the sample, the tree
    and a few numbers for each leaf.
    """
    spark = vectors.sparkSession
    usable = settle(_with_bytes(_usable(vectors, id_col, vec_col)).distinct())
    out_schema = "query_id long, rank int, vec_id long, score double"
    # equal vectors once, each with its k + 1 smallest ids
    ranked = usable.withColumn("r", F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    unique = ranked.groupBy("raw").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    unique = settle(unique.select(F.col("ids")[0].alias("key"), "ids", "raw"))
    n, longest = unique.agg(F.count("*"), F.max(F.octet_length("raw"))).first()
    if not n:
        return spark.createDataFrame([], out_schema)
    width = longest // 8
    # the first by hash are tried, those after them fit the tree
    asked = min(trials, n // 4)
    chosen = unique.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(asked + sample).select("key", "raw").collect()
    matrix = _matrix([bytes(r["raw"]) for r in chosen], width)
    trial, matrix = matrix[:asked], matrix[asked:]
    tree = spark.sparkContext.broadcast(fit_tree(matrix, int(max(1, min(len(matrix) // 4, n // leaf_size)))))  # bounded by the sample

    def index(batches):
        for b in batches:
            yield {"key": b["key"], "ids": b["ids"], "raw": b["raw"], "leaf": tree.value.assign(_matrix(b["raw"], width))}

    indexed = settle(map_rows(unique, index, "key long, ids array<long>, raw binary, leaf int"))
    visits = calibrate(indexed, [r["key"] for r in chosen[:asked]], trial, tree, k, recall, width)

    counts = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a row for each leaf
    group, parts, room = {}, {}, 0
    for leaf in range(tree.value.leaves):  # small leaves share a block, crowded ones are cut into several
        size = counts.get(leaf, 0)
        if not parts or size > room:
            parts[len(parts)] = max(1, -(-size // block))
            room = block if size <= block else size
        group[leaf] = len(parts) - 1
        room -= size
    held = spark.sparkContext.broadcast((matrix, tree.value.assign(matrix)))  # bounded by sample

    def walk(batches):
        known, known_leaf = held.value
        for b in batches:
            out = {"raw": [], "group": [], "leaves": [], "floor": []}
            queries = _matrix(b["raw"], width)
            near_all = queries @ known.T
            for raw, near, bins in zip(b["raw"], near_all, tree.value.best_bins(queries, visits)):
                # sample vectors in the visited leaves give a floor below which nothing can be found
                near = near[np.isin(known_leaf, bins)]
                floor = float(np.partition(near, len(near) - k - 1)[len(near) - k - 1]) if len(near) > k else -math.inf
                by_group: dict = {}
                for leaf in bins:
                    by_group.setdefault(group[leaf], []).append(leaf)
                for g, leaves in by_group.items():
                    out["raw"].append(raw)
                    out["group"].append(g)
                    out["leaves"].append(leaves)
                    out["floor"].append(floor)
            yield out

    asking = usable.where(F.col("vec_id") % every == 0)
    walked = settle(map_rows(asking.select("raw").distinct(), walk, "raw binary, group int, leaves array<int>, floor double"))
    streams = {r["group"]: -(-r["count"] // stream) for r in walked.groupBy("group").count().collect()}  # a row for each block
    shape = "leaf int, group int, parts int, streams int"
    place = F.broadcast(spark.createDataFrame([(leaf, g, parts[g], streams.get(g, 0)) for leaf, g in group.items()], shape))
    cuts = F.broadcast(spark.createDataFrame([(g, p, streams.get(g, 0)) for g, p in parts.items()], "group int, parts int, streams int"))
    none = F.lit(None)
    to = F.explode(F.sequence(F.lit(0), F.col("streams") - 1))
    by_block = indexed.join(place.where("streams > 0"), "leaf").select("group", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), to.alias("ask"), F.lit(0).alias("side"), "raw", "key", "leaf", none.cast("array<int>").alias("leaves"), none.cast("double").alias("floor"))
    by_query = walked.join(cuts, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("raw"), F.col("streams")).cast("int").alias("ask"), F.lit(1).alias("side"), "raw", none.cast("long").alias("key"), none.cast("int").alias("leaf"), "leaves", "floor")
    met = by_block.unionByName(by_query).repartition("group", "part", "ask").sortWithinPartitions("group", "part", "ask", "side")
    names = ["query", "key", "score"]

    def compare(batches):
        now, raws, keys, leaves, x, at = None, [], [], [], None, None
        spots = np.zeros(0, int)
        for b in batches:
            out: dict = {n: [] for n in names}
            i, rows = 0, len(b["raw"])
            while i < rows:
                spot = (b["group"][i], b["part"][i], b["ask"][i])
                if spot != now:
                    now, raws, keys, leaves, x = spot, [], [], [], None
                side, j = b["side"][i], i
                while j < rows and b["side"][j] == side and (b["group"][j], b["part"][j], b["ask"][j]) == spot and (not side or j - i < 256):
                    j += 1
                if not side:
                    raws += b["raw"][i:j]
                    keys += b["key"][i:j]
                    leaves += b["leaf"][i:j]
                elif keys:
                    if x is None:
                        x = _matrix(raws, width)
                        spots, at = np.unique(np.array(leaves), return_inverse=True)
                    q = _matrix(b["raw"][i:j], width)
                    floor = np.array(b["floor"][i:j])
                    keep = min(k + 1, len(x))
                    visited = np.array([np.isin(spots, v) for v in b["leaves"][i:j]])
                    s = np.where(visited[:, at], q @ x.T, -np.inf)
                    edge = np.maximum(np.partition(s, len(x) - keep, axis=1)[:, len(x) - keep], floor)
                    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))
                    for a, c in zip(*(z.tolist() for z in np.nonzero((s >= (edge - slack)[:, None]) & np.isfinite(s)))):
                        out["query"].append(b["raw"][i + a])
                        out["key"].append(keys[c])
                        out["score"].append(exact_score(q[a], x[c]))
                i = j
            yield out

    close = map_rows(met, compare, "query binary, key long, score double")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    best = close.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("query", "key", "score")
    # a class of equal vectors stands for its smallest ids; k + 1 of them suffice, as only the query itself may go
    spread = best.join(indexed.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    spread = spread.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("query", "score", "vec_id")
    named = asking.select(F.col("vec_id").alias("query_id"), F.col("raw").alias("query")).join(spread, "query").where(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def calibrate(indexed: DataFrame, keys: list[int], trial: np.ndarray, tree, k: int, recall: float, width: int) -> int:
    """Leaf visits, widened until the trial queries' true neighbours, found by brute force without the queries themselves, are reached in the wanted share."""
    spark, leaves = indexed.sparkSession, tree.value.leaves
    if not len(trial):
        return leaves
    asked = spark.sparkContext.broadcast((np.array(keys), trial))

    def brute(batches):
        own, queries = asked.value
        held_s = [[] for _ in queries]
        for b in batches:
            s = queries @ _matrix(b["raw"], width).T
            s[own[:, None] == np.array(b["key"])[None, :]] = -np.inf
            for i, row in enumerate(s):
                top = np.argpartition(-row, min(k, len(row) - 1))[:k]
                held_s[i] = sorted([*held_s[i], *((float(row[j]), int(b["leaf"][j])) for j in top if row[j] > -np.inf)], reverse=True)[:k]
        rows = [(i, s, leaf) for i, h in enumerate(held_s) for s, leaf in h]
        yield {"q": [r[0] for r in rows], "score": [r[1] for r in rows], "leaf": [r[2] for r in rows]}

    near = map_rows(indexed.select("raw", "leaf", "key"), brute, "q int, score double, leaf int")
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("r") <= k)
    rows = ranked.select("q", "leaf").collect()  # trials times k
    place = [{leaf: i for i, leaf in enumerate(bins)} for bins in tree.value.best_bins(trial, leaves)]
    steps = np.sort([place[r["q"]][r["leaf"]] for r in rows])
    return int(steps[min(len(steps) - 1, math.ceil(recall * len(steps)))]) + 1 if len(steps) else leaves
