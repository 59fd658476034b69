"""Exact Jaccard join of word n-gram sets by a partitioned universe and the pigeonhole principle.

Sets within the threshold differ in at most H elements, H following from their sizes.  Sizes fall into bands;
for each band the universe of shingles is hashed into segments.  A segment with allowance 0 must agree, one
with allowance 1 may differ in one element, which one-deletion neighbourhoods find; with allowances of H + 1
in all (a segment of allowance a counting a + 1) at least one segment of two linked sets agrees.  How many
segments get allowance 1 follows from a cost model of rows emitted against candidates expected.  Each set
emits the shortest prefix of segments whose allowances make up what its own H needs; empty segments say
nothing and count nothing, so a few more segments are held ready.  In the shorter prefix of two linked sets
some segment that is not empty then agrees.  A set that runs out of segments goes on with all of them under
another hash; if only one of two sets does, the other one's prefix was long enough.

Candidates are verified exactly.  A bucket of sets is first joined as a star around its smallest id; buckets
that the links so found leave in several components are compared pair by pair in blocks of bounded size,
with a parity sketch that only discards pairs which differ too much, and survivors are verified as well.

That finds the components.  Every link lies in one of them, so links are counted (or listed) by comparing all
pairs of a component's different sets exactly, in pairs of blocks of bounded size, each pair once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, map_rows, settle, whole_texts
from .graph import components

_U = np.uint64
MOST_LEVELS = 24
#: Classes of equal sets that are broadcast; 40 bytes each.
LARGE_CLASSES = 200_000


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Shingles:
    """A text's set of word n-grams as sorted 64-bit hashes.

    ASCII letters are lower-cased and words are what ASCII white space separates, on the UTF-8 bytes.
    """

    def __init__(self, words: int, remember: int = 100_000):
        self.words, self.remember, self.known = words, remember, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        if len(self.known) > self.remember:
            self.known.clear()
        known, words = self.known, text.encode().lower().split()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=_U, count=len(words))
        size = min(self.words, len(h))
        if not size:
            return h
        with np.errstate(over="ignore"):
            s = np.full(len(h) - size + 1, size, dtype=_U)
            for k in range(size):
                s = s * _U(0x9FB21C651E98DF25) + h[k : len(h) - size + 1 + k]
        return np.unique(mix(s))


@dataclass(frozen=True)
class Scheme:
    """Bands, segments and allowances for a threshold of numerator / denominator."""

    numerator: int
    denominator: int
    documents: int
    width: int = 3  # links that a band spans
    related: float = 1e-3  # share of the documents that have something to do with one
    overlap: float = 0.5  # of their elements

    def most(self, size: int) -> int:
        """The largest set that a set of this size can link with."""
        return size * self.denominator // self.numerator

    def differences(self, total: int) -> int:
        """The most elements in which linked sets of this total size differ."""
        return (self.denominator - self.numerator) * total // (self.denominator + self.numerator)

    def top(self, low: int) -> int:
        """The largest size of the band that begins with ``low``."""
        for _ in range(self.width):
            low = self.most(low) + 1
        return low - 1

    def band(self, size: int) -> tuple[int, int]:
        """Number and largest size of a band: sets of one band or of neighbouring ones can link."""
        top, k = self.top(1), 0
        while top < size:
            top, k = self.top(top + 1), k + 1
        return k, top

    def allowances(self, top: int) -> tuple[int, int]:
        """Segments of allowance 1 and of allowance 0 for a band whose largest size is ``top``."""
        need = self.differences(2 * top) + 1
        best = None
        for ones in range(0, need // 2 + 1):
            zeros = need - 2 * ones
            zeros += zeros // 25 + 2 if need > 1 else 0  # in place of empty ones
            each = top / (ones + zeros)
            cost = zeros + ones * (1 + each) + self.documents * self.related * self.overlap**each
            if best is None or cost < best[0]:
                best = (cost, ones, zeros)
        return best[1], best[2]

    def signatures(self, s: np.ndarray, cache: dict) -> np.ndarray:
        """The keys under which a set meets every set that it can link with."""
        n = len(s)
        if not n:
            return np.zeros(0, dtype=np.int64)
        if n not in cache:
            k, top = self.band(n)
            plans = [(k, top, n + min(top, self.most(n)))]
            if self.most(n) > top:
                plans.append((k + 1, self.top(top + 1), n + self.most(n)))
            cache[n] = [(g, *self.allowances(t), self.differences(total) + 1) for g, t, total in plans]
        out = []
        value = mix(s, 1)
        for group, ones, zeros, need in cache[n]:
            m = ones + zeros
            for level in range(MOST_LEVELS + 1):
                if level == MOST_LEVELS:  # never met in practice; still exact, as all such sets share this key
                    out.append(mix(np.array([group], dtype=_U), 99))
                    break
                seg = (((mix(s, 2 + level) >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
                count = np.bincount(seg, minlength=m)
                sure = np.minimum(count, 1)  # differences in a segment that leave a key in common
                sure[:ones] = np.minimum(count[:ones], 2)
                sums = np.cumsum(sure)
                take = int(np.searchsorted(sums, need)) + 1
                within = seg < take
                seg, val = seg[within], value[within]
                order = np.argsort(seg, kind="stable")
                seg, val = seg[order], val[order]
                there = np.flatnonzero(count[:take])
                first = np.concatenate(([0], np.cumsum(count[there])[:-1]))
                total = np.add.reduceat(val, first)
                tag = (there.astype(_U) << _U(20)) + _U((group << 8) + level)
                out.append(mix(mix(total, 3) + tag, 4))
                inner = (seg < ones) & (count[seg] > 1)
                if inner.any():
                    place = np.searchsorted(there, seg[inner])
                    out.append(mix(mix(total[place] - val[inner], 3) + tag[place], 4))
                if sums[-1] >= need:
                    break
        return np.unique(np.concatenate(out)).view(np.int64)


def parity_sketch(s: np.ndarray) -> bytes:
    """Parities of elements by bit; two sets differ in at least as many elements as their sketches in bits."""
    bits = min(1 << 16, max(256, 1 << len(s).bit_length()))
    odd = np.bincount((mix(s, 5) & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shingles(words: int) -> Shingles:
    return kept(("shingles", words), lambda: Shingles(words))


def _sets(texts: DataFrame, words: int, scheme: Scheme) -> DataFrame:
    cache: dict = {}

    def run(batches):
        import xxhash

        for b in batches:
            for i in range(0, len(b["text"]), 500):
                of = [shingles(words)(t) for t in b["text"][i : i + 500]]
                yield {"doc_id": b["doc_id"][i : i + 500], "n": [len(s) for s in of], "print": [xxhash.xxh3_128_digest(s.tobytes()) for s in of], "keys": [scheme.signatures(s, cache) for s in of], "sketch": [parity_sketch(s) for s in of]}

    return map_rows(texts, run, "doc_id long, n long, print binary, keys array<long>, sketch binary")


#: Bits of the filter of documents that have candidates: fixed, so what is broadcast does not grow.
_FILTER_BUCKETS, _BUCKET_BITS = 512, 32768


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose id is in ``ids``, and perhaps a few others: by a bitmap of fixed size, so texts aren't shuffled."""
    return _maybe(texts, ids, "doc_id").select("doc_id", "text")


def _maybe(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is in ``ids``, and perhaps others."""
    spot, maps, hit = _bitmap(ids, column)
    near = rows.withColumn("spot", spot).withColumn("bucket", (F.col("spot") / _BUCKET_BITS).cast("int"))
    return near.join(F.broadcast(maps), "bucket").where(hit).select(*rows.columns)


def _bitmap(ids: DataFrame, column: str = "doc_id"):
    """The place of an id, the bitmaps by bucket, and the test of columns ``spot`` and ``bits``."""
    spot = F.pmod(F.xxhash64(column), F.lit(_FILTER_BUCKETS * _BUCKET_BITS))
    maps = ids.groupBy((spot / _BUCKET_BITS).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(spot, F.lit(_BUCKET_BITS))).alias("bits"))
    byte = F.expr(f"conv(hex(substr(bits, CAST(spot % {_BUCKET_BITS} / 8 AS int) + 1, 1)), 16, 10)").cast("int")
    return spot, maps, byte.bitwiseAND(F.expr("shiftleft(1, CAST(spot % 8 AS int))")) > 0


def _verified(pairs: DataFrame, sets: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    link = scheme.denominator * common >= scheme.numerator * (F.size("x") + F.size("y") - common)
    # b first: a hub is a smallest id, so its set is met by its pairs and not carried on with each of them
    return pairs.join(right, "b").join(left, "a").where(link).select("a", "b")


def _likely(pairs: DataFrame, sketches: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose sketches do not differ in more bits than linked sets of their sizes can differ in elements."""

    def run(batches):
        for c in batches:
            keep = []
            for na, nb, x, y in zip(c["na"], c["nb"], c["x"], c["y"]):
                width = min(len(x), len(y)) // 8
                fold = lambda z: np.bitwise_xor.reduce(np.frombuffer(z, dtype=_U).reshape(-1, width), axis=0)  # noqa: B023, E731
                keep.append(int(np.bitwise_count(fold(x) ^ fold(y)).sum()) <= scheme.differences(na + nb))
            yield {side: [v for v, k in zip(c[side], keep) if k] for side in ("a", "b")}

    left = sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    near = F.least("na", "nb") * scheme.denominator >= F.greatest("na", "nb") * scheme.numerator
    return map_rows(pairs.join(right, "b").join(left, "a").where(near).select("a", "b", "na", "nb", "x", "y"), run, "a long, b long")


def _crossing(rows: DataFrame, scheme: Scheme, block: int) -> DataFrame:
    """Pairs of different components in one bucket that the sketches do not rule out.

    ``rows``: key, part_a, part_b, doc_id, component, n, sketch, sorted by the first three within partitions.
    """

    def pairs(group) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        ids = np.array([g[0] for g in group])
        comp = np.array([g[1] for g in group])
        n = np.array([g[2] for g in group])
        width = min(len(g[3]) for g in group)
        folded = np.zeros((len(group), width // 8), dtype=np.uint64)
        for i, g in enumerate(group):
            folded[i] = np.bitwise_xor.reduce(np.frombuffer(g[3], dtype=np.uint64).reshape(-1, width // 8), axis=0)
        side = np.array([g[4] for g in group])
        out = []
        for i in range(len(group) - 1):
            rest = slice(i + 1, None)
            ok = (comp[rest] != comp[i]) & (np.minimum(n[rest], n[i]) * scheme.denominator >= scheme.numerator * np.maximum(n[rest], n[i])) & ((side[rest] != side[i]) | (side[i] < 0))
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                gap = np.bitwise_count(folded[at] ^ folded[i]).sum(axis=1)
                most = (scheme.denominator - scheme.numerator) * (n[at] + n[i]) // (scheme.denominator + scheme.numerator)
                out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in at[gap <= most].tolist()]
        return out

    def run(batches):
        now, group = None, []
        for b in batches:
            found: list = []
            for key, p, q, doc, c, n, sketch, own in zip(b["key"], b["part_a"], b["part_b"], b["doc_id"], b["component"], b["n"], b["sketch"], b["part"]):
                if (key, p, q) != now:
                    found += pairs(group)
                    now, group = (key, p, q), []
                group.append((doc, c, n, sketch, -1 if p == q else own))
            found = list(set(found))
            yield {"a": [x for x, _ in found], "b": [y for _, y in found]}
        found = list(set(pairs(group)))
        yield {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return map_rows(rows, run, "a long, b long")


@dataclass(frozen=True)
class _Groups:
    """What the join knows before links are counted."""

    scheme: Scheme
    words: int
    texts: DataFrame  # doc_id, text
    heads: DataFrame  # doc_id, n: one document of each set
    placed: DataFrame  # doc_id, component_id of the documents that link
    rows: DataFrame  # doc_id, n_shingles, component_id, class_id of every row


def _groups(docs: DataFrame, words: int, numerator: int, denominator: int, block: int, id_col: str, text_col: str) -> _Groups:
    texts = whole_texts(docs, id_col, text_col)
    scheme = Scheme(numerator, denominator, documents=docs.count())
    again = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").cast("int").alias("rows")).where("rows > 1")
    repeated = again.limit(1).count() > 0
    if repeated:
        texts = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text")).unionByName(texts.where("doc_id IS NULL"))
    told = settle(_sets(texts, words, scheme))
    full = told.where("n > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1")
    # the largest classes are told to all tasks, so their copies need not meet in one; the list is bounded, and
    # only where there are more classes do the documents that are in none of these meet by their sets' prints
    large = settle(classes.orderBy(F.desc("copies"), "class_id").limit(LARGE_CLASSES)).select("print", "class_id")
    full = full.join(F.broadcast(large), "print", "left").withColumn("large", F.col("class_id").isNotNull())
    if classes.limit(LARGE_CLASSES + 1).count() > LARGE_CLASSES:
        small = classes.join(F.broadcast(large), "print", "left_anti").select("print", F.col("class_id").alias("small_class"))
        left_over = full.where("NOT large").drop("class_id").join(small, "print", "left").withColumnRenamed("small_class", "class_id")
        full = full.where("large").unionByName(left_over)
    heads = full.where("class_id IS NULL OR class_id = doc_id")
    # a key's smallest document by an aggregate that combines on the map side; only keys of several documents,
    # which a bitmap of fixed size tells apart from most others, are looked up again, by a join whose hot keys can be split
    by_key = heads.select(F.explode("keys").alias("key"), "doc_id")
    several = settle(by_key.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first"))
    shared = settle(_maybe(by_key, several, "key").join(several, "key").select("key", "doc_id", "first"))
    sketches = full.select("doc_id", "n", "sketch")
    star = shared.where("first <> doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()

    def linked(pairs: DataFrame) -> DataFrame:
        """Exactly the linked ones; only their documents' sets are made again from the texts."""

        def with_sets(batches):
            for b in batches:
                yield {"doc_id": b["doc_id"], "shingles": [shingles(words)(t).view(np.int64) for t in b["text"]]}

        likely = settle(_likely(pairs, sketches, scheme))
        wanted = _only(texts.where("doc_id IS NOT NULL"), likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        return settle(_verified(likely, settle(map_rows(wanted, with_sets, "doc_id long, shingles array<long>")), scheme))

    links = linked(star)
    joined = settle(components(links))  # of one document of each class; copies are attached in the end

    # buckets in several components: all pairs across them, in blocks; those of the largest component are not
    # compared among themselves
    placed = shared.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sized = placed.groupBy("key", "component").agg(F.count("*").alias("rows"))
    open_keys = sized.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("most"), F.sum("rows").alias("rows"), F.count("*").alias("c")).where("c > 1")
    open_keys = open_keys.select("key", F.col("most.component").alias("main"), F.ceil(F.col("most.rows") / block).cast("int").alias("mains"), F.ceil((F.col("rows") - F.col("most.rows")) / block).cast("int").alias("others"))
    own = F.xxhash64("doc_id")
    is_main = F.col("component") == F.col("main")
    part = F.when(is_main, F.pmod(own, F.col("mains"))).otherwise(F.col("mains") + F.pmod(own, F.col("others"))).cast("int")
    rest = placed.join(open_keys, "key").withColumn("part", part)
    dealt = rest.select("key", "doc_id", "component", "part", F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)).alias("other"))
    dealt = dealt.select("key", "doc_id", "component", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))
    dealt = dealt.join(sketches, "doc_id")
    dealt = dealt.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b")
    more = linked(settle(_crossing(dealt, scheme, block).distinct()))
    name = lambda side: joined.select(F.col("id").alias(side), F.col("component").alias(f"{side}_component"))
    bridges = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_component", "a").alias("a"), F.coalesce("b_component", "b").alias("b"))
    merged = components(bridges).select(F.col("id").alias("component"), F.col("component").alias("final"))
    final = joined.select(F.col("id").alias("doc_id"), "component").unionByName(bridges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(joined.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").withColumn("component", F.col("doc_id")))
    final = settle(final.join(merged, "component", "left").select("doc_id", F.coalesce("final", "component").alias("component_id")))
    head = full.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), "large")
    of = final.select(F.col("doc_id").alias("class_id"), "component_id")
    # copies of a large class get its component from a table as bounded as that of the classes
    many = head.where("large").join(F.broadcast(of.join(F.broadcast(large.select("class_id")), "class_id", "left_semi")), "class_id", "left")
    few = head.where("NOT large").join(of, "class_id", "left")
    none = told.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    rows = many.unionByName(few).withColumn("component_id", F.coalesce("component_id", "class_id")).drop("large").unionByName(none)
    if repeated:
        rows = rows.join(again, "doc_id", "left").withColumn("_", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1)))))
    rows = rows.select("doc_id", "n_shingles", "component_id", "class_id")
    return _Groups(scheme, words, texts.where("doc_id IS NOT NULL"), heads.select("doc_id", "n"), final, rows)


def _links_of(sets: list, side: list | None, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of linked sets; unless ``side`` is None, of pairs of different sides only."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(n, kind="stable")
    n, side = n[order], None if side is None else np.array(side)[order]
    _, flat, often = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(n)), n)
    met = often[flat] > 1  # an element of one set alone is in no intersection
    flat, owner = flat[met], owner[met]
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(n)))))
    mark = np.zeros(len(often), dtype=bool)
    left, right = [], []
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, scheme.most(int(n[i])), side="right"))
        if stop <= i + 1:
            continue
        own = flat[ends[i] : ends[i + 1]]
        mark[own] = True
        sums = np.concatenate(([0], np.cumsum(mark[flat[ends[i + 1] : ends[stop]]])))
        mark[own] = False
        at = ends[i + 1 : stop + 1] - ends[i + 1]
        common = sums[at[1:]] - sums[at[:-1]]
        ok = scheme.denominator * common >= scheme.numerator * (n[i] + n[i + 1 : stop] - common)
        if side is not None:
            ok &= side[i + 1 : stop] != side[i]
        found = np.flatnonzero(ok) + i + 1
        left.append(np.full(len(found), i))
        right.append(found)
    none = np.zeros(0, dtype=np.int64)
    return order[np.concatenate([none, *left])], order[np.concatenate([none, *right])]


def _all_links(groups: _Groups, block: int, listed: bool) -> DataFrame:
    """(a, b) of all linked pairs of different sets, or (doc_id, n_links) of the documents that have any."""
    scheme, words = groups.scheme, groups.words
    placed = groups.placed.join(groups.heads, "doc_id")
    sized = settle(placed.groupBy("component_id").agg(F.count("*").alias("members"), F.sum("n").alias("elements"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("members > 1"))
    two = sized.where("members = 2")  # they link, being one component
    parts = F.greatest(F.ceil(F.col("members") / block), F.ceil(F.col("elements") / (block * 1000))).cast("int")
    dealt = placed.join(sized.where("members > 2").select("component_id", parts.alias("parts")), "component_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = settle(dealt.select("doc_id", "component_id", "part", "parts"))
    whole = _only(groups.texts, dealt.select("doc_id")).join(dealt, "doc_id")
    whole = whole.select("component_id", "doc_id", "text", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    whole = whole.select("component_id", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "doc_id", "text", "part")
    whole = whole.repartition("component_id", "part_a", "part_b").sortWithinPartitions("component_id", "part_a", "part_b")

    def run(batches):
        def answer(key, ids, sets, side):
            i, j = _links_of(sets, None if key[1] == key[2] else side, scheme)
            ids = np.array(ids, dtype=np.int64)
            if listed:
                return {"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}
            count = np.bincount(np.concatenate((i, j)), minlength=len(ids))
            some = np.flatnonzero(count)
            return {"doc_id": ids[some], "n_links": count[some]}

        now, ids, sets, side = None, [], [], []
        for batch in batches:
            for c, p, q, doc, text, part in zip(*(batch[k] for k in ("component_id", "part_a", "part_b", "doc_id", "text", "part"))):
                if (c, p, q) != now:
                    if ids:
                        yield answer(now, ids, sets, side)
                    now, ids, sets, side = (c, p, q), [], [], []
                ids.append(doc)
                sets.append(shingles(words)(text))
                side.append(part)
        if ids:
            yield answer(now, ids, sets, side)

    found = map_rows(whole, run, "a long, b long" if listed else "doc_id long, n_links long")
    if listed:
        return found.unionByName(two.select("a", "b"))
    return found.unionByName(two.select(F.explode(F.array("a", "b")).alias("doc_id"), F.lit(1).cast("long").alias("n_links"))).groupBy("doc_id").agg(F.sum("n_links").alias("n_links"))


def similar_groups(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, block: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row, as ``similar_documents``, without counting links."""
    return _groups(docs, words, numerator, denominator, block, id_col, text_col).rows


def linked_pairs(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, block: int = 1500, id_col: str = "doc_id", text_col: str = "text", link_block: int = 500) -> DataFrame:
    """(a, b), a < b, of all links between different sets, each once; a set is named by its class."""
    return _all_links(_groups(docs, words, numerator, denominator, block, id_col, text_col), link_block, True)


def similar_documents(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100, block: int = 1500, id_col: str = "doc_id", text_col: str = "text", link_block: int = 500) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of every row.

    Documents link when denominator * |intersection| >= numerator * |union| of their sets of ``words``-word
    shingles; with fewer words the whole sequence is one shingle.  ``component_id`` is the smallest id
    reachable by links.  Equal sets form a class, named by its smallest id; ``n_links`` is the number of other
    classes that the document's class links with, the same for every copy.  Empty and null texts have
    no shingles and link with nothing; repeated rows of one id are one document, with the least of their texts,
    and have one row each; rows without an id get a null component; an empty table gives no rows; other columns are not read.
    """
    groups = _groups(docs, words, numerator, denominator, block, id_col, text_col)
    degree = _all_links(groups, link_block, False).withColumnRenamed("doc_id", "class_id")
    return groups.rows.join(degree, "class_id", "left").select("doc_id", "n_shingles", "component_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, similar: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that a smaller id of their component stands for, and without repeats of an id.

    A bitmap of fixed size parts the rows that certainly stay; only the others are joined and shuffled.
    Rows without an id stay.
    """
    told = similar.where("doc_id IS NOT NULL")
    again = told.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    doubtful = settle(again.where("component_id <> doc_id OR rows > 1").select("doc_id", (F.col("component_id") == F.col("doc_id")).alias("stays")))
    names = docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    maybe, sure = _parted(rows, doubtful)
    joined = maybe.join(doubtful, "doc_id", "left")
    first = Window.partitionBy("doc_id").orderBy(F.col("row").getField("text"))
    kept = joined.where("stays IS NULL OR stays").withColumn("place", F.row_number().over(first)).where("place = 1")
    return sure.select("row.*").unionByName(kept.select("row.*"))


def _parted(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be in ``ids``, and those whose id is not."""
    spot, maps, hit = _bitmap(ids)
    near = rows.withColumn("spot", spot).withColumn("bucket", (F.col("spot") / _BUCKET_BITS).cast("int")).join(F.broadcast(maps), "bucket", "left")
    marked = near.withColumn("hit", F.coalesce(hit, F.lit(False)))
    return marked.where("hit").select("doc_id", "row"), marked.where("NOT hit").select("doc_id", "row")
