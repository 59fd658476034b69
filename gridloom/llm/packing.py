"""Packing of tokenized documents into sequences by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; full pieces are sequences of their own.  Pieces of
one length are interchangeable, so what has to be packed is a count for each length: a table of bounded size
whatever the number of pieces.  The counts are written as digits of a fixed base; a level holds the digits
of one power of it, is packed once and stands for that many equal groups of sequences.  Levels go from the
highest down; a level's sequences that are not full are opened and their pieces handed to the level below,
whose count of them is larger by the base, so only the lowest level leaves room unfilled.  No table is
cut into shards and the work grows with the logarithm of the pieces.

On each level islands, one task each, evolve populations of packings.  A packing's genes are its bins:
crossover injects well-filled bins of one parent whole into the other, removes the bins that hold
duplicates of what came in, and puts the displaced pieces back best fit, longest first; mutation empties
the worst filled bins in the same way.  A population starts from best fits in random order.  After each
epoch every island sends its elite to the next one.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SPACE
from .common import blocks, kept, map_rows, settle, whole_texts

# ---------------------------------------------------------------- tokens

#: str.split also splits at these, which are no white space to the tokenizer.
SENTENCE_END = re.compile(r"(?<=[^\W_])([.,])(?=[ \n])").sub
SEPARATOR = re.compile("[\x1c-\x1f]").search


def byte_letters() -> dict[int, int]:
    """Byte-level tokenizers' letters for bytes (fixed by the format): printable ones stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: 256 + k for k, b in enumerate(others)}


BYTE_LETTERS = byte_letters()


def simpler(text: str) -> str:
    """A text with the same ids and fewer different words: lower case, and ends of sentences apart from words.

    The tokenizer lower-cases by itself, after composing characters; only texts that are composed already are
    touched, and none with a letter whose lower case hangs on its neighbours.  A full stop or comma between a
    letter or digit and white space is a token of its own in any case.
    """
    if text.isascii() or unicodedata.is_normalized("NFC", text) and "\u03a3" not in text and "\u0130" not in text:
        return SENTENCE_END(r" \1", text.lower())
    return text


class WordTokens:
    """Ids by a tokenizer that lower-cases and treats what white space separates apart, remembered by words up to a bound."""

    def __init__(self, path: str, remember: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember, self.known = remember, {}
        self.model = self.tokenizer.model
        self.apart = re.compile(f"[^{SPACE}]+").findall

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        """Little-endian 32-bit ids of each text, then ``end``; a text with a special token's string in it goes to the tokenizer whole."""
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        if whole:
            plain = iter(self.encode([t for i, t in enumerate(texts) if i not in whole], end))
            ids = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() + end
            return [ids(t) if i in whole else next(plain) for i, t in enumerate(texts)]
        if len(self.known) > self.remember:
            self.known.clear()
        known, cut = self.known, [(self.apart(t) if SEPARATOR(t) else t.split()) for t in map(simpler, texts)]
        new = list(set().union(*cut).difference(known))
        odd = []
        for w in new:
            if w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w):
                # nothing to normalize and nothing to cut: such a word goes straight to the merges
                known[w] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS))])
            else:
                odd.append(w)
        for i in range(0, len(odd), 20_000):
            part = odd[i : i + 20_000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[word] = b"".join([x.to_bytes(4, "little") for x in e.ids])
        return [b"".join([known[w] for w in words]) + end for words in cut]


def word_tokens(path: str) -> WordTokens:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("word tokens", path), lambda: WordTokens(path))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every whole text: its ids and ``end_id``, cut every ``capacity`` tokens.

    A null or empty text is one piece, the end id alone; repeated rows give repeated pieces; an empty table
    gives none.
    """

    def cut(batches):
        end = end_id.to_bytes(4, "little")
        for b in batches:
            for ids, texts in blocks(b["doc_id"], b["text"]):
                out = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc, tokens in zip(ids, word_tokens(tokenizer_path).encode(texts, end)):
                    view, n = memoryview(tokens), len(tokens) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        part = view[4 * at : 4 * (at + capacity)]
                        out["doc_id"].append(doc)
                        out["piece"].append(k)
                        out["start"].append(at)
                        out["length"].append(len(part) // 4)
                        out["ids_crc32"].append(zlib.crc32(part))
                yield out

    return map_rows(whole_texts(docs, id_col, text_col), cut, PIECES)


# ---------------------------------------------------------------- genetic algorithm


class Packing:
    """Bins of item indices and their loads."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> tuple:
        """Fewer bins first, then unevenly filled ones, which leave room together."""
        return (-len(self.bins), sum(x * x for x in self.loads) / capacity**2)

    def place(self, items: int) -> list[int]:
        """The bin of each item."""
        out = [0] * items
        for b, members in enumerate(self.bins):
            for j in members:
                out[j] = b
        return out


def best_fit(bins: list[list[int]], loads: list[int], items: list[int], size: list[int], capacity: int) -> Packing:
    """Puts ``items`` in the given order, each into the fullest bin that has room; changes the lists it is given."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room for exactly r
    for i, x in enumerate(loads):
        if x < capacity:
            by_room[capacity - x].append(i)
            rooms |= 1 << (capacity - x)
    for item in items:
        s = size[item]
        if fits := rooms >> s:
            room = s + (fits & -fits).bit_length() - 1
            i = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[i].append(item)
            loads[i] += s
            room -= s
        else:
            i, room = len(bins), capacity - s
            bins.append([item])
            loads.append(s)
        if room:
            by_room[room].append(i)
            rooms |= 1 << room
    return Packing(bins, loads)


def longest_first(items, size: list[int]) -> list[int]:
    return sorted(items, key=lambda j: (-size[j], j))


def refit(source: Packing, gone: set[int], injected: list[list[int]], size: list[int], capacity: int) -> Packing:
    """``source`` without the bins ``gone``, with the injected ones, and what is left over fitted anew."""
    came = {j for x in injected for j in x}
    bins = [list(x) for x in injected] + [list(x) for i, x in enumerate(source.bins) if i not in gone]
    loads = [sum(size[j] for j in x) for x in injected] + [x for i, x in enumerate(source.loads) if i not in gone]
    displaced = [j for i in gone for j in source.bins[i] if j not in came]
    return best_fit(bins, loads, longest_first(displaced, size), size, capacity)


def crossover(giver: Packing, taker: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects well-filled bins of the giver whole, of equals those of fewer items; the taker's bins that hold any of their items go."""
    order = sorted(range(len(giver.bins)), key=lambda i: (-giver.loads[i], len(giver.bins[i])))
    best = order[: max(1, len(order) // 2)]
    injected = [giver.bins[i] for i in rng.sample(best, max(1, len(best) // 2))]
    place = taker.place(len(size))
    return refit(taker, {place[j] for x in injected for j in x}, injected, size, capacity)


def mutate(p: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """Empties the worst filled bin, random shares of those that are not full and of those of the most (and so the shortest) items, and fits their items anew."""
    worst = min(range(len(p.bins)), key=lambda i: p.loads[i])
    share = rng.random()
    some = [i for i, x in enumerate(p.loads) if x < capacity and rng.random() < share]
    crowded = sorted(range(len(p.bins)), key=lambda i: -len(p.bins[i]))[: 1 + int(len(p.bins) * share)]
    return refit(p, {worst, *some, *crowded}, [], size, capacity)


def least_bins(size: list[int], capacity: int) -> int:
    """No packing has fewer bins: neither the total nor the pieces longer than half a bin allow it."""
    return max(-(-sum(size) // capacity), sum(2 * s > capacity for s in size))


@dataclass
class Evolution:
    """What an island did: its best packing, bins of the best one it began with, crossovers, and how often one improved on the best."""

    best: Packing
    began: int
    crossovers: int = 0
    gains: int = 0


def evolve(size: list[int], capacity: int, seeds: list[Packing], population: int, generations: int, seed: int, patience: int = 5) -> Evolution:
    """The best packing that an island finds; stops at the lower bound, and after ``patience`` generations without fewer bins."""
    rng = random.Random(seed)
    least = least_bins(size, capacity)
    score = lambda p: p.fitness(capacity)

    def filled(pool: list[Packing]) -> list[Packing]:
        """One packing of each fitness, and newcomers in random order in place of the others, so that parents differ."""
        pool = sorted({score(p): p for p in reversed(pool)}.values(), key=score, reverse=True)[:population]
        while len(pool) < population:
            order = list(range(len(size)))
            rng.shuffle(order)
            pool.append(best_fit([], [], order, size, capacity))
        return sorted(pool, key=score, reverse=True)

    pool = filled(list(seeds))
    told, since = Evolution(pool[0], len(pool[0].bins)), 0
    for _ in range(generations):
        if len(pool[0].bins) <= least or len(pool) < 2 or since == patience:
            break
        best = pool[0]
        a = best if rng.random() < 0.5 else rng.choice(pool)
        b = rng.choice([p for p in pool if p is not a])
        children = [crossover(b, a, size, capacity, rng), mutate(crossover(a, b, size, capacity, rng), size, capacity, rng)]
        told.crossovers += 2
        told.gains += sum(score(c) > score(best) for c in children)
        pool = filled([*pool, *children])
        since = 0 if len(pool[0].bins) < len(best.bins) else since + 1
    told.best = pool[0]
    return told


def _as_packing(bin_of, size: list[int]) -> Packing:
    bins: dict[int, list[int]] = {}
    for j, b in enumerate(bin_of):
        bins.setdefault(b, []).append(j)
    return Packing(list(bins.values()), [sum(size[j] for j in x) for x in bins.values()])


def evolve_islands(spark: SparkSession, size: list[int], capacity: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> tuple[Packing, dict]:
    """The best packing of all islands, each a task of its own, and counts of what they did.

    ``size`` is bounded (see ``pack``), and so is what goes to the tasks and comes back: an elite an island.  An
    island that is lost is evolved again from the same seeds with the same random numbers.
    """
    elites: dict[int, list[int]] = {}
    counts = {"items": len(size), "crossovers": 0, "gains": 0, "began": None}
    least = least_bins(size, capacity)
    score = lambda p: p.fitness(capacity)
    best = None
    for epoch in range(epochs):
        told = spark.sparkContext.broadcast((size, elites))

        def run(batches, epoch=epoch, told=told):
            for b in batches:
                items, known = told.value
                for island in b.column(0).to_pylist():
                    # an island's own elite, and that of its neighbour
                    seeds = [_as_packing(known[k], items) for k in dict.fromkeys((island, (island + 1) % islands)) if k in known]
                    e = evolve(items, capacity, seeds, population, generations, seed * 7919 + epoch * 101 + island)
                    yield pa.RecordBatch.from_pydict({"island": [island], "place": [np.array(e.best.place(len(items)), "<i4").tobytes()], "began": [e.began], "crossovers": [e.crossovers], "gains": [e.gains]})

        rows = spark.range(0, islands, 1, islands).mapInArrow(run, "island long, place binary, began long, crossovers long, gains long").collect()
        elites = {r.island: np.frombuffer(r.place, "<i4").tolist() for r in rows}
        before, best = best, max((_as_packing(x, size) for x in elites.values()), key=score)
        counts["began"] = counts["began"] or min(r.began for r in rows)
        counts["crossovers"] += sum(r.crossovers for r in rows)
        counts["gains"] += sum(r.gains for r in rows)
        told.unpersist()
        if len(best.bins) <= least or (before and len(best.bins) == len(before.bins)):
            break
    return best, {**counts, "bins": len(best.bins), "least": least}


# ---------------------------------------------------------------- levels


@dataclass
class Level:
    """The sequences of one level: bins of lengths, each standing for ``copies`` sequences."""

    copies: int
    bins: list[list[int]]


def digits(counts: dict[int, int], base: int) -> list[dict[int, int]]:
    """The counts' digits, lowest first."""
    out, left = [], dict(counts)
    while left:
        out.append({s: n % base for s, n in left.items() if n % base})
        left = {s: n // base for s, n in left.items() if n >= base}
    return out


def pack_counts(counts: dict[int, int], capacity: int, solve, base: int = 16, opened: int = 800) -> tuple[list[Level], list[dict]]:
    """Levels that hold ``counts`` pieces of each length, by ``solve(sizes, level) -> (Packing, counts)``, and what it told.

    A level has at most ``base`` - 1 pieces of a length beside those of the level above, of which at most
    ``opened`` pieces are handed down for each of their ``base`` copies: those of its worst filled bins, then those
    of the full ones that hold the most and so the shortest pieces, which the level below needs to fill its own.
    """
    levels, told, handed = [], [], Counter()
    by_digit = digits(counts, base)
    for k in reversed(range(len(by_digit))):
        wanted = Counter(by_digit[k]) + handed
        sizes = sorted(wanted.elements(), reverse=True)
        handed = Counter()
        if not sizes:
            continue
        found, about = solve(sizes, k)
        bins = [[sizes[j] for j in b] for _, b in sorted(zip(found.loads, found.bins), key=lambda x: (x[0], -len(x[1])))]
        loose = 0
        if k:
            pieces = 0
            while loose < len(bins) and pieces + len(bins[loose]) <= opened:
                pieces += len(bins[loose])
                loose += 1
            handed = Counter({s: n * base for s, n in Counter(s for b in bins[:loose] for s in b).items()})
        levels.append(Level(base**k, bins[loose:]))
        told.append({"copies": base**k, **about, "opened": loose})
    return levels, told


def _numbered(pieces: DataFrame, capacity: int) -> DataFrame:
    """(_row, _size, _task, _rank): each piece with its place among its task's pieces of the same length; lengths outside of 1..capacity count as 0."""
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("_row"), F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(0).cast("int").alias("_size"))

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            size = b.column(1).to_numpy(zero_copy_only=False)
            if not len(size):
                continue
            order = np.argsort(size, kind="stable")
            s = size[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            many = np.diff(np.append(first, len(s)))
            rank = np.empty(len(s), dtype=np.int64)
            rank[order] = np.arange(len(s)) - np.repeat(first, many) + seen[s]
            seen[s[first]] += many
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), task, dtype=np.int32)), pa.array(rank)], names=["_row", "_size", "_task", "_rank"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_rank", T.LongType())]))


def pack(pieces: DataFrame, capacity: int = 2048, islands: int = 4, epochs: int = 3, population: int = 4, generations: int = 8, base: int = 16, told: list | None = None) -> DataFrame:
    """``pieces`` (any columns, with ``length`` in 1..capacity) with sequence_id and offset.

    Offsets within a sequence are gapless from 0.  The driver sees how many pieces there are of each length, at
    most ``capacity`` numbers; an island holds at most about (``capacity`` + 800) * ``base`` pieces; the tables of
    places that go to all tasks have about as many rows for each level, of which there are log(pieces) / log(base).
    ``told`` gets what the islands did on each level.  Pieces whose length is null or outside of 1..capacity
    get a null sequence_id and offset; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    numbered = settle(_numbered(pieces, capacity))
    by_task = numbered.groupBy("_task", "_size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_size").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    first = by_task.select("_task", "_size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    counts = {r["_size"]: r["n"] for r in by_task.groupBy("_size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    solve = lambda sizes, level: evolve_islands(spark, sizes, capacity, islands, epochs, population, generations, 1 + level)
    levels, about = pack_counts({s: n for s, n in counts.items() if 0 < s < capacity}, capacity, solve, base)
    if told is not None:
        told += about
    slots = {n: [] for n in ("_size", "_level", "_slot", "_bin", "offset")}
    spans: dict[int, list] = {}
    done, sequences = Counter(), 0
    for k, level in enumerate(levels):
        held: Counter = Counter()
        for b, sizes in enumerate(level.bins):
            at = 0
            for s in sizes:
                for name, value in zip(slots, (s, k, held[s], b, at)):
                    slots[name].append(value)
                held[s] += 1
                at += s
        for s, n in held.items():
            spans.setdefault(s, []).append((k, done[s], n, sequences, len(level.bins)))
            done[s] += n * level.copies
        sequences += len(level.bins) * level.copies
    slot = pa.table({"_size": pa.array(slots["_size"], pa.int32()), "_level": pa.array(slots["_level"], pa.int32()), "_slot": pa.array(slots["_slot"], pa.int64()), "_bin": pa.array(slots["_bin"], pa.int64()), "offset": pa.array(slots["offset"], pa.int64())})
    span = spark.createDataFrame(list(spans.items()), "_size int, _spans array<struct<level:int,start:long,n:long,first:long,bins:long>>")
    place = F.col("_before") + F.col("_rank")
    at = numbered.join(first, ["_task", "_size"]).withColumn("_place", place).join(F.broadcast(span), "_size", "left")
    at = at.withColumn("_span", F.expr("element_at(filter(_spans, x -> x.start <= _place), -1)"))
    at = at.withColumn("_copy", F.expr("(_place - _span.start) DIV _span.n")).withColumn("_slot", F.expr("(_place - _span.start) % _span.n")).withColumn("_level", F.col("_span.level"))
    put = at.join(F.broadcast(spark.createDataFrame(slot)), ["_size", "_level", "_slot"], "left")
    full = F.col("_size") == capacity
    sequence = F.when(full, sequences + F.col("_place")).otherwise(F.col("_span.first") + F.col("_copy") * F.col("_span.bins") + F.col("_bin"))
    return put.select("_row.*", sequence.alias("sequence_id"), F.when(full, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """token_pieces, packed; the pieces are settled first, so that a task needs one Python worker at a time and not two."""
    return pack(settle(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity, **options)
