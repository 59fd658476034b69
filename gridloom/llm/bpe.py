"""Byte-level BPE encoding and decoding by merge replay over a whole corpus of words.

A block of documents is turned into its distinct pre-tokens.  All of them are laid out as one array of
symbols, an inverted index leads from a token pair's rank to the positions where the pair stands, and the
merges are replayed in rank order over the whole array at once: each step looks up the positions of one
rank, merges them, and updates only the touched neighbours, which enter the index under their new rank.
A word's ids depend on the word alone, so it makes no difference to the result how documents are dealt to
blocks: the encoding needs no shuffle, memory is bounded by a block, and a lost executor's tasks are
simply run again.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, kept, map_rows, whole_texts

NONE = np.int32(2**31 - 1)
#: White space as the rank files' pattern understands it; Python's own \s also takes \x1c-\x1f.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Coarser cuts than the pre-token pattern makes, each of which holds whole pre-tokens.
CHUNK = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many words at once; ``ranks`` maps a token's bytes to its id, which is its merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = (np.array(left, dtype=np.int64) << 32) | np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.int64(2**62))
        self.pair_rank = np.append(np.array(made, dtype=np.int32)[order], NONE)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian 32-bit integers.  A word that is a token itself is that token."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            known = self.ranks.get(w)
            if known is None:
                rest.append(i)
            else:
                out[i] = known.to_bytes(4, "little")
        start, size = 0, 0
        for k in range(len(rest) + 1):
            if k == len(rest) or size and size + len(words[rest[k]]) > 2_000_000:
                part = rest[start:k]
                for i, ids in zip(part, self._replay([words[i] for i in part])):
                    out[i] = ids
                start, size = k, 0
            if k < len(rest):
                size += len(words[rest[k]])
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.concatenate(([0], np.cumsum(length)))
        n = int(first[-1])
        token = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[first[1:][length > 0] - 1] = -1
        prv[first[:-1][length > 0]] = -1
        rank = np.full(n, NONE, dtype=np.int32)
        inner = np.flatnonzero(nxt >= 0)
        rank[inner] = self._rank_of(token[inner], token[inner + 1])
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks != NONE
            positions, ranks = positions[keep], ranks[keep]
            if not len(positions):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, p in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(positions, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        enter(inner, rank[inner])
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                chained = nxt[at[:-1]] == at[1:]
                if chained.any():  # overlapping pairs: every other one of a run, from its left end
                    starts = np.concatenate(([True], ~chained))
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 0]
                same = word[at[1:]] == word[at[:-1]]
                if same.any():
                    at = self._leftmost(at, same, r, token, nxt, prv, word, index, heap)
            gone = nxt[at]
            after = nxt[gone]
            token[at] = r
            nxt[at] = after
            inside = after >= 0
            prv[after[inside]] = at[inside]
            rank[gone] = NONE
            alive[gone] = False
            before = prv[at]
            before = before[before >= 0]
            touched = np.concatenate((at[inside], before))
            fresh = self._rank_of(token[touched], token[nxt[touched]])
            rank[at] = NONE
            rank[touched] = fresh
            enter(touched, fresh)
        kept = np.flatnonzero(alive)
        ids = token[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word[kept], minlength=len(words)))).tolist()
        return [ids[a:b] for a, b in zip(chain((0,), ends), ends)]

    def _leftmost(self, at, same, r, token, nxt, prv, word, index, heap) -> np.ndarray:
        """Words where a merge may make a pair of lower rank take one merge at a time, leftmost first."""
        several = np.zeros(len(at), dtype=bool)
        several[1:] |= same
        several[:-1] |= same
        p = at[several]
        made = np.full(len(p), r, dtype=np.int32)
        left, right = prv[p], nxt[nxt[p]]
        low = self._rank_of(made[:1], made[:1])[0] < r
        unsafe = np.full(len(p), low)
        unsafe |= (left >= 0) & (self._rank_of(token[left], made) < r)
        unsafe |= (right >= 0) & (self._rank_of(made, token[right]) < r)
        if not unsafe.any():
            return at
        slow = np.isin(word[at], word[p[unsafe]])
        again = slow & np.concatenate(([False], same))
        index.setdefault(r, []).append(at[again])
        heapq.heappush(heap, r)
        return at[~again]


class Codec:
    """Texts to ids and back; remembers the chunks that it has met, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 250_000):
        self.replay = MergeReplay(ranks)
        self.split = regex.compile(pattern).findall
        self.chunks = regex.compile(CHUNK).findall
        self.remember, self.known = remember, {}
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        if len(self.known) > self.remember:
            self.known.clear()
        known, cut = self.known, [self.chunks(t) for t in texts]
        new = {c: self.split(c) for c in set(chain.from_iterable(cut)).difference(known)}
        pieces = list(set(chain.from_iterable(new.values())).difference(known))
        known.update(zip(pieces, self.replay.encode([p.encode() for p in pieces])))
        for c, parts in new.items():
            if len(parts) != 1:
                known[c] = b"".join([known[p] for p in parts])
        return [b"".join([known[c] for c in chunks]) for chunks in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """One per worker process, so that the vocabulary is read once and chunks are remembered across tasks."""
    return kept(("codec", path, pattern), lambda: Codec(load_ranks(path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids): the ids of each whole text, as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows give repeated results; a null doc_id stays null; an
    empty table gives an empty table; other columns are not read.
    """

    def encode(batches):
        for b in batches:
            for ids, texts in blocks(b["doc_id"], b["text"]):
                yield {"doc_id": ids, "ids": codec(ranks_path, pattern).encode(texts)}

    return map_rows(whole_texts(docs, id_col, text_col), encode, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids, decoded) of (doc_id, ids): the bytes that the ids stand for; null ids count as none."""

    def decode(batches):
        for b in batches:
            to_bytes = codec(ranks_path, pattern).decode
            step = 500
            for i in range(0, len(b["ids"]), step):
                ids = [x or b"" for x in b["ids"][i : i + step]]
                yield {"doc_id": b["doc_id"][i : i + step], "ids": ids, "decoded": [to_bytes(x) for x in ids]}

    return map_rows(encoded.select("doc_id", "ids"), decode, "doc_id long, ids binary, decoded binary")


def encoding_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = decode_documents(encode_documents(docs, ranks_path, pattern), ranks_path, pattern)
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
