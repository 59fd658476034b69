"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf holds a pre-token's characters and tokens, inner nodes their sums.  An edit descends to the leaves that
it touches, takes boundary context on both sides, cuts only that region into pre-tokens again, and updates
the sums on the paths to the root; everything else keeps its counts.

Context: the pattern looks at most one character beyond the one that follows a pre-token, and never back.  So
pre-tokens that end two characters before an edit stand, and once a new cut meets an old one behind the edit
all later cuts are the old ones.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load_ranks
from .common import kept, map_rows


class Counter:
    """Pre-tokens and their token counts, remembered up to a bound."""

    def __init__(self, ranks_path: str, pattern: str, remember: int = 400_000):
        import tiktoken

        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={}).encode_ordinary
        self.split = regex.compile(pattern).findall
        self.remember, self.known = remember, {}

    def counts(self, words: list[str]) -> list[int]:
        known = self.known
        new = list(set(words).difference(known))
        if new:
            if len(known) > self.remember:
                known.clear()
                new = list(set(words))
            encode = self.encode
            for w in new:
                known[w] = len(encode(w))
        return [known[w] for w in words]


class CountTree:
    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        words = counter.split(text)
        self.slots: list = words  # a pre-token, or the pre-tokens that an edit left in this place
        self.base = 1 << max(0, len(words) - 1).bit_length()
        self.chars = self._sums(list(map(len, words)))
        self.tokens = self._sums(counter.counts(words))
        self.recounted = 0

    def _sums(self, leaves: list[int]) -> np.ndarray:
        tree = np.zeros(2 * self.base, dtype=np.int64)
        tree[self.base : self.base + len(leaves)] = leaves
        at = self.base
        while at > 1:
            tree[at // 2 : at] = tree[at : 2 * at].reshape(-1, 2).sum(axis=1)
            at //= 2
        return tree

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(map(self._text, range(len(self.slots))))

    def _text(self, i: int) -> str:
        s = self.slots[i]
        return s if isinstance(s, str) else "".join(s)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            left = int(self.chars[node])
            if at >= start + left:
                start += left
                node += 1
        return node - self.base, start

    def edit(self, start: int, end: int, text: str) -> None:
        """Replaces characters start..end; offsets beyond the text mean its end."""
        size = self.n_chars
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        if not size:
            self.__init__(text, self.counter)
            self.recounted += len(text)
            return
        first, begin = self._find(max(0, min(start - 2, size - 1)))
        reach, more = first, 8
        old, stop = "", begin  # the text of leaves first..reach-1
        while True:
            while reach < len(self.slots) and (stop < end or more > 0):
                more -= stop >= end
                piece = self._text(reach)
                old, stop, reach = old + piece, stop + len(piece), reach + 1
            region = old[: start - begin] + text + old[end - begin :]
            shift = len(text) - (end - start)
            words = self.counter.split(region)
            if reach >= len(self.slots):
                self._put(first, reach, words)
                return
            cuts, at, last = {}, begin, first
            while last < reach:
                at += len(self._text(last))
                last += 1
                if at >= end:
                    cuts[at + shift - begin] = last
            at = 0
            for k, w in enumerate(words):
                at += len(w)
                if at in cuts and at <= len(region) - 2:
                    self._put(first, cuts[at], words[: k + 1])
                    return
            more = 2 * (reach - first)

    def _put(self, first: int, stop: int, words: list[str]) -> None:
        """The leaves first..stop-1 give way to ``words``, which all stand in the first of them."""
        self.slots[first] = words
        self.recounted += sum(map(len, words))
        leaves = np.arange(self.base + first, self.base + stop)
        for i in range(first + 1, stop):
            self.slots[i] = ""
        self.chars[leaves] = self.tokens[leaves] = 0
        self.chars[leaves[0]] = sum(map(len, words))
        self.tokens[leaves[0]] = sum(self.counter.counts(words))
        nodes = leaves
        while nodes[0] > 1:
            nodes = np.unique(nodes // 2)
            for tree in (self.chars, self.tokens):
                tree[nodes] = tree[2 * nodes] + tree[2 * nodes + 1]


def counter(path: str, pattern: str) -> Counter:
    return kept(("counter", path, pattern), lambda: Counter(path, pattern))


COUNTS = "doc_id long, n_chars long, n_pretokens long, n_tokens long, n_edits int, n_chars_edited long, n_tokens_edited long, chars_recounted long"


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Counts of (doc_id, text, edits array<struct<start, end, text>>) before and after the edits.

    Edits apply in order, each to what the ones before have left.  Null texts are empty; null edits, edits
    without a start, and a null array change nothing; a null end means start, a null replacement none.
    Repeated rows are counted each by itself; an empty table gives no rows.
    """

    def count(batches):
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for b in batches:
            rows = []
            for doc, text, edits in zip(b["doc_id"], b["text"], b["edits"]):
                tree = CountTree(text, counter(ranks_path, pattern))
                before = (tree.n_chars, len(tree.slots), tree.n_tokens)
                done = 0
                for e in edits or ():
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["text"] or "")
                        done += 1
                rows.append((doc, *before, done, tree.n_chars, tree.n_tokens, tree.recounted))
            yield dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("edits").cast("array<struct<start:long,end:long,text:string>>").alias("edits"))
    return map_rows(clean, count, COUNTS)


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text and three edits of every document that depend on its id and length alone: an insertion, a deletion, a replacement."""
    n = F.length(F.coalesce("text", F.lit("")))
    part = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), n.cast("long") + 1)
    edit = lambda at, size, text: F.struct(at.alias("start"), (at + size).alias("end"), text.alias("text"))
    edits = F.array(edit(part(1), F.lit(0), F.concat(F.lit(" note "), F.col("doc_id").cast("string"))), edit(part(2), F.lit(7), F.lit("")), edit(part(3), F.lit(3), F.lit("it's 42")))
    return docs.select("doc_id", "text", edits.alias("edits"))
