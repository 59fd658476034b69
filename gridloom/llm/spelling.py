"""Spelling variants: words one edit apart, by bands of letter-parity masks.

A word's mask has a bit for each of 48 classes of letters, set where the word holds an odd number of them.  One
inserted or deleted letter flips one bit at most, a replaced one two, so of three bands of 16 bits at least one is
the same in both words.  Words meet in equal bands of equal or next lengths, and each pair is then verified.

A band of a short mask has few values (about 2**6 over real letters), so the join's key holds also the half of the
word that the edit cannot have touched: an edit of two words whose shorter one has m letters leaves the first m // 2
letters alone or the last m // 2.  No pair is lost by it; pairs that meet by several keys are verified under the
first of them only.  All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, whole_texts
from .linedup import LOWER, UPPER

LETTERS = "A-Za-zÀ-ÿ"
BITS, BANDS = 16, 3


def garbled_words(docs: DataFrame, shortest: int = 7, one_in: int = 31) -> DataFrame:
    """(word), one row for each run of letters of whole texts, with planted misspellings.

    A-Z are lower-cased.  Where ``one_in`` divides the CRC-32 h of ``<doc_id>:<run>``, the run loses its code point
    h % length.  Words shorter than ``shortest`` after that are left out.  Null texts have no words; a null id is
    written as nothing.
    """
    runs = whole_texts(docs).select("doc_id", F.explode(F.split("text", f"[^{LETTERS}]+", -1)).alias("run"))
    runs = runs.where(F.length("run") >= shortest)
    ascii_only = F.length("run") == F.octet_length("run")
    runs = runs.withColumn("run", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest)


def counted(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, n) of the words that occur at least ``least`` times; null words are left out."""
    return words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def parity_mask(word: Column) -> Column:
    """A word's mask: neighbouring letters go to different bands, so that the letters' frequencies are spread over them."""
    bit = lambda c: F.when(c == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), (F.ascii(c) % BANDS * BITS + F.floor(F.ascii(c) / BANDS) % BITS).cast("int")))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(bit(c)))


def _band(mask: Column, k: int) -> Column:
    return F.shiftrightunsigned(mask, BITS * k).bitwiseAND(F.lit((1 << BITS) - 1).cast("long"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of words (word, n) that are exactly one edit apart.

    Words must be distinct.  Words of one letter have no halves: they meet in their bands alone.
    """
    masked = words.select("word", "n", F.length("word").alias("len"), parity_mask(F.col("word")).alias("mask"))

    def keys(shorter: Column) -> list[Column]:
        """A word's keys in pairs whose shorter word has so many letters."""
        half = F.floor(shorter / 2).cast("int")
        found = []
        for side in (0, 1):
            text = F.substring(F.col("word"), F.lit(1), half) if side == 0 else F.when(half > 0, F.substring(F.col("word"), -half, half)).otherwise("")
            for k in range(BANDS):
                at = side * BANDS + k
                found.append(F.struct(F.xxhash64(shorter, F.lit(at), text, _band(F.col("mask"), k)).alias("key"), F.lit(at).cast("byte").alias("at")))
        return found

    own = keys(F.col("len"))
    left = masked.select("word", "n", "mask", F.inline(F.array(*own)))
    right = masked.select("word", "n", "mask", F.inline(F.array(*own, *keys(F.col("len") - 1))))
    a, b = left.alias("a"), right.alias("b")
    col = F.col
    differ = col("a.mask").bitwiseXOR(col("b.mask"))
    first_band = F.when(_band(differ, 0) == 0, 0).when(_band(differ, 1) == 0, 1).otherwise(2)
    half = F.floor(F.length("a.word") / 2).cast("int")
    same_start = F.substring(col("a.word"), F.lit(1), half) == F.substring(col("b.word"), F.lit(1), half)
    gap = F.length("b.word") - F.length("a.word")
    met = a.join(
        b,
        (col("a.key") == col("b.key"))
        & (col("a.at") == col("b.at"))
        & ((gap == 1) | ((gap == 0) & (col("a.word") < col("b.word"))))
        & (F.bit_count(differ) <= F.when(gap == 0, 2).otherwise(1))
        & (col("a.at") % BANDS == first_band)
        & ((col("a.at") < BANDS) | ~same_start)
        & (F.levenshtein(col("a.word"), col("b.word"), 1) == 1),
    )
    pair = lambda x, y: F.struct(col(f"{x}.word").alias("word"), col(f"{x}.n").alias("n"), col(f"{y}.word").alias("near"), col(f"{y}.n").alias("near_n"))
    return met.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))


def spelling_forms(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n of each of the distinct words (word, n).

    A word's form is its near word of the largest n (ties: the first in code-point order), where that is at least
    ``times`` the word's own n, else null.  The root is where the forms lead in the end, the word itself if it has
    none.  Counts rise ``times``-fold from form to form and fit into 64 bits, so chains are short and have no cycles.
    An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    words = settle(words.select("word", F.col("n").cast("long").alias("n")))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    told = words.join(best, "word", "left")
    is_form = -F.col("best.minus") >= times * F.col("n")
    told = settle(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")))
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = True
    while moved:  # each round doubles the steps: six at most
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = settle(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count() > 0
        roots = step.select("word", "root")
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
