"""Line dedup and spelling variants against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.llm import linedup, spelling

SCHEMA = "doc_id long, text string"


def plain_lines(rows, shortest=20, enough=3):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    order = lambda i: -(2**63) if i is None else i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= shortest and len(holders[key(x)]) >= enough and order(i) < max(map(order, holders[key(x)])))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines_of(frame):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in frame.collect()), key=repr)


def random_rows(n, seed):
    rng = random.Random(seed)
    pool = [f"{'  ' * (k % 3)}This line No {k} stands in MANY ÄÖ documents{chr(9) * (k % 2)}" for k in range(30)] + ["short", "", "exactly twenty chars", "nineteen characters"]
    return [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(n)]


@pytest.mark.parametrize("batches", [1, 2, 5, 9])
def test_lines_as_plain(spark, batches):
    rows = random_rows(120, batches)
    found = linedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), batches=batches)
    assert lines_of(found) == plain_lines(rows)


def test_lines_odd_inputs(spark):
    common = "A line that is common to all of them"
    long = "\n".join([common] * 3000 + [f"line number {k} of the long text" for k in range(3000)])
    rows = [(1, None), (2, ""), (3, common), (3, common), (3, common + "\nmore"), (None, common + "\nof no id"), (5, long), (6, "\n\n" + common.upper() + "\r\n"), (-7, common + "\x85"), (8, "x" * 200_000)]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], SCHEMA + ", pos string, hi int")
    assert lines_of(linedup.dedup_lines(frame)) == plain_lines(rows)
    assert lines_of(linedup.dedup_lines(spark.createDataFrame([], SCHEMA))) == []
    two = [(3, common), (3, common), (4, common)]  # repeated rows are one document
    assert lines_of(linedup.dedup_lines(spark.createDataFrame(two, SCHEMA))) == plain_lines(two)
    nothing = [(1, "a"), (2, None)]
    assert lines_of(linedup.dedup_lines(spark.createDataFrame(nothing, SCHEMA))) == plain_lines(nothing)


def test_frequent_lines_are_looked_up_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(linedup, "FREQUENT", 2)
    monkeypatch.setattr(linedup, "max", lambda a, b: b, raising=False)
    rows = random_rows(60, 3) + [(1000 + k, "one line that stands in everything") for k in range(400)]
    assert lines_of(linedup.dedup_lines(spark.createDataFrame(rows, SCHEMA))) == plain_lines(rows)


def test_runs_leave_out_what_is_settled_and_go_on_in_a_later_session(spark, tmp_path):
    first = spark.createDataFrame([(i, "the very same line everywhere") for i in range(10, 20)], SCHEMA)
    later = spark.createDataFrame([(i, f"the very same line everywhere\nand one line of its own {i}") for i in range(5)], SCHEMA)
    runs = linedup.LineRuns(spark, str(tmp_path / "runs"), 4)
    runs.add(linedup.line_keys(first), 1000)
    runs.add(linedup.line_keys(later), 1000)
    newest = spark.table(runs.runs[-1][2])
    assert newest.count() == 5  # the settled key is not written again
    again = linedup.LineRuns(spark, str(tmp_path / "runs"), 4, state=runs.state)
    again.add(linedup.line_keys(spark.createDataFrame([(99, "the very same line everywhere")], SCHEMA)), 1000)
    assert [level for level, _ in again.state] == [1]  # three runs have become one of the next level
    assert [(r.docs, r.last) for r in again.repeated().collect()] == [(11, 99)]
    plan = again._merged([again.runs[0], again.runs[0]])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close(), again.close()


def plain_words(rows):
    import re

    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(words):
    out = {}
    for w, n in words.items():
        near = [(-words[x], x) for x in words if one_edit(w, x)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= 10 * n else None
        out[w] = [form, n, len(near), -best[0] if form else None]
    rows = []
    for w, (form, n, k, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, form_n))
    return sorted(rows)


def forms_of(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def test_words_and_forms_as_plain(spark):
    rng = random.Random(5)
    letters = "abeinrstÀßéÿ×÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 14))) for _ in range(60)]

    def bent(w):
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        return w[:at] + (rng.choice(letters) if kind else "") + w[at + (kind != 1) :]

    rows = []
    for i in range(300):
        words = [w if rng.random() < 0.8 else bent(bent(w) if rng.random() < 0.3 else w) for w in rng.choices(base[:20] * 6 + base, k=60)]
        rows.append((i, " ".join(w.title() if rng.random() < 0.1 else w for w in words) + "1x,y_Straße"))
    rows += [(None, "wordless wordless"), (7, None), (8, ""), (9, "z" * 50_000), (9, "z" * 50_000)]
    words = plain_words(rows)
    counts = spelling.counted(spelling.garbled_words(spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA + ", word int")))
    assert {r.word: r.n for r in counts.collect()} == words
    expected = plain_forms(words)
    assert sum(r[1] is not None for r in expected) > 20
    assert forms_of(spelling.spelling_forms(counts)) == expected


def test_short_words_ties_chains_and_nothing(spark):
    words = {"a": 1, "b": 30, "c": 30, "": 5, "ab": 400, "abc": 4000, "abcd": 39_999, "xyz": 3, "xyzz": 29}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert forms_of(spelling.spelling_forms(frame)) == plain_forms(words)
    assert forms_of(spelling.spelling_forms(frame.limit(0))) == []
    assert spelling.counted(spark.createDataFrame([(None,), (None,), ("w",)], "word string")).collect() == []


def test_one_edit_flips_two_bits_at_most(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéîøÿ") for _ in range(rng.randrange(1, 12)))
        at = rng.randrange(len(w))
        pairs += [(w, w[:at] + w[at + 1 :], 1), (w, w[:at] + "q" + w[at + 1 :], 2), (w, w[:at] + "é" + w[at:], 1)]
    frame = spark.createDataFrame(pairs, "a string, b string, most int")
    flips = F.bit_count(spelling.parity_mask(F.col("a")).bitwiseXOR(spelling.parity_mask(F.col("b"))))
    assert frame.where(flips > F.col("most")).count() == 0
