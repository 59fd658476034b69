"""Personal data: exact patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns' matches stand.  Around every character that can belong to personal data, a window of text is
cut into tokens; candidate segments of bounded length are scored by features of the whole span, and dynamic
programming chooses boundaries and types jointly.  Segments without such a character are no candidates, so
text outside of windows holds none by definition and whole texts are covered at the speed of one scan.

The field sees a window of ``reach`` characters on both sides of such a character, widened to white space, and
segments of at most ``longest`` tokens: longer ones are not found by it (the patterns have no such bound).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import blocks, map_rows, whole_texts

KINDS = ("email", "ip", "card", "phone")

# ---------------------------------------------------------------- patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A leftmost match never starts behind a digit: it could have started there.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            # the characters before this @ cannot begin a match: none of them leads past it
            done = at + 1
        at = text.find("@", at + 1 if not m else m.end())
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(small_part, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ---------------------------------------------------------------- semi-Markov field

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\S")
CUE = re.compile(r"[0-9@]|[\[({] ?(?:at|AT|dot|DOT) ?[\])}]")
REACH, LONGEST = 40, 17
_TOP = frozenset("com org net edu gov io de fr es uk info".split())
_HINTS = {"email": frozenset("mail email contact write".split()), "ip": frozenset("ip server host address".split()), "card": frozenset("card visa mastercard amex payment".split()), "phone": frozenset("call phone tel mobile fax dial".split())}
_FOUR = re.compile(r"([0-9]+)\W{1,3}([0-9]+)\W{1,3}([0-9]+)\W{1,3}([0-9]+)$")


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int, before: str) -> list[str]:
    """Features of the whole span of tokens i..j-1; ``before`` is the word in front."""
    a, z = tokens[i][0], tokens[j - 1][1]
    s = text[a:z]
    digits = _NOT_DIGIT.sub("", s)
    d, letters = len(digits), sum(c.isalpha() for c in s)
    low = s.lower()
    at_sign = "@" in s or re.search(r"[\[({] ?at ?[\])}]", low) is not None
    f = ["bias", f"tokens:{min(j - i, 12)}"]
    f.append("digits:" + ("0" if not d else "1-6" if d < 7 else "7-8" if d < 9 else "9-12" if d < 13 else "13-19" if d < 20 else "20+"))
    f.append("letters:" + ("0" if not letters else "few" if letters < d else "many"))
    f.append("at" if at_sign else "no at")
    four = _FOUR.match(s)
    if four and all(map(small_part, four.groups())):
        f.append("four dotted" if "." in s else "four parts")
    if 13 <= d <= 19:
        f.append("luhn" if luhn(digits) else "no luhn")
    if not letters and s[0] in "+(" and 9 <= d <= 15:
        f.append("phone start")
    if not letters and re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", s):
        f.append("national phone")
    if not letters and re.fullmatch(r"(?:[0-9]{4}[ .-]?){3,4}[0-9]{1,4}", s):
        f.append("groups of four")
    if at_sign and low.rpartition(".")[2].strip() in _TOP or at_sign and re.search(r"dot ?[\])}] ?(?:com|org|net|edu)$", low):
        f.append("top domain")
    if not s[0].isalnum() and s[0] not in "+(":
        f.append("odd start")
    if not s[-1].isalnum():
        f.append("odd end")
    if "(" in s and s.count("(") != s.count(")"):
        f.append("open bracket")
    glued = (a > 0 and not text[a - 1].isspace() and text[a - 1] not in "(<[:,;\"'=") or (z < len(text) and text[z].isalnum())
    f.append("glued" if glued else "free")
    if z < len(text) and text[z] in "@.-+/_" and z + 1 < len(text) and text[z + 1].isalnum():
        f.append("goes on")
    spaces = sum(c.isspace() for c in s)
    f.append(f"spaces:{min(spaces, 4)}")
    for kind, words in _HINTS.items():
        if before in words:
            f.append(f"hint:{kind}")
    return f


def candidates(text: str, tokens: list[tuple[int, int]], longest: int = LONGEST) -> Iterator[tuple[int, int, list[str]]]:
    """Segments of at most ``longest`` tokens that hold a digit or an at sign and begin and end sensibly, in order of their start, then end."""
    cue = [bool(re.search(r"[0-9@]", text[a:z])) or text[a:z].lower() in ("at", "dot") for a, z in tokens]
    before = ""
    for i, (a, z) in enumerate(tokens):
        if text[a].isalnum() or text[a] in "+(":
            near = False
            for j in range(i + 1, min(len(tokens), i + longest) + 1):
                near = near or cue[j - 1]
                if tokens[j - 1][0] > z and tokens[j - 1][0] - tokens[j - 2][1] > 2:
                    break
                if near and text[tokens[j - 1][1] - 1].isalnum():
                    yield i, j, span_features(text, tokens, i, j, before)
        word = text[a:z].lower()
        if word[0].isalpha():
            before = word


class SemiMarkovField:
    """Weights of (type, feature); tokens outside of entities score 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = {f: tuple(map(float, w)) for f, w in weights.items()}

    def score(self, features: list[str]) -> list[float]:
        """Of a segment as each kind."""
        out = [0.0] * len(KINDS)
        for f in features:
            if w := self.weights.get(f):
                out = [x + y for x, y in zip(out, w)]
        return out

    def spans(self, text: str, longest: int = LONGEST) -> list[tuple[int, int, int]]:
        """The best joint choice of non-overlapping (kind, start, end).

        Candidates are scored as they come and only the best way to each token is kept, so memory grows with the tokens.
        """
        tokens = [m.span() for m in TOKEN.finditer(text)]
        best, back, done = [0.0] + [-math.inf] * len(tokens), [-1] * (len(tokens) + 1), 0

        def pass_over(upto: int) -> None:
            """Tokens before ``upto`` may also be no part of a segment, which counts among equals."""
            nonlocal done
            while done < upto:
                if best[done] >= best[done + 1]:
                    best[done + 1], back[done + 1] = best[done], -1
                done += 1

        for i, j, features in candidates(text, tokens, longest):
            pass_over(i)
            score = self.score(features)
            value = max(score)
            if value > 0 and best[i] + value > best[j]:
                best[j], back[j] = best[i] + value, len(KINDS) * i + score.index(value)
        pass_over(len(tokens))
        out, t = [], len(tokens)
        while t:
            if back[t] < 0:
                t -= 1
            else:
                i, kind = divmod(back[t], len(KINDS))
                out.append((kind, tokens[i][0], tokens[t - 1][1]))
                t = i
        return out[::-1]


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, rate: float = 0.5, l2: float = 1e-3, seed: int = 5) -> SemiMarkovField:
    """Maximum likelihood by AdaGrad, with exact segment marginals from forward and backward sums."""
    names: dict[str, int] = {}
    data = []
    for text, gold in examples:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        segments = list(candidates(text, tokens))
        if not segments:
            continue
        want = {(a, z): k for k, a, z in gold}
        x = [np.array([names.setdefault(f, len(names)) for f in fs]) for _, _, fs in segments]
        y = [want.get((tokens[i][0], tokens[j - 1][1]), -1) for i, j, _ in segments]
        data.append((len(tokens), [(i, j) for i, j, _ in segments], x, y))
    w, seen, rng = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-6), random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, spans, x, y in data:
            score = np.array([w[f].sum(axis=0) for f in x])
            total = np.logaddexp.reduce(score, axis=1)
            by_end: list = [[] for _ in range(n + 1)]
            by_start: list = [[] for _ in range(n + 1)]
            for k, (i, j) in enumerate(spans):
                by_end[j].append(k)
                by_start[i].append(k)
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for t in range(1, n + 1):
                alpha[t] = _log_sum([alpha[t - 1]] + [alpha[spans[k][0]] + total[k] for k in by_end[t]])
            for t in range(n - 1, -1, -1):
                beta[t] = _log_sum([beta[t + 1]] + [beta[spans[k][1]] + total[k] for k in by_start[t]])
            place = np.array([alpha[i] + beta[j] - alpha[n] for i, j in spans])
            off = np.exp(score + place[:, None])
            for k, kind in enumerate(y):
                if kind >= 0:
                    off[k, kind] -= 1
            grad = np.zeros_like(w)
            for f, g in zip(x, off):
                if np.abs(g).max() > 1e-4:
                    grad[f] += g
            rows = np.flatnonzero(np.abs(grad).sum(axis=1))
            g = grad[rows] + l2 * w[rows]
            seen[rows] += g * g
            w[rows] -= rate * g / np.sqrt(seen[rows])
    return SemiMarkovField({f: w[i] for f, i in names.items()})


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


# ---------------------------------------------------------------- labelled examples

_WORDS = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would".split()


def labelled_examples(n: int = 420, seed: int = 11) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up sentences with the places of the personal data in them, and with look-alikes that are none."""
    rng = random.Random(seed)
    number = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    word = lambda: rng.choice(_WORDS) if rng.random() < 0.6 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))

    def card(valid: bool) -> str:
        while True:
            d = "4" + number(15)
            if luhn(d) == valid:
                sep = rng.choice(["", "", " ", "-", "."])
                return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        user, host, top = word() + rng.choice(["", ".", "_"]) + number(rng.randint(0, 2)), word() + number(1), rng.choice(["com", "org", "net", "example.com"])
        user = user.rstrip("._") or "me"
        form = rng.randrange(4)
        return f"{user}@{host}.{top}" if form < 2 else f"{user} (at) {host}.{top}" if form == 2 else f"{user} [at] {host} [dot] com"

    def ip() -> str:
        return rng.choice([".", ".", "[.]", " . "]).join(str(rng.randrange(256)) for _ in range(4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(20, 98)} {a} {b} {c}", f"+1-{a}-{b}-{c}"])

    def none() -> str:
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 40])))
        return rng.choice([f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}", f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{number(2)}:{number(2)}", f"${number(3)}.{number(2)}", number(rng.randint(1, 8)), f"password={hexes}", f'token = "{hexes}"', "AKIA" + hexes[:16].upper(), card(False), f"{rng.randint(256, 999)}.{number(3)}.{number(1)}.{number(1)}", f"page {number(2)} of {number(3)}", f"{number(4)} {number(1)}", f"@{word()}", f"{number(2)} @ {number(1)}"])

    makers = [email, ip, lambda: card(True), phone]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(word() for _ in range(rng.randint(1, 5))) + " "
            kind = rng.randrange(7)
            if kind < 4:
                if rng.random() < 0.3:
                    text += rng.choice(sorted(_HINTS[KINDS[kind]])) + " "
                value = makers[kind]()
                gold.append((kind, len(text), len(text) + len(value)))
            else:
                value = none()
            text += value + rng.choice([" ", ", ", ". ", "\n"])
        out.append((text + word(), gold))
    return out


_FIELD: list = []


def default_field() -> SemiMarkovField:
    """Trained on the made-up sentences; the same in every process."""
    if not _FIELD:
        _FIELD.append(train(labelled_examples()))
    return _FIELD[0]


# ---------------------------------------------------------------- operator


def windows(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Stretches around the characters that personal data can hold, widened to white space, without overlap."""
    start, end, done = -1, -1, 0
    for m in CUE.finditer(text):
        a, z = m.span()
        if start >= 0 and a - reach <= end:
            end = max(end, z + reach)
            continue
        if start >= 0:
            yield (found := _widened(text, max(start, done), end, done))
            done = found[1]
        start, end = max(a - reach, 0), z + reach
    if start >= 0:
        yield _widened(text, max(start, done), end, done)


def _widened(text: str, a: int, z: int, done: int) -> tuple[int, int]:
    while done < a and not text[a - 1].isspace():
        a -= 1
    while z < len(text) and not text[z].isspace():
        z += 1
    return a, min(z, len(text))


class Taken:
    """Where spans lie, for tests of overlap by bisection."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, z in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], z)
            else:
                self.starts.append(a)
                self.ends.append(z)

    def meets(self, a: int, z: int) -> bool:
        k = bisect_left(self.starts, z) - 1  # the last stretch that begins before z
        return k >= 0 and self.ends[k] > a


def all_spans(text: str, field: SemiMarkovField, reach: int = REACH, longest: int = LONGEST) -> tuple[list, list]:
    """(base spans, base and added spans), each ordered by kind and start; an added span overlaps no other."""
    base = base_spans(text)
    taken = Taken([(a, z) for _, a, z in base])
    added = []
    for a, z in windows(text, reach):
        added += [(kind, s + a, e + a) for kind, s, e in field.spans(text[a:z], longest) if not taken.meets(s + a, e + a)]
    return base, sorted(base + added)


SPANS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"
_named = lambda spans: [{"kind": KINDS[k], "start": a, "end": z} for k, a, z in spans]


def find_personal_data(docs: DataFrame, field: SemiMarkovField | None = None, reach: int = REACH, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and all spans of every whole text, as code point offsets with exclusive ends.

    Null and empty texts have none; repeated rows give repeated rows; an empty table none.  The field is
    trained on made-up sentences where none is given; ``reach`` and ``longest`` bound what it sees.  Time grows with the
    text, at most ``longest`` candidates a token.
    """
    model = field or default_field()

    def find(batches):
        for b in batches:
            for ids, texts in blocks(b["doc_id"], b["text"]):
                both = [all_spans(t, model, reach, longest) for t in texts]
                yield {"doc_id": ids, "base": [_named(x) for x, _ in both], "spans": [_named(x) for _, x in both]}

    return map_rows(whole_texts(docs, id_col, text_col), find, SPANS)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans, their sha256 and all spans as text."""
    joined = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return found.selectExpr("doc_id", *[f"CAST(size(filter(base, x -> x.kind = '{k}')) AS long) AS n_{k}" for k in KINDS], f"sha2({joined('base')}, 256) AS base_sha256", f"{joined('spans')} AS spans")


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in sorted(spans)).encode()).hexdigest()
