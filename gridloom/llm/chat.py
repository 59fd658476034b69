"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: one row with the whole text of all preceding turns as
context and that reply, which alone is trainable (its span is the loss mask).  Turns after the last assistant
turn make a last row without a loss span, so the output holds every turn.  The expansion's total length grows
with the square of a conversation's turns, which is the method's nature; rows are passed on in small
batches, so a task holds the text of one conversation and a batch.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

START, END = "<|im_start|>", "<|im_end|>\n"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: each ``<``, backslashes, ``|`` gets a further backslash."""
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long"


def _columns(schema: str, rows: list[tuple]) -> dict[str, list]:
    names = [x.split()[0] for x in schema.split(", ")]
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def prefix_examples(turns: DataFrame, batch_chars: int = 4_000_000) -> DataFrame:
    """Examples of (conv_id, turn, role, text), the rows of a conversation in order of turn, role and text.

    ``example`` counts from 0 in a conversation; the loss span is in characters of the example's text, its end
    exclusive, and null in the row of turns behind the last assistant turn.  Null
    texts and roles are empty; null turns come first; rows without a conv_id form one conversation; repeated
    rows are repeated turns; an empty table has no examples; other columns are not read.
    """

    def fold(batches):
        conv, live, parts, size, start, example = None, False, [], 0, 0, 0
        rows, waiting = [], 0
        for b in batches:
            for c, role, text in zip(b["conv_id"], b["role"], b["text"]):
                if not live or c != conv:
                    if live and size > start:
                        rows.append((conv, example, "".join(parts), None, None))
                        waiting += size
                    conv, live, parts, size, start, example = c, True, [], 0, 0, 0
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                parts += head, body, END
                at = size + len(head)
                size = at + len(body) + len(END)
                if role == "assistant":
                    parts = ["".join(parts)]
                    rows.append((conv, example, parts[0], at, at + len(body)))
                    waiting += size
                    start, example = size, example + 1
                if waiting > batch_chars:
                    yield _columns(EXAMPLES, rows)
                    rows, waiting = [], 0
        if live and size > start:
            rows.append((conv, example, "".join(parts), None, None))
        yield _columns(EXAMPLES, rows)

    clean = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(ordered, fold, EXAMPLES)


TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)
TOLD = "conv_id long, example long, n_turns long, turns_sha256 string, said string, chars long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _told(text: str, start: int | None, end: int | None) -> tuple:
    """Number and digest of an example's turns, and the text under its mask, which must be the last turn's and an assistant's."""
    turns, n, at, last = hashlib.sha256(), 0, 0, None
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
        n, at, last = n + 1, m.end(), m
    if at != len(text) or not n or (start is not None and ((start, end) != last.span(2) or last[1] != "assistant")):
        raise ValueError("not an example: its text does not read as turns, or its mask is not the last assistant turn")
    return n, turns.hexdigest(), None if start is None else unescape(text[start:end])


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of conversations from their examples, whose rows may come in any order.

    Every example is read as turns; it must hold those that its mask says, and a conversation's examples must be
    numbered from 0 without a gap or repeat, else this raises.  What is digested over a conversation, the
    texts under the masks, is as long as the conversation itself and is streamed in order.
    """

    def tell(batches):
        for b in batches:
            rows = [(c, k, *_told(t, a, z), len(t)) for c, k, t, a, z in zip(*(b[x] for x in ("conv_id", "example", "text", "loss_start", "loss_end")))]
            yield _columns(TOLD, rows)

    def digest(batches):
        conv, live = None, False
        n = turns = loss = loss_chars = chars = seen = None
        for b in batches:
            rows = []
            for c, k, n_turns, sha, said, size in zip(*(b[x] for x in ("conv_id", "example", "n_turns", "turns_sha256", "said", "chars"))):
                if not live or c != conv:
                    if live:
                        rows.append((conv, n, turns, loss_chars, loss.hexdigest(), chars))
                    conv, live, loss, loss_chars, chars, seen = c, True, hashlib.sha256(), 0, 0, 0
                if k != seen:
                    raise ValueError(f"conversation {c}: example {seen} is missing or repeated")
                seen, n, turns, chars = seen + 1, n_turns, sha, chars + size
                if said is not None:
                    loss.update(said.encode())
                    loss_chars += len(said)
            yield _columns(DIGEST, rows)
        if live:
            yield _columns(DIGEST, [(conv, n, turns, loss_chars, loss.hexdigest(), chars)])

    told = map_rows(examples.select("conv_id", "example", "text", "loss_start", "loss_end"), tell, TOLD)
    return map_rows(told.repartition("conv_id").sortWithinPartitions("conv_id", "example"), digest, DIGEST)
