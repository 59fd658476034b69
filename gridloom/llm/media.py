"""Media columns in Matroska: a writer, a parser of variable-length EBML elements, and packet tables.

``mux`` stores bytes as 8-bit PCM samples in clusters of simple blocks that use every kind of lacing, with
cues at the end.  ``parse`` reads any Matroska stream of elements with known or unknown cluster sizes: it
follows EBML varints, clusters, block groups, the four lacings and cues, and gives one packet row for each
frame with its timestamp, track and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import blocks, map_rows, whole_texts

#: Element ids of the Matroska format.
EBML, DOC_TYPE, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, BITS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACING = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}

UNIT, SAMPLE_RATE, FRAMES, BLOCKS = 192, 8000, 8, 8


# ---------------------------------------------------------------- writing


def varint(n: int, width: int = 0) -> bytes:
    """An EBML size of the least width; all ones is kept for an unknown size."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * w) | n).to_bytes(w, "big")


def signed_varint(n: int) -> bytes:
    w = next(w for w in range(1, 9) if -(1 << 7 * w - 1) < n < 1 << 7 * w - 1)
    return ((1 << 7 * w) | (n + (1 << 7 * w - 1) - 1)).to_bytes(w, "big")


def element(code: int, data: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + varint(len(data)) + data


def uint(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(kind: int, frames: list[bytes]) -> bytes:
    """A block's frames with their lacing header."""
    body = b"".join(frames)
    if kind == 0:
        return body
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in frames[:-1])
    elif kind == 3 and len(frames) > 1:
        head += varint(len(frames[0])) + b"".join(signed_varint(len(b) - len(a)) for a, b in zip(frames, frames[1:-1]))
    return head + body


def simple_block(track: int, at: int, kind: int, frames: list[bytes], key: bool = True) -> bytes:
    return element(SIMPLE_BLOCK, varint(track) + struct.pack(">hB", at, 0x80 * key | kind << 1) + laced(kind, frames))


_HEAD = element(EBML, element(DOC_TYPE, b"matroska"))
_TRACKS = element(TRACKS, element(TRACK, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + uint(CHANNELS, 1) + uint(BITS, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file of ``payload``, whose length must be a positive multiple of 192, as 8-bit samples.

    Blocks of up to 8 frames of 192 samples take the lacings in turn: none (one frame for the block), Xiph
    and EBML (frames of uneven sizes), fixed.  Each cluster of 8 blocks has a cue.
    """
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)))
    body, cues = info + _TRACKS, []
    span = UNIT * FRAMES * BLOCKS
    for c in range(0, len(payload), span):
        time, parts = c * 1000 // SAMPLE_RATE, []
        for k, b in enumerate(range(c, min(c + span, len(payload)), UNIT * FRAMES)):
            data, kind = payload[b : min(b + UNIT * FRAMES, c + span)], k % 4
            if kind == 0:
                frames = [data]
            else:
                n = len(data) // UNIT
                sizes = [UNIT] * n
                if kind != 2:
                    for i in range(0, n - 1, 2):
                        sizes[i : i + 2] = UNIT + 96, UNIT - 96
                frames, at = [], 0
                for s in sizes:
                    frames.append(data[at : at + s])
                    at += s
            parts.append(simple_block(1, b * 1000 // SAMPLE_RATE - time, kind, frames))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, len(body)))))
        body += element(CLUSTER, uint(CLUSTER_TIME, time) + b"".join(parts))
    return _HEAD + element(SEGMENT, body + element(CUES, b"".join(cues)))


# ---------------------------------------------------------------- parsing

_WIDTH = [9 - n.bit_length() if n else 0 for n in range(256)]
_PARENTS = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, TRACK, INFO, CUES, CUE_POINT, CUE_POSITIONS, AUDIO}
_TOP = {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


def read_varint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A value and its width; -1 for an unknown size."""
    w = _WIDTH[data[at]]
    if not w or at + w > len(data):
        raise ValueError(f"no EBML number at byte {at}")
    n = int.from_bytes(data[at : at + w], "big")
    if keep_marker:
        return n, w
    n &= (1 << 7 * w) - 1
    return (-1 if n == (1 << 7 * w) - 1 else n), w


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags and the byte ranges of a block's frames."""
    track, w = read_varint(data, at)
    time, flags = struct.unpack_from(">hB", data, at + w)
    at, kind = at + w + 3, flags >> 1 & 3
    if kind == 0:
        return track, time, flags, [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing of uneven frames")
        sizes = [(end - at) // n] * (n - 1)
    elif n > 1:
        size, w = read_varint(data, at)
        at += w
        sizes.append(size)
        for _ in range(n - 2):
            step, w = read_varint(data, at)
            at, size = at + w, size + step - ((1 << 7 * w - 1) - 1)
            sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing beyond its block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, time, flags, out


def parse(data: bytes) -> dict:
    """packets: (track, cluster, block, lace, time_ms, start, length, key); cues: (time, track, byte of its cluster); tracks; scale; duration."""
    found: dict = {"packets": [], "cues": [], "tracks": [], "clusters": [], "scale": 1_000_000, "duration": None, "doc_type": None}
    seg, cluster, cluster_time, cue, track = 0, -1, 0, [0, 0, 0], {}
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0
    block = 0
    ends, at = [], 0  # of the open parents: (end, element); an unknown size ends with its own parent or the next of its level
    while at < len(data):
        while ends and at >= ends[-1][0]:
            ends.pop()
        begin = at
        code, w = read_varint(data, at, True)
        size, v = read_varint(data, at + w)
        at += w + v
        if ends and code in _TOP:
            while len(ends) > 1 and ends[-1][1] != SEGMENT:
                ends.pop()
        limit = ends[-1][0] if ends else len(data)
        end = limit if size < 0 else at + size
        if end > limit:
            raise ValueError(f"element {code:x} at byte {begin} ends beyond its parent")
        if code in _PARENTS:
            if code == SEGMENT:
                seg = at
            elif code == CLUSTER:
                cluster, cluster_time = cluster + 1, 0
                found["clusters"].append(begin)
            elif code == CUE_POINT:
                cue = [0, 0, 0]
            elif code == TRACK:
                found["tracks"].append(track := {})
            ends.append((end, code))
            continue
        if code == SIMPLE_BLOCK or code == BLOCK:
            t, rel, flags, frames = frames_of(data, at, end)
            time = (cluster_time + rel) * found["scale"] / 1e6
            for k, (start, length) in enumerate(frames):
                found["packets"].append((t, cluster, block, k, time, start, length, bool(flags & 0x80) if code == SIMPLE_BLOCK else None))
            block += 1
        elif code == CLUSTER_TIME:
            cluster_time = number(at, end)
        elif code == SCALE:
            found["scale"] = number(at, end)
        elif code == DURATION:
            found["duration"] = real(at, end)
        elif code == DOC_TYPE:
            found["doc_type"] = data[at:end].decode("ascii", "replace")
        elif code == CUE_TIME:
            cue[0] = number(at, end)
        elif code == CUE_TRACK:
            cue[1] = number(at, end)
        elif code == CUE_CLUSTER:
            found["cues"].append((cue[0], cue[1], seg + number(at, end)))
        elif code in (TRACK_NUMBER, TRACK_TYPE):
            track["number" if code == TRACK_NUMBER else "type"] = number(at, end)
        elif code == CODEC:
            track["codec"] = data[at:end].decode("ascii", "replace")
        at = end
    return found


# ---------------------------------------------------------------- columns


def to_payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT or (UNIT if not raw else 0))


MEDIA = "doc_id long, n_bytes long, media binary"


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text padded and stored; a null or empty text is 192 spaces."""

    def store(batches):
        for b in batches:
            for ids, texts in blocks(b["doc_id"], b["text"]):
                yield {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "media": [mux(to_payload(t)) for t in texts]}

    return map_rows(whole_texts(docs, id_col, text_col), store, MEDIA)


PACKETS = "doc_id long, packet int, track int, cluster int, block int, lace int, time_ms double, start long, length long, keyframe boolean, error string"


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each frame of each media value, in stored order.

    Null media have no rows; media that cannot be parsed have one row, with nulls and the error.
    """

    def packets(batches):
        names = [x.split()[0] for x in PACKETS.split(", ")]
        for b in batches:
            rows = []
            for i, m in zip(b["doc_id"], b["media"]):
                if m is None:
                    continue
                try:
                    rows += [(i, k, *p, None) for k, p in enumerate(parse(m)["packets"])]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((i, *[None] * 9, str(e)))
            yield dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    return map_rows(media.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"`{media_col}` AS media"), packets, PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(found: dict, payload: bytes) -> str:
    """Counts of the packet table and plain statistics of the samples."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64)
    length = np.array([p[6] for p in found["packets"]])
    cued = sum(at == start for (_, _, at), start in zip(found["cues"], found["clusters"]))
    return (
        f"packets={len(length)};clusters={len(found['clusters'])};cues={cued};duration_ms={found['duration']:g}"
        f";shortest={length.min()};longest={length.max()};last_ms={found['packets'][-1][4]:g}"
        f";sum={x.sum()};squares={(x * x).sum()};rises={(np.diff(x) > 0).sum()}"
    )


def media_digest(media: DataFrame) -> DataFrame:
    """Reads stored media back through their packets: digests of the payload and of the file, and features.

    Null media have a row of nulls beside doc_id and n_bytes; media that cannot be parsed raise.
    """

    def digest(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        for b in batches:
            for i in range(0, len(b["doc_id"]), 1000):
                rows = []
                for doc, n, m in zip(b["doc_id"][i : i + 1000], b["n_bytes"][i : i + 1000], b["media"][i : i + 1000]):
                    if m is None:
                        rows.append((doc, n, *[None] * 6))
                        continue
                    found = parse(m)
                    payload = b"".join([m[p[5] : p[5] + p[6]] for p in found["packets"]])
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(found, payload)))
                yield dict(zip(names, map(list, zip(*rows))))

    return map_rows(media, digest, DIGEST)
