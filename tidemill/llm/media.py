"""Media columns: Matroska files to packet tables.

The reader follows variable-length EBML elements: identifiers of 1 to 4 bytes,
sizes of 1 to 8 bytes or unknown (the element then ends where an element begins
that cannot lie in it, or with its parent).  Clusters give timestamps, blocks
give track, relative time and lacing (none, Xiph, EBML, fixed size), cues give
seek points.  A packet is one frame: track, timestamp, byte range in the file.

A frame of a group of blocks is a keyframe if the group refers to no other block.  Frames of a lace follow one another by
the track's default duration, or by their own length for PCM; without either they share the block's time.  Frames whose
tracks strip a header or deflate their content are given as stored, with the track's encoding beside them, and
``payload`` undoes it; other compression and encryption are named as the file's error.

Null bytes have no packets.  Bytes that break off or are no Matroska give the
packets before the break and the error's text, never an exception.  Equal bytes
give equal tables; rows are told apart by nothing, so repeated and null ids do no harm.  Packets of one time stand in file order.  Work is per row, without shuffles; a
file, however long, is held in memory whole, its frames as views.  Columns besides id and media are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import crc, documents, fields, mapped, named

# Fixed values of the public Matroska and EBML formats (RFC 8794, RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
SCALE, DURATION, DOC_TYPE = 0x2AD7B1, 0x4489, 0x4282
NUMBER, UID, KIND, LACING, CODEC, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK = 0xE7, 0xA3, 0xA1
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
REFERENCE, DEFAULT_DURATION = 0xFB, 0x23E383
ENCODINGS, ENCODING, COMPRESSION, ENCRYPTION, ALGORITHM, SETTINGS, SCOPE = 0x6D80, 0x6240, 0x5034, 0x5035, 0x4254, 0x4255, 0x5032
ALGORITHMS = {0: "zlib", 1: "bzlib", 2: "lzo1x", 3: "header"}
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, VOID = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469, 0xEC
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, ENCODINGS, ENCODING, COMPRESSION, ENCRYPTION}
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
UNSIGNED = {SCALE, NUMBER, UID, KIND, LACING, CHANNELS, DEPTH, TIMESTAMP, CUE_TIME, CUE_TRACK, CUE_CLUSTER, DEFAULT_DURATION, ALGORITHM, SCOPE}
FLOATS = {DURATION, RATE}

#: Of the files written here: samples a second, bytes a frame, frames a block, blocks a cluster.
HERTZ, FRAME, FRAMES, BLOCKS = 8000, 1024, 8, 4


@dataclass
class Media:
    """What a file holds; times in nanoseconds, offsets in bytes from the file's start."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # offset, timestamp
    packets: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # track, timestamp, offset, length, keyframe, lacing
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # timestamp, track, cluster's offset
    encodings: dict[int, tuple[str, bytes]] = field(default_factory=dict)  # track: compression, header
    error: str = ""


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """The number at ``at`` and its length; None for the reserved size of all ones (unknown)."""
    if at >= len(data):
        raise ValueError(f"a number is cut off at byte {at}")
    first = data[at]
    if not first:
        raise ValueError(f"a number longer than 8 bytes at byte {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError(f"a number is cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        if n > 4:
            raise ValueError(f"an identifier longer than 4 bytes at byte {at}")
        return value, n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), n


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block's body and where the first frame begins."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise ValueError(f"a block is cut off at byte {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:  # Xiph: sums of bytes, 255 goes on
        for _ in range(n - 1):
            size = 0
            while True:
                b, at = data[at], at + 1
                size += b
                if b != 255:
                    break
            sizes.append(size)
    elif lacing == 3:  # EBML: the first size, then signed differences
        for i in range(n - 1):
            value, k = vint(data, at)
            if value is None:
                raise ValueError(f"a reserved lace size at byte {at}")
            at += k
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * k - 1) - 1))
    else:  # fixed size
        if (end - at) % n:
            raise ValueError(f"{end - at} bytes are not {n} frames of one size")
        return [(end - at) // n] * n, at
    last = end - at - sum(sizes)
    if min([last, *sizes]) < 0:
        raise ValueError(f"lace sizes pass the block's end at byte {end}")
    return [*sizes, last], at


def _block(data: bytes, at: int, end: int, base: int, out: Media, simple: bool) -> None:
    track, k = vint(data, at)
    at += k
    if at + 3 > end:
        raise ValueError(f"a block is cut off at byte {at}")
    (relative,), flags = struct.unpack_from(">h", data, at), data[at + 2]
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, lacing)
    entry = next((t for t in out.tracks if t.get(NUMBER) == track), {})
    step, each = entry.get("step", 0), entry.get(DEFAULT_DURATION, 0)  # nanoseconds a byte, a frame
    header = len(out.encodings.get(track, ("", b""))[1])
    time = (base + relative) * out.scale
    for size in sizes:
        out.packets.append((track, round(time), at, size, flags >> 7 if simple else 0, lacing))
        at += size
        time += (size + header) * step if step else each


def parse(data: bytes | None) -> Media:
    """Everything that can be read of a file; ``error`` says why reading stopped early."""
    out = Media()
    if not data:
        return out
    start = [0]  # of the segment's content

    def elements(at: int, end: int, inside: int, into: dict) -> int:
        while at < end:
            here = at
            name, k = vint(data, at, True)
            if inside == CLUSTER and into.get("open") and (name in TOP or name == SEGMENT):
                return here  # an element of the level above ends a cluster of unknown size
            size, m = vint(data, at + k)
            at += k + m
            stop = end if size is None else at + size
            cut = stop > end
            if cut:
                stop = end
                if name not in (SEGMENT, CLUSTER):
                    raise ValueError(f"element {name:X} at byte {here} passes the end")
            if name in MASTERS:
                own: dict = {"open": size is None, "at": here}
                if name == SEGMENT:
                    start[0] = at
                elif name == BLOCK_GROUP:
                    own |= {TIMESTAMP: into.get(TIMESTAMP, 0), "first": len(out.packets)}
                at = elements(at, stop, name, own)
                at = at if size is None else stop
                finish(name, own, into)
                if cut:
                    raise ValueError(f"element {name:X} at byte {here} passes the end")
                continue
            if name in UNSIGNED:
                into[name] = int.from_bytes(data[at:stop], "big")
                if name == TIMESTAMP:
                    out.clusters.append((into["at"], into[name] * out.scale))
                elif name == SCALE:
                    out.scale = into[name]
            elif name in FLOATS:
                into[name] = {0: 0.0, 4: 0.0, 8: 0.0}[stop - at] if stop == at else struct.unpack(">f" if stop - at == 4 else ">d", data[at:stop])[0]
            elif name == REFERENCE:
                into["refers"] = True
            elif name == SETTINGS:
                into[name] = data[at:stop]
            elif name in (CODEC, DOC_TYPE):
                into[name] = data[at:stop].rstrip(b"\0").decode("ascii", "replace")
            elif name in (SIMPLE_BLOCK, BLOCK):
                _block(data, at, stop, into.get(TIMESTAMP, 0), out, name == SIMPLE_BLOCK)
            at = stop
        return at

    def finish(name: int, own: dict, into: dict) -> None:
        if name == EBML:
            out.doc_type = own.get(DOC_TYPE, "")
        elif name == INFO:
            out.duration = own.get(DURATION, 0.0) * out.scale
        elif name == AUDIO:
            into["audio"] = own
        elif name == BLOCK_GROUP:
            out.packets[own["first"] :] = [(*p[:4], int("refers" not in own), p[5]) for p in out.packets[own["first"] :]]
        elif name == COMPRESSION:
            into["compression"] = (ALGORITHMS.get(own.get(ALGORITHM, 0), "unknown"), own.get(SETTINGS, b""))
        elif name == ENCRYPTION:
            into["compression"] = ("encryption", b"")
        elif name == ENCODING:
            into.setdefault("encodings", []).append((own.get(SCOPE, 1), *own.get("compression", ("zlib", b""))))
        elif name == ENCODINGS:
            into["encodings"] = own.get("encodings", [])
        elif name == TRACK_ENTRY:
            audio = own.get("audio", {})
            if own.get(CODEC, "").startswith("A_PCM") and audio.get(RATE):
                own["step"] = 1e9 / (audio[RATE] * audio.get(CHANNELS, 1) * max(1, audio.get(DEPTH, 8) // 8))
            out.tracks.append(own)
            for scope, kind, header in own.get("encodings", []):
                if kind not in ("zlib", "header") or scope != 1 or len(own["encodings"]) > 1:
                    raise ValueError(f"track {own.get(NUMBER, 0)} has content that is not read: {kind}, scope {scope}")
                out.encodings[own.get(NUMBER, 0)] = (kind, header if kind == "header" else b"")
        elif name == CUE_POSITIONS:
            into.setdefault("positions", []).append((own.get(CUE_TRACK, 0), start[0] + own.get(CUE_CLUSTER, 0)))
        elif name == CUE_POINT:
            out.cues += [(own.get(CUE_TIME, 0) * out.scale, track, at) for track, at in own.get("positions", [])]

    try:
        elements(0, len(data), 0, {})
        if out.doc_type not in ("matroska", "webm"):
            out.error = f"document type {out.doc_type!r}"
    except (ValueError, IndexError, struct.error, KeyError, RecursionError) as e:
        out.error = f"{type(e).__name__}: {e}"
    return out


def _size(n: int) -> bytes:
    k = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], ebml: bool) -> tuple[int, bytes]:
    """Lacing bits and a block's body."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 2, head + b"".join(frames)
    if not ebml:
        return 1, head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1]) + b"".join(frames)
    head += _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        k = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
        head += (b - a + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return 3, head + b"".join(frames)


def mux(samples: bytes, hertz: int = HERTZ) -> bytes:
    """A Matroska file with one track of 8-bit PCM; the same samples give the same bytes.

    Blocks of frames of one size use fixed-size lacing, others Xiph or EBML lacing in turn.
    """
    clusters, cues, place = [], [], 0
    info = _element(INFO, _number(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / hertz)) + _element(0x4D80, b"tidemill") + _element(0x5741, b"tidemill"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", hertz)) + _number(CHANNELS, 1) + _number(DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK_ENTRY, _number(NUMBER, 1) + _number(UID, 1) + _number(KIND, 2) + _number(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + audio))
    place = len(info) + len(tracks)
    each = FRAME * FRAMES
    for c in range(0, len(samples), each * BLOCKS):
        ms = c * 1000 // hertz
        body = _number(TIMESTAMP, ms)
        for b in range(c, min(len(samples), c + each * BLOCKS), each):
            chunk = samples[b : b + each]
            lacing, laced = _lace([chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)], b // each % 2 == 0)
            body += _element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // hertz - ms, 0x80 | lacing << 1) + laced)
        clusters.append(_element(CLUSTER, body))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, ms) + _element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, place))))
        place += len(clusters[-1])
    head = _element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
    return head + _element(SEGMENT, b"".join([info, tracks, *clusters, _element(CUES, b"".join(cues))]))


def payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets as its codec has them, in file order."""
    kind, header = media.encodings.get(track, ("", b""))
    view = memoryview(data)
    frames = (view[at : at + n] for t, _, at, n, _, _ in media.packets if t == track)
    if kind == "zlib":
        return b"".join(zlib.decompress(f) for f in frames)
    return b"".join(x for f in frames for x in ((header, f) if header else (f,)))


#: encodings: of tracks whose frames in the file are not what their codec has.
PACKETS = "encodings array<struct<track:bigint,kind:string,header:binary>>, packets array<struct<track:bigint,timestamp_ns:bigint,offset:bigint,length:bigint,keyframe:boolean,lacing:int>>, cues array<struct<timestamp_ns:bigint,track:bigint,offset:bigint>>, error string"


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per file: id, encodings, packets, cues, error ('' if the file was read to its end)."""

    def each(part):
        found = [parse(x) for x in part.column(1).to_pylist()]
        return {
            id_col: part.column(0),
            "encodings": [[{"track": t, "kind": k, "header": h} for t, (k, h) in m.encodings.items()] for m in found],
            "packets": [[{"track": t, "timestamp_ns": ns, "offset": at, "length": n, "keyframe": bool(k), "lacing": x} for t, ns, at, n, k, x in m.packets] for m in found],
            "cues": [[{"timestamp_ns": ns, "track": t, "offset": at} for ns, t, at in m.cues] for m in found],
            "error": [m.error for m in found],
        }

    return mapped(df.select(named(id_col), named(media_col).alias("_media")), each, fields(df, (id_col,), PACKETS), "_media")


def text_payload(text: str | None) -> bytes:
    """UTF-8 with zero bytes up to the next multiple of 64, at least one block."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def feature(samples: bytes, media: Media) -> str:
    """Counts of the packet table and statistics of the samples that were read back."""
    x = np.frombuffer(samples, np.uint8)
    laces = Counter(p[5] for p in media.packets)
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    squares = int(np.sum(np.square(x.astype(np.int64) - 128)))
    return (
        f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={int(media.duration // 1e6)};lacing={'/'.join(str(laces[i]) for i in range(4))};"
        f"last_ns={max((p[1] for p in media.packets), default=0)};mean_milli={int(x.sum(dtype=np.int64)) * 1000 // max(1, len(x))};power={squares // max(1, len(x))};crossings={crossings}"
    )


def op6_matroska_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as PCM in Matroska, read back through the packet table; null texts are empty, odd rows go as the module says."""

    def each(part):
        out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for text in part.column(1).to_pylist():
            stored = mux(text_payload(text))
            media = parse(stored)
            if media.error:
                raise ValueError(media.error)
            back = payload(stored, media)
            row = (len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), crc(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, media))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out | {"doc_id": part.column(0)}

    return mapped(documents(spark, sf_dir, "doc_id", "text"), each, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


QUERIES = {"op6_matroska_columns": op6_matroska_columns}
SQL: dict[str, str] = {}
