"""AVI motion-JPEG columns: lossless storage, RIFF index parsing, intra-frame decoding and shot detection.

A payload (UTF-8 bytes and spaces up to a positive multiple of 192) is stored as
grey motion-JPEG: a frame of 128 x 96 pixels holds 192 samples, one for each
8 x 8 block. A flat block has a DC coefficient only; with a DC quantiser of 8
the coefficient is the sample less 128, so baseline JPEG keeps it exactly. DC
categories 0..8 have codes of four bits, end of block has one bit.

Reading goes by the file alone: RIFF lists and idx1 give the frames, each
frame's own markers give its tables. Frames are decoded side by side, one block
of all frames at a time. A cut lies where the difference of two neighbouring
frames' histograms exceeds the running mean of the eight differences before by
`factor` and the floor `least`. A text is coded, stored and read back some
thousand frames at a time, so a long one needs memory for itself and its file.

Defined results: null is the empty text (192 spaces, one frame, one clip);
repeated rows and equal texts have equal values; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import bounded_batches
from .words import texts

SAMPLES, WIDTH, HEIGHT, FPS = 192, 128, 96, 25


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: SOI, quantiser (8, then ones), frame header, DC and AC Huffman tables, scan header.
FRAME_HEAD = (
    b"\xff\xd8" + _segment(0xDB, b"\0\x08" + b"\1" * 63) + _segment(0xC0, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\0" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))) + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0") + _segment(0xDA, b"\1\1\0\0\x3f\0")
)


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % SAMPLES or (0 if text else SAMPLES))


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of (frames, 192) samples."""
    n = len(samples)
    if not n:
        return []
    level = samples.astype(np.int32) - 128
    diff = np.diff(level, axis=1, prepend=0)
    size = np.zeros(512, np.int32)
    size[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int32) + 1
    cat = size[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff)
    code = ((cat << cat) | extra) << 1
    bits = cat + 5
    used = bits.sum(axis=1)
    room = (used + 7) >> 3
    first = np.concatenate(([0], np.cumsum(room)[:-1]))
    at = (first[:, None] * 8 + np.cumsum(bits, axis=1) - bits).ravel()
    word = code.ravel() << (24 - (at & 7) - bits.ravel())
    total = int(room.sum())
    body = np.zeros(total + 2)
    for k, shift in enumerate((16, 8, 0)):
        body += np.bincount((at >> 3) + k, weights=(word >> shift) & 255, minlength=total + 2)[: total + 2]
    stop = first + room - 1
    body[stop] += (1 << (room * 8 - used)) - 1
    blob = body[:total].astype(np.uint8).tobytes()
    out = []
    for a, b in zip(first.tolist(), (first + room).tolist(), strict=True):
        out.append(FRAME_HEAD + blob[a:b].replace(b"\xff", b"\xff\0") + b"\xff\xd9")
    return out


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body


def _header(frames: int, largest: int) -> bytes:
    """The header list; its length does not depend on the numbers."""
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    return _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form)))


def write_avi(frames: Iterable[bytes], most: int = 1 << 30) -> bytearray:
    """A RIFF AVI file with an index. Its sizes have 32 bits, so frames beyond `most` bytes go to further RIFF parts, each with its own index."""
    out, index, many, largest = bytearray(), bytearray(), 0, 0
    head = movi = 0

    def start() -> None:
        nonlocal head, movi
        head = len(out)
        out.extend(b"RIFF\0\0\0\0AVIX" if head else b"RIFF\0\0\0\0AVI " + _header(0, 0))
        movi = len(out) + 8
        out.extend(b"LIST\0\0\0\0movi")

    def finish() -> None:
        struct.pack_into("<I", out, movi - 4, len(out) - movi)
        out.extend(b"idx1" + struct.pack("<I", len(index)))
        out.extend(index)
        index.clear()
        struct.pack_into("<I", out, head + 4, len(out) - head - 8)

    start()
    for f in frames:
        n = len(f)
        if index and len(out) - movi + n + 9 > most:
            finish()
            start()
        index.extend(struct.pack("<4sIII", b"00dc", 0x10, len(out) - movi, n))
        out.extend(b"00dc" + struct.pack("<I", n))
        out.extend(f)
        if n & 1:
            out.append(0)
        many, largest = many + 1, max(largest, n)
    finish()
    known = _header(many, largest)
    out[12 : 12 + len(known)] = known
    return out


def avi_index(data: bytes | bytearray) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and sizes of the frames by the idx1 of each RIFF part (in one without: by walking its movi), and seconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    places, sizes, step, part = [], [], 1 / FPS, 0
    while part + 12 <= len(data) and data[part : part + 4] == b"RIFF" and data[part + 8 : part + 12] in (b"AVI ", b"AVIX"):
        end, at, movi, rows = min(len(data), part + 8 + struct.unpack_from("<I", data, part + 4)[0]), part + 12, None, None
        while at + 8 <= end:
            tag, size = struct.unpack_from("<4sI", data, at)
            if tag == b"LIST" and data[at + 8 : at + 12] == b"movi":
                movi = (at + 8, min(end, at + 8 + size))
            elif tag == b"LIST" and data[at + 12 : at + 16] == b"avih":
                step = struct.unpack_from("<I", data, at + 20)[0] / 1e6
            elif tag == b"idx1":
                rows = np.frombuffer(data, dtype="<u4", count=min(size, end - at - 8) // 16 * 4, offset=at + 8).reshape(-1, 4)
            at += 8 + size + (size & 1)
        if movi is None:
            raise ValueError("no movi list")
        video = rows[(rows[:, 0] >> 16 == 0x6364) | (rows[:, 0] >> 16 == 0x6264)] if rows is not None else []  # 'dc' and 'db'
        if len(video):
            offset = movi[0] - part if video[0, 2] < movi[0] - part else 0
            places += (video[:, 2].astype(np.int64) + part + offset + 8).tolist()
            sizes += video[:, 3].tolist()
        else:
            at = movi[0] + 4
            while at + 8 <= movi[1]:
                tag, size = struct.unpack_from("<4sI", data, at)
                if tag[2:] in (b"dc", b"db"):
                    places.append(at + 8)
                    sizes.append(size)
                at += 8 + size + (size & 1)
        part = end + (end & 1)
    return np.array(places, np.int64), np.array(sizes, np.int64), step


def read_avi(data: bytes | bytearray) -> tuple[list[bytes], float]:
    """Frames and seconds a frame."""
    places, sizes, step = avi_index(data)
    return [bytes(data[a : a + n]) for a, n in zip(places.tolist(), sizes.tolist(), strict=True)], step


@lru_cache(64)
def _tables(head: bytes) -> tuple[int, np.ndarray, np.ndarray, int, int] | str:
    """(blocks, bits by code word, difference by code word, bits looked at, DC quantiser) of a frame's markers up to its scan, or why it can have no flat blocks of one grey part."""
    at, trees, quant, blocks, q = 2, {}, {}, 0, 0
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            quant[body[0] & 15] = body[1]
        elif marker == 0xC0:
            high, wide, parts = struct.unpack_from(">HHB", body, 1)
            if body[0] != 8 or parts != 1:
                return "not grey with 8 bits"
            blocks, q = -(-high // 8) * -(-wide // 8), body[8]
        elif marker in (0xC1, 0xC2, 0xC3, 0xDD):
            return "not plain baseline"
        elif marker == 0xC4:
            if len(body) != 17 + sum(body[1:17]):
                return "several tables in one marker"
            code, k, tree = 0, 17, []
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    tree.append((code, bits, body[k]))
                    code, k = code + 1, k + 1
                code <<= 1
            trees[body[0]] = tree
        at += 2 + size
    stop = next(((c, n) for c, n, v in trees.get(0x10, ()) if v == 0), None)
    if stop is None or 0 not in trees or q not in quant:
        return "no end of block, or a table is missing"
    most = max(n + v for _, n, v in trees[0]) + stop[1]
    if most > 22:
        return "code words are too long"
    length, value = np.zeros(1 << most, np.int64), np.zeros(1 << most, np.int64)
    for code, bits, cat in trees[0]:
        for extra in range(1 << cat):
            word = ((((code << cat) | extra) << stop[1]) | stop[0]) << (most - bits - cat - stop[1])
            span = slice(word, word + (1 << (most - bits - cat - stop[1])))
            length[span] = bits + cat + stop[1]
            value[span] = extra if not cat or extra >> (cat - 1) else extra - (1 << cat) + 1
    return blocks, length, value, most, quant[q]


def _flat(frames: list[bytes]) -> np.ndarray | str:
    """(frames, blocks) samples of frames that share their markers and have flat blocks only, or why these have not."""
    scan = frames[0].find(b"\xff\xda")
    if scan < 0 or len(frames[0]) < scan + 4:
        return "no scan"
    scan += 2 + struct.unpack_from(">H", frames[0], scan + 2)[0]
    head = frames[0][:scan]
    if not all(f.startswith(head) for f in frames):
        return "frames differ in their markers"
    tables = _tables(head)
    if isinstance(tables, str):
        return tables
    blocks, length, value, most, quant = tables
    parts = [f[scan:-2].replace(b"\xff\0", b"\xff") for f in frames]
    data = np.frombuffer(b"".join(parts) + b"\xff" * 8, dtype=np.uint8).astype(np.uint32)
    wide = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = 8 * np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])).astype(np.int64)
    end = at + 8 * np.array([len(p) for p in parts])
    level = np.zeros(len(frames), np.int64)
    out = np.empty((blocks, len(frames)), np.uint8)
    for k in range(blocks):
        word = (wide[np.minimum(at >> 3, len(wide) - 1)] >> (32 - most - (at & 7)).astype(np.uint32)) & np.uint32((1 << most) - 1)
        step = length[word]
        if not step.all():
            return "a block is not flat"
        level += value[word]
        at += step
        out[k] = np.clip(((level * quant + 4) >> 3) + 128, 0, 255)
    if (at > end).any():
        return "a frame ends early"
    return np.ascontiguousarray(out.T)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """(frames, blocks) flat blocks' samples; frames must share their markers, as those of one writer do."""
    if not frames:
        return np.empty((0, SAMPLES), np.uint8)
    out = _flat(frames)
    if isinstance(out, str):
        raise ValueError(out)
    return out


_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINE = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of one restart interval, first bit first; past its end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.word = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.held < n:
            self.word = ((self.word & ((1 << self.held) - 1)) << 8) | (self.data[self.at] if self.at < len(self.data) else 255)
            self.at, self.held = self.at + 1, self.held + 8

    def symbol(self, tree: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            self.need(1)
            self.held -= 1
            code = (code << 1) | ((self.word >> self.held) & 1)
            if (n, code) in tree:
                return tree[n, code]
        raise ValueError("no such code word")

    def value(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        self.held -= n
        v = (self.word >> self.held) & ((1 << n) - 1)
        return v if v >> (n - 1) else v - (1 << n) + 1


def decode_luma(frame: bytes) -> np.ndarray:
    """(height, width) luma of any baseline JPEG frame: grey or of three components, with or without restart markers."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, trees, parts, every, high, wide = 2, {}, {}, [], 0, 0, 0
    while True:
        if at + 4 > len(frame) or frame[at] != 0xFF:
            raise ValueError("broken markers")
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide_numbers, n = body[k] >> 4, body[k] & 15
                quant[n] = np.frombuffer(body, ">u2" if wide_numbers else "u1", 64, k + 1).astype(np.float64)
                k += 1 + 64 * (2 if wide_numbers else 1)
        elif marker in (0xC0, 0xC1):
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only samples of 8 bits can be read")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames can be read")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts, tree, code, v = body[k + 1 : k + 17], {}, 0, k + 17
                for n, many in enumerate(counts, 1):
                    for _ in range(many):
                        tree[n, code] = body[v]
                        code, v = code + 1, v + 1
                    code <<= 1
                trees[body[k]], k = tree, v
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            break
    if not parts or not high or not wide:
        raise ValueError("no frame header")
    top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, top_h, top_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-wide // (8 * top_h)), -(-high // (8 * top_v))
    scan = frame[at : len(frame) - 2 if frame.endswith(b"\xff\xd9") else len(frame)]
    cuts, k = [0], 0
    while (k := scan.find(b"\xff", k)) >= 0:
        if k + 1 < len(scan) and 0xD0 <= scan[k + 1] <= 0xD7:
            cuts += [k, k + 2]
        k += 2
    cuts.append(len(scan))
    pieces = [scan[a:b].replace(b"\xff\0", b"\xff") for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    _, h, v, q = parts[0]
    luma = np.zeros((down * v, across * h, 64))
    bits, before = _Bits(pieces[0]), [0] * len(parts)
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            if mcu // every >= len(pieces):
                raise ValueError("a frame ends early")
            bits, before = _Bits(pieces[mcu // every]), [0] * len(parts)
        for i, (name, ph, pv, _) in enumerate(parts):
            dc, ac = trees[tables[name][0]], trees[16 + tables[name][1]]
            for block in range(ph * pv):
                before[i] += bits.value(bits.symbol(dc))
                row, k = np.zeros(64), 1
                row[0] = before[i]
                while k < 64:
                    s = bits.symbol(ac)
                    if not s:
                        break
                    k += s >> 4
                    if s & 15:
                        if k > 63:
                            raise ValueError("a block is too long")
                        row[k] = bits.value(s & 15)
                    k += 1
                if i == 0:
                    luma[mcu // across * v + block // h, mcu % across * h + block % h] = row
    whole = np.zeros_like(luma)
    whole[..., _ZIGZAG] = luma * quant[q]
    pixels = np.einsum("ux,rcuv,vy->rcxy", _COSINE, whole.reshape(*whole.shape[:2], 8, 8), _COSINE)
    flat = pixels.transpose(0, 2, 1, 3).reshape(luma.shape[0] * 8, luma.shape[1] * 8)
    return np.clip(np.floor(flat + 128.5), 0, 255).astype(np.uint8)[:high, :wide]


def decode_any(frames: list[bytes]) -> np.ndarray:
    """(frames, samples) of any baseline motion-JPEG: flat frames of one writer side by side, others one by one."""
    out = _flat(frames) if frames else np.empty((0, SAMPLES), np.uint8)
    return np.stack([decode_luma(f).ravel() for f in frames]) if isinstance(out, str) else out


def histogram_steps(samples: np.ndarray, bins: int = 32) -> np.ndarray:
    """Share of samples that change bins between each frame and the one before (0 for the first)."""
    n = len(samples)
    hist = np.bincount((np.arange(n)[:, None] * bins + (samples >> 3)).ravel(), minlength=n * bins).reshape(n, bins)
    return np.concatenate(([0.0], np.abs(np.diff(hist, axis=0)).sum(axis=1) / (2 * samples.shape[1])))[:n]


def shots(steps: np.ndarray, factor: float = 1.8, least: float = 0.2, behind: int = 8) -> list[int]:
    """First frames of the shots of one clip's histogram steps."""
    total = np.concatenate(([0.0], np.cumsum(steps)))
    k = np.arange(len(steps))
    low = np.maximum(1, k - behind)
    mean = (total[k] - total[np.minimum(low, k)]) / np.maximum(1, k - low)
    return [0, *np.flatnonzero((k > 0) & (steps > least) & (steps > factor * mean)).tolist()]


def _row(text: bytes, file: bytes | bytearray, n: int, digest: str, tail: bytes, steps: np.ndarray, second: float) -> dict:
    cuts = shots(steps)
    return {
        "n_bytes": len(text), "payload_bytes": n, "payload_sha256": digest, "tail_crc32": zlib.crc32(tail), "media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest(),
        "feature": f"frames={len(steps)};shots={len(cuts)};motion={steps.mean():.4f}",
        "clips": [{"shot": i, "start_s": round(a * second, 6), "end_s": round(b * second, 6), "motion": float(steps[a:b].mean())} for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(steps)], strict=True))],
        "media": file,
    }


def _side_by_side(batch: list[bytes]) -> list[dict]:
    """Rows of short texts, whose frames are coded and decoded together."""
    padded = [payload(t) for t in batch]
    counts = [len(p) // SAMPLES for p in padded]
    samples = np.frombuffer(b"".join(padded), dtype=np.uint8).reshape(-1, SAMPLES)
    frames, files, at = encode_frames(samples), [], 0
    for n in counts:
        files.append(write_avi(frames[at : at + n]))
        at += n
    del frames
    read = [read_avi(f) for f in files]
    back = decode_frames([f for fs, _ in read for f in fs])
    steps = histogram_steps(back)
    out, at = [], 0
    for text, file, (fs, second) in zip(batch, files, read, strict=True):
        data = back[at : at + len(fs)].tobytes()
        own = steps[at : at + len(fs)].copy()
        own[:1] = 0.0
        at += len(fs)
        out.append(_row(text, file, len(data), hashlib.sha256(data).hexdigest(), data[-16:], own, second))
    return out


def _sliced(text: bytes, frames: int) -> dict:
    """The row of a long text, coded and decoded some frames at a time: besides the text and its file only one slice is held."""
    size = frames * SAMPLES

    def coded() -> Iterator[bytes]:
        for i in range(0, len(text), size):
            part = text[i : i + size]
            yield from encode_frames(np.frombuffer(payload(part), np.uint8).reshape(-1, SAMPLES))

    file = write_avi(coded())
    places, sizes, second = avi_index(file)
    digest, n, last, steps = hashlib.sha256(), 0, None, []
    for i in range(0, len(places), frames):
        back = decode_frames([bytes(file[a : a + k]) for a, k in zip(places[i : i + frames].tolist(), sizes[i : i + frames].tolist(), strict=True)])
        digest.update(back.data)
        n += back.size
        steps.append(histogram_steps(back) if last is None else histogram_steps(np.concatenate((last, back)))[1:])
        last = back[-1:].copy()
    return _row(text, file, n, digest.hexdigest(), last.tobytes()[-16:], np.concatenate(steps), second)


def stored(batch: list[bytes], frames: int = 4096) -> Iterator[dict]:
    """One row per text, in order; at most `frames` frames are coded at a time, whatever the texts' lengths."""
    group, held = [], 0
    for t in batch:
        n = len(t) // SAMPLES + 1
        if group and held + n > frames:
            yield from _side_by_side(group)
            group, held = [], 0
        if n > frames:
            yield _sliced(t, frames)
        else:
            group.append(t)
            held += n
    if group:
        yield from _side_by_side(group)


_KIND = {
    "n_bytes": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string()),
    "clips": ("array<struct<shot:long,start_s:double,end_s:double,motion:double>>", pa.list_(pa.struct([("shot", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("motion", pa.float64())]))), "media": ("binary", pa.binary()),
}


def _motion(data: bytes, frames: int = 4096) -> tuple[np.ndarray, float]:
    """Histogram steps of a file's frames, and seconds a frame."""
    places, sizes, second = avi_index(data)
    last, steps = None, [np.zeros(0)]
    for i in range(0, len(places), frames):
        back = decode_any([data[a : a + n] for a, n in zip(places[i : i + frames].tolist(), sizes[i : i + frames].tolist(), strict=True)])
        steps.append(histogram_steps(back) if last is None else histogram_steps(np.concatenate((last, back)))[1:])
        last = back[-1:].copy()
    return np.concatenate(steps), second


def clip_rows(files: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: id, shot, start_s, end_s, motion, error. A null or unreadable file has one row that says why."""
    bounded_batches(files.sparkSession, 64)
    names = ["id", "shot", "start_s", "end_s", "motion", "error"]

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                key, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                try:
                    steps, second = _motion(data or b"")
                    cuts = shots(steps) if len(steps) else []
                    out += [(key, i, round(a * second, 6), round(e * second, 6), float(steps[a:e].mean()), None) for i, (a, e) in enumerate(zip(cuts, [*cuts[1:], len(steps)], strict=True))]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    out.append((key, None, None, None, None, str(e)))
            kinds = [b.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    few = files.select(files[id_col].alias("id"), files[media_col].alias("media"))
    return few.mapInArrow(run, f"id {files.schema[id_col].dataType.simpleString()}, shot long, start_s double, end_s double, motion double, error string").withColumnRenamed("id", id_col)


def store_as_avi(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False, frames: int = 4096) -> DataFrame:
    """One row per document: sizes, digests, features and timed clips; with media=True also the file. No shuffle; `frames` bounds what is coded at a time."""
    bounded_batches(docs.sparkSession)
    names = [c for c in _KIND if media or c != "media"]
    kind = pa.schema([(c, _KIND[c][1]) for c in names])

    def run(batches):
        for b in batches:
            rows, at = [], 0
            for r in stored(texts(b, "text"), frames):
                rows.append({c: bytes(r[c]) if c == "media" else r[c] for c in names})
                if media and sum(len(x["media"]) for x in rows) > 32 << 20:  # files go on before they fill the worker
                    yield _out(b, at, rows, kind, names)
                    rows, at = [], at + len(rows)
            yield _out(b, at, rows, kind, names)

    few = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return few.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} {_KIND[c][0]}" for c in names)).withColumnRenamed("id", id_col)


def _out(b: pa.RecordBatch, at: int, rows: list[dict], kind: pa.Schema, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0).slice(at, len(rows)), *pa.RecordBatch.from_pylist(rows, schema=kind).columns], names=["id", *names])
