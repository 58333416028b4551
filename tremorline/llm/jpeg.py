"""Media columns: baseline JPEG written from payloads, and a baseline decoder with DC-only thumbnails.

Writing stores a payload losslessly in the format's own unit, the quantised coefficient: each byte becomes one non-zero
coefficient of a greyscale image, 64 to a block in zigzag order, with one block to a restart interval. A comment segment
carries the payload's length. Reading parses the markers, Huffman-decodes the scans and rebuilds from the DC
coefficients alone a luminance thumbnail of one pixel per block.

The decoder takes any baseline (SOF0) or 8-bit sequential Huffman file: several components, sampling factors, several
scans, run lengths, with or without restart intervals. It advances all restart intervals ("lanes") of all images of a
batch together, one symbol of each per step, so numpy does the work; a file without restarts is a single lane.

Defined results: null and empty texts are 192 spaces; texts are padded with spaces to a positive multiple of 192 bytes. Very long
texts are one image each, whose side grows with the root of its size. Rows are independent: repeated rows and null
ids get equal rows, an empty table none, extra columns are ignored. Null media, and files that are damaged, cut short, not baseline, without a
luminance scan, or that claim more blocks than their bytes can code, give null features, never an error for the batch; a
file that holds no payload of `store` has a feature but no payload.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as K

UNIT, TAIL = 192, 16
#: What reading a damaged file can raise.
DAMAGE = (ValueError, KeyError, IndexError, StopIteration)
TAG = b"tremorline payload "

# Zigzag order is a walk along anti-diagonals, built by rule.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))

#: Code lengths of our Huffman tables by symbol (run << 4 | size), shortest for the sizes of ASCII letters.
AC_LENGTHS = {0x05: 2, 0x04: 3, 0x07: 3, 0x06: 3, 0x03: 4, 0x08: 5, 0x02: 5, 0x01: 6, 0x00: 6, 0xF0: 7}
DC_LENGTHS = {5: 2, 4: 3, 7: 3, 6: 3, 3: 4, 8: 5, 2: 5, 1: 6, 0: 6, 9: 8, 10: 8, 11: 8}


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The DHT body (counts by length, symbols) and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, last, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return bytes(sum(1 for s in order if lengths[s] == n) for n in range(1, 17)) + bytes(order), codes


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _byte_codes(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of each byte's coefficient: Huffman code of its size, then its amplitude."""
    value, length = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for b in range(256):
        c = b - 128 if b < 128 else b - 127
        size = abs(c).bit_length()
        code, n = codes[size]
        value[b] = code << size | (c if c > 0 else c + (1 << size) - 1)
        length[b] = n + size
    return value, length


_DC_BODY, _DC_CODES = _canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = _canonical(AC_LENGTHS)
_DC_V, _DC_L = _byte_codes(_DC_CODES)
_AC_V, _AC_L = _byte_codes(_AC_CODES)
_EMPTY = (_DC_CODES[0][0] << _AC_CODES[0][1] | _AC_CODES[0][0], _DC_CODES[0][1] + _AC_CODES[0][1])  # an all-zero block
_HEAD = b"\xff\xd8"
_TABLES = _segment(0xDB, b"\x00\x08" + b"\x01" * 63)
_AFTER = _segment(0xC4, b"\x00" + _DC_BODY) + _segment(0xC4, b"\x10" + _AC_BODY) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def shape(blocks: int) -> tuple[int, int]:
    """Blocks per row and rows of the image that holds so many blocks."""
    wide = 3 * max(1, round(blocks**0.5 / 3))
    return wide, -(-blocks // wide)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One JPEG for each payload; each length is a positive multiple of 64."""
    if not payloads:
        return []
    sizes = np.array([len(p) // 64 for p in payloads], np.int64)
    grid = [shape(int(n)) for n in sizes]
    lanes = np.array([w * h for w, h in grid], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    value, length = _AC_V[data], _AC_L[data]
    value[:, 0], length[:, 0] = _DC_V[data[:, 0]], _DC_L[data[:, 0]]
    v, n = value[:, 0::4], length[:, 0::4]  # four coefficients to a word: at most 60 bits
    for k in (1, 2, 3):
        v = v << length[:, k::4] | value[:, k::4]
        n = n + length[:, k::4]
    total = int(lanes.sum())
    first = np.cumsum(lanes) - lanes
    real = K.ranges(first, sizes)
    word, bits = np.zeros((total, 17), np.uint64), np.zeros((total, 17), np.int64)
    word[:, 0], bits[:, 0] = _EMPTY
    word[real, :16], bits[real, :16] = v, n.astype(np.int64)
    used = bits.sum(axis=1)
    pad = -used % 8
    word[:, 16], bits[:, 16] = (1 << pad) - 1, pad
    ends = np.cumsum((used + pad) // 8)
    raw = _bits(word.ravel(), bits.ravel(), int(ends[-1]))
    extra = (raw == 0xFF).astype(np.int64)
    last = np.zeros(total, bool)
    last[first + lanes - 1] = True
    marked = ends[~last] - 1
    extra_all = extra.copy()
    extra_all[marked] += 2
    at = np.arange(len(raw)) + np.cumsum(extra_all) - extra_all
    out = np.zeros(len(raw) + int(extra_all.sum()), np.uint8)
    out[at] = raw
    spot = at[marked] + 1 + extra[marked]
    out[spot] = 0xFF
    out[spot + 1] = 0xD0 + ((np.arange(total) - np.repeat(first, lanes)) % 8)[~last]
    stop = ends[first + lanes - 1] - 1
    stops = at[stop] + 1 + extra[stop]
    starts = np.r_[0, stops[:-1]]
    body = out.tobytes()
    return [
        b"".join([_HEAD, _segment(0xFE, TAG + str(len(p)).encode()), _TABLES, _segment(0xC0, b"\x08" + (h * 8).to_bytes(2, "big") + (w * 8).to_bytes(2, "big") + b"\x01\x01\x11\x00"), _AFTER, body[a:b], b"\xff\xd9"])
        for p, (w, h), a, b in zip(payloads, grid, starts.tolist(), stops.tolist(), strict=True)
    ]


def _bits(word: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Words of at most 60 bits each, one after the other, as bytes."""
    keep = bits > 0
    word, bits = word[keep], bits[keep]
    start = np.cumsum(bits) - bits
    at, r = start >> 6, (start & 63)
    out = np.zeros((size + 7) // 8 + 2, np.uint64)
    left = (word << (64 - bits).astype(np.uint64)) >> r.astype(np.uint64)
    group = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out[at[group]] = np.bitwise_or.reduceat(left, group)
    over = np.flatnonzero(r + bits > 64)
    out[at[over] + 1] |= word[over] << (128 - bits[over] - r[over]).astype(np.uint64)
    return out.byteswap().view(np.uint8)[:size]


_luts: dict[bytes, np.ndarray] = {}


def _lut(body: bytes) -> np.ndarray:
    """By the next 16 bits: code length | size << 5 | run << 9; 0 where no code fits."""
    if body not in _luts:
        counts, table, code, k = body[:16], np.zeros(65536, np.int32), 0, 16
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                s = body[k]
                table[code << (16 - n) : (code + 1) << (16 - n)] = n | (s & 15) << 5 | (s >> 4) << 9
                code, k = code + 1, k + 1
            code <<= 1
        if len(_luts) > 256:
            _luts.clear()
        _luts[body] = table
    return _luts[body]


class Image:
    """Markers of one file: dimensions, components, tables and scans."""

    def __init__(self, data: bytes):
        self.comment = b""
        self.comps: list[tuple[int, int, int, int]] = []  # id, horizontal and vertical factor, quantisation table
        self.quant: dict[int, bytes | list[int]] = {}
        self.scans: list[tuple] = []
        self.width = self.height = 0
        tables: dict[int, bytes] = {}
        interval, i = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("no SOI")
        while True:
            while data[i : i + 1] == b"\xff" and data[i + 1 : i + 2] == b"\xff":
                i += 1
            if i + 2 > len(data) or data[i] != 0xFF:
                raise ValueError("marker expected")
            marker = data[i + 1]
            i += 2
            if marker == 0xD9:
                break
            size = int.from_bytes(data[i : i + 2], "big")
            body = data[i + 2 : i + size]
            if size < 2 or len(body) != size - 2:
                raise ValueError("short segment")
            i += size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    step = 129 if body[0] >> 4 else 65
                    q = body[1:step]
                    if len(q) != step - 1:
                        raise ValueError("short quantisation table")
                    self.quant[body[0] & 15] = [int.from_bytes(q[j : j + 2], "big") for j in range(0, 128, 2)] if step == 129 else list(q)
                    body = body[step:]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    if len(body) < n:
                        raise ValueError("short Huffman table")
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise ValueError("sample precision")
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.comps = [(body[j], body[j + 1] >> 4, body[j + 1] & 15, body[j + 2]) for j in range(6, 6 + 3 * body[5], 3)]
                if any(not (1 <= h <= 4 and 1 <= v <= 4) for _, h, v, _ in self.comps):
                    raise ValueError("sampling factor")
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not baseline")
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                if not self.comps or not self.width or not self.height:
                    raise ValueError("scan before frame")
                chosen = [(next(k for k, c in enumerate(self.comps) if c[0] == body[j]), body[j + 1]) for j in range(1, 1 + 2 * body[0], 2)]
                end = self._end(data, i)
                self.scans.append(([(k, tables[t >> 4], tables[16 | t & 15]) for k, t in chosen], interval, i, end))
                i = end
        if not any(k == 0 for chosen, *_ in self.scans for k, _, _ in chosen):
            raise ValueError("no luminance scan")
        self.hmax, self.vmax = max(c[1] for c in self.comps), max(c[2] for c in self.comps)
        for scan in self.scans:
            n, plan = self.plan(scan)
            if n * len(plan) > 4 * (scan[3] - scan[2]):  # a block takes two codes, so two bits at least
                raise ValueError("more blocks than the data can hold")

    @staticmethod
    def _end(data: bytes, i: int) -> int:
        """Where the entropy-coded data end: a marker other than a stuffed byte or a restart."""
        if data[-2:] == b"\xff\xd9" and data.find(b"\xff\xda", i) < 0 and data.find(b"\xff\xc4", i) < 0:
            return len(data) - 2
        while True:
            i = data.find(b"\xff", i)
            if i < 0 or i + 1 >= len(data):
                raise ValueError("no EOI")
            if data[i + 1] != 0 and not 0xD0 <= data[i + 1] <= 0xD7 and data[i + 1] != 0xFF:
                return i
            i += 1

    def grid(self, k: int) -> tuple[int, int]:
        """Blocks of component k in a non-interleaved scan."""
        _, h, v, _ = self.comps[k]
        return -(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8)

    def plan(self, scan: tuple) -> tuple[int, list[tuple[int, bytes, bytes]]]:
        """MCUs of a scan, and (component, DC table, AC table) of each block of an MCU."""
        if len(scan[0]) == 1:
            w, h = self.grid(scan[0][0][0])
            return w * h, [scan[0][0]]
        return self.mcus()[0] * self.mcus()[1], [c for c in scan[0] for _ in range(self.comps[c[0]][1] * self.comps[c[0]][2])]

    def mcus(self) -> tuple[int, int]:
        return -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))


def _decode(files: list[bytes], images: list[Image]) -> tuple[np.ndarray, list[list[tuple[int, list]]]]:
    """Coefficients [blocks, 64] of all scans in decoding order, and for each image and scan (first block, MCU plan)."""
    table_at: dict[bytes, int] = {}
    tables: list[np.ndarray] = []

    def table(body: bytes) -> int:
        if body not in table_at:
            table_at[body] = len(tables) << 16
            tables.append(_lut(body))
        return table_at[body]

    parts, where, lane_rows = [], [], []
    patterns: dict[tuple, int] = {}
    block, base = 0, 0
    for data, image in zip(files, images, strict=True):
        own = []
        for scan in image.scans:
            n, plan = image.plan(scan)
            key = tuple((k, table(d), table(a)) for k, d, a in plan)
            pattern = patterns.setdefault(key, len(patterns))
            step = scan[1] or n
            own.append((block, plan))
            lane_rows.append((base, scan[3] - scan[2], block, n * len(plan), step * len(plan), pattern))
            parts.append(data[scan[2] : scan[3]])
            base += scan[3] - scan[2]
            block += n * len(plan)
        where.append(own)
    coef = np.zeros((block, 64), np.int16)
    if not block:
        return coef, where
    raw = np.frombuffer(b"".join(parts), np.uint8)
    scan_at, scan_len, scan_block, scan_blocks, scan_step, scan_pattern = (np.array(x, np.int64) for x in zip(*lane_rows, strict=True))
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    follow = raw[ff + 1] if len(ff) else ff
    drop = np.zeros(len(raw), bool)
    drop[ff[follow == 0] + 1] = True
    rst = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    drop[rst] = drop[rst + 1] = True
    gone = np.r_[0, np.cumsum(drop)]
    clean = np.concatenate([raw[~drop], np.zeros(16, np.uint8)])
    begins = np.sort(np.r_[scan_at, rst + 2])
    scan_of = np.searchsorted(scan_at, begins, "right") - 1
    number = np.arange(len(begins)) - np.searchsorted(begins, scan_at)[scan_of]
    if (np.bincount(scan_of, minlength=len(scan_at)) != -(-scan_blocks // scan_step)).any():
        raise ValueError("restart markers")
    pos = (begins - gone[begins]) * 8
    limit = len(raw) * 8
    blk = scan_block[scan_of] + number * scan_step[scan_of]
    end = np.minimum(blk + scan_step[scan_of], (scan_block + scan_blocks)[scan_of])
    width = max(len(p) for p in patterns)
    comp, dc, ac, count = (np.zeros((len(patterns), width), np.int64) for _ in range(4))
    for key, i in patterns.items():
        for j, (k, d, a) in enumerate(key):
            comp[i, j], dc[i, j], ac[i, j] = k, d, a
        count[i] = len(key)
    simple = len(patterns) == 1 and width == 1
    lut = np.concatenate(tables)
    window = np.ndarray((len(clean) - 8,), ">u8", clean.tobytes(), strides=(1,))
    half = np.array([0] + [1 << (s - 1) for s in range(1, 16)], np.int64)
    full = np.array([0] + [(1 << s) - 1 for s in range(1, 16)], np.int64)
    flat_coef = coef.reshape(-1)
    pat, turn = scan_pattern[scan_of], np.zeros(len(begins), np.int64)
    pred = np.zeros((len(begins), 4 if simple else max(4, int(comp.max()) + 1)), np.int64)
    k = np.zeros(len(begins), np.int64)
    rows = np.arange(len(begins))
    while len(pos):
        if int(pos.max()) > limit:
            raise ValueError("data end early")
        w = window[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        is_dc = k == 0
        all_dc = bool(is_dc.all())
        no_dc = not all_dc and not is_dc.any()
        if simple:
            tab = dc[0, 0] if all_dc else ac[0, 0] if no_dc else np.where(is_dc, dc[0, 0], ac[0, 0])
        else:
            tab = np.where(is_dc, dc[pat, turn], ac[pat, turn])
        entry = lut[(w >> np.uint64(48)).astype(np.int64) + tab]
        n = entry & 31
        if not n.all():
            raise ValueError("bad Huffman code")
        size, run = (entry >> 5) & 15, entry >> 9
        amp = (((w << n.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)).astype(np.int64)
        amp = np.where(amp < half[size], amp - full[size], amp)
        pos = pos + (n + size)
        if not no_dc:
            at = rows[: len(pos)] if all_dc else np.flatnonzero(is_dc)
            c = 0 if simple else comp[pat[at], turn[at]]
            pred[at, c] += amp[at]
            flat_coef[blk[at] * 64] = pred[at, c]
        if not all_dc:
            at = rows[: len(pos)] if no_dc else np.flatnonzero(~is_dc)
            s, r = size[at], run[at]
            if s.all():
                kk = k[at] + r
                if (kk > 63).any():
                    raise ValueError("run past the block")
                flat_coef[blk[at] * 64 + kk] = amp[at]
                k[at] = kk + 1
            else:
                kk = k[at] + r
                some = np.flatnonzero(s)
                if (kk[some] > 63).any():
                    raise ValueError("run past the block")
                flat_coef[blk[at[some]] * 64 + kk[some]] = amp[at[some]]
                k[at] = np.where(s > 0, kk + 1, np.where(r == 15, k[at] + 16, 64))
        if not no_dc:
            k[is_dc] = 1
        over = k >= 64
        if over.any():
            blk = blk + over
            k[over] = 0
            if not simple:
                turn = np.where(over, (turn + 1) % count[pat, 0], turn)
            going = blk < end
            if not going.all():
                pos, blk, end, k, pat, turn, pred = pos[going], blk[going], end[going], k[going], pat[going], turn[going], pred[going]
    return coef, where


class Decoded:
    """One image: its markers, luminance blocks' DC values as a thumbnail, and access to all coefficients."""

    def __init__(self, image: Image, coef: np.ndarray, scans: list[tuple[int, list]]):
        self.image, self.coef, self.scans = image, coef, scans

    def thumbnail(self) -> np.ndarray:
        """8-bit luminance, a pixel for each block of the first component, from DC coefficients only."""
        image = self.image
        q = image.quant.get(image.comps[0][3], [1])[0]
        for first, plan in self.scans:
            if not any(c[0] == 0 for c in plan):
                continue
            _, h, v, _ = image.comps[0]
            if len({c[0] for c in plan}) == 1:
                wide, high = image.grid(0)
                dc = self.coef[first : first + wide * high, 0].reshape(high, wide)
            else:
                wide, high = image.mcus()
                n = len(plan)
                skip = next(j for j, c in enumerate(plan) if c[0] == 0)
                dc = self.coef[first : first + wide * high * n, 0].reshape(high, wide, n)[:, :, skip : skip + h * v]
                dc = dc.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
                gw, gh = image.grid(0)
                dc = dc[:gh, :gw]
            return np.clip(np.round(dc.astype(np.float64) * q / 8) + 128, 0, 255).astype(np.uint8)
        raise ValueError("no luminance scan")

    def payload(self) -> bytes | None:
        """What encode() stored, or None for other files."""
        note = self.image.comment
        if not note.startswith(TAG) or not note[len(TAG) :].isdigit() or len(self.image.comps) != 1:
            return None
        size = int(note[len(TAG) : len(TAG) + 19])
        first, _ = self.scans[0]
        wide, high = self.image.grid(0)
        if size < UNIT or size % UNIT or size // 64 > wide * high:
            return None
        c = self.coef[first : first + size // 64].reshape(-1)
        return np.where(c < 0, c + 128, c + 127).astype(np.uint8).tobytes()

    def feature(self) -> str:
        """Dimensions, thumbnail size, a 64-bit average hash and a digest of the thumbnail."""
        t = self.thumbnail()
        small = t[(np.arange(8) * t.shape[0] // 8)[:, None], np.arange(8) * t.shape[1] // 8].astype(np.int32)
        bits = np.packbits((small * 64 > small.sum()).ravel()).tobytes().hex()
        return f"{self.image.width}x{self.image.height}/{t.shape[1]}x{t.shape[0]}/{bits}/{hashlib.sha1(t.tobytes()).hexdigest()[:16]}"


def decode(files: list[bytes | None]) -> list[Decoded | None]:
    """Decoded images; None for null or undecodable files."""
    images: list[Image | None] = []
    for data in files:
        try:
            images.append(Image(data) if data else None)
        except DAMAGE:
            images.append(None)
    good = [i for i, x in enumerate(images) if x is not None]
    out: list[Decoded | None] = [None] * len(files)
    try:
        coef, where = _decode([files[i] for i in good], [images[i] for i in good])
        for i, scans in zip(good, where, strict=True):
            out[i] = Decoded(images[i], coef, scans)
    except DAMAGE:
        if len(files) > 1:
            return [decode([f])[0] for f in files]
    return out


STORED = "n_bytes long, payload_bytes long, media binary"
READ = "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets, _ = K.flat(batch.column("text"))
        data = buf.tobytes()
        media, sizes = [], np.diff(offsets)
        padded = np.maximum(-(-sizes // UNIT), 1) * UNIT
        for i, j in K.chunks(offsets, K.CHUNK >> 1):
            cut = [data[offsets[r] : offsets[r + 1]] for r in range(i, j)]
            media += encode([t.ljust(int(n)) for t, n in zip(cut, padded[i:j], strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(padded), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column("media").to_pylist()
        out: list[list] = [[] for _ in range(5)]
        sizes = np.r_[0, np.cumsum([len(f or b"") for f in files])].astype(np.int64)
        for i, j in K.chunks(sizes, K.CHUNK >> 1):
            for f, d in zip(files[i:j], decode(files[i:j]), strict=True):
                payload = d.payload() if d else None
                row = (
                    hashlib.sha256(payload).hexdigest() if payload is not None else None, zlib.crc32(payload[-TAIL:]) if payload is not None else None,
                    len(f) if f is not None else None, hashlib.sha256(f).hexdigest() if f is not None else None, d.feature() if d else None,
                )
                for column, x in zip(out, row, strict=True):
                    column.append(x)
        keep = [batch.column(c) for c in ("doc_id", "n_bytes", "payload_bytes")]
        yield pa.RecordBatch.from_arrays([*keep, *[pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", *[c.split()[0] for c in READ.split(", ")]])


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes and the JPEG of each text, in one narrow pass."""
    K.ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, f"doc_id long, {STORED}")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload digests and the thumbnail feature, in one narrow pass."""
    K.ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(_read, f"doc_id long, n_bytes long, payload_bytes long, {READ}")
