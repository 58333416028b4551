import hashlib
import zlib

import numpy as np
import pytest

from tremorline.llm import jpeg as M
from tremorline.llm import registered


def test_zigzag_is_the_standard_walk():
    assert M.ZIGZAG[:12].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25] and M.ZIGZAG[-3:].tolist() == [55, 62, 63]


def bits(out, code, n):
    out.extend((code >> (n - 1 - i)) & 1 for i in range(n))


def amplitude(out, v):
    s = abs(v).bit_length()
    if s:
        bits(out, v if v > 0 else v + (1 << s) - 1, s)


def scalar_jpeg(width, height, comps, coefs, interval, interleaved=True):
    """A plain one-bit-at-a-time encoder. comps: (id, h, v); coefs[c]: function (row, col) -> 64 zigzag values."""
    sizes = {s << 4 | n: 8 for s in range(16) for n in range(1, 11)} | {0: 3, 0xF0: 8}
    ac_body, ac = M._canonical(sizes)
    dc_body, dc = M._canonical({n: 4 for n in range(12)})
    hmax, vmax = max(c[1] for c in comps), max(c[2] for c in comps)
    mw, mh = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    out = b"\xff\xd8" + M._segment(0xDB, b"\x00\x10" + b"\x03" * 63)
    out += M._segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(comps)]) + b"".join(bytes([i, h << 4 | v, 0]) for i, h, v in comps))
    out += M._segment(0xC4, b"\x00" + dc_body) + M._segment(0xC4, b"\x10" + ac_body)
    if interval:
        out += M._segment(0xDD, interval.to_bytes(2, "big"))
    scans = [list(range(len(comps)))] if interleaved else [[i] for i in range(len(comps))]
    for scan in scans:
        if len(scan) > 1:
            units = [[(c, my * comps[c][2] + y, mx * comps[c][1] + x) for c in scan for y in range(comps[c][2]) for x in range(comps[c][1])] for my in range(mh) for mx in range(mw)]
        else:
            _, h, v = comps[scan[0]]
            gw, gh = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
            units = [[(scan[0], y, x)] for y in range(gh) for x in range(gw)]
        out += M._segment(0xDA, bytes([len(scan)]) + b"".join(bytes([comps[c][0], 0]) for c in scan) + b"\x00\x3f\x00")
        stream, pred = [], dict.fromkeys(scan, 0)

        def flush():
            while len(stream) % 8:
                stream.append(1)
            raw = bytes(int("".join(map(str, stream[i : i + 8])), 2) for i in range(0, len(stream), 8))
            stream.clear()
            return raw.replace(b"\xff", b"\xff\x00")

        for m, unit in enumerate(units):
            if interval and m and m % interval == 0:
                out += flush() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
                pred = dict.fromkeys(scan, 0)
            for c, y, x in unit:
                z = coefs[c](y, x)
                d = z[0] - pred[c]
                pred[c] = z[0]
                bits(stream, *dc[abs(d).bit_length()])
                amplitude(stream, d)
                run, last = 0, max([k for k in range(64) if z[k]], default=0)
                for k in range(1, last + 1):
                    if not z[k]:
                        run += 1
                        continue
                    while run > 15:
                        bits(stream, *ac[0xF0])
                        run -= 16
                    bits(stream, *ac[run << 4 | abs(z[k]).bit_length()])
                    amplitude(stream, z[k])
                    run = 0
                if last < 63:
                    bits(stream, *ac[0])
        out += flush()
    return out + b"\xff\xd9"


@pytest.mark.parametrize("comps,interval,interleaved", [([(1, 1, 1)], 0, True), ([(1, 2, 2), (2, 1, 1), (3, 1, 1)], 2, True), ([(1, 2, 1), (2, 1, 1), (3, 1, 1)], 0, True), ([(1, 2, 2), (2, 1, 1)], 3, False)])
def test_general_files(comps, interval, interleaved):
    rng = np.random.default_rng(5)
    width, height = 53, 41
    grids = [rng.integers(-120, 120, (12, 12, 64)) * (rng.random((12, 12, 64)) < 0.1) for _ in comps]
    for g in grids:
        g[:, :, 0] = rng.integers(-60, 60, (12, 12))
    data = scalar_jpeg(width, height, comps, [lambda y, x, g=g: g[y, x].tolist() for g in grids], interval, interleaved)
    other = M.encode([b"x" * 192])[0]
    got, second = M.decode([data, other])
    assert second.payload() == b"x" * 192
    assert got.payload() is None
    wide, high = -(-width // 8), -(-height // 8)
    want = np.clip(np.round(grids[0][:high, :wide, 0] * 16 / 8) + 128, 0, 255)
    assert (got.thumbnail() == want).all()
    first, plan = got.scans[0]
    assert (got.coef[first] == grids[0][0, 0]).all()
    assert got.feature().startswith("53x41/7x6/")


def test_round_trip_and_bad_files():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8).tobytes() for n in (1, 2, 7, 50)] + [bytes(range(256)) * 3, b"\xff" * 192, b"\x00" * 192, b"\x80" * 384]
    files = M.encode(payloads)
    assert [d.payload() for d in M.decode(files)] == payloads
    broken = [files[0][:200], b"", None, b"\xff\xd8junk", files[3][:-40] + b"\xff\xd9", files[1]]
    got = M.decode(broken)
    assert got[5].payload() == payloads[1] and got[:4] == [None] * 4


def colour_file():
    rng = np.random.default_rng(6)
    g = rng.integers(-60, 60, (12, 12, 64)) * (rng.random((12, 12, 64)) < 0.1)
    return scalar_jpeg(53, 41, [(1, 2, 2), (2, 1, 1), (3, 1, 1)], [lambda y, x: g[y, x].tolist()] * 3, 2)


def null_or_feature(files):
    """decode() and all that _read asks of it, which must not raise."""
    out = []
    for d in M.decode(files):
        out.append((d.feature(), d.payload()) if d else None)
    return out


def test_damaged_headers_give_null_features():
    good, colour = M.encode([b"text " * 192])[0], colour_file()
    frame = colour.index(b"\xff\xc0")
    zero_factor = colour[: frame + 11] + b"\x00" + colour[frame + 12 :]
    quant = colour.index(b"\xff\xdb")
    short_quant = colour[:quant] + M._segment(0xDB, b"\x00\x01\x02") + colour[quant + 69 :]
    chroma_only = scalar_jpeg(16, 16, [(1, 1, 1), (2, 1, 1)], [lambda y, x: [0] * 64] * 2, 0, interleaved=False)
    first = chroma_only.index(b"\xff\xda")
    chroma_only = chroma_only[:first] + chroma_only[chroma_only.index(b"\xff\xda", first + 2) :]
    frame = good.index(b"\xff\xc0")
    huge = good[: frame + 5] + b"\xff\xff\xff\xff" + good[frame + 9 :]
    files = [zero_factor, short_quant, chroma_only, huge, good]
    assert null_or_feature(files)[:4] == [None] * 4 and null_or_feature(files)[4][1] == b"text " * 192


def test_foreign_comments_are_no_payload():
    data = M.encode([b"y" * 192])[0]
    note = M._segment(0xFE, M.TAG + b"192")
    for text in (M.TAG, M.TAG + b"many", M.TAG + b"100", M.TAG + b"19200000", M.TAG + b"9" * 400, b"hello"):
        (feature, payload), = null_or_feature([data.replace(note, M._segment(0xFE, text))])
        assert payload is None and feature.startswith("24x8/")


def test_random_damage_never_raises():
    rng = np.random.default_rng(8)
    whole = [M.encode([b"some words " * 192])[0], colour_file()]
    files = []
    for k in range(300):
        raw = bytearray(whole[k % 2])
        for at in rng.integers(0, len(raw) if k % 3 else 400, int(rng.integers(1, 6))):
            raw[at] = int(rng.integers(0, 256))
        files.append(bytes(raw[: int(rng.integers(1, len(raw)))] if k % 5 == 0 else raw))
    got = null_or_feature([*files, *whole])
    assert got[-2][1] == b"some words " * 192 and got[-1][0].startswith("53x41/")


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registered.op1(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        p = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        f = M.encode([p])[0]
        assert (r.media_bytes, r.media_sha256) == (len(f), hashlib.sha256(f).hexdigest())
        assert r.feature == M.decode([f])[0].feature()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = M.features(M.store(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    empty = {(r.n_bytes, r.payload_bytes, r.payload_sha256) for r in rows if r.doc_id in (1, 2)}
    assert empty == {(0, 192, hashlib.sha256(b" " * 192).hexdigest())}
    assert M.features(M.store(no_docs)).count() == 0
    bad = spark.createDataFrame([(1, 0, 0, bytearray(b"nope")), (2, 0, 0, None)], "doc_id long, n_bytes long, payload_bytes long, media binary")
    assert [r.feature for r in M.features(bad).collect()] == [None, None]
