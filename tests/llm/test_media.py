"""Exact round trips, and a decoder that reads bit by bit as a second opinion."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import jpeg, media


def sequential(data):
    """Coefficients of a progressive file, one bit after the other, with restarts; component after component."""
    tables, at, restart = {}, 2, 0
    while data[at + 1] != 0xD9:
        code, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if code == 0xC4:
            while body:
                counts, k, codes, c = body[1:17], 17, {}, 0
                for length, m in enumerate(counts, 1):
                    for _ in range(m):
                        codes[length, c] = body[k]
                        c, k = c + 1, k + 1
                    c <<= 1
                tables[body[0]] = codes
                body = body[k:]
        elif code == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif code == 0xC2:
            h, w = struct.unpack_from(">HH", body, 1)
            mw, mh = w // 16, h // 16
            grids = [np.zeros((mh * s, mw * s, 64), int) for s in (2, 1, 1)]
        elif code == 0xDA:
            comps = [body[1 + 2 * j] - 1 for j in range(body[0])]
            sel = [body[2 + 2 * j] for j in range(body[0])]
            ss, se, a = body[-3:]
            ah, al = a >> 4, a & 15
            end = at
            while not (data[end] == 0xFF and data[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            pieces, cur, k = [], bytearray(), at
            while k < end:
                if data[k] == 0xFF:
                    if data[k + 1]:
                        pieces.append(cur)
                        cur = bytearray()
                    else:
                        cur.append(0xFF)
                    k += 2
                else:
                    cur.append(data[k])
                    k += 1
            pieces.append(cur)
            at = end
            if len(comps) == 1:
                g = grids[comps[0]]
                units = [[(comps[0], 0, y, x)] for y in range(g.shape[0]) for x in range(g.shape[1])]
            else:
                units = [[(c, j, y * s + v, x * s + u) for j, (c, s) in enumerate(zip(comps, (2, 1, 1)))for v in range(s) for u in range(s)] for y in range(mh) for x in range(mw)]
            for p, piece in enumerate(pieces):
                bits = iter("".join(f"{b:08b}" for b in piece))
                get = lambda m, bits=bits: int("".join(next(bits) for _ in range(m)) or "0", 2)

                def symbol(t, get=get):
                    c = n = 0
                    while True:
                        c, n = c << 1 | get(1), n + 1
                        if (n, c) in t:
                            return t[n, c]

                def signed(s, get=get):
                    v = get(s)
                    return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1

                pred, eob = {}, 0
                for unit in units[p * restart : (p + 1) * restart]:
                    for c, j, y, x in unit:
                        block = grids[c][y, x]
                        if ss == 0:
                            if ah:
                                block[0] |= get(1) << al
                            else:
                                pred[c] = pred.get(c, 0) + signed(symbol(tables[sel[j] >> 4]))
                                block[0] = pred[c] << al
                            continue
                        t = tables[0x10 | sel[j] & 15]
                        k = ss
                        if not ah:
                            if eob:
                                eob -= 1
                                continue
                            while k <= se:
                                rs = symbol(t)
                                r, s = rs >> 4, rs & 15
                                if s == 0:
                                    if r < 15:
                                        eob = (1 << r) + get(r) - 1
                                        break
                                    k += 16
                                    continue
                                k += r
                                block[k] = signed(s) * (1 << al)
                                k += 1
                            continue
                        while k <= se and not eob:
                            rs = symbol(t)
                            r, s = rs >> 4, rs & 15
                            new = 0
                            if s == 0 and r < 15:
                                eob = (1 << r) + get(r)
                                break
                            if s:
                                new = (1 if get(1) else -1) << al
                            while k <= se:
                                if block[k]:
                                    if get(1):
                                        block[k] += (1 << al) * (1 if block[k] > 0 else -1)
                                elif r == 0:
                                    block[k] = new
                                    k += 1
                                    break
                                else:
                                    r -= 1
                                k += 1
                        if eob:
                            while k <= se:
                                if block[k] and get(1):
                                    block[k] += (1 << al) * (1 if block[k] > 0 else -1)
                                k += 1
                            eob -= 1
    return np.concatenate([g.reshape(-1, 64) for g in grids])


def cases():
    rng = np.random.default_rng(8)
    return [
        rng.integers(0, 256, (13, 64)), rng.integers(0, 3, (9, 64)), np.zeros((2, 64), int), rng.integers(97, 123, (50, 64)),
        np.where(rng.random((20, 64)) < 0.06, rng.integers(0, 256, (20, 64)), 0), np.where(rng.random((20, 64)) < 0.2, rng.integers(-3, 4, (20, 64)), 0),
    ]


def test_coefficients_come_back():
    blocks = cases()
    files = jpeg.encode(blocks)
    images, found = jpeg.coefficients_of(files)
    for b, f, image, c in zip(blocks, files, images, found, strict=True):
        assert (c == sequential(f)).all()
        w, h = jpeg.geometry(len(b))
        mcu = np.empty((6 * w * h, 64), int)
        for k, which in enumerate("012"):
            mcu[jpeg._order(w, h, which)] = c[image.first[k] : image.first[k + 1]]
        assert (mcu[: len(b)] == b).all() and not mcu[len(b) :].any()


def test_transform_equals_the_definition():
    rng = np.random.default_rng(1)
    c = rng.integers(-60, 60, (5, 64))
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    m = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    natural = np.zeros((5, 64))
    natural[:, jpeg.ZIGZAG] = c
    want = np.einsum("bvu,vy,ux->byx", natural.reshape(5, 8, 8), m, m).reshape(5, 64) + 128
    assert np.abs(np.clip(want, 0, 255) - jpeg.clipped(c)).max() <= 1


def test_grey_picture():
    image = jpeg.Image.__new__(jpeg.Image)
    image.components, image.padded, image.first, image.height, image.width = [(1, 1, 1, 0)], [(1, 1)], np.array([0, 1]), 8, 8
    assert (jpeg.rgb(image, np.full((1, 64), 77, np.uint8)) == 77).all()


TEXTS = [None, "", "a", "x" * 64, "é" * 33, "long text " * 40_000, "same", "same", "\0\1\x02", "😀 mixed \x7f"]


def test_media_table(spark):
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    rows = media.decode_media(media.encode_media(df), tensors=True).orderBy("doc_id").collect()
    for t, r in zip(TEXTS, rows, strict=True):
        raw = (t or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, bytes(r.payload), r.payload_sha256) == (len(raw), len(want), want, hashlib.sha256(want).hexdigest())
        assert r.tail_crc32 == zlib.crc32(want[-64:]) and len(r.rgb) == r.height * r.width * 3
        sums = list(map(int, r.feature.split(":")[1:]))
        pixels = np.frombuffer(r.rgb, np.uint8).reshape(-1, 3).astype(int)
        assert sums == [v for c in range(3) for v in (pixels[:, c].sum(), (pixels[:, c] ** 2).sum())]
    assert rows[6][1:] == rows[7][1:]
    assert media.decode_media(media.encode_media(df.limit(0))).count() == 0


def test_other_files_are_refused():
    with pytest.raises((ValueError, IndexError)):
        jpeg.coefficients_of([b"\x89PNG\r\n\x1a\n" + b"\0" * 20])


def test_features_come_from_stored_tensors(spark, monkeypatch):
    """The query stores media and tensors, and what it returns is what the stored tensors say."""
    kept = []
    real = media.tensor_features
    monkeypatch.setattr(media, "ROUNDS", 2)
    monkeypatch.setattr(media, "tensor_features", lambda stored: kept.append((stored.inputFiles(), stored.count())) or real(stored))
    rows = [(1, "abc"), (2, "x" * 5000), (2, "x" * 5000), (3, None), (4, "é" * 700), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, media.media_features(df).collect()), key=str)
    assert got == sorted(map(tuple, media.decode_media(media.encode_media(df)).collect()), key=str)
    assert sum(n for _, n in kept) == len(rows) and all("tensors-" in f for files, _ in kept for f in files)


def test_few_tensors_at_once_and_media_read_once(spark, monkeypatch):
    """A part's tensors are a small share of all, and its media are files of its own."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(k, "".join(map(chr, rng.integers(33, 126, 400)))) for k in range(640)], "doc_id long, text string")
    rows, files = [], []
    features, decode = media.tensor_features, media.decode_media
    monkeypatch.setattr(media, "tensor_features", lambda stored: rows.append(stored.count()) or features(stored))
    monkeypatch.setattr(media, "decode_media", lambda m, tensors=False: files.append({r[0] for r in m.select(F.input_file_name()).distinct().collect()}) or decode(m, tensors))
    assert media.media_features(df).count() == 640 == sum(rows) and max(rows) <= 64
    assert len(set.union(*files)) == sum(map(len, files))
