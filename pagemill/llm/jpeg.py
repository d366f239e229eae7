"""Progressive JPEG in numpy: many images, or restart intervals, in lock step.

The decoder takes Huffman-coded progressive files (SOF2) of one or three
components: it accumulates spectral-selection and successive-approximation
scans into coefficient arrays, then transforms, upsamples and converts to RGB.
Each restart interval is a lane; numpy steps all lanes of a scan at once, so
intervals give the vector width.  Images with the same frame, tables and scan
script are decoded together.

The encoder writes given coefficients (unit quantisation, 4:2:0): DC and AC
first scans with one bit held back, then refinement scans.  What it writes is
what the decoder's coefficient arrays hold, without loss.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# The zigzag order (index in natural order of the k-th coefficient), from its rule.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
RESTART = 1
MCUS_WIDE, MOST_MCUS = 32, 65535 // 16

_u64 = np.uint64


def _basis() -> np.ndarray:
    """(zigzag coefficient, sample) in 1/8192: sums of integers, so exact in float64 whatever the order."""
    x, u = np.meshgrid(np.arange(8), np.arange(8))
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG] * 8192)


_IDCT = _basis()


class Huffman:
    """A canonical code from (symbol, length) pairs in code order."""

    def __init__(self, counts: list[int], symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.codes, self.sizes = np.zeros(256, _u64), np.zeros(256, np.int64)
        look_symbol, look_size = np.zeros(65536, np.uint8), np.full(65536, 1, np.uint8)
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                s = symbols[k]
                self.codes[s], self.sizes[s] = code, length
                look_symbol[code << (16 - length) : (code + 1) << (16 - length)] = s
                look_size[code << (16 - length) : (code + 1) << (16 - length)] = length
                code, k = code + 1, k + 1
            code <<= 1
        #: symbol and length of the code at the head of 16 bits
        self.look = look_symbol.astype(np.int64) | look_size.astype(np.int64) << 8

    @classmethod
    def of(cls, lengths: dict[int, int]) -> Huffman:
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        return cls([sum(v == n for v in lengths.values()) for n in range(1, 17)], bytes(order))

    def segment(self, cls: int, ident: int) -> bytes:
        return bytes([cls << 4 | ident, *self.counts]) + self.symbols


#: Lengths suit bytes of text with one bit held back: sizes 5 to 7 without a run come first.
_AC_LENGTHS = {r << 4 | s: 12 for r in range(16) for s in range(1, 8)} | {0xF0: 12, 0x06: 1, 0x05: 2, 0x07: 3, 0x00: 5, 1: 6, 2: 6, 3: 6, 4: 6}
DC, AC, REFINE = Huffman.of({s: 4 for s in range(10)}), Huffman.of(_AC_LENGTHS), Huffman.of({0x00: 1} | {r << 4 | 1: 6 for r in range(16)} | {0xF0: 6})


def _marker(code: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, code, len(body) + 2) + body


def geometry(n_blocks: int) -> tuple[int, int]:
    """MCUs (of six blocks) across and down that hold so many blocks."""
    n = -(-n_blocks // 6)
    # a side has at most 65,535 samples, MOST_MCUS MCUs: beyond MCUS_WIDE * MOST_MCUS of them a picture is wider
    wide = min(n, max(MCUS_WIDE, -(-n // MOST_MCUS)))
    if wide > MOST_MCUS:
        raise ValueError(f"{n_blocks} blocks are more than one picture holds")
    return wide, -(-n // wide)


class _Lanes:
    """Bit strings, one a lane, that grow by up to 32 bits at a time."""

    def __init__(self, n: int, cap_bits: int):
        self.acc, self.n, self.at = np.zeros(n, _u64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.out = np.zeros((n, cap_bits // 32 + 2), ">u4")
        self.most = 0

    def put(self, value: np.ndarray, size: np.ndarray, lanes: np.ndarray | slice = slice(None)) -> None:
        """Adds to the lanes; where size is 0 nothing is added."""
        more = int(size.max(initial=0))
        if self.most + more > 64:
            self.flush()
        self.most += more
        if isinstance(lanes, slice):
            self.acc <<= size.astype(_u64)
            self.acc |= value
            self.n += size
        else:
            self.acc[lanes] = self.acc[lanes] << size.astype(_u64) | value
            self.n[lanes] += size

    def flush(self) -> None:
        """Leaves less than 32 bits in each lane."""
        full = np.flatnonzero(self.n >= 32)
        n = self.n[full] - 32
        self.out[full, self.at[full]] = (self.acc[full] >> n.astype(_u64)) & _u64(0xFFFFFFFF)
        self.at[full] += 1
        self.n[full] = n
        self.most = 31

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All lanes' bytes, the last of each filled up with ones; bytes of each lane."""
        self.flush()
        gap = 32 - self.n
        rest = np.where(self.n > 0, (self.acc << gap.astype(_u64)) | ((_u64(1) << gap.astype(_u64)) - _u64(1)), 0) & _u64(0xFFFFFFFF)
        self.out[np.arange(len(self.n)), self.at] = rest
        size = (self.at * 32 + self.n + 7) // 8
        flat = self.out.view(np.uint8)
        return flat[np.arange(flat.shape[1]) < size[:, None]], size


def _size(v: np.ndarray) -> np.ndarray:
    """Bits of a magnitude below 2 ** 16."""
    return np.frexp(v.astype(np.float32))[1].astype(np.int64)


def _segments(data: np.ndarray, size: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffs zeros behind 0xFF and puts restart markers between lanes; ends of the lanes."""
    full = data == 0xFF
    end = np.cumsum(size)
    grown = np.concatenate([[0], np.cumsum(full)])
    marks = np.cumsum(np.where(last, 0, 2))
    lane = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data)) + grown[:-1] + (marks - np.where(last, 0, 2))[lane]
    ends = end + grown[end] + marks
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[at] = data
    inner = np.flatnonzero(~last)
    out[ends[inner] - 2] = 0xFF
    out[ends[inner] - 1] = 0xD0 + number[inner] % 8
    return out, ends


def _scan(blocks_of_lane: np.ndarray, coefficients: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes one scan; blocks_of_lane has a row of block numbers a lane, -1 where there is none."""
    n, units = blocks_of_lane.shape
    lanes = _Lanes(n, units * {"dc": 16, "dc2": 1, "ac": 63 * 19, "ac2": 63 * 8 + 8}[kind])
    prior: dict[int, np.ndarray] = {}
    for u in range(units):
        here = np.flatnonzero(blocks_of_lane[:, u] >= 0)
        if not len(here):
            break
        at = slice(None) if len(here) == n else here
        c = coefficients[blocks_of_lane[here, u]]
        if kind == "dc":
            now, slot = c[:, 0] >> 1, _component(u, units)
            d = now - prior.get(slot, np.zeros(n, np.int64))[here]
            prior.setdefault(slot, np.zeros(n, np.int64))[here] = now
            s = _size(np.abs(d))
            bits = np.where(d < 0, d + (1 << s) - 1, d).astype(_u64)
            lanes.put(DC.codes[s] << s.astype(_u64) | bits, DC.sizes[s] + s, at)
        elif kind == "dc2":
            lanes.put((c[:, 0] & 1).astype(_u64), np.ones(len(here), np.int64), at)
        elif kind == "ac":
            _ac_first(lanes, at, here, np.abs(c) >> 1, c < 0)
        else:
            _ac_refine(lanes, at, here, np.abs(c), c < 0)
    return lanes.bytes()


def _component(u: int, units: int) -> int:
    """Of the u-th block of an interleaved scan of 4:2:0 MCUs."""
    return max(0, u % 6 - 3)


def _ac_first(lanes: _Lanes, at, here: np.ndarray, v: np.ndarray, negative: np.ndarray) -> None:
    run = np.zeros(len(here), np.int64)
    sizes = _size(v)
    for k in range(1, 64):
        s = sizes[:, k]
        some = s > 0
        if not some.all():
            long = np.flatnonzero(some & (run > 15))
            while len(long):
                lanes.put(AC.codes[[0xF0]].repeat(len(long)), AC.sizes[[0xF0]].repeat(len(long)), here[long])
                run[long] -= 16
                long = long[run[long] > 15]
        symbol = np.minimum(run, 15) << 4 | s
        value = v[:, k]
        bits = np.where(negative[:, k], (1 << s) - 1 - value, value).astype(_u64)
        lanes.put(np.where(some, AC.codes[symbol] << s.astype(_u64) | bits, 0), np.where(some, AC.sizes[symbol] + s, 0), at)
        run = np.where(some, 0, run + 1)
    lanes.put(np.where(run > 0, AC.codes[0], 0), np.where(run > 0, AC.sizes[0], 0), at)


def _ac_refine(lanes: _Lanes, at, here: np.ndarray, v: np.ndarray, negative: np.ndarray) -> None:
    known, fresh = v > 1, v == 1
    fresh[:, 0] = known[:, 0] = False
    dense = known[:, 1:].all(1)
    if dense.any():  # correction bits alone: the end-of-band code of one bit and 63 more
        packed = np.packbits(v[dense] & 1 & (np.arange(64) > 0), axis=1).view(">u8").ravel().astype(_u64)
        one = here[dense]
        lanes.put(packed >> _u64(32), np.full(len(one), 32), one)
        lanes.put(packed & _u64(0xFFFFFFFF), np.full(len(one), 32), one)
        if dense.all():
            return
        here, v, known, fresh, negative = (x[~dense] for x in (here, v, known, fresh, negative))
    last = np.where(fresh.any(1), 63 - fresh[:, ::-1].argmax(1), 0)
    held, n_held, run = np.zeros(len(here), _u64), np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)

    def flush(which: np.ndarray, symbol: np.ndarray, sign: np.ndarray | None = None) -> None:
        code, size = REFINE.codes[symbol], REFINE.sizes[symbol]
        if sign is not None:
            code, size = code << _u64(1) | sign.astype(_u64), size + 1
        lanes.put(code, size, here[which])
        high = np.maximum(n_held[which] - 32, 0)
        lanes.put(held[which] >> np.minimum(n_held[which], 32).astype(_u64), high, here[which])
        lanes.put(held[which] & ((_u64(1) << np.minimum(n_held[which], 32).astype(_u64)) - _u64(1)), n_held[which] - high, here[which])
        held[which], n_held[which] = 0, 0

    any_fresh = fresh.any()
    for k in range(1, 64):
        if any_fresh:
            m = np.flatnonzero((run > 15) & (k <= last))
            if len(m):
                flush(m, np.full(len(m), 0xF0))
                run[m] -= 16
            m = np.flatnonzero(fresh[:, k])
            if len(m):
                flush(m, run[m] << 4 | 1, ~negative[m, k])
                run[m] = -1
            run += ~known[:, k]
        bit = known[:, k]
        held = held << bit.astype(_u64) | np.where(bit, v[:, k] & 1, 0).astype(_u64)
        n_held = n_held + bit
    rest = np.flatnonzero((n_held > 0) | ~known[:, 1:].all(1))
    # a block whose last coefficient is new has nothing left to say
    rest = rest[(n_held[rest] > 0) | (last[rest] < 63)]
    if len(rest):
        flush(rest, np.zeros(len(rest), np.int64))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each range, end to end."""
    until = np.cumsum(size)
    return np.arange(int(until[-1]) if len(until) else 0) + np.repeat(begin - (until - size), size)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """An image for each array (n, 64) of coefficients in zigzag order, -255 to 255, in the order of its MCUs."""
    shapes = [geometry(len(b)) for b in blocks]
    counts = np.array([6 * w * h for w, h in shapes])
    starts = np.concatenate([[0], np.cumsum(counts)])
    coefficients = np.zeros((starts[-1], 64), np.int64)
    coefficients[_ranges(starts[:-1], np.array([len(b) for b in blocks]))] = np.concatenate(blocks)
    scans = []
    lanes_of: dict[str, tuple] = {}
    for which in ("all", "0", "1", "2"):
        per = RESTART * (6 if which == "all" else 1)
        orders = [_order(w, h, which) for w, h in shapes]
        size = np.array([len(o) for o in orders])
        lanes = -(-size // per)
        until = np.cumsum(lanes)
        flat = np.full(int(until[-1]) * per, -1, np.int64)
        flat[_ranges((until - lanes) * per, size)] = np.concatenate(orders) + np.repeat(starts[:-1], size)
        number = _ranges(np.zeros(len(lanes), np.int64), lanes)
        last = np.zeros(int(until[-1]), bool)
        last[until - 1] = True
        lanes_of[which] = (flat.reshape(-1, per), number, last, until)
    script = [("all", "dc"), *((c, "ac") for c in "012"), ("all", "dc2"), *((c, "ac2") for c in "012")]
    for which, kind in script:
        rows, number, last, until = lanes_of[which]
        out, ends = _segments(*_scan(rows, coefficients, kind), number, last)
        cuts = np.concatenate([[0], ends[until - 1]])
        if which == "all":
            head = bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x01 if kind == "dc" else 0x10])
        else:
            head = bytes([1, int(which) + 1, 0x01 if kind == "ac2" else 0x00, 1, 63, 0x01 if kind == "ac" else 0x10])
        scans.append((_marker(0xDA, head), memoryview(out.tobytes()), cuts))
    tables = _marker(0xDB, bytes([0] + [1] * 64)) + _marker(0xC4, DC.segment(0, 0) + AC.segment(1, 0) + REFINE.segment(1, 1)) + _marker(0xDD, struct.pack(">H", RESTART))
    files = []
    for i, (w, h) in enumerate(shapes):
        frame = _marker(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        note = _marker(0xFE, b"blocks " + str(len(blocks[i])).encode())
        files.append(b"".join([b"\xff\xd8", note, tables, frame, *(x for head, out, cuts in scans for x in (head, out[cuts[i] : cuts[i + 1]])), b"\xff\xd9"]))
    return files


@lru_cache(maxsize=4096)
def _order(w: int, h: int, which: str) -> np.ndarray:
    """Blocks of a scan as numbers in MCU order; those of one component go row by row."""
    mcu = np.arange(w * h).reshape(h, w)
    if which == "all":
        return np.arange(6 * w * h)
    if which == "0":
        return np.stack([mcu * 6 + s for s in range(4)], -1).reshape(h, w, 2, 2).transpose(0, 2, 1, 3).ravel()
    return (mcu * 6 + 3 + int(which)).ravel()


class Image:
    """A parsed file: frame, tables as they stand at each scan, entropy-coded spans."""

    def __init__(self, data: bytes, marks: np.ndarray):
        """marks: offsets of markers other than restarts inside this file's bytes."""
        self.quant: dict[int, np.ndarray] = {}
        self.scans: list[tuple] = []
        self.blocks: int | None = None
        huffman: dict[int, bytes] = {}
        restart, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            code = data[at + 1]
            if code == 0xD9:
                break
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if code == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif code == 0xC4:
                while body:
                    total = sum(body[1:17])
                    huffman[body[0]] = bytes(body[1 : 17 + total])
                    body = body[17 + total :]
            elif code == 0xC2:
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif code == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif code == 0xFE and body.startswith(b"blocks "):
                self.blocks = int(body[7:])
            elif code == 0xDA:
                n = body[0]
                parts = tuple((next(k for k, c in enumerate(self.components) if c[0] == body[1 + 2 * j]), body[2 + 2 * j] >> 4, body[2 + 2 * j] & 15) for j in range(n))
                end = int(marks[np.searchsorted(marks, at)])
                ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
                table = tuple(huffman.get((0x10 | ac) if ss else dc, b"") for _, dc, ac in parts)
                self.scans.append(((tuple(p[0] for p in parts), ss, se, ah, al, table, restart), at, end))
                at = end
            elif 0xC0 <= code <= 0xCF:
                raise ValueError("only Huffman-coded progressive files are read")
        hm, vm = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.mcus = (-(-self.width // (8 * hm)), -(-self.height // (8 * vm)))
        #: of each component: blocks across in all MCUs, blocks down; the same without those that only fill up MCUs
        self.padded = [(self.mcus[0] * c[1], self.mcus[1] * c[2]) for c in self.components]
        self.exact = [(-(-(-(-self.width * c[1] // hm)) // 8), -(-(-(-self.height * c[2] // vm)) // 8)) for c in self.components]
        self.first = np.concatenate([[0], np.cumsum([w * h for w, h in self.padded])])

    def order(self, parts: tuple[int, ...]) -> tuple[np.ndarray, int]:
        """(blocks of a scan as numbers in component-after-component order, blocks a MCU)."""
        return _scan_order(tuple(self.components), tuple(self.padded), tuple(self.exact), parts)


@lru_cache(maxsize=4096)
def _scan_order(components: tuple, padded: tuple, exact: tuple, parts: tuple[int, ...]) -> tuple[np.ndarray, int]:
    first = np.concatenate([[0], np.cumsum([w * h for w, h in padded])])
    if len(parts) == 1:
        c = parts[0]
        w, h = exact[c]
        return (first[c] + np.arange(h)[:, None] * padded[c][0] + np.arange(w)).ravel(), 1
    grid = []
    for c in parts:
        _, hs, vs, _ = components[c]
        w, h = padded[c]
        b = (first[c] + np.arange(w * h)).reshape(h // vs, vs, w // hs, hs).transpose(0, 2, 1, 3)
        grid.append(b.reshape(h // vs, w // hs, vs * hs))
    both = np.concatenate(grid, -1)
    return both.ravel(), both.shape[-1]


class _Bits:
    """Reads at bit offsets, one a lane."""

    def __init__(self, data: np.ndarray, pos: np.ndarray):
        d = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
        self.single = np.unpackbits(np.concatenate([data, np.full(8, 0xFF, np.uint8)]))
        self.words = d[:-4] << 32 | d[1:-3] << 24 | d[2:-2] << 16 | d[3:-1] << 8 | d[4:]
        self.pos = pos

    def head(self, lanes) -> np.ndarray:
        """The next 32 bits."""
        pos = self.pos[lanes]
        return (self.words[pos >> 3] >> (8 - (pos & 7))) & 0xFFFFFFFF

    def symbol(self, table: np.ndarray, lanes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, its length, the 32 bits that it heads); nothing is consumed."""
        h = self.head(lanes)
        found = table[h >> 16]
        return found & 0xFF, found >> 8, h


def _value(h: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed value in the size bits behind the first skip bits."""
    bits = (h >> (32 - skip - size)) & ((1 << size) - 1)
    return np.where((bits >> np.maximum(size - 1, 0) == 0) & (size > 0), bits - (1 << size) + 1, bits)


def _read_scan(bits: _Bits, rows: np.ndarray, coefficients: np.ndarray, spec: tuple, unit: int, component: np.ndarray, tables: list[np.ndarray]) -> None:
    _, ss, se, ah, al, _, _ = spec
    n, units = rows.shape
    eob = np.zeros(n, np.int64)
    prior = np.zeros((n, int(component.max()) + 1), np.int64)
    for u in range(units):
        here = np.flatnonzero(rows[:, u] >= 0)
        if not len(here):
            break
        block = rows[here, u]
        if ss == 0 and ah == 0:
            c = component[u % unit]
            s, length, h = bits.symbol(tables[c], here)
            prior[here, c] += _value(h, length, s)
            coefficients[block, 0] = prior[here, c] << al
            bits.pos[here] += length + s
        elif ss == 0:
            coefficients[block, 0] |= ((bits.head(here) >> 31) & 1) << al
            bits.pos[here] += 1
        elif ah == 0:
            k = np.full(len(here), ss)
            active = np.flatnonzero(eob[here] == 0)
            eob[here] -= eob[here] > 0
            active = _dense_run(bits, here, block, coefficients, k, active, se, al, tables[0])
            while len(active):
                lane = here[active]
                symbol, length, h = bits.symbol(tables[0], lane)
                run, s = symbol >> 4, symbol & 15
                at = k[active] + run
                value = _value(h, length, s) << al
                some = s > 0
                if some.all():
                    coefficients[block[active], at] = value
                    bits.pos[lane] += length + s
                    k[active] = at + 1
                    active = active[at < se]
                    continue
                coefficients[block[active[some]], at[some]] = value[some]
                ends = ~some & (run < 15)
                extra = np.where(ends, run, s)
                eob[lane[ends]] = (1 << run[ends]) + ((h[ends] >> (32 - length[ends] - run[ends])) & ((1 << run[ends]) - 1)) - 1
                bits.pos[lane] += length + extra
                k[active] = at + 1
                active = active[~ends & (at < se)]
        else:
            _refine_block(bits, here, block, coefficients, ss, se, al, eob, tables[0])


def _dense_run(bits: _Bits, here: np.ndarray, block: np.ndarray, coefficients: np.ndarray, k: np.ndarray, active: np.ndarray, se: int, al: int, table: np.ndarray) -> np.ndarray:
    """Steps lanes together while their symbols have no run; the lanes, with their k, that other symbols hold up."""
    left, at = [], int(k[0]) if len(k) else se + 1
    pos = bits.pos[here[active]]
    column = np.empty((se + 1 - at, len(active)), np.int64)
    lanes, begin, filled = active, at, np.arange(len(active))
    while at <= se and len(lanes):
        h = (bits.words[pos >> 3] >> (8 - (pos & 7))) & 0xFFFFFFFF
        found = table[h >> 16]
        symbol, length = found & 0xFF, found >> 8
        odd = (symbol == 0) | (symbol > 15)
        if odd.any():
            k[lanes[odd]] = at
            bits.pos[here[lanes[odd]]] = pos[odd]
            left.append(lanes[odd])
            keep = ~odd
            coefficients[block[lanes[odd]], begin:at] = column[: at - begin, filled[odd]].T
            lanes, pos, h, symbol, length, filled = lanes[keep], pos[keep], h[keep], symbol[keep], length[keep], filled[keep]
        used = length + symbol
        value = (h >> (32 - used)) & ((1 << symbol) - 1)
        value -= (1 - (value >> (symbol - 1))) * ((1 << symbol) - 1)
        column[at - begin, filled if len(filled) < column.shape[1] else slice(None)] = value << al
        pos = pos + used
        at += 1
    if len(lanes):
        coefficients[block[lanes], begin : se + 1] = column[:, filled].T
        bits.pos[here[lanes]] = pos
    return np.concatenate(left) if left else active[:0]


def _refine_block(bits: _Bits, here: np.ndarray, block: np.ndarray, coefficients: np.ndarray, ss: int, se: int, al: int, eob: np.ndarray, table: np.ndarray) -> None:
    """eob counts the blocks, this one included, whose bands hold correction bits alone."""
    run, fresh = np.full(len(here), -1), np.zeros(len(here), np.int64)

    def fetch(which: np.ndarray) -> None:
        lane = here[which]
        symbol, length, h = bits.symbol(table, lane)
        r, s = symbol >> 4, symbol & 15
        ends = (s == 0) & (r < 15)
        extra = np.where(ends, r, s)
        tail = (h >> (32 - length - extra)) & ((1 << extra) - 1)
        eob[lane[ends]] = (1 << r[ends]) + tail[ends]
        bits.pos[lane] += length + extra
        run[which] = np.where(ends, -1, r)
        fresh[which] = np.where(s == 1, np.where(tail == 1, 1, -1) << al, 0)

    first = np.flatnonzero(eob[here] == 0)
    if len(first):
        fetch(first)
    plain = np.flatnonzero(run < 0)
    if len(plain):  # correction bits alone: all at once
        lane, band = here[plain], coefficients[block[plain], ss : se + 1]
        known = band != 0
        n = known.sum(1)
        if n.min() == se + 1 - ss:
            at = bits.pos[lane][:, None] + np.arange(se + 1 - ss)
        else:
            at = np.maximum(bits.pos[lane][:, None] + np.cumsum(known, 1) - 1, 0)
        bit = bits.single[at].astype(np.int64) << al
        bit[~known] = 0
        coefficients[block[plain], ss : se + 1] = band + np.where(band < 0, -bit, bit)
        bits.pos[lane] += n
        eob[lane] -= 1
    mixed = np.flatnonzero(run >= 0)
    for k in range(ss, se + 1):
        if not len(mixed):
            break
        if k > ss:
            need = mixed[(run[mixed] < 0) & (eob[here[mixed]] == 0)]
            if len(need):
                fetch(need)
        lane, b = here[mixed], block[mixed]
        old = coefficients[b, k]
        known = old != 0
        bit = (bits.head(lane) >> 31) & 1
        new = old + np.where(known, np.sign(old) * (bit << al), 0)
        place = ~known & (run[mixed] == 0)
        coefficients[b, k] = np.where(place, fresh[mixed], new)
        bits.pos[lane] += known
        run[mixed] = np.where(known | (run[mixed] < 0), run[mixed], run[mixed] - 1)
    lane = here[mixed]
    eob[lane] -= eob[lane] > 0


def parse(files: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Images, their bytes end to end, where each begins, where restart markers and stuffed zeros are."""
    data = np.frombuffer(b"".join(files), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in files])])
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    marks = full[(after != 0) & (after != 0xFF) & ~((after >= 0xD0) & (after <= 0xD7))]
    images = []
    for i, f in enumerate(files):
        own = marks[np.searchsorted(marks, starts[i]) : np.searchsorted(marks, starts[i + 1])] - starts[i]
        images.append(Image(f, own))
    return images, data, starts, full[(after >= 0xD0) & (after <= 0xD7)], full[after == 0] + 1


def coefficients_of(files: list[bytes]) -> tuple[list[Image], list[np.ndarray]]:
    """For each file its coefficients (blocks, 64) in zigzag order, component after component, row by row."""
    images, data, starts, restarts, stuffed = parse(files)
    keep = np.ones(len(data), bool)
    keep[stuffed] = False
    found: list[np.ndarray] = [None] * len(files)
    groups: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        groups.setdefault((tuple(s[0] for s in image.scans), tuple(image.components)), []).append(i)
    for (script, _), members in groups.items():
        sizes = [int(images[i].first[-1]) for i in members]
        base = np.concatenate([[0], np.cumsum(sizes)])
        whole = np.zeros((base[-1], 64), np.int64)
        for k, spec in enumerate(script):
            begin = np.array([starts[i] + images[i].scans[k][1] for i in members])
            end = np.array([starts[i] + images[i].scans[k][2] for i in members])
            taken = _ranges(begin, end - begin)
            raw = data[taken[keep[taken]]]
            # lanes begin where the scan does and behind each restart marker
            lo, hi = np.searchsorted(restarts, begin), np.searchsorted(restarts, end)
            lanes = hi - lo + 1
            lane = np.empty(int(lanes.sum()), np.int64)
            head = np.cumsum(lanes) - lanes
            lane[head] = begin
            inner = np.ones(len(lane), bool)
            inner[head] = False
            lane[inner] = restarts[_ranges(lo, hi - lo)] + 2
            gone = np.searchsorted(stuffed, end) - np.searchsorted(stuffed, begin)
            base_of = np.cumsum(end - begin - gone) - (end - begin - gone)
            owner = np.repeat(np.arange(len(members)), lanes)
            begins = lane - begin[owner] - (np.searchsorted(stuffed, lane) - np.searchsorted(stuffed, begin)[owner]) + base_of[owner]
            orders = [images[i].order(spec[0]) for i in members]
            unit = orders[0][1]
            size = np.array([len(o) for o, _ in orders])
            per = spec[6] * unit or int(size.max())
            if (-(-size // per) != lanes).any():
                raise ValueError("restart markers don't fit the scan")
            rows = np.full(len(lane) * per, -1, np.int64)
            rows[_ranges(head * per, size)] = np.concatenate([o for o, _ in orders]) + np.repeat(base[:-1], size)
            rows = rows.reshape(-1, per)
            parts = [images[members[0]].components[c] for c in spec[0]]
            component = np.repeat(np.arange(len(parts)), [p[1] * p[2] for p in parts]) if len(parts) > 1 else np.zeros(1, np.int64)
            tables = [_table(t) for t in spec[5]]
            _read_scan(_Bits(raw, begins * 8), rows, whole, spec, len(component), component, tables)
        for m, i in enumerate(members):
            found[i] = whole[base[m] : base[m + 1]]
    return images, found


_tables: dict[bytes, np.ndarray] = {}


def _table(raw: bytes) -> np.ndarray:
    if raw not in _tables:
        _tables[raw] = Huffman(list(raw[:16]), raw[16:]).look if raw else np.full(65536, 0x100, np.int64)
    return _tables[raw]


def dequantised(image: Image, coefficients: np.ndarray) -> np.ndarray:
    if all((q == 1).all() for q in image.quant.values()):
        return coefficients
    return coefficients * np.concatenate([np.broadcast_to(image.quant[c[3]], (w * h, 64)) for c, (w, h) in zip(image.components, image.padded, strict=True)])


def samples(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The blocks' samples 0 to 255 before planes are put together: (blocks, 64)."""
    return clipped(dequantised(image, coefficients))


def clipped(values: np.ndarray) -> np.ndarray:
    out = values.astype(np.float64) @ _IDCT
    out += 128.5 * 8192
    out *= 1 / 8192
    return np.clip(out, 0, 255, out=out).astype(np.uint8)


def channels(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> list[np.ndarray]:
    """R, G and B as int32 in 0 to 255."""
    y, cb, cr = y.astype(np.int32), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    # fixed values: ITU-R BT.601 in 1/65536
    out = [y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16)]
    return [np.clip(c, 0, 255, out=c) for c in out]


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """(height, width, 3) from the blocks' samples; chroma is repeated up to full resolution."""
    hm, vm = max(c[1] for c in image.components), max(c[2] for c in image.components)
    planes = []
    for k, (_, hs, vs, _) in enumerate(image.components):
        w, h = image.padded[k]
        plane = blocks[image.first[k] : image.first[k + 1]].reshape(h, w, 8, 8).transpose(0, 2, 1, 3).reshape(h * 8, w * 8)
        if vm != vs:
            plane = plane.repeat(vm // vs, 0)
        if hm != hs:
            plane = plane.repeat(hm // hs, 1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, -1)
    return np.stack(channels(*planes), -1).astype(np.uint8)
