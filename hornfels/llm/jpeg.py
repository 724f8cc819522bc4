"""Progressive JPEG in numpy, for batches of images.

Scans (spectral selection and successive approximation) are accumulated into coefficient arrays; restart
intervals are independent, so those of all images of a batch are decoded in step, a symbol of each at a time.
Coefficients are in zigzag order: (blocks, 64). Sequential frames are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Code lengths of the encoder's Huffman tables: (symbols, bits), in code order.
DC_CODES = [(range(12), 4)]
AC_CODES = [
    ([0x00, *range(0x01, 0x09)], 4),
    (range(0x11, 0x19), 6),
    ([r << 4 | s for r in range(16) for s in range(11) if not (r == 0 and s < 9) and not (r == 1 and 0 < s < 9)], 10),
]
#: The encoder's scans: components, Ss, Se, Ah, Al, restart interval.
SCRIPT = [
    ((0, 1, 2), 0, 0, 0, 1, 16),
    *[((c,), 1, 5, 0, 1, 8) for c in range(3)],
    *[((c,), 6, 63, 0, 0, 1) for c in range(3)],
    *[((c,), 1, 5, 1, 0, 8) for c in range(3)],
    ((0, 1, 2), 0, 0, 1, 0, 64),
]


@dataclass(frozen=True)
class Component:
    h: int
    v: int
    table: int
    wide: int  # blocks that hold samples
    high: int
    stride: int  # blocks with those that fill up whole MCUs
    rows: int
    base: int = 0  # first block in the batch's coefficient array


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)  # components, Ss, Se, Ah, Al, DC tables, AC table, interval, data


def huffman_table(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits that may come next: symbol << 5 | length; length 0 where no code fits."""
    table, code, at = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[code << (16 - length) : (code + 1) << (16 - length)] = symbols[at] << 5 | length
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _codes(groups: list) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length of each symbol, and the table as a DHT segment has it."""
    code, bits, value, before = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    counts, order = bytearray(16), bytearray()
    for symbols, n in groups:
        value <<= n - before
        for s in symbols:
            code[s], bits[s], value = value, n, value + 1
            counts[n - 1] += 1
            order.append(s)
        before = n
    return code, bits, bytes(counts) + bytes(order)


_DC, _AC = _codes(DC_CODES), _codes(AC_CODES)


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float32))[1].astype(np.int64)


def _extra(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << s) - 1, v)


def _ac_items(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, bits, length) of a first scan of the band ``z`` (blocks, coefficients), in order."""
    row, col = np.nonzero(z)
    v = z[row, col].astype(np.int64)
    same = np.concatenate(([False], row[1:] == row[:-1]))
    run = col - np.where(same, np.concatenate(([0], col[:-1])), -1) - 1
    s = _sizes(v)
    sym = (run & 15) << 4 | s
    bits, length = _AC[0][sym] << s | _extra(v, s), _AC[1][sym] + s
    if (run > 15).any():
        reps = 1 + (run >> 4)
        last = np.cumsum(reps) - 1
        row, full, wide = np.repeat(row, reps), np.full(reps.sum(), _AC[0][0xF0]), np.full(reps.sum(), _AC[1][0xF0])
        full[last], wide[last] = bits, length
        bits, length = full, wide
    short = np.flatnonzero(z[:, -1] == 0)
    if len(short):
        at = np.searchsorted(row, short, "right")
        row, bits, length = np.insert(row, at, short), np.insert(bits, at, _AC[0][0]), np.insert(length, at, _AC[1][0])
    return row, bits, length


def _refine_items(z: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a refinement of a band to ``bit``: new coefficients with the bits of old ones passed over."""
    rows, bits, lengths = [], [], []
    mag = np.abs(z.astype(np.int64)) >> bit
    n, k = z.shape
    old, new = mag > 1, mag == 1
    low = mag & 1
    last_new = np.where(new.any(1), k - 1 - np.argmax(new[:, ::-1], 1), -1)
    run, kept, kept_n = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(rows_: np.ndarray, value: np.ndarray, length: np.ndarray, order: int) -> None:
        rows.append(rows_ * 512 + order)
        bits.append(value)
        lengths.append(length)

    for j in range(k):
        zrl = (run > 15) & (j <= last_new)
        while zrl.any():
            r = np.flatnonzero(zrl)
            put(r, _AC[0][0xF0] << kept_n[r] | kept[r], _AC[1][0xF0] + kept_n[r], 4 * j)
            run[r], kept[r], kept_n[r] = run[r] - 16, 0, 0
            zrl = (run > 15) & (j <= last_new)
        r = np.flatnonzero(old[:, j])
        kept[r], kept_n[r] = kept[r] << 1 | low[r, j], kept_n[r] + 1
        r = np.flatnonzero(new[:, j])
        sym = run[r] << 4 | 1
        put(r, (_AC[0][sym] << 1 | (z[r, j] > 0)) << kept_n[r] | kept[r], _AC[1][sym] + 1 + kept_n[r], 4 * j + 1)
        run[r], kept[r], kept_n[r] = 0, 0, 0
        r = np.flatnonzero(mag[:, j] == 0)
        run[r] += 1
    r = np.flatnonzero((last_new < k - 1) & ((run > 0) | (kept_n > 0)))
    put(r, _AC[0][0] << kept_n[r] | kept[r], _AC[1][0] + kept_n[r], 4 * k)
    key = np.concatenate(rows)
    order = np.argsort(key, kind="stable")
    return key[order] // 512, np.concatenate(bits)[order], np.concatenate(lengths)[order]


def _pack(segment: np.ndarray, bits: np.ndarray, length: np.ndarray, segments: int, first: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each image, with stuffing and restart markers. ``first``: the images' first segments."""
    total = np.bincount(segment, weights=length, minlength=segments).astype(np.int64)
    size = (total + 7) >> 3
    start = np.concatenate(([0], np.cumsum(size)))
    ends = np.cumsum(length)
    begin = np.concatenate(([0], np.cumsum(total)))[:-1]
    at = ends - length - begin[segment] + 8 * start[segment]
    out = np.zeros(int(start[-1]) + 8, np.int64)
    word = bits << (40 - (at & 7) - length)  # length and shift fit in 40 bits
    byte = at >> 3
    for k in range(5):
        part = (word >> (32 - 8 * k)) & 255
        some = part != 0
        out += np.bincount(byte[some] + k, weights=part[some], minlength=len(out)).astype(np.int64)
    data = out[: int(start[-1])]
    pad = (8 * size - total)[size > 0]
    data[start[1:][size > 0] - 1] += (1 << pad) - 1
    data = data.astype(np.uint8)
    own = np.repeat(np.arange(segments), size)
    stuffed = np.cumsum(data == 255)
    image = np.zeros(segments, np.int64)
    image[first[1:]] = 1
    image = np.cumsum(image)
    marks = np.arange(segments) - image  # markers before a segment: one between segments of an image
    spot = np.arange(len(data)) + np.concatenate(([0], stuffed[:-1])) + 2 * marks[own]
    full = np.zeros(len(data) + (int(stuffed[-1]) if len(data) else 0) + 2 * int(marks[-1]), np.uint8)
    full[spot] = data
    inner = np.setdiff1d(np.arange(segments), first)
    seg_at = spot[start[inner]]  # no segment is empty
    full[seg_at - 2], full[seg_at - 1] = 255, 0xD0 + (inner - first[image[inner]] - 1) % 8
    cuts = [*spot[start[first]].tolist(), len(full)]
    return [full[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def encode(grids: list[tuple[int, int]], coefficients: np.ndarray, comments: list[bytes]) -> list[bytes]:
    """Files without subsampling and with quantisers of one. Grids: blocks wide and high of each image.

    ``coefficients``: (all blocks, 3, 64), images after each other, rows of blocks from the top.
    """
    n = np.array([w * h for w, h in grids])
    base = np.concatenate(([0], np.cumsum(n)))
    blocks, image = int(base[-1]), np.repeat(np.arange(len(n)), n)
    head = []
    for (w, h), text in zip(grids, comments, strict=True):
        frame = bytes([8]) + (8 * h).to_bytes(2, "big") + (8 * w).to_bytes(2, "big") + bytes([3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
        head.append(b"\xff\xd8" + _segment(0xFE, text) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC2, frame) + _segment(0xC4, b"\0" + _DC[2] + b"\x10" + _AC[2]))
    files = [[x] for x in head]
    for comps, ss, se, ah, al, interval in SCRIPT:
        many = len(comps)
        local = np.arange(blocks) - base[image]
        per = -(-n // interval)
        first = np.concatenate(([0], np.cumsum(per)))
        segment = first[image] + local // interval
        if ss == 0:
            dc = coefficients[:, :, 0].astype(np.int64)
            if ah:
                row, bits, length = np.repeat(np.arange(blocks), many), (dc.ravel() >> al) & 1, np.ones(blocks * many, np.int64)
            else:
                dc = dc >> al
                before = np.concatenate((np.zeros((1, many), np.int64), dc[:-1]))
                before[local % interval == 0] = 0
                diff = (dc - before).ravel()
                s = _sizes(diff)
                row, bits, length = np.repeat(np.arange(blocks), many), _DC[0][s] << s | _extra(diff, s), _DC[1][s] + s
        else:
            z = coefficients[:, comps[0], ss : se + 1]
            if ah:
                row, bits, length = _refine_items(z, al)
            else:
                row, bits, length = _ac_items(np.sign(z) * (np.abs(z) >> al) if al else z)
        data = _pack(segment[row], bits, length, int(first[-1]), first[:-1])
        scan = _segment(0xDD, interval.to_bytes(2, "big")) + _segment(0xDA, bytes([many, *[x for c in comps for x in (c + 1, 0)], ss, se, ah << 4 | al]))
        for f, d in zip(files, data, strict=True):
            f += [scan, d]
    return [b"".join(f) + b"\xff\xd9" for f in files]


def parse(data: bytes) -> Image:
    """Segments of a file; entropy-coded data stay as they are."""
    image, tables, interval, at = Image(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    raw = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    marks = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]  # restarts belong to the data
    while True:
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            return image
        size = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                image.quant[body[0] & 15], body = table.astype(np.float32), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = body[1 : 17 + n], body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            hm, vm = max(p[1] for p in parts), max(p[2] for p in parts)
            across, down = -(-image.width // (8 * hm)), -(-image.height // (8 * vm))
            for _, h, v, q in parts:
                image.components.append(Component(h, v, q, -(-image.width * h // (8 * hm)), -(-image.height * v // (8 * vm)), across * h, down * v))
            number = {p[0]: k for k, p in enumerate(parts)}
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only progressive Huffman frames are read")
        elif marker == 0xDA:
            n = body[0]
            comps = tuple(number[body[1 + 2 * k]] for k in range(n))
            dc = tuple(tables.get(body[2 + 2 * k] >> 4) for k in range(n))
            ac = tables.get(0x10 | body[2] & 15)
            ss, se, approx = body[1 + 2 * n : 4 + 2 * n]
            end = int(marks[np.searchsorted(marks, at)])
            image.scans.append((comps, ss, se, approx >> 4, approx & 15, dc, ac, interval, raw[at:end]))
            at = end


class _Lanes:
    """Restart intervals of scans of one kind, to be read in step."""

    def __init__(self, pieces: list[np.ndarray]):
        whole = np.concatenate(pieces)
        size = np.array([len(p) for p in pieces])
        keep = np.ones(len(whole), bool)
        keep[1:] = ~((whole[1:] == 0) & (whole[:-1] == 255))
        restart = np.zeros(len(whole), bool)
        restart[:-1] = (whole[:-1] == 255) & (whole[1:] >= 0xD0) & (whole[1:] <= 0xD7)
        keep &= ~restart
        keep[1:] &= ~restart[:-1]
        solid = np.concatenate(([0], np.cumsum(keep)))
        ends = np.cumsum(size)
        marks = np.flatnonzero(restart)
        starts = np.sort(np.concatenate((ends - size, marks + 2)))
        self.pos = solid[starts] * 8
        self.per_piece = np.diff(np.searchsorted(starts, np.concatenate((ends - size, ends[-1:]))))
        data = np.concatenate((whole[keep], np.zeros(8, np.uint8))).astype(np.uint64)
        n = len(data) - 5
        self.window = np.zeros(n, np.uint64)  # the 40 bits from each byte on
        for k in range(5):
            self.window |= data[k : k + n] << np.uint64(32 - 8 * k)
        self.window = self.window.astype(np.int64)

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """The next 33 bits at least, at the top of 40."""
        return (self.window[np.minimum(pos >> 3, len(self.window) - 1)] << (pos & 7)) & ((1 << 40) - 1)


def _extend(v: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << np.maximum(s - 1, 0)), v - (1 << s) + 1, v)


def _symbol(lanes: _Lanes, pos: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, the 40 bits that follow (16 fewer in the worst case), and the position after the code."""
    v = lanes.peek(pos)
    e = table[v >> 24]
    length = e & 31
    if not length.all():
        raise ValueError("bits that are no Huffman code")
    return e >> 5, (v << length) & ((1 << 40) - 1), pos + length


def _dc(lanes: _Lanes, coef: np.ndarray, blocks: np.ndarray, parts: np.ndarray, tables: list[np.ndarray], ah: int, al: int) -> None:
    """blocks: (lanes, steps) block of each step or -1 after the end; parts: the component of each step of an MCU."""
    pos, pred = lanes.pos.copy(), np.zeros((len(blocks), int(parts.max()) + 1), np.int64)
    for t in range(blocks.shape[1]):
        on = np.flatnonzero(blocks[:, t] >= 0)
        at, c = blocks[on, t], int(parts[t % len(parts)])
        if ah:
            coef[at, 0] |= ((lanes.peek(pos[on]) >> 39) << al).astype(coef.dtype)
            pos[on] += 1
            continue
        s, rest, pos[on] = _symbol(lanes, pos[on], tables[c])
        pred[on, c] += np.where(s > 0, _extend(rest >> (40 - s), s), 0)
        pos[on] += s
        coef[at, 0] = pred[on, c] << al


def _ac_first(lanes: _Lanes, coef: np.ndarray, blocks: np.ndarray, table: np.ndarray, ss: int, se: int, al: int) -> None:
    count = (blocks >= 0).sum(1)
    flat, wide = coef.reshape(-1), blocks.shape[1]
    lane = np.flatnonzero(count > 0)
    pos, k, b = lanes.pos[lane].copy(), np.full(len(lane), ss), np.zeros(len(lane), np.int64)
    count = count[lane]
    own = blocks[lane, 0] * 64
    while len(lane):
        rs, rest, pos = _symbol(lanes, pos, table)
        r, s = rs >> 4, rs & 15
        k = k + r
        some = s > 0
        if some.all():
            flat[own + k] = _extend(rest >> (40 - s), s) << al
            k, pos, skip = k + 1, pos + s, None
        else:
            i = np.flatnonzero(some)
            flat[own[i] + k[i]] = _extend(rest[i] >> (40 - s[i]), s[i]) << al
            runs = ~some & (r < 15)
            skip = np.where(runs, (1 << r) + (rest >> (40 - r)), 0)  # blocks that end here and after
            pos = pos + np.where(some, s, np.where(runs, r, 0))
            k = np.where(runs, se + 1, k + 1)
        over = np.flatnonzero(k > se)
        if len(over):
            b[over] += 1 if skip is None else np.maximum(1, skip[over])
            k[over] = ss
            going = b[over] < count[over]
            stay = over[going]
            own[stay] = blocks[lane[stay], np.minimum(b[stay], wide - 1)] * 64
            if not going.all():
                keep = np.ones(len(lane), bool)
                keep[over[~going]] = False
                lane, pos, k, b, count, own = lane[keep], pos[keep], k[keep], b[keep], count[keep], own[keep]


def _ac_refine(lanes: _Lanes, coef: np.ndarray, blocks: np.ndarray, table: np.ndarray, ss: int, se: int, al: int) -> None:
    """A lane either reads a symbol or passes one coefficient in a step."""
    count = (blocks >= 0).sum(1)
    flat, bit = coef.reshape(-1), 1 << al
    lane = np.flatnonzero(count > 0)
    pos, k, b = lanes.pos[lane].copy(), np.full(len(lane), ss), np.zeros(len(lane), np.int64)
    count, run, value, eob = count[lane], np.full(len(lane), -1), np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    while len(lane):
        ask = np.flatnonzero((run < 0) & (eob == 0))
        if len(ask):
            rs, rest, after = _symbol(lanes, pos[ask], table)
            r, s = rs >> 4, rs & 15
            ends = (s == 0) & (r < 15)
            eob[ask] = np.where(ends, (1 << r) + (rest >> (40 - r)), 0)
            run[ask] = np.where(ends, -1, r)
            value[ask] = np.where(s > 0, np.where(rest >> 39, bit, -bit), 0)
            pos[ask] = after + np.where(ends, r, np.where(s > 0, 1, 0))
        at = blocks[lane, b] * 64 + k
        old = flat[at].astype(np.int64)
        known = old != 0
        fix = known & ((lanes.peek(pos) >> 39) > 0) & ((np.abs(old) & bit) == 0)
        new = ~known & (run == 0)
        flat[at] = np.where(fix, old + np.sign(old) * bit, np.where(new, value, old))
        pos, run = pos + known, np.where(known, run, np.where(run >= 0, run - 1, run))
        k = k + 1
        over = k > se
        k = np.where(over, ss, k)
        run = np.where(over, -1, run)
        eob, b = eob - (over & (eob > 0)), b + over
        keep = b < count
        if not keep.all():
            lane, pos, k, b, count, run, value, eob = (x[keep] for x in (lane, pos, k, b, count, run, value, eob))


@lru_cache(maxsize=4096)
def _grid(shape: tuple[tuple[int, ...], ...], interval: int) -> tuple[np.ndarray, np.ndarray]:
    """(lanes, steps) of block numbers of a scan, -1 for none; and the place in the scan of each step's component.

    ``shape``: h, v, wide, high, stride, rows and base of each component, bases from that of the first.
    """
    if len(shape) == 1:
        _, _, wide, high, stride, _, base = shape[0]
        n = np.arange(wide * high)
        units, parts = (base + n // wide * stride + n % wide)[:, None], np.zeros(1, np.int64)
    else:
        h, v, _, _, stride, rows, _ = shape[0]
        across = stride // h
        m = np.arange(across * (rows // v))
        columns, parts = [], []
        for k, (h, v, _, _, stride, _, base) in enumerate(shape):
            for y in range(v):
                for x in range(h):
                    columns.append(base + (m // across * v + y) * stride + m % across * h + x)
                    parts.append(k)
        units, parts = np.stack(columns, 1), np.array(parts)
    step = interval or len(units)
    lanes = -(-len(units) // step)
    full = np.full((lanes * step, units.shape[1]), -1)
    full[: len(units)] = units
    return full.reshape(lanes, -1), parts


def _scan_blocks(image: Image, comps: tuple[int, ...], interval: int) -> tuple[np.ndarray, np.ndarray]:
    own = [image.components[c] for c in comps]
    shape = tuple((c.h, c.v, c.wide, c.high, c.stride, c.rows, c.base - own[0].base) for c in own)
    small = own[0].stride * own[0].rows <= 4096
    grid, parts = (_grid if small else _grid.__wrapped__)(shape, interval)
    return np.where(grid < 0, -1, grid + own[0].base), parts


def decode(files: list[bytes]) -> tuple[list[Image], np.ndarray]:
    """Images with their components placed in the coefficient array (blocks, 64), which all scans have filled."""
    images, base = [parse(f) for f in files], 0
    for image in images:
        for k, c in enumerate(image.components):
            image.components[k] = Component(c.h, c.v, c.table, c.wide, c.high, c.stride, c.rows, base)
            base += c.stride * c.rows
    coef = np.zeros((base, 64), np.int16)
    steps: dict[int, dict[tuple, list]] = {}
    for image in images:
        step, before, seen = -1, None, set()
        for comps, ss, se, ah, al, dc, ac, interval, data in image.scans:
            kind = (ss, se, ah, al)
            if kind != before or ss == 0 or seen & set(comps):  # else it is of other components, and independent
                step, seen = step + 1, set()
            before, seen = kind, seen | set(comps)
            shape = tuple((image.components[c].h, image.components[c].v) for c in comps) if len(comps) > 1 else 1
            steps.setdefault(step, {}).setdefault((kind, dc if ss == 0 and not ah else None, ac if ss else None, shape), []).append((image, comps, interval, data))
    tables: dict[bytes, np.ndarray] = {}

    def table(spec: bytes) -> np.ndarray:
        if spec not in tables:
            tables[spec] = huffman_table(spec[:16], spec[16:])
        return tables[spec]

    for step in sorted(steps):
        for (kind, dc, ac, _), scans in steps[step].items():
            ss, se, ah, al = kind
            grids = [_scan_blocks(image, comps, interval) for image, comps, interval, _ in scans]
            lanes = _Lanes([data for *_, data in scans])
            if lanes.per_piece.tolist() != [len(g) for g, _ in grids]:
                raise ValueError("restart intervals are missing")
            wide = max(g.shape[1] for g, _ in grids)
            blocks = np.concatenate([g if g.shape[1] == wide else np.pad(g, ((0, 0), (0, wide - g.shape[1])), constant_values=-1) for g, _ in grids])
            if ss == 0:
                _dc(lanes, coef, blocks, grids[0][1], [table(t) for t in dc] if dc else [], ah, al)
            else:
                (_ac_refine if ah else _ac_first)(lanes, coef, blocks, table(ac), ss, se, al)
    return images, coef


def _basis() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return (np.where(k == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)).astype(np.float32)


_BASIS = _basis()


def inverse(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of blocks: (blocks, 8, 8). Elementwise, so that a block's result does not hang on its batch."""
    square = np.empty((64, len(coef)), np.float32)
    square[ZIGZAG] = coef.T * quant[:, None]
    square = square.reshape(8, 8, -1)
    for _ in range(2):
        done = np.empty_like(square)
        even = [sum(square[k] * _BASIS[k, x] for k in (0, 2, 4, 6)) for x in range(4)]
        odd = [sum(square[k] * _BASIS[k, x] for k in (1, 3, 5, 7)) for x in range(4)]
        for x in range(4):
            done[x], done[7 - x] = even[x] + odd[x], even[x] - odd[x]
        square = done.transpose(1, 0, 2)
    return np.clip(np.rint(square + 128), 0, 255).astype(np.uint8).transpose(2, 0, 1)


def plane(c: Component, blocks: np.ndarray) -> np.ndarray:
    return blocks.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(c.rows * 8, c.stride * 8)


def rgb(image: Image, coef: np.ndarray, samples: Callable[[Component], np.ndarray] | None = None) -> np.ndarray:
    """(height, width, 3) bytes: chroma repeated to full resolution and turned from YCbCr."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        own = samples(c) if samples else inverse(coef[c.base : c.base + c.stride * c.rows], image.quant[c.table])
        p = plane(c, own)
        p = p.repeat(vm // c.v, 0).repeat(hm // c.h, 1) if (hm, vm) != (c.h, c.v) else p
        planes.append(p[: image.height, : image.width].astype(np.float32))
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    out = np.stack((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb), 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
