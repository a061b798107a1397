"""Progressive JPEG in numpy, many files at a time.

Files have three components at 4:2:0 and a restart interval, so that every
interval of every file is a lane of its own and lanes are coded and decoded in
step. Scans select a band of the spectrum and one bit of precision (successive
approximation) and add up in coefficient arrays; the inverse transform and
chroma upsampling give full-resolution RGB tensors.
"""

from __future__ import annotations

import functools
import struct
from typing import NamedTuple

import numpy as np

#: Scans: components, first and last coefficient, bit position before (0: first scan of the band) and after.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1)] + [((c,), low, high, 0, 1) for low, high in ((1, 5), (6, 63)) for c in range(3)] + [((0, 1, 2), 0, 0, 1, 0)] + [((c,), 1, 63, 1, 0) for c in range(3)]
#: Blocks of a component in one unit (16 x 16 pixels), and where they begin among its six.
IN_UNIT, AT_UNIT = (4, 1, 1), (0, 4, 5)


def _zigzag() -> np.ndarray:
    """Place (row * 8 + column) of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()


class Huffman(NamedTuple):
    """``bits``: how many codes of each length 1 to 16; ``symbols`` in order; codes and lengths by symbol; ``table``: length << 8 | symbol by the next 16 bits."""

    bits: bytes
    symbols: bytes
    code: np.ndarray
    length: np.ndarray
    table: np.ndarray


@functools.lru_cache(64)
def huffman(bits: bytes, symbols: bytes) -> Huffman:
    code, length, table = np.zeros(256, np.uint64), np.zeros(256, np.int64), np.zeros(65_536, np.int64)
    value, at = 0, 0
    for size in range(1, 17):
        for _ in range(bits[size - 1]):
            code[symbols[at]], length[symbols[at]] = value, size
            table[value << (16 - size) : (value + 1) << (16 - size)] = size << 8 | symbols[at]
            value, at = value + 1, at + 1
        value <<= 1
    return Huffman(bits, symbols, code, length, table)


def _by_length(groups: dict[int, list[int]]) -> Huffman:
    bits = bytes(len(groups.get(size, [])) for size in range(1, 17))
    return huffman(bits, bytes(s for size in sorted(groups) for s in groups[size]))


#: Tables: differences of the first coefficient; bands, short codes for runs of no zeros; refinements.
DC = _by_length({4: list(range(12))})
_FAST = {1: [0x04], 3: [0x03, 0x06], 4: [0x02, 0x05], 5: [0x01, 0x07], 6: [0x00]}
AC = _by_length(_FAST | {12: [s for s in [*(r << 4 | k for r in range(16) for k in range(1, 8)), 0xF0] if s not in sum(_FAST.values(), [])]})
REFINE = _by_length({1: [0x00], 6: [*(r << 4 | 1 for r in range(16)), 0xF0]})


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _magnitude(v: np.ndarray) -> np.ndarray:
    """Bits of |v|."""
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def _signed(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The extra bits of a value: as it is, or less by one in its bits if negative."""
    return np.where(v < 0, v + (1 << size) - 1, v).astype(np.uint64)


def _write(lane: np.ndarray, code: np.ndarray, size: np.ndarray, lanes: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all lanes (codes of up to 32 bits in order of lane), padded with ones, stuffed, each but a file's last ended by its restart marker; and where each lane begins."""
    total = np.bincount(lane, size, lanes).astype(np.int64)
    bytes_in = (total + 7) // 8
    begin = np.concatenate(([0], np.cumsum(bytes_in)))
    before = np.cumsum(size) - size
    first = np.concatenate(([0], np.cumsum(total)))[:-1]
    at = begin[lane] * 8 + before - first[lane]
    pad = bytes_in * 8 - total
    at = np.concatenate([at, begin[:-1] * 8 + total])
    code = np.concatenate([code, (np.uint64(1) << pad.astype(np.uint64)) - np.uint64(1)])
    size = np.concatenate([size, pad])
    spread = code << (np.uint64(40) - size.astype(np.uint64) - (at & 7).astype(np.uint64))
    data = np.zeros(int(begin[-1]) + 5)
    reach = (at & 7) + size
    for j in range(5):
        use = reach > 8 * j
        if use.any():
            data += np.bincount((at[use] >> 3) + j, (spread[use] >> np.uint64(32 - 8 * j) & np.uint64(255)).astype(np.float64), len(data))
    data = data[: int(begin[-1])].astype(np.uint8)
    # stuffing, and markers 0 to 7 in turn
    full = np.concatenate(([0], np.cumsum(data == 255)))
    file_first = np.concatenate(([True], last[:-1]))
    turn = np.arange(lanes) - np.maximum.accumulate(np.where(file_first, np.arange(lanes), 0))
    markers = np.where(last, 0, 2)
    out_begin = np.concatenate(([0], np.cumsum(bytes_in + np.diff(full[begin]) + markers)))
    owner = np.repeat(np.arange(lanes), bytes_in)
    place = out_begin[owner] + np.arange(len(data)) - begin[owner] + full[:-1] - full[begin[owner]]
    out = np.zeros(int(out_begin[-1]), np.uint8)
    out[place] = data
    ends = out_begin[1:][~last]
    out[ends - 2], out[ends - 1] = 255, 0xD0 + turn[~last] % 8
    return out, out_begin


def layout(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units across and down for files of at least so many units."""
    across = np.minimum(np.ceil(np.sqrt(units)).astype(np.int64), 4095)
    return across, -(-units // across)


def _order(across: np.ndarray, down: np.ndarray, component: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (unit * 6 + block) of a component's blocks as its own scan has them, and the number of each file's blocks."""
    units = across * down
    n = units * IN_UNIT[component]
    first = np.cumsum(units) - units
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = np.repeat(first, n)
    if component:
        return (base + k) * 6 + AT_UNIT[component], n
    wide = np.repeat(2 * across, n)
    y, x = k // wide, k % wide
    return (base + (y >> 1) * (wide >> 1) + (x >> 1)) * 6 + (y & 1) * 2 + (x & 1), n


def _first_codes(values: np.ndarray, table: Huffman) -> tuple[np.ndarray, np.ndarray]:
    """Codes and sizes of a band's first scan, one for each coefficient and one for the rest of zeros."""
    n, width = values.shape
    some = values != 0
    at = np.where(some, np.arange(width), -1)
    past = np.maximum.accumulate(at, axis=1)
    run = np.arange(width) - 1 - np.concatenate([np.full((n, 1), -1), past[:, :-1]], axis=1)
    size = _magnitude(values)
    symbol = (run % 16) << 4 | size
    code = table.code[symbol] << size.astype(np.uint64) | _signed(values, size)
    bits = table.length[symbol] + size
    code, bits = np.where(some, code, 0).astype(np.uint64), np.where(some, bits, 0)
    skips = np.where(some, run // 16, 0)
    rest = past[:, -1:] < width - 1
    code = np.concatenate([code, np.where(rest, table.code[0], 0).astype(np.uint64)], axis=1)
    bits = np.concatenate([bits, np.where(rest, table.length[0], 0)], axis=1)
    if skips.any():  # sixteen zeros, up to three times in front of a code
        front = np.zeros((n, width + 1, 4), np.uint64)
        sizes = np.zeros((n, width + 1, 4), np.int64)
        for k in range(3):
            front[:, :width, k] = np.where(skips > k, table.code[0xF0], 0)
            sizes[:, :width, k] = np.where(skips > k, table.length[0xF0], 0)
        front[:, :, 3], sizes[:, :, 3] = code, bits
        return front.reshape(n, -1), sizes.reshape(n, -1)
    return code, bits


def _refine_codes(values: np.ndarray, table: Huffman) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lanes, codes and sizes of the scan that adds the lowest bit."""
    n, width = values.shape
    size = np.abs(values)
    fresh = size == 1
    final = np.where(fresh.any(1), width - 1 - np.argmax(fresh[:, ::-1], axis=1), -1)
    run, held, kept = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def emit(who: np.ndarray, code: np.ndarray, bits: np.ndarray) -> None:
        out.append((who, code, bits))
        count = kept[who]
        out.append((who, held[who] >> np.uint64(32), np.maximum(count - 32, 0)))
        out.append((who, held[who] & np.uint64(0xFFFFFFFF), np.minimum(count, 32)))
        held[who], kept[who] = 0, 0

    for k in range(width):
        now = size[:, k]
        while len(long := np.flatnonzero((now > 0) & (run > 15) & (k <= final))):
            emit(long, np.full(len(long), table.code[0xF0]), np.full(len(long), table.length[0xF0]))
            run[long] -= 16
        old = now > 1
        held = np.where(old, held << np.uint64(1) | (now & 1).astype(np.uint64), held)
        kept += old
        if len(new := np.flatnonzero(now == 1)):
            symbol = run[new] << 4 | 1
            emit(new, table.code[symbol] << np.uint64(1) | (values[new, k] > 0).astype(np.uint64), table.length[symbol] + 1)
            run[new] = 0
        run += now == 0
    rest = np.flatnonzero((run > 0) | (kept > 0))
    emit(rest, np.full(len(rest), table.code[0]), np.full(len(rest), table.length[0]))
    lane, code, bits = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(lane, kind="stable")
    return lane[order], code[order].astype(np.uint64), bits[order]


def encode(coefficients: np.ndarray, across: np.ndarray, down: np.ndarray) -> list[bytes]:
    """Files of coefficients (rows: unit by unit, four luma and two chroma blocks each; columns in zigzag order; between -1023 and 1023)."""
    units = across * down
    unit_last = np.zeros(int(units.sum()), bool)
    unit_last[np.cumsum(units) - 1] = True
    parts: list[tuple[bytes, np.ndarray, np.ndarray]] = []
    for components, low, high, past, now in SCRIPT:
        head = _segment(0xDA, bytes([len(components)]) + b"".join(bytes([c + 1, (0 if low == 0 else 1 if not past else 2)]) for c in components) + bytes([low, high, past << 4 | now]))
        if low == 0:
            dc = coefficients[:, 0].reshape(-1, 6)
            if past:
                code = ((dc & 1) << np.arange(5, -1, -1)).sum(1).astype(np.uint64)
                lane, code, bits = np.arange(len(dc)), code, np.full(len(dc), 6)
            else:
                diff = dc >> now
                diff[:, 1:4] -= diff[:, 0:3].copy()
                size = _magnitude(diff)
                code = (DC.code[size] << size.astype(np.uint64) | _signed(diff, size)).ravel()
                lane, bits = np.repeat(np.arange(len(dc)), 6), (DC.length[size] + size).ravel()
            data, begin = _write(lane, code, bits, len(dc), unit_last)
            first = np.concatenate(([0], np.cumsum(units)))
        else:
            rows, n = _order(across, down, components[0])
            values = coefficients[rows, low : high + 1]
            last = np.zeros(len(rows), bool)
            last[np.cumsum(n) - 1] = True
            if past:
                lane, code, bits = _refine_codes(values, REFINE)
            else:
                code, bits = _first_codes(np.sign(values) * (np.abs(values) >> now), AC)
                lane = np.repeat(np.arange(len(rows)), code.shape[1])
                code, bits = code.ravel(), bits.ravel()
                some = bits > 0
                lane, code, bits = lane[some], code[some], bits[some]
            data, begin = _write(lane, code, bits, len(rows), last)
            first = np.concatenate(([0], np.cumsum(n)))
        parts.append((head, data, begin[first]))
    tables = b"".join(_segment(0xC4, bytes([kind]) + t.bits + t.symbols) for kind, t in ((0x00, DC), (0x10, DC), (0x11, AC), (0x12, REFINE)))
    front = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
    middle = _segment(0xDD, b"\x00\x01") + tables
    blobs = [(head, data.tobytes(), edges.tolist()) for head, data, edges in parts]
    out = []
    for f in range(len(across)):
        size = _segment(0xC2, struct.pack(">BHHB", 8, 16 * int(down[f]), 16 * int(across[f]), 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        out.append(b"".join([front, size, middle, *(x for head, data, edges in blobs for x in (head, data[edges[f] : edges[f + 1]])), b"\xff\xd9"]))
    return out


class Scan(NamedTuple):
    components: tuple[int, ...]
    low: int
    high: int
    past: int
    now: int
    tables: tuple[Huffman | None, ...]
    restart: int


class Parsed(NamedTuple):
    across: int
    down: int
    scans: list[tuple[Scan, bytes]]
    quantization: list[np.ndarray]


def parse(file: bytes) -> Parsed:
    """Frame and scans of a progressive file of three components at 4:2:0."""
    data = np.frombuffer(file, np.uint8)
    full = np.flatnonzero(data[:-1] == 255)
    after = data[full + 1]
    real = full[(after != 0) & (after != 255) & ~((after >= 0xD0) & (after <= 0xD7))].tolist()
    at, restart, across, down = 2, 0, 0, 0
    tables: dict[int, Huffman] = {}
    quant: dict[int, np.ndarray] = {}
    frame: list[tuple[int, int]] = []
    scans: list[tuple[Scan, bytes]] = []
    while at < len(file) - 1:
        marker = file[at + 1]
        if marker == 0xD9:
            break
        size = file[at + 2] << 8 | file[at + 3]
        body, end = file[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xC2:
            height, width = struct.unpack(">HH", body[1:5])
            across, down = -(-width // 16), -(-height // 16)
            frame = [(body[6 + 3 * c], body[8 + 3 * c]) for c in range(body[5])]
            if body[5] != 3 or [body[7 + 3 * c] for c in range(3)] != [0x22, 0x11, 0x11]:
                raise ValueError("only three components at 4:2:0")
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive files")
        elif marker == 0xDA:
            n = body[0]
            ids = [f[0] for f in frame]
            low, high, position = body[1 + 2 * n : 4 + 2 * n]
            used = tuple(tables.get(body[2 + 2 * k] >> 4 if low == 0 else 0x10 | body[2 + 2 * k] & 15) for k in range(n))
            stop = next((r for r in real if r >= end), len(file))
            scans.append((Scan(tuple(ids.index(body[1 + 2 * k]) for k in range(n)), low, high, position >> 4, position & 15, used if position >> 4 == 0 or low else (None,) * n, restart), file[end:stop]))
            end = stop
        at = end
    return Parsed(across, down, scans, [quant[q] for _, q in frame])


class _Lanes:
    """Entropy-coded bits of many restart intervals, each read from its own place."""

    def __init__(self, blobs: list[bytes]):
        data = np.frombuffer(b"".join(blobs) + b"\xff" * 2, np.uint8)
        edges = np.cumsum([0, *map(len, blobs)])
        full = np.flatnonzero(data[:-2] == 255)
        after = data[full + 1]
        keep = np.ones(len(data), bool)
        keep[full[after == 0] + 1] = False
        marks = full[(after >= 0xD0) & (after <= 0xD7)]
        keep[marks] = keep[marks + 1] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        starts = np.sort(np.concatenate([edges[:-1], marks + 2]))
        self.file = np.searchsorted(edges, starts, "right") - 1
        clean = np.concatenate([data[keep], np.full(8, 255, np.uint8)]).astype(np.uint64)
        self.window = sum(clean[k : len(clean) - 7 + k] << np.uint64(56 - 8 * k) for k in range(8))
        self.at = kept[starts] * 8

    def look(self, who: np.ndarray) -> np.ndarray:
        """The next 57 bits or more of some lanes, in the highest places."""
        at = np.minimum(self.at[who], 8 * len(self.window) - 8)
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def bit(self, who: np.ndarray) -> np.ndarray:
        out = self.look(who) >> np.uint64(63)
        self.at[who] += 1
        return out.astype(np.int64)


def _top(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The highest ``size`` (0 to 16) bits."""
    return (bits >> np.uint64(32) >> (np.uint64(32) - size.astype(np.uint64))).astype(np.int64)


def _extend(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)


def _scan(scan: Scan, blobs: list[bytes], rows_of_unit: list[np.ndarray], out: np.ndarray) -> None:
    """Adds one scan of some files. ``rows_of_unit``: of each file, the rows of the blocks of each unit of the scan."""
    lanes = _Lanes(blobs)
    count = np.bincount(lanes.file, minlength=len(blobs))
    turn = np.arange(len(lanes.at)) - np.repeat(np.cumsum(count) - count, count)
    units = np.array([len(r) for r in rows_of_unit])
    step = np.where(scan.restart > 0, scan.restart, units[lanes.file])
    first = turn * step
    n = np.clip(units[lanes.file] - first, 0, step)
    rows = np.concatenate(rows_of_unit)
    base = (np.cumsum(units) - units)[lanes.file] + first
    skip = np.zeros(len(lanes.at), np.int64)
    before = np.zeros((len(lanes.at), 3), np.int64)
    for j in range(int(n.max(initial=0))):
        who = np.flatnonzero(n > j)
        if scan.low == 0:
            for slot in range(rows.shape[1]):
                part = sum(slot >= e for e in np.cumsum([IN_UNIT[c] for c in scan.components])) if len(scan.components) > 1 else 0
                row = rows[base[who] + j, slot]
                if scan.past:
                    out[row, 0] |= lanes.bit(who) << scan.now
                    continue
                look = lanes.look(who)
                entry = scan.tables[part].table[_top(look, np.full(len(who), 16))]
                length, size = entry >> 8, entry & 255
                value = _extend(_top(look << length.astype(np.uint64), size), size)
                lanes.at[who] += length + size
                before[who, part] += value
                out[row, 0] = before[who, part] << scan.now
        elif scan.past:
            _refine(scan, lanes, who, rows[base[who] + j, 0], skip, out)
        else:
            _band(scan, lanes, who, rows[base[who] + j, 0], skip, out)


def _band(scan: Scan, lanes: _Lanes, who: np.ndarray, row: np.ndarray, skip: np.ndarray, out: np.ndarray) -> None:
    table = scan.tables[0].table
    free = skip[who] == 0
    skip[who[~free]] -= 1
    who, row = who[free], row[free]
    k = np.full(len(who), scan.low)
    at = lanes.at[who]
    window, limit = lanes.window, 8 * len(lanes.window) - 8
    live = np.arange(len(who))
    while len(live):
        place = np.minimum(at[live], limit)
        look = window[place >> 3] << (place & 7).astype(np.uint64)
        entry = table[(look >> np.uint64(48)).astype(np.int64)]
        length, run, size = entry >> 8, entry >> 4 & 15, entry & 15
        rest = look << length.astype(np.uint64)
        to = k[live] + run
        some = size > 0
        end = ~some & (run < 15)
        if end.any():
            skip[who[live[end]]] = (1 << run[end]) - 1 + _top(rest[end], run[end])
            length = np.where(end, length + run, length)
        value = _extend(_top(rest, size), size) << scan.now
        ok = some & (to <= scan.high)
        if ok.all():
            out[row[live], to] = value
        else:
            out[row[live[ok]], to[ok]] = value[ok]
        at[live] += length + size
        k[live] = to + 1
        live = live[~end & (to < scan.high)]
    lanes.at[who] = at


def _refine(scan: Scan, lanes: _Lanes, who: np.ndarray, row: np.ndarray, skip: np.ndarray, out: np.ndarray) -> None:
    table, one = scan.tables[0].table, 1 << scan.now
    values = out[row]
    left = np.full(len(who), -1)  # zeros still to pass; -1: a code comes next
    fresh = np.zeros(len(who), np.int64)
    over = skip[who] > 0
    skip[who[over]] -= 1
    at = lanes.at[who]
    window, limit = lanes.window, 8 * len(lanes.window) - 8

    def look(place: np.ndarray) -> np.ndarray:
        place = np.minimum(place, limit)
        return window[place >> 3] << (place & 7).astype(np.uint64)

    for k in range(scan.low, scan.high + 1):
        need = np.flatnonzero(~over & (left < 0))
        if len(need):
            bits = look(at[need])
            entry = table[(bits >> np.uint64(48)).astype(np.int64)]
            length, run, size = entry >> 8, entry >> 4 & 15, entry & 15
            rest = bits << length.astype(np.uint64)
            end = (size == 0) & (run < 15)
            skip[who[need[end]]] = (1 << run[end]) - 1 + _top(rest[end], run[end])
            over[need[end]] = True
            left[need[~end]] = run[~end]
            fresh[need] = np.where(size > 0, np.where(rest >> np.uint64(63) > 0, one, -one), 0)
            at[need] += length + np.where(end, run, size)
        now = values[:, k]
        old = np.flatnonzero(now)
        if len(old):
            bit = (look(at[old]) >> np.uint64(63)).astype(np.int64)
            at[old] += 1
            values[old, k] += np.where(now[old] > 0, bit, -bit) * one
        zero = np.flatnonzero((now == 0) & ~over) if len(old) < len(now) else old[:0]
        if len(zero):
            here = zero[left[zero] == 0]
            values[here, k] = fresh[here]
            left[zero] -= 1
    out[row] = values
    lanes.at[who] = at


def decode(files: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Parsed]]:
    """Coefficients of files (as ``encode`` takes them), units across and down, and what was parsed."""
    parsed = [parse(f) for f in files]
    across, down = np.array([p.across for p in parsed], np.int64), np.array([p.down for p in parsed], np.int64)
    units = across * down
    out = np.zeros((int(units.sum()) * 6, 64), np.int64)
    whole = np.arange(len(out)).reshape(-1, 6)
    edges = np.concatenate(([0], np.cumsum(units)))
    own = {}
    for c in range(3):
        rows, n = _order(across, down, c)
        ends = np.concatenate(([0], np.cumsum(n)))
        own[c] = (rows[:, None], ends)
    for turn in range(max((len(p.scans) for p in parsed), default=0)):
        groups: dict[tuple, tuple[Scan, list[int]]] = {}
        for f, p in enumerate(parsed):
            if turn < len(p.scans):
                scan = p.scans[turn][0]
                groups.setdefault((*scan[:5], tuple(id(t) for t in scan.tables), scan.restart), (scan, []))[1].append(f)
        for scan, members in groups.values():
            if len(scan.components) > 1:
                columns = np.concatenate([np.arange(AT_UNIT[c], AT_UNIT[c] + IN_UNIT[c]) for c in scan.components])
                rows = [whole[edges[f] : edges[f + 1]][:, columns] for f in members]
            else:
                table, ends = own[scan.components[0]]
                rows = [table[ends[f] : ends[f + 1]] for f in members]
            _scan(scan, [parsed[f].scans[turn][1] for f in members], rows, out)
    return out, across, down, parsed


_BASIS = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)], np.float32)


def units_rgb(coefficients: np.ndarray, quantization: list[np.ndarray]) -> np.ndarray:
    """RGB of every unit, (units, 16, 16, 3): inverse transform, chroma upsampled by two, YCbCr to RGB."""
    n = len(coefficients) // 6
    scale = np.stack([quantization[c] for c in (0, 0, 0, 0, 1, 2)])
    square = np.zeros((n * 6, 64), np.float32)
    square[:, ZIGZAG] = (coefficients.reshape(n, 6, 64) * scale).reshape(-1, 64)
    pixels = (_BASIS @ square.reshape(-1, 8, 8) @ _BASIS.T).reshape(n, 6, 8, 8) + 128
    y = pixels[:, :4].reshape(n, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n, 16, 16)
    cb, cr = (np.repeat(np.repeat(pixels[:, c], 2, axis=1), 2, axis=2) - 128 for c in (4, 5))
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=3)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def image(units: np.ndarray, across: int, down: int) -> np.ndarray:
    """The (height, width, 3) tensor of one file's units."""
    return units.reshape(down, across, 16, 16, 3).transpose(0, 2, 1, 3, 4).reshape(16 * down, 16 * across, 3)
