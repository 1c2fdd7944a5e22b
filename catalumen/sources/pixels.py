"""Luminance of picture files, for picture hashes: JPEG at an eighth of its size, PNG, GIF and TIFF whole. Plain Python and NumPy.

A picture hash needs 32 x 32 means, so that of a JPEG only the constant coefficient of each 8 x 8 block is decoded, which is
the block's mean. Whatever isn't read gives None: arithmetic coding, 12-bit JPEG, floating point and JPEG-in-TIFF.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

WEIGHTS = np.array([0.299, 0.587, 0.114])


def luminance(path: str) -> np.ndarray | None:
    with open(path, "rb") as f:
        data = f.read()
    if data[:2] == b"\xff\xd8":
        return jpeg(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return png(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return gif(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return tiff(data)
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    """Of (height, width, channels): the first channel of one or two, the weighted sum of three or four."""
    return pixels[..., 0].astype(float) if pixels.shape[2] < 3 else pixels[..., :3] @ WEIGHTS


# JPEG


def _codes(lengths: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(first of the 16-bit words that begin with it, bits, symbol) of each code of a Huffman table."""
    out, code, at = [], 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out.append((code << (16 - n), n, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _constant_table(codes: list[tuple[int, int, int]]) -> list[int]:
    """By the next 16 bits: bits of the code, and the size of the difference that follows it, packed."""
    table = [0] * 65536
    for word, n, symbol in codes:
        table[word : word + (1 << (16 - n))] = [n << 8 | symbol] * (1 << (16 - n))
    return table


def _skip_table(codes: list[tuple[int, int, int]]) -> list[int]:
    """By the next 16 bits: coefficients that a code and its value go on by, and the bits that both have, packed."""
    table = [0] * 65536
    for word, n, symbol in codes:
        run, size = symbol >> 4, symbol & 15
        on = run + 1 if size else 16 if run == 15 else 64
        table[word : word + (1 << (16 - n))] = [on << 8 | (n + size)] * (1 << (16 - n))
    return table


def jpeg(data: bytes) -> np.ndarray | None:
    """Means of the luminance blocks, of the first scan that has them."""
    quant: dict[int, int] = {}
    tables: dict[int, list[tuple[int, int, int]]] = {}
    frame, restart, at = None, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        end = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
        if end > len(data):
            return None
        body = data[at + 4 : end]
        if mark == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quant[body[i] & 15] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                i += 1 + (128 if wide else 64)
        elif mark == 0xC4:
            i = 0
            while i + 17 <= len(body):
                n = sum(body[i + 1 : i + 17])
                tables[body[i]] = _codes(body[i + 1 : i + 17], body[i + 17 : i + 17 + n])
                i += 17 + n
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark in (0xC0, 0xC1, 0xC2):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if depth != 8 or not height or not width:
                return None
            frame = (mark == 0xC2, width, height, parts)
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            return None
        elif mark == 0xDA:
            if frame is None:
                return None
            ids = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            first, exact = body[1 + 2 * body[0]], body[3 + 2 * body[0]]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(data, end)
            coded = data[end : stop.start() if stop else len(data)]
            if first == 0 and exact >> 4 == 0 and ids[0][0] == frame[3][0][0]:
                means = _scan(coded, frame, ids, tables, restart)
                return means * float((1 << (exact & 15)) * quant.get(frame[3][0][3], 1)) / 8 + 128
            end = stop.start() if stop else len(data)
        elif mark == 0xD9:
            return None
        at = end
    return None


def _scan(coded: bytes, frame: tuple, ids: list[tuple[int, int, int]], tables: dict, restart: int) -> np.ndarray:
    """Constant coefficients of the first component's blocks."""
    progressive, width, height, parts = frame
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    by_id = {p[0]: p for p in parts}
    _, h0, v0, _ = parts[0]
    wide, high = -(-(-(-width * h0 // most_h)) // 8), -(-(-(-height * v0 // most_v)) // 8)
    if len(ids) == 1:
        across, down, shape = wide, high, [(1, 1)]
    else:
        across, down, shape = -(-width // (8 * most_h)), -(-height // (8 * most_v)), [by_id[i][1:3] for i, _, _ in ids]
    plan = []  # of one unit: component, tables, in order of its blocks
    for n, ((_, dc, ac), (h, v)) in enumerate(zip(ids, shape, strict=True)):
        constant = _constant_table(tables[dc])
        skip = None if progressive else _skip_table(tables[16 + ac])
        plan += [(n, constant, skip)] * (h * v)
    own = shape[0][0] * shape[0][1]
    units, values = across * down, []
    for piece in re.split(rb"\xff[\xd0-\xd7]", coded):
        left = min(restart or units, units - len(values) // own)
        if left <= 0:
            break
        values += _interval(piece.replace(b"\xff\x00", b"\xff") + b"\0" * 8, left, plan, len(ids))
    h, v = shape[0]
    values += [0] * (units * own - len(values))  # a file that breaks off
    grid = np.array(values, dtype=float).reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    return grid[:high, :wide]


def _interval(d: bytes, units: int, plan: list[tuple], components: int) -> list[int]:
    """Constant coefficients of the first component between two restarts."""
    before, out = [0] * components, []
    pos, end = 0, 8 * (len(d) - 8)
    for _ in range(units):
        if pos >= end:
            break
        for n, constant, skip in plan:
            b = pos >> 3
            e = constant[((d[b] << 16 | d[b + 1] << 8 | d[b + 2]) >> (8 - (pos & 7))) & 0xFFFF]
            pos += e >> 8
            size = e & 255
            if size:
                b = pos >> 3
                v = ((d[b] << 16 | d[b + 1] << 8 | d[b + 2]) >> (8 - (pos & 7)) & 0xFFFF) >> (16 - size)
                pos += size
                before[n] += v if v >> (size - 1) else v - (1 << size) + 1
            if n == 0:
                out.append(before[0])
            if skip is not None:
                k = 1
                while k < 64:
                    b = pos >> 3
                    if b + 3 > len(d):
                        return out
                    e = skip[((d[b] << 16 | d[b + 1] << 8 | d[b + 2]) >> (8 - (pos & 7))) & 0xFFFF]
                    if not e:
                        return out
                    k += e >> 8
                    pos += e & 255
            elif (pos >> 3) + 3 > len(d):
                return out
    return out


# PNG


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes of which each begins with its filter; step: bytes of a pixel."""
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), dtype=np.uint8)
    above = np.zeros(rows.shape[1] - 1, dtype=np.uint8)
    for y in range(rows.shape[0]):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 1:
            padded = np.concatenate([line, np.zeros(-len(line) % step, np.uint8)]).reshape(-1, step)
            line = np.cumsum(padded, axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            new, up = [0] * step + line.tolist(), [0] * step + above.tolist()
            for x in range(step, len(new)):
                left, top = new[x - step], up[x]
                if kind == 3:
                    new[x] = (new[x] + (left + top) // 2) & 255
                else:
                    corner = up[x - step]
                    a, b = top - corner, left - corner
                    c = abs(a + b)
                    a, b = abs(a), abs(b)
                    new[x] = (new[x] + (left if a <= b and a <= c else top if b <= c else corner)) & 255
            line = np.array(new[step:], dtype=np.uint8)
        out[y] = above = line
    return out


#: First column and row, and distance of columns and rows, of the passes of an interlaced PNG: fixed values of the format.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def png(data: bytes) -> np.ndarray | None:
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    at, body, palette = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        elif kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + n], np.uint8).reshape(-1, 3) @ WEIGHTS
        at += 12 + n
    raw, used = zlib.decompress(b"".join(body)), 0
    out = np.zeros((height, width))
    for x0, y0, dx, dy in PASSES if interlace else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        line = -(-w * channels * depth // 8)
        rows = np.frombuffer(raw, np.uint8, h * (line + 1), used).reshape(h, line + 1)
        used += rows.size
        values = _samples(_unfilter(rows, max(1, channels * depth // 8)), depth, w * channels)
        if colour == 3:
            if palette is None:
                return None
            part = palette[np.minimum(values, len(palette) - 1)]
        else:
            part = _grey(values.reshape(h, w, channels)) * (255 / ((1 << min(depth, 8)) - 1))
        out[y0::dy, x0::dx] = part
    return out


def _samples(rows: np.ndarray, depth: int, n: int, little: bool = False) -> np.ndarray:
    """n samples a row, of bytes: 16-bit ones by their high byte, those under 8 bits unpacked."""
    if depth == 16:
        return rows[:, int(little) :: 2][:, :n]
    if depth == 8:
        return rows[:, :n]
    bits = np.unpackbits(rows, axis=1)
    bits = bits[:, : bits.shape[1] // depth * depth].reshape(len(rows), -1, depth)
    return (bits @ (1 << np.arange(depth - 1, -1, -1)))[:, :n]


# GIF and TIFF


def _words(data: bytes, first: int, most_significant: bool, early: int) -> Iterator[int]:
    """Codes of an LZW stream whose width grows with its table; a clear code sets it back."""
    clear, width, size = 1 << first, first + 1, (1 << first) + 2
    held = bits = 0
    for byte in data:
        if most_significant:
            held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        else:
            held, bits = held | byte << bits, bits + 8
        while bits >= width:
            if most_significant:
                code = held >> (bits - width) & ((1 << width) - 1)
            else:
                code = held & ((1 << width) - 1)
                held >>= width
            bits -= width
            yield code
            if code == clear:
                width, size = first + 1, (1 << first) + 1
            elif size < 4096:
                size += 1
            if size + early >= 1 << width and width < 12:
                width += 1


def lzw(data: bytes, first: int, most_significant: bool = True) -> bytes:
    """Of TIFF (8, True) and GIF (its own first size, False)."""
    clear, end = 1 << first, (1 << first) + 1
    table: list[bytes] = []
    out, last = [], None
    for code in _words(data, first, most_significant, 1 if most_significant else 0):
        if code == clear:
            table, last = [bytes([i]) for i in range(clear)] + [b"", b""], None
            continue
        if code == end:
            break
        if not table:
            table = [bytes([i]) for i in range(clear)] + [b"", b""]
        if code < len(table):
            word = table[code]
        elif last is not None:
            word = last + last[:1]
        else:
            break
        out.append(word)
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
        last = word
    return b"".join(out)


def gif(data: bytes) -> np.ndarray | None:
    """The first frame, as large as it is itself."""
    flags, at = data[10], 13
    colours = np.frombuffer(data, np.uint8, 3 << ((flags & 7) + 1), at) if flags & 128 else None
    at += len(colours) if colours is not None else 0
    while at < len(data):
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
        elif data[at] == 0x2C:
            width, height, own = struct.unpack_from("<HHB", data, at + 5)
            at += 10
            if own & 128:
                colours = np.frombuffer(data, np.uint8, 3 << ((own & 7) + 1), at)
                at += len(colours)
            first, body = data[at], []
            at += 1
            while at < len(data) and data[at]:
                body.append(data[at + 1 : at + 1 + data[at]])
                at += 1 + data[at]
            if colours is None:
                return None
            values = np.zeros(width * height, dtype=np.int64)
            told = np.frombuffer(lzw(b"".join(body), first, False), np.uint8)[: len(values)]
            values[: len(told)] = told
            palette = colours.reshape(-1, 3) @ WEIGHTS
            rows = palette[np.minimum(values, len(palette) - 1)].reshape(height, width)
            if own & 64:
                order = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
                rows = rows[np.argsort(order)]
            return rows
        else:
            return None
    return None


def _unpack(data: bytes) -> bytes:
    """PackBits: runs and literals."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


def tiff(data: bytes) -> np.ndarray | None:
    """The first directory's picture of 1 to 16 bits a sample, in strips or tiles: plain, LZW, Deflate or PackBits."""
    order = "<" if data[:2] == b"II" else ">"
    kinds = {1: "B", 3: "H", 4: "I"}
    tags: dict[int, tuple[int, ...]] = {}
    at = struct.unpack_from(order + "I", data, 4)[0]
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in kinds and n:
            form = f"{order}{n}{kinds[kind]}"
            place = at + 10 + 12 * i
            tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, place)[0])
    one = lambda tag, otherwise: tags.get(tag, (otherwise,))[0]
    width, height, channels, depth = one(256, 0), one(257, 0), one(277, 1), one(258, 1)
    way, shown, planar, predictor, form = one(259, 1), one(262, 1), one(284, 1), one(317, 1), one(339, 1)
    unpack = {1: bytes, 5: lambda b: lzw(b, 8), 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack}.get(way)
    if unpack is None or not width or not height or depth not in (1, 2, 4, 8, 16) or form > 2 or shown not in (0, 1, 2, 3) or predictor > 2 or (predictor == 2 and depth != 8):
        return None
    tiled = 322 in tags
    w, h = (one(322, 0), one(323, 0)) if tiled else (width, min(height, one(278, height)))
    offsets, sizes = tags.get(324 if tiled else 273, ()), tags.get(325 if tiled else 279, ())
    across, down = -(-width // w), -(-height // h)
    per = 1 if planar == 2 else channels
    values = np.zeros((down * h, across * w, channels))
    for n, (offset, size) in enumerate(zip(offsets, sizes, strict=False)):
        plane, place = divmod(n, across * down)
        if plane >= (channels if planar == 2 else 1):
            break
        raw = unpack(data[offset : offset + size])
        line = -(-w * per * depth // 8)
        rows = np.frombuffer(raw[: len(raw) // line * line][: h * line], np.uint8).reshape(-1, line)
        part = _samples(rows, depth, w * per, order == "<").reshape(len(rows), w, per)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        y, x = place // across * h, place % across * w
        values[y : y + len(rows), x : x + w, plane : plane + per] = part
    if shown == 3:
        table = np.array(tags.get(320, ()), dtype=float).reshape(3, -1).T / 257 @ WEIGHTS
        return table[values[:height, :width, 0].astype(int)] if len(table) else None
    grey = _grey(values[:height, :width]) * (255 / ((1 << min(depth, 8)) - 1))
    return 255 - grey if shown == 0 else grey
