"""Readers of file bytes: fingerprints, capture tags, sizes, picture hashes. Plain Python, run inside Arrow batches.

Only headers are read where headers hold what is asked for. Whatever can't be read gives None.
"""

from __future__ import annotations

import hashlib
import io
import mmap
import os
import re
import struct
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from typing import BinaryIO

import numpy as np

from catalumen.functions.constants import EXIF_DATE_TAGS, SPARSE_BLOCK, SPARSE_FROM
from catalumen.sources.pixels import luminance

#: Fixed values of the TIFF tag registry.
_TAGS = {0x0100: "width", 0x0101: "height", 0x0110: "Image Model", 0x0132: "Image DateTime", 0x8769: "exif", 0x9003: "EXIF DateTimeOriginal", 0x9004: "EXIF DateTimeDigitized", 0xA002: "exif_width", 0xA003: "exif_height", 0xA434: "EXIF LensModel"}
#: Bytes of a value by TIFF type: fixed values.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def full_hash(path: str, block: int = 1 << 16) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def sparse_hash(path: str, block: int = SPARSE_BLOCK) -> str:
    size = os.path.getsize(path)
    h = hashlib.sha256(str(size).encode())
    with open(path, "rb") as f:
        h.update(f.read(block))
        if size > 3 * block:
            f.seek(size // 2)
            h.update(f.read(block))
        if size > 2 * block:
            f.seek(-block, os.SEEK_END)
            h.update(f.read(block))
    return "s-" + h.hexdigest()


def fingerprint(path: str, size: int, least: int = SPARSE_FROM, force_full: bool = False) -> tuple[str | None, str | None]:
    """(full, sparse) of a first look: full for small files, sparse for large ones, both where full is forced."""
    large = size >= least
    return (full_hash(path) if force_full or not large else None), (sparse_hash(path) if large else None)


def _ascii(f: BinaryIO, size: int, block: int = 1 << 16) -> str:
    """The text from here to its first zero byte, of at most size bytes."""
    raw = b""
    while size > len(raw) and (part := f.read(min(block, size - len(raw)))):
        raw += part
        if b"\0" in part:
            break
    return raw.split(b"\0")[0].decode("utf-8", "replace")


def tiff_tags(f: BinaryIO) -> dict[str, str | int]:
    """Tags of interest of a TIFF file or block, wherever in it they are; offsets beyond its end are passed over."""
    end = f.seek(0, os.SEEK_END)
    f.seek(0)
    head = f.read(8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        return {}
    out: dict[str, str | int] = {}
    todo, seen = [struct.unpack(order + "I", head[4:])[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > end:
            continue
        seen.add(at)
        f.seek(at)
        entries = f.read(12 * struct.unpack(order + "H", f.read(2))[0])
        for entry in range(0, len(entries) - 11, 12):
            tag, kind, count = struct.unpack_from(order + "HHI", entries, entry)
            name, size = _TAGS.get(tag), _SIZES.get(kind, 0) * count
            if name is None or not size:
                continue
            where = at + 2 + entry + 8 if size <= 4 else struct.unpack_from(order + "I", entries, entry + 8)[0]
            if where + size > end:
                continue
            f.seek(where)
            if kind == 2:
                out.setdefault(name, _ascii(f, size))
            elif kind in (3, 4):
                value = struct.unpack(order + ("H" if kind == 3 else "I"), f.read(2 if kind == 3 else 4))[0]
                todo.append(value) if name == "exif" else out.setdefault(name, value)
    return out


def _jpeg(f: BinaryIO) -> tuple[dict[str, str | int], int | None, int | None]:
    tags: dict[str, str | int] = {}
    f.seek(2)
    while len(head := f.read(4)) == 4 and head[0] == 0xFF:
        mark, length = head[1], struct.unpack(">H", head[2:])[0]
        body = f.read(length - 2)
        if mark == 0xE1 and body.startswith(b"Exif\0\0"):
            tags = tags or tiff_tags(io.BytesIO(body[6:]))
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack(">HH", body[1:5])
            return tags, width, height
        elif mark == 0xDA:
            break
    return tags, None, None


def image_head(path: str) -> tuple[dict[str, str | int], int | None, int | None]:
    """(tags, width, height) of a JPEG, PNG, GIF, PSD or TIFF-like file."""
    with open(path, "rb") as f:
        head = f.read(32)
        if head[:2] == b"\xff\xd8":
            return _jpeg(f)
        if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
            return {}, *struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return {}, *struct.unpack("<HH", head[6:10])
        if head[:4] == b"8BPS" and len(head) >= 22:
            height, width = struct.unpack(">II", head[14:22])
            return {}, width, height
        if head[:2] in (b"II", b"MM"):
            tags = tiff_tags(f)
            size = [tags.get("exif_" + k) or tags.get(k) for k in ("width", "height")]
            return tags, size[0], size[1]  # type: ignore[return-value]
    return {}, None, None


def exif(path: str, strip: bool = True) -> dict[str, str | None]:
    """date, camera, lens of an image: the first date tag that there is, in order of trust. v1 keeps outer blanks."""
    tags = image_head(path)[0]
    clean: Callable[[str], str] = str.strip if strip else str
    text = lambda k: clean(str(tags[k])) or None if tags.get(k) else None
    date = next((str(tags[k]) for k in EXIF_DATE_TAGS if tags.get(k)), None)
    return {"date": date, "camera": text("Image Model"), "lens": text("EXIF LensModel")}


#: What a movie's user data tells, by box kind or key: fixed values of the QuickTime format, and our tags for them.
_USER_TAGS = {b"\xa9mod": "device_model", b"\xa9ART": "performer", b"\xa9swr": "encoded_library", b"\xa9day": "recorded_date"}
_USER_KEYS = {b"com.apple.quicktime.model": "device_model", b"com.apple.quicktime.artist": "performer", b"com.apple.quicktime.software": "encoded_library", b"com.apple.quicktime.creationdate": "recorded_date"}


def _boxes(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the content, end) of the boxes between two offsets."""
    while at + 8 <= end:
        f.seek(at)
        size, kind = struct.unpack(">I4s", f.read(8))
        inner = at + 8
        if size == 1:
            long = f.read(8)
            if len(long) < 8:
                return
            size, inner = struct.unpack(">Q", long)[0], at + 16
        stop = at + size if size else end
        if stop <= at + 7 or stop > end:
            return
        yield kind, inner, stop
        at = stop


def _text(f: BinaryIO, at: int, end: int) -> str:
    f.seek(at)
    return f.read(end - at).decode("utf-8", "replace").strip("\0 \r\n")


def _user_data(f: BinaryIO, at: int, end: int, out: dict[str, str]) -> None:
    """Adds what boxes of user data (udta, meta, keys, ilst) tell."""
    keys: list[bytes] = []
    for kind, inner, stop in _boxes(f, at, end):
        if kind in _USER_TAGS and stop - inner > 4:
            f.seek(inner)
            n = struct.unpack(">H", f.read(2))[0]  # length and language come before the text
            out.setdefault(_USER_TAGS[kind], _text(f, inner + 4, min(stop, inner + 4 + n)))
        elif kind == b"meta":
            f.seek(inner)
            plain = f.read(8)[4:] in (b"hdlr", b"keys", b"ilst")
            _user_data(f, inner if plain else inner + 4, stop, out)
        elif kind == b"keys":
            at_ = inner + 8
            while at_ + 8 <= stop:
                f.seek(at_)
                n = struct.unpack(">I", f.read(4))[0]
                if n < 8 or at_ + n > stop:
                    break
                f.seek(at_ + 8)
                keys.append(f.read(n - 8))
                at_ += n
        elif kind == b"ilst":
            for number, first, last in _boxes(f, inner, stop):
                n = struct.unpack(">I", number)[0]
                tag = _USER_KEYS.get(keys[n - 1]) if 0 < n <= len(keys) else _USER_TAGS.get(number)
                for what, value, ends in _boxes(f, first, last):
                    if tag and what == b"data" and ends - value > 8:
                        out.setdefault(tag, _text(f, value + 8, ends))


def movie_head(path: str) -> dict[str, str]:
    """General tags of a movie: of MP4 and MOV files encoded_date in UTC and duration in milliseconds from the movie header,
    model, performer, software and recorded date from its user data; of AVI files duration, recorded date and encoder."""
    out: dict[str, str] = {}
    with open(path, "rb") as f:
        end = os.path.getsize(path)
        head = f.read(12)
        if head[:4] == b"RIFF" and head[8:] == b"AVI ":
            _riff(f, 12, end, out)
            return out
        for kind, inner, stop in _boxes(f, 0, end):
            if kind != b"moov":
                continue
            for part, at, last in _boxes(f, inner, stop):
                if part in (b"udta", b"meta"):
                    _user_data(f, at - 8 if part == b"meta" else at, last, out)
                elif part == b"mvhd" and last - at >= 20:
                    f.seek(at)
                    body = f.read(36)
                    made, scale, length = struct.unpack(">QxxxxxxxxIQ", body[4:32]) if body[0] == 1 else struct.unpack(">IxxxxII", body[4:20])
                    if made:
                        out["encoded_date"] = f"{datetime(1904, 1, 1, tzinfo=UTC) + timedelta(seconds=made):%Y-%m-%d %H:%M:%S} UTC"
                    if scale:
                        out["duration"] = str(round(1000 * length / scale))
    return {k: v for k, v in out.items() if v}


def _riff(f: BinaryIO, at: int, end: int, out: dict[str, str]) -> None:
    """Adds what the chunks of an AVI file tell; lists of frames are passed over."""
    while at + 8 <= end:
        f.seek(at)
        kind, size = struct.unpack("<4sI", f.read(8))
        inner, stop = at + 8, min(end, at + 8 + size)
        if kind == b"LIST":
            if f.read(4) != b"movi":
                _riff(f, inner + 4, stop, out)
        elif kind == b"avih" and size >= 20:
            micro, _, _, _, frames = struct.unpack("<5I", f.read(20))
            if micro and frames:
                out["duration"] = str(round(micro * frames / 1000))
        elif kind == b"IDIT":
            text = _text(f, inner, stop)
            try:  # as the C library writes times
                text = f"{datetime.strptime(text, '%a %b %d %H:%M:%S %Y'):%Y-%m-%d %H:%M:%S}"
            except ValueError:
                pass
            out.setdefault("recorded_date", text)
        elif kind == b"ISFT":
            out.setdefault("encoder", _text(f, inner, stop))
        at += 8 + size + size % 2


def embedded_names(path: str) -> list[str]:
    """File names of pictures embedded in a layered document, in order: the Unicode names of its linked layer records
    (liFD, liFE, liFA). The document is mapped, not read into memory; a record whose name exceeds the file is passed over."""
    if os.path.getsize(path) < 4:
        return []
    out = []
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        if data[:4] != b"8BPS":
            return []
        for m in re.finditer(rb"li(?:FD|FE|FA)", data):
            at = m.end() + 4
            if at >= len(data):
                continue
            at += 1 + data[at]  # the record's unique id
            if at + 4 > len(data):
                continue
            n = struct.unpack_from(">I", data, at)[0]
            if 0 < n and at + 4 + 2 * n <= len(data):
                name = data[at + 4 : at + 4 + 2 * n].decode("utf-16-be", "replace").split("\0")[0]
                if name:
                    out.append(name)
    return out


def _shares(n: int, parts: int) -> np.ndarray:
    """(parts, n): the share that each of n cells has in each of so many equal parts of their length."""
    edges = np.linspace(0, n, parts + 1)
    cells = np.arange(n)
    over = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.maximum(over, 0) * (parts / n)


def picture_hash(path: str) -> str | None:
    """16 hex digits: the signs of the 8 x 8 lowest cosine coefficients of a 32 x 32 reduction against their median.

    Of JPEG, PNG, GIF and TIFF; null where pixels can't read the file.
    """
    grey = luminance(path)
    if grey is None:
        return None
    rows, cols = (_shares(n, 32) for n in grey.shape)
    small = rows @ grey @ cols.T
    k = np.arange(32)
    cosine = np.cos(np.pi * (2 * k[None, :] + 1) * np.arange(8)[:, None] / 64)
    low = cosine @ small @ cosine.T
    bits = (low > np.median(low)).reshape(-1)
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
