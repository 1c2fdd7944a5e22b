"""Problem 7: encoding of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import unicodedata
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from catalumen.runtime import spread, table

#: Where the vocabulary files are; byte_bpe_50k by its ranks.
TOKENIZERS = os.environ.get("CATALUMEN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Code points encoded at once; a longer text is cut where a run of white space begins, which is a boundary anyway.
CODES = 1_000_000
#: Pieces whose ids are kept per worker.
KEPT = 100_000

# code point classes
LETTER, NUMBER, OTHER, SPACE, WHITE, SHORT2, SHORT3 = range(7)
#: White space other than the space: fixed values of the Unicode property White_Space.
WHITES = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# states after a code point: in a run of a kind, with 1 or 2 code points of a contraction to come, or a piece just closed
S_LETTER, S_NUMBER, S_OTHER, S_SPACE, S_WHITE, S_ONE, S_TWO, S_CLOSED = range(8)


def _transitions() -> np.ndarray:
    """T[class, state]: the next state. A class is thus a function of states, and functions compose associatively."""
    t = np.zeros((7, 8), dtype=np.uint8)
    for c, s in ((LETTER, S_LETTER), (NUMBER, S_NUMBER), (OTHER, S_OTHER), (SPACE, S_SPACE), (WHITE, S_WHITE)):
        t[c] = s
    for c, s in ((SHORT2, S_ONE), (SHORT3, S_TWO)):
        t[c] = s  # an apostrophe that opens a piece begins a contraction
        t[c, [S_OTHER, S_SPACE]] = S_OTHER  # one that goes on with a piece does not
    t[:, S_TWO], t[:, S_ONE] = S_ONE, S_CLOSED
    return t


TRANSITIONS = _transitions()


#: Letters and numbers that Unicode 16 added, first and last code point: fixed values of its character database.
NEWER = {
    LETTER: [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    NUMBER: [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
#: Versions of Python's Unicode data from which the same table comes out.
UNICODE = ("15.1.0", "16.0.0")


def class_table() -> np.ndarray:
    """Class of every code point by Unicode 16, whichever of UNICODE this Python knows; with another it is an error."""
    if unicodedata.unidata_version not in UNICODE:
        raise RuntimeError(f"the class table needs Unicode data {' or '.join(UNICODE)}, this Python has {unicodedata.unidata_version}")
    t = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        if k[0] in kinds:
            t[c] = kinds[k[0]]
    for kind, runs in NEWER.items():
        for low, high in runs:
            t[low : high + 1] = kind
    t[WHITES] = WHITE
    t[32] = SPACE
    return t


def _scan_functions(functions: np.ndarray) -> np.ndarray:
    """functions: (blocks, width, states). The state after each function of each block, from S_CLOSED."""
    blocks, width, k = functions.shape
    prefix = np.empty_like(functions)
    prefix[:, 0] = functions[:, 0]
    for j in range(1, width):
        prefix[:, j] = np.take_along_axis(functions[:, j], prefix[:, j - 1], axis=1)
    start = np.full(blocks, S_CLOSED, dtype=np.uint8)
    if blocks > 1:
        whole = prefix[:-1, -1]
        if blocks <= width:
            start[1:] = _scan_functions(whole[None])[0]
        else:
            up = -(-(blocks - 1) // width)
            filled = np.broadcast_to(np.arange(k, dtype=np.uint8), (up * width, k)).copy()
            filled[: blocks - 1] = whole
            start[1:] = _scan_functions(filled.reshape(up, width, k)).reshape(-1)[: blocks - 1]
    return np.take_along_axis(prefix, start[:, None, None].astype(np.intp), axis=2)[:, :, 0]


def scan(classes: np.ndarray, first: np.ndarray, width: int = 64) -> np.ndarray:
    """State after each code point of texts laid end to end: prefixes of transition functions within blocks, then the
    blocks' functions scanned the same way, then each block's prefixes applied to the state that it starts in."""
    n = len(classes)
    if n == 0:
        return np.empty(0, np.uint8)
    blocks = -(-n // width)
    functions = np.empty((blocks * width, 8), dtype=np.uint8)
    functions[:n] = TRANSITIONS[classes]
    functions[n:] = S_SPACE
    at = np.flatnonzero(first)  # a text's first code point forgets the state before it: its function is constant
    functions[at] = TRANSITIONS[classes[at], S_CLOSED][:, None]
    return _scan_functions(functions.reshape(blocks, width, 8)).reshape(-1)[:n]


def boundaries(codes: np.ndarray, first: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point. first: whether a text begins there."""
    n = len(codes)
    c = table_[codes]
    # an apostrophe followed by s t m d, or by re ve ll, within the text
    at = np.flatnonzero(codes == 0x27)
    one, two = np.minimum(at + 1, n - 1), np.minimum(at + 2, n - 1)
    has1 = (at + 1 < n) & ~first[one]
    has2 = has1 & (at + 2 < n) & ~first[two]
    x, y = codes[one], codes[two]
    c[at[has1 & np.isin(x, [ord(q) for q in "stmd"])]] = SHORT2
    c[at[has2 & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))]] = SHORT3
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = S_CLOSED, scan(c, first)[:-1]
    before[first] = S_CLOSED
    white = (c == SPACE) | (c == WHITE)
    was_white = (before == S_SPACE) | (before == S_WHITE)
    next_first = np.append(first[1:], True)
    next_white = np.append(white[1:], False)
    last_of_run = white & ~next_white & ~next_first
    kind = np.minimum(c, OTHER)
    kind[(c == SHORT2) | (c == SHORT3)] = OTHER
    goes_on = (before <= S_OTHER) & (before == kind)
    inside = (before == S_ONE) | (before == S_TWO)
    dark = ~white & ~goes_on & ~inside & (before != S_SPACE)
    return first | dark | (white & (~was_white | last_of_run))


class Encoder:
    """Encodes texts by a rank file (lines of base64 token and rank)."""

    def __init__(self, ranks: bytes, classes: np.ndarray | None = None) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.kept: dict[bytes, tuple[int, ...]] = {}
        self.classes = class_table() if classes is None else classes

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: adjacent parts merge in rank order, leftmost first; a heap keeps long pieces n log n."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, piece[i : i + 2]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                up = both + part[after[i]]
                if (r := ranks.get(up)) is not None:
                    heappush(heap, (r, i, up))
            if (h := before[i]) >= 0:
                up = part[h] + both
                if (r := ranks.get(up)) is not None:
                    heappush(heap, (r, h, up))
        return tuple(ranks[p] for p in part if p is not None)

    def _ids(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        kept, out = self.kept, []
        for p in pieces:
            ids = kept.get(p)
            if ids is None:
                ids = self.merge(p)
                if len(p) <= 64:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[p] = ids
            out.append(ids)
        return out

    def pieces(self, texts: list[str]) -> tuple[list[bytes], np.ndarray]:
        """The pieces of texts, and how many each text has. Texts must be few enough code points for memory."""
        joined = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not joined:
            return [], np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.zeros(len(codes), dtype=bool)
        start = np.cumsum(sizes) - sizes
        first[start[sizes > 0]] = True
        at = np.flatnonzero(boundaries(codes, first, self.classes))
        widths = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        offset = np.concatenate([[0], np.cumsum(widths)])
        data = joined.encode("utf-8", "surrogatepass")
        cuts = [*offset[at].tolist(), len(data)]
        begin = np.searchsorted(at, np.append(start, len(codes)))
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], np.diff(begin)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in one array, and how many each text has; null and empty texts have none."""
        ids: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        for owner, part in _portions(texts):
            pieces, per = self.pieces(part)
            found = self._ids(pieces)
            each = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.concatenate([[0], np.cumsum(each)])
            stops = np.cumsum(per)
            np.add.at(counts, owner, ends[stops] - ends[stops - per])
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])))
        return np.concatenate(ids) if ids else np.empty(0, np.int32), counts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def spans(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each id of a text begins, and the text's length in bytes at the end."""
        return np.concatenate([[0], np.cumsum([len(self.bytes_of[i]) for i in ids.tolist()], dtype=np.int64)])


def _portions(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(owners, parts) of about CODES code points, in order; long texts in parts that end before white space."""
    owner: list[int] = []
    part: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = t or ""
        lo = 0
        while lo < len(t):
            hi = min(len(t), lo + CODES)
            while hi < len(t) and not (t[hi] == " " and not t[hi - 1].isspace()):
                hi += 1
            owner.append(i)
            part.append(t[lo:hi])
            size += hi - lo
            lo = hi
            if size >= CODES:
                yield np.array(owner), part
                owner, part, size = [], [], 0
    if part:
        yield np.array(owner), part


_encoders: dict[int, Encoder] = {}


def encoder_of(vocabulary: tuple[bytes, bytes]) -> Encoder:
    """The worker's encoder for a rank file and a packed class table, made once."""
    key = hash(vocabulary)
    if key not in _encoders:
        ranks, classes = vocabulary
        _encoders[key] = Encoder(ranks, np.frombuffer(zlib.decompress(classes), np.uint8))
    return _encoders[key]


def send(spark: SparkSession, ranks: bytes | None = None) -> Broadcast:
    """A broadcast of the rank file (under 1 MB) and of the driver's class table: all workers class code points alike."""
    return spark.sparkContext.broadcast((ranks or read_ranks(), zlib.compress(class_table().tobytes())))


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks: bytes | None = None) -> DataFrame:
    """(key, ids) of each row; special tokens are ordinary text, null and empty texts give an empty list.

    The vocabulary (under 1 MB) is read by the driver and sent once to each worker; texts go through Arrow and
    never leave their task. Null keys and repeated rows are kept as they are; other columns are ignored.
    """
    shared = send(documents.sparkSession, ranks)
    rows = spread(documents.select(key, text))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared.value)
        for b in batches:
            ids, counts = e.encode(b.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", ranks: bytes | None = None) -> DataFrame:
    """keep..., n_tokens of each row."""
    shared = send(documents.sparkSession, ranks)
    rows = spread(documents.select(*keep, text))
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared.value)
        for b in batches:
            _, counts = e.encode(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", n_tokens long")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of ids, and whether their bytes are its text again, cut at the spans kept."""
    shared = send(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(shared.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, counts = e.encode(texts)
            parts = np.split(ids, np.cumsum(counts)[:-1])
            same = [e.decode(p.tolist()) == (raw := t.encode()) and int(e.spans(p)[-1]) == len(raw) for p, t in zip(parts, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "exact"])

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, exact boolean")


QUERIES = {"p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}
SQL: dict[str, str] = {}
