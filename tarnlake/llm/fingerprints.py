"""Operator 3: document fingerprints from prefix polynomial hashes.

``PrefixHash`` keeps, for a text c_0 c_1 ..., the modular prefix array
S[i] = sum of c_k * B**k for k < i.  Two spans are equal (up to hash accidents) when their
prefix differences agree after shifting, so any span equality takes constant time, and
the longest common extension of two positions takes a binary search.

A fingerprint is a bounded extract of the array: the hashes of the prefixes and of the
suffixes (shifted to place 0) whose lengths are multiples of a power-of-two stride, at most
``GRID`` each, beside the length and the hash of the whole text under two moduli.  Two
fingerprints therefore still answer span equality on their common grid, but only where
nothing before has changed the length.

The query's likeness therefore works on the whole arrays: ``common`` chains longest common
extensions from both ends of what is left and synchronises again after an edit at equal
windows, in order on both sides (see there).  ``likeness`` is the share of the longer text
that the chain covers, whatever the edits' number and lengths.

Defined cases: a null text is the empty text; two empty texts are alike (1), an empty
and another text are not (0); "next" follows ascending doc_id, ties ordered by text;
a row without id stands outside that order and is its own next document; a single
document is its own next; repeated rows are each kept; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import by_shard, column, ordered_shards, prepare, slices, texts

M1, M2 = 2**31 - 1, 2**31 - 19  #: prime moduli
B1, B2 = 1_103_515_245, 1_299_709_201  #: bases
GRID = 64  #: most values of each prefix array in a fingerprint
SHARD_BYTES = 8_000_000  #: text bytes per shard, about


class _Powers:
    """B**k modulo M for k from 0 on, grown as needed."""

    def __init__(self, base: int, modulus: int):
        self.base, self.modulus = base, modulus
        self.values = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = pow(self.base, len(self.values), self.modulus)
            self.values = np.concatenate([self.values, self.values * np.uint64(step) % np.uint64(self.modulus)])
        return self.values[:n]


_P1, _P2 = _Powers(B1, M1), _Powers(B2, M2)
_INVERSE = _Powers(pow(B1, -1, M1), M1)  #: shifts spans to place 0


def prefix_array(codes: np.ndarray, powers: _Powers, known: np.ndarray | None = None) -> np.ndarray:
    """S[0..n] modulo the powers' modulus; ``known`` is its beginning, if some other text shares it."""
    m = np.uint64(powers.modulus)
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    at = 0
    if known is not None:
        at = len(known) - 1
        out[: at + 1] = known
    np.cumsum((codes[at:] + np.uint64(1)) * powers(len(codes))[at:] % m, out=out[at + 1 :])
    out[at + 1 :] = (out[at + 1 :] + out[at]) % m
    return out


class PrefixHash:
    """Prefix arrays of one text under two moduli."""

    def __init__(self, text: str | np.ndarray, like: PrefixHash | None = None, upto: int = 0):
        """``like``: a text with the same first ``upto`` characters, whose arrays need not be computed again."""
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) if isinstance(text, str) else text
        self.n = len(self.codes)
        one, two = (like.one[: upto + 1], like.two[: upto + 1]) if like is not None else (None, None)
        self.one, self.two = prefix_array(self.codes, _P1, one), prefix_array(self.codes, _P2, two)

    def edited(self, following: PrefixHash) -> PrefixHash:
        """The last quarter replaced by the beginning of ``following``."""
        cut = self.n // 4
        return PrefixHash(np.concatenate([self.codes[: self.n - cut], following.codes[:cut]]), self, self.n - cut)

    def _span(self, i: int, length: int, room: int) -> tuple[int, int]:
        """The span's hash, shifted so that spans at different places compare."""
        one = (int(self.one[i + length]) - int(self.one[i])) * int(_P1(room + 1)[room - i]) % M1
        return one, (int(self.two[i + length]) - int(self.two[i])) * int(_P2(room + 1)[room - i]) % M2

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans of ``length`` characters at i here and at j there are equal."""
        if length < 0 or i < 0 or j < 0 or i + length > self.n or j + length > other.n:
            return False
        room = max(self.n, other.n)
        return self._span(i, length, room) == other._span(j, length, room)

    def extension(self, i: int, other: PrefixHash, j: int, limit: int | None = None) -> int:
        """Longest common extension of position i here and j there (``limit`` at most), by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        high = high if limit is None else min(high, limit)
        if high and self.codes[i] != other.codes[j]:
            return 0
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def extension_back(self, i: int, other: PrefixHash, j: int, limit: int) -> int:
        """Longest common extension to the left of the ends i here and j there, ``limit`` at most."""
        low, high = 0, limit
        if high and self.codes[i - 1] != other.codes[j - 1]:
            return 0
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i - mid, other, j - mid, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def windows(self, start: int, end: int, length: int, room: int) -> np.ndarray:
        """Hashes of all windows of ``length`` characters within start to end; they compare for equal ``room``."""
        first, last = slice(start, end - length + 1), slice(start + length, end + 1)
        parts = []
        for s, p in ((self.one, _P1), (self.two, _P2)):
            m = np.uint64(p.modulus)
            shift = p(room + 1)[room - end + length : room - start + 1][::-1]
            parts.append((s[last] + m - s[first]) % m * shift % m)
        return parts[0] << np.uint64(31) | parts[1]

    def common(self, other: PrefixHash) -> int:
        """Characters of a chain of equal spans, in order on both sides.

        In a gap (at first both whole texts) the longest common extensions from both ends
        count.  Between them windows that stand once on either side, or if there are none the
        k-th occurrences of a window on both sides, are joined to runs; the heaviest ordered
        chain of runs counts, and the gaps between them are treated likewise.  Windows are so
        long (two bits a character) that a gap of this size hardly has equal ones by chance.
        """
        room, total = max(self.n, other.n), 0
        gaps = [(0, self.n, 0, other.n)]
        while gaps:
            a, a_end, b, b_end = gaps.pop()
            head = self.extension(a, other, b, min(a_end - a, b_end - b))
            a, b = a + head, b + head
            tail = self.extension_back(a_end, other, b_end, min(a_end - a, b_end - b))
            a_end, b_end = a_end - tail, b_end - tail
            total += head + tail
            if a == a_end or b == b_end:
                continue
            length = 1 + (((a_end - a) * (b_end - b)).bit_length() + 1) // 2
            if min(a_end - a, b_end - b) < length:
                continue
            left, right = _anchors(self.windows(a, a_end, length, room), other.windows(b, b_end, length, room))
            for i, j, n in _chain(left + a, right + b, length):
                total += n
                gaps.append((a, i, b, j))
                a, b = i + n, j + n
            if len(left):
                gaps.append((a, a_end, b, b_end))
        return total

    def likeness(self, other: PrefixHash) -> float:
        """Share of the longer text found in common, from 0 to 1."""
        if self.n == other.n and self.one[-1] == other.one[-1] and self.two[-1] == other.two[-1]:
            return 1.0
        return self.common(other) / max(self.n, other.n)


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in ``a`` of all hashes that are in ``b`` (and, by chance, of a few others)."""
    mask = np.uint64((16 << len(b).bit_length()) - 1)
    seen = np.zeros(int(mask) + 1, dtype=bool)
    seen[b & mask] = True
    return np.flatnonzero(seen[a & mask])


def _anchors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal hashes: of those that stand once on either side, or if there are none the k-th of either side."""
    in_b = _met(b, a)
    in_a = _met(a, b[in_b])  # only what may be equal is sorted
    left, right = _paired(a[in_a], b[in_b])
    return in_a[left], in_b[right]


def _paired(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (va, ia, ca), (vb, ib, cb) = (np.unique(x, return_index=True, return_counts=True) for x in (a, b))
    _, at, bt = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    once = (ca[at] == 1) & (cb[bt] == 1)
    if once.any() or not len(at):
        left, right = ia[at[once]], ib[bt[once]]
    else:
        both = np.minimum(ca[at], cb[bt])
        within = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        first = [np.repeat((np.cumsum(c) - c)[t], both) for c, t in ((ca, at), (cb, bt))]
        left, right = (np.argsort(x, kind="stable")[f + within] for x, f in zip((a, b), first, strict=True))
    order = np.argsort(left)
    return left[order], right[order]


def _chain(left: np.ndarray, right: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Spans (i, j, n) of the heaviest chain, increasing on both sides, of runs of anchors; ``left`` ascends."""
    if not len(left):
        return []
    cut = np.flatnonzero((np.diff(left) != 1) | (np.diff(right) != 1)) + 1
    starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(left)]])
    runs = list(zip(left[starts].tolist(), right[starts].tolist(), (ends - starts).tolist(), strict=True))
    # best[k]: the heaviest chain whose last anchor on the right is at most keys[k]; both ascend
    keys, weights, last, before = [-1], [0], [-1], []
    for r, (_, j, n) in enumerate(runs):
        k = bisect_left(keys, j) - 1
        before.append(last[k])
        key, weight = j + n - 1, weights[k] + n
        at = bisect_right(keys, key)
        if weights[at - 1] >= weight:
            continue
        at = bisect_left(keys, key)
        stop = at
        while stop < len(keys) and weights[stop] <= weight:
            stop += 1
        keys[at:stop], weights[at:stop], last[at:stop] = [key], [weight], [r]
    chosen, r = [], last[-1]
    while r >= 0:
        chosen.append(runs[r])
        r = before[r]
    out, a, b = [], 0, 0
    for i, j, n in reversed(chosen):
        n += length - 1
        late = max(0, a - i, b - j)  # windows overlap, spans must not
        if n > late:
            out.append((i + late, j + late, n - late))
            a, b = i + n, j + n
    return out


@dataclass
class Fingerprint:
    """Length, whole-text hash, stride, and the two arrays on the grid (multiples of the stride from 0)."""

    n: int
    whole: int
    stride: int
    front: np.ndarray
    back: np.ndarray

    @classmethod
    def of(cls, text: str | PrefixHash) -> Fingerprint:
        h = text if isinstance(text, PrefixHash) else PrefixHash(text)
        stride = 1
        while h.n // stride > GRID:
            stride *= 2
        m, start = np.uint64(M1), np.arange(h.n, -1, -stride)
        back = (h.one[-1] + m - h.one[start]) % m * _INVERSE(h.n + 1)[start] % m  # of the suffixes, each shifted to place 0
        return cls(h.n, int(h.one[-1]) << 31 | int(h.two[-1]), stride, h.one[::stride].astype(np.int64), back.astype(np.int64))

    def __str__(self) -> str:
        grid = "".join([f"{x:08x}" for x in self.front.tolist()]), "".join([f"{x:08x}" for x in self.back.tolist()])
        return f"{self.n:x}.{self.whole:016x}.{self.stride:x}.{grid[0]}.{grid[1]}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, whole, stride, front, back = text.split(".")
        array = lambda s: np.array([int(s[i : i + 8], 16) for i in range(0, len(s), 8)], dtype=np.int64)
        return cls(int(n, 16), int(whole, 16), int(stride, 16), array(front), array(back))

    def likeness(self, other: Fingerprint) -> float:
        """Share of the longer text found in common on the grid alone, from 0 to 1; edits that shift the text hide what lies between them."""
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        if not self.n or not other.n:
            return 0.0
        stride = max(self.stride, other.stride)
        front = [f.front[:: stride // f.stride] for f in (self, other)]
        back = [f.back[:: stride // f.stride] for f in (self, other)]
        head, tail = _common(*front), _common(*back)
        cells = min(len(front[0]), len(front[1])) - 1
        tail = min(tail, cells - head)  # what the beginning has covered does not count twice
        left, right = head, cells - tail
        middle = 0
        if left < right:
            a, b = (np.diff(f[left : right + 1]) % M1 for f in front)
            middle = int((a == b).sum())
        return min(1.0, (head + tail + middle) * stride / max(self.n, other.n))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Cells of the longest common prefix: equal prefix values are equal up to some place, found by binary search."""
    low, high = 0, min(len(a), len(b)) - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid] == b[mid] else (low, mid - 1)
    return low


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of ``following``."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def with_next(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """Rows ``doc_id, text, _shard, _guest`` so that a shard, sorted, holds each own row right before its next document.

    Shards are ranges of doc_id; the first document of a shard also visits the shard
    before it as a guest, and the first of all visits the last.
    """
    sharded, shards = ordered_shards(docs, "doc_id", shard_bytes, F.octet_length("text"))
    own = sharded.withColumn("_guest", F.lit(False))
    firsts = {r["_shard"]: r["first"] for r in sharded.filter("doc_id is not null").groupBy("_shard").agg(F.min("doc_id").alias("first")).collect()}
    if not firsts:
        return own, shards
    order = sorted(firsts)
    host = dict(zip(order, [order[-1], *order[:-1]], strict=True))  # one entry per shard
    places = F.broadcast(docs.sparkSession.createDataFrame([(firsts[s], host[s]) for s in order], "doc_id long, _shard int"))
    guests = docs.join(places, "doc_id").groupBy("doc_id", "_shard").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("_guest", F.lit(True))
    return own.unionByName(guests.select(*own.columns)), shards


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see the contract columns in SCHEMA."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chained, shards = with_next(rows, shard_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # shard, doc_id, text, prefix arrays, fingerprint
        out: list[tuple] = []
        for b in slices(batches):
            for shard, guest, doc, text in zip(column(b, "_shard"), column(b, "_guest"), column(b, "doc_id"), texts(b), strict=True):
                if held is not None and held[0] != shard:
                    held = None
                whole = PrefixHash(text)
                mark = Fingerprint.of(whole)
                if doc is None:
                    out.append(_row(doc, text, whole, mark, text, whole))
                    continue
                if held is not None:
                    out.append(_row(*held[1:], text, whole))
                held = None if guest else (shard, doc, text, whole, mark)
            yield _batch(out)
            out = []

    return by_shard(chained, shards, "_guest", "doc_id", "text").mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _row(doc: int | None, text: str, whole: PrefixHash, mark: Fingerprint, following: str, next_whole: PrefixHash) -> tuple:
    changed = whole.edited(next_whole)
    digest = hashlib.sha256(edited(text, following).encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), digest, str(mark), str(Fingerprint.of(changed)), whole.likeness(changed), whole.likeness(next_whole)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _ARROW]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
