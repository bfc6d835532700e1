"""Operator 7: token ids in one wavelet-matrix file per shard.

Bit-plane k of a wavelet matrix holds bit k (from the top) of every id, in the
order that results from sorting stably by the bits before it.  Rank and select on the
planes give the id at any position, the number of times an id occurs in any range, and the
place of its j-th occurrence, from the file alone.

File: ``WMX2``, the header's length (unsigned 32 bit), a JSON header, then
zstandard-compressed sections: every plane in blocks of ``BLOCK_WORDS`` 64-bit words, and
``doc_ids``, ``doc_null`` and ``doc_ends`` (token offset after each document).  The header
lists their offsets and, for every block, the ones of the plane before it; a block begins
with its rank directory, the ones before each 512 bits.  So a look-up reads the header and
the blocks that it touches, by ranges of the file.

Documents are dealt to ranges of doc_id, and a range's sorted rows are cut into files of about
``FILE_TOKENS`` ids, so the files in the order of (range, number) hold all ids in ascending
doc_id order.  A task writes under a temporary name and then renames,
so repeated or speculative tasks leave one whole file.

Defined cases: a null text is the empty text and holds only the end id; null ids
come first; equal ids lie side by side, ordered by text; repeated rows are each
stored; other columns are ignored; an empty table writes no file and reads as an
empty table.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.bpe import byte_alphabet
from tarnlake.llm.shared import by_shard, materialize, maybe_broadcast, ordered_shards, prepare, shared_dir, slices

MAGIC = b"WMX2"
SHARD_BYTES = 8_000_000  #: text bytes per range, about
FILE_TOKENS = 8_000_000  #: ids after which a file ends; a document is never cut
BLOCK_WORDS = 8192  #: 64-bit words in a block of a plane
_STEP = 8  #: 64-bit words per directory entry
_PIECE = 1 << 16  #: ids moved at once; places within a piece are faster than masks over all

Block = tuple[np.ndarray, np.ndarray]  #: ones before each entry of the directory, and the words


def _directory(words: np.ndarray) -> np.ndarray:
    """Number of ones before every ``_STEP``-th word."""
    ones = np.bitwise_count(words).astype(np.int64)
    return np.concatenate([[0], np.cumsum(np.add.reduceat(ones, np.arange(0, len(ones), _STEP)))])[:-1] if len(ones) else np.zeros(0, np.int64)


class Plane:
    """A bit vector with rank and select, in blocks that ``load`` brings when they are first needed."""

    def __init__(self, n: int, before: np.ndarray, load: Callable[[int], Block]):
        self.n, self.before, self.load = n, np.asarray(before, dtype=np.int64), load
        self.blocks: dict[int, Block] = {}

    @classmethod
    def of(cls, words: np.ndarray, n: int) -> Plane:
        parts = [words[at : at + BLOCK_WORDS] for at in range(0, len(words), BLOCK_WORDS)]
        ones = [int(np.bitwise_count(p).sum()) for p in parts]
        return cls(n, np.cumsum([0, *ones])[: max(1, len(parts))], lambda b: (_directory(parts[b]), parts[b]))

    def block(self, number: int) -> Block:
        if number not in self.blocks:
            self.blocks[number] = self.load(number)
        return self.blocks[number]

    def bit_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each position (0 at the end) and the number of ones before it."""
        at = np.asarray(at, dtype=np.int64)
        bit, rank = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not self.n:
            return bit, rank
        home = np.minimum(at, self.n - 1) // (64 * BLOCK_WORDS)
        for b in np.unique(home).tolist():
            own = np.flatnonzero(home == b)
            directory, words = self.block(b)
            place = at[own] - b * 64 * BLOCK_WORDS
            word = np.minimum(place >> 6, len(words) - 1)
            start = word // _STEP * _STEP
            out = self.before[b] + directory[word // _STEP]
            for k in range(_STEP - 1):
                out = out + np.where(start + k < word, np.bitwise_count(words[np.minimum(start + k, len(words) - 1)]), 0)
            rest = (place - (word << 6)).astype(np.uint64)  # 64 just after the last word
            inside = np.where(rest < 64, (np.uint64(1) << (rest & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
            rank[own] = out + np.bitwise_count(words[word] & inside)
            bit[own] = np.where(rest < 64, (words[word] >> (rest & np.uint64(63))) & np.uint64(1), np.uint64(0)).astype(np.int64)
        return bit, rank

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        return self.bit_rank(at)[1]

    def select(self, value: int, j: np.ndarray) -> np.ndarray:
        """Position of the j-th (from 0) bit that equals ``value``: its block by the header's counts, then binary search on rank."""
        j = np.asarray(j, dtype=np.int64)
        starts = np.arange(len(self.before), dtype=np.int64) * 64 * BLOCK_WORDS
        home = np.searchsorted(self.before if value else starts - self.before, j, side="right") - 1
        low, high = starts[home], np.minimum(starts[home] + 64 * BLOCK_WORDS, self.n)
        while np.any(low < high):
            mid = (low + high) // 2
            bit, ones = self.bit_rank(mid)  # of the position itself, so that no other block is touched
            ones = ones + bit
            got = ones if value else mid + 1 - ones
            go = got > j
            high, low = np.where(go & (low < high), mid, high), np.where(~go & (low < high), mid + 1, low)
        return low

    def words(self) -> np.ndarray:
        parts = [self.block(b)[1] for b in range(-(-self.n // (64 * BLOCK_WORDS)))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


class WaveletMatrix:
    """Token ids as bit-planes."""

    def __init__(self, planes: list[Plane], zeros: list[int], n: int):
        self.planes, self.zeros, self.n, self.bits = planes, zeros, n, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        row = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for k in range(bits):
            one = (row & row.dtype.type(1 << (bits - 1 - k))).astype(bool)
            raw = np.packbits(one, bitorder="little")
            planes.append(Plane.of(np.frombuffer(raw.tobytes() + b"\0" * (-len(raw) % 8), dtype="<u8"), len(ids)))
            low, high = [], []
            for at in range(0, len(row), _PIECE):
                here, bits_here = row[at : at + _PIECE], one[at : at + _PIECE]
                low.append(here.take(np.flatnonzero(~bits_here)))
                high.append(here.take(np.flatnonzero(bits_here)))
            zeros.append(sum(map(len, low)))
            row = np.concatenate([*low, *high]) if low else row
        return cls(planes, zeros, len(ids))

    def all(self) -> np.ndarray:
        """Every id in order: the stable partitions undone from the last plane to the first."""
        row = np.zeros(self.n, dtype=np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            one = np.unpackbits(self.planes[k].words().view(np.uint8), count=self.n, bitorder="little").view(bool)
            back = np.empty_like(row)
            row[self.zeros[k] :] |= row.dtype.type(1 << (self.bits - 1 - k))
            low, high = 0, self.zeros[k]
            for at in range(0, self.n, _PIECE):
                here, ones = back[at : at + _PIECE], np.flatnonzero(one[at : at + _PIECE])
                rest = np.flatnonzero(~one[at : at + _PIECE])
                here[rest], here[ones] = row[low : low + len(rest)], row[high : high + len(ones)]
                low, high = low + len(rest), high + len(ones)
            row = back
            self.planes[k].blocks.clear()
        return row.astype(np.uint32)

    def access(self, at) -> np.ndarray:
        """Ids at positions."""
        at = np.asarray(at, dtype=np.int64)
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            bit, ones = self.planes[k].bit_rank(at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return out

    def _narrow(self, token: int, start: int, stop: int) -> tuple[int, int]:
        if token >> self.bits or token < 0:
            return 0, 0
        ends = np.array([start, stop], dtype=np.int64)
        for k in range(self.bits):
            ones = self.planes[k].rank1(ends)
            ends = self.zeros[k] + ones if token >> (self.bits - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in [start, stop)."""
        low, high = self._narrow(token, start, self.n if stop is None else stop)
        return high - low

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Positions of the token's occurrences numbered [first, last)."""
        low, high = self._narrow(token, 0, self.n)
        at = np.arange(low + first, high if last is None else min(high, low + last), dtype=np.int64)
        for k in reversed(range(self.bits)):
            at = self.planes[k].select(1, at - self.zeros[k]) if token >> (self.bits - 1 - k) & 1 else self.planes[k].select(0, at)
        return at


def pack(shard: list[int], ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray) -> bytes:
    """One shard as a file's bytes."""
    wm = WaveletMatrix.build(ids)
    squeeze = zstandard.ZstdCompressor(level=1)
    body: list[bytes] = []
    end = 0

    def put(raw: bytes) -> list[int]:
        nonlocal end
        body.append(squeeze.compress(raw))
        end += len(body[-1])
        return [end - len(body[-1]), len(body[-1])]

    blocks = []
    for p in wm.planes:
        blocks.append([])
        for b in range(-(-wm.n // (64 * BLOCK_WORDS))):
            directory, words = p.load(b)
            blocks[-1].append(put(directory.astype("<u4").tobytes() + words.tobytes()))
    sections = {
        "doc_ids": put(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        "doc_null": put(np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()),
        "doc_ends": put(ends.astype("<i8").tobytes()),
    }
    head = {"shard": shard, "n": wm.n, "docs": len(doc_ids), "zeros": wm.zeros, "block_words": BLOCK_WORDS, "step": _STEP}
    head |= {"blocks": blocks, "before": [p.before.tolist() for p in wm.planes], "sections": sections}
    raw = json.dumps(head).encode()
    return b"".join([MAGIC, struct.pack("<I", len(raw)), raw, *body])


class ShardFile:
    """A shard's file, given whole or as a function (start, size) that reads a range of it."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self.read = source if callable(source) else lambda start, size: source[start : start + size]
        magic, size = struct.unpack("<4sI", self.read(0, 8))
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.head = json.loads(self.read(8, size))
        self.at = 8 + size
        if (self.head["block_words"], self.head["step"]) != (BLOCK_WORDS, _STEP):
            raise ValueError("blocks of another size")

    def _part(self, place: list[int]) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.read(self.at + place[0], place[1]))

    def section(self, name: str) -> bytes:
        return self._part(self.head["sections"][name])

    def _block(self, plane: int, number: int) -> Block:
        raw = self._part(self.head["blocks"][plane][number])
        size = min(BLOCK_WORDS, -(-self.head["n"] // 64) - number * BLOCK_WORDS)
        entries = -(-size // _STEP)
        return np.frombuffer(raw, "<u4", entries).astype(np.int64), np.frombuffer(raw, "<u8", size, 4 * entries) if entries % 2 == 0 else np.frombuffer(raw[4 * entries :], "<u8", size)

    @property
    def matrix(self) -> WaveletMatrix:
        zeros, n = self.head["zeros"], self.head["n"]
        planes = [Plane(n, before, lambda b, k=k: self._block(k, b)) for k, before in enumerate(self.head["before"])]
        return WaveletMatrix(planes, zeros, n)

    @property
    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and the token offset after each."""
        n = self.head["docs"]
        null = np.unpackbits(np.frombuffer(self.section("doc_null"), np.uint8), count=n).astype(bool)
        ids = np.frombuffer(self.section("doc_ids"), "<i8").tolist()
        return [None if x else d for d, x in zip(ids, null.tolist(), strict=True)], np.frombuffer(self.section("doc_ends"), "<i8")


#: Chunks and spaces that LibraryEncoder's assumptions are tried on.
_TRIED = ["The", "don't", "a1b22", "x.,y", "\u00c9t\u00e9,", "na\u00efve", "\u6f22\u5b57", "e\u0301", "\U0001f600", "\u03a3\u0130", "<|endoftext|>", "_-", "\x85b", "a\u00a0b", "\x1c", "WORDS."]
_SPACES = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r\n"]


class LibraryEncoder:
    """The tokenizers library's ids, each distinct chunk between ASCII spaces encoded once per batch.

    For vocabularies that drop white space before merging (no token spans it) a text's ids are its
    chunks' ids in a row, and a plain word's ids are its lower-case letters' merges and then its
    mark's.  Both are tried on samples when a vocabulary is opened; where they fail whole texts or
    whole chunks go to the library.  Arrow splits and numbers the chunks; ids of the last
    ``KEEP`` to twice as many distinct chunks are kept.
    """

    KEEP = 250_000
    #: Precomposed letters: a run of them and one mark after it are two independent pre-tokens whatever the case.
    LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.alphabet = byte_alphabet()
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        alone = dict(zip(_TRIED, self._library(_TRIED), strict=True))
        pairs = [(a, s, b) for a in _TRIED for b in _TRIED for s in _SPACES]
        together = self._library([a + s + b for a, s, b in pairs])
        self.by_chunk = not any(self._library(_SPACES)) and all(x == alone[a] + alone[b] for (a, _, b), x in zip(pairs, together, strict=True))
        self.marks = {m: self._merge(m) for m in ".,"}
        letters = [chr(c) for c in range(65, 256) if self.LETTERS.fullmatch(chr(c))]
        words = [*letters, *[a + b for a, b in zip(letters, reversed(letters), strict=True)], "Letters", "WORDS"]
        marked = [(w, m) for w in words for m in ("", ".", ",")]
        want = self._library([w + m for w, m in marked])
        self.by_letters = all(x == self._merge(w.lower()) + self.marks.get(m, b"") for (w, m), x in zip(marked, want, strict=True))

    def _library(self, items: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _merge(self, word: str) -> bytes:
        """A lower-case run of letters, or a mark, needs the library's merges only."""
        if not word.isascii():
            word = "".join(map(self.alphabet.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        new, old, merge, letters = self.new, self.old, self._merge, self.LETTERS.fullmatch
        ids = [*map(new.get, chunks)]
        missing = [i for i, x in enumerate(ids) if x is None]
        need = [chunks[i] for i in missing]
        found = [*map(old.get, need)]
        hard, at = [], -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            c = need[at]
            mark = c[-1]
            if mark == "." or mark == ",":
                word = c[:-1]
            else:
                word, mark = c, ""
            if not self.by_letters or not (word.isalpha() and (word.isascii() or letters(word))):
                hard.append(at)
                found[at] = b""
                continue
            word = word.lower()
            x = new.get(word) or old.get(word)
            if x is None:
                x = new[word] = merge(word)
            found[at] = x + self.marks[mark] if mark else x
        for i, x in zip(hard, self._library([need[i] for i in hard]) if hard else (), strict=True):
            found[i] = x
        new.update(zip(need, found, strict=True))
        for i, x in zip(missing, found, strict=True):
            ids[i] = x
        if len(new) > self.KEEP:
            self.old, self.new = new, {"": b""}
        return ids

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and the number of each text's."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            each = self._library(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        each = self._chunks(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        store = np.frombuffer(b"".join(each), "<u4")
        size = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        begin = np.cumsum(size) - size
        chunk = coded.indices.to_numpy(zero_copy_only=False)
        n = size[chunk]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(begin[chunk] - ends[:-1], n)
        at += np.arange(len(at))
        return store[at], np.diff(ends[split.offsets.to_numpy()])


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _put(folder: str, name: str, data: bytes) -> None:
    """Write a file into a folder of any file system that pyarrow knows (s3a is its s3), whole or not at all."""
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    fs, path = pa.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    fs.move(temporary, f"{path}/{name}")


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes: the more texts, the fewer distinct chunks for each."""
    held: list[pa.RecordBatch] = []
    for b in slices(batches, rows=1000, chars=size):
        if held and sum(x.nbytes for x in held) + b.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(b)
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every text, append ``end_id``, and write ``shard-*.wm`` files into ``folder``.

    Returns ``shard, number, n_docs, n_tokens``, one row per file; running it writes the files.
    """
    prepare(docs.sparkSession, lean=False)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sharded, shards = ordered_shards(rows, "doc_id", shard_bytes, F.octet_length("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        at, number, held, ids, sizes, parts = None, 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            _put(folder, f"shard-{at:06d}-{number:06d}.wm", pack([at, number], flat, ids, np.cumsum(sizes)))
            return pa.record_batch([[at], [number], [len(ids)], [len(flat)]], names=["shard", "number", "n_docs", "n_tokens"])

        for b in _gathered(batches):
            bare, counts = enc.encode(b.column("text"))
            flat = np.full(len(bare) + len(counts), end_id, np.uint32)  # every text's ids and an end id
            flat[np.arange(len(bare)) + np.repeat(np.arange(len(counts)), counts)] = bare
            offsets = np.concatenate([[0], np.cumsum(counts + 1)]).tolist()
            low = 0
            for i, (s, d) in enumerate(zip(b.column("_shard").to_pylist(), b.column("doc_id").to_pylist(), strict=True)):
                if at is not None and (s != at or held >= file_tokens):
                    parts.append(flat[offsets[low] : offsets[i]])
                    low = i
                    yield flush()
                    number = number + 1 if s == at else 0
                    held, ids, sizes, parts = 0, [], [], []
                at = s
                ids.append(d)
                sizes.append(offsets[i + 1] - offsets[i])
                held += sizes[-1]
            parts.append(flat[offsets[low] :])
        if at is not None:
            yield flush()

    return by_shard(sharded, shards, "doc_id", "text").mapInArrow(run, "shard long, number long, n_docs long, n_tokens long")


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` of every document in the files of ``folder``.

    Ids are packed as unsigned 32 bit, little-endian; ids_crc32 is their crc32.  ``ids=False`` leaves
    the ids themselves out.
    """
    prepare(spark, lean=False)
    shown = ["ids"] if ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                file = ShardFile(data.as_py())
                (docs, ends), (shard, number) = file.documents, file.head["shard"]
                raw = memoryview(file.matrix.all().astype("<u4")).cast("B")
                starts = np.concatenate([[0], ends[:-1]])
                for lo in range(0, len(docs), 1024):
                    s, e = starts[lo : lo + 1024], ends[lo : lo + 1024]
                    own = [raw[4 * a : 4 * z] for a, z in zip(s.tolist(), e.tolist(), strict=True)]
                    columns = [pa.array([shard] * len(s), pa.int64()), pa.array([number] * len(s), pa.int64()), pa.array(docs[lo : lo + 1024], pa.int64())]
                    columns += [pa.array(s, pa.int64()), pa.array(e - s, pa.int64()), pa.array([*map(zlib.crc32, own)], pa.int64())]
                    columns += [pa.array([*map(bytes, own)], pa.binary())] if ids else []
                    yield pa.record_batch(columns, names=["shard", "number", "doc_id", "at", "n_tokens", "ids_crc32", *shown])

    # exclusive running sums: over the shards (a bounded number), and over the files of each
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier(Window.orderBy("shard"))), F.lit(0)).alias("of_shards"))
    own = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("shard").orderBy("number"))), F.lit(0)).alias("of_files")
    before = manifest.select("shard", "number", own).join(shards, "shard").select("shard", "number", (F.col("of_shards") + F.col("of_files")).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder).select("content")
    docs = files.mapInArrow(run, "shard long, number long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    return docs.join(maybe_broadcast(before, 1_000_000), ["shard", "number"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *shown)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, ids: bool = True) -> DataFrame:
    """Write ``docs`` as files in the shared folder and read them back, as ``read_documents`` does."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "wavelet")
    manifest = materialize(write(docs, tokenizer_path, folder, end_id), "wavelet-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    return read_documents(spark, folder, manifest, ids)
