"""Operator 9: BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token starts as one symbol per byte.  Leaf i of its segment tree holds
``rank * leaves + i`` for the pair that begins at symbol i (infinity if no merge
exists), so the root is the leftmost pair of the lowest rank.  Applying it changes
three leaves, each repaired in a logarithmic number of steps; encoding ends
when the root is infinite.  Pre-tokens of similar length run in lockstep as
rows of one numpy matrix; long ones run singly.

Work per distinct pre-token is done once per batch and frequent results stay in
a bounded dictionary; the dictionary only saves time, never changes a result.

Defined cases: a null text is the empty text (no ids, decoded ''); a special
token's string inside a text becomes that token, as in the tokenizers library's
default; rows are independent, so repeated rows, ties and null ids give one result
row each; other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import prepare, slices, texts

_S = r"\p{White_Space}"
#: Fixed value: how byte-level BPE splits a text (as published with the vocabulary).
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|{_S}+(?![^{_S}])|{_S}+")
_NONE = np.int64(2**62)
_LONG = 128  #: symbols from which a pre-token runs singly
_CACHE = 80_000  #: entries kept per worker and dictionary

SCHEMA = "doc_id long, ids binary, decoded string"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by the public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class PairRanks:
    """Rank of a pair of symbol ids: an open-addressing table read by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        bits = max(10, int(len(left)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.int64)
        todo = np.arange(len(left))
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        while len(todo):
            free = self.keys[slots[todo]] == -1
            _, first = np.unique(slots[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slots[put]], self.ranks[slots[put]] = keys[put], put
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        seen = self.keys[slots]
        out = np.where(seen == keys, self.ranks[slots], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            seen = self.keys[slots[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out


class Codec:
    """A byte-level BPE vocabulary with its encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.rank = PairRanks(left, right)
        self.rank_of = {(a << 32) | b: r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))}
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], dtype=np.int64)
        back = {c: b for b, c in enumerate(alphabet)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in [*vocab.items(), *special.items()]:
            self.token_bytes[i] = bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode()
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    # -- one pre-token after another: the tree in plain lists -----------------

    def merge_one(self, symbols: list[int]) -> list[int]:
        """Encode one pre-token given as symbol ids."""
        n = len(symbols)
        if n < 2:
            return symbols
        leaves = 1 << (n - 1).bit_length()
        rank_of, merged = self.rank_of, self.merged
        inf = int(_NONE)

        def leaf(i: int, j: int) -> int:
            r = rank_of.get((symbols[i] << 32) | symbols[j])
            return inf if r is None else r * leaves + i

        tree = [inf] * (2 * leaves)
        for i in range(n - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low

        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while tree[1] < inf:
            r, i = divmod(tree[1], leaves)
            j = after[i]
            k = after[j]
            symbols[i] = int(merged[r])
            symbols[j] = -1
            after[i] = k
            put(j, inf)
            if k < n:
                before[k] = i
                put(i, leaf(i, k))
            else:
                put(i, inf)
            if before[i] >= 0:
                put(before[i], leaf(before[i], i))
        return [s for s in symbols if s >= 0]

    # -- many pre-tokens in lockstep ------------------------------------------

    def merge_rows(self, sym: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Encode each row of symbol ids (``length`` of them count); merged-away places become -1."""
        rows, leaves = sym.shape
        sym = sym.reshape(-1)
        pair = np.full((rows, leaves), _NONE, dtype=np.int64)
        r, i = np.nonzero(np.arange(leaves - 1)[None, :] < length[:, None] - 1)
        rank = self.rank(sym[r * leaves + i], sym[r * leaves + i + 1])
        pair[r, i] = np.where(rank < _NONE, rank * leaves + i, _NONE)
        levels = [pair]
        while levels[0].shape[1] > 1:
            levels.insert(0, levels[0].reshape(rows, -1, 2).min(axis=2))
        width = 2 * leaves
        tree = np.concatenate([np.full((rows, 1), _NONE), *levels], axis=1).reshape(-1)
        after = np.tile(np.arange(1, leaves + 1), rows)
        before = np.tile(np.arange(-1, leaves - 1), rows)
        act = np.flatnonzero(tree[np.arange(rows) * width + 1] < _NONE)

        def put(act: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base, k = act * width, at + leaves
            tree[base + k] = value
            for _ in range(leaves.bit_length() - 1):
                k = k >> 1
                child = base + 2 * k
                tree[base + k] = np.minimum(tree[child], tree[child + 1])

        while len(act):
            root = tree[act * width + 1]
            i = root % leaves
            base = act * leaves
            j = after[base + i]
            k = after[base + j]
            sym[base + i] = self.merged[root // leaves]
            sym[base + j] = -1
            after[base + i] = k
            tree[act * width + leaves + j] = _NONE
            inside = k < length[act]
            before[(base + k)[inside]] = i[inside]
            new = np.full(len(act), _NONE)
            rank = self.rank(sym[(base + i)[inside]], sym[(base + k)[inside]])
            new[inside] = np.where(rank < _NONE, rank * leaves + i[inside], _NONE)
            put(act, j, np.full(len(act), _NONE))
            put(act, i, new)
            p = before[base + i]
            has = p >= 0
            rank = self.rank(sym[(base + p)[has]], sym[(base + i)[has]])
            put(act[has], p[has], np.where(rank < _NONE, rank * leaves + p[has], _NONE))
            act = act[tree[act * width + 1] < _NONE]
        return sym.reshape(rows, leaves)

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens, as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        for p, b, n in zip(pieces, raw, size.tolist(), strict=True):
            if n > _LONG:
                out[p] = np.array(self.merge_one(self.byte_id[np.frombuffer(b, np.uint8)].tolist()), "<u4").tobytes()
        low = 1
        leaves = 2
        while leaves <= _LONG:
            for part in np.array_split(own := np.flatnonzero((size >= low) & (size <= leaves)), max(1, len(own) * leaves // 150_000)):
                if len(part):
                    n = size[part]
                    flat = self.byte_id[np.frombuffer(b"".join([raw[x] for x in part]), np.uint8)]
                    sym = np.full((len(part), leaves), -1, dtype=np.int64)
                    sym[np.arange(leaves)[None, :] < n[:, None]] = flat
                    sym = self.merge_rows(sym, n)
                    keep = sym >= 0
                    ids, ends = sym[keep].astype("<u4").tobytes(), np.cumsum(4 * keep.sum(axis=1)).tolist()
                    at = 0
                    for x, end in zip(part.tolist(), ends, strict=True):
                        out[pieces[x]] = ids[at:end]
                        at = end
            low, leaves = leaves + 1, 2 * leaves
        return out

    # -- whole texts ----------------------------------------------------------

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        jobs: list[list] = []  # per text: bytes of special tokens and segments (str)
        for t in batch:
            if self.special_re is not None and (found := [*self.special_re.finditer(t)]):
                at, job = 0, []
                for m in found:
                    job += [t[at : m.start()], self.special[m[0]]]
                    at = m.end()
                jobs.append([*job, t[at:]])
            else:
                jobs.append([t])
        parts = {s: s.split(" ") for job in jobs for s in job if isinstance(s, str) and s}
        # A space between two other characters always begins a pre-token, so the text's
        # space-led chunks are independent; chunks that touch other white space send the segment the long way.
        first = {s: p.pop(0) for s, p in parts.items()}
        pieces, chunks = self.pieces, self.chunks
        ids = {s: [*map(chunks.get, p)] for s, p in parts.items()}
        holes = {s: [i for i, x in enumerate(got) if x is None] for s, got in ids.items() if None in got}
        need = {parts[s][i] for s, at in holes.items() for i in at}
        odd = {c for c in need if not c or c[0].isspace() or c[-1].isspace()}
        need -= odd
        whole = {s for s in parts if first[s][-1:].isspace()}
        whole |= {s for s, at in holes.items() if odd and not odd.isdisjoint([parts[s][i] for i in at])}
        split = {c: [" " + c] if c.isalpha() else SPLIT.findall(" " + c) for c in need}
        heads = {s: SPLIT.findall(s if s in whole else first[s]) for s in parts}
        fresh = self.encode_pieces([*set().union(*split.values(), *heads.values()).difference(pieces)])
        pieces.update(fresh)
        for c, p in split.items():
            chunks[c] = pieces[p[0]] if len(p) == 1 else b"".join([pieces[x] for x in p])
        done: dict[str, bytes] = {}
        for s, p in parts.items():
            done[s] = b"".join([pieces[x] for x in heads[s]])
            if s not in whole:
                got = ids[s]
                for i in holes.get(s, ()):
                    got[i] = chunks[p[i]]
                done[s] += b"".join(got)
        for kept, new in ((pieces, fresh), (chunks, split)):
            if len(kept) > _CACHE:
                for x in [*new][: len(kept) - _CACHE]:
                    del kept[x]
        return [b"".join([s if isinstance(s, bytes) else done.get(s, b"") for s in job]) for job in jobs]

    def forget(self) -> None:
        """Empty the kept dictionaries, so that an idle worker holds little."""
        self.pieces.clear()
        self.chunks.clear()

    def decode(self, ids: bytes) -> str:
        """The text of ids: their tokens' bytes, wrong UTF-8 shown as U+FFFD."""
        tokens = self.token_bytes
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every text: ids as packed unsigned 32-bit integers and the text decoded from them."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab_path)
        for b in slices(batches, rows=256, chars=1_000_000):
            ids = bpe.encode(texts(b))
            yield pa.record_batch(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                names=["doc_id", "ids", "decoded"],
            )
        bpe.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def digests(coded: DataFrame) -> DataFrame:
    """Contract columns of ``encode_decode``'s result."""
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
