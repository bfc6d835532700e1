"""Operator 5: a convolutional toxicity classifier on hashed word embeddings, in numpy.

A word's vector is the sum of rows of one table at hashed places: two of the word itself
(so that two words rarely share both) and one each of its first four and first five
characters, which lets unseen forms of a known stem count.  Filters of width 1, 2
and 3 run over all words of the whole text, each filter keeps its maximum, and a
linear layer gives the logit.

It learns from every labelled text it is given, copies of a text once.  A hash deals the texts
into two folds; each fold teaches a network of its own, and the model is the two side by side,
its logit their mean.  A fold lies in shards on the executors.  In each of ``ROUNDS`` rounds every
shard goes on from the fold's network by minibatch Adagrad, and the mean change becomes
the next network: a table row changes by the mean over the shards that touched it.  Changes
are added as integers, so their order does not matter.  The fewer texts, the more epochs
(``EPOCHS`` to five times as many).

Every language gets its own threshold, chosen on all labelled texts, each judged by the network
that has not seen it; the language is guessed from the text alone, by the frequencies of
hashed words in all labelled texts of each language.  The score is the logistic of logit minus
threshold, so 0.5 is the decision for every language.

Defined cases: a null text is the empty text and gets the score of no evidence; without
labelled texts every score is 0; with one class only, every score is that class's; if a fold lacks
a class one network learns from both and the threshold is 0; repeated rows and null ids give
one row each; labels of one document that disagree count as toxic; a null language
teaches no language; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import column, crc32_mod, materialize, maybe_broadcast, prepare, slices, splitmix, texts, trim
from tarnlake.llm.words import split
from tarnlake.sources.staging import scope

TABLE_BITS = 17
DIM = 12
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS)  #: blank words after each text, so that an empty one has a window too
FILTERS = 8  #: per width
EPOCHS = 8
BATCH = 32
RATE = 0.12
ROUNDS = 4  #: of training in shards, after each of which the shards' networks become one
FOLDS = 2
SHARD_CHARS = 12_000_000  #: of a shard of a fold, as long as MAX_SHARDS suffice; they are read as streams of chunks
MAX_SHARDS = 64  #: of a fold
CHUNK_CHARS = 4_000_000  #: of texts in memory at once while training
GUESS_CELLS = 23  #: bits: word places times languages of the guesser, at most
FINE = 256  #: thresholds are multiples of half of 1 / FINE
_ONE = float(1 << 30)  #: of the integers in which changes are added
_BLOCK = 1 << 13  #: table rows that are added up together, and words that are hashed together
_GATHER = 1 << 12  #: words whose vectors are gathered together


def places(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of each word, shape (words, 4), and the bounds of each text's words."""
    w = split(batch)
    hashes = [w.hashes, splitmix(w.hashes ^ np.uint64(0xA5A5)), splitmix(w.prefix_hashes(4) ^ np.uint64(0x44)), splitmix(w.prefix_hashes(5) ^ np.uint64(0x55))]
    shift = np.uint64(64 - TABLE_BITS)
    return np.stack([(h >> shift).astype(np.int32) for h in hashes], axis=1), w.bounds


def _layout(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word lies when every text is followed by blank words, and where texts start and end."""
    counts = np.diff(bounds)
    starts = np.cumsum(np.concatenate([[0], counts[:-1] + PAD]))
    return np.arange(int(bounds[-1] - bounds[0])) + np.repeat(starts - bounds[:-1] + bounds[0], counts), starts, starts + counts + PAD


@dataclass
class Chunk:
    """Labelled texts as numbers of distinct words."""

    rows: np.ndarray  #: places of each distinct word, shape (words, 4)
    ids: np.ndarray  #: the texts' words, as places in rows
    bounds: np.ndarray  #: text i has the words bounds[i]:bounds[i + 1]
    labels: np.ndarray
    langs: list[str | None]

    @classmethod
    def of(cls, batch: list[str], labels: list[int], langs: list[str | None]) -> Chunk:
        parts = [places(batch[at : at + 100]) for at in range(0, len(batch), 100)]  # bounds memory
        every = np.concatenate([r for r, _ in parts])
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
        del parts  # every has them too
        mixed = np.empty(len(every), np.uint64)
        for lo in range(0, len(every), _BLOCK):
            own = every[lo : lo + _BLOCK].astype(np.uint64)
            half = splitmix(own[:, :2] @ np.array([1, 1 << 20], np.uint64))
            mixed[lo : lo + _BLOCK] = splitmix(half ^ (own[:, 2:] @ np.array([1, 1 << 20], np.uint64)))
        _, first, ids = np.unique(mixed, return_index=True, return_inverse=True)
        return cls(every[first], ids.astype(np.int32), bounds, np.asarray(labels, np.float32), langs)


class WordGuesser:
    """The language of a text by the frequencies of its words in the labelled texts of each language."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.bits = max(1, min(TABLE_BITS, GUESS_CELLS - max(0, len(languages) - 1).bit_length()))
        self.weights = np.zeros((len(languages), 1 << self.bits), np.float32)

    def count(self, chunk: Chunk) -> Iterator[tuple[int, np.ndarray]]:
        """For each language in the chunk its number and how often it has the words of each place."""
        at = self._places(chunk.rows)[chunk.ids]
        owner = np.repeat([self.languages.index(x) if x is not None else -1 for x in chunk.langs], np.diff(chunk.bounds))
        for i in sorted(set(owner.tolist()) - {-1}):
            yield i, np.bincount(at[owner == i], minlength=1 << self.bits)

    def learn(self, counts: dict[int, np.ndarray]) -> None:
        for i in range(len(self.languages)):
            own = counts.get(i, np.zeros(1 << self.bits)) + 0.5
            self.weights[i] = np.log(own / own.sum())

    def _places(self, rows: np.ndarray) -> np.ndarray:
        return rows[:, 0] >> (TABLE_BITS - self.bits)

    def numbers(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of the likeliest language of each text, -1 without words."""
        number = np.full(len(bounds) - 1, -1)
        full = np.flatnonzero(np.diff(bounds))
        if len(full) and self.languages:
            starts = bounds[full] - bounds[0]
            best = np.full(len(full), -np.inf)
            for i, w in enumerate(self.weights):
                votes = np.add.reduceat(w[at].astype(np.float64), starts)
                number[full[votes > best]] = i
                best = np.maximum(best, votes)
        return number


class ToxicityNet:
    """The network, its thresholds and its language guesser."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.05, (1 << TABLE_BITS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        self.out = rng.normal(0.5, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out_bias = np.float32(-1.0)
        self.constant: float | None = None
        self.languages: WordGuesser | None = None
        self.thresholds = np.zeros(1, dtype=np.float32)

    # -- forward --------------------------------------------------------------

    def _pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum and its place of every filter over one text's words and the blanks after them."""
        x = self.table[rows].sum(axis=1) if len(rows) else np.zeros((0, self.table.shape[1]), np.float32)
        x = np.concatenate([x, np.zeros((PAD, x.shape[1]), np.float32)])
        best, where = [], []
        for f in self.filters:
            w = len(f)
            z = sum(x[k : len(x) - w + 1 + k] @ f[k] for k in range(w))
            at = z.argmax(axis=0)
            best.append(z[at, np.arange(z.shape[1])])
            where.append(at)
        return np.concatenate(best), np.concatenate(where)

    def _convolved(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Of words and blanks in one row: every filter's values, one array a width, and each text's maxima."""
        # one product for every row of every filter, then sums of shifted rows
        each = np.concatenate([row for f in self.filters for row in f], axis=1).T @ x.T
        values, at = [], 0
        for f in self.filters:
            n = f.shape[2]
            z = each[at : at + n]
            for k in range(1, len(f)):
                z[:, :-k] += each[at + k * n : at + (k + 1) * n, k:]
                z[:, ends - k] = -np.inf  # would reach into the next text
            at += len(f) * n
            values.append(z)
        return values, np.concatenate([np.maximum.reduceat(z, starts, axis=1) for z in values]).T

    def _logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts whose words have the vectors ``words``."""
        place, starts, ends = _layout(bounds)
        x = np.zeros((int(ends[-1]), words.shape[1]), np.float32)
        x[place] = words
        return np.maximum(self._convolved(x, starts, ends)[1] + self.bias, 0) @ self.out + self.out_bias

    def _vectors(self, rows: np.ndarray) -> np.ndarray:
        gathered = np.empty((len(rows), self.table.shape[1]), np.float32)
        for lo in range(0, len(rows), _GATHER):  # pieces that stay in the cache; with mode="clip" take needs no buffer
            own, some = rows[lo : lo + _GATHER], gathered[lo : lo + _GATHER]
            self.table.take(own[:, 0], axis=0, mode="clip", out=some)
            more = np.empty_like(some)
            for k in range(1, rows.shape[1]):
                some += self.table.take(own[:, k], axis=0, mode="clip", out=more)
        return gathered

    def logits(self, batch: list[str]) -> np.ndarray:
        rows, bounds = places(batch)
        return self._logits(self._vectors(rows), bounds) if len(batch) else np.zeros(0)

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.constant is not None or not len(batch):
            return np.full(len(batch), self.constant, dtype=np.float64)
        rows, bounds = places(batch)
        logit = self._logits(self._vectors(rows), bounds).astype(np.float64)
        if self.languages is not None:
            logit -= self.thresholds[self.languages.numbers(self.languages._places(rows), bounds)]  # -1, unknown, is the last entry
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    # -- training -------------------------------------------------------------

    def fit(self, batch: list[str], labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> ToxicityNet:
        """Learn from texts in memory, as ``train`` does from a table: every other text of a class is a fold's."""
        fold = np.zeros(len(batch), np.int64)
        for y in (0, 1):
            own = np.flatnonzero(np.asarray(labels) == y)
            fold[own] = np.arange(len(own)) % FOLDS
        chunks = []
        for i in range(FOLDS):
            own = np.flatnonzero(fold == i)
            if len(own):
                chunks.append((i, Chunk.of([batch[d] for d in own], [int(labels[d]) for d in own], [langs[d] for d in own] if langs else [None] * len(own))))
        stats: dict = {}
        for i, chunk in chunks:
            for y, lang in zip(chunk.labels, chunk.langs, strict=True):
                stats[i, int(y), lang] = stats.get((i, int(y), lang), 0) + 1
        plan = _Plan(stats, 1, epochs, seed)

        def count(guesser: WordGuesser) -> dict[int, np.ndarray]:
            counts: dict = {}
            for _, chunk in chunks:
                for i, c in guesser.count(chunk):
                    counts[i] = counts.get(i, 0) + c
            return counts

        def learn(states: list[_State], turn: int) -> None:
            for i, chunk in chunks:
                states[plan.net(i)].learn(chunk, plan, turn, plan.net(i), [i, 0, 0])

        def judge(nets: list[ToxicityNet], guesser: WordGuesser) -> list[tuple]:
            return [(1 - i, n, b, y, 1) for i, chunk in chunks for n, b, y in _judged(nets[1 - i], guesser, chunk)]

        self.__dict__ |= _fitted(plan, count, learn, judge).__dict__
        return self


class _Plan:
    """What the numbers of labelled texts by (fold, label, language) decide."""

    def __init__(self, stats: dict, shards: int, epochs: int = EPOCHS, seed: int = 7):
        self.seed = seed
        self.languages = sorted({lang for _, _, lang in stats if lang is not None})
        both = {y: sum(n for (_, label, _), n in stats.items() if label == y) for y in (0, 1)}
        self.classes = [y for y in (0, 1) if both[y]]
        per = [{y: sum(n for (f, label, _), n in stats.items() if f == i and label == y) for y in (0, 1)} for i in range(FOLDS)]
        self.counts = per if all(min(c.values()) for c in per) else [both]
        self.rounds = ROUNDS if shards > 1 else 1
        self.epochs = []  #: of each net in each round
        for c in self.counts:
            n = max(1, sum(c.values()))
            self.epochs.append(-(-max(epochs, min(5 * epochs, 500 * BATCH // n)) // self.rounds))  # few texts need more epochs

    def net(self, fold: int) -> int:
        """The network that a fold teaches."""
        return fold if len(self.counts) > 1 else 0

    def weight(self, net: int) -> np.ndarray:
        c = self.counts[net]
        return np.array([(c[0] + c[1]) / (2 * max(1, c[y])) for y in (0, 1)], np.float32)


class _State:
    """A network with the sums of squares that Adagrad keeps."""

    def __init__(self, net: ToxicityNet):
        self.net = net
        self.sums = np.full(len(net.table), 1e-2, np.float32)
        self.squares = [np.full_like(p, 1e-2) for p in self._dense()]
        self.bias_square = 1e-2

    def _dense(self) -> list[np.ndarray]:
        return [*self.net.filters, self.net.bias, self.net.out]

    def block(self, at: int) -> np.ndarray:
        """Rows of the table with their sums, ``_BLOCK`` from ``at`` on."""
        return np.concatenate([self.net.table[at : at + _BLOCK], self.sums[at : at + _BLOCK, None]], axis=1)

    def rest(self) -> np.ndarray:
        """All numbers but the table and its sums."""
        rest = [*self._dense(), *self.squares, np.array([self.net.out_bias, self.bias_square])]
        return np.concatenate([p.ravel() for p in rest]).astype(np.float64)

    def set(self, table: np.ndarray, rest: np.ndarray) -> _State:
        self.net.table, self.sums = np.ascontiguousarray(table[:, :-1], np.float32), np.array(table[:, -1], np.float32)
        at = 0
        for p in [*self._dense(), *self.squares]:
            p[...] = rest[at : at + p.size].reshape(p.shape)
            at += p.size
        self.net.out_bias, self.bias_square = np.float32(rest[at]), float(rest[at + 1])
        return self

    def learn(self, chunk: Chunk, plan: _Plan, turn: int, which: int, name: list[int]) -> None:
        """The epochs of round ``turn`` over the chunk."""
        rng = np.random.default_rng([plan.seed, turn, *name])
        weight, epochs = plan.weight(which), plan.epochs[which]
        vectors = self.net._vectors(chunk.rows)  # of each distinct word, kept up with the table
        users = np.argsort(chunk.rows.ravel(), kind="stable")
        used = chunk.rows.ravel()[users]
        for epoch in range(turn * epochs, (turn + 1) * epochs):
            rate = RATE / (1 + 0.3 * epoch * EPOCHS / (epochs * plan.rounds))
            order = rng.permutation(len(chunk.labels))
            for lo in range(0, len(order), BATCH):
                self._step(chunk, order[lo : lo + BATCH], weight, rate, vectors, users, used)

    def _step(self, chunk: Chunk, docs: np.ndarray, weight: np.ndarray, rate: float, vectors: np.ndarray, users: np.ndarray, used: np.ndarray) -> None:
        net = self.net
        ids = np.concatenate([chunk.ids[chunk.bounds[d] : chunk.bounds[d + 1]] for d in docs])
        place, starts, ends = _layout(np.concatenate([[0], np.cumsum(chunk.bounds[docs + 1] - chunk.bounds[docs])]))
        x = np.zeros((int(ends[-1]), DIM), np.float32)
        x[place] = vectors[ids]
        word = np.full(len(x), -1)
        word[place] = ids
        values, pooled = net._convolved(x, starts, ends)
        hidden = np.maximum(pooled + net.bias, 0)
        logit = hidden @ net.out + net.out_bias
        y = chunk.labels[docs]
        g = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight[y.astype(int)] / BATCH).astype(np.float32)
        active = np.flatnonzero(np.abs(g) * BATCH >= 0.02)  # the others are as good as learnt
        g, hidden = g[active], hidden[active]
        back = g[:, None] * net.out * (hidden > 0)
        dense = self._dense()
        grads = [np.zeros_like(p) for p in dense]
        grads[-1] += g @ hidden
        grads[-2] += back.sum(axis=0)
        touched, pushes = [], []
        for i, (f, z) in enumerate(zip(net.filters, values, strict=True)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            text, filt = np.nonzero(own)
            if not len(text):
                continue
            where = np.stack([starts[d] + z[:, starts[d] : ends[d]].argmax(axis=1) for d in active])[text, filt]
            b = own[text, filt][:, None]
            for k in range(len(f)):
                np.add.at(grads[i][k].T, filt, b * x[where + k])
                real = word[where + k] >= 0
                touched.append(chunk.rows[word[where + k][real]].ravel())
                pushes.append(np.repeat((b * f[k].T[filt])[real], 4, axis=0))
        for p, s, grad in zip(dense, self.squares, grads, strict=True):
            s += grad * grad
            p -= rate * grad / np.sqrt(s)
        out_grad = float(g.sum())
        self.bias_square += out_grad**2
        net.out_bias -= np.float32(rate * out_grad / np.sqrt(self.bias_square))
        rows = np.concatenate(touched) if touched else np.zeros(0, np.int32)
        if len(rows):
            by = np.argsort(rows, kind="stable")
            unique, first = np.unique(rows[by], return_index=True)
            total = np.add.reduceat(np.concatenate(pushes)[by], first, axis=0)
            self.sums[unique] += (total**2).mean(axis=1)
            change = 2 * rate * total / np.sqrt(self.sums[unique])[:, None]
            net.table[unique] -= change
            lo, hi = np.searchsorted(used, unique, "left"), np.searchsorted(used, unique, "right")
            n = hi - lo
            at = np.arange(int(n.sum())) + np.repeat(lo - np.cumsum(n) + n, n)
            cells = (users[at] // 4 * DIM)[:, None] + np.arange(DIM)  # by cell in one row, which numpy does several times faster than by rows
            np.subtract.at(vectors.reshape(-1), cells.ravel(), np.repeat(change, n, axis=0).ravel())


def _judged(net: ToxicityNet, guesser: WordGuesser, chunk: Chunk) -> Iterator[tuple[int, int, int]]:
    """Language number, logit in steps of 1 / FINE and label of each text."""
    at = guesser._places(chunk.rows)
    for lo in range(0, len(chunk.labels), 200):
        bounds = chunk.bounds[lo : min(lo + 200, len(chunk.labels)) + 1]
        ids = chunk.ids[bounds[0] : bounds[-1]]
        logit = net._logits(net._vectors(chunk.rows[ids]), bounds)
        number = guesser.numbers(at[ids], bounds)
        step = np.floor(np.clip(logit, -31, 31) * FINE)
        yield from zip(number.tolist(), step.astype(int).tolist(), chunk.labels[lo : lo + 200].astype(int).tolist(), strict=True)


def _fitted(plan: _Plan, count: Callable, learn: Callable, judge: Callable) -> ToxicityNet:
    """The model, by functions that go over all chunks.

    ``count`` gives word counts by language, ``learn`` does one round on the states, and ``judge`` gives
    rows of net, language number, logit step, toxic texts and texts, of texts that the net has not seen.
    """
    model = ToxicityNet(plan.seed)
    if len(plan.classes) < 2:
        model.constant = float(plan.classes[0]) if plan.classes else 0.0
        return model
    guesser = WordGuesser(plan.languages)
    guesser.learn(count(guesser))
    states = [_State(ToxicityNet(plan.seed + i)) for i in range(len(plan.counts))]
    for turn in range(plan.rounds):
        learn(states, turn)
    nets = [s.net for s in states]
    model = _side_by_side(nets)
    model.languages = guesser
    model.thresholds = np.zeros(len(plan.languages) + 1, np.float32)
    if len(nets) > 1:
        got = np.array(judge(nets, guesser), np.int64).reshape(-1, 5)
        model.thresholds = np.mean([_thresholds(got[got[:, 0] == i], len(plan.languages)) for i in range(len(nets))], axis=0).astype(np.float32)
    return model


def _side_by_side(nets: list[ToxicityNet]) -> ToxicityNet:
    """One network whose logit is the mean of the networks' logits."""
    out = ToxicityNet()
    out.table = np.concatenate([n.table for n in nets], axis=1)
    out.filters = []
    for i, w in enumerate(WIDTHS):
        f = np.zeros((w, DIM * len(nets), FILTERS * len(nets)), np.float32)
        for j, n in enumerate(nets):
            f[:, j * DIM : (j + 1) * DIM, j * FILTERS : (j + 1) * FILTERS] = n.filters[i]
        out.filters.append(f)
    own = [slice(i * FILTERS, (i + 1) * FILTERS) for i in range(len(WIDTHS))]
    out.bias = np.concatenate([n.bias[s] for s in own for n in nets])
    out.out = np.concatenate([n.out[s] for s in own for n in nets]) / np.float32(len(nets))
    out.out_bias = np.float32(np.mean([n.out_bias for n in nets]))
    return out


def _thresholds(judged: np.ndarray, languages: int) -> np.ndarray:
    """Per guessed language the threshold of the best F1, in the middle of its plateau; the overall one is last."""

    def one(rows: np.ndarray, default: float) -> float:
        step, place = np.unique(rows[:, 2], return_inverse=True)
        return _threshold((step + 0.5) / FINE, np.bincount(place, rows[:, 3]), np.bincount(place, rows[:, 4]), default)

    overall = one(judged, 0.0)
    out = np.full(languages + 1, overall)
    for i in range(languages):
        own = judged[judged[:, 1] == i]
        if own[:, 3].sum() >= 5:  # fewer toxic texts say too little about a language
            out[i] = one(own, overall)
    return out


def _threshold(z: np.ndarray, toxic: np.ndarray, every: np.ndarray, default: float) -> float:
    """Of ascending logits ``z``, each of ``every`` texts and ``toxic`` ones among them."""
    if not len(z) or toxic.sum() in (0, every.sum()):
        return default
    hits = toxic.sum() - np.concatenate([[0], np.cumsum(toxic)])  # toxic texts above each cut
    said = every.sum() - np.concatenate([[0], np.cumsum(every)])
    f1 = 2 * hits / np.maximum(1, said + toxic.sum())
    ends = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    return float(ends[best[len(best) // 2]])


_CHUNK = "shard int, chunk int, words binary, ids binary, bounds binary, toxic array<int>, lang array<string>"


def _chunks(labelled: DataFrame) -> tuple[DataFrame, int]:
    """Every different labelled text once, as chunks of numbered words, and the number of shards of a fold.

    A shard is fold + FOLDS * number; its chunks are written next to each other.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("toxic").isNotNull()).select("text", (F.col("toxic") != 0).cast("int").alias("toxic"), "lang")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, min(MAX_SHARDS, -(-size // (FOLDS * SHARD_CHARS))))
    place = F.xxhash64("text")
    rows = rows.groupBy("text", "toxic").agg(F.min("lang").alias("lang")).withColumn("_shard", F.pmod(place, F.lit(FOLDS * shards)).cast("int"))
    rows = rows.repartitionById(FOLDS * shards, F.col("_shard")).sortWithinPartitions("_shard", place, "text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, size, held = -1, 0, 0, []

        def flush() -> pa.RecordBatch:
            c = Chunk.of(*map(list, zip(*held, strict=True)))
            columns = [[shard], [number], [c.rows.tobytes()], [c.ids.tobytes()], [c.bounds.tobytes()], [c.labels.astype(int).tolist()], [c.langs]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string())]
            return pa.record_batch([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["shard", "chunk", "words", "ids", "bounds", "toxic", "lang"])

        for b in slices(batches):
            for s, *row in zip(column(b, "_shard"), column(b, "text"), column(b, "toxic"), column(b, "lang"), strict=True):
                if held and (s != shard or size >= CHUNK_CHARS):
                    yield flush()
                    number = number + 1 if s == shard else 0
                    size, held = 0, []
                shard = s
                held.append(row)
                size += len(row[0])
        if held:
            yield flush()

    return materialize(rows.mapInArrow(run, _CHUNK), "labelled"), shards


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Chunk]]:
    for b in batches:
        for i in range(b.num_rows):
            shard, number, *data, toxic, lang = (b.column(k)[i] for k in range(b.num_columns))
            words, ids, bounds = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(data, (np.int32, np.int32, np.int64), strict=True))  # in the batch's own memory
            yield shard.as_py(), number.as_py(), Chunk(words.reshape(-1, 4), ids, bounds, np.array(toxic.as_py(), np.float32), lang.as_py())


def _lessons(chunks: Iterator[tuple[int, int, Chunk]], states: list[_State], plan: _Plan, turn: int, one: bool) -> Iterator[pa.RecordBatch]:
    """The networks' changes, as integers, by a task's chunks in round ``turn``; ``states`` stay as they are."""
    tables, rests = {}, {}
    state, current = None, None

    def add() -> None:
        net = plan.net(current % FOLDS)
        before = states[net]
        if net not in tables:
            tables[net] = np.zeros((len(state.sums), DIM + 2), np.int64)
        table = tables[net]
        for at in range(0, len(table), _BLOCK):  # a block at a time, as 64-bit copies of a table are large
            moved = np.rint((state.block(at).astype(np.float64) - before.block(at)) * _ONE).astype(np.int64)
            table[at : at + _BLOCK, :-1] += moved
            table[at : at + _BLOCK, -1] += moved.any(axis=1)
        rests[net] = rests.get(net, 0) + np.append(np.rint((state.rest() - before.rest()) * _ONE).astype(np.int64), 1)

    for shard, number, chunk in chunks:
        net = plan.net(shard % FOLDS)
        if current is None or (shard != current and not one):
            if current is not None:
                add()
            state = None  # before the next one is made
            state = deepcopy(states[net])
        current = shard
        state.learn(chunk, plan, turn, net, [shard % FOLDS, shard // FOLDS, number])
    if current is not None:
        add()
    state = None
    for net, table in tables.items():
        for block in range(0, len(table), _BLOCK):
            yield _part(net, block, table[block : block + _BLOCK].ravel())
        yield _part(net, -1, rests[net])


def _added(parts: DataFrame, finish: Callable[[int, int, np.ndarray], np.ndarray] = lambda net, block, data: data) -> dict[tuple[int, int], bytes]:
    """Integers of ``net, block, data`` rows, added up by net and block; the sums go through ``finish`` on the executors, and the driver gets what it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for net, block, data in zip(column(b, "net"), column(b, "block"), b.column(b.schema.get_field_index("data")), strict=True):
                total[net, block] = total.get((net, block), 0) + np.frombuffer(data.as_buffer(), np.int64)
        for key, data in total.items():
            yield _part(*key, finish(*key, data))

    return {(r["net"], r["block"]): r["data"] for r in parts.repartition("net", "block").mapInArrow(run, parts.schema).collect()}


def _part(net: int, block: int, data: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([net], pa.int32()), pa.array([block], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["net", "block", "data"])


_PART = "net int, block int, data binary"


def train(labelled: DataFrame) -> ToxicityNet:
    """Fit on all ``text, toxic, lang`` rows; lang only teaches the guesser that picks a threshold."""
    prepare(labelled.sparkSession)
    with scope(labelled.sparkSession):
        model = _train(*_chunks(labelled))
    trim()
    return model


def _train(chunks: DataFrame, shards: int) -> ToxicityNet:
    spark = chunks.sparkSession
    each = chunks.select((F.col("shard") % FOLDS).alias("fold"), F.explode(F.arrays_zip("toxic", "lang")).alias("of")).groupBy("fold", "of.toxic", "of.lang").count()
    plan = _Plan({(r["fold"], r["toxic"], r["lang"]): r["count"] for r in each.collect()}, shards)
    one = len(plan.counts) == 1 and shards == 1  # few texts of one class: its network goes on from fold to fold
    lessons = chunks.coalesce(1).sortWithinPartitions("shard", "chunk") if one else chunks

    def count(guesser: WordGuesser) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for _, _, chunk in _read(batches):
                for i, c in guesser.count(chunk):
                    total[i] = total.get(i, 0) + c
            for i, c in total.items():
                yield _part(0, i, c)

        return {i: np.frombuffer(c, np.int64) for (_, i), c in _added(chunks.mapInArrow(run, _PART)).items()}

    def learn(states: list[_State], turn: int) -> None:
        shared = spark.sparkContext.broadcast(states)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _lessons(_read(batches), shared.value, plan, turn, one)

        def moved_on(net: int, block: int, data: np.ndarray) -> np.ndarray:
            """The next rows of a block of the table, which are shorter than the sums of their changes."""
            if block < 0:
                return data
            own = shared.value[net].block(block)
            moved = data.reshape(-1, own.shape[1] + 1)
            return (own.astype(np.float64) + moved[:, :-1] / (_ONE * np.maximum(1, moved[:, -1:]))).astype(np.float32)

        total = _added(lessons.mapInArrow(run, _PART), moved_on)
        shared.destroy()
        for net, state in enumerate(states):
            moved = np.frombuffer(total.pop((net, -1)), np.int64)
            rest = state.rest() + moved[:-1] / (_ONE * moved[-1])
            blocks = [np.frombuffer(total.pop((net, block)), np.float32) for block in range(0, len(state.sums), _BLOCK)]
            state.set(np.concatenate(blocks).reshape(len(state.sums), -1), rest)

    def judge(nets: list[ToxicityNet], guesser: WordGuesser) -> list[tuple]:
        shared = spark.sparkContext.broadcast((nets, guesser))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, _, chunk in _read(batches):
                other = 1 - shard % FOLDS
                number, step, toxic = (pa.array(v, pa.int32()) for v in zip(*_judged(shared.value[0][other], shared.value[1], chunk), strict=True))
                yield pa.record_batch([pa.array([other] * len(step), pa.int32()), number, step, toxic], names=["net", "number", "step", "toxic"])

        rows = chunks.mapInArrow(run, "net int, number int, step int, toxic int").groupBy("net", "number", "step").agg(F.sum("toxic"), F.count("*"))
        got = [tuple(r) for r in rows.collect()]
        shared.destroy()
        return got

    return _fitted(plan, count, learn, judge)


def score(docs: DataFrame, model: ToxicityNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` as it is, ``score`` (0 to 1) and ``predicted`` (score >= 0.5) of every text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, chars=500_000):
            s = shared.value.scores(texts(b))
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic, lang`` of labelled documents that are not held out (crc32 of doc_id mod 5 is not 0)."""
    per_doc = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per_doc = per_doc.filter(crc32_mod(F.col("doc_id"), 5) != 0)
    per_doc = maybe_broadcast(per_doc, 1_000_000)
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return rows.join(per_doc, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "lang")


def train_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: fit on the labelled rows that are not held out, score every row."""
    scored = score(docs, train(labelled_texts(docs, labels)))
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
