"""Operator 6: language identification by bit-sliced Bloom filters of n-grams.

Every language owns one bit.  All languages' Bloom filters share hash functions and are
stored slice by slice: slot p holds the bits of slot p of every filter, so the
AND of an n-gram's slots is at once the set of all languages that contain it.  A text's
vote for a language is the number of its n-grams with that bit, corrected for
the false positives that the filter's fill predicts; the largest vote decides.

A language's filter holds the n-grams (3 and 4 characters inside words with their
borders) that are at least ``SHARE`` times as frequent in it as in the language where
they are most frequent.  It is fitted on at most ``MAX_TRAINING`` texts in all, split
evenly over the languages, of each the different texts with the smallest hashes.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the
language first in code-point order; without any labelled text every text is ``und``;
repeated rows and null ids give one row each; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.shared import crc32_mod, prepare, slices, splitmix, texts
from tarnlake.llm.words import code_points

MAX_TRAINING = 4_000  #: texts that the filters are fitted on, at most
SHARE = 0.3
SLOTS_PER_GRAM = 16
HASHES = 3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


_SALT = splitmix(np.arange(0x110000, dtype=np.uint64) + np.uint64(1 << 40))
_STEP = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the number of the text of each (ascending)."""
    codes, offsets = code_points([t.lower() for t in batch])
    lengths = np.diff(offsets)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    owner = np.repeat(np.arange(len(batch)), lengths)
    codes, owner, letter = codes[keep], owner[keep], letter[keep]
    if len(codes) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.concatenate([[np.uint32(32)], codes])  # the first word's border; others use the blank before them
    letter = np.concatenate([[False], letter])
    owner = np.concatenate([owner[:1], owner])
    salt = _SALT[codes]
    out, who = [], []
    with np.errstate(over="ignore"):
        for n in (3, 4):
            if len(codes) < n:
                continue
            m = len(codes) - n + 1
            inner = letter[1 : 1 + m].copy()
            for k in range(2, n - 1):
                inner &= letter[k : k + m]
            at = np.flatnonzero(inner)
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h += salt[at + k] * _STEP[k]
            out.append(splitmix(h))
            who.append(owner[at + 1])
    hashes, owners = np.concatenate(out), np.concatenate(who)
    order = np.argsort(owners, kind="stable")
    return hashes[order], owners[order]


def _gram_counts(batch: list[str], step: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts and how often each occurs, ``step`` texts at a time to bound memory."""
    values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(batch), step):
        v, c = np.unique(grams(batch[at : at + step])[0], return_counts=True)
        every, inverse = np.unique(np.concatenate([values, v]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([counts, c]), minlength=len(every)).astype(np.int64)
        values = every
    return values, counts


class LanguageFilters:
    """Bit-sliced Bloom filters, one bit per language."""

    def __init__(self, languages: list[str], members: list[np.ndarray]):
        """``members``: hashes of each language's n-grams."""
        self.languages = languages
        planes = max(1, -(-len(languages) // 64))
        most = max([1, *map(len, members)])
        self.slots = 1 << (most * SLOTS_PER_GRAM - 1).bit_length()
        self.table = np.zeros((planes, self.slots), dtype=np.uint64)
        for i, own in enumerate(members):
            for at in self._places(own):
                np.bitwise_or.at(self.table[i // 64], at, np.uint64(1 << (i % 64)))
        fill = [float(((self.table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.slots - 1)
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        with np.errstate(over="ignore"):
            return [((hashes + step * np.uint64(k)) & mask).astype(np.int64) for k in range(HASHES)]

    @classmethod
    def fit(cls, batch: list[str], labels: list[str]) -> LanguageFilters:
        languages = sorted(set(labels))
        each = []
        for lang in languages:
            values, counts = _gram_counts([t for t, x in zip(batch, labels, strict=True) if x == lang])
            each.append((values, counts / max(1, counts.sum()), counts))
        every = np.unique(np.concatenate([v for v, _, _ in each])) if each else np.zeros(0, np.uint64)
        top = np.zeros(len(every))
        for v, f, _ in each:
            at = np.searchsorted(every, v)
            top[at] = np.maximum(top[at], f)
        members = [v[(f >= SHARE * top[np.searchsorted(every, v)]) & (c > 1)] for v, f, c in each]
        return cls(languages, members)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Per plane and n-gram the bits of all languages that contain it."""
        out = None
        for at in self._places(hashes):
            out = self.table[:, at] if out is None else out & self.table[:, at]
        return out

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and language number (-1: unknown) of each text."""
        hashes, owner = grams(batch)
        total = np.bincount(owner, minlength=len(batch)).astype(float)
        votes = np.zeros((len(batch), len(self.languages)))
        if len(hashes) and self.languages:
            masks = self.masks(hashes)
            for i in range(len(self.languages)):
                bit = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64)
                seen = np.bincount(owner, weights=bit, minlength=len(batch))
                rate = self.false_rate[i]
                votes[:, i] = np.maximum(0.0, seen - total * rate) / max(1e-9, 1 - rate)
        number = np.full(len(batch), -1)
        score = np.zeros(len(batch))
        if self.languages:
            known = total > 0
            best = votes.argmax(axis=1)
            ranked = np.sort(votes, axis=1)[:, ::-1]
            second = ranked[:, 1] if ranked.shape[1] > 1 else np.zeros(len(batch))
            number[known] = best[known]
            both = ranked[:, 0] + second
            score[known] = np.where(both > 0, ranked[:, 0] / np.maximum(both, 1e-12), 1 / len(self.languages))[known]
        return [self.languages[i] if i >= 0 else UNKNOWN for i in number], score, number


def label_counts(rows: DataFrame, most: int) -> list[tuple]:
    """``label, n`` of the ``most`` labels with the most different texts; n is an estimate."""
    counts = rows.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    return [(r["label"], r["n"]) for r in counts.orderBy(F.desc("n"), "label").limit(most).collect()]


def training_sample(rows: DataFrame, max_rows: int) -> list:
    """At most ``max_rows`` different ``text, label`` rows (and the least of other columns), evenly over labels.

    Of every label the texts with the smallest hashes are taken, copies of a text once.  The estimated
    numbers of texts only choose up to which hash the first pass looks; it looks further until
    every label has its share or all its texts.  Beyond ``max_rows`` labels the rarest are not learned.
    """
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    counts = label_counts(rows, max_rows)
    if not counts:
        return []
    each = max(1, max_rows // len(counts))
    wanted = each * 1.25 + 5 * each**0.5 + 20
    kind = T.StructType([T.StructField("label", rows.schema["label"].dataType), T.StructField("upto", T.LongType())])
    place = F.xxhash64("text")
    more = [F.min(c).alias(c) for c in rows.columns if c not in ("text", "label")]
    found, share = {}, {label: min(1.0, wanted / max(1, n)) for label, n in counts}
    todo = [*share]
    while todo:
        upto = [(label, min(2**63 - 1, int(share[label] * 2**64) - 2**63)) for label in todo]
        cut = F.broadcast(rows.sparkSession.createDataFrame(upto, kind))  # at most max_rows rows
        some = rows.join(cut, "label").filter(place <= F.col("upto")).groupBy("text", "label").agg(F.count("*").alias("copies"), *more)
        first = some.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(place, "text"))).filter(F.col("rank") <= each).drop("rank")
        got: dict = {label: [] for label in todo}
        for r in first.orderBy(place, "text", "label").collect():
            got[r["label"]].append(r)
        found |= got
        todo = [label for label in todo if len(got[label]) < each and share[label] < 1]
        share |= {label: min(1.0, 16 * share[label]) for label in todo}
    # in the order of a hash that mixes the labels
    return sorted((r for own in found.values() for r in own), key=lambda r: xxhash.xxh64_intdigest(r["text"].encode("utf-8", "surrogatepass")))


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING) -> LanguageFilters:
    """Fit on ``text, label`` rows."""
    got = training_sample(labelled, max_rows)
    return LanguageFilters.fit([r["text"] for r in got], [r["label"] for r in got])


def identify(docs: DataFrame, model: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, chars=500_000):
            lang, score, _ = shared.value.predict(texts(b))
            yield pa.record_batch([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Contract columns: fit on the rows that are not held out, predict every row."""
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    labelled = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").alias("label"))
    return identify(docs, train(labelled)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
