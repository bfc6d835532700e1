"""Operator 10: token counts by counting each distinct pre-token once.

A SentencePiece BPE vocabulary without pieces that continue across a space never
merges over one, so a text's token count is the sum over its space-led pre-tokens.
The operator counts the pieces of every distinct pre-token once, joins those counts to
per-document pre-token frequencies and sums, so no id sequence exists anywhere.

The join has two halves with one result.  Pre-tokens that a small sample shows
to be frequent form a table of at most ``hot_size`` rows, which is broadcast: it takes
the skewed keys and most occurrences.  All other pre-tokens, however many, join by
shuffle, where each document contributes a pre-token at most once.

Defined cases: a null or empty text has 0 bytes and 0 tokens; U+2581 in a text counts as a
space, as in the library; repeated rows and null ids give one result row per input
row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import column, materialize, prepare, slices, texts

_MARK = "▁"
HOT_SIZE = 200_000  #: most rows of the broadcast half
HOT_LENGTH = 64  #: characters of a pre-token in it, at most, so that its size is bounded
HOT_SAMPLE = 12_000  #: documents looked at to choose it; no effect on any count


#: A mark after a letter and before a space or the end, where no piece joins letter and mark.
_LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_MARKS = re.compile(rf"(?<={_LETTER})[.,](?= |\Z)")


class Pieces:
    """Numbers of pieces of pre-tokens; a pre-token is what follows one space mark."""

    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = self.model.get_piece_size()
        if any(_MARK in self.model.id_to_piece(i).lstrip(_MARK) for i in range(size)):
            raise ValueError("the vocabulary has pieces that continue across a space; pre-tokens would not be independent")
        self.lone_space = self._after("a", " ")
        #: pieces of a mark that ends a word; 0 if pieces may join them, so that marks stay with their words
        self.mark = self._after("a", ".")
        joined = re.compile(rf"{_LETTER}[.,]")
        if self._after("a", ",") != self.mark or any(joined.search(self.model.id_to_piece(i)) for i in range(size) if not self.model.is_byte(i)):
            self.mark = 0

    def _after(self, before: str, more: str) -> int:
        return len(self.model.encode(before + more)) - len(self.model.encode(before))

    def split(self, text: str) -> tuple[list[str], int]:
        """A text's pre-tokens, and the pieces of the marks taken off their ends."""
        if not text:
            return [], 0
        text = text.replace(_MARK, " ")
        marks = 0
        if self.mark:
            text, marks = _MARKS.subn("", text)
        return pre_tokens(text), marks * self.mark

    def count(self, units: list[str]) -> list[int]:
        encoded = self.model.encode(units, num_threads=1)
        return [len(ids) if u else self.lone_space for u, ids in zip(units, encoded, strict=True)]


def pre_tokens(text: str) -> list[str]:
    """What follows each space mark of the normalised text; a run of marks stays with its word."""
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, run = [], 0
    for p in parts[:-1]:
        if p:
            out.append(" " * run + p)
            run = 0
        else:
            run += 1
    out.append(" " * run + parts[-1])
    return out


@lru_cache(maxsize=2)
def pieces(model_path: str) -> Pieces:
    return Pieces(model_path)


def count_distinct(units: DataFrame, model_path: str) -> DataFrame:
    """``unit, n``: the number of pieces of each row's pre-token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for b in slices(batches, rows=20_000):
            yield pa.record_batch([b.column(0), pa.array(model.count(column(b, "unit")), pa.int32())], names=["unit", "n"])

    return units.select("unit").mapInArrow(run, "unit string, n int")


def _frequent(docs: DataFrame, model_path: str, sample: int, size: int) -> dict[str, int]:
    """Piece counts of at most ``size`` pre-tokens that repeat within a sample of about ``sample`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for b in slices(batches):
            seen = Counter()
            for t in texts(b):
                seen.update(model.split(t)[0])
            yield pa.record_batch([pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], names=["unit", "f"])

    rows = docs.count()
    if not rows:
        return {}
    some = docs.sample(fraction=min(1.0, sample / rows), seed=17)
    top = some.select("text").mapInArrow(run, "unit string, f long").groupBy("unit").agg(F.sum("f").alias("f"))
    top = top.filter((F.col("f") > 1) & (F.length("unit") <= HOT_LENGTH)).orderBy(F.desc("f"), "unit").limit(size)
    got = count_distinct(top, model_path).toArrow()
    return dict(zip(got["unit"].to_pylist(), got["n"].to_pylist(), strict=True))


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", hot_size: int = HOT_SIZE, hot_sample: int = HOT_SAMPLE
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every text."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hot = spark.sparkContext.broadcast(_frequent(docs, model_path, hot_sample, hot_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = hot.value, pieces(model_path)
        for b in slices(batches):
            base, units, times = [], [], []
            for t in texts(b):
                units_here, total = model.split(t)
                freq = Counter(units_here)
                counts = [*map(known.get, freq)]
                cold, cold_f = [], []
                for u, f, n in zip(freq, freq.values(), counts, strict=True):
                    if n is None:
                        cold.append(u)
                        cold_f.append(f)
                    else:
                        total += n * f
                base.append(total)
                units.append(cold)
                times.append(cold_f)
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(base, pa.int64()), pa.array(units, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                names=["doc_id", "n_bytes", "base", "units", "times"],
            )

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    per_doc = sized.mapInArrow(run, "doc_id long, n_bytes long, base long, units array<string>, times array<int>")
    per_doc = materialize(per_doc.withColumn("row", F.monotonically_increasing_id()), "token-counts")
    rare = per_doc.select("row", F.explode(F.arrays_zip("units", "times")).alias("u")).select("row", F.col("u.units").alias("unit"), F.col("u.times").alias("f"))
    counted = count_distinct(rare.select("unit").distinct(), model_path)
    sums = rare.join(counted, "unit").groupBy("row").agg(F.sum(F.col("f") * F.col("n")).alias("more"))
    joined = per_doc.drop("units", "times").join(sums, "row", "left")
    return joined.select("doc_id", "n_bytes", (F.col("base") + F.coalesce("more", F.lit(0))).cast("long").alias("n_tokens"))
