"""Operator 8: URL filters: rules first, gradient-boosted trees on lexical features for the rest.

Rules are (host, path) pairs; the longest that fits decides.  URLs that no rule fits
are judged by logistic gradient boosting over lexical features: lengths, depth, digit
ratio, character entropy, numbers of labels, parameters and marks, all computed as columns, and
smoothed block rates of suffixes: the host's last one and two labels and the first path segment.

The labelled URLs are those that a rule decides, at most ``MAX_TRAINING`` different ones, those of
the smallest hashes.  The rates that a labelled URL is trained with come from the other of
``FOLDS`` folds of hosts.  Every URL is also learnt with its suffixes withheld, as if never seen, since the
trees would else only learn the rules back from their own hosts and segments and know nothing of
hosts that no rule names.  Scores are calibrated (Platt) on predictions for hosts kept apart, for
URLs with and without a known suffix on their own.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is
judged from empty features; without labelled URLs, or with one label only, every URL gets
that label (allow when there is none); repeated rows and null ids give one row each; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.languages import training_sample
from tarnlake.llm.shared import prepare

#: Fixed values: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MAX_TRAINING = 20_000  #: labelled URLs that the trees are fitted on, at most
FOLDS = 4  #: folds of hosts for the calibration
PRIOR_WEIGHT = 5  #: labelled URLs that the overall rate counts for in a suffix's rate


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as columns."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(F.regexp_extract(path, r"^([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


# -- features -----------------------------------------------------------------

_MARKS = "-_.=%~"


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers of a URL by name."""
    n = F.length(url)

    def count(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.translate(text, mark, ""))

    letters = F.array_distinct(F.split(url, ""))  # counts of each different character, for the entropy
    shares = F.transform(letters, lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    out = {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "labels": F.when(host == "", 0).otherwise(count(host, ".") + 1),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": count(url, "0123456789") / F.greatest(n, F.lit(1)),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "query_length": F.length(query),
        "fragment": F.contains(url, F.lit("#")),
        "extension": F.contains(F.substring_index(path, "/", -1), F.lit(".")),
        "folder": F.endswith(path, F.lit("/")),
    }
    out |= {f"mark_{i}": count(url, m) for i, m in enumerate(_MARKS)}
    return {k: v.cast("double") for k, v in out.items()}


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Keys of the suffix rates by name."""
    return {
        "suffix_1": F.substring_index(host, ".", -1),
        "suffix_2": F.substring_index(host, ".", -2),
        "segment": F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("")),
    }


class SuffixRates:
    """Smoothed block rates of the values of one key, and how often each was seen."""

    def __init__(self, values: Sequence[str], block: np.ndarray, base: float):
        total, bad = Counter(values), Counter(v for v, y in zip(values, block, strict=True) if y)
        self.values = pa.array([*total], pa.string())
        seen = np.array([*total.values()], dtype=float)
        hits = np.array([bad[v] for v in total], dtype=float)
        # the last entry stands for values never seen
        self.rates = np.append((hits + PRIOR_WEIGHT * base) / (seen + PRIOR_WEIGHT), base)
        self.seen = np.append(np.log1p(seen), 0.0)

    def __call__(self, values: pa.Array) -> np.ndarray:
        """Rate and logarithm of the number of each value, as two columns."""
        at = pc.fill_null(pc.index_in(values, value_set=self.values), len(self.values)).to_numpy(zero_copy_only=False)
        return np.stack([self.rates[at], self.seen[at]], axis=1)

    def withheld(self, n: int) -> np.ndarray:
        return np.tile([self.rates[-1], 0.0], (n, 1))


@dataclass
class Trees:
    """Boosted trees; every tree is arrays of feature, threshold and value over a complete binary tree."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    prior: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, block: np.ndarray) -> Trees:
        """Train on rows of features with block = 1 or 0."""
        share = float(block.mean()) if len(block) else 0.0
        if share in (0.0, 1.0):
            self.prior = 20.0 if share else -20.0
            return self
        y = block.astype(float)
        self.prior = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        score = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(tree := self._grow(bins, cuts, y - p, p * (1 - p)))
            score += self.rate * self._run(tree, x)
        return self

    def _grow(self, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.ones(len(g), dtype=np.int64)
        for at in range(1, size):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[at] = gs / (hs + 1.0)
            if at >= size // 2:
                continue
            best = (1e-6, -1, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(bins[own, f], weights=g[own], minlength=len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[own, f], weights=h[own], minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
            if best[1] >= 0:
                feature[at], threshold[at] = best[1], cuts[best[1]][best[2]]
                node[own] = 2 * at + (bins[own, best[1]] > best[2])
        return feature, threshold, value

    def _run(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, threshold, value = tree
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            f = feature[node]
            go = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[node]
            node = np.where(go, 2 * node + right, node)
        return value[node]

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for t in self.trees if len(x) else ():
            total += self.rate * self._run(t, x)
        return total


def platt(logit: np.ndarray, block: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic calibration: Newton steps on the smoothed log loss, halved while it grows."""
    good, bad = (block == 0).sum(), (block == 1).sum()
    want = np.where(block == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    x = np.stack([logit, np.ones(len(logit))])

    def loss(w: np.ndarray) -> float:
        z = w @ x
        return float((np.logaddexp(0, z) - want * z).sum())

    w = np.array([0.0, math.log((bad + 1) / (good + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (want - p))
        while loss(w + step) > loss(w) + 1e-9 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    if w[0] < 0:  # hosts kept apart are predicted worse than by the overall rate
        return 0.0, math.log((bad + 1) / (good + 1))
    return float(w[0]), float(w[1])


class UrlModel:
    """Suffix rates, trees and calibration."""

    def __init__(self):
        self.trees, self.rates = Trees(), []
        self.calibration = [(1.0, 0.0), (1.0, 0.0)]  #: without and with a known suffix

    def fit(self, x: np.ndarray, keys: list[list[str]], hosts: list[str], block: np.ndarray) -> UrlModel:
        """``x``: lexical features; ``keys``: for each suffix key its values; all by labelled URL."""
        if not len(block) or block.min() == block.max():
            self.trees.fit(x, block)
            return self
        keys = [np.array(k, dtype=object) for k in keys]
        fold = np.array([xxhash.xxh64_intdigest(h) % FOLDS for h in hosts])
        apart = np.full((2, len(block)), np.nan)
        for f in range(FOLDS):
            rest, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(own) and len(rest):
                trees, rates = _fitted(x, keys, fold, block, rest)
                for known, parts in enumerate((_withheld(rates, own), _rated(rates, keys, own))):
                    apart[known, own] = trees.logits(np.column_stack([x[own], *parts]))
        judged = ~np.isnan(apart[0])
        if judged.any() and block[judged].min() < block[judged].max():
            self.calibration = [platt(z[judged], block[judged]) for z in apart]
        self.trees, self.rates = _fitted(x, keys, fold, block, np.arange(len(block)))
        return self

    def scores(self, x: np.ndarray, keys: list[pa.Array]) -> np.ndarray:
        """Probability of block of URLs that no rule fits."""
        parts = [r(k) for r, k in zip(self.rates, keys, strict=True)] if self.rates else []
        logit = self.trees.logits(np.column_stack([x, *parts]))
        known = np.any([p[:, 1] > 0 for p in parts], axis=0).astype(int) if parts else np.zeros(len(x), int)
        slope, offset = np.array(self.calibration)[known].T
        return 1 / (1 + np.exp(-np.clip(slope * logit + offset, -30, 30)))


def _rated(rates: list[SuffixRates], keys: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    return [r(pa.array(k[at], pa.string())) for r, k in zip(rates, keys, strict=True)]


def _withheld(rates: list[SuffixRates], at: np.ndarray) -> list[np.ndarray]:
    return [r.withheld(len(at)) for r in rates]


def _fitted(x: np.ndarray, keys: list[np.ndarray], fold: np.ndarray, block: np.ndarray, at: np.ndarray) -> tuple[Trees, list[SuffixRates]]:
    """Trees learnt from the rows ``at``, each with rates from the other folds and with none; and the rates of all of them."""
    base = float(block[at].mean())
    parts = [np.zeros((len(at), 2)) for _ in keys]
    for g in np.unique(fold[at]):
        rest, own = at[fold[at] != g], np.flatnonzero(fold[at] == g)
        for part, k in zip(parts, keys, strict=True):
            part[own] = SuffixRates(k[rest], block[rest], base)(pa.array(k[at[own]], pa.string()))
    rates = [SuffixRates(k[at], block[at], base) for k in keys]
    both = np.concatenate([np.column_stack([x[at], *parts]), np.column_stack([x[at], *_withheld(rates, at)])])
    return Trees().fit(both, np.tile(block[at], 2)), rates


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING) -> UrlModel:
    """Fit on ``url, host, verdict`` rows with features and keys, at most ``max_rows`` different URLs of the smallest hashes."""
    names = [c for c in labelled.columns if c.startswith("x_")]
    keys = [c for c in labelled.columns if c.startswith("k_")]
    got = training_sample(labelled.select(F.col("url").alias("text"), F.lit(0).alias("label"), "host", "verdict", *names, *keys), max_rows)
    x = np.array([[r[c] for c in names] for r in got]).reshape(len(got), len(names))
    return UrlModel().fit(x, [[r[k] for r in got] for k in keys], [r["host"] for r in got], np.array([r["verdict"] == "block" for r in got], dtype=float))


def featured(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every URL (the last two null where no rule fits), numbers ``x_*`` and suffix keys ``k_*``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    host, path = host_path(F.col("url"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": verdict})
    own = (F.col("url"), F.col("host"), F.col("path"))
    return rows.withColumns({f"x_{k}": v for k, v in lexical(*own).items()} | {f"k_{k}": v for k, v in suffixes(*own[1:]).items()})


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every URL; score is the probability of block (1 or 0 where a rule decides)."""
    spark = pages.sparkSession
    prepare(spark)
    rows = featured(pages, rules, id_col, url_col)
    model = spark.sparkContext.broadcast(train(rows.filter("verdict is not null")))
    shown = ["page_id", "host", "path", "rule", "verdict"]
    names, keys = ([c for c in rows.columns if c.startswith(p)] for p in ("x_", "k_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column("verdict")
            score = pc.equal(said, "block").cast(pa.float64()).to_numpy(zero_copy_only=False).copy()
            rest = b.filter(pc.is_null(said))  # the trees are asked about these only
            if rest.num_rows:
                x = np.column_stack([rest.column(c).to_numpy(zero_copy_only=False) for c in names])
                score[np.isnan(score)] = model.value.scores(x, [rest.column(c) for c in keys])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in shown], pa.array(score, pa.float64())], names=[*shown, "score"])

    empty = F.lit(None)  # a URL that a rule decides needs no features
    needed = rows.select(*shown, *[F.when(F.col("verdict").isNull(), F.col(c)).otherwise(empty).alias(c) for c in [*names, *keys]])
    scored = needed.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
    decided = F.coalesce("verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", decided.alias("verdict"), "score")
