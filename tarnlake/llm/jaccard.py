"""Operator 1: n-gram Jaccard join by MinHash banding with full verification.

Documents with equal sets of word n-grams form a class; only one row per class is
compared.  ``bands`` x ``rows`` MinHash values are chosen by ``choose_bands`` for a target
recall at the threshold.  Classes are shuffled on their band hashes; bands shared by two
classes or more become buckets; and all pairs within a bucket are verified on their whole
n-gram sets.  A pair that shares several bands is verified in the first only.

A bucket is never expanded into rows per pair.  It is cut into blocks bounded in
classes and in n-grams; a task compares two blocks in numpy and returns one row
per linked class: its number of links and a spanning edge.  So any bucket size works, no
partner is dropped, and what is written grows with the classes.

Connected components of the links give the class id, by rounds of neighbour
minimisation (large star, small star) over tables in the shared folder.

Defined cases: n-grams are ``N`` consecutive words, and a text of fewer words has one n-gram;
texts without words (null, empty) are linked to nothing and are their own class; the
class id is the smallest doc_id among linked documents; rows with equal n-gram sets are
copies whatever their ids, so repeated rows share a class; rows with null id take part, and a
class of null ids only has a null id; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import materialize, maybe_broadcast, prepare, row_key, slices, splitmix, texts
from tarnlake.llm.words import split

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
BLOCK_CLASSES = 1024  #: classes in a block, about
BLOCK_GRAMS = 1_000_000  #: n-grams in a block, about
MAX_BROADCAST = 200_000
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def choose_bands(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most selective (bands, rows) with at most ``most`` hashes whose recall at ``threshold`` is reached."""
    for rows in range(min(most, 32), 1, -1):
        bands = most // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return most, 1


def gram_sets(batch: list[str], n: int = N) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams."""
    w = split(batch)
    out = []
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(w.hashes) - n + 1), dtype=np.uint64)
        for k in range(n):
            whole += w.hashes[k : k + len(whole)] * _MIX[k % 8]
        whole = splitmix(whole)
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(whole[a : b - n + 1]))
            elif b > a:
                out.append(splitmix(np.array([sum(int(h) * int(_MIX[k % 8]) for k, h in enumerate(w.hashes[a:b])) + int(b - a) & (2**64 - 1)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(grams: np.ndarray) -> bytes | None:
    """128 bits that identify a set; none for the empty set."""
    if not len(grams):
        return None
    with np.errstate(over="ignore"):
        return b"".join(np.array([splitmix(grams ^ s).sum() + np.uint64(len(grams))], "<u8").tobytes() for s in (_MIX[0], _MIX[1]))


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240607)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(grams), 4096):
                part = grams[at : at + 4096]
                np.minimum(low, (part[:, None] * self.a[None, :] + self.b[None, :]).min(axis=0), out=low)
            mixed = splitmix(low).reshape(self.bands, self.rows)
            h = np.arange(self.bands, dtype=np.uint64)
            for k in range(self.rows):
                h = splitmix(h ^ mixed[:, k])
        return h


def signatures(docs: DataFrame, bands: int, rows: int, n: int) -> DataFrame:
    """``doc_id, place, set_key, grams, bands``: one row per document; place names its text's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHash(bands, rows)
        for b in slices(batches, chars=500_000):
            sets = gram_sets(texts(b), n)
            sign = [hasher.band_hashes(s).astype(np.int64).tolist() if len(s) else None for s in sets]
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([*map(len, sets)], pa.int32()), pa.array(sign, pa.list_(pa.int64()))],
                names=["doc_id", "place", "set_key", "grams", "bands"],
            )

    return docs.select("doc_id", "place", "text").mapInArrow(run, "doc_id long, place binary, set_key binary, grams int, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``set_key, sets`` of the rows of ``docs`` at the places in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, chars=500_000):
            sets = gram_sets(texts(b), n)
            yield pa.record_batch([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["set_key", "sets"])

    rows = docs.join(maybe_broadcast(wanted, MAX_BROADCAST), "place", "left_semi").select("text")
    return rows.mapInArrow(run, "set_key binary, sets binary").dropDuplicates(["set_key"])


# -- verification of one pair of blocks ---------------------------------------


def verify(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the classes of one block pair: per linked class the documents it links to, and an edge.

    ``block`` has set_key, weight (documents of the class), bands (as signed 64-bit bytes), band, side
    (0: left, 1: right, 2: both, when a block meets itself) and sets.
    """
    side = block["side"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    same = side[0] == 2
    sets = [np.frombuffer(s, "<u8") for s in block["sets"]]
    size = np.array([len(s) for s in sets], dtype=np.int32)
    sign = np.stack([np.frombuffer(s, "<i8") for s in block["bands"]])
    band = int(block["band"].iloc[0])
    todo = np.ones((len(left), len(right)), dtype=bool)
    if same:
        todo = np.triu(todo, 1)
    for i in range(0, len(left), 128):  # length bound, in strips that bound memory
        a, b = size[left[i : i + 128], None], size[right][None, :]
        todo[i : i + 128] &= np.minimum(a, b) >= threshold * np.maximum(a, b)
    for k in range(band):  # verified in an earlier band
        todo &= sign[left, k][:, None] != sign[right, k][None, :]
    pairs = np.argwhere(todo)
    if not len(pairs):
        return _links([], [], [])
    if len(pairs) <= 4 * len(block):
        common = np.array([len(np.intersect1d(sets[left[i]], sets[right[j]], assume_unique=True)) for i, j in pairs], dtype=np.int64)
    else:
        common = _overlaps([sets[i] for i in left], [sets[j] for j in right])[pairs[:, 0], pairs[:, 1]]
    a, b = left[pairs[:, 0]], right[pairs[:, 1]]
    total = size[a].astype(np.int64) + size[b] - common
    # exact comparison of common / total with the threshold, in thousandths
    linked = common * 1000 >= round(threshold * 1000) * total
    a, b = a[linked], b[linked]
    weight = block["weight"].to_numpy()
    links = np.bincount(a, weights=weight[b], minlength=len(block)) + np.bincount(b, weights=weight[a], minlength=len(block))
    root = np.arange(len(block))
    while True:  # smallest linked row, by rounds of hooking and pointer jumping
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    touched = np.flatnonzero(links > 0)
    keys = block["set_key"].to_numpy()
    return _links(keys[touched], keys[root[touched]], links[touched].astype(np.int64))


def _links(keys, roots, links) -> pd.DataFrame:
    return pd.DataFrame({"set_key": list(keys), "root": list(roots), "links": np.asarray(links, dtype=np.int64)})


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over slices of the shared n-grams."""
    lv, rv = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(np.unique(lv), np.unique(rv), assume_unique=True)
    lo, ro = (np.repeat(np.arange(len(s), dtype=np.int32), [*map(len, s)]) for s in (left, right))

    def coordinates(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, values).astype(np.int32)
        ok = at < len(shared)
        ok[ok] = shared[at[ok]] == values[ok]
        at, owner = at[ok], owner[ok]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (lc, lo), (rc, ro) = coordinates(lv, lo), coordinates(rv, ro)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    del lv, rv
    step = 1024
    for base in range(0, len(shared), step):
        parts = []
        for c, o, n in ((lc, lo, len(left)), (rc, ro, len(right))):
            s, e = np.searchsorted(c, [base, base + step])
            m = np.zeros((n, step), dtype=np.float32)
            m[o[s:e], c[s:e] - base] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int32)


# -- the join -----------------------------------------------------------------


def links_of(docs: DataFrame, classes: DataFrame, threshold: float, n: int) -> DataFrame:
    """``set_key, root, links``: verified links between classes, a row per class and block pair."""
    spread = classes.select("set_key", F.posexplode("bands").alias("band", "hash"))
    buckets = spread.groupBy("band", "hash").agg(F.count("*").alias("classes")).filter("classes > 1")
    members = spread.join(buckets, ["band", "hash"]).select("set_key", "band", "hash", "classes")
    members = members.join(classes.select("set_key", "grams", "weight", "bands"), "set_key")
    members = materialize(members, "band-members")
    # A bucket whose classes all share an earlier band holds no pair of its own.
    # Its blocks hold about BLOCK_CLASSES classes and BLOCK_GRAMS n-grams.
    width = len(classes.select("bands").first()["bands"]) if not classes.isEmpty() else 0
    ends = [f(F.col("bands")[k]).alias(f"{name}{k}") for k in range(width) for name, f in (("low", F.min), ("high", F.max))]
    shared_before = F.lit(False)
    for k in range(width):
        shared_before = shared_before | ((F.col("band") > k) & (F.col(f"low{k}") == F.col(f"high{k}")))
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK_CLASSES), F.ceil(F.col("total") / BLOCK_GRAMS)).cast("int")
    plan = members.groupBy("band", "hash").agg(F.count("*").alias("classes"), F.sum("grams").alias("total"), *ends).filter(~shared_before)
    plan = plan.select("band", "hash", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("set_key", "band"), F.col("blocks")).cast("int")
    placed = members.drop("classes").join(plan, ["band", "hash"]).withColumn("own", own)
    placed = materialize(placed, "band-blocks")
    sets = sets_of(docs, placed.select("set_key").distinct().join(classes.select("set_key", "place"), "set_key").select("place"), n)
    packed = F.col("bands")
    facing = placed.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    facing = facing.select(
        "band", "hash", F.least("own", "facing").alias("i"), F.greatest("own", "facing").alias("j"),
        F.when(F.col("own") == F.col("facing"), 2).when(F.col("own") < F.col("facing"), 0).otherwise(1).alias("side"),
        "set_key", "weight", packed.alias("bands"),
    )
    rows = facing.join(sets, "set_key")
    # a block meets itself alone, and two blocks meet as left and right
    schema = "set_key binary, root binary, links long"

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("set_key", ignore_index=True)
        block["bands"] = [np.asarray(x, "<i8").tobytes() for x in block["bands"]]
        return verify(block, threshold)

    met = rows.groupBy("band", "hash", "i", "j").applyInPandas(compare, schema)
    return materialize(met, "links")


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, root``: the smallest node of each connected component, for every node that has an edge.

    Alternating large-star and small-star rounds over ``a, b`` edges; a round costs two
    shuffles of the edges, whose number never grows, and the number of rounds is
    logarithmic.  Each node's least neighbour is written first, so that the join with the
    edges has plain exchanges, whose skewed partitions (the hub of a large component) are split.
    """
    edges = materialize(_oriented(edges), purpose)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), purpose)
        star = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(_oriented(star), purpose)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), purpose)
        rest = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(_oriented(rest.unionByName(low.select("a", F.col("m").alias("b")))), purpose)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = N, recall: float = RECALL) -> DataFrame:
    """``doc_id, place, group, class_id, n_links, n_copies`` of every document.

    place: 128 bits that name the content of (doc_id, text); group: the group's key, null
    without words; class_id: the smallest doc_id linked to it directly or by others; n_links: the
    other documents of at least the threshold's similarity; n_copies: those with the same n-gram set.
    """
    prepare(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("place", row_key(F.col("doc_id"), F.col("text")))
    signed = materialize(signatures(docs, bands, rows, n), "signatures")
    known = signed.filter("set_key is not null")
    classes = known.groupBy("set_key").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.min_by(F.struct("place", "grams", "bands"), "place").alias("one"))
    classes = materialize(classes.select("set_key", "weight", "least", "one.place", "one.grams", "one.bands"), "classes")
    links = links_of(docs, classes, threshold, n)
    found = components(links.select(F.col("set_key").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("set_key").agg(F.sum("links").alias("links"))
    rooted = classes.select("set_key", "weight", "least").join(found.withColumnRenamed("node", "set_key"), "set_key", "left")
    rooted = materialize(rooted.join(counted, "set_key", "left").withColumn("group", F.coalesce("root", "set_key")), "rooted")
    least = materialize(rooted.groupBy("group").agg(F.min("least").alias("class_id")), "least")  # so that a large group's partition can be split
    links_here = (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    per_class = rooted.join(least, "group").select("set_key", "group", "class_id", (F.col("weight") - 1).alias("n_copies"), links_here)
    per_class = materialize(per_class, "per-class")
    joined = known.select("doc_id", "place", "set_key").join(per_class, "set_key").select("doc_id", "place", "group", "class_id", "n_links", "n_copies")
    none = F.lit(0).cast("long")  # texts without words stand aside, else they would meet in one task under a null key
    alone = signed.filter("set_key is null").select("doc_id", "place", F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_copies"))
    return joined.unionByName(alone)


def jaccard_classes(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, class_id, n_links, n_copies`` of every document; see ``groups``."""
    return groups(docs, **how).drop("place", "group")


#: DuckDB: exact n-gram sets, all links, and components by repeated neighbour minima.
ORACLE_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT rid, array_to_string(ws[s + 1 : s + 5], ' ') AS g FROM (SELECT rid, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS s FROM dw WHERE len(ws) > 0)
), cls AS (SELECT rid, count(*) AS n, list_sort(list(g)) AS gs FROM sh GROUP BY rid),
rep AS (SELECT gs, min(rid) AS rep, count(*) AS weight FROM cls GROUP BY gs),
of_rep AS (SELECT cls.rid, rep.rep, cls.n, rep.weight FROM cls JOIN rep USING (gs)),
one AS (SELECT rid, n, weight FROM of_rep WHERE rid = rep),
g1 AS (SELECT sh.rid, g FROM sh JOIN one USING (rid)),
co AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM g1 a JOIN g1 b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
link AS (SELECT a, b, y.weight FROM co JOIN one x ON x.rid = a JOIN one y ON y.rid = b WHERE c * 10 >= 8 * (x.n + y.n - c)),
reach AS (SELECT rid AS v, rid AS u FROM one UNION SELECT reach.v, link.b FROM reach JOIN link ON link.a = reach.u),
root AS (SELECT v, min(u) AS root FROM reach GROUP BY v),
cid AS (SELECT r.root, min(d.doc_id) AS class_id FROM of_rep o JOIN root r ON r.v = o.rep JOIN dw d ON d.rid = o.rid GROUP BY r.root),
deg AS (SELECT a, sum(weight) AS links FROM link GROUP BY a)
SELECT d.doc_id, coalesce(cid.class_id, d.doc_id) AS class_id, CAST(coalesce(o.weight - 1, 0) + coalesce(deg.links, 0) AS BIGINT) AS n_links,
  CAST(coalesce(o.weight - 1, 0) AS BIGINT) AS n_copies
FROM dw d LEFT JOIN of_rep o ON o.rid = d.rid LEFT JOIN root r ON r.v = o.rep LEFT JOIN cid ON cid.root = r.root LEFT JOIN deg ON deg.a = o.rep
"""
