"""Operator 2 [native]: benchmark decontamination as a prefix-filtered set join.

Words are maximal runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the text with A-Z
lower-cased.  A window is ``WINDOW`` consecutive item words (an item of fewer words is one
window); as a set it holds its shingles (``SHINGLE`` words).  Everything runs in DataFrame
functions:

1. One scan of the documents counts the items' shingles over the corpus, by their hashes
   (equal hashes of different shingles would only blur the order).  The counts order
   shingles by rarity.
2. Containment is exact, so the necessary prefix of a window is its rarest shingle; windows
   with a shingle that no document has are out.  Neighbouring windows of an item with
   the same prefix form a span, equal spans of several items one row.
3. A second scan joins the documents' shingles with the prefix shingles only.  A
   candidate (place, span) stays if a window of the span fits into the document there:
   the bounds on length and position.
4. A candidate is verified word by word over the span, which has less than two
   windows' words.  Runs of equal words as long as a window are exactly its occurrences.

The item side is broadcast only if counted to be small, in rows and bytes.  Beyond that the
same joins shuffle: counts are aggregated before the shuffle, and a place carries no more than the
``2 * WINDOW`` words around it.

Defined cases: a null text has no words, and null or wordless items no windows; items
without id are ignored; repeated item rows count once, and an id with two texts owns the windows of
both; repeated documents and null doc_ids give one row per input row; other columns are
ignored, whatever their names; without documents the result is empty, without items
nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.shared import fits_broadcast, materialize, maybe_broadcast

WINDOW = 13
SHINGLE = 3
MAX_BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as an array, cut out by what stands between them: ``regexp_extract_all`` copies the text for every match."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), "")


def _shingle_key(array: str, at: Column, q: int) -> Column:
    """Hash of the ``q`` words from place ``at``; null where the array ends before."""
    return F.when(at + q <= F.size(array), F.xxhash64(F.lit(q), *[F.get(array, at + k) for k in range(q)]))


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(" ", *parts)))


def item_texts(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """``tid, words, n, m, q`` of every different item text (m words a window, q a shingle), and ``tid, item_id``."""
    split = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    split = materialize(split.withColumn("tid", _digest(F.col("words"))), "item-words")
    size = F.size("words")
    texts = split.groupBy("tid").agg(F.first("words").alias("words"))
    texts = texts.select("tid", "words", size.alias("n"), F.least(F.lit(window), size).alias("m"), F.least(F.lit(shingle), size).alias("q"))
    return materialize(texts, "item-texts"), split.select("tid", "item_id").distinct()


def item_shingles(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """``tid, n, m, q, ipos, key`` of every shingle of every text."""
    every = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("q"))).alias("ipos"))
    key = F.coalesce(*[F.when(F.col("q") == q, _shingle_key("words", F.col("ipos"), q)) for q in lengths], F.lit(None).cast("long"))
    return every.select("tid", "n", "m", "q", "ipos", key.alias("key"))


def document_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """``row, doc_id, words, pos, key``: every place and length of every document, and one row with null pos of a wordless one."""
    doc = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("words"))
    at = doc.select("row", "doc_id", "words", F.posexplode_outer("words").alias("pos", "word"))
    keys = [_shingle_key("words", F.col("pos"), q) for q in lengths]
    key = keys[0] if len(keys) == 1 else F.explode(F.array(*keys)) if keys else F.lit(None).cast("long")
    return at.select("row", "doc_id", "words", "pos", key.alias("key"))


def shingle_counts(docs: DataFrame, keys: DataFrame, lengths: list[int]) -> DataFrame:
    """``key, df``: how often each of the items' shingles occurs in the corpus."""
    at = document_shingles(docs, lengths).select("key").filter("key is not null")
    if fits_broadcast(keys, MAX_BROADCAST):
        return at.join(F.broadcast(keys), "key", "left_semi").groupBy("key").agg(F.count("*").alias("df"))
    return at.groupBy("key").agg(F.count("*").alias("df")).join(keys, "key", "left_semi")


def prefix_spans(texts: DataFrame, shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, sid, tid, span, m, at``: per prefix shingle the words of the windows that it stands for, and its place in them."""
    ranked = shingles.join(maybe_broadcast(counts, MAX_BROADCAST), "key", "left")
    last = F.col("n") - F.col("m")  # start of the last window
    first_start, last_start = F.greatest(F.lit(0), F.col("ipos") + F.col("q") - F.col("m")), F.least(F.col("ipos"), last)
    starts = ranked.select("tid", "m", "q", "df", "key", "ipos", F.explode(F.sequence(first_start, last_start)).alias("start"))
    windows = starts.groupBy("tid", "start", "m", "q").agg(F.count("df").alias("present"), F.min(F.struct("df", "key", "ipos")).alias("rarest"))
    windows = windows.filter(F.col("present") == F.col("m") - F.col("q") + 1)
    spans = windows.groupBy("tid", "m", "rarest.key", "rarest.ipos").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    spans = spans.join(texts.select("tid", "words"), "tid")
    span = F.slice("words", F.col("low") + 1, F.col("high") - F.col("low") + F.col("m"))
    spans = spans.select("key", "tid", span.alias("span"), "m", (F.col("ipos") - F.col("low")).alias("at"))
    return spans.withColumn("sid", _digest(F.col("at").cast("string"), F.col("m").cast("string"), F.col("span")))


def candidates(docs: DataFrame, spans: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """``row, doc_id, n_words, pos, sid, low, high, occurs``: the join on prefix shingles, and the verified word range of each candidate.

    Every document's place 0 (or null, without words) is there too, with a null sid if nothing begins at it.
    """
    at = document_shingles(docs, lengths).withColumn("n_words", F.size("words"))
    if fits_broadcast(spans, MAX_BROADCAST):
        near, spans = at.withColumnsRenamed({"words": "near"}).withColumn("near_pos", F.col("pos")), F.broadcast(spans)
    else:
        around = F.slice("words", F.greatest(F.lit(0), F.col("pos") - window) + 1, F.lit(2 * window))
        near = at.withColumn("near", around).withColumn("near_pos", F.least(F.col("pos"), F.lit(window))).drop("words")
    joined = near.join(spans, "key", "left").withColumn("offset", F.col("pos") - F.col("at"))
    fits = (F.col("offset") + F.size("span") - F.col("m") >= 0) & (F.col("offset") + F.col("m") <= F.col("n_words"))
    joined = joined.withColumn("sid", F.when(fits, F.col("sid"))).filter(F.col("sid").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    begin = F.col("near_pos") - F.col("at")
    equal = F.transform(F.sequence(F.lit(0), F.size("span") - 1), lambda i: F.coalesce(F.get("near", begin + i) == F.get("span", i), F.lit(False)))
    joined = joined.withColumn("equal", F.when(F.col("sid").isNotNull(), equal))
    # the run of equal words around the prefix shingle, from its nearest differences on either side
    before = F.array_position(F.reverse(F.slice("equal", F.lit(1), F.col("at"))), False)
    after = F.array_position(F.slice("equal", F.col("at") + 1, F.size("equal")), False)
    low = F.when(before > 0, F.col("at") - before + 1).otherwise(F.lit(0))
    high = F.when(after > 0, F.col("at") + after - 1).otherwise(F.size("equal"))
    ranged = joined.withColumn("from", low.cast("int")).withColumn("to", high.cast("int"))
    occurs = F.col("sid").isNotNull() & (F.col("to") - F.col("from") >= F.col("m"))
    return ranged.select("row", "doc_id", "n_words", "pos", "sid", (F.col("offset") + F.col("from")).alias("low"), (F.col("offset") + F.col("to")).alias("high"), occurs.alias("occurs"))


def _covered(ranges: Column) -> Column:
    """Number of places in the union of sorted [low, high) ranges."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("int").alias("upto"))

    def step(acc: Column, r: Column) -> Column:
        more = F.greatest(F.lit(0), r["high"] - F.greatest(r["low"], acc["upto"]))
        return F.struct((acc["total"] + more).cast("long").alias("total"), F.greatest(acc["upto"], r["high"]).cast("int").alias("upto"))

    return F.aggregate(ranges, start, step, lambda acc: acc["total"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document, and ``items``, the ids."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts, owners = item_texts(items.select("item_id", F.col("text").cast("string").alias("text")), window, shingle)
    lengths = sorted(r["q"] for r in texts.select("q").distinct().collect())  # 1 to ``shingle``
    shingles = materialize(item_shingles(texts, lengths), "item-shingles")
    keys = materialize(shingles.select("key").distinct(), "item-keys")
    counts = materialize(shingle_counts(docs, keys, lengths), "shingle-counts")
    spans = materialize(prefix_spans(texts, shingles, counts), "spans")
    distinct = materialize(spans.select("key", "sid", "span", "m", "at").dropDuplicates(["sid"]), "distinct-spans")
    found = materialize(candidates(docs, distinct, lengths, window), "candidates")
    hits = found.filter("occurs")
    ranges = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))).alias("ranges"))
    ranges = ranges.select("row", _covered(F.col("ranges")).alias("n_hit"))
    owned = spans.select("sid", "tid").join(owners, "tid").select("sid", F.col("item_id").cast("string").alias("item_id")).distinct()
    owned = maybe_broadcast(materialize(owned, "span-owners"), MAX_BROADCAST)
    items_of = hits.select("row", "sid").distinct().join(owned, "sid").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    base = found.filter("pos is null or pos = 0").select("row", "doc_id", F.col("n_words").cast("long").alias("n_words")).dropDuplicates(["row"])
    out = base.join(ranges, "row", "left").join(items_of, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "items",
    )


#: DuckDB: every window of an item against every stretch of a document of that length.
ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), iw AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT item_id, least(13, len(ws)) AS n, array_to_string(ws[s + 1 : s + least(13, len(ws))], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(0, greatest(1, len(ws) - 12))) AS s FROM iw WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM win), doc AS (
  SELECT rid, s, n, array_to_string(ws[s + 1 : s + n], ' ') AS w
  FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM dw, sizes WHERE len(ws) >= n)
), hit AS (SELECT DISTINCT rid, s, doc.n, item_id FROM doc JOIN win ON doc.w = win.w AND doc.n = win.n),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
