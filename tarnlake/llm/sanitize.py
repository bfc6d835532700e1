"""Operator 4: personal data by patterns, and terms that disclose it by corpus co-occurrence.

Base spans are emails, IP addresses, payment cards and phone numbers.  Every base
span's value is a protected entity e.  Over the whole corpus the operator estimates how
strongly a term t near e reveals it:

    disclosure(t, e) = PMI(t, e) / IC(e) = log2(n_te * N / (n_t * n_e)) / -log2(n_e / N)

with N distinct texts, of which n_t hold t, n_e hold e and n_te hold both, however far
apart, so that copies of a page count once in all four.  1 means that t determines e.
Evidence is counted in distinct contexts of e (its surroundings of ``REACH`` characters;
equal ones, as in near copies, are no further evidence): a text gives those with t in
them, or one if t stands farther off.  With at least ``SUPPORT`` of them, terms from
``REMOVE`` on are removed and terms from ``GENERALISE`` on generalised, wherever they stand
in a text that holds the entity.  Texts are searched whole.

Defined cases: a null text is the empty text without spans; repeated rows and null ids give
one row each; overlapping spans are all reported, and redaction replaces their union once;
other columns are kept by ``redact`` and ignored by ``find``; an empty table gives an
empty table.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.shared import column, materialize, maybe_broadcast, prepare, row_key, slices, texts

KINDS = ["email", "ip", "card", "phone"]
TERM_KINDS = ["term_generalised", "term_removed"]
SUPPORT = 3
GENERALISE = 0.7
REMOVE = 0.9
REACH = 120
MAX_BROADCAST = 200_000
MAX_COPIED = 1_000_000  #: hashes of copied texts that are broadcast, at most

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match cannot begin inside a run of digits whose beginning it could take, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"\p{L}{2,}")
_LONG_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping emails, found from each ``@`` outwards (so in linear time)."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_TAIL.match(text, at)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            end = at + 1
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind as in KINDS, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_LONG_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def term_places(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All terms of the text outside of the spans, with their places."""
    union: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if union and s <= union[-1][1]:
            union[-1][1] = max(union[-1][1], e)
        else:
            union.append([s, e])
    out, k = [], 0
    for m in _TERM.finditer(text):
        while k < len(union) and union[k][1] <= m.start():
            k += 1
        if k == len(union) or m.end() <= union[k][0]:
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def contexts(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[str, int, int]]) -> list[dict]:
    """The different entities, each with the hashes of its different contexts and the different terms in them."""
    starts, ends = [s for _, s, _ in terms], [e for _, _, e in terms]
    found: dict[str, dict[int, list[str]]] = {}
    for kind, start, end in spans:
        low, high = max(0, start - REACH), min(len(text), end + REACH)
        close = terms[bisect_left(starts, low) : bisect_right(ends, high)]
        value = text[start:end].lower() if kind == "email" else re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", text[start:end])
        near = text[low:high].encode("utf-8", "surrogatepass")
        context = int(np.uint64(xxhash.xxh64_intdigest(near)).astype(np.int64))
        found.setdefault(f"{kind}:{value}", {})[context] = sorted({t for t, _, _ in close})
    return [{"entity": e, "contexts": [{"context": c, "close": close} for c, close in own.items()]} for e, own in found.items()]


def grouped(terms: list[tuple[str, int, int]]) -> list[dict]:
    """The different terms, each with all its places."""
    places: dict[str, list[dict]] = {}
    for t, s, e in terms:
        places.setdefault(t, []).append({"start": s, "end": e})
    return [{"term": t, "places": own} for t, own in places.items()]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_NEAR = pa.struct([("entity", pa.string()), ("contexts", pa.list_(pa.struct([("context", pa.int64()), ("close", pa.list_(pa.string()))])))])
_PLACED = pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """``key, page, doc_id, base, near, terms`` of every row: base spans, and if there are any their contexts and all terms of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            base, near, placed = [], [], []
            for t in texts(b):
                spans = base_spans(t)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                terms = term_places(t, spans) if spans else []
                near.append(contexts(t, spans, terms))
                placed.append(grouped(terms))
            yield pa.record_batch([*b.columns[:3], pa.array(base, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR)), pa.array(placed, pa.list_(_PLACED))], names=["key", "page", "doc_id", "base", "near", "terms"])

    ddl = f"key binary, page binary, doc_id long, base {_SPANS_DDL}, near array<struct<entity:string,contexts:array<struct<context:bigint,close:array<string>>>>>, "
    ddl += "terms array<struct<term:string,places:array<struct<start:bigint,end:bigint>>>>"
    return docs.select("key", "page", "doc_id", "text").mapInArrow(run, ddl)


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``entity, term, disclosure`` of terms from ``generalise`` on; counts cover all distinct texts of ``docs``."""
    near = found.filter(F.size("near") > 0).select("page", "near", F.transform("terms", lambda t: t["term"]).alias("terms"))
    near = materialize(near.dropDuplicates(["page"]), "near-pages")  # copies of a text count once
    near = near.select("page", F.explode("near").alias("n"), "terms").select("page", "n.entity", "n.contexts", "terms")
    entities = near.select("page", "entity", F.explode("contexts.context").alias("context")).groupBy("entity")
    entities = entities.agg(F.countDistinct("page").alias("n_e"), F.countDistinct("context").alias("contexts"))
    # a term has at most the contexts of its entity, so entities without the support have no such term
    entities = materialize(entities.filter(F.col("contexts") >= support).select("entity", "n_e"), "entities")
    near = near.join(maybe_broadcast(entities.select("entity"), MAX_BROADCAST), "entity", "left_semi")
    none, one, zero = F.lit(None).cast("long"), F.lit(1), F.lit(0)

    def row(term: Column, context: Column, held: Column) -> Column:
        return F.struct(term.alias("term"), context.alias("context"), held.alias("held"))

    every = F.transform("terms", lambda t: row(t, none, one))  # counts the text
    close = F.flatten(F.transform("contexts", lambda c: F.transform(c["close"], lambda t: row(t, c["context"], zero))))
    far = F.transform(F.array_except("terms", F.flatten("contexts.close")), lambda t: row(t, F.array_min("contexts.context"), zero))
    rows = near.select("entity", F.explode(F.concat(every, close, far)).alias("r")).select("entity", "r.*")
    pairs = rows.groupBy("entity", "term", "context").agg(F.sum("held").alias("held"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("held").alias("n_te"), F.count("context").alias("contexts"))
    pairs = materialize(pairs.filter(F.col("contexts") >= support), "term-pairs")
    terms = maybe_broadcast(pairs.select("term").distinct(), MAX_BROADCAST)
    pages = materialize(docs.groupBy("page").agg(F.count("*").alias("copies")), "pages")
    # rows of a text that stands c times weigh 1/c, so that no text has to be shuffled to count it once
    weighed = docs.join(maybe_broadcast(pages.filter("copies > 1"), MAX_COPIED), "page", "left").withColumn("weight", 1 / F.coalesce("copies", F.lit(1)))
    words = weighed.select("weight", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda t: F.length(t) > 1))).alias("term"))
    if pairs.isEmpty():  # nothing has the support, so nothing needs counting
        words = words.limit(0)
    n_t = words.join(terms, "term", "left_semi").groupBy("term").agg(F.round(F.sum("weight")).alias("n_t"))
    total = F.lit(float(max(1, pages.count())))
    scored = pairs.join(n_t, "term").join(entities, "entity")
    pmi = F.log2(F.col("n_te") * total / (F.greatest(F.col("n_t"), F.col("n_te")) * F.col("n_e")))
    information = -F.log2(F.least(F.lit(1.0), F.col("n_e") / total))
    scored = scored.select("entity", "term", F.when(information > 0, pmi / information).otherwise(F.lit(0.0)).alias("disclosure"))
    return scored.filter(F.col("disclosure") >= generalise)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", row_key(F.col("doc_id"), F.col("text"))).withColumn("page", row_key(F.lit(""), F.col("text")))


def _added(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``key, added``: spans of disclosing terms of rows that have any."""
    flagged = maybe_broadcast(materialize(disclosing_terms(docs, found), "disclosing-terms"), MAX_BROADCAST)
    held = found.filter(F.size("near") > 0).select("key", F.explode("near.entity").alias("entity"), "terms")
    held = held.join(maybe_broadcast(flagged.select("entity").distinct(), MAX_BROADCAST), "entity", "left_semi")
    places = held.select("key", "entity", F.explode("terms").alias("t")).select("key", "entity", "t.term", "t.places")
    kind = F.when(F.col("disclosure") >= REMOVE, TERM_KINDS[1]).otherwise(TERM_KINDS[0])
    spans = places.join(flagged, ["entity", "term"]).select("key", kind.alias("kind"), F.explode("places").alias("p"))
    spans = spans.groupBy("key", "p.start", "p.end").agg(F.max("kind").alias("kind"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` of every row: base spans, and all spans, as arrays of (kind, start, end)."""
    prepare(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    found = materialize(scan(rows), "base-spans")
    added = materialize(_added(rows, found), "term-spans")
    joined = found.select("key", "doc_id", "base").join(maybe_broadcast(added, MAX_BROADCAST), "key", "left")
    return joined.select("doc_id", "base", F.concat("base", F.coalesce("added", F.array().cast(_SPANS_DDL))).alias("spans"))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with the union of the spans replaced: base spans and generalised terms by a tag, removed terms by nothing."""
    out, at, end, tag = [], 0, -1, ""
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < end:
            end = max(end, e)
            continue
        if end >= 0:
            out.append(tag)
            at = end
        out.append(text[at:s])
        end, tag = e, "" if kind == "term_removed" else f"<{kind.upper()}>" if kind in KINDS else "<TERM>"
    if end >= 0:
        out.append(tag)
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns and the text redacted; rows without spans stay as they are."""
    prepare(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    found = materialize(scan(rows), "base-spans")
    added = materialize(_added(rows, found), "term-spans")
    names = docs.columns
    at = names.index(text_col)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of the input cannot clash with ours
    inner = inner.withColumn("key", row_key(F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{at}")))
    joined = inner.join(maybe_broadcast(added, MAX_BROADCAST), "key", "left").drop("key")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType() if i == at else f.dataType, True) for i, f in enumerate(docs.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            new = []
            for t, more in zip(column(b, f"c{at}"), column(b, "added"), strict=True):
                spans = base_spans(t) if t else []
                spans += [(x["kind"], x["start"], x["end"]) for x in more or ()]
                new.append(redacted(t, spans) if spans else t)
            columns = [pa.array(new, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))])

    return joined.mapInArrow(run, schema).toDF(*names)


def digests(found: DataFrame) -> DataFrame:
    """Contract columns of ``find``'s result."""
    order = {k: i for i, k in enumerate([*KINDS, *TERM_KINDS])}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])

    def text(spans: str):
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
