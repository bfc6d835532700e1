"""Jaccard join, decontamination, fingerprints and sanitisation against brute force."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import regex as unicode_re
from tests.oracle import same

from tarnlake.llm import decontaminate, fingerprints, jaccard, queries, sanitize, shared
from tarnlake.llm.shared import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


# -- op 1 -----------------------------------------------------------------------


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8)
    assert bands * rows <= jaccard.MAX_HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def test_gram_sets():
    texts = ["", "one two", "One, two!", "a b c d e f", "x a b c d e f", "A B C D E F"]
    s = jaccard.gram_sets(texts)
    assert [len(x) for x in s] == [0, 1, 1, 2, 3, 2]
    assert (s[1] == s[2]).all() and (s[3] == s[5]).all() and np.isin(s[3], s[4]).all()


def brute_classes(rows):
    sets = [grams(r.text) for r in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j].doc_id for j in seen if rows[j].doc_id is not None]
        out.append((r.doc_id, (min(ids) if ids else None) if sets[i] else r.doc_id, len(near[i]), sum(sets[j] == sets[i] for j in near[i])))
    return sorted(map(str, out))


def near_copies(n, seed=3):
    rnd = random.Random(seed)
    base = [f"tok{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(f"solo{i}x{k}" for k in range(30))) for i in range(5)]


@pytest.mark.parametrize("block", [jaccard.BLOCK_CLASSES, 7])
def test_large_group_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_CLASSES", block)
    df = spark.createDataFrame(near_copies(60), "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in jaccard.jaccard_classes(df).collect()) == brute_classes(df.collect())


def test_jaccard_odd_rows(odd_rows, no_rows):
    assert sorted(str(tuple(r)) for r in jaccard.jaccard_classes(odd_rows).collect()) == brute_classes(odd_rows.collect())
    assert jaccard.jaccard_classes(no_rows).count() == 0


def test_verify_counts_each_pair_once():
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(k) for k in (0, 1, 2, 50)]
    block = pd.DataFrame({"set_key": [b"a", b"b", b"c", b"d"], "weight": [1, 2, 3, 1], "band": 1, "side": 2})
    block["sets"] = [s.astype("<u8").tobytes() for s in sets]
    block["bands"] = [np.array(b, "<i8").tobytes() for b in ([1, 9], [1, 9], [2, 9], [3, 9])]
    got = {r.set_key: (r.root, r.links) for r in jaccard.verify(block, 0.8).itertuples()}
    assert got == {b"a": (b"a", 3), b"b": (b"a", 3), b"c": (b"a", 3)}  # a and b met in band 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, data, name):
    same(queries.QUERIES[name](spark, data), queries.ORACLES[name], data)


# -- op 2 -----------------------------------------------------------------------


def contaminations(docs, items, window=13):
    out = []
    known = {(i.item_id, tuple(words(i.text))) for i in items if i.item_id is not None}
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for item, iw in known:
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d.doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def brute_contamination(docs, items):
    return sorted(map(str, contaminations(docs, items)))


def test_contamination_against_brute_force(spark, odd_rows):
    rnd = random.Random(9)
    vocab = "a b c d".split()
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 14, 20, 60]))) for _ in range(40)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 13, 14, 16])]
    items += [(50, " ".join(texts[-1].split()[:15])), (50, "the lazy dog"), (51, "THE LAZY, DOG!"), (51, "the lazy dog"), (52, None), (53, ""), (None, "a b"), (54, "-- !")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd_rows.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).drop("items")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_contamination(docs.collect(), bench.collect())


def test_candidates_follow_rare_shingles(spark):
    """A shingle that all items and documents hold many times is no prefix, so it makes no candidates."""
    common = "and of the and of the and of the"
    items = [(i, f"a{i} b{i} c{i} d{i} {common} e{i}") for i in range(300)]
    texts = [(d, f"{common} " * 30 + f"x{d} {common}") for d in range(50)] + [(100, f"start {items[7][1]} end"), (101, f"a9 b9 c9 d9 {common} changed")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench).drop("items")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_contamination(docs.collect(), bench.collect())
    known, _ = decontaminate.item_texts(bench, 13, 3)
    shingles = decontaminate.item_shingles(known, [3])
    counts = decontaminate.shingle_counts(docs, shingles.select("key").distinct(), [3])
    assert counts.agg({"df": "max"}).first()[0] > 4000
    spans = decontaminate.prefix_spans(known, shingles, counts)
    assert decontaminate.candidates(docs, spans.drop("tid"), [3], 13).filter("sid is not null").count() < 10


def test_contamination_clashing_columns(spark, odd_rows):
    bench = spark.createDataFrame([(1, "the lazy dog", "x", 2, 3)], "item_id long, text string, doc_id string, row int, words int")
    clash = odd_rows.selectExpr("*", "1 as row", "2 as words", "3 as key", "4 as item_id", "5 as n_words", "6 as sid")
    got = decontaminate.contamination(clash, bench).drop("items")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_contamination(odd_rows.collect(), bench.collect())


def test_contamination_of_empty_tables(spark, odd_rows, no_rows):
    bench = spark.createDataFrame([(1, "the lazy dog")], "item_id long, text string")
    assert decontaminate.contamination(no_rows, bench).count() == 0
    got = decontaminate.contamination(odd_rows, bench.filter("false"))
    assert got.filter("n_hit > 0 or n_items > 0 or contaminated").count() == 0 and got.count() == odd_rows.count()


def test_contamination_without_broadcast(spark, monkeypatch, data):
    docs, bench = read(spark, data, "documents"), read(spark, data, "benchmark")
    want = sorted(str(tuple(r)) for r in decontaminate.contamination(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    assert sorted(str(tuple(r)) for r in decontaminate.contamination(docs, bench).collect()) == want


def test_contamination_is_native(spark, data):
    plan = queries.QUERIES["op2_decontaminate"](spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- op 3 -----------------------------------------------------------------------


def test_extensions_against_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choice("ab😀") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
        i, j = rnd.randint(0, len(a)), rnd.randint(0, len(b))
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
        n = rnd.randint(0, 6)
        assert x.equal(i, y, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])


def test_fingerprint():
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    other = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    f = fingerprints.Fingerprint.of
    assert str(f(text)) == str(f(str(text))) and str(f(text)) != str(f(text + "a"))
    again = fingerprints.Fingerprint.parse(str(f(text)))
    assert str(again) == str(f(text)) and again.likeness(f(text)) == 1.0
    assert f(text).likeness(f(other)) == 0.0
    assert 0.7 <= f(text).likeness(f(fingerprints.edited(text, other))) <= 0.75
    assert f(text).likeness(f("x" + text)) > 0.9  # the common end
    assert f(text).likeness(f(text[:2000] + "#" + text[2001:])) > 0.9
    assert f("").likeness(f("")) == 1.0 and f("").likeness(f("a")) == 0.0
    for a, b in (("a" * 100, "a" * 50), ("ab" * 3000, "ab" * 1500), ("abc" * 70, "abc" * 7)):  # the overlap of both ends counts once
        assert f(a).likeness(f(b)) <= len(b) / len(a) and fingerprints.PrefixHash(a).likeness(fingerprints.PrefixHash(b)) == len(b) / len(a)


def test_arrays_of_an_edited_text():
    rnd = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc😀") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        x = fingerprints.PrefixHash(a).edited(fingerprints.PrefixHash(b))
        want = fingerprints.PrefixHash(fingerprints.edited(a, b))
        assert (x.one == want.one).all() and (x.two == want.two).all() and (x.codes == want.codes).all()
        assert str(fingerprints.Fingerprint.of(x)) == str(fingerprints.Fingerprint.of(want))
        # suffix hashes do not depend on what stands before
        f, g = fingerprints.Fingerprint.of(a), fingerprints.Fingerprint.of(b + a)
        n = min(len(a), 20)
        if f.stride == g.stride == 1:
            assert (f.back[: n + 1] == g.back[: n + 1]).all()


def brute_common(a, b):
    """Length of the longest common subsequence."""
    x, y = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (a, b))
    row = np.zeros(len(y) + 1, int)
    for c in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == c, row[:-1] + 1, 0)))
    return int(row[-1])


def scattered(words, edits, rnd):
    """Words at random places replaced by words of other lengths."""
    w = list(words)
    for at in rnd.sample(range(len(w)), edits):
        w[at] = "".join(rnd.choice("ABCDEF") for _ in range(rnd.randint(1, 12)))
    return " ".join(w)


@pytest.mark.parametrize("repeats", [1, 12])
def test_likeness_after_scattered_edits(repeats):
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    for edits in (0, 1, 2, 3, 5, 10):
        for _ in range(4):
            words = [rnd.choice(vocab) for _ in range(360 // repeats)] * repeats
            a, b = " ".join(words), scattered(words, edits, rnd)
            x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
            want = brute_common(a, b) / max(len(a), len(b))
            assert want - 0.03 <= x.likeness(y) <= want and want - 0.03 <= y.likeness(x) <= want, edits
    assert fingerprints.PrefixHash("x" * 3000).likeness(fingerprints.PrefixHash("x" * 2000)) == 2000 / 3000
    assert fingerprints.PrefixHash("").likeness(fingerprints.PrefixHash("a")) == 0.0


def test_query_likeness_is_whole(spark):
    """The end of a document that its edited text keeps behind a shift counts too."""
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(500)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, scattered(words, 5, rnd))], "doc_id long, text string")
    assert all(r.near_next > 0.9 for r in fingerprints.fingerprint_pairs(frame).collect())


def test_fingerprints_of_next_documents(spark, monkeypatch, odd_rows, no_rows, data):
    monkeypatch.setattr(shared, "MAX_REGIONS", 3)  # regions cut into parts
    docs = read(spark, data, "documents").select("doc_id", "text")
    for frame, size in ((docs, 50_000), (docs, 10**9), (odd_rows, 200_000)):
        rows = sorted([(r.doc_id, r.text or "") for r in frame.collect() if r.doc_id is not None])
        want = []
        for i, (d, t) in enumerate(rows):
            e = fingerprints.edited(t, rows[(i + 1) % len(rows)][1])
            want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
        want += [(None, len(r.text or ""), hashlib.sha256(fingerprints.edited(r.text or "", r.text or "").encode()).hexdigest()) for r in frame.collect() if r.doc_id is None]
        got = fingerprints.fingerprint_pairs(frame, shard_bytes=size).collect()
        assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got) == sorted(map(str, want))
        assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints.fingerprint_pairs(no_rows).count() == 0


# -- op 4 -----------------------------------------------------------------------


def brute_spans(t):
    def luhn(d):
        s = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (2 if i % 2 else 1)
            s += v - 9 if v > 9 else v
        return s % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_against_brute_force():
    rnd = random.Random(3)
    for _ in range(20_000):
        t = "".join(rnd.choice("0123456789..@@aB+--( )%_ é") for _ in range(rnd.randint(0, 40)))
        assert sanitize.base_spans(t) == brute_spans(t), t
    t = "pay 4539 1488 0343 6467 or 4539-1488-0343-6467 x 0001.2.3.255 +1 (555) 123-4567"
    assert sanitize.base_spans(t) == brute_spans(t) and len(sanitize.base_spans(t)) == 4


def test_long_texts_take_linear_time():
    for t in ("a" * 200_000 + "@", "1" * 200_000 + ".", "@a" * 50_000, "+1" * 50_000):
        sanitize.base_spans(t)


def fixture(spark):
    """'zorblax' stands only beside one address, in different contexts; 'common' stands everywhere."""
    rows = [(i, f"filler{i} common mail to ann@site.org about zorblax item{i}") for i in range(6)]
    rows += [(100 + i, f"common words number{i} and mail{i}@else.net thing") for i in range(60)]
    rows += [(300 + i, "copied text with oneoff@copy.org and rarecopy") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    found = {r.doc_id: r.spans for r in sanitize.digests(sanitize.find(fixture(spark))).collect()}
    for i in range(6):
        text = f"filler{i} common mail to ann@site.org about zorblax item{i}"
        at = text.index("zorblax")
        assert f"term_removed:{at}:{at + 7}" in found[i] and "common" not in [text[slice(*map(int, s.split(":")[1:]))] for s in found[i].split(",")]
    assert all("term" not in found[d] for d in found if d >= 100)  # neither singletons nor copies disclose


def test_copied_pages_still_disclose(spark):
    """Copies of a page change neither what is counted together nor what is counted over all."""
    rows = fixture(spark)
    copied = rows.filter("doc_id < 100").crossJoin(spark.range(100)).selectExpr("1000 * (id + 1) + doc_id", "text")
    kept = {r.doc_id: r.spans for r in sanitize.digests(sanitize.find(rows.union(copied))).collect()}
    for d in [0, 5, 1000, 100_005]:
        text = f"filler{d % 1000} common mail to ann@site.org about zorblax item{d % 1000}"
        at = text.index("zorblax")
        assert f"term_removed:{at}:{at + 7}" in kept[d]
    plain = {r.doc_id: r.spans for r in sanitize.digests(sanitize.find(rows)).collect()}
    assert {d: kept[d] for d in plain} == plain


def test_terms_far_from_their_entity(spark):
    """'zorblax' stands near the address and far from it, 'quuxly' far from it only."""
    pad = "common words stand here and there " * 12
    rows = [(i, f"number{i} ann@site.org knows zorblax {pad} zorblax and quuxly {pad} quuxly") for i in range(6)]
    rows += [(100 + i, f"{pad} number{i} mail{i}@else.net knows") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in sanitize.find(docs).collect()}
    for d, text in rows:
        own = sorted((s.start, s.end) for s in found[d] if s.kind == "term_removed")
        assert own == [m.span() for m in re.finditer("zorblax|quuxly", text)]
    assert not any("zorblax" in r.text or "quuxly" in r.text for r in sanitize.redact(docs).collect())


def brute_disclosures(texts, support):
    """{(entity, term): disclosure} from the definition, over distinct texts."""
    pages = sorted(set(texts))
    spoken = {p: set(unicode_re.findall(r"\p{L}{2,}", p.lower())) for p in pages}
    of, contexts = {}, {}
    for p in pages:
        spans = brute_spans(p)
        outside = [m for m in unicode_re.finditer(r"\p{L}{2,}", p) if not any(m.start() < e and s < m.end() for _, s, e in spans)]
        near = {}
        for kind, s, e in spans:
            value = p[s:e].lower() if kind == "email" else re.sub("[^0-9.]" if kind == "ip" else "[^0-9]", "", p[s:e])
            low, high = max(0, s - sanitize.REACH), min(len(p), e + sanitize.REACH)
            near.setdefault(f"{kind}:{value}", {})[p[low:high]] = {m[0].lower() for m in outside if m.start() >= low and m.end() <= high}
        for entity, own in near.items():
            for t in {m[0].lower() for m in outside}:
                of.setdefault((entity, t), set()).add(p)
                close = [c for c, terms in own.items() if t in terms]
                contexts.setdefault((entity, t), set()).update(close or [("far", p)])
            of.setdefault(entity, set()).add(p)
    out = {}
    for key, held in of.items():
        if isinstance(key, tuple) and len(contexts[key]) >= support:
            n_e, n_t = len(of[key[0]]), max(len(held), sum(key[1] in spoken[p] for p in pages))
            information = -np.log2(n_e / len(pages))
            out[key] = np.log2(len(held) * len(pages) / (n_t * n_e)) / information if information > 0 else 0.0
    return out


@pytest.mark.parametrize("support", [1, 2, 3])
def test_disclosures_against_brute_force(spark, support):
    rnd = random.Random(support)
    people = [f"p{i}@site.org" for i in range(4)] + ["10.0.0.7"]
    words = [rnd.choice("abcdef") * 2 + rnd.choice("ghijk") for _ in range(40)]
    texts = []
    for _ in range(60):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        for who in rnd.sample(people, rnd.choice([0, 0, 1, 1, 2])):
            w[rnd.randrange(len(w))] = who
        texts.append(" ".join(w))
    texts += texts[:10] * 7  # copies
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = sanitize._keyed(docs, "doc_id", "text")
    got = sanitize.disclosing_terms(rows, sanitize.scan(rows), support, -100.0).collect()
    want = brute_disclosures(texts, support)
    # a text whose term stands far off gives one of its contexts, which may be another text's too
    found = {(r.entity, r.term): r.disclosure for r in got}
    assert found.keys() <= want.keys() and len(found) >= 0.9 * len(want) and len(found) > 20
    assert all(abs(found[k] - want[k]) < 1e-9 for k in found)


def test_redaction(spark, odd_rows, no_rows):
    out = {r.doc_id: r.text for r in sanitize.redact(fixture(spark)).collect()}
    assert "<EMAIL>" in out[0] and "ann@" not in out[0] and "zorblax" not in out[0] and "common" in out[0]
    assert out[300] == "copied text with <EMAIL> and rarecopy"
    clash = odd_rows.withColumn("key", odd_rows.score).withColumn("added", odd_rows.score)
    kept = sanitize.redact(clash)
    assert kept.columns == clash.columns and sorted(map(str, kept.collect())) == sorted(map(str, clash.collect()))
    assert sanitize.redact(no_rows).count() == 0 and sanitize.find(no_rows).count() == 0
    assert sanitize.find(odd_rows).count() == odd_rows.count()
    assert sanitize.redacted("abcdef", [("email", 1, 3), ("phone", 2, 5)]) == "a<EMAIL>f"


def test_spans_of_documents(spark, data):
    docs = read(spark, data, "documents")
    got = {r.doc_id: r for r in sanitize.digests(sanitize.find(docs)).collect()}
    for r in docs.collect():
        spans = brute_spans(r.text)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[r.doc_id].spans.startswith(text)
        assert got[r.doc_id].n_email == sum(k == "email" for k, _, _ in spans)
