"""Winnowing, fill-in-middle and the point-in-time join against plain versions, with the edge cases of the docstrings."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe, fim, mixing, ogg, pii, pointintime, quality, registry, secrets, toxicity, winnow

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, lang string"
EDGES = [
    (None, "no id " * 30, "s", 1, "x"), (5000, None, None, None, None), (5001, "", "s", 0, "y"), (5002, "word " * 6_000, "s", 1, "y"), (5003, "éa 😀 ſ K \x1c x\U00010ffff" * 9, "t", 2, None),
    (5004, "a\tb\x0bc", "t", 3, "z"), (5005, "a" * 3000, "t", 3, "z"), (5006, "q" * 23, "t", 3, "z"), (5007, "xy" * 31, "t", 3, "z"), (5008, "now <P> here <", "t", 3, "z"), (5009, " \n  \t ", "t", 3, "z"), (5010, "<P", "t", 3, "z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 2 = 0").select("doc_id", "text", "source", "n_chars", "lang")
    return d.union(spark.createDataFrame(EDGES, SCHEMA)).cache()


def rolled(text, gram):
    """CRC-32 of each run of code points, rolled: what leaves is taken off by its remainder after the run's length, as the code is linear."""
    table = [0] * 256
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        table[b] = c
    step = lambda c, b: (c >> 8) ^ table[(c ^ b) & 255]
    raw = text.encode("utf-32-be")

    def after(c, zeros):
        for _ in range(zeros):
            c = step(c, 0)
        return c

    out_of = [after(step(0, b), 4 * gram - 1) for b in range(256)]  # a byte's share once 4 * gram - 1 more have come
    fill = after(0xFFFFFFFF, 4 * gram)  # the share of the register's first state
    c = 0
    for i, b in enumerate(raw):
        c = step(c, b)
        if i >= 4 * gram:
            c ^= step(out_of[raw[i - 4 * gram]], 0)
        if i % 4 == 3 and i >= 4 * gram - 1:
            yield c ^ fill ^ 0xFFFFFFFF


def plain(text, gram=winnow.GRAM, window=winnow.WINDOW):
    if not text:
        return []
    h = list(rolled(text + "\0" * max(0, gram - len(text)), gram))
    out = set()
    for i in range(max(1, len(h) - window + 1)):
        out.add(min(((h[p], -p) for p in range(i, min(i + window, len(h))))))
    return sorted((-p, x) for x, p in out)


def test_the_rolled_hash_is_the_checksum():
    t = "Rolling é😀 along the text"
    b = t.encode("utf-32-be")
    assert list(rolled(t, 5)) == [zlib.crc32(b[4 * i : 4 * i + 20]) for i in range(len(t) - 4)]


@pytest.mark.parametrize("shape", [(24, 40, 1000), (5, 7, 16), (3, 1, 4), (4, 2, 900)])
def test_fingerprints(docs, shape):
    gram, window, block = shape
    some = docs.where("doc_id is not null and (doc_id % 5 = 0 or doc_id >= 5000)").select(F.col("doc_id").alias("key"), "text")
    got = {r.key: [(e >> 32, e & 0xFFFFFFFF) for e in r.entries] for r in winnow.fingerprints(some, gram=gram, window=window, block=block).collect()}
    want = {r.key: plain(r.text or "", gram, window) for r in some.collect()}
    assert got == want


def likeness(a, b):
    a, b = {x for _, x in a}, {x for _, x in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_fingerprints(docs):
    want = []
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
    for i, (k, t) in enumerate(rows):
        after, m = rows[(i + 1) % len(rows)][1], len(t) // 3
        e = t[: len(t) - m] + after[:m]
        a, b = plain(t), plain(e)
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, plain(after))))
    unpack = lambda es: [(e >> 32, e & 0xFFFFFFFF) for e in es]
    got = [(r.doc_id, r.n_chars, r.edited_sha256, unpack(r.entries), unpack(r.edited), r.near_edited, r.near_next) for r in winnow.edited_fingerprints(docs.withColumn("key", F.lit("clash"))).collect()]
    order = lambda x: (x[0] is None, x[0])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_edited_fingerprints_of_repeats_one_and_none(spark, docs):
    one = spark.createDataFrame([(1, "the same text, twice " * 5)] * 2 + [(1, "another")], "doc_id bigint, text string")
    got = winnow.edited_fingerprints(one).collect()
    assert len(got) == 3 and len({(r.n_chars, r.edited_sha256) for r in got}) == 2
    alone = winnow.edited_fingerprints(one.where("text = 'another'")).first()
    assert alone.near_next == 1.0 and alone.n_chars == 7
    assert winnow.edited_fingerprints(docs.limit(0)).count() == 0


def test_a_long_match_is_always_found():
    rng, shared = random.Random(1), winnow.GRAM + winnow.WINDOW - 1
    for _ in range(30):
        text = lambda n: "".join(rng.choice("abcd ") for _ in range(n))  # noqa: B023, E731
        same = text(shared)
        a, b = plain(text(rng.randrange(99)) + same + text(50)), plain(text(rng.randrange(99)) + same + text(70))
        assert {x for _, x in a} & {x for _, x in b}


def test_winnowing_stays_out_of_python(spark):
    plan = winnow.edited_fingerprints(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowToJava", "")


def cut_up(k, text, seed="42:"):
    tokens = re.findall(fim.PATTERN, text)
    h = [int(hashlib.sha256(f"{seed}{'' if k is None else k}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs):
    odd = docs.withColumns({"row": F.lit(1), "h1": F.lit("clash"), "a bc": F.lit(2), "form": F.lit("old")})
    got = fim.fill_in_middle(odd)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "lang", "row", "h1", "a bc", *fim.OUT]
    key = lambda x: str(x)
    rows = got.collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in rows), key=key) == sorted(((r.doc_id, *cut_up(r.doc_id, r.text or "")) for r in docs.collect()), key=key)
    assert all(fim.restored(r.output, r.form) == (r.text or "") for r in rows) and {r.form for r in rows} == {"plain", "spm", "psm"}


def test_fill_in_middle_restores_what_lies_beside_marks():
    for text in ("<P", "a <", "S> x", "<<S <M", "> P> <"):
        for h in range(60):
            b = fim.splitter()(text)
            for order in (0, 99):
                n, form, p, m, out = fim.arranged(text, b, (h, h // 7, 0, order))
                assert fim.restored(out, form) == text and form != "plain" and 0 <= p <= p + m <= len(text)


def test_fill_in_middle_digests(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((r.doc_id, *(c := cut_up(r.doc_id, r.text or ""))[:4], sha(c[4]), sha(r.text or "")) for r in docs.collect()), key=str)
    assert sorted(map(tuple, fim.digests(docs).collect()), key=str) == want and fim.digests(docs.limit(0)).count() == 0


def test_columns_whose_names_need_quotes(spark):
    d = spark.createDataFrame([(1, "a text", "x"), (2, None, "y")], "doc_id bigint, text string, other string").withColumnRenamed("other", "a.b c")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    judged = lambda m: lambda d: m.score(d, m.learn(d, labels)).withColumn("text", F.lit(""))
    for op in (judged(quality), judged(toxicity), lambda d: ogg.probe(ogg.store(d)), bpe.digests, bpe.encode, secrets.scan, fim.fill_in_middle, lambda d: pii.surrogates(d, secret="k"), mixing_of):
        got = op(d)
        assert "a.b c" in got.columns and {r["a.b c"] for r in got.collect()} == {"x", "y"}


def mixing_of(d):
    return mixing.copies(d.withColumn("source", F.lit("s")))


def winner(versions, source, t):
    best = [(v[2], v[3], v[1]) for v in versions if v[0] is not None and v[0] == source and None not in v[1:5] and t is not None and v[2] <= t and v[3] <= t < v[4]]
    return max(best, default=None)


@pytest.mark.parametrize("shape", [(1024, 64), (8, 4), (4096, 4096)])
def test_point_in_time(spark, shape):
    rng = random.Random(3)
    versions = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, e := rng.randrange(-300, 3000), e + rng.randrange(-60, 540), e + rng.randrange(0, 900), f"p{i}") for i in range(900)]
    versions += [("long", 5000, -40, -90, 9000, "p5000"), ("long", 5001, 100, 100, 100, "p5001"), ("a", None, 1, 1, 900, "x"), ("a", 5002, None, 1, 900, "x"), *[("tie", 6000 + i, 10, 10, 500, f"p{6000 + i}") for i in range(5)]]
    labels = [(i, rng.choice(["hot", "hot", "a", "b", "long", "tie", "none", None]), rng.choice([None, *range(-350, 4000)]), "e") for i in range(900)]
    labels += labels[:5]
    v = spark.createDataFrame(versions, "source string, version_id bigint, event bigint, arrival bigint, expiry bigint, name string")
    q = spark.createDataFrame(labels, "label bigint, source string, t bigint, event string")
    got = pointintime.join(q, v, payload=("name",), chunk=shape[0], tile=shape[1])
    assert got.columns == ["label", "source", "t", "version_id", "event", "name"]
    want = [(i, s, t, w[2] if w else None, w[0] if w else None, f"p{w[2]}" if w else None) for i, s, t, _ in labels for w in [winner(versions, s, t)]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert pointintime.join(q.limit(0), v).count() == 0 and {r.version_id for r in pointintime.join(q, v.limit(0)).collect()} == {None}


def test_painting():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 40, (2, 12))
        owner = pointintime.paint(np.minimum(a, b), np.maximum(a, b), 40)
        for s in range(40):
            inside = [k for k in range(12) if min(a[k], b[k]) <= s < max(a[k], b[k])]
            assert owner[s] == (inside[0] if inside else -1)
        start, end, who = pointintime.runs(owner)
        again = np.full(40, -1)
        for x, y, w in zip(start, end, who, strict=True):
            again[x:y] = w
        assert (again == owner).all()


@pytest.mark.parametrize("name", ["op11_winnow", "op12_fim", "op13_point_in_time"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    c = duckdb.connect()
    for f in ("documents", "labels"):
        c.execute(f"CREATE VIEW {f} AS SELECT * FROM '{DATA}/{f}.parquet'")
    a, b = registry.QUERIES[name](spark, DATA).toPandas(), c.execute(registry.ORACLES[name]).fetchdf()
    cols = sorted(a.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(a), order(b), check_dtype=False)
