"""Classifiers by held-out accuracy, near-duplicates against brute force, the pipeline stage by stage."""

import collections
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import components, itq, minhash, quality, toxicity
from waymark.llm.common import fold, materialise

BIG = os.environ.get("TEST_BIG_DIR", "/root/testdata/sf0.1")
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def auc(s, y):
    s, y = np.asarray(s), np.asarray(y)
    order = np.argsort(np.argsort(s))
    return (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op9_quality, "quality", 0.99), (toxicity.op5_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    got = query(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    assert auc(got["score"], got[label]) >= least and (got["predicted"] == got[label]).mean() >= 0.95 and got["score"].between(0, 1).all()


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_on_edges(spark, op):
    d = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "x"), (1, "a b"), (4, "w" * 100_000)], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, odd):
        got = op.score(d, op.learn(d, labels)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert op.score(d.limit(0), op.learn(d.limit(0), none)).count() == 0


@pytest.mark.parametrize("op", [quality, toxicity])
def test_classifiers_beside_clashing_columns(spark, op):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    odd = d.withColumns({c: F.lit("clash") for c in ("_key", "key", "kind", "u", "word", "n", "x", "row")})
    a, b = op.score(d, op.learn(d, labels)), op.score(odd, op.learn(odd, labels.withColumns({"u": F.lit(1), "key": F.lit(2)})))
    assert {(r.doc_id, r.score) for r in a.collect()} == {(r.doc_id, r.score) for r in b.collect()} and b.where("kind = 'clash' and _key = 'clash'").count() == d.count()


def slope(f, w):
    return np.array([(f(w + e) - f(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6])


@pytest.mark.parametrize("prior", [0.05, 0.9])
def test_risk_and_its_steps_against_a_plain_version(prior):
    rng = np.random.default_rng(8)
    p, u, w = rng.integers(0, 3, (7, 5)).astype(float), rng.integers(0, 2, (12, 5)).astype(float), rng.standard_normal(6)
    loss = lambda g: float(np.log(1 + np.exp(-g)))

    def parts(w):
        g = lambda x: sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1]
        return prior * sum(loss(g(x)) for x in p) / 7, sum(loss(-g(x)) for x in u) / 12 - prior * sum(loss(-g(x)) for x in p) / 7

    seen = set()
    for shift in (-4.0, 0.0, 6.0):
        v = w + np.append(np.full(5, shift / 2), 0)
        positive, negative, gradient = toxicity.risk(p, u, v, prior)
        assert np.allclose((positive, negative), parts(v))
        seen.add(negative >= 0)
        want = slope(lambda x: sum(parts(x)), v) if negative >= 0 else slope(lambda x: -parts(x)[1], v)
        assert np.allclose(gradient, want, atol=1e-5)
    assert prior < 0.5 or seen == {True, False}


def test_pair_loss_against_a_plain_version():
    rng = np.random.default_rng(9)
    d, w = rng.standard_normal((11, 4)), rng.standard_normal(4)
    plain = lambda w: sum(np.log(1 + np.exp(-sum(a * b for a, b in zip(x, w, strict=True)))) for x in d) / 11 + 0.05 * sum(a * a for a in w)
    loss, gradient = quality.pair_loss(d, w, 0.1)
    assert np.isclose(loss, plain(w)) and np.allclose(gradient, slope(plain, w), atol=1e-5)


def test_block_sums_against_pairs():
    rng = np.random.default_rng(10)
    good, bad, w = rng.standard_normal((7, 4)), rng.standard_normal((5, 4)), rng.standard_normal(4)
    d = np.array([g - b for g in good for b in bad])
    loss, gradient = quality.pair_loss(d, w)
    got = quality.block_sums(good, bad, w)
    curve = np.array([slope(lambda v, i=i: quality.pair_loss(d, v)[1][i], w) for i in range(4)])
    assert got[0] == 35 and np.isclose(got[1] / 35, loss) and np.allclose(got[2:6] / 35, gradient) and np.allclose(got[6:].reshape(4, 4) / 35, curve, atol=1e-5)


def test_quality_is_learned_from_all_labelled_documents(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.learn(d, labels)
    rows = d.join(labels, "doc_id").where(fold() != 0).collect()
    x = np.array([quality.figures(r.text) for r in rows])
    s, share = model.strength(x), np.mean([r.quality == 0 for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.isclose(model.cut, np.quantile(s, share)) and np.isclose(model.spread, s.std() / 4)
    good, bad = (model._norm(x[[r.quality == k for r in rows]]) for k in (1, 0))
    loss, gradient = quality.pair_loss((good[:, None] - bad[None]).reshape(-1, x.shape[1]), model.weights, 1e-4)
    assert np.abs(gradient).max() < 1e-3  # the weights are those of all pairs
    assert np.array_equal(model.weights, quality.learn(d.repartition(5), labels.repartition(3)).weights)


@pytest.mark.parametrize("rare", [1, 3, 400])
def test_blocks_take_every_labelled_document(spark, rare):
    rows = spark.range(5000).selectExpr("id AS key", f"IF(id < {rare}, 0, 1) AS kind", "array(double(id)) AS x")
    got = quality.dealt(rows, 5000, {0: rare, 1: 5000 - rare}).collect()
    assert len(got) == 20 and sorted(v for r in got for v in r.good) == list(range(rare, 5000)) and {v for r in got for v in r.bad} == set(range(rare))
    assert all(len(set(r.bad)) == len(r.bad) for r in got)


@pytest.mark.parametrize("share", [0.0, 0.123, 0.5, 1.0])
def test_quantile_of_all_values(spark, share):
    values = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0.25D ELSE double(hash(id)) * double(hash(id)) END AS s")
    assert quality.quantile(values, share) == pytest.approx(np.quantile([r.s for r in values.collect()], share))


def test_gram_totals_against_a_plain_version(spark):
    texts = [(1, "Abc abc abcdef"), (1, None), (0, "abcdef ghi"), (0, "abcdef")]
    d = spark.createDataFrame(texts, "kind int, text string")
    got = {(r.kind, r.gram): r.total for r in toxicity.gram_sums(toxicity.word_counts(d.where("kind = 1"), 1).unionByName(toxicity.word_counts(d.where("kind = 0"), 0))).collect()}
    want = collections.Counter((k, g) for k, t in texts for w in set((t or "").lower().split()) for g in toxicity.grams(w))
    assert got == dict(want)


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(fold() == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.learn(d, labels), quality.learn(d, flipped)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut


def brute_components(rows, links):
    up = {i: i for i in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in rows}


def words_set(t, n):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_near(rows, words):
    s = [(i, words_set(t, words)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(s) for b, y in s[:k] if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    return brute_components([i for i, _ in s], links), {i: len(x) for i, x in s}


def variants(n, seed):
    """Texts in groups of near copies of many degrees, chains among them."""
    rng = np.random.default_rng(seed)
    out, base = [], []
    for i in range(n):
        if i % 12 == 0:
            base = [f"w{x}" for x in rng.integers(0, 400, int(rng.integers(5, 80)))]
        w = list(base)
        for _ in range(int(rng.integers(0, 1 + len(w) // 9))):
            w[int(rng.integers(0, len(w)))] = f"w{rng.integers(0, 400)}"
        if i % 5 == 0:
            base = w
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("chunk", "words"), [(components.CHUNK, 4), (4, 4), (7, 5), (2, 5)])
def test_near_duplicates(spark, chunk, words):
    rows = variants(300, 1) + [(1000, ""), (1001, None), (1002, " \t"), (1003, "A b"), (1004, "a B"), (1005, "a b c"), (1006, "x " * 60_000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, sizes = brute_near(rows, words)
    got = minhash.near_duplicates(d.withColumn("n", F.lit(1)).repartition(5), words=words, chunk=chunk).collect()
    assert {r.id: r.component for r in got} == want and {r.id: r.n for r in got} == sizes


def test_a_large_group_of_near_copies_beside_others(spark):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    rows = []
    for i in range(240):  # copies of one text with more and more edits, so that only some are linked with the first
        w = list(base)
        for _ in range(i % 12):
            w[int(rng.integers(0, 300))] = f"v{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, _ = brute_near(rows, 5)
    assert 1 < len(set(want.values())) < 150
    assert {r.id: r.component for r in minhash.near_duplicates(d, chunk=16).collect()} == want


def test_chunk_pairs_bring_every_two_rows_together_once(spark):
    rows = [(b, i, (i * 7 + b) % 3 > 0) for b, n in ((1, 40), (2, 9), (3, 1)) for i in range(n)] + [(4, i, True) for i in range(30)]
    d = spark.createDataFrame(rows, "bucket bigint, id bigint, settled boolean")
    for frame, calm in ((d, {(b, i): s for b, i, s in rows}), (d.drop("settled"), {})):
        pieces, met = collections.defaultdict(list), collections.Counter()
        for r in components.chunk_pairs(frame, 5).collect():
            pieces[r.bucket, r.i, r.j].append((r.id, r.own))
        for (b, i, j), own in pieces.items():
            assert len(own) <= 40
            met.update((b, *sorted((x, y))) for k, (x, p) in enumerate(own) for y, q in own[:k] if i == j or p != q)
        want = {(b, *sorted((x, y))) for b, x, _ in rows for c, y, _ in rows if b == c and x != y and not (calm.get((b, x)) and calm.get((b, y)))}
        assert set(met) == want and set(met.values()) <= {1}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    d = spark.createDataFrame([(7, "a b c d e"), (7, "v w x y z"), (9, "v w x y z"), (None, "a b c d e"), (None, "alone in here now")], "doc_id bigint, text string")
    got = sorted((r.id or -1, r.component or -1) for r in minhash.near_duplicates(d).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7), (9, 7)]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_components_on_chains_stars_and_trees(spark):
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(int(a), int(b)) for a, b in rng.integers(200, 300, (70, 2))] + [(400, 400)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = brute_components(sorted({x for e in links for x in e}), links)
    assert got == {i: c for i, c in want.items() if i != 400}


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16))
    rows = [(i, (base[i % 40] + rng.standard_normal(16) * 0.12 * (i % 4)).astype("f4").tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(30)] + [(800, None), (801, [0.0] * 16), (802, [float("nan")] * 16), (803, [None] + [1.0] * 15), (804, []), (805, [float("inf")] * 16), (3, rows[3][1])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    x = np.array([v for _, v in rows[:730]], dtype=np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= 0.9
    got = collections.defaultdict(list)
    for r in itq.link(d).collect():
        got[r.id].append(r)
    found, there = sum(got[i][0].n_links for i in range(730) if i != 3), int(near.sum() - 730)
    # One more vector than in x, the repeated row of id 3, links with what 3 links with.
    extra = int(near[3].sum())
    assert 0.98 * (there - (near[3].sum() - 1)) <= found - extra + 1 <= there + extra
    want = brute_components(list(range(730)), np.argwhere(near).tolist())
    assert sum(got[i][0].component == want[i] for i in range(730)) >= 720
    assert all(got[i][0].n_links == 0 and got[i][0].component == i for i in range(800, 806)) and len(got[3]) == 2
    assert itq.link(d.limit(0)).count() == 0


def test_embedding_recall_on_the_tables(spark):
    d = spark.read.parquet(f"{BIG}/embeddings.parquet")
    got = {r.id: r.n_links for r in itq.link(d.select("vec_id", "embedding")).collect()}
    p = d.toPandas()
    x = np.array(p["embedding"].tolist(), dtype=np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    want = dict(zip(p["vec_id"], (x @ x.T >= 0.9).sum(1) - 1, strict=True))
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())


def test_embedding_links_of_each_length(spark):
    rows = [(i, [1.0, i / 100, 0.0]) for i in range(5)] + [(10, [1.0, 1.0]), (11, [1.0, 1.1]), (12, [-1.0, 0.0]), (20, [3.0]), (21, [5.0]), (30, [1.0] * 7)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in itq.link(d).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {10: (1, 10), 11: (1, 10), 12: (0, 12), 20: (1, 20), 21: (1, 20), 30: (0, 30)}


def test_embedding_links_of_a_repeated_id_with_other_vectors(spark):
    v, v2, w, w2, far = [1.0, 0.02, 0.0], [1.0, 0.0, 0.0], [0.0, 0.02, 1.0], [0.0, 0.0, 1.0], [-1.0, 0.0, 0.0]
    rows = [(1, v), (1, w), (2, v2), (3, w2), (5, far), (5, far), (None, far), (None, [0.0, -1.0, 0.0]), (1, None)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "same", "name", "v", "copies")})
    got = collections.Counter((r.id, r.n_links, r.component) for r in itq.link(d).collect())
    assert got == collections.Counter({(1, 1, 1): 2, (2, 1, 1): 1, (3, 1, 1): 1, (5, 2, 5): 2, (None, 2, 5): 1, (None, 0, None): 1, (1, 0, 1): 1})


@pytest.mark.parametrize("n", [20_000, 1_000_000])
@pytest.mark.parametrize("common", [0.0, 0.75])
def test_near_vectors_meet_whatever_their_mean(common, n):
    rng = np.random.default_rng(5)
    unit = lambda a: a / np.sqrt((a * a).sum(-1, keepdims=True))
    mean = unit(rng.standard_normal(64)) * common**0.5
    own = unit(rng.standard_normal((1500, 64)))
    # Pairs near cosine 0.91 in every case; with a common mean their own parts are further apart.
    mate = unit(own + unit(rng.standard_normal(own.shape)) * (0.46 if common == 0 else 1.2))
    x, y = unit(mean + own * (1 - common) ** 0.5), unit(mean + mate * (1 - common) ** 0.5)
    near = (x * y).sum(1)
    near = (near >= 0.9) & (near < 0.93)
    assert near.sum() >= 300
    index = itq.Index(np.concatenate([x[~near], y[~near], x[near]]), 64, n)
    assert (index.keys(x[near]) == index.keys(y[near])).any(1).mean() >= 0.99


def test_vectors_close_to_their_mean_are_all_compared():
    rng = np.random.default_rng(6)
    x = np.eye(64)[0] + rng.standard_normal((500, 64)) * 0.02
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    index = itq.Index(x, 64, 100_000)
    keys = index.keys(x)
    assert all((keys == k).any(1).all() for k in keys)


def test_pipeline(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", None, None), (9001, "", "en", "s", 0), (None, "plain words in a row for once.", "en", "s", 5), (9002, "Mail a.b@mail1.example.com now, says the man in the house.", "en", "s", 1)], d.schema)
    docs = materialise(d.unionByName(extra))
    names, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, materialise(stage(spark, docs, SMALL))
        seen[name] = docs
        if k < 4:
            assert docs.columns == names
        if name == "quality":
            model = quality.learn(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
            assert docs.count() == quality.score(before, model, out="s").where(F.col("s") >= 0.3).count() < before.count()
        if name == "near_duplicates":
            want, _ = brute_near([(r.doc_id, r.text) for r in before.where("doc_id is not null").collect()], 5)
            assert sorted(r.doc_id for r in docs.where("doc_id is not null").collect()) == sorted({c for c in want.values()})
        if name == "private_data":
            assert docs.count() == before.count() and not docs.where("text like '%a.b@mail1%'").count()
        if name == "mixing":
            assert docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").where("doc_id is not null").count() == 0
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() == seen["mixing"].count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_each_text_of_repeated_and_null_ids_once(spark):
    rows = [(7, "a b c d e"), (7, "v w x y z"), (7, "a b c d e"), (9, "v w x y z"), (None, "a b c d e"), (None, "alone in here now"), (None, "alone in here now"), (None, None), (3, "V w x y z"), (8, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.text or "") for r in corpus_pipeline.deduplicate(spark, d, SMALL).collect())
    assert got == [(-1, ""), (-1, "alone in here now"), (3, "V w x y z"), (7, "a b c d e"), (8, "")]


def test_pipeline_stages_on_an_empty_table(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SMALL)
        assert d.count() == 0


def test_pipeline_beside_clashing_columns(spark):
    clash = ["_key", "key", "row", "size", "target", "source_size", "score", "_score", "spans", "n_email", "redrawn", "digest", "gone", "id", "_id", "n", "component", "bands", "copies", "bucket", "copy", "tie", "_t", "number"]
    plain = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = plain.withColumns({c: F.lit("clash") for c in clash})
    for name, stage in corpus_pipeline.STAGES:
        before = odd
        plain, odd = materialise(stage(spark, plain, SMALL)), materialise(stage(spark, odd, SMALL))
        if name != "token_ids":
            assert odd.columns == before.columns and odd.where(" and ".join(f"`{c}` = 'clash'" for c in clash)).count() == odd.count()
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, odd.select(*plain.columns).collect()), key=str)


def test_pipeline_order_of_rows_that_share_an_id(spark):
    rows = [(7, "a b c d e f", "x"), (7, "a b c d e f", "y"), (7, "A b c d e f", "z"), (None, "a b c d e f", "w"), (8, "q", None), (8, "q", "s")]
    kept = []
    for seed in (1, 2, 3):
        d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").orderBy(F.rand(seed)).repartition(4)
        kept.append(sorted(map(tuple, corpus_pipeline.deduplicate(spark, d, SMALL).collect()), key=str))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_pu_weights_hardly_depend_on_the_draw():
    rng = np.random.default_rng(1)
    toxic = rng.random(3000) < 0.2
    unl = (rng.random((3000, 40)) < np.where(toxic[:, None] & (np.arange(40) < 10), 0.6, 0.1)).astype(np.uint8)
    pos = (rng.random((300, 40)) < np.where(np.arange(40) < 10, 0.6, 0.1)).astype(np.uint8)
    told = [unl @ w + b >= 0 for w, b in (toxicity.nnpu(pos, unl, 0.2, steps=600, seed=s) for s in (1, 2, 3))]
    assert all((t == toxic).mean() > 0.95 for t in told)
    assert max((a != b).mean() for a in told for b in told) < 0.01


def test_pipeline_cuts_at_the_quantile_of_all_labelled(spark, monkeypatch):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, used = spark.read.parquet(f"{SMALL}/labels.parquet"), []
    score = quality.score
    monkeypatch.setattr(quality, "score", lambda docs, model, **named: used.append(model) or score(docs, model, **named))
    corpus_pipeline.classify(spark, d, SMALL)
    rows = d.join(labels, "doc_id").where(fold() != 0).collect()
    s = used[0].strength(np.array([quality.figures(r.text) for r in rows]))
    assert np.isclose(used[0].cut, np.quantile(s, np.mean([r.quality == 0 for r in rows])))
