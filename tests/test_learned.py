"""Beams down a tree, balanced codes, codebook starts, batch inference, windows of long users and documents, against plain versions."""

import datetime
import itertools
import json
import math
import pathlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import profile, sid
from waymark.models import Trie, conversation, generated, rendered, template_arguments
from waymark.operators import balanced, decoding, places, quantise, ranking, sampling, seeding, semantic, sequences, traces
from waymark.plans import runs
from waymark.plans.meaning import trained_codes
from waymark.session import read_config, shared_dir, write_config
from waymark.sources import documents, files
from waymark.streaming import steps

SEQUENCES = [[0, 1], [0, 1, 2], [0, 3], [1, 1, 1], [1, 1, 2], [2], [2, 0, 0, 1], [3, 2]]


class Tabled:
    """Log-probabilities by path and token, the same for the tree and the plain version."""

    def __init__(self, seed):
        self.seed = seed

    def one(self, context, path, token):
        return math.log(0.01 + np.random.default_rng([self.seed, context, *path, token, len(path)]).random())

    def __call__(self, contexts, tree, context, node, child):
        def path(n):
            out = []
            while n > 0:
                out.append(int(tree.token[n]))
                n = tree.parent[n]
            return out[::-1]

        return np.array([self.one(contexts[c], path(n), int(tree.token[x])) for c, n, x in zip(context, node, child, strict=True)])


def test_tree_holds_each_answer_once():
    t = decoding.Tree([*SEQUENCES, [2], []])
    assert len(t) == len(SEQUENCES) and [list(r) for r in t.rows] == sorted(SEQUENCES)
    for i, r in enumerate(t.rows):
        node = 0
        for token in r:
            node = next(n for n in range(t.first[node], t.last[node]) if t.token[n] == token)
        assert t.answer[node] == i
    with pytest.raises(ValueError, match="no answer"):
        decoding.Tree([[]])


@pytest.mark.parametrize("width", [1, 2, 3, 8])
def test_beams_of_a_batch_are_those_of_each_prompt(width):
    tree, s = decoding.Tree(SEQUENCES), Tabled(4)

    def plain(context, k):
        live, done = [(0.0, ())], []
        while live:
            grown = sorted(((total + s.one(context, p, t), (*p, t)) for total, p in live for t in {q[len(p)] for q in SEQUENCES if tuple(q[: len(p)]) == p and len(q) > len(p)}), key=lambda x: (-round(x[0], 9), x[1]))[:width]
            done += [(total, p) for total, p in grown if list(p) in SEQUENCES]
            live = grown
        return [list(p) for _, p in sorted(done, key=lambda x: (-round(x[0], 9), x[1]))[:k]]

    got = decoding.beams([5, 6, 7], tree, s, 3, width)
    assert [[list(tree.rows[i]) for i in one] for one in got] == [plain(c, 3) for c in (5, 6, 7)]
    assert decoding.beams([], tree, s, 3) == []


def test_wide_beams_find_the_best_of_all():
    tree, s = decoding.Tree(SEQUENCES), Tabled(9)
    score = lambda q: sum(s.one(1, q[:i], q[i]) for i in range(len(q)))
    best = sorted(sorted(SEQUENCES), key=lambda q: -score(q))[:4]
    assert [list(tree.rows[i]) for i in decoding.beams([1], tree, s, 4)[0]] == best
    by_token = lambda prefix: {t: s.one(1, prefix, t) for t in range(4)}
    whole = [q for q in SEQUENCES if not any(o != q and o[: len(q)] == q for o in SEQUENCES)]  # where no end has to be scored
    tree = decoding.Tree(whole)
    assert [list(tree.rows[i]) for i in decoding.beams([1], tree, s, 3)[0]] == Trie(whole).beams(by_token, 3)


def test_decoded_frames(spark):
    space = spark.createDataFrame([("<a_1><b_2><c_3>",), ("<a_1><b_2><c_4>",), ("<a_2><b_1><c_1><d_0>",), ("<a_1><b_2><c_3>",)], "target string").withColumn("tokens", sid.segments(F.col("target")))
    vocabulary, tree = decoding.answers(space, "tokens")
    scorer = decoding.PathCounts(vocabulary, tree, {"x": {(): 9, ("<a_2>",): 9, ("<a_2>", "<b_1>"): 9}})
    d = spark.createDataFrame([(1, "x", "old"), (2, "unknown", "old")], "id int, context string, prediction string")
    got = {r.id: r.prediction.split() for r in decoding.decoded(d, "context", vocabulary, tree, scorer, 5).collect()}
    assert got[1][0] == "<a_2><b_1><c_1><d_0>" and len(got[1]) == 3 and got[2] == ["<a_2><b_1><c_1><d_0>", "<a_1><b_2><c_3>", "<a_1><b_2><c_4>"]
    assert decoding.decoded(d.limit(0), "context", vocabulary, tree, scorer).count() == 0


def test_batch_inference_writes_what_evaluation_reads(spark, tmp_path):
    sids = [f"<a_{i}><b_1><c_1>" for i in range(12)]
    bank = spark.createDataFrame([(f"s{i:02}", i, "sid", "test" if i < 6 else "train", sids[i], "2024-01-01 08:00", "seen", "seen", "c") for i in range(12)], "sample_id string, uid int, repr string, split string, target string, target_time string, input_text string, key_text string, context string")
    scorer = lambda v, t: decoding.PathCounts(v, t, {"c": {(): 5, ("<a_3>",): 5, ("<a_3>", "<b_1>"): 5, ("<a_3>", "<b_1>", "<c_1>"): 5}})
    path = str(tmp_path / "predictions" / "p.jsonl")
    told = runs.run_inference(bank, "sid", path, scorer, bank.select("target"), sid.segments, context="context", limit=4, metadata={"dataset": "d"})
    assert told["num_samples"] == 4 and told["candidate_space_size"] == 12 and told["dataset"] == "d" and files.read_json(runs.metadata_path(path)) == told
    rows = {r.sample_id: r for r in spark.read.json(path).collect()}
    assert sorted(rows) == ["s00", "s01", "s02", "s03"] and all(r.prompt and r.prompt_char_length == len(r.prompt) and len(r.parsed_predictions) == 10 and r.parsed_predictions[0] == sids[3] for r in rows.values())
    out = runs.run_evaluation(spark, path)
    assert out["metadata"]["dataset"] == "d" and out["metrics"]["num_samples"] == 4 and out["metrics"]["correct_at_1"] == 1
    with pytest.raises(ValueError, match="jsonl"):
        runs.run_inference(bank, "sid", "p.json", scorer, bank.select("target"), sid.segments)


def test_choices_from_lists_are_those_from_all(spark):
    class Last:
        def generate(self, prompts, candidates, k):
            return [max(c, key=lambda x: (hash_of(p, x), x)) for p, c in zip(prompts, candidates, strict=True)]

    def hash_of(p, x):
        return sum(ord(a) * (i + 7) for i, a in enumerate(p + x)) % 17

    d = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "i int, prompt string")
    space = spark.createDataFrame([(f"c{i}",) for i in range(23)] + [(None,)], "c string")
    want = {r.i: r.prediction for r in generated(d, "prompt", sorted(f"c{i}" for i in range(23)), 1, Last()).collect()}
    for most in (4, 23, 100):
        got = runs.chosen(d, "prompt", space, Last(), most)
        assert got.columns == ["i", "prompt", "prediction"] and {r.i: r.prediction for r in got.collect()} == want


def crowded(n=400, k=8, seed=0):
    rng = np.random.default_rng(seed)
    book = np.linalg.qr(rng.normal(size=(k, k)))[0]
    x = book[rng.choice(k, n, p=[0.65] + [0.05] * (k - 1))] + rng.normal(0, 0.25, (n, k))
    return x / np.linalg.norm(x, axis=1, keepdims=True), book


def test_balanced_codes(spark):
    x, book = crowded()
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>").repartition(5)
    got = np.array([r.code for r in balanced.balanced(d, book, 0.05, 60).orderBy("id").collect()])
    plain = (x @ book.T).argmax(1)
    assert np.bincount(plain, minlength=8).max() > 200 and np.bincount(got, minlength=8).max() < 80 and np.bincount(got, minlength=8).min() > 30
    assert (got == quantise.sinkhorn(-(x @ book.T), 0.05, 60)).mean() > 0.99
    assert [r.code for r in balanced.balanced(d, book, 0.05, 0).orderBy("id").collect()] == plain.tolist()


def test_balanced_codes_of_odd_vectors(spark):
    x, book = crowded(40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, [float("nan")] * 8)]
    got = {r.id: r.code for r in balanced.balanced(spark.createDataFrame(rows, "id int, vec array<double>"), book, 0.05, 9).collect()}
    assert [got[i] for i in range(40)] == (x @ book.T).argmax(1).tolist() and 0 <= got[99] < 8
    assert balanced.balanced(spark.createDataFrame([], "id int, vec array<double>"), book).count() == 0


def loss(x, centres):
    return seeding.squares(x, centres).min(1).mean()


def test_a_start_is_near_that_of_plain_draws(spark):
    rng = np.random.default_rng(2)
    means = rng.normal(0, 10, (12, 6))
    x = np.concatenate([m + rng.normal(0, 0.5, (n, 6)) for m, n in zip(means, [400] + [12] * 11, strict=True)])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>").repartition(4)
    got = seeding.start(d, 12)
    plain = min(loss(x, seeding.weighted_start(x, np.ones(len(x)), 12, s)) for s in range(5))
    assert got.shape == (12, 6) and loss(x, got) < 1.5 * plain and len(set(seeding.squares(x, got).argmin(1))) == 12
    assert (seeding.start(d.repartition(2), 12) == got).all()
    near = seeding.nearest(d, got).orderBy("id").collect()
    assert [r.code for r in near] == seeding.squares(x, got).round(9).argmin(1).tolist()


def test_a_start_of_few_distinct_vectors(spark):
    d = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(60)], "id int, vec array<double>")
    assert sorted(map(tuple, seeding.start(d, 5).tolist())) == [(0.0, 1.0), (1.0, 1.0), (2.0, 1.0)]
    with pytest.raises(ValueError, match="no vectors"):
        seeding.start(d.limit(0), 3)


def test_trained_codes_of_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    sound = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 4)))]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0])]
    coded = {}
    for name, rows in (("all", sound + odd), ("odd", odd), ("none", [])):
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        coded[name] = {r.pid: r.sid_token for r in trained_codes(spark, f"{tmp_path}/{name}").collect()}
    assert set(coded["all"]) == {i for i, _ in sound + odd} and {i for i, t in coded["all"].items() if t is None} == {i for i, _ in odd}
    assert len({t for t in coded["all"].values() if t}) == 60
    assert coded["odd"] == dict.fromkeys(range(100, 105)) and coded["none"] == {}


def test_trained_codes_of_vectors_of_other_lengths(spark, tmp_path):
    rng = np.random.default_rng(5)
    most = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((40, 4)))]
    others = [(100, [1.0]), (101, [1.0, 2.0, 3.0]), (102, [0.5] * 8), (103, None)]
    coded = {}
    for name, rows in (("most", most), ("all", most + others), ("tie", [(1, [1.0, 0.0]), (2, [1.0])])):
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        coded[name] = {r.pid: r.sid_token for r in trained_codes(spark, f"{tmp_path}/{name}").collect()}
    assert coded["all"] == coded["most"] | dict.fromkeys(range(100, 104)) and all(coded["most"].values())
    assert coded["tie"][1] is None and coded["tie"][2]


def test_sums_by_code_take_one_plan_for_any_length(spark, monkeypatch):
    calls, plain = [], F.sum
    monkeypatch.setattr(F, "sum", lambda *a: calls.append(a) or plain(*a))
    asked = set()
    for d in (3, 16, 300):
        rng, n = np.random.default_rng(d), len(calls)
        x, book = rng.standard_normal((70, d)), rng.standard_normal((5, d))
        frame = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(3)
        for unit in (False, True):
            total, used = quantise.code_sums(frame, book, unit=unit)
            c = (x @ book.T).argmax(1)
            want = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x
            assert used.tolist() == np.bincount(c, minlength=5).tolist() and np.allclose(total, [want[c == i].sum(0) for i in range(5)])
        asked.add(len(calls) - n)
    assert len(asked) == 1


def test_training_with_tasks_that_have_no_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((20, 3))
    whole = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>").coalesce(1)
    some = whole.unionByName(whole.where("id < 0")).unionByName(spark.createDataFrame([], whole.schema))
    assert [r.n for r in some.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n")).collect()] == [20] and some.rdd.getNumPartitions() > 1
    total, used = quantise.code_sums(some, np.eye(3))
    assert used.sum() == 20 and np.allclose(total.sum(0), x.sum(0))
    assert seeding.start(some, 4).shape == (4, 3) and seeding.nearest(some, np.eye(3)).count() == 20
    coded = quantise.assign(some, [np.eye(3)] * 2).select("id", "indices").collect()
    assert {r.id: r.indices for r in coded} == {r.id: r.indices for r in quantise.assign(whole, [np.eye(3)] * 2).collect()} and len(coded) == 20


def test_trained_codes_where_splits_have_no_row_group(spark, tmp_path):
    rng = np.random.default_rng(7)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))], "vec_id bigint, embedding array<double>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {k: spark.conf.get(k) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "4k")  # one row group over several splits
        got = trained_codes(spark, str(tmp_path)).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {r.pid for r in got} == set(range(300)) and len({r.sid_token for r in got}) == 300


def test_vectors_of_different_lengths_are_an_error(spark):
    d = spark.createDataFrame([([1.0],), ([1.0, 2.0, 3.0],)], "vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="vectors of different lengths"):
        quantise.code_sums(d, np.ones((2, 2)))


def test_training_leaves_no_files(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 3)))], "id bigint, vec array<double>")
    at = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in at.glob("cut-*")}
    quantise.train(d, levels=2, k=4, rounds=2, first_rounds=2)
    assert {p.name for p in at.glob("cut-*")} == before


def test_windows_of_a_user_with_many_events(spark):
    d = spark.range(200_000).select(F.lit(1).alias("uid"), (F.col("id") % 7).alias("pid"), F.col("id").cast("string").alias("t"), "id")
    d = d.unionAll(spark.range(30).select(F.lit(2), "id", F.col("id").cast("string"), "id")).unionAll(spark.range(51).select(F.lit(3), "id", F.col("id").cast("string"), "id"))
    every, held = sequences.gathered(d, "uid", "pid", "id", "id"), sequences.gathered(d, "uid", "pid", "id", "id", most=80)
    assert held.agg(F.max(F.size("p"))).first()[0] == 80 and {r.uid: r.before for r in held.collect()} == {1: 199_920, 2: 0, 3: 0}
    same = lambda f: [sorted(map(str, f(s).collect())) for s in (every, held)]
    a, b = same(sequences.train_windows)
    assert a == b and len(a) == 6
    few = sequences.gathered(d, "uid", "pid", "id", "id", most=51)
    a, b = sorted(map(str, sequences.eval_windows(every).collect())), sorted(map(str, sequences.eval_windows(few).collect()))
    assert a == b and len(a) == 6
    plan = held._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_steps_of_a_user_with_all_the_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(None if i % 50 == 0 else 1 if i % 3 else int(rng.integers(2, 6)), int(rng.integers(0, 5)) if i % 7 else None, i // 2, i) for i in range(3000)]
    d = spark.createDataFrame(rows, "uid int, pid int, time_dt int, seq int").repartition(6)
    plain = d.select("uid", F.col("pid").alias("a"), F.lead("pid").over(Window.partitionBy("uid").orderBy("time_dt", "seq")).alias("b"), "time_dt", "seq")
    assert sorted(map(str, places.followed(d).collect())) == sorted(map(str, plain.collect()))
    plan = places.followed(d)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Window " in line and "_part" not in line]  # one over the ranges' sizes only


@pytest.mark.parametrize("shape", ["spread", "equal", "crowded", "one"])
def test_medians_without_gathering_a_group(spark, shape):
    rng = np.random.default_rng(4)
    make = {"spread": lambda n: rng.random(n), "equal": lambda n: np.full(n, 1 / 3), "crowded": lambda n: 0.5 + rng.random(n) * 1e-11, "one": lambda n: np.ones(n)}[shape]
    groups = {("a", "x"): make(4001), ("a", "y"): make(4000), ("b", "x"): make(1), ("b", "y"): make(2)}
    d = spark.createDataFrame([(*k, float(v)) for k, vs in groups.items() for v in vs], "level string, field string, s double").repartition(5)
    got = {(r.level, r.field): r["median"] for r in semantic.medians(d, ["level", "field"], "s").collect()}
    assert got == {k: pytest.approx(float(np.median(v)), abs=1e-15) for k, v in groups.items()}


@pytest.mark.parametrize("shape", ["clusters", "spread", "copies"])
def test_retrieval_by_blocks_is_that_of_all_pairs(spark, shape):
    rng = np.random.default_rng(8)
    means = rng.normal(size=(12, 16))
    x = {"clusters": lambda: means[rng.integers(0, 12, 900)] + rng.normal(0, 0.03, (900, 16)), "spread": lambda: rng.normal(size=(900, 16)), "copies": lambda: means[rng.integers(0, 3, 900)]}[shape]()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    when = rng.integers(0, 50, 900)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=int(h)) if i % 41 else None, v.tolist()) for i, (h, v) in enumerate(zip(when, x, strict=True))]
    d = spark.createDataFrame(rows, "id bigint, time timestamp_ntz, vec array<double>").repartition(4)
    report = {}
    got = {}
    for r in ranking.causal_topk(d.where("id % 7 = 0"), d, 3, block=40, report=report).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.key_id, r.score))
    s = (x @ x.T).round(9)
    for i in range(0, 900, 7):
        able = [j for j in range(900) if j % 41 and i % 41 and when[j] < when[i] and j != i]
        want = sorted(able, key=lambda j: (-s[i, j], j))[:3]
        assert [(k, s[i, k]) for _, k, _ in sorted(got.get(i, []))] == [(j, pytest.approx(s[i, j], abs=1e-8)) for j in want], i
    assert report["scored"] <= report["pairs"] and (shape != "clusters" or report["scored"] < 0.7 * report["pairs"])
    assert ranking.causal_topk(d.limit(0), d, 3).count() == 0 and ranking.causal_topk(d, d.limit(0), 3).count() == 0


def templates():
    class Template:
        def __init__(self, known=(), broken=False):
            self.known, self.broken = known, broken

        def apply_chat_template(self, messages, **arguments):
            if self.broken:
                raise RuntimeError("no template")
            for a in arguments:
                if a not in self.known:
                    raise TypeError(f"got an unexpected keyword argument '{a}'")
            return f"{len(messages)} {sorted(arguments)} {messages[-1]['content']}"

    return Template


def test_conversations_by_template(spark):
    Template = templates()  # a class of its own goes to the workers by value
    d = spark.createDataFrame([(1, [("system", "be"), ("user", "hi")]), (2, [])], "id int, m array<struct<role:string,content:string>>")
    told = {"enable_thinking": False}
    said = lambda *a: {r.id: r.prompt for r in rendered(d.where("id = 1 or true").where(F.size("m") > (0 if a and a[0] else -1)), "m", *a).collect()}
    assert said() == {1: "[SYSTEM]\nbe\n\n[USER]\nhi\n\n[ASSISTANT]\n", 2: "[ASSISTANT]\n"}
    assert said(Template(("enable_thinking",)), told)[1] == "2 ['enable_thinking'] hi" and said(Template(), told)[1] == "2 [] hi"
    assert said(Template(broken=True), told)[1] == "[SYSTEM]\nbe\n\n[USER]\nhi\n\n[ASSISTANT]\n"
    assert template_arguments({"enable_thinking": 1}) == {"enable_thinking": True} and template_arguments({"chat_template_kwargs": {"enable_thinking": 0, "x": 1}, "enable_thinking": True}) == {"enable_thinking": 0, "x": 1}

    class Strict(Template):
        def apply_chat_template(self, messages):
            raise TypeError("messages must be text")

    with pytest.raises(TypeError, match="must be text"):
        conversation([{"role": "user", "content": "x"}], Strict())


def test_json_objects_with_any_keys(spark):
    rows = [(' {"b": 1, "a": [2]}\n', '{"a":[2],"b":1}'), ("[1]", None), ("3", None), ('"x"', None), ("{", None), ("null", None), (None, None), ("{}", "{}")]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r.x for r in d.select("i", F.to_json(profile.parsed(F.col("t"))).alias("x")).orderBy("i").collect()] == [x for _, x in rows]


def test_neighbours_in_the_bank(spark):
    bank = spark.createDataFrame([("a", "id", "k", "t"), ("a", "sid", "ks", "ts"), ("b", "id", "kb", "tb"), ("b", "id", "kb", "ta")], "sample_id string, repr string, key_text string, target string")
    similar = spark.createDataFrame([("q", "a", 1), ("q", "none", 2), ("q", "b", 3), ("q", "a", 4)], "query_id string, key_id string, rank int")
    got = sorted(map(tuple, runs.neighbour_rows(similar, bank, "id", 3).collect()))
    assert got == [("q", 1, "k", "t"), ("q", 3, "kb", "tb")] and {r.sample_id for r in runs.bank_map(bank, "id").collect()} == {"a", "b"}


@pytest.mark.parametrize("cuts", [(0, 1, 8, 9, 30, 31, 95), (0, 95), (0, 40, 41, 42, 43, 95)])
def test_streamed_steps_are_those_of_a_batch(spark, tmp_path, cuts):
    rng = np.random.default_rng(6)
    rows = [("r" if i % 4 else "q", i // 2, i % 2, i, float(rng.random()) if i % 9 else None) for i in range(95)]
    schema = "run string, time_ns bigint, pid bigint, local_record_index bigint, total_reward double"
    for a, b in itertools.pairwise(cuts):  # a start for each cut: what came before is in the checkpoint
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        steps.start(steps.step_stream(stream, 8), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = steps.latest(spark.read.parquet(str(tmp_path / "out")))
    for run in "rq":
        own = spark.createDataFrame([r for r in rows if r[0] == run], schema)
        want = sorted(map(tuple, traces.steps(traces.ordered(own), 8).collect()))
        have = sorted(map(tuple, got.where(F.col("run") == run).drop("run").collect()))
        assert len(have) == len(want) and all(h == pytest.approx(w, abs=1e-9) for h, w in zip(have, want, strict=True))
    with pytest.raises(ValueError, match="one row or more"):
        steps.step_stream(got, 0)


def test_small_documents_on_a_file_system_by_uri(spark, tmp_path):
    uri = f"file://{tmp_path}/deep/er/manifest.json"
    assert not documents.exists(uri)
    files.write_json(uri, {"é": [1, "x\n"]})
    files.write_json(uri, {"é": [2, "😀"]})
    assert files.read_json(uri) == {"é": [2, "😀"]} and (tmp_path / "deep/er/manifest.json").read_text().startswith('{\n  "é"')
    assert [p.name for p in (tmp_path / "deep/er").iterdir() if not p.name.endswith(".crc")] == ["manifest.json"]
    for at in (f"file://{tmp_path}/a/c.yaml", str(tmp_path / "b/c.yaml")):
        write_config(at, {"b": 1, "a": {"é": [1]}})
        assert read_config(at) == {"b": 1, "a": {"é": [1]}} and list(read_config(at)) == ["b", "a"]
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        files.read_json(f"file://{tmp_path}/none.json")


def test_sid_maps_of_all_forms(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"7": {"sid_token": "<a_1>", "more": [1]}, "8": {"sid_token": "<a_2>"}}, indent=1))
    assert {r.pid: r.sid_token for r in files.read_sid_map(spark, str(tmp_path / "m.json")).collect()} == {7: "<a_1>", 8: "<a_2>"}
    (tmp_path / "m.csv").write_text('pid,sid_token,sid_indices,sid\n1,,"[np.int64(4), 2]",\n2,,,"[1, 2, 3]"\n3,<x>,[9],\n')
    assert {r.pid: r.sid_token for r in files.read_sid_map(spark, str(tmp_path / "m.csv")).collect()} == {1: "<a_4><b_2>", 2: "<a_1><b_2><c_3>", 3: "<x>"}
    (tmp_path / "bad.csv").write_text("pid,sid_token,sid_indices,sid\n5,,,\n")
    with pytest.raises(Exception, match="no semantic ID"):
        files.read_sid_map(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "list.json").write_text("[1, 2]")
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_sid_map(spark, str(tmp_path / "list.json")).collect()


def test_a_mix_of_nothing_is_empty(spark):
    d = spark.createDataFrame([], "sample_id string, x int")
    assert sampling.mixed({"a": d, "b": d}, (("a", 0.5), ("b", 0.5))).count() == 0


def test_profiles_of_long_categories(spark):
    d = spark.range(1).select(F.repeat(F.lit("ab"), 1_000_000).alias("c"))
    got = d.select(profile.to_json("a", F.col("c")).alias("j")).first().j
    assert json.loads(got) == {"category": "ab" * 1_000_000}
    assert d.select(sid.prefix(F.lit("<a_1><b_2><c_3><d_4>"), "full_sid").alias("x")).first().x == "<a_1><b_2><c_3><d_4>"


def test_counts_of_paths_score_what_they_say():
    v = decoding.Vocabulary(list("abc"))
    tree = decoding.Tree([[v.number[x] for x in p] for p in ("ab", "ac", "b")])
    s = decoding.PathCounts(v, tree, {"q": {(): 4, ("a",): 3, ("a", "c"): 2}})
    total = {"".join(v.tokens[x] for x in tree.rows[i]): None for i in decoding.beams(["q"], tree, s, 3)[0]}
    want = {"ac": (4 / 6) * (3 / 5), "ab": (4 / 6) * (1 / 5), "b": 1 / 6}
    assert list(total) == sorted(want, key=lambda x: -want[x]) and len(list(itertools.chain(total))) == 3
