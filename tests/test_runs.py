"""Prepared samples, builds, evaluations, exports, rewards, models and configuration."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import models, session
from waymark.functions import reward
from waymark.operators import quantise, ranking, sampling
from waymark.plans import builders, report, runs
from waymark.sources import files


def windows(spark):
    rows = [(u, 3 - back, [1, 2, 3 - back], ["2024-01-01 08:00", "2024-01-01 09:00", "2024-01-02 08:00"], 4, "2024-01-03 08:00") for u in (2, 1) for back in (0, 1)]
    return spark.createDataFrame(rows, "uid bigint, end int, pids array<bigint>, times array<string>, target bigint, target_time string")


def sid_frame(spark, n=12):
    return spark.createDataFrame([(i, f"<a_{i % 3}><b_{i % 5}><c_{i}>") for i in range(n)], "pid bigint, sid_token string")


def test_prepared_samples_of_each_kind_split_and_source(spark):
    w = {"train": windows(spark), "test": windows(spark).where("end = 3")}
    past = spark.createDataFrame([(1, "User_1 visited: <9> at long ago")], "uid bigint, history string")
    got = runs.prepared(w, 2, sid_frame(spark), {"id": past})
    assert len(got) == 12 and set(runs.prepared(w, 2)) == {k for k in got if k[0] == "id"}
    s = got["sid", "train"].orderBy("row_index").collect()
    assert [(r.sample_id, r.target, len(r.observed_pids)) for r in s] == [(f"train-0000{k}-u{u}", "<a_1><b_4><c_4>", 2) for k, u in enumerate((1, 1, 2, 2))]
    assert s[0].key_text == "User_1 visited: <a_2><b_2><c_2> at 2024-01-01 09:00, <a_0><b_3><c_3> at 2024-01-02 08:00"
    texts = {r.sample_id: r.input for r in got["id", "test", "original"].collect()}
    assert "<9> at long ago" in texts["test-00000-u1"] and "No historical trajectory is available." in texts["test-00001-u2"]
    with pytest.raises(Exception, match="without a semantic ID"):
        runs.prepared({"test": w["test"]}, 2, sid_frame(spark, 3))


def test_warmup_and_chat_builds_count_training_targets_alone(spark):
    s = runs.prepared({"train": windows(spark), "val": windows(spark)}, 2, sid_frame(spark))
    out, m = runs.warmup_build(s["sid", "train"], s["sid", "val"].withColumn("target", F.lit("<a_2><b_1><c_11>")), sid_frame(spark))
    assert (m["num_train"], m["num_valid"], m["sid_space_size"]) == (4, 4, 12)
    first = out["valid"].first().ranked_targets
    assert len(first) == 10 and first[0] == "<a_2><b_1><c_11>" and first.index("<a_1><b_4><c_4>") < 5
    with pytest.raises(ValueError):
        runs.warmup_build(s["sid", "train"], s["sid", "val"], sid_frame(spark, 9))
    chat, m = runs.chat_build(s["sid", "train"], s["sid", "val"])
    assert m["num_train"] == 4 and chat["valid"].first().repr == "sid"


def test_bank_rows_and_sanity_of_the_similar_map(spark):
    rows = [(f"{s}-{i}", s, k, f"2024-01-0{i} 08:00", f"text {i}", f"text {i}", f"<{i}>") for s in ("train", "test") for k in ("id", "sid") for i in (1, 2, 3)]
    bank = spark.createDataFrame(rows, "sample_id string, split string, repr string, target_time string, key_text string, query_text string, target string")
    assert runs.bank_rows(bank, "train", "id").count() == 3 and [r.target for r in runs.candidate_space(bank, "sid").collect()] == ["<1>", "<2>", "<3>"]
    assert runs.checked_similar_map(bank, "test", "id", 5).count() == 3
    for split, kind in (("val", "id"), ("test", "no")):
        with pytest.raises(ValueError):
            runs.checked_similar_map(bank, split, kind)

    class Across:
        dimension = 2

        def encode(self, texts):
            return np.array([[1.0, 0.0] if self.first else [0.0, 1.0]] * len(texts))

    with pytest.raises(ValueError):
        runs.checked_similar_map(bank.withColumn("key_text", F.lit("k")), "test", "id", encoder=type("E", (), {"dimension": 2, "encode": lambda self, ts: np.array([[1.0, 0.0] if t == "k" else [0.0, 1.0] for t in ts])})())


def test_retrieval_in_many_blocks_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, f"2024-01-0{1 + i % 3} {i % 24:02d}:00:00", v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, "id bigint, time string, vec array<double>").withColumn("time", F.col("time").cast("timestamp"))
    got = collections.defaultdict(list)
    for r in ranking.causal_topk(d.where("id % 2 = 0"), d, 4, block=17).orderBy("rank").collect():
        got[r.query_id].append(r.key_id)
    for i in range(0, 300, 2):
        earlier = sorted((-round(float(x[i] @ x[j]), 9), j) for j in range(300) if rows[j][1] < rows[i][1] and j != i)
        assert got[i] == [j for _, j in earlier[:4]]


def test_weighted_draws_follow_their_weights(spark):
    d = spark.createDataFrame([(f"x{i}", 1.0 if i < 5 else 0.1) for i in range(105)], "sample_id string, weight double")
    got = sampling.with_replacement(d, "sample_id", 6000, 3, F.col("weight")).groupBy("sample_id").count().collect()
    heavy = sum(r["count"] for r in got if int(r.sample_id[1:]) < 5)
    assert sum(r["count"] for r in got) == 6000 and abs(heavy - 2000) < 150
    assert sampling.with_replacement(d.limit(0), "sample_id", 5, 3).count() == 0
    again = [sorted(map(tuple, sampling.with_replacement(x, "sample_id", 50, 3, F.col("weight")).collect())) for x in (d, d.repartition(7))]
    assert again[0] == again[1] and len(again[0]) == 50


def semantic_frame(spark):
    rows = [(i, f"<a_{i % 3}><b_{i % 4}><c_{i % 6}><d_{i}>", f"<a_{i % 3}>", f"<a_{i % 3}><b_{i % 4}>", f"<a_{i % 3}><b_{i % 4}><c_{i % 6}>", f"cat{i % 2}" if i < 20 else "rare", str(i % 3), f"G{i % 4}_1") for i in range(24)]
    return spark.createDataFrame(rows, "pid bigint, full_sid string, a string, ab string, abc string, category string, region string, geo_bucket string")


def test_alignment_build_and_evaluation(spark):
    out = builders.alignment(semantic_frame(spark), 0.25)
    counts = {(r.table, r.task_type): r.n for r in out["task_counts"].collect()}
    assert counts["train_phase_b1", "full_sid_to_abc_profile"] + counts["train_phase_b1", "abc_to_abc_profile"] == out["train_phase_b1"].count() and "weight" not in out["train_phase_b2"].columns
    assert not {r.source_abc for r in out["train_phase_a"].collect()} & {r.source_abc for r in out["valid_phase_a"].collect()}
    m, rows = runs.alignment_evaluation(out["valid_phase_b2"], "abc_profile_to_abc")
    assert m.first().valid_prefix_rate == 1.0 and rows.where("valid_prefix").count() == m.first().num_samples
    m, rows = runs.alignment_evaluation(out["valid_phase_b2"], "sid_to_abc_profile", limit=3)
    assert (m.first().num_samples, m.first().valid_rate, m.first().unique_profiles) == (3, 1.0, 1) and rows.where("valid_profile").count() == 3
    with pytest.raises(ValueError):
        runs.alignment_evaluation(out["valid_phase_b2"], "no such task")
    with pytest.raises(ValueError):
        builders.alignment(semantic_frame(spark).limit(0))


def test_evaluations_from_files_to_the_summary(spark, tmp_path):
    rows = [{"sample_id": "a", "repr": "id", "prediction": "<2> <2> <3>", "target": "<3>", "prompt": "four"}, {"sample_id": "b", "repr": "id", "prediction": "none", "target": "<3>", "prompt": "hm"}]
    (tmp_path / "out" / "pred").mkdir(parents=True)
    (tmp_path / "out" / "pred" / "p.json").write_text(json.dumps({"metadata": {"repr": "id", "history_source": "current"}, "samples": rows}))
    (tmp_path / "out" / "pred" / "bare.json").write_text(json.dumps(rows))
    got = runs.run_evaluation(spark, str(tmp_path / "out" / "pred" / "p.json"))
    assert got["metrics"]["acc_at_1"] == 0.0 and got["metrics"]["acc_at_5"] == 0.5 and got["metrics"]["avg_prompt_char_length"] == 3.0
    where = tmp_path / "out" / "eval" / "eval_id_current.json"
    assert json.loads(where.read_text())["metrics"] == got["metrics"]
    back = spark.read.json(str(where).replace(".json", "_samples")).orderBy("sample_id").collect()
    assert [(r.parsed_predictions, r.top1_correct, r.top5_correct) for r in back] == [(["<2>", "<3>"], False, True), ([], False, False)]
    assert runs.run_evaluation(spark, str(tmp_path / "out" / "pred" / "bare.json"), str(tmp_path / "out" / "eval" / "bare.json"), "id")["metrics"] == got["metrics"]
    assert files.summarise(spark, str(tmp_path / "out" / "eval"), str(tmp_path / "out" / "s.md")) == 2
    text = (tmp_path / "out" / "s.md").read_text().splitlines()
    assert text[0] == "# Evaluation Summary" and text[4] == "| bare | - | - | 2 | 0.0000 | 0.5000 | 0.5000 | 3.0 | 0.0000 |" and text[5].startswith("| eval_id_current | id | current | 2 |")


def test_rewards_by_name_value_and_file(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([("s1", "<a_1><b_1><c_1>", "<a_1><b_1><c_1>"), ("s2", "none", "<a_1><b_1><c_1>")], "sample_id string, prediction string, ground_truth string")
    by = lambda x: {r.sample_id: r.reward for r in x.collect()}
    plain = by(reward.scored(d))
    assert plain == by(reward.scored(d, truth=F.lit("<a_1><b_1><c_1>"))) == by(reward.scored(d, truth="<a_1><b_1><c_1>", name="environment")) and plain["s1"] > plain["s2"]
    with pytest.raises(KeyError):
        reward.scored(d, name="unknown")
    (tmp_path / "own.py").write_text("def compute_score(source, answer, truth, extra_info=None):\n    return len(answer) + len(source) + 100 * (extra_info['sample_id'] == 's2') + (extra_info['target'] == truth)\n")
    monkeypatch.setenv(reward.PATH_VARIABLE, str(tmp_path / "own.py"))
    assert by(reward.scored(d, name="environment", source="ab")) == {"s1": 18.0, "s2": 107.0}
    monkeypatch.setenv(reward.NAME_VARIABLE, "missing")
    with pytest.raises(AttributeError):
        reward.scored(d, name="environment")


def test_trace_records_are_gated_and_never_raise(spark, tmp_path, monkeypatch):
    monkeypatch.delenv(files.TRACE_VARIABLE, raising=False)
    files.record_trace({}, {"total_reward": 1.0})
    monkeypatch.setenv(files.TRACE_VARIABLE, str(tmp_path / "t"))
    monkeypatch.setenv(files.GROUP_VARIABLE, "8")
    files.record_trace({"uid": 7, "other": 1}, {"total_reward": 1.0, "odd": {1: (2, {3})}})
    row = json.loads(next((tmp_path / "t").glob("*.jsonl")).read_text())
    assert (row["uid"], row["group_size_hint"], row["odd"]) == (7, 8, {"1": [2, "{3}"]}) and "other" not in row
    (tmp_path / "f").write_text("")
    monkeypatch.setenv(files.TRACE_VARIABLE, str(tmp_path / "f"))
    files.record_trace({}, {})


def test_report_files(spark, tmp_path):
    d = spark.createDataFrame([(i, 1, i, 4, float(i % 5)) for i in range(10)], "time_ns bigint, pid bigint, local_record_index bigint, group_size_hint bigint, total_reward double")
    s = report.write(d, str(tmp_path / "t.jsonl"))
    assert (s["synthetic_step_count"], s["group_size"], s["last_step"], s["last_step_mean_total_reward"]) == (3, 4, 3, 3.5)
    assert json.loads((tmp_path / "report.summary.json").read_text()) == s and spark.read.option("header", "true").csv(s["csv_path"]).count() == 3 and "<svg" in (tmp_path / "report.html").read_text()


def test_tables_and_configuration_are_written(spark, tmp_path):
    d = spark.createDataFrame([(1, [1, 2])], "a bigint, b array<int>")
    m = runs.write_tables({"one": d, "two": d.limit(0)}, str(tmp_path), csv=True)
    assert m["rows"] == {"one": 1, "two": 0} and json.loads(spark.read.text(str(tmp_path / "manifest")).first().value) == m
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "one_csv")).first().b == "[1,2]"
    session.write_config(str(tmp_path / "c" / "x.yaml"), {"b": {"é": [1, 2]}, "a": None})
    assert session.read_config(str(tmp_path / "c" / "x.yaml")) == {"b": {"é": [1, 2]}, "a": None}
    (tmp_path / "list.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        session.read_config(str(tmp_path / "list.yaml"))


def test_export_of_codes(spark, tmp_path):
    d = spark.createDataFrame([(1, [0, 1], [0.5]), (2, [0, 1], [0.5]), (3, [1, 1], [0.1])], "pid bigint, indices array<int>, reconstruction array<double>")
    out, stats = runs.export_sids(d, str(tmp_path))
    assert {r.pid: r.sid_token for r in out.collect()} == {1: "<a_0><b_1><c_0>", 2: "<a_0><b_1><c_1>", 3: "<a_1><b_1>"} and stats == {"num_pois": 3, "collision_rate_before_suffix": 1 / 3}
    assert files.read_sid_map(spark, str(tmp_path / "pid_to_sid_csv")) if False else spark.read.json(str(tmp_path / "pid_to_sid")).count() == 3


def test_codebooks_lower_their_loss(spark):
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((6, 5))
    x = middle[rng.integers(0, 6, 240)] + 0.05 * rng.standard_normal((240, 5))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    loss = lambda books: quantise.quantisation_loss(d, books).first().loss
    first = [np.linalg.qr(rng.standard_normal((5, 5)))[0]]
    trained = quantise.train(d, levels=2, k=6, rounds=3, first_rounds=5)
    assert len(trained) == 2 and np.allclose(np.linalg.norm(trained[0], axis=1), 1) and loss(trained) < loss(trained[:1]) < loss(first)
    r = x - np.maximum(0, (x @ trained[0].T).max(1))[:, None] * trained[0][(x @ trained[0].T).argmax(1)]
    assert np.isclose(loss(trained[:1]), 0.25 * (r * r).mean())


def test_layers_and_autoencoder(spark):
    rng = np.random.default_rng(2)
    w = [(rng.standard_normal((4, 3)), rng.standard_normal(4)), (rng.standard_normal((2, 4)), rng.standard_normal(2))]
    norms = [(np.ones(4), np.zeros(4), np.full(4, 0.3), np.full(4, 2.0))]
    e, back = models.Layers(w, norms), models.Layers([(rng.standard_normal((3, 2)), np.zeros(3))])
    x = rng.standard_normal((9, 3))
    h = np.maximum((x @ w[0][0].T + w[0][1] - 0.3) / np.sqrt(2.0 + 1e-5), 0) @ w[1][0].T + w[1][1]
    assert np.allclose(e(x), h)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    book = np.eye(2)
    got = {r.id: r for r in models.autoencoded(d, e, [book], back).collect()}
    c = h.argmax(1)
    q = np.maximum(0, h.max(1))[:, None] * book[c]
    assert all(got[i].indices == [c[i]] and np.allclose(got[i].decoded, back(q)[i]) for i in range(9))
    r = models.autoencoder_loss(d, e, [book], back).first()
    assert np.isclose(r.reconstruction_loss, ((back(q) - x) ** 2).mean()) and np.isclose(r.loss, r.reconstruction_loss + 0.25 * 0.25 * ((h - q) ** 2).mean())
    with pytest.raises(ValueError):
        models.Layers(w, activation="odd")


def test_attention_pooling(spark):
    rng = np.random.default_rng(3)
    hidden, weights = rng.standard_normal((4, 3)), rng.random((2, 4, 4))
    t = spark.createDataFrame([(1, j, v.tolist()) for j, v in enumerate(hidden)], "id bigint, position int, vec array<double>")
    a = spark.createDataFrame([(1, h, i, j, float(weights[h, i, j])) for h in range(2) for i in range(4) for j in range(4)], "id bigint, head int, asker int, position int, weight double")
    assert np.allclose(quantise.attention_pooled(t, a, 3).first().vec, (weights.mean(0) @ hidden).mean(0))
    with pytest.raises(Exception, match="not finite or zero"):
        quantise.attention_pooled(t, a.withColumn("weight", F.lit(0.0)), 3).collect()


def test_beams_find_the_best_allowed_sequences():
    rng = np.random.default_rng(5)
    allowed = sorted({tuple(int(x) for x in rng.integers(0, 5, 3)) for _ in range(60)}) + [(0,)]
    cost = rng.random((4, 6))
    scores = lambda prefix: {t: -float(cost[len(prefix), t]) for t in range(6)}
    total = lambda s: sum(scores(s[:i])[t] for i, t in enumerate(s)) + (scores(list(s))[5] if s == (0,) and any(a[0] == 0 and len(a) > 1 for a in allowed) else 0)
    want = sorted(allowed, key=lambda s: (-total(s), list(s)))[:6]
    t = models.Trie([list(s) for s in allowed])
    assert [tuple(s) for s in t.beams(scores, 6, end=5)] == want and t.size == len(allowed)


def test_popular_candidates(spark):
    train = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 5, 3), (1, 6, 4), (2, 9, 1), (2, 9, 2), (2, 9, 3)], "uid bigint, pid bigint, seq bigint").withColumn("time_dt", F.col("seq"))
    s = spark.createDataFrame([("a", [1, 5]), ("b", [])], "sample_id string, observed_pids array<bigint>")
    assert {r.sample_id: r.candidates for r in runs.popular_candidates(s, train, 2).collect()} == {"a": ["<6>", "<9>"], "b": ["<9>", "<5>"]}
