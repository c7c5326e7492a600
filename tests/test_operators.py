"""Operators on small frames, with the edges that the test tables lack."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import base, places, quantise, ranking, sampling, semantic, sequences, traces
from waymark.sources import files


def seqs(spark, *sizes):
    rows = [(u, list(range(n)), [f"2024-01-01 {i:05d}" for i in range(n)]) for u, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "uid bigint, p array<bigint>, t array<string>")


def test_eval_windows_edges(spark):
    got = sequences.eval_windows(seqs(spark, 2, 3, 49, 50, 51)).select("uid", "split", "end", F.size("pids").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(1, "test", 2, 2), (1, "val", 1, 1), (2, "test", 48, 48), (2, "val", 47, 47), (3, "test", 49, 49), (4, "test", 50, 49), (4, "val", 49, 49)]


def test_train_windows_edges(spark):
    got = sequences.train_windows(seqs(spark, 9, 10, 49, 50, 81), mask_prob=0.0).select("uid", "end", F.size("pids").alias("n"), "target").collect()
    # 81 events: the last 80, whose places are 1 .. 80.
    assert sorted(map(tuple, got)) == [(1, 9, 9, 9), (2, 48, 48, 48), (3, 49, 49, 49), (4, 49, 49, 50), (4, 59, 49, 60), (4, 69, 49, 70), (4, 79, 49, 80)]


def test_masking_keeps_the_length_and_ends_with_the_true_last(spark):
    got = sequences.train_windows(seqs(spark, 80), mask_prob=1.0).collect()
    assert got
    for r in got:
        assert r.masked and len(r.pids) == 49 and r.pids[-1] == r.end and r.target not in r.pids


def test_history_rows(spark):
    got = sequences.history_rows(seqs(spark, 1, 4)).collect()
    assert [(r.uid, r.pids, r.target) for r in got] == [(1, [0, 1, 2], 3)]


def test_positions_are_a_total_order(spark):
    d = spark.range(1000).select(F.col("id"), ((F.col("id") * 37) % 101).alias("v"))
    got = base.positions(d, [F.col("v"), F.col("id")], "k").orderBy("k").collect()
    assert [r.k for r in got] == list(range(1, 1001)) and [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_positions_with_one_value_nearly_everywhere(spark):
    d = spark.range(4000).select(F.col("id"), F.when(F.col("id") == 7, "1970-01-01").otherwise("2024-05-05").alias("v")).repartition(5)
    got = base.positions(d, [F.col("v"), F.col("id")], "k").collect()
    assert {r.id: r.k for r in got} == {7: 1} | {i: i + 2 if i < 7 else i + 1 for i in range(4000) if i != 7}
    assert base.positions(d.limit(0), [F.col("id")], "k").count() == 0


def test_frequent_is_two_passes(spark):
    d = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 3), (3, 1)], "uid bigint, pid bigint")
    assert sorted(map(tuple, base.frequent(d, "pid", "uid", 2, 1).collect())) == [(1, 1), (2, 1), (3, 1)]
    assert base.frequent(d, "pid", "uid", 2, 2).count() == 0


def test_clean_drops_nulls_and_names_missing_categories(spark):
    t = dt.datetime(2024, 1, 1, 8)
    rows = [(1, "p", "c", None, 1.0, 2.0, -60, t), (2, None, "c", "x", 1.0, 2.0, 0, t), (3, "p", "c", "x", 1.0, 2.0, None, t)]
    d = spark.createDataFrame(rows, "original_uid bigint, original_pid string, category_id string, category string, latitude double, longitude double, timezone_offset int, utc_ts timestamp_ntz")
    got = base.clean(d).collect()
    assert [(r.original_uid, r.category, r.Time, r.visit_hour) for r in got] == [(1, "nan", "2024-01-01 07:00", 7)]


def test_raw_reader(spark, tmp_path):
    good = "1\tp\tc\tCafé\t1.5\t2.5\t-60\tMon Jan 01 08:00:00 +0000 2024"
    lines = [good, good + "\textra", "2\tp\tc\tBar", "", good.replace("Mon Jan", "Xxx Jan")]
    (tmp_path / "u.tsv").write_text("\n".join(lines), encoding="utf-8")
    got = files.read_checkins(spark, str(tmp_path / "u.tsv")).orderBy("original_uid", F.col("utc_ts").desc_nulls_last()).collect()
    assert [(r.original_uid, r.category, r.utc_ts is not None) for r in got] == [(1, "Café", True), (1, "Café", False), (2, "Bar", False)]
    (tmp_path / "l.tsv").write_bytes(good.encode("latin1"))
    assert files.read_checkins(spark, str(tmp_path / "l.tsv")).first().category == "Café"


def test_neighbours_of_lonely_places_are_empty(spark):
    d = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 5, 3), (2, 9, 1)], "uid bigint, pid bigint, seq bigint").withColumn("time_dt", F.col("seq"))
    got = {r.pid: r.neighbours for r in places.neighbour_lists(d, forward_only=False).collect()}
    assert got == {5: [6], 6: [5], 9: []}


def test_suffixes(spark):
    d = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [0, 0, 0])], "pid bigint, indices array<int>")
    assert {r.pid: r.sid_token for r in semantic.with_suffix(d).collect()} == {1: "<a_1><b_2><c_3><d_0>", 2: "<a_1><b_2><c_3><d_1>", 3: "<a_0><b_0><c_0>"}


def test_hard_negatives_example(spark):
    rows = [("abc", "<a_1><b_2><c_3>", "Bar", "54", "G3_5"), ("abc", "<a_1><b_2><c_4>", "Bar", "67", "G3_5"), ("abc", "<a_1><b_2><c_5>", "Bar", "54", "G3_4"), ("abc", "<a_2><b_1><c_1>", "Office", "54", "G3_4")]
    p = spark.createDataFrame(rows, "level string, prefix string, category string, region string, geo_bucket string")
    got = {r.positive: r.negatives for r in semantic.hard_negatives(p, "abc").collect()}
    assert got["<a_1><b_2><c_3>"] == ["<a_1><b_2><c_4>", "<a_1><b_2><c_5>", "<a_2><b_1><c_1>"]


def test_split_is_disjoint(spark):
    d = spark.createDataFrame([(f"<a_{i}><b_0><c_0>",) for i in range(4)], "abc string")
    got = semantic.split_prefixes(d, 0.25).collect()
    assert len(got) == 4 and sum(r.valid for r in got) == 1
    with pytest.raises(ValueError):
        semantic.split_prefixes(d, 1.0)


def test_mixed_total(spark):
    fam = {f: spark.createDataFrame([(f"{f}{i}",) for i in range(10)], "sample_id string") for f, _ in sampling.PHASE_B2}
    got = sampling.mixed(fam, sampling.PHASE_B2).groupBy("family").count().collect()
    assert {r.family: r["count"] for r in got} == {"full_sid_to_abc_profile": 20, "abc_to_abc_profile": 8, "abc_profile_to_abc": 8, "phase_a_replay": 4}


def test_weights(spark):
    w = spark.range(1).select(sampling.forward_weight(F.lit(200), F.lit(100), F.lit(180)), sampling.forward_weight(F.lit(8), F.lit(5), F.lit(6))).first()
    assert 0.1 <= w[0] < w[1] <= 1


def greedy(target, space, counts):
    """The sequential form: the target, one more of its abc, two of its ab and two of its a by unused abc, then all by unused abc."""
    cut = lambda s, n: "".join(x + ">" for x in s.split(">")[:n])
    order = sorted(space, key=lambda s: (-counts.get(s, 0), s))
    out, used = [target], {cut(target, 3)}
    out += [s for s in order if cut(s, 3) == cut(target, 3) and s != target][:1]
    for n, quota in ((2, 2), (1, 2), (0, 10)):
        got = 0
        for s in order:
            if got < quota and len(out) < 10 and cut(s, 3) not in used and (n == 0 or cut(s, n) == cut(target, n)) and (n != 1 or cut(s, 2) != cut(target, 2)):
                out.append(s)
                used.add(cut(s, 3))
                got += 1
    return out


def test_ranked_targets_match_the_greedy_form(spark):
    rng = np.random.default_rng(4)
    space = sorted({f"<a_{a}><b_{b}><c_{c}>" + (f"<d_{d}>" if d < 2 else "") for a, b, c, d in rng.integers(0, 4, (90, 4))})
    counts = {s: int(rng.integers(0, 5)) for s in space}
    s = spark.createDataFrame([(x, counts[x]) for x in space], "sid string, n bigint")
    got = {}
    for r in ranking.ranked_targets(s.select(F.col("sid").alias("target")), s).orderBy("target", "rank").collect():
        got.setdefault(r.target, []).append(r.candidate)
    assert all(got[t] == greedy(t, space, counts) for t in space)


def test_causal_search_has_no_future_and_no_self(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    d = spark.createDataFrame([(i, t[i - 1], [1.0, 0.0]) for i in (1, 2, 3)], "id bigint, time timestamp, vec array<double>")
    q = spark.createDataFrame([(2, dt.datetime(2024, 1, 2, 12), [1.0, 0.0])], "id bigint, time timestamp, vec array<double>")
    assert [r.key_id for r in ranking.causal_topk(q, d, 5).collect()] == [1]
    assert ranking.causal_topk(q.withColumn("time", F.lit("2000-01-01").cast("timestamp")), d, 5).count() == 0


def test_accuracy_of_nothing_is_zero(spark):
    d = spark.createDataFrame([], "prediction string, parsed_predictions array<string>, target string, prompt string")
    m = ranking.accuracy(d).first()
    assert (m.num_samples, m.acc1, m.mean_parsed) == (0, 0.0, 0.0)
    d = spark.createDataFrame([("<2> <2> <3>", [], "<2>", "p")], "prediction string, parsed_predictions array<string>, target string, prompt string")
    assert ranking.accuracy(d, "id").first().acc1 == 1.0


def test_profile_rates(spark):
    good = '{"category":"Bar","region":54,"geo_bucket":"G3_5"}'
    d = spark.createDataFrame([(good, good), (good.replace("54", "67"), good)], "prediction string, output string")
    r = ranking.profile_eval(d).first()
    assert (r.valid_rate, r.category_rate, r.region_rate, r.geo_bucket_rate, r.joint_rate) == (1.0, 1.0, 0.5, 1.0, 0.5)


def test_trace_rollups(spark):
    rows = [(10 + i, 1, i, 2, float(i), 1.0, 1.0, 1.0) for i in range(4)]
    t = traces.ordered(spark.createDataFrame(rows, "time_ns bigint, pid bigint, local_record_index bigint, group_size_hint bigint, total_reward double, single_line_score double, valid_count_score double, exact_ten_score double"))
    assert traces.group_size(t) == 2
    s = traces.steps(t, 2).orderBy("step").collect()
    assert [(r.n, r.total_reward_sum, r.total_reward_cum_mean) for r in s] == [(2, 1.0, 0.5), (2, 5.0, 1.5)]
    b = traces.backfilled(t).first()
    assert (b.single_line_reward, b.valid_count_reward, b.exact_ten_reward) == (0.1, 0.25, 0.15)
    with pytest.raises(ValueError):
        traces.group_size(t, 0)


def test_downsampling(spark):
    d = spark.createDataFrame([(i, i + 1, float(i)) for i in range(10)], "i bigint, x bigint, y double")
    got = sorted(map(tuple, traces.downsampled(d, 4, "i", "x", ("y",)).collect()))
    assert got == [(3, 1.0), (6, 4.0), (9, 7.0), (10, 9.0)]


def test_quantiser_forms_agree(spark):
    rng = np.random.default_rng(2)
    book = rng.standard_normal((8, 6))
    book /= np.linalg.norm(book, axis=1, keepdims=True)
    x = rng.standard_normal((40, 6))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    bulk = {r.id: list(r.indices) for r in quantise.assign(d, [book, book]).collect()}
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(book)], "code int, direction array<double>")
    e = d.withColumn("residual", F.col("vec")).withColumn("reconstruction", F.transform("vec", lambda v: F.lit(0.0)))
    for level in (1, 2):
        e = quantise.assign_level(e, b, level)
    assert bulk == {r.id: [r.code_1, r.code_2] for r in e.collect()}


def test_sinkhorn_balances():
    d = np.tile([0.0, 1.0], (10, 1)) + np.random.default_rng(0).random((10, 2)) * 0.5
    got = quantise.sinkhorn(d, 0.05, 50)
    assert 3 <= got.sum() <= 7
    assert (quantise.sinkhorn(np.array([[np.nan, 1.0]]), 0.05, 5) == [0]).all()


def test_sid_map_and_history(spark):
    raw = spark.createDataFrame([(1, "<a_1><b_1><c_1>", None), (2, None, "[1, 2, 3]")], "pid bigint, sid_token string, sid_indices string")
    assert {r.pid: r.sid_token for r in files.sid_map(raw).collect()} == {1: "<a_1><b_1><c_1>", 2: "<a_1><b_2><c_3>"}
    h = spark.createDataFrame([(0, "User_7 visited: x"), (1, "User_7 visited: y"), (2, "nobody")], "k bigint, text string")
    assert [tuple(r) for r in files.history_map(h, "text", "k").collect()] == [(7, "User_7 visited: y")]
    with pytest.raises(ValueError):
        files.read_sid_map(spark, "map.pkl")


def test_jsonl_keeps_nulls(spark, tmp_path):
    d = spark.createDataFrame([(1, None)], "a bigint, b string")
    files.write_jsonl(d, str(tmp_path / "x"))
    assert "".join(p.read_text() for p in (tmp_path / "x").glob("part-*")) == '{"a":1,"b":null}\n'  # of several parts some are empty
