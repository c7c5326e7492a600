"""Whole builds on a small raw file, models and the stream."""

import datetime as dt
import json

from pyspark.sql import functions as F

from waymark import streaming
from waymark.models import Trie, constrained, encoded
from waymark.operators import ranking
from waymark.plans import builders
from waymark.session import BuildConfig, merged
from waymark.sources import files


def raw_file(tmp_path):
    rows = []
    for step in range(30):
        for uid, pid, cat, lat, lon, late in ((100, "poi_a", "Cafe", 40.7128, -74.0060, 0), (200, "poi_b", "Park", 40.7580, -73.9855, 1)):
            t = dt.datetime(2024, 1, 1, 8) + dt.timedelta(hours=2 * step + late)
            rows.append("\t".join(map(str, (uid, pid, f"c{pid}", cat, lat, lon, -300, t.strftime("%a %b %d %H:%M:%S +0000 %Y")))))
    (tmp_path / "raw.tsv").write_text("\n".join(rows) + "\n")
    return str(tmp_path / "raw.tsv")


def test_raw_build_to_inference(spark, tmp_path):
    raw = files.read_checkins(spark, raw_file(tmp_path))
    t = builders.trajectories(raw, BuildConfig())
    m = builders.manifest(t)
    assert m["rows"] == {"uid_mapping": 2, "pid_mapping": 2, "catname_mapping": 2, "region_id_mapping": 2, "checkins": 60, "train": 2, "test": 2, "val": 2, "history": 2, "poi_info": 2}
    info = t["poi_info"].orderBy("pid").first()
    assert (info.uids, info.visit_count, info.unique_user_count, info.neighbors) == ([1], 30, 1, [1])
    from waymark.operators import sequences

    samples = sequences.sample_rows(t["test"], F.lit("test"), F.col("uid") - 1, "id", 5)
    one = samples.orderBy("uid").first()
    assert one.sample_id == "test-00000-u1" and len(one.observed_pids) == 5 and one.input_text.startswith("User_1 visited: <1> at ") and one.input_text.endswith("user_1 is likely to visit:")
    hist = builders.history_texts(t["history"])
    assert builders.supervised(samples, "original", hist).where("input like 'Historical trajectory:\nUser_%'").count() == 2
    cand = samples.select("sample_id", F.array(F.lit("<9>"), F.col("target")).alias("candidates"))
    answers = builders.inference(samples, cand, "id", "original", hist)
    r = ranking.accuracy(answers, "id").first()
    assert (r.acc1, r.acc5) == (0.0, 1.0)
    chat = builders.chat(samples).first()
    assert [x.role for x in chat.messages] == ["system", "user"] and builders.chat(samples).columns[:3] == ["data_source", "ability", "messages"]


def test_similar_map_looks_back_only(spark):
    rows = [(f"train-{i}", "train", f"2024-01-0{i} 08:00", f"text {i}", f"text {i}") for i in (1, 2, 3)] + [("test-1", "test", "2024-01-02 09:00", "text 2", "text 2")]
    bank, counts = builders.bank([spark.createDataFrame(rows, "sample_id string, split string, target_time string, key_text string, query_text string")])
    got = builders.similar_map(bank, "test", 5).orderBy("rank").collect()
    assert [r.key_id for r in got] == ["train-2", "train-1"] and got[0].score > got[1].score and {r.split: r.n for r in counts.collect()} == {"train": 3, "test": 1}


def test_warmup_lists_start_with_the_target(spark):
    space = spark.createDataFrame([(f"<a_{i % 3}><b_{i % 5}><c_{i}>", i) for i in range(15)], "sid string, n bigint")
    s = space.select(F.col("sid").alias("target"), F.col("sid").alias("sample_id"), F.lit("in").alias("input_text"), F.lit("k").alias("key_text"), F.lit("t").alias("target_time"))
    rows = builders.warmup(s, space).collect()
    assert len(rows) == 15 and all(len(set(r.ranked_targets)) == 10 and r.ranked_targets[0] == r.target for r in rows)


def test_models(spark):
    d = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "id bigint, t string")
    v = {r.id: r.vec for r in encoded(d, "t").collect()}
    assert v[1] == v[2] and abs(sum(x * x for x in v[3]) - 1) < 1e-9
    s = spark.createDataFrame([("s", "b", 1.0), ("s", "a", 1.0), ("s", "c", 0.5)], "sample_id string, candidate string, score double")
    assert constrained(s, 2).first().prediction == "a b"
    t = Trie([[1, 2], [1, 3]])
    assert (t.allowed([]), t.allowed([1]), t.allowed([1, 2]), t.allowed([9])) == ([1], [2, 3], [], [])
    assert merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_trace_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda minute, reward: json.dumps({"time_ns": (minute * 60 + 1) * 10**9, "pid": 1, "total_reward": reward, "single_line_score": 1.0})
    (tmp_path / "in" / "a.json").write_text("\n".join([row(0, 1.0), row(0, 3.0), row(1, 5.0), row(60, 0.0)]))
    streaming.start(streaming.trace_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = [(r.n, r.mean_total_reward) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()]
    assert got == [(2, 2.0), (1, 5.0)]
    batch = streaming.rolled(spark.read.schema(streaming.TRACE_SCHEMA).json(str(tmp_path / "in")))
    assert batch.count() == 3


def test_trace_files(spark, tmp_path):
    d = spark.createDataFrame([(5, 1.0), (6, 2.0)], "time_ns bigint, total_reward double")
    files.append_traces(d, str(tmp_path / "t"))
    files.append_traces(d, str(tmp_path / "t"))
    got = files.read_traces(spark, str(tmp_path / "t"), streaming.TRACE_SCHEMA)
    assert got.count() == 4 and got.where("file is not null and local_record_index is not null").count() == 4


def test_report(spark):
    from waymark.plans import report

    d = spark.createDataFrame([(i, 1, i, 4, float(i % 5), 1.0, 0.5, 0.0, 2) for i in range(50)], "time_ns bigint, pid bigint, local_record_index bigint, group_size_hint bigint, total_reward double, single_line_score double, valid_count_score double, exact_ten_score double, parsed_prediction_count int")
    page, summary = report.report(d, most=6)
    assert summary["group_size"] == 4 and summary["steps"] == 13 and summary["trace_row_count"] == 50 and page.count("<svg") == page.count("</svg>") >= 4
    assert report.ticks(0, 1) == [0.0, 0.5, 1.0] and report.nice(0.3) == 0.5 and report.chart("none", [], {}).endswith("</svg>")
    assert report.default_path("a/checkpoints/d/s/r/traces") == "a/outputs/d/s/r/report.html" and report.default_path("x/t.jsonl") == "x/report.html"


def test_replay_and_encoder_inspection(spark):
    s = spark.createDataFrame([("a", "<a_1><b_1><c_1>"), ("b", "<a_2><b_2><c_2>")], "sample_id string, ground_truth string")
    ans = spark.createDataFrame([("a", "<a_1><b_1><c_1>"), ("b", "none")], "sample_id string, prediction string")
    assert builders.replay(s, ans, "a").first().reward.hit == 1.0 and builders.replay(s, ans, row_index=1).first().reward.hit == 0.0
    bank = s.select("sample_id", F.col("ground_truth").alias("key_text"))
    assert [(r.sample_id, r.health.nans) for r in builders.inspect_encoder(bank).collect()] == [("a", 0), ("b", 0)]


def test_import(spark, tmp_path):
    import pytest

    from waymark.sources import imported

    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "train.csv").write_text('Uid,Pids\n1,"[1, 2]"\n')
    (tmp_path / "data" / "retrieval_bank_id.jsonl").write_text('{"sample_id": "x"}\n')
    got = imported.imported(spark, str(tmp_path))
    assert sorted(got) == ["retrieval_bank_id", "train"] and got["train"].first().Pids == "[1, 2]"
    with pytest.raises(FileNotFoundError):
        imported.present(spark, str(tmp_path / "none"))


def test_column_vectors(spark):
    from waymark.operators import embedding

    d = spark.createDataFrame([("Bar",), ("Cafe",), ("Bar",), (None,), ("Park",)], "category string")
    v = embedding.column_vectors(d, "category", components=2).collect()
    assert sorted(r.value for r in v) == ["Bar", "Cafe", "Park"] and all(len(r.vec) == 2 for r in v)
