"""Scalars against fixed examples."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, profile, prompts, reward, sid, text, vector


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_sid_strings(spark):
    t = F.lit("<a_1><b_2><c_3><d_4>")
    got = one(spark, sid.token(F.array(F.lit(1), F.lit(2), F.lit(3))), sid.prefix(t, "a"), sid.prefix(t, "ab"), sid.prefix(t, "abc"), sid.level_name(t), sid.first_prefix(F.lit("x <a_9><b_1> y"), "a"), sid.first_prefix(F.lit("none"), "a"))
    assert tuple(got) == ("<a_1><b_2><c_3>", "<a_1>", "<a_1><b_2>", "<a_1><b_2><c_3>", "full_sid", "<a_9>", None)


def test_predictions(spark):
    got = one(spark, sid.predictions(F.lit("><b_10><c_9> <a_9><b_10><c_9><d_0>"), "sid"), sid.predictions(F.lit("<2> <2> <3>"), "id"))
    assert got[0] == ["<a_9><b_10><c_9><d_0>"] and got[1] == ["<2>", "<3>"]


def test_bad_sid_is_null_or_an_error(spark):
    assert one(spark, sid.segments(F.lit("<a_1>")))[0] is None
    with pytest.raises(Exception, match="not a semantic ID"):
        one(spark, sid.segments(F.lit("<a_1>"), strict=True))


def test_geo(spark):
    n = [F.lit(float(x)) for x in (10, 20, 0, 10, 0, 20)]
    got = one(spark, geo.bucket(*n, 8), geo.plus_code(F.lit(40.7128), F.lit(-74.0060)), geo.bucket_distance(F.lit("G3_5"), F.lit("G1_6")), geo.bucket_distance(F.lit("x"), F.lit("G1_6")), geo.bucket(*[F.lit(1.0)] * 6, 8))
    assert tuple(got) == ("G7_7", "87G7PX", 3, None, "G0_0")


def test_profile(spark):
    js = profile.to_json("abc", F.lit("Bar"), F.lit("54"), F.lit("G3_5"))
    word = profile.to_json("ab", F.lit('a "b" é'), F.lit("north"))
    got = one(spark, js, profile.valid(js, "abc"), profile.valid(F.lit('{"region":54,"category":"Bar","geo_bucket":"G3_5"}'), "abc"), profile.valid(F.lit("[1]"), "a"), word)
    assert tuple(got) == ('{"category":"Bar","region":54,"geo_bucket":"G3_5"}', True, False, False, '{"category":"a \\"b\\" é","region":"north"}')


def test_text(spark):
    got = one(spark, text.category(F.lit("  a   b\n")), text.category(F.lit("  ")), text.region(F.lit(" 54.0 ")), text.region(F.lit("x1")), text.literal_list(F.lit("[np.int64(1), 2]"), "bigint"), text.literal_list(F.lit(None).cast("string")), text.without_think(F.lit(" <think>a\nb</think> <think>c</think>x")), F.length(text.preview(F.lit("y" * 300))))
    assert tuple(got) == ("a b", None, "54", "x1", [1, 2], [], "x", 240)


def test_time_features(spark):
    got = one(spark, vector.time_features(F.array(F.lit(6)), F.array(F.lit(2.0))), vector.time_features(F.array().cast("array<int>"), F.array().cast("array<double>")))
    assert got[0][:2] == pytest.approx([1.0, 0.0]) and got[0][2:4] == pytest.approx([0.0, -1.0]) and got[1] == [0.0] * 12


TEN = " ".join(f"<a_1><b_2><c_{i}>" for i in range(3, 13))


@pytest.mark.parametrize(
    ("answer", "truth", "total"),
    [
        ("<a_1><b_2><c_3> " + " ".join(f"<a_{i}><b_{i}><c_{i}>" for i in range(11, 20)), "<a_1><b_2><c_3>", 0.5 + 1.9 + 1.0 + 0.2 * 3 / 30 + 0.1),
        (TEN, "<a_1><b_2><c_4>", 0.5 + 0.5 * 1.8 + 1.0 + 0.2 * (3 + 9 * 2) / 30 + 0.1),
        ("<think>long</think>\n" + TEN, "<a_1><b_2><c_3>", 0.5 + 1.9 + 1.0 + 0.2 * (3 + 9 * 2) / 30 + 0.1),
        ("<a_1><b_2><c_3><d_0>", "<a_1><b_2><c_3><d_1>", 0.5 * (0.2 + 0.5 / 10) + 0.2 * 3 / 30 + 0.01),
        ("><b_2><c_3>", "<a_1><b_2><c_3>", 0.1),
        ("<a_1><b_2><c_3>\n<a_1><b_2><c_3>", "<a_1><b_2><c_3>", 0.5 * 0.5 / 10 + 1.9 + 1.0 + 0.2 * 3 / 30 + 0.01),
    ],
)
def test_reward(spark, answer, truth, total):
    assert one(spark, reward.parts(F.lit(answer), F.lit(truth))["total_reward"])[0] == pytest.approx(total, abs=1e-9)


def test_prompts(spark):
    now = prompts.current(F.lit(""), F.lit("k"), F.lit("t"))
    both = prompts.body("hybrid", now, prompts.history(F.lit(None).cast("string")), prompts.cases(F.array().cast("array<string>")))
    got = one(spark, both, prompts.prompt(F.lit("x"), "sid", 1), prompts.prompt(F.lit("x"), "id"))
    assert got[0] == "Historical trajectory:\nNo historical trajectory is available.\n\nRetrieved similar cases:\nNo retrieved case is available.\n\nk\nPrediction time: t"
    assert "Output format" not in got[1] and got[2].endswith("7. Start the reply immediately with the first POI ID.")


def test_literals(spark):
    rows = [("[np.int64(1), numpy.int64(-2), 3]", [1, -2, 3]), ("(4, 5)", [4, 5]), ("[]", []), (None, [])]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [list(r.x) for r in d.select("i", text.literal_list(F.col("t"), "bigint").alias("x")).orderBy("i").collect()] == [x for _, x in rows]
    rows = [('["O\'Brien", \'x\']', ["O'Brien", "x"]), ("['say \\\"hi\\\"', 'a, b', 'it\\'s']", ['say "hi"', "a, b", "it's"]), ("['[x]']", ["[x]"]), ("[None, 'a']", [None, "a"]), ('["tab\tin"]', ["tab\tin"])]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [list(r.x) for r in d.select("i", text.literal_list(F.col("t")).alias("x")).orderBy("i").collect()] == [x for _, x in rows]
    for junk in ("[1, 2", "nothing", "['a' 'b']", "[1], [2]"):
        with pytest.raises(Exception, match="not a list literal"):
            spark.createDataFrame([(junk,)], "t string").select(text.literal_list(F.col("t"))).collect()


def test_time_literals_and_completions(spark):
    rows = [("{8: 2, '9': np.int64(3)}", {8: 2, 9: 3}), ("[(8, 2), (10, 1)]", {8: 2, 10: 1}), ("{8: 1, 8: 5}", {8: 5}), ("{}", {}), ("junk", {}), ("", {}), (None, {})]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    assert [r.x for r in d.select("i", text.time_literal(F.col("t")).alias("x")).orderBy("i").collect()] == [x for _, x in rows]
    one = spark.range(1).select(text.completion(F.lit(" do \n"), F.lit("this"), F.lit(" that ")).alias("x")).first().x
    assert one == "### Instruction:\ndo\n\n### Input:\nthis\n\n### Response:\nthat<|eot_id|>"
