import duckdb
from pyspark.sql import functions as F

from lexloom.llm import preferences as pf

TURN = "array<struct<role: string, text: string>>"


def formatted(spark, chosen, rejected):
    return pf.format_preferences(spark.createDataFrame([(1, chosen, rejected)], f"pair_id long, chosen {TURN}, rejected {TURN}")).first()


def test_prompt_once_and_masks(spark):
    head = [("system", "Be kind."), ("user", "Hé?")]
    r = formatted(spark, [*head, ("assistant", "Yes é"), ("user", "ok"), ("assistant", "bye")], [*head, ("assistant", "No")])
    assert r.prompt_turns == 2
    assert r.prompt == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>user\nHé?<|im_end|>\n"
    parts = [tuple(map(int, m.split(":"))) for m in r.chosen_mask.split(",")]
    assert [r.chosen[a:b] for a, b in parts] == ["Yes é<|im_end|>", "bye<|im_end|>"]
    a, b = map(int, r.rejected_mask.split(":"))
    assert r.rejected[a:b] == "No<|im_end|>"


def test_prefixes_equal_and_missing_sides(spark):
    one, two = [("user", "a")], [("user", "a"), ("assistant", "b")]
    r = formatted(spark, two, one)
    assert (r.prompt_turns, r.rejected, r.rejected_mask) == (1, "", "")
    r = formatted(spark, two, two)
    assert (r.prompt_turns, r.chosen, r.rejected) == (2, "", "")
    r = formatted(spark, two, None)
    assert (r.prompt_turns, r.prompt, r.rejected, r.rejected_mask) == (0, "", None, None)
    assert formatted(spark, [], [("user", "a")]).prompt == ""


def test_awkward_turns(spark):
    schema = "conv_id long, turn long, role string, text string, chosen int, pair_id int"
    rows = [(0, 1, "assistant", None, 1, 1), (0, 0, "user", "q", 1, 1), (0, 0, "user", "q", 1, 1), (1, None, None, "x", 1, 1), (1, 2, "assistant", "y", 1, 1), (None, 0, "user", "lost", 1, 1), (4, 0, "user", "alone", 1, 1)]
    turns = spark.createDataFrame(rows, schema)
    got = {r.pair_id: r for r in pf.format_preferences(pf.swapped_replies(turns)).collect()}
    assert set(got) == {0, 1, 4}
    assert got[0].prompt_turns == 2 and got[0].rejected == "<|im_start|>assistant\ny<|im_end|>\n"
    assert got[4].rejected is None
    con = duckdb.connect()
    con.register("conversations", turns.toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    want = {r[0]: r for r in con.sql(pf.OP8_SQL).fetchall()}
    assert {k: tuple(v) for k, v in got.items()} == want
    assert pf.format_preferences(pf.swapped_replies(turns.limit(0))).count() == 0


def test_no_python_in_the_plan(spark, small_dir):
    plan = pf.op8_preferences(spark, small_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_long_conversation(spark):
    turns = spark.range(3000).select(F.lit(2).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("t").alias("text"))
    r = pf.format_preferences(pf.swapped_replies(turns)).first()
    assert r.chosen_mask.count(":") == 1500
