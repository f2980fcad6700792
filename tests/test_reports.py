from pyspark.sql import functions as F

from lexloom.operators import lines, reports


def test_projection_audit(spark):
    records = spark.createDataFrame([(0, "k", "よみ［読み］\n①かな/汉字\n｢かな/汉｣\n何か")], "ordinal int, headword string, text string")
    nodes = lines.parse_records(records)
    rows = reports.projection_audit(lines.forms(records, nodes), lines.project_definitions(nodes), lines.project_examples(nodes), lines.project_blocks(nodes), lines.diagnostics(nodes)).collect()
    got = {(r.name, r.key): r.n for r in rows}
    assert got["blocks", "example"] == 1 and got["nesting", "child"] == 1 and got["definitions", "ja"] == 1 and got["diagnostics", "raw-line"] == 1 and got["texts", "und"] == 1


def test_projection_audit_of_outlines_is_that_of_nodes(spark, capsys):
    text = "よみ［読み］\n①かな/汉字\n｢かな/汉｣\n→x\n｢かな/汉｣\n②か\n㋐か\n▶n\n｢か｣\n何か"
    records = spark.createDataFrame([(0, "k", text), (1, "かな", "head\n｢あ｣\n表現x\n(1)y\n\n派生z\n(2)y"), (2, None, None)], "ordinal int, headword string, text string")

    def counts(nodes):
        rows = reports.projection_audit(lines.forms(records, nodes), lines.project_definitions(nodes), lines.project_examples(nodes), lines.project_blocks(nodes), lines.diagnostics(nodes)).collect()
        return sorted((r.name, r.key, r.n) for r in rows)

    nodes = lines.parse_records(records)
    assert counts(lines.outlines(nodes)) == counts(nodes) and len({n for n, *_ in counts(nodes)}) == 8
    blocks = lines.project_blocks(nodes)
    at = {(r.ordinal, r.line): r for r in blocks.collect()}
    assert [(at[k].block, at[k].parent_block) for k in ((0, 1), (0, 2), (0, 4), (0, 6), (0, 8), (1, 1), (1, 3), (1, 6))] == [(0, None), (1, 0), (3, None), (5, 4), (7, 6), (0, None), (2, 1), (5, 4)]
    blocks.explain()
    assert "Join" not in capsys.readouterr().out  # one pass over the lines


def test_markdown(spark):
    text = ["# A", "| x | 1.5 |", "## Times", "| cold | 20.5 | 3 |", "none", "| warm | 4 | 3 |", "## B", "| cold | 1 | 1 |"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line int, text string")
    got = reports.markdown_measurements(rows, "Times", r"^\| (\w+) \| ([0-9.]+) \| (\d+) \|$", ("label", "value", "runs")).orderBy("line")
    assert [(r.label, r.value, r.runs) for r in got.collect()] == [("cold", "20.5", "3"), ("warm", "4", "3")]
    assert reports.markdown_table(got.select("label", "value")) == "| label | value |\n|---|---|\n| cold | 20.5 |\n| warm | 4 |"


def test_names_and_drift(spark):
    df = spark.createDataFrame([("2026-01-02T03",), (None,), ("",)], "e string")
    assert [r.x for r in df.select(reports.default_name(F.col("e"), "Lexicon").alias("x")).collect()] == ["Lexicon 2026-01-02", "Lexicon", "Lexicon"]
    assert reports.count_drift({"a": 3, "b": 4}, {"a": df, "b": df}) == {"b": (4, 3)}


def test_diagnostic_run(spark):
    rows = spark.createDataFrame([(i, float(i), "ok" if i else "failed") for i in range(5)], "ordinal int, milliseconds double, status string")
    r = reports.diagnostic_run(rows).first()
    assert (r.samples, r.failures, r.cold, r.p50, r.max) == (5, 1, 0.0, 2.0, 4.0)
