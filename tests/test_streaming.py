import base64
import json
import os
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.operators.generated import validate_generated
from lexloom.streaming import chunk_log
from lexloom.streaming import json_field as jf


def pushed(fragments, field="paragraph"):
    reader = jf.FieldReader(field)
    return [reader.push(f) for f in fragments]


STRING = re.compile(r'"((?:[^"\\]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*)("?)')


def readable(source, field):
    """What can be read of the field, found in the whole text so far; None before it begins."""
    at = 0
    while (at := source.find('"', at)) >= 0:
        key = STRING.match(source, at)
        if not key[2]:
            return None
        at = key.end()
        colon = re.compile(r"[\s\ufeff]*:[\s\ufeff]*").match(source, at)
        if decoded(key[1]) == field and colon:
            return decoded(STRING.match(source, colon.end())[1]) if source.startswith('"', colon.end()) else None
    return None


def decoded(raw):
    text = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else jf.ESCAPES[m[2]], raw, flags=re.S)
    if text and "\ud800" <= text[-1] <= "\udbff":
        text = text[:-1]
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def test_fragments_at_any_boundary():
    assert "".join(pushed(['{"para', 'graph":"Hello \\', '"learner\\"', '!","translation":"中文"}'])) == 'Hello "learner"!'
    assert "".join(pushed(['{"paragraph":"a\\', 'nb\\u26', '03c"'])) == "a\nb☃c"
    assert pushed(['{"x": 1, "paragraph": 5}']) == [""]
    assert pushed(['{"paragraph"', ' ', ':', '\t"a', 'b', '", "paragraph": "c"}']) == ["", "", "", "a", "b", ""]
    assert pushed(['{"paragraph", "paragraph": "x\\q y"']) == ["x"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=30), st.integers(1, 7), st.booleans())
def test_any_text_in_any_chunks(text, size, ascii_only):
    text = text.encode("utf-16", "replace").decode("utf-16")
    doc = json.dumps({"other": "paragraph", "paragraph": text, "translation": "t"}, ensure_ascii=ascii_only)
    assert "".join(pushed([doc[i : i + size] for i in range(0, len(doc), size)])) == text


BITS = st.sampled_from(['"', "p", '"p"', '"p":', ":", " ", '"p" : "', "\\", "\\u", "d83d", "\\ude00", "\\ud83d", "\\n", "\\x", "é", "{", "pp", '\\u0070"', "\ufeff", ","])


@settings(max_examples=600, deadline=None)
@given(st.lists(BITS, max_size=14))
def test_reading_on_is_reading_all(bits):
    """After every fragment, all that was read is what a reading of the whole text so far gives."""
    reader, got = jf.FieldReader("p"), ""
    for i, b in enumerate(bits):
        got += reader.push(b)
        assert got == (readable("".join(bits[: i + 1]), "p") or "")


def test_reading_is_linear():
    def seconds(n):
        reader, start = jf.FieldReader("paragraph"), time.perf_counter()
        for _ in range(n):
            reader.push('{"a": "b\\n", ')
        reader.push('"paragraph": "')
        for _ in range(n):
            reader.push("some words \\u00e9")
        return time.perf_counter() - start

    seconds(2000)
    assert seconds(40_000) < 60 * seconds(4000)


def test_stream_of_requests(spark, tmp_path):
    """Two micro-batches: the state carries each request from one to the next."""
    doc = {r: json.dumps({"paragraph": f"text of {r} ☃", "translation": "t"}) for r in ("a", "b")}
    schema = "request_id string, seq long, fragment string"
    (tmp_path / "in").mkdir()
    stream = jf.field_deltas(spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(str(tmp_path / "in")))
    for n in range(3):
        rows = [{"request_id": r, "seq": n * 100 + i, "fragment": c} for r, d in doc.items() for i, c in enumerate(d[n * 12 : (n + 1) * 12 if n < 2 else None])]
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / f"in/{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are read by age
    q = stream.writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120), q.status
    got = {}
    for r in sorted(spark.sql("select * from deltas").collect(), key=lambda r: r.seq):
        got[r.request_id] = got.get(r.request_id, "") + r.delta
    assert got == {r: f"text of {r} ☃" for r in doc}


def test_lines_and_completion(spark):
    rows = [("a", 0, '{"response":"x","done":fal'), ("a", 1, 'se}\n\n{"response":"y","done":true}'), ("b", 0, '{"response":"x","done":false}\n'), ("c", 0, '{"response":1,"done":true}\n')]
    lines = jf.ndjson(spark.createDataFrame(rows, "request_id string, seq long, chunk string"))
    got = {r.request_id: (r.text, r.status) for r in jf.completions(jf.checked_events(lines)).collect()}
    assert got["a"] == ("xy", "completed") and got["b"] == ("x", "interrupted") and got["c"][1] == "malformed"


def test_attempts_and_first_response(spark):
    rows = [("a", 0, "delta", "x"), ("a", 1, "retry", None), ("a", 2, "delta", "y"), ("a", 3, "result", None), ("b", 0, "delta", "z"), ("c", 0, "retry", None), ("c", 1, "retry", None), ("d", 0, "error", None)]
    got = {r.request_id: (r.status, r.draft) for r in jf.attempts(spark.createDataFrame(rows, "request_id string, seq long, kind string, text string")).collect()}
    assert got == {"a": ("completed", "y"), "b": ("open", "z"), "c": ("protocol-error", ""), "d": ("failed", "")}
    events = spark.sql("select 'r' request_id, timestamp'2026-01-01 00:00:00' started, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,0,t) ts, x response from values (1, ''), (2, 'a'), (3, 'b') v(t, x)")
    assert jf.time_to_first(events).first().seconds == 2.0


def run_once(stream, checkpoint, sink):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(sink))
    assert q.awaitTermination(180), q.status
    assert q.exception() is None


def log_line(request, seq, data):
    return json.dumps({"request_id": request, "seq": seq, "chunk": None if data is None else base64.b64encode(data).decode()})


def test_logs_are_read_on_after_a_restart(spark, tmp_path):
    """Three runs of one query; lines and characters are cut between them, and a record is half written at the first."""
    folder = tmp_path / "logs"
    folder.mkdir()
    spark.dataSource.register(chunk_log.ChunkLog)
    text = {"a": "one é\n\ntwo\nthr", "b": "漢字\n" * 5 + "end\n"}
    cut = {r: [t.encode()[i : i + 2] for i in range(0, len(t.encode()), 2)] for r, t in text.items()}
    lines = {r: [log_line(r, i, c) for i, c in enumerate(cs)] + [log_line(r, len(cs), None)] for r, cs in cut.items()}
    logs = {"a": "\n".join(lines["a"]) + "\n", "b": "\n".join(lines["b"]) + "\n"}
    for k in range(1, 4):
        for r, whole in logs.items():
            (folder / f"{r}.log").write_text(whole[: len(whole) * k // 3])
        stream = spark.readStream.format("chunk-log").option("bytesPerPartition", "100").load(str(folder))
        run_once(jf.framed_lines(stream), tmp_path / "cp", tmp_path / "out")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.request_id, r.seq, r.line) for r in got) == sorted((r, i, x) for r, t in text.items() for i, x in enumerate(t.split("\n")) if x)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é", max_size=12), max_size=20), st.integers(1, 40), st.integers(1, 9), st.booleans())
def test_parts_hold_every_line_once(tmp_path_factory, lines, size, block, whole):
    folder = tmp_path_factory.mktemp("log")
    data = "\n".join(lines).encode() + (b"\n" if whole and lines else b"")
    (folder / "x.log").write_bytes(data)
    end = chunk_log.whole_lines(str(folder), "x.log", len(data), block)
    assert end == data.rfind(b"\n") + 1
    got = [x for p in chunk_log.parts("x.log", 0, end, size) for x in chunk_log.lines_of(str(folder), p, block)]
    assert [x for _, x in got] == data[:end].split(b"\n")[:-1] and all(data[at : at + len(x)] == x for at, x in got)


def test_bad_records_and_shrunken_logs_are_errors(tmp_path):
    (tmp_path / "x.log").write_text('{"request_id": 1}\n')
    part = chunk_log.parts("x.log", 0, 18)[0]
    with pytest.raises(chunk_log.ChunkLogError, match="x.log at 0"):
        list(chunk_log.records(str(tmp_path), part))
    with pytest.raises(chunk_log.ChunkLogError, match="shorter"):
        chunk_log._Stream(str(tmp_path), 100).partitions({"x.log": 30}, {"x.log": 18})
    assert chunk_log.logs(str(tmp_path / "none")) == {}


def test_attempts_over_batches(spark, tmp_path):
    events = [("a", "delta", "x"), ("a", "retry", None), ("b", "delta", "z"), ("c", "retry", None), ("a", "delta", "y"), ("d", "error", None), ("c", "retry", None), ("a", "result", None), ("b", "delta", "w")]
    schema = "request_id string, seq long, kind string, text string"
    (tmp_path / "in").mkdir()
    for n in range(3):
        rows = [dict(zip(("request_id", "seq", "kind", "text"), (r, 3 * n + i, k, t), strict=True)) for i, (r, k, t) in enumerate(events[3 * n : 3 * n + 3])]
        (tmp_path / f"in/{n}.json").write_text("\n".join(map(json.dumps, rows)))
        run_once(jf.attempt_results(spark.readStream.schema(schema).json(str(tmp_path / "in"))), tmp_path / "cp", tmp_path / "out")
    got = {r.request_id: (r.status, r.draft) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("completed", "y"), "c": ("protocol-error", ""), "d": ("failed", "")}


def test_quiet_requests_end(spark, tmp_path):
    """With a timeout the query goes on by itself; the request that isn't ended is, when it has been quiet for long enough."""
    (tmp_path / "in").mkdir()
    rows = [{"request_id": "a", "seq": 0, "kind": "delta", "text": "so far"}, {"request_id": "b", "seq": 0, "kind": "result", "text": None}]
    (tmp_path / "in/0.json").write_text("\n".join(map(json.dumps, rows)))
    stream = jf.attempt_results(spark.readStream.schema("request_id string, seq long, kind string, text string").json(str(tmp_path / "in")), timeout_ms=1500)
    q = stream.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            got = {r.request_id: (r.status, r.draft) for r in spark.sql("select * from quiet").collect()}
            if len(got) == 2:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert got == {"a": ("interrupted", "so far"), "b": ("completed", "")}


PARAGRAPH = " ".join(["the cat stopped near a box"] * 8)


@pytest.mark.parametrize(
    "text,words,errors",
    [
        (json.dumps({"paragraph": PARAGRAPH, "translation": "t", "usedWords": ["Stop", "cat"]}), ["cat", "stop"], []),
        ("{no json", ["cat"], ["Output is not valid JSON"]),
        ("[1]", ["cat"], ["Output must be an object with only paragraph, translation, and usedWords"]),
        (json.dumps({"paragraph": PARAGRAPH, "translation": "t", "usedWords": ["cat"], "extra": 1}), ["cat"], ["Output must be an object with only paragraph, translation, and usedWords"]),
        (json.dumps({"paragraph": "too short", "translation": " ", "usedWords": [1]}), ["dog"], ["translation must be a non-empty string", "usedWords must be an array of strings", "paragraph must contain 35–120 English words", "paragraph is missing requested items: dog"]),
        (json.dumps({"paragraph": PARAGRAPH, "translation": "t", "usedWords": ["dog"]}), ["cat"], ["usedWords does not match the requested vocabulary items"]),
        (json.dumps({"translation": "t"}), ["cat"], ["paragraph must be a non-empty string", "usedWords must be an array of strings", "paragraph must contain 35–120 English words", "paragraph is missing requested items: cat"]),
    ],
)
def test_generated_texts(spark, text, words, errors):
    r = validate_generated(spark.createDataFrame([(text, words)], "text string, words array<string>")).first()
    assert r.errors == errors and r.valid == (not errors)
