"""Streams of generated text: lines out of chunks of bytes, a JSON string field out of fragments, attempts out of events.

As Structured Streaming each is a state machine a request, with timers for requests that went quiet; the state is what the
next chunk needs and no more, so the work is linear in the length of a stream. Over bounded tables the same questions are
plain aggregates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# JSON's short escapes, and what counts as white space around a key and its colon.
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
SPACES = frozenset("\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
PLAIN = re.compile(r'[^"\\]*')
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Where the tokenizer stands: outside of strings, in a string that may be the key, behind the key, behind its colon, in the
# field's string, at an end beyond which nothing is read.
OUTSIDE, KEY, BEHIND_KEY, BEHIND_COLON, VALUE, END = range(6)


@dataclass
class FieldReader:
    """Reads one string field of a JSON text that comes in fragments; strings are looked at in their order, at any depth.

    `key` holds no more of a string than tells whether it is the field's name; `escape` an escape that isn't whole yet, `half`
    the first unit of a surrogate pair whose second may follow. An escape that JSON lacks ends the reading, as does a value
    that is no string.
    """

    field: str
    place: int = OUTSIDE
    key: str = ""
    escape: str = ""
    half: int = 0

    def push(self, fragment: str) -> str:
        """The newly readable part of the field."""
        at, out = 0, []
        while at < len(fragment) and self.place != END:
            if self.place in (KEY, VALUE):
                at = self._in_string(fragment, at, out)
            elif self.place == OUTSIDE:
                quote = fragment.find('"', at)
                if quote < 0:
                    break
                self.place, self.key, at = KEY, "", quote + 1
            elif fragment[at] in SPACES:
                at += 1
            elif self.place == BEHIND_KEY:
                colon = fragment[at] == ":"
                self.place, at = BEHIND_COLON if colon else OUTSIDE, at + colon
            else:
                self.place, at = VALUE if fragment[at] == '"' else END, at + 1
        return "".join(out)

    def _in_string(self, fragment: str, at: int, out: list[str]) -> int:
        if self.escape:
            self.escape, at = self.escape + fragment[at], at + 1
            unit = self._unit()
            if unit is not None:
                self.escape = ""
                self._take(unit, out)
            return at
        end = PLAIN.match(fragment, at).end()
        if end > at:
            self._take(fragment[at:end], out)
        if end == len(fragment):
            return end
        if fragment[end] == "\\":
            self.escape = "\\"
        elif self.place == VALUE:
            self.place = END
        else:
            self._lone_half(out)
            self.place = BEHIND_KEY if self.key == self.field else OUTSIDE
        return end + 1

    def _unit(self) -> str | int | None:
        """What the escape stands for, once it is whole: a character, or one unit of sixteen bits."""
        if self.escape[1] != "u":
            known = ESCAPES.get(self.escape[1])
            if known is None:
                self.place = END
            return known
        if len(self.escape) > 2 and self.escape[-1] not in "0123456789abcdefABCDEF":
            self.place = END
        return int(self.escape[2:], 16) if len(self.escape) == 6 and self.place != END else None

    def _take(self, unit: str | int, out: list[str]) -> None:
        if isinstance(unit, int) and 0xDC00 <= unit < 0xE000 and self.half:
            unit, self.half = chr(0x10000 + ((self.half - 0xD800) << 10) + unit - 0xDC00), 0
        else:
            self._lone_half(out)
            if isinstance(unit, int):
                if 0xD800 <= unit < 0xDC00:
                    self.half = unit
                    return
                unit = "\ufffd" if 0xDC00 <= unit < 0xE000 else chr(unit)
        self._emit(unit, out)

    def _lone_half(self, out: list[str]) -> None:
        if self.half:
            self.half = 0
            self._emit("\ufffd", out)

    def _emit(self, text: str, out: list[str]) -> None:
        if self.place == VALUE:
            out.append(text)
        elif len(self.key) <= len(self.field):
            self.key += text[: len(self.field) + 1 - len(self.key)]


def with_state(spark: SparkSession) -> None:
    """State machines keep their state in RocksDB; queries started from now on do."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class _Requests(StatefulProcessor):
    """A state machine a request: rows of a batch in the order of seq, and a timer that ends requests gone quiet."""

    timeout_ms: int | None = None

    def open(self) -> None:
        """Names the states."""

    def forget(self) -> None:
        """Clears them."""

    def step(self, request: str, rows: pd.DataFrame) -> tuple[list[tuple], bool]:
        """What to return for rows in their order, and whether the request has ended."""

    def quiet(self, request: str) -> list[tuple]:
        """What to return for a request that went quiet."""
        return []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open()

    def close(self) -> None:
        pass

    def _timer(self, now: int | None) -> None:
        if self.timeout_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if now is not None:
                self.handle.registerTimer(now + self.timeout_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        all_rows = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out, ended = self.step(key[0], all_rows)
        if ended:
            self.forget()
        self._timer(None if ended else timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.quiet(key[0])
        self.forget()
        yield pd.DataFrame(out, columns=self.columns)


def _run(rows: DataFrame, processor: _Requests, schema: str) -> DataFrame:
    with_state(rows.sparkSession)
    return rows.groupBy("request_id").transformWithStateInPandas(processor, schema, "append", "ProcessingTime" if processor.timeout_ms else "None")


class _Fields(_Requests):
    columns = ["request_id", "seq", "delta"]

    def __init__(self, field: str, timeout_ms: int | None):
        self.field, self.timeout_ms = field, timeout_ms

    def open(self) -> None:
        self.state = self.handle.getValueState("reader", "place int, key string, escape string, half int")

    def forget(self) -> None:
        self.state.clear()

    def step(self, request, rows):
        reader = FieldReader(self.field, *(self.state.get() if self.state.exists() else ()))
        out, ended = [], False
        for seq, fragment in zip(rows["seq"], rows["fragment"], strict=True):
            if ended := fragment is None:
                break
            if delta := reader.push(fragment):
                out.append((request, int(seq), delta))
        if not ended:
            self.state.update((reader.place, reader.key, reader.escape, reader.half))
        return out, ended


def field_deltas(chunks: DataFrame, field: str = "paragraph", timeout_ms: int | None = None) -> DataFrame:
    """request_id, seq, delta from a stream of request_id, seq, fragment; of a bounded table, too.

    A null fragment ends a request, whose state then goes; with a timeout, so does that of requests gone quiet. A query
    with a timeout runs batches without data to look for them, and so never comes to rest by itself.
    """
    return _run(chunks.select("request_id", "seq", "fragment"), _Fields(field, timeout_ms), "request_id string, seq long, delta string")


class _Lines(_Requests):
    columns = ["request_id", "seq", "line"]

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def open(self) -> None:
        # What a line has so far is appended to, never written again, so a line that comes in many batches costs its length.
        self.rest = self.handle.getListState("rest", "piece binary")
        self.count = self.handle.getValueState("count", "n long, has boolean")

    def forget(self) -> None:
        self.rest.clear()
        self.count.clear()

    def step(self, request, rows):
        n, has = self.count.get() if self.count.exists() else (0, False)
        data, ended = [], False
        for chunk in rows["chunk"]:
            if ended := chunk is None:
                break
            data.append(bytes(chunk))
        data = b"".join(data)
        first, *more = data.split(b"\n")
        out = []
        if not (more or ended):
            if data:
                self.rest.appendValue((data,))
            self.count.update((n, has or bool(data)))
            return out, False
        held = b"".join(p for (p,) in self.rest.get()) if has else b""
        lines = [held + first, *more]
        left = b"" if ended else lines.pop()
        for line in lines:
            text = line.decode("utf-8", "replace")
            if text.strip():
                out.append((request, n, text))
            n += 1
        if not ended:
            self.rest.clear()
            if left:
                self.rest.appendValue((left,))
            self.count.update((n, bool(left)))
        return out, ended

    def quiet(self, request):
        n, has = self.count.get() if self.count.exists() else (0, False)
        text = b"".join(p for (p,) in self.rest.get()).decode("utf-8", "replace") if has else ""
        return [(request, n, text)] if text.strip() else []


def framed_lines(chunks: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """request_id, seq (the line's number), line from a stream of request_id, seq, chunk (bytes), cut anywhere, within a
    character, too; of a bounded table as well. Blank lines are left out but counted; a null chunk ends a request, whose
    last line may lack its end, and so does a timeout."""
    return _run(chunks.select("request_id", "seq", "chunk"), _Lines(timeout_ms), "request_id string, seq long, line string")


class _Attempts(_Requests):
    columns = ["request_id", "status", "draft"]

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def open(self) -> None:
        self.draft = self.handle.getListState("draft", "text string")
        self.count = self.handle.getValueState("count", "retries int, has boolean")

    def forget(self) -> None:
        self.draft.clear()
        self.count.clear()

    def _held(self, has: bool) -> str:
        return "".join(t for (t,) in self.draft.get()) if has else ""

    def step(self, request, rows):
        retries, has = self.count.get() if self.count.exists() else (0, False)
        new: list[str] = []
        for kind, text in zip(rows["kind"], rows["text"], strict=True):
            if kind == "delta":
                new.append(text or "")
            elif kind == "retry":
                retries, has, new = retries + 1, False, []
                self.draft.clear()
                if retries > 1:
                    return [(request, "protocol-error", "")], True
            elif kind in ("result", "error"):
                return [(request, "completed" if kind == "result" else "failed", self._held(has) + "".join(new))], True
        if new:
            self.draft.appendValue(("".join(new),))
        self.count.update((retries, has or bool(new)))
        return [], False

    def quiet(self, request):
        _, has = self.count.get() if self.count.exists() else (0, False)
        return [(request, "interrupted", self._held(has))]


def attempt_results(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """request_id, status, draft once a request ends, from a stream of protocol events (request_id, seq, kind, text): delta,
    retry, result, error. A retry clears the draft and is allowed once; result and error end a request, as does a second
    retry (`protocol-error`) and, with a timeout, silence (`interrupted`)."""
    return _run(events.select("request_id", "seq", "kind", "text"), _Attempts(timeout_ms), "request_id string, status string, draft string")


def ndjson(chunks: DataFrame) -> DataFrame:
    """request_id, seq, line: whole lines of each request's chunks, blank ones aside; a last line may lack its end."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x.chunk), "")
    lines = chunks.groupBy("request_id").agg(F.split(text, "\n").alias("lines"))
    return lines.select("request_id", F.posexplode("lines").alias("seq", "line")).filter(F.trim("line") != "")


def checked_events(lines: DataFrame) -> DataFrame:
    """request_id, seq, response, done, problem of generator lines: each needs a string response and a boolean done."""
    v = F.try_parse_json("line")
    response, done = F.try_variant_get(v, "$.response", "variant"), F.try_variant_get(v, "$.done", "variant")
    ok = F.coalesce((F.schema_of_variant(response) == "STRING") & (F.schema_of_variant(done) == "BOOLEAN"), F.lit(False))
    return lines.select("request_id", "seq", F.try_variant_get(v, "$.response", "string").alias("response"), F.try_variant_get(v, "$.done", "boolean").alias("done"), F.when(~ok, "malformed").alias("problem"))


def completions(events: DataFrame) -> DataFrame:
    """request_id, text, status: the responses in order; a stream must end with done."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "response")))
    agg = events.groupBy("request_id").agg(
        F.array_join(F.transform(parts, lambda x: x.response), "").alias("text"), F.max_by("done", "seq").alias("ended"), F.count("problem").alias("problems")
    )
    return agg.select("request_id", "text", F.when(F.col("problems") > 0, "malformed").when(F.coalesce("ended", F.lit(False)), "completed").otherwise("interrupted").alias("status"))


def attempts(events: DataFrame) -> DataFrame:
    """request_id, status, draft from protocol events (request_id, seq, kind, text): delta, retry, result, error.

    A retry clears the draft; one retry is allowed; the last of result and error decides.
    """
    last_retry = F.max(F.when(F.col("kind") == "retry", F.col("seq")))
    marked = events.join(events.groupBy("request_id").agg(last_retry.alias("retry"), F.count_if(F.col("kind") == "retry").alias("retries")), "request_id")
    live = (F.col("kind") == "delta") & (F.col("retry").isNull() | (F.col("seq") > F.col("retry")))
    parts = F.array_sort(F.collect_list(F.when(live, F.struct("seq", "text"))))
    end = F.max_by("kind", F.when(F.col("kind").isin("result", "error"), F.col("seq")))
    out = marked.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x.text), "").alias("draft"), end.alias("end"), F.max("retries").alias("retries"))
    status = F.when(F.col("retries") > 1, "protocol-error").when(F.col("end") == "result", "completed").when(F.col("end") == "error", "failed").otherwise("open")
    return out.select("request_id", status.alias("status"), "draft")


def time_to_first(events: DataFrame) -> DataFrame:
    """request_id, seconds from the request to its first response that isn't empty (columns started, ts, response)."""
    first = F.min(F.when(F.char_length("response") > 0, F.col("ts")))
    return events.groupBy("request_id").agg((first.cast("double") - F.min("started").cast("double")).alias("seconds"))
