"""Reviews by a language model: bounded calls at a time, a rate, retries, and a second call for the audit of a verdict."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.sources.shared import written

Call = Callable[[str], str]


class CallError(Exception):
    """kind: http, timeout or invalid_response; status of the reply, if there was one."""

    def __init__(self, kind: str, message: str = "", status: int | None = None) -> None:
        super().__init__(message)
        self.kind, self.status = kind, status


def http_call(endpoint: str, model: str, timeout_s: float = 60.0) -> Call:
    """One prompt to an endpoint as a chat of one message; the body of the reply."""

    def call(prompt: str) -> str:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt}], "stream": False}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(endpoint, body, {"Content-Type": "application/json"}), timeout=timeout_s) as reply:
                return reply.read().decode(errors="replace")
        except urllib.error.HTTPError as e:
            raise CallError("http", f"HTTP {e.code}", e.code) from e
        except TimeoutError as e:
            raise CallError("timeout") from e
        except OSError as e:  # URLError too
            raise CallError("timeout" if isinstance(getattr(e, "reason", None), TimeoutError) else "http", str(e)) from e

    return call


@dataclass(frozen=True)
class Policy:
    """attempts in all, with a doubled delay after each that may be tried again: refused ones (status 429) only, or every error but a reply that makes no sense."""

    attempts: int = 4
    first_delay_s: float = 1.0
    refused_only: bool = False

    def again(self, error: CallError) -> bool:
        return error.status == 429 if self.refused_only else error.kind != "invalid_response"

    def run(self, call: Callable[[], object]) -> object:
        for i in range(self.attempts):
            try:
                return call()
            except CallError as e:
                if i + 1 == self.attempts or not self.again(e):
                    raise
                time.sleep(self.first_delay_s * 2**i)
        raise CallError("http", "no attempts")


class Bucket:
    """At most `rate` calls a second over time, `burst` at once."""

    def __init__(self, rate: float, burst: int = 1, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.burst, self._now, self._sleep = rate, burst, now, sleep
        self._left, self._at, self._lock = float(burst), now(), threading.Lock()

    def take(self) -> None:
        with self._lock:  # the wait of each call is settled here, so calls go in the order in which they came
            now = self._now()
            self._left = min(self.burst, self._left + (now - self._at) * self.rate) - 1
            self._at, wait = now, max(0.0, -self._left / self.rate)
        if wait:
            self._sleep(wait)


def in_order(rows: Iterator, work: Callable, most: int) -> Iterator:
    """work of each row, at most `most` at a time, in the order of rows; rows are taken as room is made."""
    waiting: deque[Future] = deque()
    with ThreadPoolExecutor(most) as pool:
        for row in rows:
            waiting.append(pool.submit(work, row))
            if len(waiting) >= 2 * most:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def outer_object(body: str) -> dict:
    """The outermost JSON object of a reply."""
    start, end = body.find("{"), body.rfind("}")
    if start < 0 or end < start:
        raise CallError("invalid_response", "no JSON object")
    try:
        found = json.loads(body[start : end + 1])
    except ValueError as e:
        raise CallError("invalid_response", f"no JSON: {e}") from e
    return found


def _is(value: object, kind: str) -> bool:
    return {"bool": isinstance(value, bool), "text": isinstance(value, str), "number": isinstance(value, int | float) and not isinstance(value, bool)}[kind]


def _take(found: object, fields: dict[str, str]) -> dict:
    for name, kind in fields.items():
        if not isinstance(found, dict) or not _is(found.get(name), kind):
            raise CallError("invalid_response", f"field `{name}`")
    return {name: float(found[name]) if kind == "number" else found[name] for name, kind in fields.items()}


# fixed values: fields of the replies
VERDICT = {"is_plagiarism": "bool", "confidence": "number", "reasoning": "text"}
AUDIT = {"structural_match": "number", "logic_flow_similarity": "bool", "variable_patterns": "text", "comments_analysis": "text", "code_origin": "text", "recommendation": "text"}


def verdict_of(body: str) -> dict:
    found = _take(outer_object(body), VERDICT)
    if not 0.0 <= found["confidence"] <= 1.0 and found["confidence"] == found["confidence"]:
        raise CallError("invalid_response", "confidence out of range")
    if not found["reasoning"]:
        raise CallError("invalid_response", "empty reasoning")
    return found


def audit_of(body: str) -> dict:
    """The audit's fields: of the reply's object `audit`, if it has one, else of the reply itself."""
    found = outer_object(body)
    return _take(found["audit"] if isinstance(found, dict) and isinstance(found.get("audit"), dict) else found, AUDIT)


def prompt(code_a: str, code_b: str, similarity: float) -> str:
    """Asks for a verdict and its audit."""
    fields = {**{k: v for k, v in VERDICT.items()}, "audit": AUDIT}
    return f"Two programs have {similarity * 100:.1f}% of their structure in common. Was one taken from the other? Look at the flow of logic, the names, the comments and the origin.\n\nFirst:\n{code_a}\n\nSecond:\n{code_b}\n\nAnswer with one JSON object of these fields and kinds: {json.dumps(fields)}"


_KINDS = {"bool": pa.bool_(), "text": pa.string(), "number": pa.float64()}
_REVIEW = [("verdict", pa.struct([(n, _KINDS[k]) for n, k in VERDICT.items()])), ("audit", pa.struct([(n, _KINDS[k]) for n, k in AUDIT.items()])), ("error", pa.struct([("call", pa.string()), ("kind", pa.string()), ("message", pa.string())])), ("calls", pa.int32())]


def review(
    pairs: DataFrame, make_call: Callable[[], Call], key: str, a: str = "code_a", b: str = "code_b", similarity: str = "similarity", policy: Policy = Policy(), audit: bool = True, parts: int = 4, most: int = 8, rate: float | None = None
) -> DataFrame:
    """The written table (key, verdict, audit, error<call, kind, message>, calls), a row for each pair.

    make_call(): on an executor, what sends one prompt and gives the reply's body. The verdict is asked for under `policy`, then, if there is one and audit is set, the audit, once. A failed
    verdict has neither; a failed audit leaves the verdict. A null code counts as empty, a null similarity as 0. parts tasks at most have calls under way, `most` each, so parts * most calls at a time over the whole cluster, and rate calls a second in all, retries
    counted. Rows of a task stay in order. A task that is lost is tried again and calls again; the table is written once, so reading it doesn't.
    """
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send, bucket, schema = make_call(), Bucket(rate / parts) if rate else None, None

        def one(row: dict) -> dict:
            made = 0

            def ask(read: Callable[[str], dict]) -> dict:
                nonlocal made
                if bucket:
                    bucket.take()
                made += 1
                return read(send(text))

            text = prompt(row["a"] or "", row["b"] or "", row["s"] or 0.0)
            out = {"key": row["key"], "verdict": None, "audit": None, "error": None}
            step = "verdict"
            try:
                out["verdict"] = policy.run(lambda: ask(verdict_of))
                step = "audit"
                if audit:
                    out["audit"] = ask(audit_of)
            except CallError as e:
                out["error"] = {"call": step, "kind": e.kind, "message": str(e)}
            return out | {"calls": made}

        def rows() -> Iterator[dict]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("key", batch.schema.field("key").type), *_REVIEW])
                for i in range(0, batch.num_rows, 100):
                    yield from batch.slice(i, 100).to_pylist()

        held = []
        for out in in_order(rows(), one, most):
            held.append(out)
            if len(held) == 100:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    sent = pairs.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(similarity).cast("double").alias("s")).repartition(parts)
    types = {"bool": "boolean", "text": "string", "number": "double"}
    shape = lambda fields: "struct<" + ",".join(f"{n}:{types[k]}" for n, k in fields.items()) + ">"
    out = sent.mapInArrow(run, f"key {kind}, verdict {shape(VERDICT)}, audit {shape(AUDIT)}, error struct<call:string,kind:string,message:string>, calls int")
    return written(out.withColumnRenamed("key", key), "reviews")


def judge(similarity: float) -> Call:
    """An offline reviewer that finds plagiarism from this similarity on, for tests and dry runs: what it says follows from the prompt alone."""

    def call(text: str) -> str:
        share = float(text.split("% of", 1)[0].rsplit(" ", 1)[1]) / 100
        found = {"is_plagiarism": share >= similarity, "confidence": share, "reasoning": "structure" if share >= similarity else "differs"}
        return "So: " + json.dumps(found | {"audit": {"structural_match": share, "logic_flow_similarity": share >= similarity, "variable_patterns": "similar", "comments_analysis": "none", "code_origin": "unknown", "recommendation": "CONFIRM_PLAGIARISM" if share >= similarity else "CLEAR"}})

    return call
