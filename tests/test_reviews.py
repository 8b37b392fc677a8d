import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quarrymill.operators import reviews, script_table

GOOD = {"is_plagiarism": True, "confidence": 0.75, "reasoning": "same"}
AUDIT = {"structural_match": 0.5, "logic_flow_similarity": True, "variable_patterns": "similar", "comments_analysis": "c", "code_origin": "o", "recommendation": "CLEAR"}


class Server(ThreadingHTTPServer):
    """Replies by what the first program says: each text has its own list of replies (status, body), the last of which repeats."""

    def __init__(self, script):
        self.script, self.lock, self.asked, self.now, self.most, self.times = script, threading.Lock(), {}, 0, 0, []
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"http://127.0.0.1:{self.server_port}/api"


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def do_POST(self):
        server = self.server
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
        code = text.split("First:\n", 1)[1].split("\n", 1)[0]
        with server.lock:
            server.now += 1
            server.most = max(server.most, server.now)
            server.times.append(time.monotonic())
            n = server.asked[code] = server.asked.get(code, 0) + 1
        time.sleep(0.02)
        replies = server.script(code)
        status, body = replies[min(n, len(replies)) - 1]
        with server.lock:
            server.now -= 1
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())


def script(code):
    ok, full = (200, "Well: " + json.dumps(GOOD)), (200, json.dumps(GOOD | {"audit": AUDIT}))
    return {
        "good": [ok, (200, "x " + json.dumps(AUDIT) + " y")], "full": [full], "busy": [(429, ""), (503, "no"), full], "down": [(500, "no")], "odd": [(200, json.dumps(GOOD | {"confidence": 1.5}))], "empty": [(200, json.dumps(GOOD | {"reasoning": ""}))],
        "none": [(200, "no object")], "typed": [(200, json.dumps(GOOD | {"is_plagiarism": 1}))], "half": [ok, (200, "{}")], "late": [ok, (500, "no")],
    }.get(code.rstrip("0123456789"), [full])


WANT = {
    "good": (True, True, None, 2), "full": (True, True, None, 2), "busy": (True, True, None, 4), "down": (False, False, ("verdict", "http"), 4), "odd": (False, False, ("verdict", "invalid_response"), 1), "empty": (False, False, ("verdict", "invalid_response"), 1),
    "none": (False, False, ("verdict", "invalid_response"), 1), "typed": (False, False, ("verdict", "invalid_response"), 1), "half": (True, False, ("audit", "invalid_response"), 2), "late": (True, False, ("audit", "http"), 2),
}


def shown(r):
    return r["verdict"] is not None, r["audit"] is not None, r["error"] and (r["error"]["call"], r["error"]["kind"]), r["calls"]


def test_verdicts_audits_retries_and_bounds(spark):
    server = Server(script)
    try:
        rows = [(f"{name}{i}", 0.5) for name in WANT for i in range(6)]
        pairs = spark.createDataFrame(rows, "code_a string, similarity double").selectExpr("code_a AS id", "code_a", "CAST(NULL AS STRING) AS code_b", "similarity")
        url = server.url
        got = reviews.review(pairs, lambda: reviews.http_call(url, "m"), "id", policy=reviews.Policy(first_delay_s=0.01), parts=2, most=3)
        assert {r["id"]: shown(r) for r in got.collect()} == {name: WANT[name.rstrip("0123456789")] for name, _ in rows}
        assert 1 < server.most <= 6 and got.count() == 60
        asked = sum(server.asked.values())
        assert asked == sum(w[3] for w in WANT.values()) * 6  # reading the table doesn't call again
        first = got.where("id = 'full0'").first()
        assert tuple(first["verdict"]) == (True, 0.75, "same") and first["audit"]["recommendation"] == "CLEAR"
        # refused calls only are tried again, and no audit is asked for
        server.asked.clear()
        got = reviews.review(pairs, lambda: reviews.http_call(url, "m"), "id", policy=reviews.Policy(3, 0.01, refused_only=True), audit=False, parts=1, most=4)
        calls = {r["id"]: r["calls"] for r in got.collect()}
        assert calls["down0"] == 1 and calls["busy0"] == 2 and calls["good0"] == 1
        # a rate for the whole job
        server.times.clear()
        few = pairs.where("id LIKE 'full%'")
        reviews.review(few, lambda: reviews.http_call(url, "m"), "id", parts=2, most=8, rate=20.0)
        assert len(server.times) == 12 and max(server.times) - min(server.times) > 0.4
        assert reviews.review(few.where("false"), lambda: reviews.http_call(url, "m"), "id").collect() == []
    finally:
        server.shutdown()
        server.server_close()


def test_no_reply_is_an_error():
    with pytest.raises(reviews.CallError) as e:
        reviews.http_call("http://127.0.0.1:9/", "m", 2)("x")
    assert e.value.kind == "http" and e.value.status is None


def test_order_is_kept_and_rows_are_taken_as_room_is_made():
    taken, done = [], []

    def rows():
        for i in range(50):
            taken.append(i)
            assert len(taken) - len(done) <= 9
            yield i

    for x in reviews.in_order(rows(), lambda i: (time.sleep(0.01 * (i % 3)), i)[1], 4):
        done.append(x)
    assert done == list(range(50))


def test_bucket_by_a_clock():
    clock = [0.0]
    waits = []
    bucket = reviews.Bucket(2.0, 3, lambda: clock[0], waits.append)
    for _ in range(6):
        bucket.take()
    assert waits == [0.5, 1.0, 1.5]
    clock[0] = 10.0
    bucket.take()
    assert len(waits) == 3


GOOD_LINE = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b","function_call":{"name":"f","arguments":"{}"}}],"thinking":"t"}'


def test_scripts_as_a_table_function(spark):
    with pytest.raises(PermissionError):
        script_table.register(spark)
    script_table.register(spark, allow=True)
    sources = [f"print({GOOD_LINE!r})\nprint()\nprint({GOOD_LINE!r}, end='\\r\\n')\nraise SystemExit(3)", f"print({GOOD_LINE!r})\nprint('no')", "pass", "import os\nos.system('ls')", "import time\ntime.sleep(9)", None]
    spark.createDataFrame(list(enumerate(sources)), "ord int, source string").createOrReplaceTempView("scripts")
    got = spark.sql("SELECT ord, r.* FROM scripts s, LATERAL run_script(s.source, 2) r ORDER BY ord, line").collect()
    assert [(r["ord"], r["line"], r["error"] and (r["error"]["kind"], r["error"]["line"]), r["exit_code"]) for r in got] == [
        (0, 1, None, 3), (0, 3, None, 3), (1, None, ("invalid_output", 2), 0), (2, None, ("invalid_output", None), 0), (3, None, ("security_violation", None), None), (4, None, ("timeout", None), None), (5, None, ("invalid_output", None), None),
    ]
    assert got[0]["messages"][1]["function_call"]["name"] == "f" and got[0]["thinking"] == "t" and got[0]["function_calls"] is None
    met = spark.sql("SELECT m.role, count(*) AS n FROM scripts s, LATERAL run_script(s.source, 2) r LATERAL VIEW explode(r.messages) AS m GROUP BY m.role ORDER BY 1").collect()
    assert [tuple(r) for r in met] == [("assistant", 2), ("user", 2)]
