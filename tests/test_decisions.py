"""The decision client against a scripted server, and the working state."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from driftloom.operators import decision_client as C
from driftloom.operators import working_state as W

LONG = "lorem ipsum dolor sit amet " * 20


def answer(text):
    return json.dumps({"content": [{"type": "text", "text": text}]}).encode()


class Scripted:
    """A server whose answers depend on the first word of the content and how often it was asked."""

    def __init__(self, script):
        self.asked, self.bodies, self.headers, lock = Counter(), [], [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["content-length"])))
                said = body["messages"][0]["content"]
                word = said.split("<content>\n" if "<content>" in said else '">\n', 1)[1].split()[0]
                with lock:
                    outer.asked[word] += 1
                    nth = outer.asked[word]
                    outer.bodies.append(body)
                    outer.headers.append(dict(self.headers))
                status, headers, out, wait = script(word, nth)
                time.sleep(wait)
                self.send_response(status)
                for k, v in headers.items():
                    self.send_header(k, v)
                self.send_header("content-length", str(len(out)))
                self.end_headers()
                self.wfile.write(out)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}/v1/messages"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.server.shutdown()
        self.server.server_close()


def script(word, nth):
    if word == "limited":
        return (429, {"retry-after": "0"}, b"", 0) if nth < 3 else (200, {}, answer('{"choice":"summarize","summary_content":"short"}'), 0)
    if word == "always":
        return 529, {"retry-after": "0"}, b"", 0
    if word == "late":
        return 429, {"retry-after": "60"}, b"", 0
    if word == "slow":
        return 200, {}, answer('{"choice":"compress"}'), 5
    said = {
        "prose": "no braces", "broken": '{"choice": }', "odd": '{"choice":"delete"}', "ranges": 'So {"choice":"truncate","ranges_to_keep":[{"start":1,"end":3}]} it is',
        "bare": '{"choice":"truncate"}', "void": '{"choice":"summarize","summary_content":""}', "long": json.dumps({"choice": "summarize", "summary_content": "x" * 9_999}), "negative": '{"choice":"truncate","ranges_to_keep":[{"start":-1,"end":3}]}',
    }
    if word == "tool":
        return 200, {}, json.dumps({"content": [{"type": "tool_use", "id": "x"}]}).encode(), 0
    return (200, {}, answer(said[word]), 0) if word in said else (int(word), {}, b"", 0)


WANT = {
    "limited": ("summarize", 3, "ok"), "always": ("keep", 3, "status 529"), "late": ("keep", 1, "timeout"), "slow": ("keep", 1, "timeout"), "prose": ("keep", 1, "no json"), "broken": ("keep", 1, "unparsed"),
    "odd": ("keep", 1, "unparsed"), "ranges": ("truncate", 1, "ok"), "bare": ("keep", 1, "ok"), "void": ("compress", 1, "ok"), "long": ("keep", 1, "ok"), "negative": ("keep", 1, "unparsed"), "tool": ("keep", 1, "malformed"), "400": ("keep", 1, "status 400"), "500": ("keep", 1, "status 500"),
}


def test_decisions_over_http(spark):
    rows = [(k, f"{w} {LONG}", ["A", "B"] if k % 2 else None) for k, w in enumerate(WANT)] + [(90, "tiny", None), (91, None, None), (92, "", None)]
    df = spark.createDataFrame(rows, "id int, content string, tags array<string>").coalesce(2)
    with Scripted(script) as server:
        client = C.Client(C.http(server.url, {"x-key": "secret"}), model="some-model", parallel=3, deadline=2.0)
        got = {r["id"]: (r["content"], r["decision"]) for r in C.decided(df, client, tags="tags").collect()}
        assert len(got) == len(rows)
        for k, w in enumerate(WANT):
            content, d = got[k]
            assert (d["choice"], d["attempts"], d["outcome"]) == WANT[w], w
            assert content == f"{w} {LONG}"
            assert server.asked[w] == WANT[w][1]
        for k in (90, 91, 92):
            assert (got[k][1]["choice"], got[k][1]["attempts"], got[k][1]["outcome"]) == ("keep", 0, "gated")
        assert sum(server.asked.values()) == sum(x[1] for x in WANT.values())
        assert all({k.lower(): v for k, v in h.items()}["x-key"] == "secret" for h in server.headers)
        assert {b["model"] for b in server.bodies} == {"some-model"} and {b["max_tokens"] for b in server.bodies} == {C.DECISION_TOKENS}
        assert any("<tags>A, B</tags>" in b["messages"][0]["content"] for b in server.bodies)
        assert [tuple(r) for r in got[list(WANT).index("ranges")][1]["ranges_to_keep"]] == [(1, 3)]
    assert C.decided(df.limit(0), client).count() == 0


def test_nobody_listens():
    with Scripted(script) as server:
        url = server.url
    send, clock = C.http(url, {})()
    assert C.called(C.Client(None, "m"), send, clock, "s", "u", 1) == (None, 1, "unreachable")


def test_waits_and_deadline_on_a_clock_of_its_own():
    at, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        at[0] += s

    def client(answers, takes=0.0):
        left = iter(answers)

        def send(r):
            at[0] += takes
            return next(left)

        return send, C.Clock(lambda: at[0], sleep)

    ok, busy = C.Answer(200, answer("x")), C.Answer(529)
    cases = [
        ([busy, busy, ok], 0, ("x", 3, "ok"), [2.0, 8.0]), ([busy, busy, busy], 0, (None, 3, "status 529"), [2.0, 8.0]), ([C.Answer(429, retry_after="7"), ok], 0, ("x", 2, "ok"), [7.0]),
        ([C.Answer(429, retry_after="1.5"), ok], 0, ("x", 2, "ok"), [2.0]), ([C.Answer(429, retry_after="120"), ok], 0, (None, 1, "timeout"), []), ([busy, ok], 61, (None, 2, "timeout"), [2.0]), ([C.Answer(200, b"{}")], 0, (None, 1, "malformed"), []),
    ]
    for answers, takes, want, waited in cases:
        waits.clear()
        assert C.called(C.Client(None, "m"), *client(answers, takes), "s", "u", 1) == want
        assert waits == waited


STATE = {
    "constraints": [{"text": "never touch secrets", "source_message": "u1", "superseded_by": None}, {"text": "use staging", "source_message": "u2", "superseded_by": "u9"}],
    "decisions": [{"text": "port it", "rationale": "tested", "planned": False, "superseded_by": None}], "in_flight": {"task": "fold", "last_safe_point": "green", "open_files": ["a.py"], "skill_paths": ["b.md"]},
}


def test_states_are_read_whole_or_not_at_all():
    assert C.state_in(f"Here:\n{json.dumps(STATE)}\nDone.") == STATE
    assert C.state_in("{}") == C.EMPTY
    spare = json.loads(json.dumps(STATE))
    del spare["constraints"][0]["superseded_by"], spare["in_flight"]["open_files"]
    spare["more"] = 1
    assert C.state_in(json.dumps(spare)) == {**STATE, "in_flight": STATE["in_flight"] | {"open_files": []}}
    for change in ({"constraints": 1}, {"constraints": [{"text": "x"}]}, {"decisions": [{"text": "x", "rationale": "y"}]}, {"decisions": [{"text": "x", "rationale": "y", "planned": "no"}]}, {"in_flight": {"task": "x"}}, {"in_flight": []}, {"constraints": [{"text": "x", "source_message": "y", "superseded_by": 3}]}):
        with pytest.raises(ValueError):
            C.state_in(json.dumps(STATE | change))
    for text in ("", "none", "}{"):
        with pytest.raises(LookupError):
            C.state_in(text)


def test_an_error_keeps_the_previous_state():
    answers = iter([json.dumps(STATE), None, "prose", '{"constraints": 3}'])
    state = C.EMPTY
    for good in (True, False, False, False):
        state, held = W.folded(state, "m", "t", lambda *a: next(answers))
        assert held == good and state == STATE


def test_noting_ends_what_a_later_item_replaces():
    ask, state = W.noting(), C.EMPTY
    for message, text in [("user:0", "Use tabs. Please."), ("assistant:1", "Edit a/b.py, then c.py.\nmore"), ("user:2", "use spaces, see notes.md"), ("system:3", "Use nothing."), ("assistant:4", "Edit a/b.py again")]:
        state, _ = W.folded(state, message, text, ask)
    assert [(c["text"], c["superseded_by"]) for c in state["constraints"]] == [("Use tabs", "user:2"), ("use spaces, see notes", None)]
    assert [(d["text"], d["planned"], d["superseded_by"]) for d in state["decisions"]] == [("Edit a/b", False, "assistant:4"), ("Edit a/b", False, None)]
    assert state["in_flight"] == {"task": "use spaces, see notes", "last_safe_point": "assistant:4", "open_files": ["a/b.py", "c.py"], "skill_paths": ["notes.md"]}


def test_batch_folds_in_order_with_odd_rows(spark):
    rows = [(1, 2, "user:2", "b. x"), (1, 0, "user:0", "a. x"), (2, 0, "user:0", None), (None, 0, "user:0", "x"), (1, None, "user:9", "x"), (3, 0, None, "z"), (1, 1, "assistant:1", "a, c")]
    df = spark.createDataFrame(rows, "session_id long, turn long, message string, text string")
    got = {r["session_id"]: r for r in W.batch_states(df).collect()}
    assert set(got) == {1, 2, 3}
    assert [c["text"] for c in got[1]["state"]["constraints"]] == ["a", "b"] and got[1]["state"]["in_flight"]["last_safe_point"] == "assistant:1"
    assert (got[2]["turns"], got[2]["failed"], got[2]["state"]["in_flight"]) == (1, 1, None) and got[3]["failed"] == 1
    assert W.batch_states(df.limit(0)).count() == 0


def test_a_model_folds_over_http(spark):
    def script(word, nth):
        return (500, {}, b"", 0) if word == "bad" else (200, {}, answer(json.dumps(STATE | {"decisions": []}) if word == "second" else json.dumps(STATE)), 0)

    df = spark.createDataFrame([(1, 0, "u", "first turn"), (1, 1, "u", "bad turn"), (2, 0, "u", "bad turn"), (3, 0, "u", "first turn"), (3, 1, "u", "second turn")], "session_id long, turn long, message string, text string")
    with Scripted(script) as server:
        got = {r["session_id"]: r for r in W.batch_states(df, C.folded_by(C.Client(C.http(server.url, {}), "m"))).collect()}
        assert {b["max_tokens"] for b in server.bodies} == {C.FOLD_TOKENS}
    assert [len(got[k]["state"]["decisions"]) for k in (1, 2, 3)] == [1, 0, 0]
    assert [got[k]["failed"] for k in (1, 2, 3)] == [1, 1, 0]
    assert got[1]["state"]["in_flight"]["skill_paths"] == ["b.md"] and got[2]["state"]["in_flight"] is None
