"""Queries over request bodies of many shapes: what is read from them, and what goes into them.

A document makes a request of one to four exchanges of seven kinds, told by its id: a tool used and answered
by the document, a turn with reasoning, a system message, an answer to nothing, a server tool, two tools at
once, the document typed by a human; and at the end a question, or a tool use that is still open.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..operators import budget, relay, render, segments
from ..operators.segments import KEY
from ..sources import wire
from .session_queries import read

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


EXCHANGES = 4
SIZES = (3, 1, 1, 1, 1, 2, 1)  # messages of each kind of exchange
THOUGHT, SAID = '{"type":"thinking","thinking":"hm, let me see"}', '{"type":"text","text":"so it is"}'
SERVER = ('{"type":"server_tool_use","id":"s1","name":"web","input":{}}', '{"type":"web_search_tool_result","tool_use_id":"s1","content":[]}', '{"type":"text","text":"found"}')
HEAD = '{"model":"model-large", "max_tokens": 4000, "system":"be brief", "zeta":1.10, "messages":['


def quoted(c):
    """A text as JSON."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.char_length(whole) - 2)


def bodies(spark, d):
    """session_id, body, text, and the kind of each exchange (null beyond the last)."""
    doc = F.col("doc_id").cast("long")
    t, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("x"))
    kinds = [F.when(F.lit(k) <= doc % EXCHANGES, (doc + 3 * k) % 7) for k in range(EXCHANGES)]

    def use(k, i):
        return F.concat(F.lit('{"type":"tool_use","id":"t'), doc.cast("string"), F.lit(f'_{k}{i}","name":'), quoted(lang), F.lit(',"input":{"q":1}}'))

    def result(k, i, content):
        return F.concat(F.lit('{"type":"tool_result","tool_use_id":"t'), doc.cast("string"), F.lit(f'_{k}{i}","content":'), content, F.lit("}"))

    def message(role, *blocks):
        return F.concat(F.lit(f'{{"role":"{role}","content":['), F.concat_ws(",", *blocks), F.lit("]}"))

    def typed(role, json):
        return F.concat(F.lit(f'{{"role":"{role}","content":'), json, F.lit("}"))

    def exchange(k):
        cases = [
            F.array(typed("user", F.lit(f'"what is {k}?"')), message("assistant", use(k, "a")), message("user", result(k, "a", quoted(t)))),
            F.array(message("assistant", F.lit(THOUGHT), F.lit(SAID))),
            F.array(typed("system", F.lit('"mind the gap"'))),
            F.array(message("user", result(k, "x", F.lit('"late"')))),
            F.array(message("assistant", *map(F.lit, SERVER))),
            F.array(message("assistant", use(k, "a"), use(k, "b")), message("user", result(k, "a", F.lit('"no","is_error":true')), result(k, "b", F.lit('[{"type":"text","text":"x"},{"type":"text","text":"y"}]')))),
            F.array(typed("user", quoted(t))),
        ]
        out = F.expr("cast(array() as array<string>)")
        for c, made in enumerate(cases):
            out = F.when(kinds[k] == c, made).otherwise(out)
        return out

    end = F.array(F.when(doc % 5 == 0, message("assistant", use(99, "z"))).otherwise(typed("user", F.lit('"and now?"'))))
    messages = F.flatten(F.array(*map(exchange, range(EXCHANGES)), end))
    body = F.concat(F.lit(HEAD), F.array_join(messages, ", "), F.lit("]}"))
    return read(spark, d, "documents").select(doc.alias(KEY), body.alias("body"), t.alias("text"), F.array(*kinds).alias("kinds"))


def messages(spark, d):
    """The messages of all bodies, read once and kept in the shared folder: segments are made of them and joined to them."""
    return scratch.written(wire.read_bodies(bodies(spark, d)), "messages")


BODY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, 'x') AS lang FROM documents),
x AS (SELECT *, (doc_id + 3 * k) % 7 AS c FROM (SELECT *, unnest(range(0, doc_id % {EXCHANGES} + 1)) AS k FROM d)),
y AS (SELECT doc_id, t, lang, k, c, j FROM x JOIN (VALUES (0, 0), (0, 1), (0, 2), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1), (6, 0)) v(c, j) USING (c)
  UNION ALL SELECT doc_id, t, lang, 99, CASE WHEN doc_id % 5 = 0 THEN 7 ELSE 8 END, 0 FROM d),
z AS (SELECT *, '{{"type":"tool_use","id":"t' || doc_id || '_' || k AS use, '{{"type":"tool_result","tool_use_id":"t' || doc_id || '_' || k AS res, '","name":' || to_json(lang)::VARCHAR || ',"input":{{"q":1}}}}' AS rest FROM y),
m0 AS (SELECT doc_id, k, c, j, t,
  CASE WHEN c = 2 THEN 'system' WHEN c IN (1, 4, 7) OR (c = 0 AND j = 1) OR (c = 5 AND j = 0) THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN c = 0 AND j = 0 THEN 'what is ' || k || '?' WHEN c = 2 THEN 'mind the gap' WHEN c = 6 THEN t WHEN c = 8 THEN 'and now?' END AS said,
  CASE WHEN c = 0 AND j = 1 THEN [use || 'a' || rest] WHEN c = 0 AND j = 2 THEN [res || 'a","content":' || to_json(t)::VARCHAR || '}}'] WHEN c = 1 THEN ['{THOUGHT}', '{SAID}'] WHEN c = 3 THEN [res || 'x","content":"late"}}']
    WHEN c = 4 THEN ['{SERVER[0]}', '{SERVER[1]}', '{SERVER[2]}'] WHEN c = 5 AND j = 0 THEN [use || 'a' || rest, use || 'b' || rest]
    WHEN c = 5 THEN [res || 'a","content":"no","is_error":true}}', res || 'b","content":[{{"type":"text","text":"x"}},{{"type":"text","text":"y"}}]}}'] WHEN c = 7 THEN [use || 'z' || rest] END AS blocks FROM z),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS msg, coalesce(said, array_to_string(blocks, '')) AS rendered, CASE WHEN (c = 0 AND j > 0) THEN 1 ELSE 0 END AS g,
  '{{"role":"' || role || '","content":' || CASE WHEN said IS NULL THEN '[' || array_to_string(blocks, ',') || ']' ELSE to_json(said)::VARCHAR END || '}}' AS span FROM m0),
s0 AS (SELECT doc_id, k, c, g, min(msg) AS msg, string_agg(rendered, '' ORDER BY j) AS rendered, CASE WHEN count(*) > 1 THEN 'tool_pair' WHEN min(role) = 'user' THEN 'user_turn' WHEN min(role) = 'assistant' THEN 'assistant_turn' ELSE 'system' END AS kind,
    min(role) = 'user' AND count(said) = 1 AND count(*) = 1 AS human FROM m GROUP BY ALL
  UNION ALL SELECT doc_id, -1, -1, 0, -1, '"be brief"', 'system', false FROM d),
s AS (SELECT *, row_number() OVER w - 1 AS seg_index, count(*) FILTER (kind = 'user_turn') OVER w AS generation, count(*) OVER (PARTITION BY doc_id) AS n, ceil(length(rendered) / 3.5::DOUBLE)::BIGINT AS tokens FROM s0 WINDOW w AS (PARTITION BY doc_id ORDER BY msg)),
e AS (SELECT *, seg_index = n - 1 AS is_current, seg_index = n - 1 OR c = 7 AS pinned, kind = 'user_turn' AND human AS salient,
  CASE WHEN c = 1 AND seg_index < max(seg_index) FILTER (kind = 'assistant_turn') OVER (PARTITION BY doc_id) THEN greatest(tokens - ceil(length('{SAID}') / 3.5::DOUBLE)::BIGINT, 0) END AS shed FROM s)
"""


@query("tool_pairs", BODY + "SELECT doc_id AS session_id, seg_index::INT AS seg_index, kind, generation::INT AS generation, tokens, pinned FROM e")
def tool_pairs(spark, d):
    s = segments.segment_table(wire.read_bodies(bodies(spark, d)))
    return s.select(KEY, F.col("seg_index").cast("int").alias("seg_index"), "kind", F.col("generation").cast("int").alias("generation"), F.col("token_estimate").alias("tokens"), "pinned")


@query("block_classes", BODY + "SELECT CASE json_extract_string(b, '$.type') WHEN 'web_search_tool_result' THEN 'server_tool_result' ELSE json_extract_string(b, '$.type') END AS kind, count(*) AS n FROM (SELECT unnest(blocks) AS b FROM m) GROUP BY ALL")
def block_classes(spark, d):
    m = wire.read_bodies(bodies(spark, d)).select(F.explode("blocks").alias("b"))
    return m.groupBy("b.kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "squash_targets",
    BODY + """SELECT m.doc_id AS session_id, e.seg_index::INT AS seg_index, m.msg::INT AS msg_index, CASE WHEN said IS NULL THEN 0 END AS block_index, ceil(length(t) / 3.5::DOUBLE)::BIGINT AS original_tokens, CASE WHEN said IS NULL THEN 'tool_result' ELSE 'string_content' END AS slot
FROM m JOIN e ON e.doc_id = m.doc_id AND e.k = m.k AND e.g = m.g WHERE (m.c = 6 AND strlen(to_json(said)::VARCHAR) > 256) OR (m.c = 0 AND m.j = 2 AND strlen(blocks[1]) > 256)""",
)
def squash_targets(spark, d):
    m = messages(spark, d)
    found = wire.replaceable_blocks(segments.segment_table(m), m)
    return found.select(KEY, F.col("seg_index").cast("int").alias("seg_index"), F.col("msg_index").cast("int").alias("msg_index"), "block_index", "original_tokens", "slot")


@query("tool_names", BODY + "SELECT doc_id AS session_id, e.seg_index::INT AS seg_index, lang AS tool, 't' || doc_id || '_' || k || 'a' AS tool_use_id FROM e JOIN d USING (doc_id) WHERE kind = 'tool_pair'")
def tool_names(spark, d):
    m = messages(spark, d)
    return render.tool_names(segments.segment_table(m), m).select(KEY, F.col("seg_index").cast("int").alias("seg_index"), "tool", "tool_use_id")


@query("reasoning_shed", BODY + "SELECT doc_id AS session_id, seg_index::INT AS seg_index, shed FROM e WHERE kind = 'assistant_turn'")
def reasoning_shed(spark, d):
    m = messages(spark, d)
    s = render.reasoning_shed(segments.segment_table(m), m).where("kind = 'assistant_turn'")
    return s.select(KEY, F.col("seg_index").cast("int").alias("seg_index"), "shed")


@query(
    "fallback_rungs",
    BODY + """, a AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id) AS total, kind = 'tool_pair' AND NOT pinned AND NOT salient AS pair FROM e),
b AS (SELECT *, shed IS NOT NULL AND total > 256 AS first FROM a),
f AS (SELECT *, total - coalesce(sum(shed) FILTER (first) OVER (PARTITION BY doc_id), 0) AS rest1 FROM b),
h AS (SELECT *, pair AND rest1 - coalesce(sum(tokens) FILTER (pair) OVER (PARTITION BY doc_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 256 AS second FROM f),
i AS (SELECT *, rest1 - coalesce(sum(tokens) FILTER (second) OVER (PARTITION BY doc_id), 0) AS rest2, NOT second AND kind <> 'system' AND NOT is_current AS old FROM h),
l AS (SELECT *, old AND rest2 - coalesce(sum(tokens) FILTER (old) OVER (PARTITION BY doc_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 256 AS third FROM i)
SELECT doc_id AS session_id, 1 AS rung, seg_index::INT AS seg_index, shed AS tokens FROM l WHERE first UNION ALL SELECT doc_id, 2, seg_index::INT, tokens FROM l WHERE second UNION ALL SELECT doc_id, 3, seg_index::INT, tokens FROM l WHERE third""",
)
def fallback_rungs(spark, d):
    m = messages(spark, d)
    s = render.reasoning_shed(segments.with_salience(segments.segment_table(m)), m)
    return budget.drop_ladder(s, F.lit(256)).select(KEY, "rung", F.col("seg_index").cast("int").alias("seg_index"), "tokens")


def rewritten(spark, d):
    """The first tool answer of a request replaced, in six ways by the id of the document, three of them wrong; where there
    is none, the reasoning of its first turn that has some is cut; and else nothing is changed."""
    b = bodies(spark, d)
    t, doc = F.col("text"), F.col(KEY)
    sizes = F.array(*map(F.lit, SIZES))
    before = [sum((F.when(F.col("kinds")[q].isNotNull(), F.get(sizes, F.col("kinds")[q].cast("int"))).otherwise(0) for q in range(k)), F.lit(0)) for k in range(EXCHANGES)]
    first = lambda c, plus: F.coalesce(*[F.when(F.col("kinds")[k] == c, F.struct(F.lit(k).alias("k"), (before[k] + plus).cast("int").alias("at"))) for k in range(EXCHANGES)])
    answer, thought, way = first(0, 2), first(1, 0), doc % 6
    mark = X.placeholder(X.content_address(t), X.token_estimate(t), X.byte_length(t), F.lit("one document"))
    own = F.concat(F.lit("t"), doc.cast("string"), F.lit("_"), answer["k"].cast("string"), F.when(way == 2, "q").otherwise("a"))
    marked = F.to_json(F.struct(F.lit("tool_result").alias("type"), own.alias("tool_use_id"), mark.alias("content")))
    hints = F.to_json(F.struct(F.lit("tool_result").alias("type"), own.alias("tool_use_id"), F.array_repeat(F.struct(F.lit(1).alias("cache_control")), 5).alias("content")))
    block = F.when(way == 3, 7).otherwise(0)
    json = F.when(way == 4, F.lit("3")).when(way == 5, hints).otherwise(marked)
    none = F.expr("cast(array() as array<struct<message: int, block: int, json: string>>)")
    cut = F.array(F.struct(thought["at"].alias("message"), F.lit(0).alias("block"), F.lit('{"type":"thinking","thinking":"hm"}').alias("json")))
    target = F.when(answer.isNotNull(), F.array(F.struct(answer["at"].alias("message"), block.alias("block"), json.alias("json")))).when(thought.isNotNull(), cut).otherwise(none)
    at = F.when(answer.isNotNull() & (way == 0), F.array(answer["at"])).otherwise(F.expr("cast(array() as array<int>)"))
    return b.select(KEY, "body", wire.rewrite_udf("body", target, at).alias("r"))


GATE = BODY + """, marks AS (SELECT doc_id, 'sha256:' || sha256(t) AS ref, '[stored segment | ref=sha256:' || sha256(t) || ' | ~' || ceil(length(t) / 3.5::DOUBLE)::BIGINT || ' tokens | ' || strlen(t) || ' bytes]' || chr(10) || 'one document' || chr(10) || 'Full text: retrieve("sha256:' || sha256(t) || '")' AS mark FROM d),
o AS (SELECT doc_id, min(k) FILTER (c = 0) AS ka, min(k) FILTER (c = 1) AS kt, bool_or(c IN (3, 7)) AS loose, max(k) FILTER (role = 'assistant') AS last_turn FROM m GROUP BY doc_id),
w AS (SELECT o.*, doc_id % 6 AS way, strlen(b.blocks[1]) AS old_size, '{' || CASE WHEN doc_id % 6 = 0 THEN '"cache_control":{"type":"ephemeral"},' ELSE '' END || '"content":' || to_json(mark)::VARCHAR || ',"tool_use_id":"t' || doc_id || '_' || ka || 'a","type":"tool_result"}' AS block
  FROM o JOIN marks USING (doc_id) LEFT JOIN (SELECT doc_id, k, blocks FROM m WHERE c = 0 AND j = 2) b ON b.doc_id = o.doc_id AND b.k = ka),
v AS (SELECT *, CASE WHEN ka IS NOT NULL AND way = 3 THEN 'splice' WHEN ka IS NOT NULL AND way = 4 THEN 'reparse' WHEN loose OR (ka IS NOT NULL AND way = 2) THEN 'unpaired_tools' WHEN ka IS NOT NULL AND way = 5 THEN 'too_many_hints'
  WHEN ka IS NOT NULL THEN CASE WHEN strlen(block) >= old_size THEN 'grew' END WHEN kt IS NULL THEN 'grew' WHEN kt = last_turn THEN 'thinking_changed' END AS error FROM w)
"""


@query("gate_checks", GATE + "SELECT doc_id AS session_id, error FROM v")
def gate_checks(spark, d):
    return rewritten(spark, d).select(KEY, F.col("r.error").alias("error"))


@query(
    "splice",
    GATE + """SELECT v.doc_id AS session_id, md5('{"max_tokens":4000,"messages":[' || string_agg(CASE WHEN m.k = ka AND m.c = 0 AND m.j = 2 THEN '{"content":[' || block || '],"role":"user"}'
  WHEN ka IS NULL AND m.c = 1 THEN '{"content":[{"thinking":"hm","type":"thinking"},{"text":"so it is","type":"text"}],"role":"assistant"}' ELSE span END, ',' ORDER BY m.msg) || '],"model":"model-large","system":"be brief","zeta":1.10}') AS body_md5, 0::INT AS suppressed
FROM v JOIN m USING (doc_id) WHERE error IS NULL GROUP BY v.doc_id""",
)
def splice(spark, d):
    """The rewritten bodies that pass the gate, to the byte."""
    return rewritten(spark, d).where("r.error is null").select(KEY, F.md5(F.col("r.body").cast("binary")).alias("body_md5"), F.col("r.suppressed").alias("suppressed"))


MOST, PASSED = 9_000, 5_000  # sizes of this table's bodies, in place of megabytes
RELAYED = GATE + f""", l AS (SELECT v.doc_id, min(error) AS error, {len(HEAD)} + sum(strlen(span)) + 2 * (count(*) - 1) + 2 AS old,
  strlen('{{"max_tokens":4000,"messages":[' || string_agg(CASE WHEN m.k = ka AND m.c = 0 AND m.j = 2 THEN '{{"content":[' || block || '],"role":"user"}}'
  WHEN ka IS NULL AND m.c = 1 THEN '{{"content":[{{"thinking":"hm","type":"thinking"}},{{"text":"so it is","type":"text"}}],"role":"assistant"}}' ELSE span END, ',') || '],"model":"model-large","system":"be brief","zeta":1.10}}') AS new
  FROM v JOIN m USING (doc_id) GROUP BY v.doc_id),
n AS (SELECT doc_id, old::BIGINT AS bytes_in, new, CASE WHEN old > {MOST} THEN 'refused' WHEN doc_id % 13 = 0 THEN 'killed' WHEN old > {PASSED} THEN 'passed' WHEN error IS NOT NULL THEN 'kept' WHEN doc_id % 7 = 2 THEN 'shadow' ELSE 'rewritten' END AS outcome FROM l),
g AS (SELECT *, CASE outcome WHEN 'refused' THEN 0 WHEN 'rewritten' THEN new ELSE bytes_in END::BIGINT AS bytes_out FROM n)
"""


def relayed(spark, d):
    r, doc = rewritten(spark, d), F.col(KEY)
    new = F.when(F.col("r.error").isNull(), F.col("r.body"))
    return relay.relayed(r, F.col("body"), new, doc % 13 == 0, doc % 7 == 2, MOST, PASSED)


@query("relay_log", RELAYED + "SELECT doc_id AS session_id, CASE WHEN outcome = 'refused' THEN 502 ELSE 200 END AS status, outcome, bytes_in, bytes_out FROM g")
def relay_log(spark, d):
    """A row for each request: what was decided, and how much came in and went out."""
    return relayed(spark, d).select(KEY, "status", "outcome", "bytes_in", "bytes_out")


@query("relay_totals", RELAYED + "SELECT o.outcome, count(g.outcome) AS requests, coalesce(sum(bytes_in), 0)::BIGINT AS bytes_in, coalesce(sum(bytes_out), 0)::BIGINT AS bytes_out FROM (VALUES ('refused'), ('killed'), ('passed'), ('kept'), ('shadow'), ('rewritten')) o(outcome) LEFT JOIN g USING (outcome) GROUP BY o.outcome")
def relay_totals(spark, d):
    return relay.totals(relayed(spark, d))


@query("segment_estimator", """WITH c AS (SELECT conv_id AS session_id, row_number() OVER w - 1 AS seg_index, ceil(strlen(coalesce(text, '')) / 4.0::DOUBLE)::BIGINT AS tokens FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT session_id, seg_index, tokens, (coalesce(sum(tokens) OVER (PARTITION BY session_id ORDER BY seg_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0))::BIGINT AS suffix FROM c""")
def segment_estimator(spark, d):
    """Segments with tokens by another estimator: a quarter of the bytes."""
    m = segments.session_messages(read(spark, d, "conversations"))
    s = segments.segment_table(m, lambda t: F.ceil(F.octet_length(t) / F.lit(4.0)).cast("long"))
    return s.select(KEY, "seg_index", F.col("token_estimate").alias("tokens"), F.col("suffix_tokens").alias("suffix"))
