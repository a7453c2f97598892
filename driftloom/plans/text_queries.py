"""Queries over documents, pages and events as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import economics as E
from ..functions import jsontext, markup
from ..functions import text as X
from ..operators import dedup, near_diff, search
from .session_queries import read

QUERIES: dict = {}
ORACLES: dict = {}
NL, CR, ESC = "chr(10)", "chr(13)", "chr(27)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def docs(spark, d):
    return read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


D = "d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)"


@query("token_estimate", f"WITH {D} SELECT doc_id, ceil(length(text) / 3.5::DOUBLE)::BIGINT AS tokens FROM d")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("byte_lengths", f"WITH {D} SELECT doc_id, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_chars, strlen(text) <= 4194304 AS rewritable FROM d WHERE strlen(text) <= 16777216")
def byte_lengths(spark, d):
    size = X.byte_length(F.col("text"))
    return docs(spark, d).where(size <= 16 << 20).select("doc_id", size.alias("n_bytes"), F.char_length("text").cast("long").alias("n_chars"), (size <= 4 << 20).alias("rewritable"))


@query("content_address", f"WITH {D} SELECT doc_id, 'sha256:' || sha256(text) AS ref_id FROM d")
def content_address(spark, d):
    return docs(spark, d).select("doc_id", X.content_address(F.col("text")).alias("ref_id"))


@query(
    "ref_syntax",
    f"""WITH {D}, r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'sha256:' || sha256(text) WHEN 1 THEN upper('sha256:' || sha256(text)) WHEN 2 THEN 'sha256:' || sha256(text) || 'a' ELSE sha256(text) END AS ref_id FROM d)
SELECT doc_id, regexp_full_match(ref_id, 'sha256:[0-9a-f]{{64}}') AS valid FROM r""",
)
def ref_syntax(spark, d):
    ref = X.content_address(F.col("text"))
    kinds = F.when(F.col("doc_id") % 4 == 0, ref).when(F.col("doc_id") % 4 == 1, F.upper(ref)).when(F.col("doc_id") % 4 == 2, F.concat(ref, F.lit("a"))).otherwise(F.sha2("text", 256))
    return docs(spark, d).select("doc_id", X.is_content_address(kinds).alias("valid"))


@query(
    "ansi_strip",
    f"""WITH {D}, t AS (SELECT doc_id, {ESC} || '[31m' || text || {ESC} || '[0m' || {CR} || chr(7) || {ESC} || 'c' || text || chr(9) || {ESC} || '[1;2' AS dirty FROM d)
SELECT doc_id, md5(regexp_replace(dirty, '\\x1b(?:\\[[^\\x40-\\x7e]*[\\x40-\\x7e]?|[^\\[])?|[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x{{9f}}]', '', 'g')) AS cleaned_md5, strlen(dirty)::BIGINT AS before FROM t""",
)
def ansi_strip(spark, d):
    t = F.col("text")
    dirty = F.concat(F.lit("\x1b[31m"), t, F.lit("\x1b[0m\r\x07\x1bc"), t, F.lit("\t\x1b[1;2"))
    return docs(spark, d).select("doc_id", F.md5(X.strip_ansi(dirty)).alias("cleaned_md5"), X.byte_length(dirty).alias("before"))


@query(
    "whitespace_norm",
    f"""WITH {D}, t AS (SELECT doc_id, replace(replace(text, '. ', '.  ' || {CR} || {NL} || {NL} || {NL} || '  ' || {NL}), {NL}, ' ' || {NL}) || CASE WHEN doc_id % 2 = 0 THEN {NL} || {NL} || {NL} ELSE ' ' || {NL} || ' ' END AS dirty FROM d),
u AS (SELECT doc_id, dirty, regexp_replace(regexp_replace(regexp_replace(replace(replace(dirty, {CR} || {NL}, {NL}), {CR}, {NL}), '[ \\t\\f\\v]+(\\n|$)', '\\1', 'g'), '^\\n{{2,}}', {NL}), '\\n{{3,}}', {NL} || {NL}, 'g') AS s FROM t)
SELECT doc_id, md5(CASE WHEN ends_with(dirty, {NL}) THEN s ELSE regexp_replace(s, '\\n+$', '') END) AS normal_md5 FROM u""",
)
def whitespace_norm(spark, d):
    spread = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".  \r\n\n\n  \n")), F.lit("\n"), F.lit(" \n"))
    dirty = F.concat(spread, F.when(F.col("doc_id") % 2 == 0, F.lit("\n\n\n")).otherwise(F.lit(" \n ")))
    return docs(spark, d).select("doc_id", F.md5(X.normalize_space(dirty)).alias("normal_md5"))


@query(
    "blob_extract",
    f"""WITH {D} SELECT doc_id, md5(text || ' [blob of 800 bytes left out] ' || repeat('xyz1', 130) || ' ' || repeat('Zm9v', 200) || '.') AS out_md5 FROM d""",
)
def blob_extract(spark, d):
    with_blobs = F.concat(F.col("text"), F.lit(" " + "QUJD" * 200 + " " + "xyz1" * 130 + " " + "Zm9v" * 200 + "."))
    return docs(spark, d).select("doc_id", F.md5(X.extract_blob(with_blobs)).alias("out_md5"))


@query(
    "head_tail",
    f"""WITH {D}, l AS (SELECT doc_id, string_split(regexp_replace(replace(text, ' ', {NL}), '\\n$', ''), {NL}) AS ls FROM d)
SELECT doc_id, len(ls)::BIGINT AS n_lines, md5(array_to_string(ls[1:40], {NL}) || {NL} || '[... ' || (len(ls) - 60)::VARCHAR || ' lines left out ...]' || {NL} || array_to_string(ls[len(ls) - 19:len(ls)], {NL})) AS out_md5
FROM l WHERE len(ls) > 60""",
)
def head_tail(spark, d):
    text = F.replace(F.col("text"), F.lit(" "), F.lit("\n"))
    return docs(spark, d).select("doc_id", F.size(X.lines(text)).cast("long").alias("n_lines"), F.md5(X.head_tail(text)).alias("out_md5")).where("out_md5 is not null")


def leaves(spark, d):
    """Documents as tool results: a session for each source, in order of their ids."""
    return docs(spark, d).select(F.coalesce("source", F.lit("none")).alias("session_id"), F.col("doc_id").alias("seq"), F.coalesce("lang", F.lit("none")).alias("tool"), F.col("text").alias("content"))


LEAF = "leaf AS (SELECT coalesce(source, 'none') AS session_id, doc_id AS seq, 'sha256:' || sha256(coalesce(text, '')) AS ref_id, strlen(coalesce(text, ''))::BIGINT AS size, coalesce(text, '') AS content FROM documents)"


@query("exact_dedup", f"WITH {LEAF} SELECT session_id, seq, ref_id, min(seq) OVER (PARTITION BY session_id, content) AS first_seq FROM leaf")
def exact_dedup(spark, d):
    return dedup.first_occurrences(leaves(spark, d)).select("session_id", "seq", "ref_id", "first_seq")


@query("dedup_backref", f"WITH {LEAF}, f AS (SELECT *, min(seq) OVER (PARTITION BY session_id, content) AS first_seq FROM leaf WHERE size >= 1024) SELECT session_id, seq, first_seq, '[repeats an earlier message | ref=' || ref_id || ']' AS marker FROM f WHERE seq > first_seq")
def dedup_backref(spark, d):
    return dedup.backrefs(leaves(spark, d))


@query(
    "dedup_gates",
    """WITH m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, strlen(coalesce(text, ''))::BIGINT AS size, lag(coalesce(role, 'user')) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, conv_id % 4 <> 0 AND size >= 1024 AND (role <> 'assistant' OR conv_id % 2 = 0) AS may_dedupe, coalesce(prev = role OR (prev = 'assistant' AND role = 'user'), false) AS may_refer FROM m""",
)
def dedup_gates(spark, d):
    from ..operators.segments import by_session, session_messages

    m = session_messages(read(spark, d, "conversations"))
    may = dedup.should_dedupe(F.col("role"), F.col("raw_len") - 2, F.col("session_id") % 4 == 0, F.col("session_id") % 2 == 0)
    refer = F.coalesce(dedup.can_refer_back(F.lag("role").over(by_session("msg_index")), F.col("role")), F.lit(False))
    return m.select(F.col("session_id").alias("conv_id"), F.col("msg_index").alias("turn"), may.alias("may_dedupe"), refer.alias("may_refer"))


TAGS = "|".join(markup.KNOWN)


@query(
    "html_detect",
    f"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(html, '<!DOCTYPE html><html', '<main') ELSE '<?xml version="1.0"?>' || html END AS html FROM pages),
h AS (SELECT page_id, trim(html, ' ' || {NL} || chr(9)) AS html, list_transform(regexp_extract_all(html, '(?i)</?({TAGS})(?:[ \\t\\n\\f\\r/>]|$)', 1), lambda x: lower(x)) AS hits FROM p)
SELECT page_id, CASE WHEN starts_with(lower(html), '<?xml') THEN false WHEN starts_with(lower(html), '<!doctype html') OR starts_with(lower(html), '<html') THEN true
  ELSE starts_with(html, '<') AND len(hits) >= 8 AND len(list_distinct(hits)) >= 3 END AS is_html FROM h""",
)
def html_detect(spark, d):
    html = F.when(F.col("page_id") % 3 == 0, F.col("html")).when(F.col("page_id") % 3 == 1, F.replace(F.col("html"), F.lit("<!DOCTYPE html><html"), F.lit("<main"))).otherwise(F.concat(F.lit('<?xml version="1.0"?>'), F.col("html")))
    return read(spark, d, "pages").select("page_id", markup.looks_like_html(html).alias("is_html"))


@query("html_strip")
def html_strip(spark, d):
    return read(spark, d, "pages").select("page_id", markup.strip_html_udf("html").alias("text"))


@query("html_strip_checks", "SELECT page_id, true AS shorter, false AS has_script, false AS has_tag FROM pages")
def html_strip_checks(spark, d):
    p = read(spark, d, "pages").select("page_id", "html", markup.strip_html_udf("html").alias("text"))
    return p.select("page_id", (F.octet_length("text") < F.octet_length("html")).alias("shorter"), F.col("text").rlike(r"track\(\d+\);").alias("has_script"), F.col("text").rlike("(?i)<(p|div|body|li|script|style)[ >]").alias("has_tag"))


@query("json_minify", "SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS minified FROM events")
def json_minify(spark, d):
    return read(spark, d, "events").select("event_id", jsontext.minify_udf("props").alias("minified"))


@query(
    "json_leanest",
    """WITH g AS (SELECT user_id, count(*) AS n, string_agg(replace(props, ': ', ':'), ',' ORDER BY event_id) AS body FROM events GROUP BY user_id)
SELECT user_id, strlen(body) + 2 AS compact_bytes, true AS never_longer FROM g""",
)
def json_leanest(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("event_id", "props")))
    body = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["props"]), ", "), F.lit("]"))
    g = read(spark, d, "events").groupBy("user_id").agg(body.alias("body")).withColumns({"small": jsontext.minify_udf("body"), "lean": jsontext.leanest_udf("body")})
    return g.select("user_id", F.octet_length("small").cast("long").alias("compact_bytes"), (F.octet_length("lean") <= F.octet_length("small")).alias("never_longer"))


@query(
    "seq_diff",
    """WITH l AS (
  SELECT doc_id, s.seq, CASE WHEN doc_id % 5 = 0 AND s.seq = 3 THEN 'read' ELSE 'grep' END AS tool,
         list_transform(range(60), lambda k: CASE WHEN doc_id % 4 = 3 AND s.seq = 2 THEN 'a new line ' || k || ' in place of all of ' || doc_id
           WHEN s.seq > 0 AND k = (doc_id + 7 * s.seq) % 60 THEN 'edited in ' || s.seq ELSE 'line ' || k || ' of the result that ' || doc_id || ' gives every time' END) AS lines
  FROM documents, range(4) AS s(seq))
SELECT doc_id::VARCHAR AS session_id, seq, tool, 0 AS base_seq, sha256(array_to_string(lines, chr(10))) AS target_sha256
FROM l WHERE seq = 1 OR (seq = 2 AND doc_id % 4 <> 3) OR (seq = 3 AND doc_id % 5 <> 0 AND doc_id % 4 <> 3)""",
)
def seq_diff(spark, d):
    """Results of a tool that change a line each time, come anew, or come from another tool: what is told
    as a difference, and the hash of what its base and the difference rebuild."""
    line = "CASE WHEN doc_id % 4 = 3 AND seq = 2 THEN concat('a new line ', k, ' in place of all of ', doc_id) WHEN seq > 0 AND k = (doc_id + 7 * seq) % 60 THEN concat('edited in ', seq) ELSE concat('line ', k, ' of the result that ', doc_id, ' gives every time') END"
    rows = read(spark, d, "documents").select("doc_id", F.explode(F.expr("sequence(0L, 3L)")).alias("seq"))
    results = rows.select(F.col("doc_id").cast("string").alias("session_id"), "seq", F.expr("if(doc_id % 5 = 0 AND seq = 3, 'read', 'grep')").alias("tool"), F.expr(f"array_join(transform(sequence(0, 59), k -> {line}), '\n')").alias("content"))
    told = near_diff.sequential_diffs(results).where("diff is not null")
    base = results.select("session_id", F.col("seq").alias("base_seq"), F.col("content").alias("base"))
    rebuilt = told.join(base, ["session_id", "base_seq"]).withColumn("target", near_diff.rebuilt_udf("base", "diff"))
    return rebuilt.select("session_id", "seq", "tool", "base_seq", F.sha2("target", 256).alias("target_sha256"))


@query(
    "extract_refs",
    f"""WITH {D}, r AS (SELECT doc_id, 'sha256:' || sha256(text) AS ref, 'sha256:' || sha256(text || 'x') AS other FROM d)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ref || ',' || other WHEN doc_id % 3 = 1 THEN other ELSE '' END AS refs FROM r""",
)
def extract_refs(spark, d):
    t = F.col("text")
    ref, other = X.content_address(t), X.content_address(F.concat(t, F.lit("x")))
    mark = X.placeholder(ref, X.token_estimate(t), X.byte_length(t), F.lit("a summary"))
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(mark, F.lit(" and "), X.backref(other))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("ref="), ref, F.lit(" "), X.backref(other))).otherwise(F.concat(F.lit("bare ref="), ref, F.lit(" [repeats an earlier message | ref="), other, F.lit("0]")))
    return docs(spark, d).select("doc_id", F.array_join(X.extract_refs(body), ",").alias("refs"))


@query(
    "placeholder",
    f"""WITH {D} SELECT doc_id, '[stored segment | ref=sha256:' || sha256(text) || ' | ~' || ceil(length(text) / 3.5::DOUBLE)::BIGINT || ' tokens | ' || strlen(text) || ' bytes]' || {NL} || source || {NL}
|| 'Full text: retrieve("sha256:' || sha256(text) || '")' || {NL} || 'or read refs/sha256-' || sha256(text) || '.txt' AS marker FROM d""",
)
def placeholder(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", X.placeholder(X.content_address(t), X.token_estimate(t), X.byte_length(t), F.col("source"), file_line=True).alias("marker"))


def asked(spark, d):
    """Each document with a benchmark item as its query; every tenth query is empty."""
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("_item"), F.col("text").alias("item"))
    both = docs(spark, d).withColumn("_item", F.col("doc_id") % 40).join(items, "_item", "left")
    return both.select("doc_id", F.col("text").alias("doc"), F.when(F.col("doc_id") % 10 == 9, F.lit("")).otherwise(F.coalesce("item", F.lit(""))).alias("query"))


BM25 = f"""WITH {D},
q AS (SELECT doc_id, doc_text AS text, CASE WHEN doc_id % 10 = 9 THEN '' ELSE coalesce(item_text, '') END AS query FROM (SELECT doc_id, text AS doc_text FROM d) LEFT JOIN (SELECT item_id, text AS item_text FROM benchmark) ON item_id = doc_id % 40),
s AS (SELECT doc_id, query, text, list_filter(string_split(text, {NL}), lambda x: trim(x) <> '') AS ls, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM q),
p AS (SELECT doc_id, query, CASE WHEN len(ls) > 1 THEN ls WHEN len(ws) > 40 THEN list_transform(range(0, len(ws), 40), lambda i: array_to_string(ws[i + 1:i + 40], ' ')) ELSE [text] END AS ps FROM s),
u AS (SELECT doc_id, unnest(ps) AS passage, (generate_subscripts(ps, 1) - 1)::INT AS idx FROM p),
tk AS (SELECT doc_id, idx, passage, list_filter(regexp_split_to_array(lower(passage), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ts FROM u),
n AS (SELECT doc_id, count(*)::DOUBLE AS n, sum(len(ts))::DOUBLE / count(*) AS av FROM tk GROUP BY doc_id),
qt AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM p),
qn AS (SELECT doc_id, t, count(*) AS times FROM qt GROUP BY ALL),
pt AS (SELECT doc_id, idx, len(ts)::DOUBLE AS size, unnest(ts) AS t FROM tk),
tf AS (SELECT doc_id, idx, size, t, count(*)::DOUBLE AS tf FROM pt GROUP BY ALL),
df AS (SELECT doc_id, t, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
sc AS (SELECT doc_id, idx, round(sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / av))), 6) AS score
  FROM tf JOIN qn USING (doc_id, t) JOIN df USING (doc_id, t) JOIN n USING (doc_id) GROUP BY doc_id, idx)"""


@query("bm25_topk", BM25 + " SELECT doc_id, idx, score, k FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS k FROM sc) WHERE k <= 5")
def bm25_topk(spark, d):
    s = search.with_scores(asked(spark, d))
    best = F.slice(search.ranked(F.transform("scores", lambda x: F.struct(E.to_digits(x["score"], 6).alias("score"), x["idx"].alias("idx")))), 1, 5)
    return s.select("doc_id", F.posexplode(best).alias("pos", "s")).select("doc_id", "s.idx", "s.score", (F.col("pos") + 1).cast("long").alias("k"))


@query("bm25_passages", BM25 + " SELECT doc_id, idx, md5(passage) AS passage_md5, len(ts) AS n_tokens FROM tk")
def bm25_passages(spark, d):
    p = docs(spark, d).select("doc_id", F.posexplode(X.passages(F.col("text"))).alias("idx", "passage"))
    return p.select("doc_id", "idx", F.md5("passage").alias("passage_md5"), F.size(X.tokenize(F.col("passage"))).cast("long").alias("n_tokens"))


@query("bm25_default", BM25 + f" SELECT doc_id, md5(array_to_string(ps[1:5], {NL})) AS found_md5 FROM p ANTI JOIN (SELECT DISTINCT doc_id FROM sc) USING (doc_id)")
def bm25_default(spark, d):
    s = search.with_scores(asked(spark, d)).where(F.size("scores") == 0)
    return s.select("doc_id", F.md5(F.array_join(F.slice("passages", 1, 5), "\n")).alias("found_md5"))


@query(
    "search_within",
    BM25.replace("/ av))), 6) AS score", "/ av))), 9) AS score") + f""", top AS (SELECT doc_id, idx FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) <= 5),
f AS (SELECT doc_id, string_agg(passage, {NL} ORDER BY idx) AS found FROM top JOIN u USING (doc_id, idx) GROUP BY doc_id)
SELECT doc_id, coalesce(found, array_to_string(ps[1:5], {NL})) AS found FROM p LEFT JOIN f USING (doc_id)""",
)
def search_within(spark, d):
    return search.search_within(asked(spark, d)).select("doc_id", "found")


HEADERS = ["Connection", "accept", "Content-Length", "X-Id", "TE", "Keep-Alive", "Proxy-Authenticate", "Trailer", "Host", "UPGRADE", "x-te", "Transfer-encoding", "proxy-authorization"]


@query(
    "header_sanitise",
    f"""SELECT event_id, array_to_string(list_transform(list_filter(list_transform(range(6), lambda i: {{'name': {HEADERS}[(event_id * (i + 1) + 3 * i) % 13 + 1], 'value': event_type || i}}),
  lambda h: lower(h.name) NOT IN ('connection', 'keep-alive', 'proxy-authenticate', 'proxy-authorization', 'te', 'trailer', 'transfer-encoding', 'upgrade', 'content-length')), lambda h: h.name || '=' || h.value), ',') AS kept FROM events""",
)
def header_sanitise(spark, d):
    """Six headers of each event, by its id and type, some of them more than once."""
    names, k = F.array(*map(F.lit, HEADERS)), F.col("event_id")
    headers = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.get(names, ((k * (i + 1) + 3 * i) % 13).cast("int")).alias("name"), F.concat("event_type", i.cast("string")).alias("value")))
    return read(spark, d, "events").select("event_id", F.array_join(F.transform(X.forwarded_headers(headers), lambda h: F.concat(h["name"], F.lit("="), h["value"])), ",").alias("kept"))


@query("embedded_json", "SELECT event_id, props AS found FROM events")
def embedded_json(spark, d):
    return read(spark, d, "events").select("event_id", X.embedded_json(F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done."))).alias("found"))


@query("version_normalise", "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN '' ELSE (event_id % 7)::VARCHAR || '.' END || event_id::VARCHAR || CASE WHEN event_id % 5 = 0 THEN '-' || event_type ELSE '' END AS version FROM events")
def version_normalise(spark, d):
    """Versions with and without a leading v, blanks around, words after, and tags of their own."""
    k = F.col("event_id")
    own = F.concat(F.when(k % 3 == 1, F.lit("")).otherwise(F.concat((k % 7).cast("string"), F.lit("."))), k.cast("string"), F.when(k % 5 == 0, F.concat(F.lit("-"), "event_type")).otherwise(""))
    said = F.concat(F.when(k % 4 == 0, "  ").otherwise(""), F.when(k % 2 == 0, "v").otherwise(""), own, F.when(k % 3 == 0, F.concat(F.lit(" v2 "), "event_type")).otherwise(""))
    return read(spark, d, "events").select("event_id", X.normalized_version(said).alias("version"))
