"""Queries over conversations: segments, scores, candidates, decisions, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import economics as E
from ..functions import text as X
from ..operators import budget, scoring, segments
from ..operators.segments import KEY

MODELS = {"model-large": "large", "model-middle": "middle", "model-small": "small"}
NOW_STEP, TTL, TURNS = 720.0, 3600.0, 40.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.segment_table(segments.session_messages(read(spark, sf_dir, "conversations")))


def constraints(s: DataFrame) -> DataFrame:
    """Every third session has a constraint from message 1, superseded in every sixth."""
    return s.where((F.col(KEY) % 3 == 0) & (F.col("seg_index") == 1)).select(KEY, F.lit(1).alias("source_message"), F.when(F.col(KEY) % 6 == 0, F.lit(7)).alias("superseded_by"))


def salient_segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segs(spark, sf_dir)
    return segments.with_salience(s, constraints(s))


def session_facts(frame: DataFrame) -> DataFrame:
    """Model, idle time and triggers of a session, derived from its number."""
    now = (F.col(KEY) % 6).cast("double") * F.lit(NOW_STEP)
    model = F.element_at(F.array(*[F.lit(m) for m in [*MODELS, "model-unpriced"]]), (F.col(KEY) % 4 + 1).cast("int"))
    return frame.withColumns(
        {"model": model, "alive": E.p_alive(F.lit(0.0), F.lit(TTL), now), "cold": E.is_cold(F.lit(0.0), F.lit(TTL), now), "free_bust": F.col(KEY) % 7 == 0, "n_turns": F.lit(TURNS), "access": (F.col(KEY) % 5 == 0).cast("double")}
    )


def priced(frame: DataFrame, how: str = "inner") -> DataFrame:
    return session_facts(frame).join(F.broadcast(E.price_table(frame.sparkSession, MODELS)), "model", how)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_scores(priced(salient_segs(spark, sf_dir)))


def squash_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision for each priced session, with the money behind it."""
    s = scored(spark, sf_dir)
    per = priced(s.groupBy(KEY).agg(F.sum(E.scaled(F.col("token_estimate"), F.lit(1.1))).cast("long").alias("prefix")))
    out = scoring.decisions(per, scoring.candidates(s, F.lit(1.1)))
    return out.select(KEY, "decision", "n_candidates", "prefix", "suffix", "removed", "head_offset", E.to_digits("bust", 9).alias("bust"), E.to_digits("recurring", 9).alias("recurring"), E.to_digits("npv", 9).alias("npv"))


SEG = """
c AS (SELECT conv_id AS session_id, turn::BIGINT AS msg_index, coalesce(role, 'user') AS role, coalesce(text, '') AS rendered FROM conversations),
seg0 AS (
  SELECT session_id, msg_index, rendered, row_number() OVER w - 1 AS seg_index, count(*) OVER (PARTITION BY session_id) AS n_segments,
         CASE role WHEN 'user' THEN 'user_turn' WHEN 'assistant' THEN 'assistant_turn' ELSE 'system' END AS kind,
         (strlen(rendered) + 2)::BIGINT AS raw_len, ceil(length(rendered) / 3.5::DOUBLE)::BIGINT AS token_estimate
  FROM c WINDOW w AS (PARTITION BY session_id ORDER BY msg_index)),
seg1 AS (
  SELECT *, coalesce(sum(raw_len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
         (sum(CASE WHEN kind = 'user_turn' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS generation,
         coalesce(sum(token_estimate) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::BIGINT AS suffix_tokens,
         (sum(token_estimate) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS prefix_tokens,
         seg_index = n_segments - 1 AS is_current, kind = 'user_turn' AS is_true_human, seg_index >= greatest(n_segments - 3, 0) AS recent
  FROM seg0 WINDOW w AS (PARTITION BY session_id ORDER BY msg_index)),
seg AS (
  SELECT *, is_current AS pinned, max(generation) OVER (PARTITION BY session_id) - generation AS gap,
         is_true_human OR (session_id % 3 = 0 AND session_id % 6 <> 0 AND msg_index = 1) AS salient,
         is_true_human AND round(token_estimate * 3.5::DOUBLE) > 16384 AS huge
  FROM seg1)"""
PRICE = """
price AS (SELECT * FROM (VALUES ('model-large', 5e-6::DOUBLE, 2.0::DOUBLE, 0.1::DOUBLE, 1024::BIGINT),
  ('model-middle', 3e-6::DOUBLE, 2.0::DOUBLE, 0.1::DOUBLE, 1024::BIGINT), ('model-small', 1e-6::DOUBLE, 2.0::DOUBLE, 0.1::DOUBLE, 4096::BIGINT)) v(model, base, w, r, floor)),
facts AS (
  SELECT session_id, ['model-large', 'model-middle', 'model-small', 'model-unpriced'][session_id % 4 + 1] AS model,
         least(greatest(1.0::DOUBLE - ((session_id % 6)::DOUBLE * 720.0::DOUBLE - 0.0::DOUBLE) / 3600.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS alive,
         (session_id % 6)::DOUBLE * 720.0::DOUBLE >= 3600.0::DOUBLE AS cold, session_id % 7 = 0 AS free_bust, (session_id % 5 = 0)::INT::DOUBLE AS access
  FROM (SELECT DISTINCT session_id FROM seg)),
priced AS (SELECT * FROM facts JOIN price USING (model))"""
SCORED = """
sig AS (
  SELECT seg.*, p.* EXCLUDE (session_id), salient::INT::DOUBLE AS salience, recent::INT::DOUBLE AS recency,
         least(greatest(1.0::DOUBLE - exp(-(gap::DOUBLE) / 4.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS freshness,
         token_estimate::DOUBLE * base * r AS saving, token_estimate::DOUBLE * base * (w - r) * alive AS own_bust,
         least(token_estimate::DOUBLE / 4096.0::DOUBLE, 1.0::DOUBLE) AS size,
         CASE kind WHEN 'assistant_turn' THEN 0.6::DOUBLE WHEN 'system' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS content_type
  FROM seg JOIN priced p USING (session_id)),
sig2 AS (
  SELECT *, CASE WHEN pinned THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (1.0::DOUBLE + exp(-((saving - own_bust) / greatest(saving, 2.2250738585072014e-308::DOUBLE)))) END AS economics FROM sig),
scored AS (
  SELECT *, CASE WHEN salience >= 1 OR recency >= 1 THEN NULL ELSE greatest(freshness + economics + size + content_type - access, 0.0::DOUBLE) END AS value,
         CASE WHEN salience >= 1 OR recency >= 1 THEN 0.0::DOUBLE ELSE greatest(greatest(freshness + economics + size + content_type - access, 0.0::DOUBLE) * 5e-4::DOUBLE, 0.0::DOUBLE) END AS quality
  FROM sig2)"""
CANDIDATE = "(NOT salient OR huge) AND NOT pinned AND NOT recent"
BATCH = f"""
cand AS (SELECT *, round((token_estimate - 40)::DOUBLE * 1.1::DOUBLE)::BIGINT AS net_removed FROM scored WHERE {CANDIDATE}),
batch AS (
  SELECT session_id, count(*) AS n_candidates, max(suffix_tokens) AS suffix, sum(net_removed)::BIGINT AS removed, sum(quality) AS quality_sum, min(byte_offset) AS head_offset
  FROM cand GROUP BY session_id),
prefix AS (SELECT session_id, sum(round(token_estimate * 1.1::DOUBLE)::BIGINT)::BIGINT AS prefix FROM seg GROUP BY session_id),
money AS (
  SELECT session_id, coalesce(n_candidates, 0)::BIGINT AS n_candidates, prefix, coalesce(suffix, 0)::BIGINT AS suffix, coalesce(removed, 0)::BIGINT AS removed,
         coalesce(head_offset, 0)::BIGINT AS head_offset, coalesce(quality_sum, 0.0::DOUBLE) AS quality_sum, base, w, r, floor, alive, cold, free_bust,
         CASE WHEN cold THEN 0.0::DOUBLE ELSE coalesce(suffix, 0)::DOUBLE * base * (w - r) * alive END AS bust,
         40.0::DOUBLE * coalesce(removed, 0)::DOUBLE * base * r AS recurring
  FROM priced JOIN prefix USING (session_id) LEFT JOIN batch USING (session_id))"""
SQUASH_SQL = f"""WITH {SEG}, {PRICE}, {SCORED}, {BATCH}
SELECT session_id, CASE WHEN n_candidates = 0 THEN 'hold:warm_deep' WHEN prefix - removed < floor THEN 'hold:sub_floor' WHEN cold THEN 'ride:cold'
  WHEN free_bust THEN 'ride:model_switch' WHEN recurring + quality_sum - bust > 0 THEN 'flush' ELSE 'hold:warm_deep' END AS decision,
  n_candidates, prefix, suffix, removed, head_offset, round(bust, 9) AS bust, round(recurring, 9) AS recurring, round(recurring + quality_sum - bust, 9) AS npv
FROM money"""

QUERIES: dict = {"squash_plan": squash_plan}
ORACLES: dict = {"squash_plan": SQUASH_SQL}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("segment_table", f"WITH {SEG} SELECT session_id, seg_index, kind, byte_offset, token_estimate, generation, pinned, is_current, is_true_human, suffix_tokens, prefix_tokens FROM seg")
def segment_rows(spark, d):
    return segs(spark, d).select(KEY, "seg_index", "kind", "byte_offset", "token_estimate", "generation", "pinned", "is_current", "is_true_human", "suffix_tokens", "prefix_tokens")


@query("recency_window", f"WITH {SEG} SELECT session_id, seg_index, n_segments, recent FROM seg")
def recency_window(spark, d):
    return segs(spark, d).select(KEY, "seg_index", "n_segments", segments.recency_protected().alias("recent"))


@query("prune_candidates", f"WITH {SEG} SELECT session_id, seg_index, token_estimate FROM seg WHERE NOT pinned AND NOT recent")
def prune_candidates(spark, d):
    return segs(spark, d).where(segments.prune_candidate()).select(KEY, "seg_index", "token_estimate")


@query("fresh_boundary", f"WITH {SEG}, g AS (SELECT session_id, generation, dense_rank() OVER (PARTITION BY session_id ORDER BY generation DESC) AS k FROM seg) SELECT session_id, min(generation) AS boundary FROM g WHERE k <= 2 GROUP BY session_id")
def fresh_boundary(spark, d):
    return segments.fresh_boundary(segs(spark, d))


@query("pinned_segments", f"WITH {SEG} SELECT session_id, seg_index, salient, pinned FROM seg WHERE salient OR pinned")
def pinned_segments(spark, d):
    return salient_segs(spark, d).where("salient or pinned").select(KEY, "seg_index", "salient", "pinned")


@query("squash_candidates", f"WITH {SEG} SELECT session_id, seg_index, kind FROM seg WHERE NOT salient OR huge")
def squash_candidates(spark, d):
    return salient_segs(spark, d).where(segments.squash_candidate()).select(KEY, "seg_index", "kind")


@query("salience_gate", f"WITH {SEG} SELECT session_id, seg_index, NOT (NOT salient OR huge) AS gated FROM seg")
def salience_gate(spark, d):
    return salient_segs(spark, d).select(KEY, "seg_index", (~segments.squash_candidate()).alias("gated"))


@query("huge_paste", "WITH d AS (SELECT doc_id, ceil(length(coalesce(text, '')) / 3.5::DOUBLE)::BIGINT AS token_estimate FROM documents) SELECT doc_id, token_estimate, round(token_estimate * 3.5::DOUBLE)::BIGINT AS approx_chars FROM d WHERE round(token_estimate * 3.5::DOUBLE) > 16384")
def huge_paste(spark, d):
    docs = read(spark, d, "documents").select("doc_id", X.token_estimate(F.coalesce("text", F.lit(""))).alias("token_estimate"), F.lit(True).alias("is_true_human"), F.lit("user_turn").alias("kind"))
    return docs.where(segments.huge_paste()).select("doc_id", "token_estimate", X.approx_chars(F.col("token_estimate")).alias("approx_chars"))


@query("breakpoint_plan", f"WITH {SEG}, f AS (SELECT session_id, seg_index, prefix_tokens, row_number() OVER (PARTITION BY session_id ORDER BY seg_index DESC) AS k FROM seg WHERE prefix_tokens >= 300 AND seg_index >= n_segments - 20 AND NOT recent) SELECT session_id, seg_index, prefix_tokens FROM f WHERE k <= 4")
def breakpoint_plan(spark, d):
    return segments.breakpoints(segs(spark, d), F.lit(300)).select(KEY, "seg_index", "prefix_tokens")


SIGNALS = ("salience", "recency", "freshness", "economics", "size", "content_type", "access_count")


@query("segment_scores", f"WITH {SEG}, {PRICE}, {SCORED} SELECT session_id, seg_index, round(salience, 9) AS salience, round(recency, 9) AS recency, round(freshness, 9) AS freshness, round(economics, 9) AS economics, round(size, 9) AS size, round(content_type, 9) AS content_type, round(access, 9) AS access_count, round(value, 9) AS value FROM scored")
def segment_scores(spark, d):
    value = F.when(F.col("value") > float("-inf"), E.to_digits("value", 9))
    return scored(spark, d).select(KEY, "seg_index", *[E.to_digits(c, 9).alias(c) for c in SIGNALS], value.alias("value"))


@query("quality_gain", f"WITH {SEG}, {PRICE}, {SCORED} SELECT session_id, seg_index, round(quality, 9) AS quality FROM scored")
def quality_gain(spark, d):
    return scored(spark, d).select(KEY, "seg_index", E.to_digits("quality", 9).alias("quality"))


@query("score_admission", f"WITH {SEG}, {PRICE}, {SCORED} SELECT session_id, seg_index FROM scored WHERE round(value, 9) >= 1.2::DOUBLE")
def score_admission(spark, d):
    return scored(spark, d).where(E.admitted(E.to_digits("value", 9), 1.2)).select(KEY, "seg_index")


@query("ladder_order", f"WITH {SEG}, {PRICE}, {SCORED} SELECT session_id, seg_index, row_number() OVER (PARTITION BY session_id ORDER BY round(value, 9) DESC NULLS LAST, seg_index) AS rung FROM scored")
def ladder_order(spark, d):
    ordered = scored(spark, d).withColumn("v", F.when(F.col("value") > float("-inf"), E.to_digits("value", 9)))
    return ordered.select(KEY, "seg_index", F.row_number().over(segments.by_session(F.desc_nulls_last("v"), "seg_index")).cast("long").alias("rung"))


@query("batch_fold", f"WITH {SEG}, {PRICE}, {SCORED}, {BATCH} SELECT session_id, n_candidates, suffix, removed, head_offset, round(quality_sum, 9) AS quality_sum FROM batch")
def batch_fold(spark, d):
    b = scoring.batches(scoring.candidates(scored(spark, d), F.lit(1.1)))
    return b.select(KEY, "n_candidates", "suffix", "removed", "head_offset", E.to_digits("quality_sum", 9).alias("quality_sum"))


def money(spark, d):
    s = scored(spark, d)
    per = priced(s.groupBy(KEY).agg(F.sum(E.scaled(F.col("token_estimate"), F.lit(1.1))).cast("long").alias("prefix")))
    return scoring.decisions(per, scoring.candidates(s, F.lit(1.1)))


MONEY = f"WITH {SEG}, {PRICE}, {SCORED}, {BATCH} SELECT session_id, "


@query("bust_cost", MONEY + "round(bust, 9) AS bust FROM money")
def bust_cost(spark, d):
    return money(spark, d).select(KEY, E.to_digits("bust", 9).alias("bust"))


@query("recurring_saving", MONEY + "round(recurring, 9) AS recurring FROM money")
def recurring_saving(spark, d):
    return money(spark, d).select(KEY, E.to_digits("recurring", 9).alias("recurring"))


@query("break_even", MONEY + "CASE WHEN cold THEN 0.0::DOUBLE WHEN removed = 0 THEN -1.0::DOUBLE ELSE round(suffix::DOUBLE * (w - r) / (removed::DOUBLE * r), 6) END AS turns FROM money")
def break_even(spark, d):
    return money(spark, d).select(KEY, F.when(F.col("break_even") == float("inf"), F.lit(-1.0)).otherwise(E.to_digits("break_even", 6)).alias("turns"))


@query("npv", MONEY + "round(recurring + quality_sum - bust, 9) AS npv FROM money")
def npv(spark, d):
    return money(spark, d).select(KEY, E.to_digits("npv", 9).alias("npv"))


@query("sub_floor", MONEY + "prefix, prefix - removed < floor AS sub_floor FROM money")
def sub_floor(spark, d):
    return money(spark, d).select(KEY, "prefix", "sub_floor")


@query("price_lookup", f"WITH {SEG}, {PRICE} SELECT session_id, model, coalesce(base, 0) AS base, coalesce(floor, 0) AS floor, base IS NOT NULL AS priced FROM facts LEFT JOIN price USING (model)")
def price_lookup(spark, d):
    return priced(segs(spark, d).select(KEY).distinct(), "left").select(KEY, "model", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("floor", F.lit(0)).cast("long").alias("floor"), F.col("base").isNotNull().alias("priced"))


CHOICES = f"""WITH {SEG}, {PRICE}, {SCORED}, ch AS (
  SELECT *, ['truncate', 'summarize', 'compress', 'keep'][(session_id + seg_index) % 4 + 1] AS choice, (seg_index % 3)::INT AS n_ranges,
         CASE WHEN seg_index % 2 = 0 THEN rendered ELSE '' END AS summary, length(rendered)::BIGINT AS chars FROM scored),
fixed AS (
  SELECT *, CASE WHEN choice = 'truncate' AND n_ranges = 0 THEN 'keep' WHEN choice = 'summarize' AND length(summary) = 0 THEN 'compress' ELSE choice END AS repaired FROM ch),
gate AS (SELECT *, CASE WHEN chars < 256 OR (repaired = 'summarize' AND length(summary) > chars) THEN 'keep' ELSE repaired END AS after_gate FROM fixed)"""


def choices(spark, d):
    """A decision for each segment, as a summariser might give: derived from its place."""
    s = scored(spark, d)
    names = F.array(*[F.lit(c) for c in ("truncate", "summarize", "compress", "keep")])
    return s.withColumns(
        {"choice": F.element_at(names, ((F.col(KEY) + F.col("seg_index")) % 4 + 1).cast("int")), "n_ranges": (F.col("seg_index") % 3).cast("int"), "summary": F.when(F.col("seg_index") % 2 == 0, F.col("rendered")).otherwise(F.lit("")), "chars": F.char_length("rendered").cast("long"), "is_huge_paste": segments.huge_paste(), "gated": ~segments.squash_candidate()}
    )


@query("decision_repair", CHOICES + " SELECT session_id, seg_index, choice, repaired FROM fixed")
def decision_repair(spark, d):
    return choices(spark, d).select(KEY, "seg_index", "choice", scoring.repaired(F.col("choice"), F.col("n_ranges"), F.col("summary")).alias("repaired"))


@query("pre_gate", CHOICES + " SELECT session_id, seg_index, after_gate FROM gate")
def pre_gate(spark, d):
    fixed = scoring.repaired(F.col("choice"), F.col("n_ranges"), F.col("summary"))
    return choices(spark, d).select(KEY, "seg_index", scoring.pre_gated(fixed, F.col("chars"), F.col("summary")).alias("after_gate"))


LADDER = CHOICES + """, lad AS (
  SELECT *, CASE WHEN NOT (NOT salient OR huge) THEN NULL WHEN huge THEN CASE WHEN after_gate = 'compress' THEN 'reversible_ref' END
    WHEN after_gate = 'truncate' THEN 'truncate' WHEN after_gate = 'summarize' THEN 'summarize' WHEN after_gate = 'compress' THEN 'reversible_ref' END AS strategy FROM gate)"""


@query("ladder_select", LADDER + " SELECT session_id, seg_index, strategy FROM lad WHERE strategy IS NOT NULL")
def ladder_select(spark, d):
    return scoring.ladder(choices(spark, d)).where("strategy is not null").select(KEY, "seg_index", "strategy")


@query("economics_gate", LADDER + ", n AS (SELECT *, 40.0::DOUBLE * (token_estimate - 40)::DOUBLE * base * r + quality - CASE WHEN cold THEN 0.0::DOUBLE ELSE suffix_tokens::DOUBLE * base * (w - r) * alive END AS npv FROM lad WHERE strategy IS NOT NULL) SELECT session_id, seg_index, round(npv, 9) AS npv, huge OR NOT (pinned OR round(npv, 9) <= 0 OR chars < 256) AS admitted FROM n")
def economics_gate(spark, d):
    rows = scoring.ladder(choices(spark, d)).where("strategy is not null")
    removed = F.col("token_estimate") - scoring.MARKER_TOKENS
    saving = E.recurring_saving(F.col("n_turns"), removed, F.col("base"), F.col("r"))
    bust = E.bust_cost(F.col("suffix_tokens"), F.col("base"), F.col("w"), F.col("r"), F.col("alive"), F.col("cold"))
    rows = rows.withColumn("npv", E.to_digits(E.npv(saving, F.col("quality"), bust), 9))
    return rows.select(KEY, "seg_index", "npv", scoring.economics_gate(F.col("npv"), F.col("pinned"), F.col("chars"), F.col("is_huge_paste")).alias("admitted"))


@query("anti_thrash", f"WITH {SEG}, a AS (SELECT session_id, seg_index, 'sha256:' || sha256(rendered) AS ref_id FROM seg), hot AS (SELECT DISTINCT ref_id FROM a WHERE session_id % 10 = 0) SELECT session_id, seg_index, ref_id, ref_id IN (SELECT ref_id FROM hot) AS dropped FROM a")
def anti_thrash(spark, d):
    rows = segs(spark, d).select(KEY, "seg_index", X.content_address(F.col("rendered")).alias("ref_id"))
    kept, dropped = scoring.without_hot(rows, rows.where(F.col(KEY) % 10 == 0))
    return kept.withColumn("dropped", F.lit(False)).unionByName(dropped.withColumn("dropped", F.lit(True))).select(KEY, "seg_index", "ref_id", "dropped")


@query("soft_pressure", f"WITH {SEG} SELECT session_id, sum(token_estimate)::BIGINT AS added, sum(token_estimate)::DOUBLE > 0.4::DOUBLE * 4000::DOUBLE AS over_budget FROM seg GROUP BY session_id")
def soft_pressure(spark, d):
    return segs(spark, d).groupBy(KEY).agg(F.sum("token_estimate").cast("long").alias("added")).withColumn("over_budget", E.soft_pressure(F.lit(4000), F.col("added")))


@query("hard_target", "SELECT DISTINCT conv_id AS session_id, greatest(256, 1000 + conv_id * 7 - 500 - 1024)::BIGINT AS target FROM conversations")
def hard_target(spark, d):
    return read(spark, d, "conversations").select(F.col("conv_id").alias(KEY)).distinct().withColumn("target", E.hard_target(1000 + F.col(KEY) * 7, F.lit(500)))


@query(
    "drop_ladder",
    f"""WITH {SEG}, t AS (SELECT *, 256::BIGINT AS target, sum(token_estimate) OVER (PARTITION BY session_id)::BIGINT AS total FROM seg),
o AS (SELECT *, coalesce(sum(token_estimate) OVER (PARTITION BY session_id ORDER BY seg_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shed FROM t WHERE kind <> 'system' AND NOT is_current)
SELECT session_id, seg_index, token_estimate AS tokens, 3::INT AS rung FROM o WHERE total - shed > target""",
)
def drop_ladder(spark, d):
    s = salient_segs(spark, d).withColumn("shed", F.lit(None).cast("long"))
    return budget.drop_ladder(s, F.lit(256))
