"""Registered queries, each over its whole tables, and the SQL that states its result."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import alignment, audit, curation, inference, selection, steps, trajectory, validation, windows
from loomwright.plans import inputs as I  # noqa: E741
from loomwright.sources import files, seek
from loomwright.sources.shared import shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- shared parts of the SQL ------------------------------------------------------------------------------------------

_STEPS = r"""
ev AS (SELECT user_id, ts, event_id, event_type,
  CASE WHEN event_id % 17 = 0 THEN 'Done.' ELSE 'We should check item ' || event_id || ' because the result looks odd.' END AS thought,
  CASE event_type WHEN 'view' THEN 'open src/main.py' WHEN 'click' THEN 'edit 3:4' WHEN 'error' THEN 'pytest tests' WHEN 'signup' THEN 'python run.py' WHEN 'purchase' THEN 'submit' END AS command,
  CASE WHEN event_id % 19 = 0 THEN '' ELSE 'value ' || event_id END AS reply FROM events),
st AS (SELECT *, length(thought) >= 20 AND len(regexp_extract_all(thought, '[A-Za-z][A-Za-z''-]*')) >= 4
    AND regexp_matches(thought, '(?i)\b(because|need|next|plan|should|therefore)\b') AS explicit,
  CASE WHEN regexp_matches(command, '(^|\s)pytest(\s|$)|python\s+[^\n]*test') THEN 'test' WHEN regexp_matches(command, '(^|\n)edit\b') THEN 'edit'
    WHEN regexp_matches(command, '(^|\s)open(\s|$)') THEN 'inspect' WHEN regexp_matches(command, '(^|\s)python\b') THEN 'run' ELSE 'other' END AS phase FROM ev)"""
_RECORDS = _STEPS + r""",
rec AS (SELECT user_id, count(*) AS ai_turns, count(*) FILTER (explicit AND reply <> '') AS cycles,
  coalesce(sum(length(thought)) FILTER (explicit AND reply <> ''), 0)::BIGINT AS thought_chars,
  coalesce(list(DISTINCT phase) FILTER (explicit AND reply <> ''), []) AS phases FROM st GROUP BY user_id),
feat AS (SELECT *, 'owner__repo' || user_id % 7 || '-' || user_id AS instance_id, ['70b', '8b', '405b'][user_id % 3 + 1] AS model_short, user_id % 2 = 0 AS target,
  user_id % 5 <> 0 AS bugfix, user_id % 13 <> 0 AS patch, user_id % 17 <> 0 AS log, CASE WHEN user_id % 17 = 0 THEN 5 ELSE 9 * (user_id % 100 * 2 + 20) END AS log_chars,
  CASE WHEN ai_turns > 0 THEN cycles / ai_turns ELSE 0.0 END AS ratio, CASE WHEN cycles > 0 THEN thought_chars / cycles ELSE 0.0 END AS mean_chars,
  CASE WHEN cycles < 20 THEN '10-19' WHEN cycles < 40 THEN '20-39' ELSE '40+' END AS band FROM rec),
ok AS (SELECT * FROM feat WHERE ai_turns >= 10 AND cycles >= 10 AND ratio >= 0.8 AND list_contains(phases, 'inspect') AND list_contains(phases, 'edit') AND patch AND log AND bugfix)"""
_CANDIDATES = """
cand AS (SELECT o_orderkey::VARCHAR AS uid, o_custkey::VARCHAR AS instance_id, 'r' || o_custkey % 50 AS repository, lower(split_part(o_orderpriority, '-', 1)) AS model_short, o_orderstatus = 'F' AS target, o_totalprice AS quality_score,
  CASE WHEN o_totalprice < 100000 THEN '10-19' WHEN o_totalprice < 200000 THEN '20-39' ELSE '40+' END AS length_band FROM orders WHERE o_orderstatus IN ('F', 'O'))"""
_JITTER = "(('0x' || substr(sha256('20260814:' || {0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_PAIRS = f"""{_CANDIDATES},
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY instance_id, model_short, target ORDER BY quality_score DESC, {_JITTER.format("uid")} DESC, uid) = 1),
pairs AS (SELECT a.instance_id, a.model_short, a.uid AS success, b.uid AS failure,
  a.quality_score + b.quality_score + CASE WHEN a.length_band <> b.length_band THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END + {_JITTER.format("a.instance_id")} AS score
  FROM best a JOIN best b ON a.instance_id = b.instance_id AND a.model_short = b.model_short AND a.target AND NOT b.target)"""
_LINES = """
base AS (SELECT l_orderkey AS unit_id, l_linenumber::VARCHAR AS action_id, (min(l_suppkey) % 3)::VARCHAR AS intent_id, CASE min(l_returnflag) WHEN 'A' THEN 'yes' WHEN 'R' THEN 'no' ELSE 'uncertain' END AS operation_match FROM lineitem GROUP BY l_orderkey, l_linenumber),
units AS (SELECT unit_id, count(*) AS n_actions, unit_id % 4 <> 0 AS window_complete FROM base GROUP BY unit_id),
res AS (SELECT unit_id, intent_id, CASE WHEN bool_or(operation_match = 'yes') THEN 'yes' WHEN any_value(window_complete) AND count(*) = any_value(n_actions) AND bool_and(operation_match = 'no') THEN 'no' ELSE 'uncertain' END AS operation_match,
  coalesce(list_sort(list(action_id) FILTER (operation_match = 'yes')), []) AS matched FROM base JOIN units USING (unit_id) WHERE intent_id <> '2' GROUP BY unit_id, intent_id),
lab AS (SELECT unit_id, count(*) FILTER (operation_match = 'yes') AS y, count(*) FILTER (operation_match = 'no') AS x, count(*) FILTER (operation_match = 'uncertain') AS u FROM units LEFT JOIN res USING (unit_id) GROUP BY unit_id),
step AS (SELECT unit_id, u, CASE WHEN y + x + u = 0 THEN 'not_applicable' WHEN x + u = 0 THEN 'fully_consistent' WHEN y + u = 0 THEN 'fully_inconsistent' WHEN y > 0 AND x > 0 THEN 'partially_consistent' ELSE 'uncertain' END AS step_label FROM lab)"""


# --- trajectories -----------------------------------------------------------------------------------------------------


@query(f"""WITH {_RECORDS} SELECT instance_id, model_short, band AS length_band, cycles::BIGINT AS valid_cycles,
  15.0::DOUBLE + 15.0::DOUBLE * least(greatest(cycles - 10, 0) / 30.0::DOUBLE, 1.0::DOUBLE) + (15.0::DOUBLE * ratio + 10.0::DOUBLE * least(mean_chars / 350.0::DOUBLE, 1.0::DOUBLE))
  + (CASE WHEN list_contains(phases, 'inspect') THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN list_contains(phases, 'edit') THEN 5 ELSE 0 END + CASE WHEN list_contains(phases, 'test') THEN 6 ELSE 0 END + CASE WHEN list_contains(phases, 'run') THEN 2 ELSE 0 END + CASE WHEN list_contains(phases, 'other') THEN 2 ELSE 0 END)
  + (10.0::DOUBLE + CASE WHEN list_contains(phases, 'test') OR log_chars >= 1000 THEN 5 ELSE 0 END) + CASE WHEN cycles BETWEEN 15 AND 50 THEN 10.0::DOUBLE ELSE 8.0::DOUBLE END AS quality_score FROM ok""")
def trajectory_quality(spark, sf_dir):
    d = trajectory.scored(trajectory.eligible(trajectory.features(I.trajectories(spark, sf_dir))), rounded=False)
    return d.select("instance_id", "model_short", "length_band", F.col("valid_cycles").cast("long"), "quality_score")


@query(f"WITH {_STEPS} SELECT phase, count(*)::BIGINT AS n FROM st GROUP BY phase")
def action_phase_counts(spark, sf_dir):
    return I.event_steps(spark, sf_dir).groupBy(T.action_phase(F.col("command")).alias("phase")).agg(F.count("*").alias("n"))


@query(rf"""WITH {_STEPS}, t AS (SELECT event_id, thought || chr(10) || '```sh' || chr(10) || 'ls -a' || chr(10) || '```' || chr(10) || 'then ' || reply || chr(10) || '```' || command || chr(10) || '```' || ' end' AS x FROM ev),
p AS (SELECT *, regexp_extract_all(x, '(?s)```[^\n`]*\n?(.*?)```') AS w, regexp_extract_all(x, '(?s)```[^\n`]*\n?(.*?)```', 1) AS g, regexp_split_to_array(x, '(?s)```[^\n`]*\n?(.*?)```') AS s FROM t)
SELECT event_id, trim(g[-1], chr(10) || ' ') AS action, trim(left(x, length(x) - length(s[-1]) - length(w[-1])), chr(10) || ' ') AS thought FROM p""")
def last_fenced_block(spark, sf_dir):
    s = I.event_steps(spark, sf_dir)
    text = F.concat("thought", F.lit("\n```sh\nls -a\n```\nthen "), T.strip(F.col("reply")), F.lit("\n```"), "command", F.lit("\n``` end"))
    return s.select("event_id", T.last_block(text).alias("b")).select("event_id", "b.action", "b.thought")


@query(f"WITH {_STEPS} SELECT event_id, thought FROM st WHERE explicit")
def explicit_thought_filter(spark, sf_dir):
    return I.event_steps(spark, sf_dir).where(T.is_explicit_thought(F.col("thought"))).select("event_id", "thought")


_TITLES = ("Add support for error {k}", "TypeError in item {k}", "Problem with total {k}", "Log   the failing {k}", "Total {k} is wrong", "Nothing to see {k}", "   ", "Refresh {k} doesn't work")


@query(rf"""WITH t AS (SELECT o_orderkey, trim(regexp_replace(replace([{", ".join("'" + x.replace("'", "''") + "'" for x in _TITLES)}][o_orderkey % 8 + 1], '{{k}}', o_orderkey::VARCHAR), '\s+', ' ', 'g')) AS title FROM orders)
SELECT o_orderkey, title FROM t WHERE title <> '' AND NOT regexp_matches(title, '(?i)^(add|log|refactor|support)\b') AND regexp_matches(title, '(?i)\b(error|typeerror|problem|wrong|doesn''?t|fail(ing)?)\b')""")
def bugfix_titles(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    raw = F.replace(F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", T.squeeze(raw).alias("title")).where(T.is_bugfix(F.col("title")))


_ISSUES = ("ISSUE: broken {k}", "see tissue: {k} is wrong", "Given\nissue:\n\n  ## Crash {k}\nmore", "plain {k}", " ", "Reissue:no {k}", "# ISSUE:{k}")


@query(f"""WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_orderkey::VARCHAR AS n FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'broken ' || n WHEN 1 THEN 'see tissue: ' || n || ' is wrong' WHEN 2 THEN '## Crash ' || n || chr(10) || 'more' WHEN 3 THEN 'plain ' || n WHEN 4 THEN 'second ' || n WHEN 5 THEN 'Reissue:no ' || n WHEN 6 THEN n END AS issue,
  CASE k WHEN 0 THEN 'broken ' || n WHEN 1 THEN 'see tissue: ' || n || ' is wrong' WHEN 2 THEN 'Crash ' || n WHEN 3 THEN 'plain ' || n WHEN 4 THEN 'second ' || n WHEN 5 THEN 'Reissue:no ' || n WHEN 6 THEN n END AS title FROM t""")
def issue_texts(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    n = F.col("o_orderkey").cast("string")
    said = F.replace(F.element_at(F.array(*map(F.lit, _ISSUES)), (F.col("o_orderkey") % len(_ISSUES) + 1).cast("int")), F.lit("{k}"), n)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    d = o.select("o_orderkey", T.issue_text(F.array(message("system", F.lit("ISSUE: none")), message("user", said), message("user", F.concat(F.lit("second "), n)))).alias("issue"))
    return d.select("o_orderkey", "issue", T.issue_title(F.col("issue")).alias("title"))


@query("""SELECT o_orderkey, 'shard-' || o_custkey % 3 || '.jsonl:' || o_orderkey AS uid, CASE WHEN o_orderkey % 4 = 0 THEN 'f' || o_custkey || '.v1' WHEN o_orderkey % 4 = 1 THEN 'noext' ELSE 'own' || o_orderkey END AS identity,
  CASE o_orderkey % 4 WHEN 2 THEN 'text' ELSE '' END AS coerced FROM orders""")
def record_names(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    own = F.when(k >= 2, F.concat(F.lit("own"), n)).when(k == 1, "")
    file = F.when(k == 1, "noext").otherwise(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".v1.json")))
    raw = F.parse_json(F.when(k == 0, "3").when(k == 1, "[1]").when(k == 2, '"text"').otherwise("null"))
    return o.select("o_orderkey", T.uid(F.concat(F.lit("shard-"), (F.col("o_custkey") % 3).cast("string"), F.lit(".jsonl")), F.col("o_orderkey")).alias("uid"), T.identity(own, file).alias("identity"), T.only_string(raw).alias("coerced"))


_ANSWERS = (('{{"a": {k}}}', True), ('```json\n{{"a": {k}}}\n```', True), ("```\n{{\"a\": {k}}}\n``` more", False), ("[{k}]", False), ("{{", False), ('  {{"a": {k}}}\n', True))


@query(f"""SELECT event_id, CASE WHEN [{", ".join(str(ok).lower() for _, ok in _ANSWERS)}][event_id % {len(_ANSWERS)} + 1] THEN event_id END AS a FROM events""")
def parsed_answers(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(r.replace("{{", "{").replace("}}", "}")) for r, _ in _ANSWERS)), (F.col("event_id") % len(_ANSWERS) + 1).cast("int"))
    answer = T.parse_object(F.replace(raw, F.lit("{k}"), F.col("event_id").cast("string")))
    return I.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(answer, "$.a", "bigint").alias("a"))


@query("""SELECT conv_id, coalesce(bool_or(turn = 0 AND role = 'system' AND trim(text) <> ''), false) AND coalesce(bool_or(role = 'user' AND trim(text) <> ''), false) AS complete FROM conversations GROUP BY conv_id""")
def context_checks(spark, sf_dir):
    """Whether a conversation begins with a system message and has a request."""
    c = I.table(spark, sf_dir, "conversations")
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.lit(None).cast("string").alias("system_prompt")))
    d = c.where("turn is not null").groupBy("conv_id").agg(m.alias("trajectory"))
    return d.select("conv_id", trajectory.context_complete(F.col("trajectory"), T.issue_text(F.col("trajectory"))).alias("complete"))


@query("""WITH m AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) AS text, lead(role) OVER w AS after_role, trim(lead(coalesce(text, '')) OVER w) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) FILTER (role = 'assistant')::BIGINT AS turns, count(*) FILTER (role = 'assistant' AND text <> '' AND after_role = 'user' AND after <> '')::BIGINT AS cycles FROM m GROUP BY conv_id""")
def valid_cycles(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    body = T.strip(T.text_or_empty(F.col("text")))
    m = I.table(spark, sf_dir, "conversations").select("conv_id", "role", body.alias("text"), F.lead("role").over(w).alias("after_role"), F.lead(body).over(w).alias("after"))
    said = F.col("role") == "assistant"
    return m.groupBy("conv_id").agg(F.count_if(said).alias("turns"), F.count_if(said & (F.col("text") != "") & (F.col("after_role") == "user") & (F.col("after") != "")).alias("cycles"))


@query(f"""WITH {_RECORDS} SELECT count(*)::BIGINT AS records, count(*) FILTER (ai_turns >= 10 AND cycles >= 10)::BIGINT AS turns, count(*) FILTER (ratio >= 0.8)::BIGINT AS ratio, count(*) FILTER (list_contains(phases, 'inspect') AND list_contains(phases, 'edit'))::BIGINT AS phases,
  count(*) FILTER (patch)::BIGINT AS patch, count(*) FILTER (log)::BIGINT AS log, count(*) FILTER (bugfix)::BIGINT AS bugfix, (SELECT count(*) FROM ok)::BIGINT AS eligible FROM feat""")
def hard_filter_breakdown(spark, sf_dir):
    d = trajectory.features(I.trajectories(spark, sf_dir))
    terms = trajectory.hard_filter_terms()
    every = F.lit(True)
    for t in terms.values():
        every = every & t
    return d.agg(F.count("*").alias("records"), *(F.count_if(terms[k]).alias(k) for k in ("turns", "ratio", "phases", "patch", "log", "bugfix")), F.count_if(every).alias("eligible"))


@query(f"WITH {_RECORDS} SELECT band AS length_band, count(*)::BIGINT AS n FROM feat GROUP BY band")
def length_band_hist(spark, sf_dir):
    return trajectory.features(I.trajectories(spark, sf_dir)).groupBy("length_band").agg(F.count("*").alias("n"))


@query(f"""WITH {_STEPS} SELECT user_id, count(*) FILTER (explicit AND reply <> '')::BIGINT AS steps, coalesce(string_agg(thought || '>' || command || '>' || reply, '|' ORDER BY ts, event_id) FILTER (explicit AND reply <> ''), '') AS told FROM st GROUP BY user_id""")
def case_records(spark, sf_dir):
    r = I.trajectories(spark, sf_dir).select("*", F.lit("CASE-0001").alias("selection_id"), F.lit("paired").alias("selection_group"), F.lit("P01").alias("pair_id"))
    c = trajectory.cases(r.withColumn("instance_id", F.col("user_id").cast("string")))
    return c.select(F.col("instance_id").cast("long").alias("user_id"), F.size("steps").cast("long").alias("steps"), F.array_join(F.transform("steps", lambda s: F.concat_ws(">", s["thought"], s["action"], s["observation"])), "|").alias("told"))


@query(f"""WITH {_STEPS}, n AS (SELECT *, row_number() OVER w AS k FROM st WHERE explicit AND reply <> '' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, k, thought, string_agg('THOUGHT ' || k || ': ' || thought || chr(10) || 'ACTION ' || k || ': ' || command || chr(10) || 'OBSERVATION ' || k || ': ' || reply, chr(10) || chr(10)) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n)
SELECT user_id, k::BIGINT AS thought_step, thought, CASE WHEN before IS NULL THEN '[No preceding context]' WHEN length(before) <= 300 THEN before ELSE '[Earlier context truncated]' || chr(10) || right(before, 300) END AS preceding_context FROM c""")
def case_step_history(spark, sf_dir):
    r = I.trajectories(spark, sf_dir).select("*", F.col("user_id").cast("string").alias("selection_id"), F.lit("").alias("selection_group"), F.lit("").alias("pair_id"))
    s = steps.case_steps(trajectory.cases(r), context_chars=300)
    return s.select(F.col("case_id").cast("long").alias("user_id"), "thought_step", "thought", "preceding_context")


# --- selection --------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_JITTER.format('doc_id')} AS jitter FROM documents ORDER BY jitter, doc_id LIMIT 100")
def stable_jitter_sample(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", T.stable_jitter(F.col("doc_id"), selection.SEED).alias("jitter"))
    return d.orderBy("jitter", "doc_id").limit(100)


@query(f"WITH {_CANDIDATES} SELECT model_short, count(*) FILTER (both_targets)::BIGINT AS capacity FROM (SELECT model_short, instance_id, min(target) <> max(target) AS both_targets FROM cand GROUP BY ALL) GROUP BY model_short")
def paired_capacity(spark, sf_dir):
    return selection.paired_capacity(I.candidates(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_options(spark, sf_dir):
    return selection.pair_options(I.candidates(spark, sf_dir)).select("instance_id", "model_short", F.col("success.uid").alias("success"), F.col("failure.uid").alias("failure"), "score")


def _quotas(spark, sf_dir) -> selection.Quotas:
    capacity = {r["model_short"]: r["capacity"] for r in paired_capacity(spark, sf_dir).collect()}
    pairs = selection.fit_quotas(capacity, {"1": 9, "2": 7, "3": 4}, min(20, sum(capacity.get(m, 0) for m in "123")))
    return selection.Quotas(pairs, {m: n + 5 for m, n in pairs.items()})


@query(f"""WITH RECURSIVE {_CANDIDATES}, cap AS (SELECT model_short AS m, count(*) AS n FROM (SELECT model_short, instance_id FROM cand GROUP BY ALL HAVING min(target) <> max(target)) GROUP BY model_short),
c AS (SELECT coalesce(max(n) FILTER (m = '1'), 0) AS a, coalesce(max(n) FILTER (m = '2'), 0) AS b, coalesce(max(n) FILTER (m = '3'), 0) AS d FROM cap),
s(x, y, z, rest) AS (SELECT least(a, 9), least(b, 7), least(d, 4), least(20, a + b + d) - least(a, 9) - least(b, 7) - least(d, 4) FROM c UNION ALL
  SELECT CASE WHEN a - x >= b - y AND a - x >= d - z THEN x + 1 ELSE x END, CASE WHEN b - y > a - x AND b - y >= d - z THEN y + 1 ELSE y END, CASE WHEN d - z > a - x AND d - z > b - y THEN z + 1 ELSE z END, rest - 1 FROM s, c WHERE rest > 0)
SELECT unnest(['1', '2', '3']) AS model_short, unnest([x, y, z])::BIGINT AS pairs FROM s WHERE rest = 0""")
def quota_fit(spark, sf_dir):
    q = _quotas(spark, sf_dir)
    return spark.createDataFrame(sorted(q.pairs.items()), "model_short string, pairs long")


@query()
def representative_selection(spark, sf_dir):
    return selection.numbered(selection.select(I.candidates(spark, sf_dir), _quotas(spark, sf_dir)))


@query(f"""WITH {_PAIRS}, best_of AS (SELECT p.*, c.repository FROM pairs p JOIN cand c ON c.uid = p.success QUALIFY row_number() OVER (PARTITION BY p.model_short, c.repository ORDER BY p.score DESC, p.instance_id) = 1),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, instance_id, model_short) AS k FROM best_of),
s AS (SELECT 'P' || lpad(k::VARCHAR, greatest(2, length(k::VARCHAR))::INT, '0') AS pair_id, unnest([{{'u': success, 't': true}}, {{'u': failure, 't': false}}]) AS x, model_short FROM top)
SELECT 'CASE-' || lpad((row_number() OVER (ORDER BY pair_id, x.t DESC, model_short, x.u))::VARCHAR, 4, '0') AS selection_id, pair_id, x.u AS uid FROM s""")
def case_numbering(spark, sf_dir):
    """The best pair of each model and repository, numbered: as many as there are models and repositories."""
    first = Window.partitionBy("model_short", "repository").orderBy(F.desc("score"), "instance_id")
    top = selection.pair_options(I.candidates(spark, sf_dir)).withColumn("_r", F.row_number().over(first)).where("_r = 1")
    k = F.row_number().over(Window.orderBy(F.desc("score"), "instance_id", "model_short"))
    top = top.withColumn("pair_id", F.format_string("P%02d", k))
    s = top.select("pair_id", "model_short", F.explode(F.array(F.struct(F.col("success.uid").alias("uid"), F.lit(True).alias("target")), F.struct(F.col("failure.uid").alias("uid"), F.lit(False).alias("target")))).alias("x"))
    s = s.select("pair_id", "model_short", "x.uid", "x.target", F.lit("paired").alias("selection_group"))
    return selection.numbered(s).select("selection_id", "pair_id", "uid")


@query(f"""WITH {_CANDIDATES}, g AS (SELECT *, CASE WHEN repository IN ('r1', 'r2') THEN 'paired' ELSE 'diversity' END AS selection_group FROM cand)
SELECT target, selection_group, model_short, length_band, count(*)::BIGINT AS n, count(DISTINCT instance_id)::BIGINT AS instances, count(DISTINCT repository)::BIGINT AS repositories, min(quality_score) AS least, max(quality_score) AS most, round(avg(quality_score), 3) AS mean FROM g
GROUP BY GROUPING SETS ((target), (selection_group), (model_short), (length_band), (target, model_short), (target, length_band), ())""")
def selection_summary(spark, sf_dir):
    c = I.candidates(spark, sf_dir).withColumn("selection_group", F.when(F.col("repository").isin("r1", "r2"), "paired").otherwise("diversity"))
    return selection.summary(c).withColumn("mean", F.round("mean", 3))


# --- validation -------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT c_custkey AS id, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def id_reconcile(spark, sf_dir):
    return validation.reconcile(I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), I.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("SELECT l_orderkey || ':' || l_linenumber AS id, count(*)::BIGINT AS n FROM lineitem GROUP BY id HAVING n > 1")
def duplicate_ids(spark, sf_dir):
    return validation.duplicates(I.table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")), "id")


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m, c_custkey % 2 = 0 AS t FROM customer), n AS (SELECT count(*) AS n FROM c),
r(position, rule, ok) AS (VALUES (0, 'the expected count is positive', true), (1, 'number of files', true), (2, 'file names', (SELECT max(k) < 10000 FROM c)), (3, 'unique case ids', true), (4, 'case ids equal file names', (SELECT count(*) = 0 FROM c WHERE k % 400 = 7)), (5, 'unique ids of JSON lines', true),
  (6, 'ids of JSON lines', (SELECT count(*) = 0 FROM c WHERE k % 400 = 7)), (7, 'unique ids of the manifest', false), (8, 'ids of the manifest', false), (9, 'there is a summary', true), (10, 'selected_count', true), (11, 'target_counts as derived', true),
  (12, 'model_counts as derived', true), (13, 'selection_group_counts as derived', false)) SELECT position::INT AS position, rule, ok FROM r""")
def snapshot_checks(spark, sf_dir):
    """A snapshot of customers: a few ids that aren't their file's, a manifest that repeats ids, and a wrong count."""
    c = I.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.concat(F.lit("CASE-"), F.when(k < 10_000, F.lpad(k.cast("string"), 4, "0")).otherwise(k.cast("string")))
    cases = c.select(F.concat(name, F.lit(".json")).alias("file_name"), F.when(k % 400 == 7, F.concat(name, F.lit("x"))).otherwise(name).alias("case_id"), (k % 2 == 0).alias("target"), F.col("c_mktsegment").alias("model_name"), F.lit("paired").alias("selection_group"))
    n = c.count()
    count = lambda d, x: {str(r[x]).lower() if isinstance(r[x], bool) else r[x]: r["count"] for r in d.groupBy(x).count().collect()}
    told = {"selected_count": n, "target_counts": count(cases, "target"), "model_counts": count(cases, "model_name"), "selection_group_counts": {"paired": n + 1}}
    manifest = c.select(F.when(k == 1, F.lit("CASE-0002")).otherwise(name).alias("selection_id"))
    return validation.snapshot_rules(cases, c.select(name.alias("case_id")), manifest, told, n).drop("detail")


_RAW = (
    ('{"intents": [{"intent_quote": "alpha", "temporal_scope": "current"}, {"intent_quote": "gamma", "temporal_scope": "future"}]}', "valid"),
    ('{"intents": ', "invalid_json"),
    ('{"intents": [], "more": 1}', "invalid_schema"),
    ('{"intents": [{"intent_quote": "alpha"}]}', "invalid_schema"),
    ('{"intents": [{"intent_quote": " ", "temporal_scope": "current"}]}', "invalid_scope_or_quote"),
    ('{"intents": [{"intent_quote": "alpha", "temporal_scope": "past"}]}', "invalid_scope_or_quote"),
    ('{"intents": [{"intent_quote": "delta", "temporal_scope": "current"}]}', "non_source_quote"),
    ('{"intents": [{"intent_quote": "beta", "temporal_scope": "current"}, {"intent_quote": "beta", "temporal_scope": "future"}]}', "duplicate_quote"),
    ('{"intents": [{"intent_quote": "beta", "temporal_scope": "current"}, {"intent_quote": "alpha", "temporal_scope": "current"}]}', "source_order_wrong"),
    ('{"intents": []}', "valid"),
    ("[1]", "invalid_schema"),
    ('{"intents": [{"intent_quote": 5, "temporal_scope": "current"}]}', "invalid_scope_or_quote"),
)


@query(f"SELECT event_id, [{', '.join(repr(s) for _, s in _RAW)}][event_id % {len(_RAW)} + 1] AS status FROM events")
def extraction_status(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(r) for r, _ in _RAW)), (F.col("event_id") % len(_RAW) + 1).cast("int"))
    return I.table(spark, sf_dir, "events").select("event_id", validation.extraction_status(raw, F.lit("alpha beta gamma")).alias("status"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'intent_id' WHEN event_id % 6 = 1 THEN 'quote_not_in_source' WHEN event_id % 6 = 2 THEN 'blank_text' WHEN event_id % 6 = 3 THEN 'reason_with_intents' WHEN event_id % 6 = 4 THEN 'thought_step' END AS status FROM events""")
def intent_validation(spark, sf_dir):
    k, n = F.col("event_id") % 6, F.lit(3).cast("long")
    one = F.struct(F.when(k == 0, "T3-I2").otherwise("T3-I1").alias("intent_id"), F.when(k == 2, " ").otherwise("look").alias("intent_text"), F.when(k == 1, "delta").otherwise("beta").alias("source_quote"))
    result = F.struct(F.when(k == 4, F.lit(2)).otherwise(F.lit(3)).cast("long").alias("thought_step"), F.array(one).alias("execution_intents"), F.when(k == 3, "none").alias("no_intent_reason"))
    return I.table(spark, sf_dir, "events").select("event_id", validation.intent_status(result, n, F.lit("alpha beta gamma")).alias("status"))


@query("""SELECT c.conv_id, c.turn, coalesce(bool_or(contains(a.text, c.text)), false) AS quoted FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant' WHERE c.role = 'user' GROUP BY c.conv_id, c.turn""")
def quote_containment(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    users, said = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("quote")), c.where("role = 'assistant'").select("conv_id", F.col("text").alias("answer"))
    return users.join(said, "conv_id", "left").groupBy("conv_id", "turn").agg(F.coalesce(F.bool_or(F.contains("answer", "quote")), F.lit(False)).alias("quoted"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 97 = 5")
def seek_lookup(spark, sf_dir):
    """Events as JSON-lines shards, their sparse index, and a lookup of some rows by their places."""
    path = shared_folder(spark, "events")
    I.table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value")).write.text(path)
    places = written(files.read_jsonl(spark, path, "part-*").select("source_file", "source_row", "source_offset", F.get_json_object("value", "$.event_id").cast("long").alias("event_id")), "places")
    found = seek.lookup_rows(path, places.where("event_id % 97 = 5"), seek.sparse_index(places))
    return found.select(F.from_json("value", "event_id long, user_id long, event_type string").alias("e")).select("e.*")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def passage_containment(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return audit.passages_within(I.table(spark, sf_dir, "benchmark").select("item_id", "text"), d)


@query("""SELECT l_orderkey, l_linenumber, format('{:.2f}', v)::DOUBLE AS two, format('{:.3f}', v)::DOUBLE AS three FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE / 1000 + l_quantity::DOUBLE / 8 AS v FROM lineitem)""")
def rounded_values(spark, sf_dir):
    """Doubles near ties, rounded by their exact binary values."""
    v = F.col("l_extendedprice").cast("double") / 1000 + F.col("l_quantity").cast("double") / 8
    return I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.round_exact(v, 2).alias("two"), T.round_exact(v, 3).alias("three"))


@query("""WITH k AS (SELECT event_id AS item_id, event_id % 3 AS split, event_id // 7 AS intent, event_type AS tool, (event_id * 7 % 23)::VARCHAR AS line, 'p' || (user_id % 11) AS path FROM events),
f AS (SELECT *, unnest(['line', 'path']) AS field, unnest([line, path]) AS value FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY split, tool, field ORDER BY sha256('7:' || value), value) AS r, count(*) OVER (PARTITION BY split, tool, field) AS n FROM (SELECT DISTINCT split, tool, field, value FROM f)),
t AS (SELECT f.item_id, f.split, f.intent, f.tool, f.field, q.value, CASE WHEN f.field = 'line' THEN q.value ELSE line END AS line, CASE WHEN f.field = 'path' THEN q.value ELSE path END AS path
  FROM f JOIN p ON p.split = f.split AND p.tool = f.tool AND p.field = f.field AND p.value = f.value JOIN p q ON q.split = p.split AND q.tool = p.tool AND q.field = p.field AND q.value <> p.value AND (q.r - p.r + p.n) % p.n <= 12),
o AS (SELECT split, tool, line, path, min(item_id) AS observed_id FROM k GROUP BY ALL),
c AS (SELECT t.*, observed_id FROM t ANTI JOIN k ON k.split = t.split AND k.intent = t.intent AND k.tool = t.tool AND k.line = t.line AND k.path = t.path LEFT JOIN o ON o.split = t.split AND o.tool = t.tool AND o.line = t.line AND o.path = t.path)
SELECT item_id, field, value, observed_id, row_number() OVER (PARTITION BY item_id ORDER BY observed_id IS NULL, sha256('7:' || field || ':' || value), field, value)::INT AS rank FROM c QUALIFY rank <= 12""")
def parameter_corruptions(spark, sf_dir):
    """Events as actions with two arguments, each changed to other values that the split's actions of the tool have."""
    k = F.col("event_id")
    arguments = F.create_map(F.lit("path"), F.concat(F.lit("p"), (F.col("user_id") % 11).cast("string")), F.lit("line"), (k * 7 % 23).cast("string"))
    e = I.table(spark, sf_dir, "events").select(k.alias("item_id"), (k % 3).alias("split"), F.floor(k / 7).alias("intent"), F.col("event_type").alias("tool"), arguments.alias("arguments"))
    return curation.parameter_corruptions(e).select("item_id", "field", "value", "observed_id", "rank")


# --- steps ------------------------------------------------------------------------------------------------------------

_WHITE_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"
_HISTORY = f"""WITH m AS (SELECT *, trim(coalesce(text, ''), {_WHITE_SQL}) AS body FROM conversations),
h AS (SELECT conv_id, turn, role, body, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS k,
  string_agg(CASE WHEN role <> 'system' THEN upper(role) || ': ' || CASE WHEN body <> '' THEN body ELSE '[empty content]' END END, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)"""


@query(f"""{_HISTORY} SELECT conv_id, turn, CASE WHEN coalesce(before, '') = '' THEN '[No preceding context]' WHEN length(before) <= 200 THEN before ELSE '[Earlier context truncated]' || chr(10) || right(before, 200) END AS preceding_context FROM h WHERE role = 'assistant'""")
def preceding_context(spark, sf_dir):
    return steps.assistant_steps(I.table(spark, sf_dir, "conversations"), context_chars=200).select("conv_id", F.col("source_index").alias("turn"), "preceding_context")


@query(f"{_HISTORY} SELECT conv_id, k::BIGINT AS thought_step, turn AS source_index, body AS thought FROM h WHERE role = 'assistant'")
def assistant_steps(spark, sf_dir):
    return steps.assistant_steps(I.table(spark, sf_dir, "conversations")).select("conv_id", "thought_step", "source_index", "thought")


_CALLS_SQL = "CASE WHEN role = 'assistant' THEN list_transform(range(length(text) % 3), lambda k: 'f' || k || '({\"a\": \"x\", \"b\": ' || turn || '})') ELSE [] END"


@query(f"""WITH m AS (SELECT *, trim(coalesce(text, ''), {_WHITE_SQL}) AS body, {_CALLS_SQL} AS calls FROM conversations WHERE role <> 'system'),
l AS (SELECT *, upper(role) || ': ' || CASE WHEN body <> '' THEN body ELSE '[empty content]' END || CASE WHEN len(calls) > 0 THEN chr(10) || 'ACTIONS: ' || array_to_string(calls, ' | ') ELSE '' END AS line FROM m),
h AS (SELECT *, string_agg(line, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT conv_id, turn, CASE WHEN coalesce(before, '') = '' THEN '[No preceding context]' WHEN length(before) <= 200 THEN before ELSE '[Earlier context truncated]' || chr(10) || right(before, 200) END AS preceding_context, len(calls)::INT AS actions, 'task ' || conv_id AS user_request FROM h WHERE role = 'assistant'""")
def chat_steps(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    one = lambda k: F.concat(F.lit('{"function": "f'), k.cast("string"), F.lit('", "args": {"b": '), F.col("turn").cast("string"), F.lit(', "a": "x"}}'))
    calls = F.filter(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.when(k < F.length("text") % 3, one(k))), lambda x: x.isNotNull())
    d = c.withColumn("tool_calls", F.when(F.col("role") == "assistant", calls))
    tasks = c.select("conv_id").distinct().select("conv_id", F.concat(F.lit("task "), F.col("conv_id").cast("string")).alias("task"))
    s = steps.assistant_steps(d, context_chars=200, tasks=tasks)
    return s.select("conv_id", F.col("source_index").alias("turn"), "preceding_context", F.size("actual_actions").alias("actions"), "user_request")


@query(f"WITH {_STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM st WHERE explicit AND reply <> '') SELECT user_id, k::BIGINT AS thought_step, [command] AS actual_actions, 'value is wrong' AS user_request FROM n")
def case_step_actions(spark, sf_dir):
    r = I.trajectories(spark, sf_dir).select("*", F.col("user_id").cast("string").alias("selection_id"), F.lit("").alias("selection_group"), F.lit("").alias("pair_id"))
    s = steps.case_steps(trajectory.cases(r).withColumn("task", F.lit("value is wrong")))
    return s.select(F.col("case_id").cast("long").alias("user_id"), "thought_step", "actual_actions", "user_request")


@query("SELECT name FROM (SELECT DISTINCT doc_id::VARCHAR || '.json' AS name FROM documents) ORDER BY name LIMIT 25")
def first_files(spark, sf_dir):
    return steps.first_files(I.table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name")).distinct(), 25)


@query("""SELECT CASE WHEN user_id % 2 = 0 THEN 'chat' ELSE 'swe' END AS source_type, CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'error' WHEN 'signup' THEN 'skipped_empty' ELSE 'unknown' END AS status,
  count(*)::BIGINT AS steps, sum(CASE WHEN event_type = 'view' THEN event_id % 3 ELSE 0 END)::BIGINT AS intents FROM events GROUP BY ALL""")
def run_summary(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "click", "error").when(F.col("event_type") == "signup", "skipped_empty").when(F.col("event_type") == "purchase", "")
    intents = F.when(F.col("event_type") == "view", F.array_repeat(F.lit("i"), (F.col("event_id") % 3).cast("int")))
    return steps.run_summary(e.select(F.when(F.col("user_id") % 2 == 0, "chat").otherwise("swe").alias("source_type"), status.alias("status"), intents.alias("execution_intents")))


@query("""WITH m AS (SELECT conv_id, length(text) % 3 AS calls, turn % 4 <> 3 AS told FROM conversations WHERE role = 'assistant' AND length(text) % 3 > 0),
s AS (SELECT c.conv_id, count(m.conv_id) AS acting, count(*) FILTER (told) AS direct, coalesce(sum(calls), 0) AS total FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON c.conv_id = m.conv_id GROUP BY c.conv_id)
SELECT conv_id::VARCHAR AS name, CASE WHEN acting > 0 THEN direct / acting ELSE 0.0 END AS coverage, direct::BIGINT AS direct, total::BIGINT AS total FROM s ORDER BY coverage DESC, direct DESC, total DESC, name LIMIT 5""")
def chat_topk(spark, sf_dir):
    c = I.table(spark, sf_dir, "conversations")
    message = F.struct("turn", "role", F.when(F.col("turn") % 4 != 3, "said").otherwise(" ").alias("content"), F.array_repeat(F.lit("call"), (F.length("text") % 3).cast("int")).alias("tool_calls"))
    chats = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    scored = chats.select(F.col("conv_id").cast("string").alias("name"), steps.call_coverage(F.col("messages")).alias("s")).select("name", "s.coverage", F.col("s.direct").cast("long").alias("direct"), F.col("s.total").cast("long").alias("total"))
    return steps.top_files(scored, 5)


@query("SELECT source_type, count(*)::BIGINT AS n, min(name) AS first, max(name) AS last FROM (SELECT DISTINCT conv_id::VARCHAR AS name, 'kimi' AS source_type FROM conversations UNION ALL SELECT doc_id::VARCHAR, 'swe' FROM documents) GROUP BY source_type")
def source_union(spark, sf_dir):
    chats = I.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("name")).distinct()
    others = I.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"))
    return steps.source_union(chats, others).groupBy("source_type").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query(f"""{_HISTORY} SELECT conv_id, turn, 'Step ' || k || chr(10) || 'Thought: ' || CASE WHEN body <> '' THEN body ELSE '[Empty observable Thought]' END || chr(10) || 'Request: [No user request provided]' AS prompt FROM h WHERE role = 'assistant'""")
def step_prompts(spark, sf_dir):
    s = steps.assistant_steps(I.table(spark, sf_dir, "conversations"))
    prompt = T.build_prompt("Step {thought_step}\nThought: {thought}\nRequest: {user_request}", F.col("thought_step"), F.lit(""), F.col("preceding_context"), F.col("thought"))
    return s.select("conv_id", F.col("source_index").alias("turn"), prompt.alias("prompt"))


# --- resume -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'reason_missing' END AS status FROM orders")
def empty_results(spark, sf_dir):
    """The result of an empty thought is valid; one without its reason isn't."""
    k = F.col("o_orderkey")
    whole = inference.empty_result(k)
    result = F.struct(whole["thought_step"].alias("thought_step"), whole["execution_intents"].alias("execution_intents"), F.when(k % 3 != 0, whole["no_intent_reason"]).alias("no_intent_reason"))
    return I.table(spark, sf_dir, "orders").select("o_orderkey", validation.intent_status(result, k, F.lit("")).alias("status"))


@query("""SELECT o_orderkey AS unit_id, CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderkey % 3 = 0 THEN 'success' END AS old_status FROM orders""")
def resume_merge(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    key = {"trajectory_id": F.col("o_custkey"), "thought_step": F.col("o_orderkey"), "thought": F.lit("t"), "config_hash": F.col("o_orderkey") % 3}
    fresh = o.select(*(c.alias(n) for n, c in (key | {"config_hash": F.lit(0).cast("long")}).items()))
    attempts = F.array(F.struct(F.lit(1).alias("written_at"), F.lit("error").alias("status")), F.struct(F.lit(2).alias("written_at"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("success").alias("status")))
    old = o.select(*(c.alias(n) for n, c in key.items()), F.explode(attempts).alias("a")).select(*key, "a.*")
    return inference.merge_resume(fresh, old).select(F.col("thought_step").alias("unit_id"), "old_status")


@query("SELECT o_orderkey AS unit_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def remaining_units(spark, sf_dir):
    return inference.remaining(I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id")), I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit_id")))


@query("SELECT 'k' AS key, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS total FROM events")
def usage_by_key(spark, sf_dir):
    return inference.usage_by_key(I.table(spark, sf_dir, "events").select(F.from_json("props", "map<string,bigint>").alias("usage")))


@query("""SELECT o_orderkey, CASE WHEN coalesce(bool_and(l_returnflag = 'A'), true) THEN 'completed' WHEN bool_and(l_returnflag IN ('A', 'N')) THEN 'dry_run' ELSE 'partial' END AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def record_status(spark, sf_dir):
    d = I.table(spark, sf_dir, "orders").join(I.table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return d.groupBy("o_orderkey").agg(inference.record_status(F.col("l_returnflag") == "A", F.col("l_returnflag") == "N").alias("status"))


def _client(payload: dict) -> tuple[str, dict[str, int]]:
    """A model for tests: fails for every ninth prompt, answers no JSON for every seventh."""
    k = int(payload["messages"][1]["content"])
    if k % 9 == 0:
        raise OSError("down")
    return ("no json" if k % 7 == 0 else json.dumps({"k": k})), {"prompt_tokens": k % 5}


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'skipped_empty' WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN 'error' ELSE 'success' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 9 = 0 OR o_orderkey % 7 = 0 THEN 1 ELSE 1 END::INT AS attempts, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 7 <> 0 THEN '{"k": ' || o_orderkey || '}' END AS answer FROM orders""")
def completed_steps(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    s = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("prompt"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise("think").alias("thought"))
    return inference.complete(s, _client, json.loads, "model", "system", tries=1).select("o_orderkey", "status", "attempts", "answer")


class _Flaky:
    """A server for tests, which fails an order's first order % 4 calls; each task has its own."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def __call__(self, payload: dict) -> tuple[str, dict[str, int]]:
        prompt = payload["messages"][1]["content"]
        self.calls[prompt] = self.calls.get(prompt, 0) + 1
        if self.calls[prompt] <= int(prompt) % 4:
            raise OSError("down")
        return json.dumps({"k": int(prompt)}), {"prompt_tokens": self.calls[prompt]}


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'error' ELSE 'success' END AS status, least(o_orderkey % 4 + 1, 3)::INT AS attempts, CASE WHEN o_orderkey % 4 <> 3 THEN '{"k": ' || o_orderkey || '}' END AS answer,
  CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 4 + 1 END AS prompt_tokens, CASE WHEN o_orderkey % 4 = 3 THEN 'OSError: down' END AS error FROM orders""")
def pooled_steps(spark, sf_dir):
    """Eight calls at a time in each task, tried again up to three times."""
    s = I.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("prompt"), F.lit("think").alias("thought"))
    done = inference.complete(s, _Flaky(), json.loads, "model", "system", tries=3, workers=8, sleep=lambda _: None)
    return done.select("o_orderkey", "status", "attempts", "answer", F.col("usage")["prompt_tokens"].alias("prompt_tokens"), "error")


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'uncertain' WHEN event_id % 21 = 4 THEN 'uncertain' WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'no' ELSE 'uncertain' END AS operation_match,
  CASE WHEN event_id % 10 = 0 THEN 'context_overflow' END AS reason, event_id % 10 = 0 OR event_id % 10 > 5 AS beyond_512, event_id % 10 <> 0 AND event_id % 21 = 4 AS failed FROM events""")
def pair_scores(spark, sf_dir):
    k = F.col("event_id")
    tokens = F.when(k % 10 == 0, 9000).when(k % 10 > 5, 600).otherwise(40).cast("int")
    pairs = I.table(spark, sf_dir, "events").select("event_id", F.concat(F.when(k % 21 == 4, "?").otherwise(""), (k % 3).cast("string")).alias("text"), tokens.alias("input_tokens"))
    scored = inference.score_pairs(pairs, lambda texts: [float("nan") if t[0] == "?" else (2.0, -2.0, 0.5)[int(t)] for t in texts], batch_size=1, margin=1.0)
    return scored.select("event_id", "operation_match", "reason", "beyond_512", F.col("error").isNotNull().alias("failed"))


@query("""SELECT event_id, CASE WHEN t > 8192 THEN 'uncertain' WHEN t % 3 = 0 THEN 'yes' ELSE 'no' END AS operation_match, CASE WHEN t > 8192 THEN 'context_overflow' END AS reason, t > 8192 OR t >= 1 AS fits, CASE WHEN t <= 8192 THEN t > 4096 END AS alone
  FROM (SELECT event_id, (event_id * 7919) % 8500 + 1 AS t FROM events)""")
def length_batched_scores(spark, sf_dir):
    """Pairs of all lengths, scored in batches of neighbours in length; the longest alone, so that they aren't padded."""
    t = (F.col("event_id") * 7919 % 8500 + 1).cast("int")
    pairs = I.table(spark, sf_dir, "events").select("event_id", t.cast("string").alias("text"), t.alias("input_tokens"))
    scored = inference.score_pairs(pairs, lambda texts: [1.0 if int(x) % 3 == 0 else -1.0 for x in texts], batch_size=16)
    padded = F.coalesce(F.col("padded_tokens"), F.col("input_tokens"))
    alone = F.when(F.col("reason").isNull(), (F.col("input_tokens") > 4096) & (F.col("padded_tokens") == F.col("input_tokens")))
    return scored.select("event_id", "operation_match", "reason", (padded >= F.col("input_tokens")).alias("fits"), alone.alias("alone"))


def _generate(thought: str) -> tuple[str, bool]:
    """A model for tests, which extracts a thought's first word."""
    kind = thought.split()[1]
    if kind in "35":  # one of kind 5 is too long to get here
        raise OSError("no device")
    quote = "none" if kind == "2" else thought.split()[0]
    return ('{"intents": []}' if kind == "4" else json.dumps({"intents": [{"intent_quote": quote, "temporal_scope": "current"}]})), kind != "1"


@query("""SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 7 IN (1, 2, 3, 5) THEN 'technical_failure' WHEN o_orderkey % 7 = 4 OR o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'completed' ELSE 'completed_with_uncertain' END AS status,
  CASE WHEN o_orderkey % 7 IN (1, 2, 3, 5) THEN 'uncertain' WHEN o_orderkey % 7 = 4 THEN 'not_applicable' WHEN o_orderstatus = 'F' THEN 'fully_consistent' WHEN o_orderstatus = 'O' THEN 'fully_inconsistent' ELSE 'uncertain' END AS step_label,
  CASE o_orderkey % 7 WHEN 1 THEN 'generation_truncated' WHEN 2 THEN 'non_source_quote' WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE 'valid' END AS extraction_status FROM orders""")
def unit_runs(spark, sf_dir):
    """Extraction, matching and aggregation with models that fail in every way."""
    o = I.table(spark, sf_dir, "orders")
    action = F.struct(F.lit("A1").alias("action_id"), F.col("o_orderstatus").alias("model_text"))
    units = o.select(F.col("o_orderkey").alias("unit_id"), F.concat(F.lit("go "), (F.col("o_orderkey") % 7).cast("string")).alias("thought"), F.lit(True).alias("window_complete"), F.array(action).alias("actions"))
    score = {"F": 5.0, "O": -5.0}
    return inference.run_units(units, _generate, lambda t: 9000 if t.endswith("5") else 10, lambda texts: [score.get(t[-1], 0.0) for t in texts], len, 8192, margin=1.0).select("unit_id", "status", "step_label", "extraction_status")


# --- alignment --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN value - 50 >= 5 THEN 'yes' WHEN value - 50 < -5 THEN 'no' ELSE 'uncertain' END AS operation_match FROM events")
def pair_threshold(spark, sf_dir):
    d = I.table(spark, sf_dir, "events").select("event_id", (F.col("value") - 50).alias("logit"))
    return alignment.decide(d, 0.0, 5.0).select("event_id", "operation_match")


@query(f"WITH {_LINES} SELECT b.unit_id, i.intent_id, count(*)::BIGINT AS pairs FROM (SELECT DISTINCT unit_id, intent_id FROM base WHERE intent_id <> '2') i JOIN base b USING (unit_id) GROUP BY ALL")
def intent_action_pairs(spark, sf_dir):
    intents, base, _ = I.line_actions(spark, sf_dir)
    return alignment.candidate_pairs(intents, base.select("unit_id", "action_id")).groupBy("unit_id", "intent_id").agg(F.count("*").alias("pairs"))


@query(f"WITH {_LINES} SELECT unit_id, intent_id, operation_match, array_to_string(matched, ',') AS matched FROM res")
def intent_aggregate(spark, sf_dir):
    intents, base, units = I.line_actions(spark, sf_dir)
    return alignment.intent_results(intents, base, units).select("unit_id", "intent_id", "operation_match", F.array_join("matched_action_ids", ",").alias("matched"))


def _labelled(spark, sf_dir):
    intents, base, units = I.line_actions(spark, sf_dir)
    return alignment.step_labels(alignment.intent_results(intents, base, units), units)


@query(f"WITH {_LINES} SELECT unit_id, step_label FROM step")
def step_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("unit_id", "step_label")


@query(f"WITH {_LINES} SELECT CASE WHEN unit_id % 50 = 0 THEN 'technical_failure' WHEN step_label = 'uncertain' OR unit_id IN (SELECT unit_id FROM base WHERE intent_id <> '2' AND operation_match = 'uncertain') THEN 'completed_with_uncertain' ELSE 'completed' END AS status, step_label, count(*)::BIGINT AS n FROM step GROUP BY ALL")
def unit_status(spark, sf_dir):
    _, base, _ = I.line_actions(spark, sf_dir)
    d = alignment.unit_status(_labelled(spark, sf_dir), base.where("intent_id <> '2'"), F.col("unit_id") % 50 == 0)
    return d.groupBy("status", "step_label").agg(F.count("*").alias("n"))


_REFS = f"""{_LINES}, refs AS (SELECT *, 'q' || intent_id AS q FROM base), preds AS (SELECT unit_id, q, action_id, CASE WHEN unit_id % 50 = 0 THEN 'missing' ELSE m END AS operation_match FROM (SELECT unit_id, q, action_id, CASE WHEN action_id::INT % 3 = 0 THEN 'no' ELSE operation_match END AS m FROM refs WHERE action_id <> '5' UNION ALL SELECT unit_id, 'other', action_id, 'yes' FROM refs WHERE action_id = '5')),
al AS (SELECT coalesce(r.operation_match, 'extra') AS expected, coalesce(p.operation_match, 'missing') AS actual FROM refs r FULL JOIN preds p ON r.unit_id = p.unit_id AND r.q = p.q AND r.action_id = p.action_id)"""


def _aligned(spark, sf_dir):
    _, base, _ = I.line_actions(spark, sf_dir)
    refs = base.select("unit_id", F.concat(F.lit("q"), "intent_id").alias("intent_quote"), F.lit("current").alias("temporal_scope"), "action_id", "operation_match")
    fifth = F.col("action_id") == "5"
    preds = refs.withColumn("operation_match", F.when(fifth, "yes").when(F.col("action_id").cast("int") % 3 == 0, "no").otherwise(F.col("operation_match"))).withColumn("intent_quote", F.when(fifth, "other").otherwise(F.col("intent_quote")))
    return alignment.align(refs, preds, refs.where(F.col("unit_id") % 50 == 0).select("unit_id"))


@query(f"WITH {_REFS} SELECT expected, actual, count(*)::BIGINT AS n FROM al GROUP BY ALL")
def pair_alignment(spark, sf_dir):
    return _aligned(spark, sf_dir).groupBy("expected", "actual").agg(F.count("*").alias("n"))


@query(f"""WITH {_REFS}, c AS (SELECT l.label, (SELECT count(*) FROM al WHERE expected = l.label) AS s, (SELECT count(*) FROM al WHERE actual = l.label) AS p, (SELECT count(*) FROM al WHERE expected = l.label AND actual = l.label) AS h FROM (VALUES ('yes'), ('no'), ('uncertain')) l(label))
SELECT label, s::BIGINT AS support, p::BIGINT AS predicted, h::BIGINT AS hits, CASE WHEN p > 0 THEN h / p ELSE 0.0 END AS precision, CASE WHEN s > 0 THEN h / s END AS recall, CASE WHEN h > 0 THEN 2.0::DOUBLE * h / (s + p) ELSE 0.0 END AS f1 FROM c""")
def confusion_prf(spark, sf_dir):
    return alignment.class_metrics(_aligned(spark, sf_dir))


@query(f"""WITH {_LINES}, p AS (SELECT unit_id, CASE WHEN unit_id % 7 = 0 THEN 'uncertain' ELSE step_label END AS label, CASE WHEN unit_id % 50 = 0 THEN 'technical_failure' ELSE 'completed' END AS status FROM step WHERE unit_id % 11 <> 0)
SELECT count(*)::BIGINT AS units, count(*) FILTER (s.step_label = p.label AND p.status <> 'technical_failure')::BIGINT AS "right", count(*) FILTER (p.unit_id IS NULL)::BIGINT AS missing, count(*) FILTER (p.status = 'technical_failure')::BIGINT AS failed FROM step s LEFT JOIN p USING (unit_id)""")
def full_denominator_rates(spark, sf_dir):
    refs = _labelled(spark, sf_dir)
    unit = F.col("unit_id")
    preds = refs.where(unit % 11 != 0).select("unit_id", F.when(unit % 7 == 0, "uncertain").otherwise(F.col("step_label")).alias("step_label"), F.when(unit % 50 == 0, "technical_failure").otherwise("completed").alias("status"))
    return alignment.unit_rates(refs, preds)


#: Windows of calls as text: the shapes that a call comes in, then one for each rule that a window can break. {t}, {n}: an event's type and number.
_CALLS = (
    '{"tool": "{t}", "arguments": {"note": {n}, "path": "p{n}"}}', '{"function": "{t}", "args": {"path": "p{n}", "b": [1, "x"], "a": null}}, {"tool": "{t}", "arguments": {}, "id": "A{n}"}',
    '{"raw_call": {"tool": "{t}", "arguments": "{\\"cmd\\": \\"ls {n}\\", \\"file\\": \\"f\\"}"}, "action_id": {n}}', '{"raw_call": {"function": {"name": "{t}", "arguments": {"n": {n}, "url": "u"}}, "id": "c{n}"}}',
    "", '{"tool": "{t}", "arguments": {}, "id": true}',
    '7, {"tool": "{t}"}', '{"raw_call": null, "tool": "{t}", "arguments": {}}', '{"tool": "{t}", "arguments": {}}, {"tool": "{t}", "arguments": "{bad"}', '{"tool": " ", "arguments": {"n": {n}}}',
    '{"tool": null, "function": "{t}", "arguments": {}}', '{"tool": "{t}", "id": "a"}, {"tool": "{t}", "action_id": "a"}', '{"tool": "{t}", "arguments": "[1]"}', '{"tool": "{t}", "arguments": {}, "action_id": "", "id": "x"}',
    '{"tool": "{t}", "arguments": {}, "id": "A2"}, {"tool": "{t}", "arguments": {}}, {"tool": "{t}"}',
)
_WINDOWS = [f'{{"unit_id": "u{{n}}", "thought": "t", "window_complete": true, "actions": [{c}]}}' for c in _CALLS] + [
    "[1]", "{bad", '{"unit_id": "u{n}", "thought": null, "window_complete": true, "actions": []}', '{"unit_id": " ", "thought": "t", "window_complete": true, "actions": []}', '{"unit_id": {n}, "thought": "t", "window_complete": true, "actions": []}',
    '{"unit_id": "u{n}", "thought": "t", "window_complete": true, "actions": {}}', '{"unit_id": "u{n}", "thought": "t", "actions": []}', '{"unit_id": "u{n}", "thought": "", "window_complete": 1, "actions": []}',
]


def _windows(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    text = F.element_at(F.array(*map(F.lit, _WINDOWS)), (F.col("event_id") % len(_WINDOWS) + 1).cast("int"))
    return windows.checked_windows(e.select("event_id", F.replace(F.replace(text, F.lit("{t}"), F.col("event_type")), F.lit("{n}"), F.col("event_id").cast("string")).alias("value"))).drop("value")


_TEXTS = ", ".join("'" + w.replace("'", "''") + "'" for w in _WINDOWS)
#: The rules from one value to the next, as json_type tells what is there.
_CHECKED = f"""x AS (SELECT event_id, replace(replace([{_TEXTS}][event_id % {len(_WINDOWS)} + 1], '{{t}}', event_type), '{{n}}', event_id::VARCHAR) AS t FROM events),
w AS (SELECT event_id, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN t::JSON END AS j FROM x),
a AS (SELECT event_id, unnest(json_extract(j, '$.actions[*]')) AS a, unnest(range(1, len(json_extract(j, '$.actions[*]')) + 1)) AS k FROM w),
c AS (SELECT *, CASE WHEN json_type(a, '$.raw_call') IS NULL THEN a ELSE a->'$.raw_call' END AS c FROM a),
f AS (SELECT *, CASE WHEN json_type(c, '$.tool') IS NULL THEN c->'$.function' ELSE c->'$.tool' END AS f FROM c),
g AS (SELECT *, json_type(f) = 'OBJECT' AS nested FROM f),
h AS (SELECT *, CASE WHEN nested THEN f->'$.name' ELSE f END AS tool, CASE WHEN nested THEN f->'$.arguments' WHEN json_type(c, '$.arguments') IS NULL THEN c->'$.args' ELSE c->'$.arguments' END AS given FROM g),
p AS (SELECT *, CASE WHEN json_type(given) <> 'VARCHAR' THEN given WHEN json_valid(given->>'$') THEN (given->>'$')::JSON END AS args,
  CASE WHEN json_type(a, '$.action_id') IS NOT NULL THEN a->'$.action_id' WHEN json_type(a, '$.id') IS NOT NULL THEN a->'$.id' ELSE c->'$.id' END AS i FROM h),
n AS (SELECT *, CASE WHEN i IS NULL THEN 'A' || k WHEN json_type(i) = 'NULL' THEN 'None' WHEN json_type(i) = 'BOOLEAN' THEN upper((i::VARCHAR)[1]) || (i::VARCHAR)[2:] ELSE i->>'$' END AS id FROM p),
r AS (SELECT *, CASE WHEN json_type(a) <> 'OBJECT' THEN 'action_is_no_object' WHEN json_type(c) <> 'OBJECT' THEN 'call_is_no_object' WHEN json_type(given) = 'VARCHAR' AND args IS NULL THEN 'arguments_are_no_json'
  WHEN coalesce(json_type(tool), '') <> 'VARCHAR' OR trim(tool->>'$') = '' THEN 'tool_is_blank' WHEN coalesce(json_type(args), '') <> 'OBJECT' THEN 'arguments_are_no_object'
  WHEN id = '' THEN 'action_id_is_empty' WHEN row_number() OVER (PARTITION BY event_id, id ORDER BY k) > 1 THEN 'action_id_repeats' END AS fault FROM n),
first AS (SELECT event_id, min(k) AS k, arg_min(fault, k) AS fault FROM r WHERE fault IS NOT NULL GROUP BY event_id),
s AS (SELECT event_id, j, first.k, CASE WHEN j IS NULL THEN 'no_object' WHEN coalesce(json_type(j, '$.thought'), '') <> 'VARCHAR' THEN 'thought_is_no_text' WHEN coalesce(json_type(j, '$.unit_id'), '') <> 'VARCHAR' OR trim(j->>'$.unit_id') = '' THEN 'unit_id_is_blank'
  WHEN coalesce(json_type(j, '$.actions'), '') <> 'ARRAY' THEN 'actions_are_no_list' WHEN coalesce(json_type(j, '$.window_complete'), '') <> 'BOOLEAN' THEN 'window_complete_is_no_flag' END AS own, coalesce(own, fault, 'valid') AS status FROM w LEFT JOIN first USING (event_id))"""


@query(f"""WITH {_CHECKED}
SELECT event_id, CASE WHEN json_type(j, '$.unit_id') = 'VARCHAR' THEN j->>'$.unit_id' END AS unit_id, CASE WHEN json_type(j, '$.window_complete') = 'BOOLEAN' THEN (j->'$.window_complete')::BOOLEAN END AS window_complete, status, CASE WHEN own IS NULL THEN k::INT END AS fault_at,
  CASE WHEN status = 'valid' THEN coalesce((SELECT string_agg(id || '=' || (tool->>'$'), ',' ORDER BY r.k) FROM r WHERE r.event_id = s.event_id), '') END AS calls FROM s""")
def window_validation(spark, sf_dir):
    """The first broken rule of each window: every shape of a call, and a window for each rule."""
    told = F.array_join(F.transform("calls", lambda c: F.concat(c["action_id"], F.lit("="), c["tool"])), ",")
    return _windows(spark, sf_dir).select("event_id", "unit_id", "window_complete", "status", "fault_at", told.alias("calls"))


@query(f"""WITH {_CHECKED}, keys AS (SELECT event_id, k, unnest(json_keys(args)) AS key, unnest(range(len(json_keys(args)))) AS place, args FROM r WHERE fault IS NULL),
told AS (SELECT event_id, k, string_agg('"' || key || '":' || json_extract(args, '$.' || key)::VARCHAR, ',' ORDER BY coalesce(list_position({list(windows.TARGET_KEYS)}, key), 99), place) AS t FROM keys GROUP BY event_id, k)
SELECT s.event_id, '[ACTION] {{"function":' || r.tool::VARCHAR || ',"args":{{' || coalesce(t, '') || '}}}}' AS model_text, r.k::INT AS call, nullif(status, 'valid') AS error FROM s LEFT JOIN r ON status = 'valid' AND r.event_id = s.event_id LEFT JOIN told ON told.event_id = r.event_id AND told.k = r.k""")
def action_serialization(spark, sf_dir):
    """What a model sees of each call of valid windows, and why others have none."""
    d = windows.with_model_texts(_windows(spark, sf_dir)).select("event_id", F.nullif("status", F.lit("valid")).alias("error"), F.posexplode_outer("actions").alias("at", "a"))
    return d.select("event_id", F.col("a.model_text").alias("model_text"), (F.col("at") + 1).alias("call"), "error")


_EVALUATED = f"""{_LINES}, x AS (SELECT b.*, 'q' || b.intent_id AS q, CASE WHEN b.unit_id % 13 = 0 THEN 'other' || b.intent_id ELSE 'q' || b.intent_id END AS pq, b.unit_id % 11 <> 0 AS there, b.unit_id % 11 <> 0 AND b.unit_id % 50 <> 0 AS valid FROM base b),
o AS (SELECT *, there AND action_id <> '5' AS said, CASE WHEN valid AND action_id <> '5' AND pq = q THEN CASE WHEN action_id::INT % 3 = 0 THEN 'no' ELSE operation_match END ELSE 'missing' END AS observed FROM x),
cases AS (SELECT o.unit_id, CASE WHEN NOT any_value(there) THEN 'missing_window' WHEN o.unit_id % 50 = 0 THEN 'technical_failure' ELSE 'completed' END AS status,
  any_value(valid) AND o.unit_id % 13 <> 0 AS extraction_exact, any_value(valid) AND CASE WHEN o.unit_id % 7 = 0 THEN 'uncertain' ELSE any_value(step_label) END = any_value(step_label) AS step_correct,
  count(*) AS reference_pairs, count(*) FILTER (observed = operation_match) AS correct_pairs, count(*) FILTER (observed = 'missing') AS missing_pairs, count(*) FILTER (said AND pq <> q) AS extra_pairs
  FROM o JOIN step USING (unit_id) GROUP BY o.unit_id)"""


def _evaluation(spark, sf_dir):
    """References and predictions as nested units: failures, other quotes, missing and wrong pairs."""
    _, base, _ = I.line_actions(spark, sf_dir)
    scope = F.when(F.col("intent_id") == "2", "future").otherwise("current")
    by = base.groupBy("unit_id").agg(
        F.array_sort(F.collect_set(F.struct("intent_id", F.concat(F.lit("q"), "intent_id").alias("intent_quote"), scope.alias("temporal_scope")))).alias("intents"),
        F.array_sort(F.collect_list(F.struct("intent_id", "action_id", "operation_match"))).alias("pairs"),
    )
    refs = by.join(_labelled(spark, sf_dir).select("unit_id", "step_label"), "unit_id")
    unit = F.col("unit_id")
    other = F.transform("intents", lambda i: F.struct(i["intent_id"].alias("intent_id"), F.concat(F.lit("other"), i["intent_id"]).alias("intent_quote"), i["temporal_scope"].alias("temporal_scope")))
    said = F.transform(F.filter("pairs", lambda p: p["action_id"] != "5"), lambda p: F.struct(p["intent_id"].alias("intent_id"), p["action_id"].alias("action_id"), F.when(p["action_id"].cast("int") % 3 == 0, "no").otherwise(p["operation_match"]).alias("operation_match")))
    preds = refs.where(unit % 11 != 0).select("unit_id", F.when(unit % 7 == 0, "uncertain").otherwise(F.col("step_label")).alias("step_label"), F.when(unit % 50 == 0, "technical_failure").otherwise("completed").alias("status"), F.when(unit % 13 == 0, other).otherwise(F.col("intents")).alias("intents"), said.alias("pairs"))
    return alignment.evaluation_cases(refs, preds)


@query(f"WITH {_EVALUATED} SELECT * FROM cases")
def evaluation_cases(spark, sf_dir):
    return _evaluation(spark, sf_dir).drop("expected_step", "observed_step")


@query(f"""WITH {_EVALUATED} SELECT count(*)::BIGINT AS windows, count(*) FILTER (status <> 'missing_window')::BIGINT AS predicted_windows, count(*) FILTER (extraction_exact)::BIGINT AS extraction_exact_windows, count(*) FILTER (extraction_exact) / count(*) AS extraction_exact_rate,
  count(*) FILTER (step_correct)::BIGINT AS step_correct_windows, count(*) FILTER (step_correct) / count(*) AS step_agreement, sum(reference_pairs)::BIGINT AS reference_pairs, sum(correct_pairs)::BIGINT AS correct_reference_pairs, sum(correct_pairs)::BIGINT / sum(reference_pairs)::BIGINT AS pair_agreement,
  sum(missing_pairs)::BIGINT AS missing_pairs, sum(extra_pairs)::BIGINT AS extra_pairs FROM cases""")
def evaluation_summary(spark, sf_dir):
    return alignment.evaluation_summary(_evaluation(spark, sf_dir))


# --- audit ------------------------------------------------------------------------------------------------------------


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS line FROM documents),
m AS (SELECT doc_id, regexp_extract(line, '{audit.INLINE}', 1) AS name, trim(trim(regexp_extract(line, '{audit.INLINE}', 2)), '"''') AS value FROM l)
SELECT doc_id, name, value FROM m WHERE regexp_matches(name, '(?i)api[_-]?key|secret|token|password') AND value <> '' AND NOT contains(value, 'example.invalid') AND value NOT IN ('<secret>', '<api-key>')""")
def secret_lines(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    found = audit.secret_lines(d, anchored=False)
    value = F.btrim(T.strip(F.regexp_extract("line", audit.INLINE, 2)), F.lit("\"'"))
    return found.select(F.col("path").alias("doc_id"), F.regexp_extract("line", audit.INLINE, 1).alias("name"), value.alias("value"))


@query("""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/.env' WHEN 1 THEN 'a/.env.example' WHEN 2 THEN 'logs/' ELSE 'src/' END || split_part(url, '//', 2) AS path FROM pages)
SELECT page_id, path FROM p WHERE list_has_any(string_split(path, '/'), ['.codex', '.sii', '__pycache__', 'checkpoints', 'models', 'logs']) OR string_split(path, '/')[-1] = '.env' OR (starts_with(string_split(path, '/')[-1], '.env.') AND string_split(path, '/')[-1] <> '.env.example')""")
def forbidden_paths(spark, sf_dir):
    k = F.col("page_id") % 5
    path = F.concat(F.when(k == 0, "a/.env").when(k == 1, "a/.env.example").when(k == 2, "logs/").otherwise("src/"), F.split_part("url", F.lit("//"), F.lit(2)))
    return I.table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(audit.is_forbidden_path(F.col("path")))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) > 10000")
def size_audit(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes")).where("bytes > 10000")


@query("""WITH l AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no, CASE WHEN event_type = 'click' THEN ' ```' ELSE event_type || event_id END AS line FROM events),
n AS (SELECT *, count(*) FILTER (starts_with(trim(line), '```')) OVER (PARTITION BY path ORDER BY line_no) AS k FROM l)
SELECT path, line_no::BIGINT AS line_no, line FROM n WHERE k % 2 = 0 AND NOT starts_with(trim(line), '```')""")
def fence_strip(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    line = F.when(F.col("event_type") == "click", " ```").otherwise(F.concat("event_type", F.col("event_id").cast("string")))
    e = I.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), (F.row_number().over(w) - 1).cast("long").alias("line_no"), line.alias("line"))
    return audit.unfenced(e)


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def content_manifest(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return audit.manifest(d).withColumnRenamed("path", "doc_id")


@query("""WITH f AS (SELECT p_partkey AS p, p_partkey % 9 AS k, p_partkey::VARCHAR AS n FROM part)
SELECT code, path, detail FROM (
  SELECT 'forbidden_path' AS code, n || '/.env' AS path, 'path must not be tracked' AS detail FROM f WHERE k = 0
  UNION ALL SELECT 'possible_secret', n || '.py', 'non-empty credential-like assignment' FROM f WHERE k = 3
  UNION ALL SELECT 'possible_secret', n || '.yml', 'non-empty credential-like assignment' FROM f WHERE k = 5
  UNION ALL SELECT 'possible_secret', n || '.md', 'non-empty credential-like assignment' FROM f WHERE k = 8
  UNION ALL SELECT 'machine_absolute_path', n || '.txt', 'contains /data/home/' FROM f WHERE k = 6
  UNION ALL SELECT 'file_too_large', n || '.txt', (24 + length(n)) || ' bytes exceeds 24' FROM f WHERE k = 6
  UNION ALL SELECT 'file_too_large', n || '.md', '28 bytes exceeds 24' FROM f WHERE k = 1
  UNION ALL SELECT 'file_too_large', n || '.py', '29 bytes exceeds 24' FROM f WHERE k = 4)""")
def file_audit(spark, sf_dir):
    """Files made of parts: a fenced and an open secret in Markdown, a literal and a lookup in Python, a placeholder, a path, bytes that are no text."""
    p = I.table(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 9, F.col("p_partkey").cast("string")
    bodies = (
        ("/.env", F.lit("A=1")), (".md", F.lit("```\ntoken=abcdefghijklm\n```\n")), (".txt", F.lit("token: <secret>")), (".py", F.lit("API_KEY = 'abc'\n")), (".py", F.lit("TOKEN = os.environ['TOKEN_1']")),
        (".yml", F.lit("  db_password: hunter2\n")), (".txt", F.concat(F.lit("in /data/home/someone/ at "), n).substr(F.lit(1), F.length(n) + 24)), (".bin", F.lit(None).cast("string")), (".md", F.lit("secret=x\n")),
    )
    pick = lambda j: F.element_at(F.array(*(F.lit(b[j]) if isinstance(b[j], str) else b[j] for b in bodies)), (k + 1).cast("int"))
    content = F.when(k == 7, F.unhex(F.lit("746F6B656E3DFFFE"))).otherwise(F.encode(pick(1), "UTF-8"))
    files = p.select(F.concat(n, pick(0)).alias("path"), content.alias("content")).withColumn("bytes", F.octet_length("content").cast("long"))
    return audit.audit(files, "/data/home/", max_bytes=24)


@query("SELECT count(*)::BIGINT AS file_count, sum(strlen(text))::BIGINT AS total_bytes FROM documents WHERE text IS NOT NULL")
def manifest_totals(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return audit.manifest(d).agg(F.count("*").alias("file_count"), F.sum("bytes").alias("total_bytes"))


# --- curation ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {_STEPS}, a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN command WHEN 1 THEN command || chr(10) || 'x' WHEN 2 THEN command || repeat(' long', 120) ELSE 'cat <<EOF' END AS action FROM ev),
r AS (SELECT event_id, concat_ws(',', CASE WHEN regexp_matches(action, '(^|\\n)edit\\b') THEN 'edit' END, CASE WHEN contains(action, '<<EOF') THEN 'heredoc' END, CASE WHEN contains(action, chr(10)) THEN 'multiline' END, CASE WHEN ceil(length(action) / 4.0) > 64 THEN 'payload' END, CASE WHEN ceil(length(action) / 4.0) > 128 THEN 'total' END) AS reasons FROM a)
SELECT reasons, count(*)::BIGINT AS n FROM r GROUP BY reasons""".replace("\\\\", "\\"))
def short_action_filter(spark, sf_dir):
    k = F.col("event_id") % 4
    action = F.when(k == 0, F.col("command")).when(k == 1, F.concat("command", F.lit("\nx"))).when(k == 2, F.concat("command", F.lit(" long" * 120))).otherwise("cat <<EOF")
    s = I.event_steps(spark, sf_dir).select(action.alias("action"))
    reasons = F.array_join(curation.short_action_reasons(F.col("action"), F.col("action")), ",")
    return s.groupBy(reasons.alias("reasons")).agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim('Fix  ' || p_name || ' in /src/a' || p_size || ' for "' || p_brand || '"')), '\s+', ' ', 'g'), '"[^"]*"|''[^'']*''', '<quote>', 'g').regexp_replace('(?:/[a-z0-9_.-]+){2,}', '<path>', 'g').regexp_replace('[0-9]+', '<n>', 'g') AS template FROM part""")
def template_key(spark, sf_dir):
    text = F.concat(F.lit("Fix  "), "p_name", F.lit(" in /src/a"), F.col("p_size").cast("string"), F.lit(' for "'), "p_brand", F.lit('"'))
    return I.table(spark, sf_dir, "part").select("p_partkey", T.template_key(text).alias("template"))


@query(f"""WITH {_STEPS} SELECT user_id, event_id, command AS action, lag(command) OVER w AS previous_action, lead(command) OVER w AS next_action FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def annotation_queue(spark, sf_dir):
    s = I.event_steps(spark, sf_dir).select("user_id", "event_id", F.col("command").alias("action"))
    return curation.annotation_queue(s, "user_id", "event_id")


def _groups(spark, sf_dir):
    o = I.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("trajectory_id"), F.concat(F.lit("t"), (F.col("o_orderkey") % 40000).cast("string")).alias("template"))
    return rows.join(curation.leak_groups(rows), "trajectory_id")


@query()
def grouped_split(spark, sf_dir):
    return curation.grouped_split(_groups(spark, sf_dir))


@query()
def hard_negative_candidates(spark, sf_dir):
    lines = I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    items = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"), F.when(F.col("l_orderkey") % 10 < 7, "train").otherwise("test").alias("split"), F.col("l_orderkey").alias("trajectory_id"), (F.col("s") % 23).alias("tool"), F.col("p").alias("target"))
    return curation.hard_negatives(items)


@query(f"WITH {_STEPS} SELECT event_id, CASE event_type WHEN 'view' THEN '[ACTION] open(path=\"src/main.py\")' WHEN 'click' THEN '[ACTION] edit(args=\"3:4\")' WHEN 'error' THEN '[ACTION] pytest(args=\"tests\")' WHEN 'signup' THEN '[ACTION] python(command=\"run.py\")' WHEN 'purchase' THEN '[ACTION] submit(args=\"\")' END AS told FROM ev")
def canonical_actions(spark, sf_dir):
    return I.event_steps(spark, sf_dir).select("event_id", curation.canonical_action(F.col("command")).alias("told"))


def _curated(spark, sf_dir):
    """Steps of orders: intents by priority, actions by status."""
    o = I.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.when(k % 2 == 0, "swe").otherwise("chat").alias("source"), F.col("o_custkey").alias("trajectory_id"), F.when(k % 10 == 0, "error").otherwise("success").alias("status"),
        F.array_repeat(F.lit("i"), (k % 3).cast("int")).alias("intents"), F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).when(F.col("o_orderstatus") == "F", F.array(F.lit("edit 3:4"))).otherwise(F.array(F.lit("open a"))).alias("actions"),
    )


@query("""WITH k AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'swe' ELSE 'chat' END AS source, o_custkey, CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 3 = 1 THEN CASE o_orderstatus WHEN 'P' THEN 'unfulfilled' WHEN 'F' THEN 'long' ELSE 'candidate' END ELSE 'other' END AS kind FROM orders)
SELECT source, count(DISTINCT o_custkey)::BIGINT AS trajectories, count(*)::BIGINT AS steps, count(*) FILTER (kind = 'candidate')::BIGINT AS candidate, count(*) FILTER (kind = 'long')::BIGINT AS long, count(*) FILTER (kind = 'unfulfilled')::BIGINT AS unfulfilled, count(*) FILTER (kind = 'other')::BIGINT AS other, true AS consistent FROM k GROUP BY source""")
def candidate_audit(spark, sf_dir):
    return curation.candidate_audit(_curated(spark, sf_dir))


@query("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'swe' ELSE 'chat' END || ':' || o_custkey || ':T' || o_orderkey || '-I1' AS item_id, CASE o_orderstatus WHEN 'P' THEN 'unfulfilled' ELSE 'candidate' END AS queue
FROM orders WHERE o_orderkey % 3 = 1 AND (o_orderstatus = 'P' OR o_orderkey % 10 <> 0)""")
def review_queues(spark, sf_dir):
    s = _curated(spark, sf_dir)
    name = curation.stable_id(F.col("source"), F.col("trajectory_id").cast("string"), F.col("o_orderkey"), F.lit(1)).alias("item_id")
    return curation.one_to_one(s).select(name, F.lit("candidate").alias("queue")).unionByName(curation.unfulfilled(s).select(name, F.lit("unfulfilled").alias("queue")))


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey % 5 = 0")
def reviewed_positives(spark, sf_dir):
    queue = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"))
    label = F.element_at(F.array(*map(F.lit, curation.REVIEW_LABELS)), (F.col("item_id") % 5 + 1).cast("int"))
    return curation.import_review(queue, queue.withColumn("label", label))


_VERDICTS = (("safe_negative", "0.95", "[]", "valid"), ("safe_negative", "0.5", "[]", "valid"), ("semantic_match", "1", "[]", "valid"), ("safe_negative", "0.99", '["risk"]', "valid"), ("other", "0.95", "[]", "invalid_label"), ("safe_negative", "1.5", "[]", "invalid_confidence"), ("safe_negative", '"high"', "[]", "invalid_schema"))


@query(f"""SELECT o_orderkey, [{", ".join(repr(v[3]) for v in _VERDICTS)}][o_orderkey % {len(_VERDICTS)} + 1] AS status, o_orderkey % {len(_VERDICTS)} = 0 AND o_custkey % 2 = 0 AS accepted FROM orders""")
def judged_negatives(spark, sf_dir):
    """Verdicts, and those of them that every gate accepts; negatives of odd customers are known positives."""
    o = I.table(spark, sf_dir, "orders")
    raw = F.element_at(F.array(*(F.lit(f'{{"label": "{a}", "negative_type": "t", "confidence": {b}, "reason": "r", "risk_flags": {c}}}') for a, b, c, _ in _VERDICTS)), (F.col("o_orderkey") % len(_VERDICTS) + 1).cast("int"))
    d = o.select("o_orderkey", "o_custkey", raw.alias("raw"), curation.verdict_status(raw).alias("status"))
    v = F.from_json("raw", "label string, confidence double, risk_flags array<string>")
    judged = d.where("status = 'valid'").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("negative_id"), v.alias("v")).select("item_id", "negative_id", F.col("v.label").alias("verdict"), "v.confidence", F.col("v.risk_flags").alias("flags"))
    positives = o.where("o_custkey % 2 = 1").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("action_item"))
    good = curation.accepted(judged, positives).select(F.col("item_id").alias("o_orderkey"), F.lit(True).alias("accepted"))
    return d.join(good, "o_orderkey", "left").select("o_orderkey", "status", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query("SELECT sha256('c' || o_orderkey || chr(10) || 'p' || chr(10) || 'm' || chr(10) || 's') AS key, o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def unjudged_candidates(spark, sf_dir):
    """Candidates without a successful judgement under the same prompt, model and settings."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("c"), k.cast("string"))
    o = I.table(spark, sf_dir, "orders").select(curation.judgement_key(name, "p", "m", "s").alias("key"), "o_orderkey", name.alias("name"))
    done = o.where(k % 3 == 0).select("key", F.when(k % 2 == 0, "error").otherwise("success").alias("status"))
    old = o.select(curation.judgement_key(F.col("name"), "p", "older", "s").alias("key"), F.lit("success").alias("status"))
    return curation.unjudged(o, done.unionByName(old)).select("key", "o_orderkey")


@query("""WITH t AS (SELECT o_custkey AS trajectory_id, 'c' || o_custkey // 8 || CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS template FROM orders),
g AS (SELECT o_custkey // 8 AS b, o_custkey AS t, bool_or(o_orderkey % 2 = 0) AS has_a, bool_or(o_orderkey % 2 = 1) AS has_b FROM orders GROUP BY ALL),
m AS (SELECT b, bool_or(has_a AND has_b) AS whole, min(t) AS least, min(t) FILTER (has_a) AS least_a, min(t) FILTER (has_b) AS least_b FROM g GROUP BY b)
SELECT t AS trajectory_id, CASE WHEN whole THEN least WHEN has_a THEN least_a ELSE least_b END AS group_id FROM g JOIN m USING (b)""")
def leak_groups(spark, sf_dir):
    """Customers in blocks of eight, each with two templates that some customer may join."""
    o = I.table(spark, sf_dir, "orders")
    c = F.col("o_custkey")
    template = F.concat(F.lit("c"), F.floor(c / 8).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b"))
    return curation.leak_groups(o.select(c.alias("trajectory_id"), template.alias("template")))
