"""Queries over evaluations and the relational store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import store
from .registry import query
from .relations import EVALUATED, TURNS, table, turns


@query(f"WITH {EVALUATED} SELECT session, node, id, attempt, second, intervention, status FROM evaluated")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, second strikes, interventions and statuses of every turn."""
    return E.attempts(turns(spark, sf_dir)).select("session", "node", "id", "attempt", "second", "intervention", "status")


@query(f"""WITH {EVALUATED} SELECT session, node, count(*) AS attempts, count(*) FILTER (intervention <> 'advance') AS failed_attempts, arg_max(status, id) AS status, string_agg(intervention, ',' ORDER BY ts, id) AS history FROM evaluated GROUP BY session, node""")
def concept_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each session's nodes after all turns."""
    return E.concept_state(E.attempts(turns(spark, sf_dir)))


def _avg(name: str, dim: str) -> str:
    points = " ".join(f"WHEN '{v}' THEN {p}" for v, p in E.RUBRIC[dim].items())
    mean = f"avg(CASE {name} {points} END)"
    return f"round({mean}, 6) AS {dim}_avg, CASE WHEN {mean} >= 1.5 THEN 'good' WHEN {mean} >= 0.75 THEN 'partial' WHEN {mean} IS NOT NULL THEN 'weak' END AS {dim}"


@query(f"""WITH {TURNS}, m AS (SELECT session, CASE WHEN event_type <> 'view' THEN c END AS c, CASE WHEN event_type <> 'view' THEN k END AS k, CASE WHEN event_type <> 'view' THEN e END AS e, CASE WHEN event_type = 'view' THEN value > 10 END AS correct FROM turns)
SELECT session, {_avg('c', 'completezza')}, {_avg('k', 'correttezza')}, {_avg('e', 'elaborazione')}, count(*) FILTER (correct) AS closed_correct, count(correct) AS closed_total FROM m GROUP BY session""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages and labels of each session."""
    rows = turns(spark, sf_dir)
    view = F.col("event_type") == "view"
    return E.session_summary(rows.select("session", *[F.when(~view, F.col(c)).alias(c) for c in "cke"], F.when(view, F.col("value") > 10).alias("correct")))


def _message_sql() -> str:
    said = " ".join(f"WHEN intervention = '{k}' AND lang = '{lang}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for lang, m in E.MESSAGES.items() for k, t in m.items())
    return f"CASE {said} END"


@query(f"""WITH {EVALUATED}, l AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'it' ELSE 'en' END AS lang, 'p.' || node AS place, repeat('excerpt ', 60) AS excerpt FROM evaluated)
SELECT id, {_message_sql()} || CASE WHEN intervention IN ('advance', 'modality_switch') THEN '' WHEN lang = 'it' THEN ' Dai un''occhiata a ' || place || '.' ELSE ' Have a look at ' || place || '.' END AS message,
  CASE WHEN intervention = 'full_redirect' THEN substr(excerpt, 1, 400) WHEN intervention NOT IN ('advance', 'modality_switch') THEN substr(excerpt, 1, 160) END AS excerpt, 'completezza=' || c || '; correttezza=' || k || '; elaborazione=' || e AS judgment FROM l""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without a model, redirects and judgments in words."""
    rows = E.attempts(turns(spark, sf_dir))
    language = F.when(F.col("id") % 2 == 0, "it").otherwise("en")
    i = F.col("intervention")
    return rows.select("id", E.fallback_message(i, language, F.concat(F.lit("p."), "node")).alias("message"), E.redirect(i, F.expr("repeat('excerpt ', 60)")).alias("excerpt"), E.open_summary(F.col("c"), F.col("k"), F.col("e")).alias("judgment"))


@query(f"""WITH {EVALUATED} SELECT 'sess_' || session AS session_id, id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CASE WHEN event_type = 'click' THEN 'audio' ELSE 'text' END AS modality, attempt, intervention, status FROM evaluated WHERE c IN ('alta', 'parziale', 'assente')""")
def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace log, one row for each turn with a valid judgment."""
    rows = E.attempts(turns(spark, sf_dir)).where(E.valid_open(F.col("c"), F.col("k"), F.col("e")))
    return rows.select(F.concat(F.lit("sess_"), "session").alias("session_id"), "id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.when(F.col("event_type") == "click", "audio").otherwise("text").alias("modality"), "attempt", "intervention", "status")


@query("SELECT user_id AS material_id, event_type AS artifact_type, arg_max(event_id, (ts, event_id)) AS id, arg_max(props, (ts, event_id)) AS content FROM events GROUP BY user_id, event_type")
def latest_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest artifact of each material and type."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("material_id"), F.col("event_type").alias("artifact_type"), F.col("event_id").alias("id"), F.col("props").alias("content"), "ts")
    return store.latest(rows, ["material_id", "artifact_type"], "ts", "id").drop("ts")


@query("SELECT c_custkey AS material_id, c_name AS name, n_nationkey AS subject_id, n_name AS subject, r_name AS group_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
def group_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materials of one group, through their subjects."""
    m = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("material_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("subject_id"))
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject_id"), F.col("n_name").alias("subject"), F.col("n_regionkey").alias("group_id"))
    g = table(spark, sf_dir, "region").where("r_regionkey = 2").select(F.col("r_regionkey").alias("group_id"), F.col("r_name").alias("group_name"))
    return m.join(s, "subject_id").join(g, "group_id").select("material_id", "name", "subject_id", "subject", "group_name")


@query("SELECT n_name AS group_name, c_custkey AS user_id, count(*) AS shared FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_custkey")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups through a link table."""
    link = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("shared"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("group_name"))
    return link.join(users, "o_custkey").join(groups, "c_nationkey").select("group_name", F.col("o_custkey").alias("user_id"), "shared")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE NOT (c_custkey % 10 = 0 AND c_nationkey = 3)""")
def patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields patched where given, rows deleted by id and owner."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    key = F.col("c_custkey")
    patch = rows.where(key % 3 == 0).select("c_custkey", F.concat(F.lit("renamed "), "c_custkey").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    gone = rows.where(key % 10 == 0).select("c_custkey", F.lit(3).alias("c_nationkey"))
    return store.deleted(store.patched(rows, patch, "c_custkey"), gone, ["c_custkey", "c_nationkey"]).drop("c_nationkey")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 20 OFFSET 10")
def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page in total order; the limit is the feature (O2, O3)."""
    return store.page(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 10, 20)


@query("SELECT p_partkey, 'uploads/group_' || p_size || '/subject_' || (p_partkey % 5) || '/' || replace(p_name, ' ', '_') AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where uploads are kept, for those not present yet."""
    present = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("p_partkey"))
    rows = store.absent(table(spark, sf_dir, "part"), present, ["p_partkey"])
    return rows.select("p_partkey", store.upload_path(F.col("p_size"), F.col("p_partkey") % 5, F.col("p_name")).alias("path"))


_MIXED = f"""{TURNS}, mixed AS (SELECT *, CASE event_type WHEN 'view' THEN 'flashcard' WHEN 'click' THEN 'mcq' WHEN 'signup' THEN 'essay' ELSE 'open' END AS kind,
  CASE WHEN event_type = 'view' THEN ['El Niño!', 'el  nino', 'la niña', ''][id % 4 + 1] WHEN id % 6 < 4 THEN chr((65 + id % 6)::INT) WHEN id % 6 = 4 THEN '2' ELSE ' ÉTÉ ' END AS response FROM turns
), judged AS (SELECT *, CASE WHEN kind = 'essay' THEN 'unknown assessment type' WHEN kind = 'open' AND id % 11 = 0 THEN 'no valid judgment' END AS error, CASE WHEN kind = 'open' THEN c = 'alta' AND k = 'corretta' AND e = 'rielaborata'
  WHEN kind = 'mcq' THEN coalesce(CASE WHEN regexp_matches(response, '^[A-D]$') THEN ascii(response) - 65 WHEN response = '2' THEN 1 ELSE list_position(['hiver', 'ete', 'automne', 'printemps'], strip_accents(lower(trim(response)))) - 1 END = session % 4, false)
  WHEN strip_accents(lower(trim(regexp_replace(regexp_replace(response, '[^\\p{{L}} ]', '', 'g'), ' +', ' ', 'g')))) = 'el nino' THEN true ELSE id % 5 >= 3 END AS good FROM mixed
), counted AS (SELECT *, coalesce(sum(CASE WHEN error IS NULL AND NOT good THEN 1 ELSE 0 END) OVER (PARTITION BY session, node ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS failed FROM judged
), routed AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN good THEN 'advance' WHEN failed >= 1 THEN 'full_redirect' WHEN kind <> 'open' THEN 'hint_plus_redirect' WHEN k <> 'corretta' THEN 'redirect_only' WHEN c <> 'alta' THEN 'hint_plus_redirect' ELSE 'modality_switch' END AS intervention FROM counted
), ev AS (SELECT session, node, ts, id, kind, CASE WHEN kind IN ('mcq', 'flashcard') THEN good END AS correct, error, CASE WHEN error IS NULL THEN failed + 1 END AS attempt, intervention, CASE WHEN error IS NULL THEN CASE intervention WHEN 'advance' THEN 'passed' WHEN 'full_redirect' THEN 'fragile' ELSE 'pending' END END AS status FROM routed)"""


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of all item types, with what is needed to judge them."""
    n, kind = F.col("id"), F.col("kind")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    rows = turns(spark, sf_dir).withColumn("kind", F.when(F.col("event_type") == "view", "flashcard").when(F.col("event_type") == "click", "mcq").when(F.col("event_type") == "signup", "essay").otherwise("open"))
    card, option = pick(["El Niño!", "el  nino", "la niña", ""], n % 4 + 1), pick(["A", "B", "C", "D", "2", " ÉTÉ "], n % 6 + 1)
    given = [F.when((kind == "open") & (n % 11 == 0), None).otherwise(F.col(x)).alias(x) for x in "cke"]
    options = F.array(*map(F.lit, ["Hiver", "Été", "Automne", "Printemps"]))
    return rows.select("session", "node", "ts", "id", "kind", F.when(kind == "flashcard", card).otherwise(option).alias("response"), options.alias("options"), (F.col("session") % 4).alias("correct"), F.lit("el niño").alias("expected"), ((n % 5) / 5).alias("fuzzy"), *given)


@query(f"WITH {_MIXED} SELECT * FROM ev")
def evaluated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed items, flashcards and open questions judged, routed and counted in one plan."""
    return E.evaluated(_mixed(spark, sf_dir))


@query(f"WITH {_MIXED} SELECT session, node, count(*) AS attempts, count(*) FILTER (intervention <> 'advance') AS failed_attempts, arg_max(status, (ts, id)) AS status, string_agg(intervention, ',' ORDER BY ts, id) AS history FROM ev WHERE error IS NULL GROUP BY session, node")
def evaluated_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's nodes after all turns of all item types."""
    return E.concept_state(E.evaluated(_mixed(spark, sf_dir)).where("error is null"))


@query("SELECT user_id AS material_id, event_type AS artifact_type, event_id AS id FROM events WHERE event_type IN ('click', 'purchase')")
def artifacts_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of the types asked for; an unknown type has none."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("material_id"), F.col("event_type").alias("artifact_type"), F.col("event_id").alias("id"))
    return store.of_types(rows, ["click", "purchase", "no such type"])


@query("SELECT o_custkey AS subject_id, o_orderkey AS material_id, o_orderdate AS uploaded_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def newest_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's materials, the newest first (O1, R2)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("material_id"), F.col("o_orderdate").alias("uploaded_at"))
    return store.newest_first(rows, "subject_id", "uploaded_at", "material_id")


#: What a model answers, by the turn's number; @ is where to look.
ANSWERS = ["Well done. Look at @!", "Your score is 7. See @.", "No pointer here.", " ", "One. Two. Three. See @.", "Rivedi @: il tuo voto non conta.", "You got 3 out of 5, see @.", "Altalena? Guarda @."]


@query(f"""WITH {EVALUATED}, a AS (SELECT id, node, CASE WHEN id % 9 <> 8 THEN replace([{', '.join("'" + a + "'" for a in ANSWERS)}][id % 9 + 1], '@', 'p.' || node) END AS raw, CASE WHEN id % 4 <> 0 THEN 'p.' || node END AS pointer FROM evaluated
), b AS (SELECT *, trim(coalesce(raw, '')) AS said FROM a), f AS (SELECT *, concat_ws(',', CASE WHEN regexp_matches(lower(said), '\\b({'|'.join(E.BARRED)})\\b|\\d+ (out of|su) \\d+|\\d+ ?%') THEN 'barred' END, CASE WHEN len(regexp_extract_all(said, '[^.!? ]+[.!?]+( |$)')) > 3 THEN 'long' END, CASE WHEN said = '' THEN 'empty' END, CASE WHEN NOT contains(said, pointer) THEN 'unpointed' END) AS faults FROM b)
SELECT id, faults, CASE WHEN faults = '' THEN said ELSE 'fallback' END AS message FROM f""")
def checked_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a model held to what they may say, else replaced."""
    rows = turns(spark, sf_dir).select("id", "node")
    pointer = F.when(F.col("id") % 4 != 0, F.concat(F.lit("p."), "node"))
    raw = F.replace(F.try_element_at(F.array(*map(F.lit, ANSWERS)), (F.col("id") % 9 + 1).cast("int")), F.lit("@"), F.concat(F.lit("p."), "node"))
    faults = E.message_faults(F.trim(F.coalesce(raw, F.lit(""))), pointer)
    return rows.select("id", F.array_join(faults, ",").alias("faults"), E.chosen_message(raw, F.lit("fallback"), pointer).alias("message"))
