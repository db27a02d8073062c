"""Queries over text functions, speech features and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import quiz as Q
from ..operators import speech as S
from .registry import query
from .relations import STRIP, table

_STOP = ", ".join("'" + w + "'" for w in [*T.STOPWORDS_IT, *T.STOPWORDS_EN])
_NORM = lambda c: f"trim(regexp_replace(regexp_replace(strip_accents(lower({STRIP(c)})), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})))"
_CUT = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE substr({c}, 1, {n - 1}) || '…' END"


@query(f"""WITH s AS (SELECT doc_id, text, {STRIP("replace(text, chr(10), ' ')")} AS flat, {STRIP("regexp_replace(" + STRIP('text') + ", '\\s+', ' ', 'g')")} AS one FROM documents)
SELECT doc_id, {_CUT('text', 600)} AS cut, {_CUT('flat', 80)} AS peek, {_CUT('flat', 240)} AS excerpt, CASE WHEN doc_id % 3 = 0 THEN 'Node ' || doc_id WHEN one <> '' THEN {_CUT('one', 60)} ELSE 'Section' END AS title,
  CASE WHEN {STRIP('text')} = '' THEN 'Section' ELSE array_to_string(regexp_split_to_array({STRIP('text')}, '\\s+')[1:6], ' ') END AS fallback_label FROM s""")
def text_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncation, peeks, excerpts and titles."""
    c = F.col("text")
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Node "), "doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_ellipsis(c, 600).alias("cut"), T.peek(c, 80).alias("peek"), T.excerpt(c).alias("excerpt"), T.node_title(label, c, F.lit("section")).alias("title"), T.fallback_label(c, F.lit("section")).alias("fallback_label"))


@query(f"SELECT doc_id, {_NORM('text')} AS normal, regexp_replace(lower({STRIP('text')}), '[^\\p{{L}}\\p{{N}}_\\s]+', '', 'g') AS token, array_to_string(list_sort({_WORDS('text')}), ' ') AS content FROM documents")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms and content words."""
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(c).alias("normal"), T.normalize_token(c).alias("token"), F.array_join(F.array_sort(T.content_words(c)), " ").alias("content"))


@query(f"""WITH s AS (SELECT conv_id AS session, turn AS seg, text, {_WORDS('text')} AS w FROM conversations), p AS (SELECT *, lag(w) OVER (PARTITION BY session ORDER BY seg) AS b FROM s
), o AS (SELECT session, CASE WHEN least(len(w), len(b)) > 0 THEN len(list_intersect(w, b)) / least(len(w), len(b)) END AS share FROM p)
SELECT session, count(*) FILTER (share > 0.45 AND share < 0.95) AS n, count(*) FILTER (share > 0.0 AND share < 0.95) AS n_any FROM o GROUP BY session""")
def reformulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns that say much the same."""
    segments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seg"), "text")
    strict = S.reformulations(segments)
    w = S.Window.partitionBy("session").orderBy("seg")
    rows = segments.withColumn("words", T.content_words(F.col("text"))).withColumn("before", F.lag("words").over(w))
    share = T.overlap_coefficient(F.col("before"), F.col("words"))
    return strict.join(rows.groupBy("session").agg(F.count_if((share > 0.0) & (share < 0.95)).alias("n_any")), "session")


_SAID = "CASE user_id % 4 WHEN 0 THEN 'um wait, no i mean it is like kind of done' WHEN 1 THEN 'Uh, basically sort of; scratch that' WHEN 2 THEN 'sorry, i mean you know, you know' ELSE event_type END"
_PATTERNS = [r"\bwait,?\s*no\b", r"\bactually,?\s*no\b", r"\bscratch\s+that\b", r"\blet\s+me\s+rephrase\b", r"\bno,?\s+sorry\b", r"\bsorry,?\s+i\s+mean\b", r"\bcorrection,?\s+\b"]


@query(f"""WITH t AS (SELECT event_id, lower({_SAID}) AS s FROM events), w AS (SELECT *, list_transform(string_split(s, ' '), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_\\s]+', '', 'g')) AS toks FROM t)
SELECT event_id, (len(list_filter(toks, lambda x: x IN ('like', 'basically', 'essentially'))) + {' + '.join(f"(length(s) - length(replace(s, '{h}', ''))) // {len(h)}" for h in S.HEDGES['en'] if ' ' in h)})::BIGINT AS hedges,
  ({' + '.join(f"len(regexp_extract_all(s, '{p}'))" for p in _PATTERNS)} + len(regexp_extract_all(s, '\\bi\\s+mean,?\\s+')))::BIGINT AS corrections FROM w""")
def hedges_and_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hedges and self-corrections (F9, F10); the texts have no dot after `i mean`, where SQL's patterns can't look ahead."""
    say = F.when(F.col("user_id") % 4 == 0, "um wait, no i mean it is like kind of done").when(F.col("user_id") % 4 == 1, "Uh, basically sort of; scratch that").when(F.col("user_id") % 4 == 2, "sorry, i mean you know, you know").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", say.alias("s"))
    tokens = F.transform(F.split("s", " "), T.normalize_token)
    return rows.select("event_id", S.hedges(F.col("s"), tokens, "en").alias("hedges"), S.corrections(F.col("s"), "en").alias("corrections"))


@query("""WITH l AS (SELECT o_orderkey, ['pdf', 'slide', 'md', 'time', 'other'][o_orderkey % 5 + 1] AS kind, (o_orderkey % 13)::DOUBLE AS lo, (o_orderkey % 13 + o_orderkey % 3 * 61)::DOUBLE AS hi, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END AS label FROM orders
), p AS (SELECT *, concat_ws(', ', '§' || label, CASE WHEN kind = 'pdf' AND lo > 0 AND hi > 0 THEN CASE WHEN lo = hi THEN 'p.' || lo::BIGINT ELSE 'p.' || lo::BIGINT || '-' || hi::BIGINT END
  WHEN kind = 'slide' AND lo > 0 AND hi > 0 THEN CASE WHEN lo = hi THEN 'slide ' || lo::BIGINT ELSE 'slides ' || lo::BIGINT || '-' || hi::BIGINT END WHEN kind = 'md' THEN 'char ' || lo::BIGINT || '-' || hi::BIGINT
  WHEN kind = 'time' THEN 'T ' || printf('%02d:%02d', lo::BIGINT // 60, lo::BIGINT % 60) || '-' || printf('%02d:%02d', hi::BIGINT // 60, hi::BIGINT % 60) END) AS s FROM l)
SELECT o_orderkey, CASE WHEN s = '' THEN '(unknown location)' ELSE s END AS summary, CASE WHEN s <> '' THEN s WHEN o_orderkey % 2 = 0 THEN 'the paragraph starting with "short excerpt"' ELSE 'the document' END AS shown FROM p""")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where passages stand, in words, with fallbacks."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ["pdf", "slide", "md", "time", "other"])), (k % 5 + 1).cast("int"))
    s = T.summarize_locator(kind, (k % 13).cast("double"), (k % 13 + k % 3 * 61).cast("double"), F.when(k % 4 == 0, F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("summary"), T.locator_fallback(s, F.when(k % 2 == 0, "short\nexcerpt"), F.lit(" ")).alias("shown"))


def _votes(words: list[str]) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


@query(f"""WITH s AS (SELECT doc_id, lang, string_split_regex(lower(substr(text, 1, 4096)), '[^\\p{{L}}]+') AS w FROM documents), v AS (SELECT doc_id, lang, {_votes(T.STOPWORDS_IT)} AS it, {_votes(T.STOPWORDS_EN)} AS en FROM s)
SELECT doc_id, CASE WHEN it > en THEN 'it' ELSE 'en' END AS detected, CASE WHEN lang = 'en' THEN 'en' END AS normal, coalesce(CASE WHEN lang = 'en' THEN 'en' END, CASE WHEN en > it THEN 'en' ELSE 'it' END) AS resolved FROM v""")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of a sample by stop words, of a code, and the one to use."""
    sample = F.substring("text", 1, 4096)
    code = T.normalize_language(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(sample, "en").alias("detected"), code.alias("normal"), F.coalesce(code, T.detect_language(sample, "it")).alias("resolved"))


_WORD_SQL = """words AS (SELECT user_id AS session, day(ts) AS seg, event_id AS ord, epoch(ts) AS s, epoch(ts) + value AS e, CASE WHEN event_type = 'click' THEN 'Um,' WHEN event_type = 'error' THEN 'like' ELSE event_type END AS word FROM events)"""


@query(f"""WITH {_WORD_SQL}, g AS (SELECT session, round(lead(s) OVER (PARTITION BY session ORDER BY seg, ord) - e, 3) AS gap FROM words), p AS (SELECT session, count(*) AS n, round(median(gap), 2) AS med FROM g WHERE gap > 0.8 GROUP BY session
), d AS (SELECT session, max(e) - min(s) AS duration, count(*) FILTER (word = 'Um,') AS fillers, count(*) FILTER (word = 'like') AS hedges FROM words GROUP BY session)
SELECT d.session, fillers AS filler_count, hedges AS hedge_count, round(fillers / (duration / 60), 1) AS filler_per_min, coalesce(n, 0) AS long_pause_count, coalesce(med, 0) AS long_pause_median_s,
  concat_ws('; ', CASE WHEN n > 0 THEN n || ' long thinking pause(s)' END, CASE WHEN hedges > 0 THEN hedges || ' informal hedge(s)' END, CASE WHEN fillers > 0 THEN fillers || ' filler(s)' END) AS evidence_summary FROM d LEFT JOIN p USING (session)""")
def speech_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each session's words (A8, A9, A10, W2, F27, R8); an event is a word that lasts `value` seconds."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    word = F.when(F.col("event_type") == "click", "Um,").when(F.col("event_type") == "error", "like").otherwise(F.col("event_type"))
    words = e.select(F.col("user_id").alias("session"), F.dayofmonth("ts").alias("seg"), F.col("event_id").alias("ord"), start.alias("start"), (start + F.col("value")).alias("end"), word.alias("word"))
    segments = words.groupBy("session", "seg").agg(F.lit("").alias("text"))
    sessions = words.groupBy("session").agg((F.max("end") - F.min("start")).alias("duration"))
    rows = S.features(segments, words, sessions, "en")
    return rows.select("session", "filler_count", "hedge_count", "filler_per_min", "long_pause_count", "long_pause_median_s", "evidence_summary")


_RAW = """CASE o_orderkey % 6 WHEN 0 THEN '```json' || chr(10) || '[{"question":"Q ' || o_orderkey || '","options":["a"," b ","c","d"],"correct_index":' || o_orderkey % 5 || '}, 7]' || chr(10) || '```'
  WHEN 1 THEN '[{"question":" ","options":["a","b","c","d"],"correct_index":1}]' WHEN 2 THEN '{"no":"array"}' WHEN 3 THEN '[{"question":"x","options":["a","b","c"],"correct_index":1},{"question":"y","options":["a","b","c","d"],"correct_index":0}]' WHEN 4 THEN '[]' ELSE 'quota exceeded' END"""


@query("""SELECT o_orderkey AS req_id, (CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_orderkey % 5 < 4 THEN 1 ELSE 0 END WHEN 3 THEN 1 ELSE 0 END)::BIGINT AS produced, CASE o_orderkey % 6 WHEN 0 THEN 'item isn''t an object' WHEN 2 THEN 'response isn''t an array' WHEN 5 THEN 'response isn''t an array' END AS warning,
  (CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_orderkey % 5 < 4 THEN 200 ELSE 503 END WHEN 3 THEN 200 WHEN 4 THEN 422 WHEN 1 THEN 422 ELSE 503 END)::INT AS status, least(o_orderkey % 40 + 1, 25)::BIGINT AS asked FROM orders""")
def quiz_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses parsed and validated defensively, with the request's outcome."""
    raw = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), F.lit("mcq").alias("item_type"), F.expr(_RAW.replace("chr(10)", "'\\n'")).alias("raw"))
    items, warnings = Q.parsed(raw)
    n = items.where(Q.valid(F.col("item_type"), F.col("item"))).groupBy("req_id").agg(F.count("*").alias("produced"))
    said = warnings.groupBy("req_id").agg(F.array_join(F.array_sort(F.collect_list("warning")), " | ").alias("warning"))
    rows = raw.select("req_id").join(n, "req_id", "left").join(said, "req_id", "left").fillna(0, ["produced"])
    return rows.select("req_id", "produced", "warning", Q.error_class(F.col("produced"), F.col("warning")).alias("status"), Q.requested(F.col("req_id") % 40 + 1).alias("asked"))


@query("""SELECT c_custkey, trim(c_name) <> '' AND c_custkey % 3 <> 0 AS card, c_custkey % 4 <> 0 AS openq, (CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END)::INT AS n_points,
  concat_ws(',', CASE WHEN c_custkey % 5 = 0 THEN 'answer_in_stem' END, CASE WHEN c_custkey % 2 = 1 THEN 'correct_is_longest' END, CASE WHEN c_custkey % 3 = 0 THEN 'catch_all' END) AS flags,
  CASE c_custkey % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'level_word' ELSE 'punctuation' END AS title_flags FROM customer""")
def item_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flashcards, open questions and what prompts ask for but nothing enforces."""
    k = F.col("c_custkey")
    points = F.when(k % 2 == 0, F.array(F.lit(" a "), F.lit(" "), F.lit("b")))
    item = F.struct(F.col("c_name").alias("front"), F.when(k % 3 != 0, "back").otherwise(" ").alias("back"), F.lit("Why?").alias("question"), F.when(k % 4 != 0, "so").alias("expected_answer"), points.alias("key_points"), F.array().cast("array<string>").alias("options"), F.lit("0").alias("correct_index"))
    options = F.array(F.lit("answer"), F.when(k % 3 == 0, "None of the above").otherwise("x"), F.when(k % 2 == 0, "a much longer wrong option").otherwise("y"))
    options = F.when(k % 2 == 1, F.array(F.lit("the longest answer of them"), options[1], options[2])).otherwise(options)
    stem = F.when(k % 5 == 0, F.concat(F.lit("Is it "), F.lower(options[0]), F.lit("?"))).otherwise("What?")
    title = F.when(k % 3 == 0, "Too short").when(k % 3 == 1, "The chapter on rivers").otherwise("Rivers of the north.")
    return table(spark, sf_dir, "customer").select("c_custkey", Q.valid(F.lit("f"), item).alias("card"), Q.valid(F.lit("qa"), item).alias("openq"), F.size(Q.key_points(item)).alias("n_points"), Q.mcq_flags(stem, options, F.lit(0)).alias("flags"), Q.title_flags(title).alias("title_flags"))


@query("""WITH r AS (SELECT c_custkey, ['', '0', '1', '4', '5', 'A', 'd', 'E', 'Z', ' perché '][c_custkey % 10 + 1] AS r FROM customer), i AS (SELECT *, CASE r WHEN '0' THEN 0 WHEN '1' THEN 0 WHEN '4' THEN 3 WHEN 'A' THEN 0 WHEN 'd' THEN 3 WHEN 'E' THEN 4 WHEN ' perché ' THEN 2 END AS i FROM r)
SELECT c_custkey, i::INT AS option_index, coalesce(i = 2, false) AS correct, coalesce(['uno', 'due', 'Perche', 'tre'][i + 1], r) AS selected, r = ' perché ' AS card_correct FROM i""")
def closed_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options named by number, letter or text, and flashcards."""
    r = F.element_at(F.array(*map(F.lit, ["", "0", "1", "4", "5", "A", "d", "E", "Z", " perché "])), (F.col("c_custkey") % 10 + 1).cast("int"))
    options = F.array(*map(F.lit, ["uno", "due", "Perche", "tre"]))
    correct, selected = E.judged_closed(r, options, F.lit(2))
    return table(spark, sf_dir, "customer").select("c_custkey", E.option_index(r, options).alias("option_index"), correct.alias("correct"), selected.alias("selected"), E.judged_flashcard(r, F.lit("Perché!"), F.lit(None).cast("double"))[0].alias("card_correct"))
