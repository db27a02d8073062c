"""Queries over languages, cleaned transcripts, requests to models and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import language as L
from ..operators import ledger as R
from ..operators import store
from ..session import scratch, stored
from .registry import query
from .relations import table


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord and text: every document's lines with something in them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return rows.where("trim(text) <> ''")


_PAIRS = lambda c: f"' ' || trim(regexp_replace(lower({c}), '{L.OTHER}', ' ', 'g')) || ' '"
LANGUAGE = f"""ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents
), b AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ls WHERE trim(text, ' ') <> ''
), sample AS (SELECT doc_id, substr(string_agg(text, chr(10) ORDER BY ord), 1, {L.SAMPLE}) AS sample FROM b WHERE before < {L.SAMPLE} GROUP BY doc_id
), t AS (SELECT lang AS language, {_PAIRS('text')} AS s FROM documents WHERE lang IS NOT NULL), tp AS (SELECT language, substr(s, i, 2) AS pair, count(*) AS n FROM (SELECT *, unnest(range(1, length(s))) AS i FROM t WHERE length(s) > 2) GROUP BY ALL
), tot AS (SELECT language, sum(n) AS total FROM tp GROUP BY language
), model AS (SELECT p.pair, language, round(1000 * ln((coalesce(n, 0) + 1) / (total + {L.ALPHABET * L.ALPHABET})))::BIGINT AS weight FROM (SELECT DISTINCT pair FROM tp) p CROSS JOIN tot LEFT JOIN tp USING (pair, language)
), sp AS (SELECT doc_id, substr(s, i, 2) AS pair, count(*) AS n FROM (SELECT *, unnest(range(1, length(s))) AS i FROM (SELECT doc_id, {_PAIRS('sample')} AS s FROM sample) WHERE length(s) > 2) GROUP BY ALL
), sc AS (SELECT doc_id, language, sum(n * weight) AS score, sum(n) AS size FROM sp JOIN model USING (pair) GROUP BY ALL
), best AS (SELECT doc_id, arg_max(language, score) AS language, floor((max(score) - max(score) FILTER (rk = 2)) / any_value(size))::BIGINT AS margin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, language) AS rk FROM sc) GROUP BY doc_id)"""


@query(f"""WITH {LANGUAGE}, s AS (SELECT doc_id, length(sample) AS n_chars, language, margin FROM sample LEFT JOIN best USING (doc_id))
SELECT doc_id, s.n_chars, language, margin, coalesce(CASE WHEN doc_id % 7 = 0 THEN 'it' END, CASE WHEN lang IN ('it', 'en') THEN lang END, CASE WHEN language IN ('it', 'en') THEN language END, 'it') AS used FROM s JOIN documents USING (doc_id)""")
def detected_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of texts, their language by profiles of letter pairs, and the language to use."""
    docs = table(spark, sf_dir, "documents")
    samples = stored(L.sample_text(lines(spark, sf_dir)), "samples")
    found = samples.select("doc_id", F.length("sample").alias("n_chars")).join(L.detected(samples, L.profiles(docs)), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    used = L.resolved(F.when(F.col("doc_id") % 7 == 0, " IT "), F.col("lang"), F.col("language"), "it")
    return found.select("doc_id", "n_chars", "language", "margin", used.alias("used"))


#: How a speaker says the words of a line, one after the other; @ is the word, ~ its first letter.
SPOKEN = ["@", "@", "ehm, @", "@ @", "~-@", "@, @", "@", "Uhm @ um,", "@ @ @,", "@. @"]
_SPOKEN = "[" + ", ".join(f"'{s}'" for s in SPOKEN) + "]"
SPEECH = f"""ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents
), wd AS (SELECT doc_id, ord, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM ls WHERE trim(text, ' ') <> ''
), spoken AS (SELECT doc_id, ord, string_agg(replace(replace({_SPOKEN}[(i + ord) % {len(SPOKEN)} + 1], '@', w), '~', substr(w, 1, 1)), ' ' ORDER BY i) AS text FROM wd GROUP BY doc_id, ord)"""


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they would be said."""
    shapes = F.array(*map(F.lit, SPOKEN))
    said = F.transform(F.split("text", " "), lambda w, i: F.replace(F.replace(F.element_at(shapes, ((i + F.col("ord")) % len(SPOKEN) + 1).cast("int")), F.lit("@"), w), F.lit("~"), F.substring(w, 1, 1)))
    return lines(spark, sf_dir).select("doc_id", "ord", F.array_join(said, " ").alias("text"))


_CORE = lambda c: rf"lower(regexp_replace({c}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))"
_FILLERS = ", ".join(f"'{x}'" for x in C.FILLERS)


@query(rf"""WITH {SPEECH}, tk AS (SELECT doc_id, ord, unnest(string_split(text, ' ')) AS tok, unnest(range(len(string_split(text, ' ')))) AS n FROM spoken
), pl AS (SELECT *, coalesce(sum(length(tok) + 1) OVER (PARTITION BY doc_id, ord ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at0 FROM tk
), st AS (SELECT *, CASE WHEN regexp_matches(tok, '^\p{{L}}-') AND lower(tok[1]) = lower(tok[3]) THEN 2 WHEN regexp_matches(tok, '^\p{{L}}{{2}}-') AND lower(tok[1:2]) = lower(tok[4:5]) THEN 3 ELSE 0 END AS skip FROM pl WHERE tok <> ''
), co AS (SELECT doc_id, ord, n, substr(tok, skip + 1) AS tok, at0 + skip AS at0, {_CORE('substr(tok, skip + 1)')} AS core FROM st
), nx AS (SELECT *, lead(core) OVER (PARTITION BY doc_id, ord ORDER BY n) AS follows FROM co WHERE core NOT IN ({_FILLERS})
), kept AS (SELECT * FROM nx WHERE NOT coalesce(core <> '' AND follows = core AND (suffix(lower(tok), core) OR (suffix(tok, ',') AND length(core) <= {C.SHORT})), false))
SELECT doc_id, ord::INT AS ord, coalesce(string_agg(tok, ' ' ORDER BY n), '') AS text, coalesce(string_agg(at0, ',' ORDER BY n), '') AS starts FROM (SELECT doc_id, ord FROM spoken) LEFT JOIN kept USING (doc_id, ord) GROUP BY doc_id, ord""")
def cleaned_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fillers, repeats and stutters taken out, with where each word stood (Q9)."""
    found = C.cleaned(spoken(spark, sf_dir), ["doc_id", "ord"])
    return found.select("doc_id", "ord", "text", F.array_join(F.transform("starts", lambda x: x.cast("string")), ",").alias("starts"))


#: What comes back for a segment, by its line and document: as it is, left out, moved, cut, other words, one other word, one word misheard.
@query(rf"""WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents), src AS (SELECT * FROM ls WHERE trim(text, ' ') <> ''
), ans AS (SELECT doc_id, ord, text, (ord + doc_id) % 7 AS k, CASE WHEN (ord + doc_id) % 7 = 2 THEN 0 ELSE ord + 10 END AS pos, CASE (ord + doc_id) % 7 WHEN 3 THEN substr(text, 1, length(text) // 3) WHEN 4 THEN 'qqqq wwww xxxx ' || substr(text, 1, 4) || repeat(' zzzz', 1 + length(text) // 5) WHEN 5 THEN text || ' qqqqqqqqqqqq' ELSE ' ' || text END AS said FROM src
), x AS (SELECT *, max(CASE WHEN k <> 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, trim(said, ' ') AS new,
  list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: {_CORE('w')}), lambda w: w <> '') AS ow, list_filter(list_transform(string_split_regex(trim(said, ' '), '\s+'), lambda w: {_CORE('w')}), lambda w: w <> '') AS nw FROM ans
), y AS (SELECT doc_id, ord, k, text, new, seen, pos, len(list_filter(nw, lambda w: list_contains(ow, w))) AS shared, len(nw) AS size, len(list_filter(nw, lambda w: NOT list_contains(ow, w) AND len(list_filter(ow, lambda o: levenshtein(o, w) * 2 <= greatest(length(o), length(w)))) = 0)) AS alien FROM x
), z AS (SELECT *, CASE WHEN k = 1 THEN 'missing' WHEN seen > pos THEN 'moved' WHEN length(new) < {C.LEAST_LENGTH} * length(text) THEN 'shortened' WHEN shared < {C.LEAST_SHARED} * size THEN 'rewritten' WHEN alien > 0 THEN 'swapped' END AS fault FROM y)
SELECT doc_id AS req_id, ord::INT AS ord, CASE WHEN fault IS NULL THEN new ELSE text END AS text, fault FROM z""")
def accepted_cleanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned segments that may replace their source, and what is wrong with the others."""
    source = lines(spark, sf_dir).select(F.col("doc_id").alias("req_id"), "ord", F.col("ord").cast("string").alias("id"), "text")
    k = (F.col("ord") + F.col("req_id")) % 7
    words = F.concat(F.lit("qqqq wwww xxxx "), F.substring("text", 1, 4), F.expr("repeat(' zzzz', int(1 + floor(length(text) / 5)))"))
    said = F.when(k == 3, F.expr("substring(text, 1, int(floor(length(text) / 3)))")).when(k == 4, words).when(k == 5, F.concat("text", F.lit(" qqqqqqqqqqqq"))).otherwise(F.concat(F.lit(" "), "text"))
    answer = source.where(k != 1).select("req_id", F.when(k == 2, 0).otherwise(F.col("ord") + 10).alias("pos"), "id", said.alias("text"))
    invented = source.where(k == 0).select("req_id", F.lit(10**6).alias("pos"), F.concat(F.lit("x"), "id").alias("id"), "text")
    return C.accepted(source, answer.unionByName(invented)).select("req_id", "ord", "text", "fault")


_ITEM = "'{\"id\":\"' || ord || '\",\"text\":\"' || words || '\"}'"
LEDGER = rf"""ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents
), bl AS (SELECT doc_id, ord, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM ls WHERE trim(text, ' ') <> ''
), rq AS (SELECT 'clean' AS kind, doc_id, rn // 12 AS batch, '[' || string_agg({_ITEM}, ',' ORDER BY ord) || ']' AS payload FROM bl GROUP BY ALL
  UNION ALL SELECT 'segment', doc_id, b, '[' || string_agg({_ITEM.replace('words', 'substr(words, 1, 60)')}, ',' ORDER BY ord) || ']' FROM (SELECT *, unnest(range(greatest(0, floor((rn - 8) / 5) + 1)::BIGINT, least(rn // 5, greatest(0, ceil((n - 8) / 5)))::BIGINT + 1)) AS b FROM bl) GROUP BY doc_id, b
  UNION ALL SELECT 'cluster', doc_id, 0, '[' || string_agg({_ITEM.replace('words', 'substr(words, 1, 80)')}, ',' ORDER BY ord) || ']' FROM bl GROUP BY doc_id
), ad AS (SELECT *, sha256(kind || chr(10) || payload) AS address FROM rq), one AS (SELECT address, kind, count(*) AS uses, ('0x' || substr(address, 1, 6))::BIGINT % 5 AS k FROM ad GROUP BY ALL)"""


@query(f"""WITH {LEDGER} SELECT address, kind, uses, CASE k WHEN 0 THEN 1 WHEN 4 THEN 0 WHEN 3 THEN 3 ELSE 2 END::BIGINT AS tries, CASE k WHEN 4 THEN 'open' WHEN 3 THEN 'rejected' WHEN 2 THEN 'failed' ELSE 'answered' END AS state, CASE WHEN k < 2 THEN '[' || k || ']' END AS answer, CASE k WHEN 4 THEN 1 WHEN 2 THEN 3 END::BIGINT AS next FROM one""")
def request_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for cleaning, segmentation and clustering, each asked once, with late, repeated, broken and failed answers over three rounds."""
    blocks = lines(spark, sf_dir).select("doc_id", "ord", F.col("ord").cast("string").alias("id"), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("text"))
    kinds = [("clean", R.payloads(blocks, 12)), ("segment", R.payloads(blocks, 8, 3, 60)), ("cluster", R.payloads(blocks, 10**9, 0, 80))]
    asked = None
    for kind, rows in kinds:
        rows = rows.withColumn("kind", F.lit(kind))
        asked = rows if asked is None else asked.unionByName(rows)
    asked = stored(R.addressed(asked), "requests")
    # by the address: answered at once; at the second try; two failures; three; never asked
    k = F.conv(F.substring("address", 1, 6), 16, 10).cast("long") % 5
    each = asked.select("address", "doc_id", k.alias("k")).distinct()
    tries = F.when(F.col("k") == 0, F.array(F.lit(1), F.lit(1))).when(F.col("k") == 3, F.array(F.lit(3), F.lit(1), F.lit(2))).when(F.col("k") < 3, F.array(F.lit(2), F.lit(1), F.lit(1))).otherwise(F.array().cast("array<int>"))
    body = F.when(F.col("k") == 0, "[0]").when((F.col("k") == 1) & (F.col("attempt") == 2), "[1]").when(F.col("attempt") == 1, '{"no": "list"}').when(F.col("attempt") == 2, "[1,")
    answers = each.withColumn("attempt", F.explode(tries)).select("address", "attempt", body.alias("body"))
    strays = answers.limit(1).select(F.lit("unknown").alias("address"), "attempt", "body")
    book = R.ledger(asked, answers.unionByName(strays))
    return book.join(R.due(book).withColumnRenamed("attempt", "next"), "address", "left").select("address", "kind", "uses", F.col("tries").cast("long").alias("tries"), "state", "answer", F.col("next").cast("long").alias("next"))


@query("""WITH e AS (SELECT o_custkey % 50 AS material, 'n' || o_orderkey % 20 AS node, CASE WHEN o_orderstatus = 'P' THEN '' ELSE '<p>' || o_orderkey || '</p>' END AS html, o_orderdate AS at0, o_orderkey AS seq FROM orders), l AS (SELECT material, node, arg_max(html, (at0, seq)) AS html FROM e GROUP BY ALL)
SELECT material, string_agg(node || '=' || html, ' ' ORDER BY node) AS annotations FROM l WHERE html <> '' GROUP BY material""")
def annotated_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of edits merged into each material's map of nodes to html, the last edit of a node counts."""
    o = table(spark, sf_dir, "orders")
    html = F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.concat(F.lit("<p>"), "o_orderkey", F.lit("</p>")))
    edits = o.select((F.col("o_custkey") % 50).alias("material"), F.concat(F.lit("n"), F.col("o_orderkey") % 20).alias("node"), html.alias("html"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    path = scratch(spark, "annotations-of")
    store.annotate(path, edits.where("seq % 3 <> 0"))
    found = store.annotate(path, edits.where("seq % 3 = 0 or seq % 10 = 0"))
    return found.select("material", F.array_join(F.transform(F.array_sort(F.map_entries("html")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), " ").alias("annotations"))
