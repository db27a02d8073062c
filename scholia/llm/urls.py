"""URL filters: rules, and a path-template tree judged by labelled purity, in DataFrame functions only.

Rules (host and path) come first: a rule fits its host and all subdomains if the url's path starts with the rule's,
and the longest rule that fits gives the verdict.

Labels. No table labels pages, so a page's label comes from its own text: words whose presence tells bad from other labelled
documents (bad: quality 0 or toxic 1; at most `sample` of them, those of the smallest hashes of doc_id) have a log odds ratio each,
and a page is bad if the prior log odds and those of its words add up to more than zero. Empty pages have no label.

Tree. Per host, the segments of a path are generalised: those with a digit become `*` (an ending like `.html` stays). Then,
level by level from the host on, until the longest path ends, the branches of a node are merged into `*`: those
whose share of bad pages doesn't differ from that of their siblings (two-proportion z below `Z`, or fewer than `LEAST` labels) and whose
own branches are spread like theirs (shares in common of at least `SIMILAR`), or which are seen once among many. A template's
purity is the share of good pages, smoothed with its host's, and that with all hosts'; templates below
`least_purity` are blocked.

Hosts, nodes and templates with much of all rows are dealt out in parts where they are joined. Null urls, and urls without `://`,
have empty host and path; null and empty pages no label. Urls and pages of any length count whole. Rows repeat as they
are in the input; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, table, written

LEAST, Z, SMOOTH, LEAST_PURITY, MANY, SIMILAR = 5, 1.96, 8.0, 0.5, 20, 0.5
#: Labelled documents that give the words' weights at most, and the deviations from which on a word counts.
SAMPLE, WORD_Z = 20_000, 4.5
#: Words with a weight that are sent to all tasks at most.
FEW = 100_000
#: The rules of the registered query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, in texts and in pages.
BREAKS = r"[^\p{L}\p{N}]+"
MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|" + BREAKS


def host_and_path(url: Column) -> tuple[Column, Column]:
    """A url's host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = None, None
    for text, say in sorted(rules, key=lambda r: -len(r[0])):
        own = text.split("/", 1)[0]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(text[len(own) :])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, say) if verdict is None else verdict.when(fits, say)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def generalised(path: Column) -> Column:
    """The path's segments with the variable ones as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"\.[A-Za-z]{1,5}$", 0))).otherwise(s))


def words(text: Column, between: str = BREAKS) -> Column:
    """The distinct words of a text, A-Z lower-cased."""
    return F.array_distinct(F.filter(F.split(F.translate(text, _UPPER, _LOWER), between), lambda w: w != ""))


def word_weights(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float | None]:
    """word and weight (its log odds ratio of bad documents), and the prior log odds (None without labels of both kinds)."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` short rows, so they may go to every task
    rows = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = written(rows.select("bad", words(F.coalesce("text", F.lit(""))).alias("words")), "url-labelled")
    total = rows.agg(F.count("*").alias("n"), F.sum("bad").alias("b")).first()
    n, b = total.n, total.b or 0
    each = rows.select("bad", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("bad").alias("b"))
    p = b / n if n else 0.0
    if not 0 < p < 1:
        return each.limit(0).select("word", F.lit(0.0).alias("weight")), None
    z = (F.col("b") - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) + 0.5)
    odds = lambda x, all_: F.log((x + 0.5) / (F.lit(float(all_)) - x + 0.5))
    weight = odds(F.col("b"), b) - odds(F.col("n") - F.col("b"), n - b)
    return written(each.where(F.abs(z) >= WORD_Z).select("word", weight.alias("weight")), "url-words"), log(b / (n - b))


def page_labels(pages: DataFrame, weights: DataFrame, prior: float | None) -> DataFrame:
    """`pages(html, ...)` with `labelled` and `bad` (0 or 1) in place of html."""
    others = [c for c in pages.columns if c != "html"]
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    labelled = (html != "").cast("long").alias("labelled")
    if prior is None:
        return pages.select(*others, F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("bad"))
    few = weights.limit(FEW + 1).count() <= FEW
    found = pages.select(F.xxhash64(html).alias("_text"), F.explode(words(html, MARKUP)).alias("word")).join(F.broadcast(weights) if few else weights, "word")
    # pages with the same text give the same words
    score = found.groupBy("_text", "word").agg(F.min("weight").alias("weight")).groupBy("_text").agg(F.sum("weight").alias("score"))
    lean = written(pages.select(*others, F.xxhash64(html).alias("_text"), labelled), "url-texts")
    scored = spread_join(lean, score, ["_text"], lean, others, "left")
    bad = (F.col("labelled") == 1) & (F.coalesce("score", F.lit(0.0)) + prior > 0)
    return scored.select(*others, "labelled", bad.cast("long").alias("bad"))


def tree(pages: DataFrame) -> DataFrame:
    """host, key, template and purity, from `pages(host, key, labelled, bad)`; key: the generalised path."""
    leaves = pages.groupBy("host", "key").agg(F.count("*").alias("n"), F.sum("labelled").alias("lab"), F.sum("bad").alias("bad"))
    rows, done, level = written(leaves.withColumn("at", F.lit("")), "url-leaves"), None, 0
    own = ["host", "key", "n", "lab", "bad"]
    node, branch = ["host", "at"], ["host", "at", "seg"]
    while True:
        segments = F.split("key", "/")
        left = rows.withColumn("seg", F.coalesce(F.get(segments, level), F.lit(""))).withColumn("next", F.coalesce(F.get(segments, level + 1), F.lit("")))
        each = left.groupBy(*branch, "next").agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
        each = written(each, "url-branches")
        n = each.count()
        kids = each.groupBy(*branch).agg(F.sum("n").alias("cn"), F.sum("lab").alias("cl"), F.sum("bad").alias("cb"))
        nodes = kids.groupBy(*node).agg(F.sum("cn").alias("pn"), F.sum("cl").alias("pl"), F.sum("cb").alias("pb"), F.count("*").alias("kids"))
        both = written(spread_join(kids, nodes, node, each, ["seg"], total=n), "url-nodes")
        spread = each.groupBy(*node, "next").agg(F.sum("n").alias("total"))
        shares = spread_join(spread_join(each.select(*branch, "next", "n"), spread, [*node, "next"], each, ["seg"], total=n), both.select(*branch, "cn", "pn"), branch, each, ["next"], total=n)
        common = shares.where("pn > cn").groupBy(*branch).agg(F.sum(F.least(F.col("n") / F.col("cn"), (F.col("total") - F.col("n")) / (F.col("pn") - F.col("cn")))).alias("common"))
        both = both.join(common, branch, "left")
        rest = F.col("pl") - F.col("cl")
        p = F.col("pb") / F.when(F.col("pl") > 0, F.col("pl"))
        differ = F.col("cb") / F.when(F.col("cl") > 0, F.col("cl")) - (F.col("pb") - F.col("cb")) / F.when(rest > 0, rest)
        error = F.sqrt(p * (1 - p) * (1 / F.when(F.col("cl") > 0, F.col("cl")) + 1 / F.when(rest > 0, rest)))
        apart = F.coalesce((F.col("cl") >= LEAST) & (rest >= LEAST) & (F.abs(differ) >= Z * error) & (error > 0), F.lit(False))
        alike = (F.coalesce("common", F.lit(0.0)) >= SIMILAR) | ((F.col("cn") == 1) & (F.col("kids") >= MANY))
        literal = (F.col("seg") == "") | F.col("seg").startswith("*") | (F.col("kids") == 1) | apart | ~alike
        named = both.select(*branch, F.when(F.col("seg") == "", F.col("at")).otherwise(F.concat("at", F.lit("/"), F.when(literal, F.col("seg")).otherwise("*"))).alias("to"))
        moved = spread_join(left, named, branch, left, ["key"]).select(*own, F.col("to").alias("at"), F.col("next"))
        moved, level = written(moved, "url-level"), level + 1
        ended = moved.where("next = ''").select(*own, F.col("at").alias("template"))
        done = ended if done is None else done.unionByName(ended)
        rows = moved.where("next <> ''").drop("next")
        if rows.isEmpty():
            break
        # a path that is alone below its node goes on as it is
        alone = rows.groupBy(*node).agg(F.count("*").alias("paths")).where("paths = 1").drop("paths")
        single = rows.join(alone, node, "left_semi").select(*own, F.concat_ws("/", "at", F.array_join(F.slice(segments, level + 1, 1 << 30), "/")).alias("template"))
        done, rows = done.unionByName(single), written(rows.join(alone, node, "left_anti"), "url-rest")
        if rows.isEmpty():
            break
    rows = written(done, "url-done")
    hosts = rows.groupBy("host").agg(F.sum("lab").alias("hl"), F.sum("bad").alias("hb"))
    total = hosts.agg(F.sum("hl").alias("l"), F.sum("hb").alias("b")).first()
    overall = ((total.b or 0) + 1.0) / ((total.l or 0) + 2.0)
    sums = rows.groupBy("host", "template").agg(F.sum("lab").alias("tl"), F.sum("bad").alias("tb"))
    templates = spread_join(sums, hosts, ["host"], rows, ["template"])
    prior = (F.col("hb") + SMOOTH * overall) / (F.col("hl") + SMOOTH)
    templates = templates.select("host", "template", (1 - (F.col("tb") + SMOOTH * prior) / (F.col("tl") + SMOOTH)).alias("purity"))
    return spread_join(rows, templates, ["host", "template"], rows, ["key"]).select("host", "key", "template", "purity")


def judged(pages: DataFrame, docs: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, least_purity: float = LEAST_PURITY) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page; `docs` and `labels` give the words' weights."""
    host, path = host_and_path(F.col("url").cast("string"))
    keyed = pages.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("key", F.array_join(generalised(F.col("path")), "/"))
    marked = page_labels(keyed.select("host", "key", "html"), *word_weights(docs, labels))
    found = written(tree(marked), "url-templates")
    rows = keyed.drop("html")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    said = F.coalesce(verdict, F.when(F.col("purity") < least_purity, "block").otherwise("allow"))
    both = spread_join(rows, found, ["host", "key"], rows, ["page_id", "path"])
    return both.select("page_id", "host", "path", rule.alias("rule"), said.alias("verdict"), "template", "purity")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(*(table(spark, sf_dir, name) for name in ("pages", "documents", "labels")))
    return found.withColumn("purity", F.round("purity", 6))


def op5_sql(levels: int = 4) -> str:
    """The query in DuckDB SQL, for paths of up to so many segments."""
    split = lambda c, at: f"list_distinct(list_filter(regexp_split_to_array(translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}'), '{at}'), lambda w: w <> ''))"
    steps = f"""
WITH known AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), lw AS (SELECT bad, {split("text", BREAKS)} AS words FROM documents JOIN known USING (doc_id)
), t AS (SELECT count(*) AS n, sum(bad) AS b FROM lw
), e AS (SELECT word, count(*) AS n, sum(bad) AS b FROM (SELECT bad, unnest(words) AS word FROM lw) GROUP BY word
), wt AS (SELECT word, ln((e.b + 0.5) / (t.b - e.b + 0.5)) - ln((e.n - e.b + 0.5) / (t.n - t.b - (e.n - e.b) + 0.5)) AS weight FROM e, t
  WHERE abs((e.b - e.n * (t.b / t.n)) / sqrt(e.n * (t.b / t.n) * (1 - t.b / t.n) + 0.5)) >= 4.5
), u AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hp AS (SELECT r, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), k AS (SELECT r, page_id, host, path, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
    lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '\\.[A-Za-z]{{1,5}}$') ELSE s END), '/') AS key,
    CASE WHEN html <> '' THEN 1 ELSE 0 END AS labelled FROM hp
), sc AS (SELECT r, sum(weight) AS score FROM (SELECT r, unnest({split("html", MARKUP)}) AS word FROM hp) JOIN wt USING (word) GROUP BY r
), m AS (SELECT host, key, labelled, CASE WHEN labelled = 1 AND coalesce(score, 0) + ln(t.b / (t.n - t.b)) > 0 THEN 1 ELSE 0 END AS bad FROM k LEFT JOIN sc USING (r), t
), r0 AS (SELECT host, key, '' AS pre, count(*) AS n, sum(labelled) AS lab, sum(bad) AS bad FROM m GROUP BY host, key)"""
    for d in range(levels):
        steps += f""", s{d} AS (SELECT *, coalesce(string_split(key, '/')[{d + 1}], '') AS seg, coalesce(string_split(key, '/')[{d + 2}], '') AS nxt FROM r{d}
), c{d} AS (SELECT host, pre, seg, sum(n) AS cn, sum(lab) AS cl, sum(bad) AS cb FROM s{d} GROUP BY host, pre, seg
), p{d} AS (SELECT host, pre, sum(cn) AS pn, sum(cl) AS pl, sum(cb) AS pb, count(*) AS kids FROM c{d} GROUP BY host, pre
), x{d} AS (SELECT host, pre, seg, nxt, sum(n) AS n FROM s{d} GROUP BY host, pre, seg, nxt
), y{d} AS (SELECT host, pre, seg, sum(least(n / cn, (total - n) / (pn - cn))) AS common
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, pre, nxt) AS total FROM x{d}) JOIN c{d} USING (host, pre, seg) JOIN p{d} USING (host, pre) WHERE pn > cn GROUP BY host, pre, seg
), b{d} AS (SELECT host, pre, seg, cn, cl, cb, pl, pb, kids, coalesce(common, 0) AS common, cb / nullif(cl, 0) - (pb - cb) / nullif(pl - cl, 0) AS differ,
    sqrt(pb / nullif(pl, 0) * (1 - pb / nullif(pl, 0)) * (1 / nullif(cl, 0) + 1 / nullif(pl - cl, 0))) AS error
  FROM c{d} JOIN p{d} USING (host, pre) LEFT JOIN y{d} USING (host, pre, seg)
), n{d} AS (SELECT host, pre, seg, CASE WHEN seg = '' THEN pre ELSE pre || '/' || CASE WHEN seg LIKE '*%' OR kids = 1
    OR coalesce(cl >= 5 AND pl - cl >= 5 AND abs(differ) >= 1.96 * error AND error > 0, false) OR NOT (common >= 0.5 OR (cn = 1 AND kids >= 20))
    THEN seg ELSE '*' END END AS towards FROM b{d}
), r{d + 1} AS (SELECT s.host, key, towards AS pre, n, lab, bad FROM s{d} s JOIN n{d} m USING (host, pre, seg)
)"""
    rule = " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{text[len(h):]}') THEN '{{{{{i}}}}}'"
        for i, (text, _) in enumerate(sorted(RULES, key=lambda r: -len(r[0])))
        for h in [text.split("/", 1)[0]]
    )
    by_rule, by_verdict = rule, rule
    for i, (text, say) in enumerate(sorted(RULES, key=lambda r: -len(r[0]))):
        by_rule, by_verdict = by_rule.replace(f"{{{{{i}}}}}", text), by_verdict.replace(f"{{{{{i}}}}}", say)
    return steps + f""", tt AS (SELECT host, key, lab, bad, pre AS template FROM r{levels}
), h AS (SELECT host, sum(lab) AS hl, sum(bad) AS hb FROM tt GROUP BY host
), o AS (SELECT (coalesce(sum(hb), 0) + 1.0) / (coalesce(sum(hl), 0) + 2.0) AS overall FROM h
), q AS (SELECT host, template, 1 - (sum(bad) + 8 * (any_value(hb) + 8 * any_value(overall)) / (any_value(hl) + 8)) / (sum(lab) + 8) AS purity
  FROM tt JOIN h USING (host), o GROUP BY host, template
)
SELECT page_id, host, path, CASE {by_rule} END AS rule,
  coalesce(CASE {by_verdict} END, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM k JOIN tt USING (host, key) JOIN q USING (host, template)
"""
