"""Generated assessment items: defensive parsing, validation and checks of their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fences, stripped
from ..sources.blocks import batches

#: An item as generated; every field may be missing.
ITEM = "struct<front:string,back:string,question:string,options:array<string>,correct_index:string,expected_answer:string,key_points:array<string>>"


def text(c: Column) -> Column:
    """A trimmed string, empty for null."""
    return F.coalesce(stripped(c), F.lit(""))


def parsed(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items(req_id, item_type, pos, item) and warnings(req_id, warning) of responses(req_id, item_type, raw).

    A response that isn't a JSON array gives no items and a warning; a member that isn't an object is skipped with one.
    """
    body = strip_fences(F.col("raw"))
    rows = responses.withColumn("parts", F.when(body.startswith("["), F.from_json(body, "array<string>")))
    broken = rows.where("parts is null").select("req_id", F.lit("response isn't an array").alias("warning"))
    each = rows.select("req_id", "item_type", F.posexplode("parts").alias("pos", "part"))
    is_object = F.coalesce(stripped(F.col("part")).startswith("{"), F.lit(False))
    odd = each.where(~is_object).select("req_id", F.lit("item isn't an object").alias("warning"))
    items = each.where(is_object).select("req_id", "item_type", "pos", F.from_json("part", ITEM).alias("item"))
    return items, broken.unionByName(odd)


def valid(kind: Column, item: Column) -> Column:
    """Whether an item of the kind f, mcq or qa is complete."""
    options = F.transform(item["options"], text)
    index = F.when(item["correct_index"].rlike("^[0-9]+$"), item["correct_index"]).cast("int")
    mcq = (text(item["question"]) != "") & (F.size(options) == 4) & F.forall(options, lambda o: o != "") & index.between(0, 3)
    card = (text(item["front"]) != "") & (text(item["back"]) != "")
    openq = (text(item["question"]) != "") & (text(item["expected_answer"]) != "")
    return F.coalesce(F.when(kind == "f", card).when(kind == "mcq", mcq).when(kind == "qa", openq), F.lit(False))


def key_points(item: Column) -> Column:
    """Trimmed key points without blank ones."""
    return F.filter(F.transform(F.coalesce(item["key_points"], F.array().cast("array<string>")), text), lambda p: p != "")


def requested(n: Column) -> Column:
    """How many items to ask for: at most 25, null for fewer than one."""
    return F.when(n >= 1, F.least(n, F.lit(25)))


def error_class(produced: Column, warnings: Column) -> Column:
    """The HTTP status of a quiz: 429 for a quota, 422 without items or warnings, 503 for other warnings."""
    quota = F.contains(warnings, F.lit("RESOURCE_EXHAUSTED")) | F.contains(F.lower(warnings), F.lit("quota"))
    return F.when(produced > 0, 200).when(quota, 429).when(F.coalesce(warnings, F.lit("")) == "", 422).otherwise(503)


def mcq_flags(question: Column, options: Column, correct: Column) -> Column:
    """What is wrong with a multiple-choice item: answer in the stem, the correct option the longest, catch-all options."""
    answer = F.get(options, correct)
    longest = F.length(answer) == F.array_max(F.transform(options, F.length))
    return F.concat_ws(",", F.when(F.contains(F.lower(question), F.lower(answer)), "answer_in_stem"), F.when(longest, "correct_is_longest"), F.when(F.exists(options, lambda o: F.lower(o).rlike("^(all|none) of the above")), "catch_all"))


def title_flags(title: Column) -> Column:
    """What is wrong with a section title: its length, a level word, punctuation at its end."""
    n = F.size(F.split(stripped(title), r"\s+"))
    return F.concat_ws(",", F.when((n < 3) | (n > 10), "length"), F.when(F.lower(title).rlike("chapter|section|paragraph"), "level_word"), F.when(title.rlike("[.;:,]$"), "punctuation"))


def bridged(items: DataFrame) -> DataFrame:
    """Quiz items as assessment items: the type's name, and a node id even where the source has none."""
    kind = F.when(F.col("item_type") == "f", "flashcard").when(F.col("item_type") == "mcq", "mcq").when(F.col("item_type") == "qa", "open")
    return items.withColumn("assessment_type", kind).withColumn("node_id", F.coalesce("node_id", F.concat(F.lit("merged:"), F.col("item_id"))))


def answered(responses: DataFrame, quizzes: DataFrame) -> DataFrame:
    """responses(material_id, quiz_id, item_index) with the item each answers, or the error that there's none.

    quizzes(material_id, id, artifact_type, items): other artifacts and those of other materials don't count.
    """
    q = quizzes.where("artifact_type = 'quiz'").select("material_id", F.col("id").alias("quiz_id"), "items", F.lit(True).alias("_found"))
    rows = responses.join(q, ["material_id", "quiz_id"], "left")
    inside = F.coalesce((F.col("item_index") >= 0) & (F.col("item_index") < F.size("items")), F.lit(False))
    rows = rows.withColumn("error", F.when(F.col("_found").isNull(), "no quiz").when(~inside, "no item"))
    return rows.withColumn("item", F.when(inside, F.get("items", F.col("item_index")))).drop("items", "_found")


def gate(kind: Column, node: Column, options: Column, correct: Column, expected: Column) -> Column:
    """Why an item can't be evaluated; null if it can."""
    closed = F.coalesce((F.size(options) > 0) & (correct < F.size(options)), F.lit(False))
    return F.when(text(node) == "", "no node id").when((kind == "mcq") & ~closed, "no options or correct index").when((kind == "flashcard") & (F.coalesce(expected, F.lit("")) == ""), "no expected answer")


def label_requests(sections: DataFrame, language: Column, size: int = 12) -> DataFrame:
    """doc_id, batch, prompt: a request for titles for each `size` consecutive sections(doc_id, ord, kind, text)."""
    rows = batches(sections, "doc_id", "ord", size).withColumn("_language", language)
    each = F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))), lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text")))
    rows = rows.groupBy("doc_id", "batch", "_language").agg(F.to_json(each).alias("_json"))
    return rows.select("doc_id", "batch", F.concat(F.lit("Titles in "), "_language", F.lit(", one for each section, as a JSON array in the same order.\n\n"), "_json").alias("prompt"))


def judge_request(source: Column, question: Column, expected: Column, points: Column, response: Column, features: Column) -> Column:
    """What a judge of an open answer is told; key points and features only where there are any."""
    part = lambda name, c: F.concat(F.lit(name), c)
    return F.concat_ws("\n\n", part("Source:\n", source), part("Question: ", question), part("Outline of the answer, not to be shown: ", expected), F.when(F.size(points) > 0, part("Key aspects: ", F.to_json(points))), part("Answer:\n", response), F.when(features != "", part("Speech: ", features)))
