"""Evaluation of responses: judgments, interventions, state and roll-ups, in columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text, stripped

# Messages when no model answers, by language.
MESSAGES = {
    "it": {"advance": "Ottimo, andiamo avanti.", "hint_plus_redirect": "Non ci siamo del tutto. Manca un pezzo della risposta.", "redirect_only": "Rivedi il sorgente e riprova.", "modality_switch": "Prova a riformulare con parole tue, magari con un esempio.", "full_redirect": "Torniamo al sorgente prima di proseguire."},
    "en": {"advance": "Great, let's move on.", "hint_plus_redirect": "Almost there — a piece of the answer is missing.", "redirect_only": "Take another look at the source and try again.", "modality_switch": "Try reformulating in your own words, maybe with an example.", "full_redirect": "Let's go back to the source before we continue."},
}
# The rubric's dimensions, best value first, with scores.
RUBRIC = {"completezza": {"alta": 2, "parziale": 1, "assente": 0}, "correttezza": {"corretta": 2, "parzialmente_corretta": 1, "errata": 0}, "elaborazione": {"rielaborata": 2, "riportata": 1, "non_valutabile": 1}}


def option_index(response: Column, options: Column) -> Column:
    """The option that a response names: by number from 1 (0: the first), letter A to H, or equal text; else null."""
    s = stripped(response)
    number = F.when(s.rlike("^[0-9]{1,9}$"), s).cast("long")
    letter = F.ascii(F.upper(s)) - 65
    text = F.array_position(F.transform(options, normalize_text), normalize_text(s)) - 1
    text = F.when(text >= 0, text)
    by_number = F.when(s.rlike("^[0-9]{1,9}$"), F.when(number.between(1, F.size(options)), number - 1).when((number == 0) & (F.size(options) > 0), F.lit(0)))
    return F.when(s == "", None).otherwise(F.coalesce(by_number, F.when(s.rlike("^[A-Ha-h]$"), letter), text)).cast("int")


def judged_closed(response: Column, options: Column, correct: Column) -> tuple[Column, Column]:
    """Whether the response names the correct option, and the option's text (the response if there's none)."""
    index = option_index(response, options)
    return F.coalesce(index == correct, F.lit(False)), F.coalesce(F.get(options, index), response)


def judged_flashcard(response: Column, expected: Column, fuzzy: Column) -> tuple[Column, Column, Column]:
    """correct, score and fuzzy_used: equal when normalised, else as an external answer (null: none) says."""
    same = normalize_text(response) == normalize_text(expected)
    return F.when(same, True).otherwise(F.coalesce(fuzzy >= 0.5, F.lit(False))), F.when(same, 1.0).otherwise(fuzzy), ~same


def valid_open(c: Column, k: Column, e: Column) -> Column:
    """Whether all three dimensions have values of the rubric."""
    return F.coalesce(c.isin(list(RUBRIC["completezza"])) & k.isin(list(RUBRIC["correttezza"])) & e.isin(list(RUBRIC["elaborazione"])), F.lit(False))


def all_positive(c: Column, k: Column, e: Column) -> Column:
    """Whether all dimensions are at their best."""
    return (c == "alta") & (k == "corretta") & (e == "rielaborata")


def route_open(c: Column, k: Column, e: Column, second: Column) -> Column:
    """The intervention after an open answer."""
    return F.when(all_positive(c, k, e), "advance").when(second, "full_redirect").when(k != "corretta", "redirect_only").when(c != "alta", "hint_plus_redirect").otherwise("modality_switch")


def route_closed(correct: Column, second: Column) -> Column:
    """The intervention after a closed answer."""
    return F.when(correct, "advance").when(second, "full_redirect").otherwise("hint_plus_redirect")


def status(intervention: Column) -> Column:
    """A concept's status after an intervention."""
    return F.when(intervention == "advance", "passed").when(intervention == "full_redirect", "fragile").otherwise("pending")


def redirect(intervention: Column, excerpt: Column) -> Column:
    """The excerpt that a redirect shows; null where there's no redirect."""
    return F.when(intervention.isin("advance", "modality_switch"), None).when(intervention == "full_redirect", F.substring(excerpt, 1, 400)).otherwise(F.substring(excerpt, 1, 160))


def fallback_message(intervention: Column, language: Column, locator: Column) -> Column:
    """The message without a model, with a pointer where there's a redirect."""
    base = F.lit("")
    for lang, said in MESSAGES.items():
        for kind, text in said.items():
            base = F.when((intervention == kind) & ((language == "it") if lang == "it" else (language != "it")), text).otherwise(base)
    it = F.concat(F.lit(" Dai un'occhiata a "), locator, F.lit("."))
    en = F.concat(F.lit(" Have a look at "), locator, F.lit("."))
    pointer = F.when(intervention.isin("advance", "modality_switch") | locator.isNull(), "").when(language == "it", it).otherwise(en)
    return F.trim(F.concat(base, pointer))


def open_summary(c: Column, k: Column, e: Column) -> Column:
    """An open judgment in words."""
    return F.concat(F.lit("completezza="), c, F.lit("; correttezza="), k, F.lit("; elaborazione="), e)


def attempts(turns: DataFrame) -> DataFrame:
    """Open turns(session, node, ts, id, c, k, e) with attempt number, second strike, intervention and status.

    A turn fails unless it advances, and whether it advances doesn't depend on earlier turns; so the failures before it
    are a running sum. They are never reset.
    """
    w = Window.partitionBy("session", "node").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    fail = (~all_positive(F.col("c"), F.col("k"), F.col("e"))).cast("long")
    rows = turns.withColumn("failed_before", F.coalesce(F.sum(fail).over(w), F.lit(0)))
    rows = rows.withColumn("attempt", F.col("failed_before") + 1).withColumn("second", F.col("failed_before") >= 1)
    rows = rows.withColumn("intervention", route_open(F.col("c"), F.col("k"), F.col("e"), F.col("second")))
    return rows.withColumn("status", status(F.col("intervention")))


def evaluated(turns: DataFrame) -> DataFrame:
    """Turns of all item types, judged, routed and counted in one plan.

    turns(session, node, ts, id, kind, response, options, correct, expected, fuzzy, c, k, e): closed items (mcq) are judged by
    option, flashcards by equality or an external score, open ones by the external judgment. A turn without a valid
    judgment, or of another kind, has an error; it isn't an attempt.
    """
    kind = F.col("kind")
    option, _ = judged_closed(F.col("response"), F.col("options"), F.col("correct"))
    card, _, _ = judged_flashcard(F.col("response"), F.col("expected"), F.col("fuzzy"))
    triple = [F.col(x) for x in "cke"]
    error = F.when(~F.coalesce(kind.isin("mcq", "flashcard", "open"), F.lit(False)), "unknown assessment type").when((kind == "open") & ~valid_open(*triple), "no valid judgment")
    passed = F.when(kind == "mcq", option).when(kind == "flashcard", card).otherwise(all_positive(*triple))
    rows = turns.withColumn("error", error).withColumn("_passed", F.when(F.col("error").isNull(), passed)).withColumn("correct", F.when(kind != "open", F.col("_passed")))
    w = Window.partitionBy("session", "node").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum((~F.col("_passed")).cast("long")).over(w), F.lit(0))
    rows = rows.withColumn("_before", before)
    second = F.col("_before") >= 1
    intervention = F.when(F.col("error").isNull(), F.when(kind == "open", route_open(*triple, second)).otherwise(route_closed(F.col("_passed"), second)))
    rows = rows.withColumn("intervention", intervention)
    return rows.select("session", "node", "ts", "id", "kind", "correct", "error", F.when(F.col("error").isNull(), F.col("_before") + 1).alias("attempt"), "intervention", F.when(F.col("error").isNull(), status(F.col("intervention"))).alias("status"))


def concept_state(evaluated: DataFrame) -> DataFrame:
    """For each session and node: attempts, failed attempts, last status and the interventions in order."""
    order = F.array_sort(F.collect_list(F.struct("ts", "id", "intervention")))
    rows = evaluated.groupBy("session", "node").agg(F.count("*").alias("attempts"), F.count_if(F.col("intervention") != "advance").alias("failed_attempts"), F.max_by("status", F.struct("ts", "id")).alias("status"), order.alias("h"))
    return rows.select("session", "node", "attempts", "failed_attempts", "status", F.array_join(F.col("h.intervention"), ",").alias("history"))


def session_summary(turns: DataFrame) -> DataFrame:
    """For each session, label and average of each dimension over its open turns (c, k, e null: closed, with correct)."""
    out = []
    for name, dim in (("c", "completezza"), ("k", "correttezza"), ("e", "elaborazione")):
        score = F.lit(None).cast("int")
        for value, points in RUBRIC[dim].items():
            score = F.when(F.col(name) == value, points).otherwise(score)
        mean = F.avg(score)
        out += [F.round(mean, 6).alias(f"{dim}_avg"), F.when(mean >= 1.5, "good").when(mean >= 0.75, "partial").when(mean.isNotNull(), "weak").alias(dim)]
    return turns.groupBy("session").agg(*out, F.count_if(F.col("correct")).alias("closed_correct"), F.count("correct").alias("closed_total"))


def spoken(responses: DataFrame, segments: DataFrame, computed: DataFrame) -> DataFrame:
    """responses(id, modality, response, transcript, features) with what was said, features and error.

    An audio response without a transcript takes its segments(id, seg, text) joined by spaces, without any an error;
    one without features takes the computed(id, features), else `{}`. Texts stay as they are.
    """
    text = segments.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]), " ").alias("_text"))
    rows = responses.join(text, "id", "left").join(computed.withColumnRenamed("features", "_features"), "id", "left")
    audio = F.col("modality") == "audio"
    given = F.nullif("transcript", F.lit(""))
    said = F.when(audio, F.coalesce(given, stripped(F.col("_text")))).otherwise(F.col("response"))
    features = F.when(audio, F.coalesce(F.nullif("features", F.lit("")), "_features", F.lit("{}")))
    error = F.when(audio & given.isNull() & F.col("_text").isNull(), "no transcript")
    return rows.select("id", said.alias("said"), features.alias("features"), error.alias("error"))


def judged_open(turns: DataFrame, judgments: DataFrame) -> DataFrame:
    """`turns` with the external judgment(id, c, k, e) of each; there's no fallback, so a missing or odd one is an error."""
    rows = turns.join(judgments, "id", "left")
    return rows.withColumn("error", F.when(~valid_open(F.col("c"), F.col("k"), F.col("e")), "no valid judgment"))


# Words that a message must not say, as they tell how it was judged.
BARRED = ["completezza", "correttezza", "elaborazione", "rubric", "punteggio", "score", "alta", "parziale", "assente", "rielaborata", "riportata", "voto", "punti"]


def message_faults(message: Column, pointer: Column) -> Column:
    """What a message does that it must not: barred (words of the rubric, grades), long (over three sentences), empty, unpointed (without the pointer, where one is given)."""
    sentences = F.size(F.filter(F.split(message, r"[.!?]+(\s|$)"), lambda s: F.trim(s) != ""))
    grade = F.lower(message).rlike(r"\b(" + "|".join(BARRED) + r")\b|\d+ (out of|su) \d+|\d+ ?%")
    faults = F.array(
        F.when(grade, "barred"),
        F.when(sentences > 3, "long"),
        F.when(sentences == 0, "empty"),
        F.when(~F.contains(message, pointer), "unpointed"),
    )
    return F.array_compact(faults)


def chosen_message(answer: Column, fallback: Column, pointer: Column) -> Column:
    """A model's message, stripped, if it is one and has no fault; else the one without a model."""
    said = F.trim(F.coalesce(answer, F.lit("")))
    return F.when(F.size(message_faults(said, pointer)) == 0, said).otherwise(fallback)
