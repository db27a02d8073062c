"""Speech features from timed transcripts: words(session, seg, ord, start, end, word) and segments(session, seg, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words, count_patterns, count_substring, normalize_token, overlap_coefficient

# Fillers, hedges and self-correction patterns by language.
FILLERS = {"it": "ehm uhm mh mmh uh boh eh ah mmm".split(), "en": "um uh er ah hmm uhh umm".split()}
HEDGES = {"it": ["tipo", "cioè", "praticamente", "essenzialmente", "diciamo", "in pratica", "in sostanza"], "en": ["like", "you know", "kind of", "sort of", "i mean", "basically", "essentially"]}
CORRECTIONS = {
    "it": [r"\bno\s+aspett[ao]\b", r"\bno\s+scusa\b", r"\bscusa,?\s+intend[ioe]\b", r"\bintend[ioe]\s+dire\b", r"\bvoglio\s+dire\b", r"\bmi\s+correggo\b", r"\bcioè\s+no\b", r"\baspetta,?\s+volevo\s+dire\b", r"\b—\s*no,?\s+\b"],
    "en": [r"\bwait,?\s*no\b", r"\bactually,?\s*no\b", r"\bi\s+mean,?\s+(?!\.)", r"\bscratch\s+that\b", r"\blet\s+me\s+rephrase\b", r"\bno,?\s+sorry\b", r"\bsorry,?\s+i\s+mean\b", r"\bcorrection,?\s+\b"],
}
# Thresholds.
PAUSE_S, OVERLAP_LOW, OVERLAP_HIGH, HIGH_RATE = 0.8, 0.45, 0.95, 20


def pauses(words: DataFrame) -> DataFrame:
    """session, n and median (to two decimals) of gaps over PAUSE_S between a word's end and the next word's start."""
    w = Window.partitionBy("session").orderBy("seg", "ord")
    gaps = words.withColumn("gap", F.lead("start").over(w) - F.col("end")).where(F.col("gap") > PAUSE_S)
    return gaps.groupBy("session").agg(F.count("*").alias("n"), F.round(F.median("gap"), 2).alias("median"))


def reformulations(segments: DataFrame) -> DataFrame:
    """session, n: neighbouring segments whose content words overlap between the two limits, both excluded."""
    w = Window.partitionBy("session").orderBy("seg")
    rows = segments.withColumn("words", content_words(F.col("text"))).withColumn("before", F.lag("words").over(w))
    share = overlap_coefficient(F.col("before"), F.col("words"))
    return rows.groupBy("session").agg(F.count_if((share > OVERLAP_LOW) & (share < OVERLAP_HIGH)).alias("n"))


def fillers(words: DataFrame, language: str) -> DataFrame:
    """session, n: words that are fillers of the language (any but it: en)."""
    vocabulary = FILLERS["it" if language == "it" else "en"]
    return words.groupBy("session").agg(F.count_if(normalize_token(F.col("word")).isin(vocabulary)).alias("n"))


def hedges(text: Column, tokens: Column, language: str) -> Column:
    """Hedges: those of several words as substrings, single words as tokens."""
    own = HEDGES["it" if language == "it" else "en"]
    total = F.size(F.filter(tokens, lambda t: t.isin([h for h in own if " " not in h]))).cast("long")
    for h in (h for h in own if " " in h):
        total += count_substring(F.lower(text), h)
    return total


def corrections(text: Column, language: str) -> Column:
    """Self-corrections, over all patterns."""
    return count_patterns(F.lower(text), CORRECTIONS["it" if language == "it" else "en"])


def summary(duration: Column, filler: Column, rate: Column, hedge: Column, fixed: Column, pause: Column, reform: Column) -> Column:
    """The features in words, in fixed order."""
    say = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(what)))
    parts = [
        F.when(duration < 5, "response very short (<5s)"),
        say(fixed, " self-correction(s)"),
        say(reform, " apparent reformulation(s) between adjacent segments"),
        say(pause, " long thinking pause(s)"),
        say(hedge, " informal hedge(s)"),
        F.when(rate > HIGH_RATE, F.concat(F.lit("high filler density ("), F.bround(rate).cast("long").cast("string"), F.lit("/min) — possible cognitive load"))).otherwise(say(filler, " filler(s)")),
    ]
    joined = F.concat_ws("; ", *parts)
    return F.when(joined == "", "no significant paralinguistic signals").otherwise(joined)


def features(segments: DataFrame, words: DataFrame, sessions: DataFrame, language: str) -> DataFrame:
    """All features of each session of `sessions(session, duration)` that has segments."""
    text = segments.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda s: s["text"]), " ").alias("text"))
    tokens = words.groupBy("session").agg(F.collect_list(normalize_token(F.col("word"))).alias("tokens"))
    rows = text.join(sessions, "session", "left").join(tokens, "session", "left")
    for name, part in (("filler_count", fillers(words, language)), ("reformulation_count", reformulations(segments))):
        rows = rows.join(part.withColumnRenamed("n", name), "session", "left")
    rows = rows.join(pauses(words).withColumnsRenamed({"n": "long_pause_count", "median": "long_pause_median_s"}), "session", "left")
    zero = {"filler_count": 0, "reformulation_count": 0, "long_pause_count": 0, "long_pause_median_s": 0.0}
    rows = rows.fillna(zero).withColumn("duration", F.coalesce(F.nullif("duration", F.lit(0.0)), F.lit(1.0)))
    rate = F.round(F.col("filler_count") / F.greatest(F.col("duration") / 60, F.lit(1e-6)), 1)
    rows = rows.withColumns({"filler_per_min": rate, "hedge_count": hedges(F.col("text"), F.coalesce("tokens", F.array().cast("array<string>")), language), "self_correction_count": corrections(F.col("text"), language)})
    said = summary(*map(F.col, ("duration", "filler_count", "filler_per_min", "hedge_count", "self_correction_count", "long_pause_count", "reformulation_count")))
    return rows.select("session", F.round("duration", 2).alias("duration_seconds"), "filler_count", "filler_per_min", "hedge_count", "self_correction_count", "long_pause_count", "long_pause_median_s", "reformulation_count", said.alias("evidence_summary"))
