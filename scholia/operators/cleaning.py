"""Cleaning of transcripts: what can be done by rule, and whether a cleaned transcript is one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sounds that fill pauses.
FILLERS = ["ehm", "uhm", "ah", "mmm", "eh", "um", "uh"]
#: Repeats of longer words behind a comma may be meant.
SHORT = 3
#: A cleaned segment keeps this share of the characters, and takes this share of its words from the source.
LEAST_LENGTH, LEAST_SHARED = 0.5, 0.6


def core(token: Column) -> Column:
    """A token's letters, folded, without the punctuation around it."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


_AROUND, _STUTTER = re.compile(r"^[\W_]+|[\W_]+$"), re.compile(r"(?:([^\W\d_]{1,2})-)+(?=\1)", re.I)


@lru_cache(maxsize=1 << 16)
def spoken_token(token: str) -> tuple[str, int, str]:
    """The token without its stutter, how many characters that took, and its core."""
    stutter = _STUTTER.match(token)
    skip = stutter.end() if stutter and stutter[0].replace("-", "").isalpha() else 0
    return token[skip:], skip, _AROUND.sub("", token[skip:]).lower()


def cleaned_text(text: str | None) -> tuple[str, list[int]]:
    """A segment's text by the rules of `cleaned`, and where each word left stood."""
    said, at = [], 0
    for token in (text or "").split(" "):
        if token:
            rest, skip, own = spoken_token(token)
            if own not in FILLERS:
                said.append((rest, at + skip, own))
        at += len(token) + 1
    left = [(token, start) for (token, start, own), (_, _, after) in zip(said, [*said[1:], ("", 0, "")]) if not (own and after == own and (token.lower().endswith(own) or token.endswith(",") and len(own) <= SHORT))]
    return " ".join(token for token, _ in left), [start for _, start in left]


def cleaned(segments: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, text and starts (where each word left stood in the source) of `segments(keys, text)` by rule.

    Fillers go, of words repeated at once only the last stays (behind a comma only short ones go), and stutters (M-Markov) lose their start.
    Each segment is cleaned where it is read, and nothing is shuffled. Segments of which nothing is left have an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            found = [cleaned_text(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.list_(pa.int64()))], [*keys, "text", "starts"])

    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)
    return segments.select(*keys, "text").mapInArrow(run, f"{kinds}, text string, starts array<bigint>")


def accepted(source: DataFrame, answer: DataFrame) -> DataFrame:
    """req_id, id, ord, text and fault: what of `answer(req_id, pos, id, text)` may replace `source(req_id, ord, id, text)`.

    fault: missing (no answer), moved (not at its place), shortened, rewritten (too few of its words stand in the source), swapped (a
    word that no word of the source resembles); with a fault the source's text stays. Of answers that repeat an id the last counts;
    invented ids are left out.
    """
    last = answer.groupBy("req_id", "id").agg(F.max_by(F.struct("pos", F.trim("text").alias("text")), "pos").alias("a"))
    rows = source.join(last, ["req_id", "id"], "left")
    place = Window.partitionBy("req_id").orderBy("ord")
    rows = rows.withColumn("seen", F.max("a.pos").over(place.rowsBetween(Window.unboundedPreceding, -1)))
    words = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s+"), core), lambda w: w != "")
    rows = rows.withColumn("old", words(F.col("text"))).withColumn("new", words(F.col("a.text")))
    fresh = F.array_except("new", "old")
    alien = F.filter(fresh, lambda w: ~F.exists("old", lambda o: F.levenshtein(o, w) * 2 <= F.greatest(F.length(o), F.length(w))))
    shared = F.size(F.filter("new", lambda w: F.array_contains("old", w)))
    fault = (
        F.when(F.col("a").isNull() | F.col("a.text").isNull(), "missing")
        .when(F.col("seen") > F.col("a.pos"), "moved")
        .when(F.length("a.text") < LEAST_LENGTH * F.length("text"), "shortened")
        .when(shared < LEAST_SHARED * F.size("new"), "rewritten")
        .when(F.size(alien) > 0, "swapped")
    )
    rows = rows.withColumn("fault", fault)
    return rows.select("req_id", "id", "ord", F.when(F.col("fault").isNull(), F.col("a.text")).otherwise(F.col("text")).alias("text"), "fault")
