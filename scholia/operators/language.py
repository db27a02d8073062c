"""Language by profiles of letter pairs, learnt from labelled texts.

A profile holds, for each pair of neighbouring letters (words padded by spaces), a weight for each language: the rounded logarithm of its smoothed
share. There are at most ALPHABET squared pairs, so a model is a table of that size whatever it was learnt from, and is broadcast. A text's
score is the sum of its pairs' weights, in integers, so that the result doesn't depend on the order of adding. Pairs are counted where a
text is read: what is shuffled are a batch's counts by language, and nothing for scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# What is no letter of the profiles: Latin with the Latin-1 accents, and the space.
OTHER = r"[^a-zà-öø-ÿ]+"
ALPHABET = 26 + 31 + 1
SAMPLE = 4096


def sample_text(blocks: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id and sample: the first blocks(doc_id, ord, text) until `most` characters, joined by line ends and cut there."""
    before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    few = blocks.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    return few.groupBy("doc_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n"), 1, most).alias("sample"))


#: Letters of the profiles, the number of each Latin-1 character among them (others count as spaces), and their pairs.
LETTERS = " abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)
CODES = np.zeros(256, np.int64)
CODES[list(LETTERS.encode("latin-1"))] = np.arange(ALPHABET)
PAIRS = [a + b for a in LETTERS for b in LETTERS]


def counted(text: str | None) -> np.ndarray:
    """How often each of PAIRS stands in a text's words, padded by spaces."""
    codes = CODES[np.frombuffer(f" {(text or '').lower()} ".encode("latin-1", "replace"), np.uint8)]
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])]  # one space between words
    return np.bincount(codes[:-1] * ALPHABET + codes[1:], minlength=ALPHABET * ALPHABET)


def pairs(texts: DataFrame, column: str) -> DataFrame:
    """language, pair and n: how often each pair stands in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, np.ndarray] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[language] = total.get(language, 0) + counted(text.as_py())
            for language, n in total.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(some), pa.string()), pa.array([PAIRS[i] for i in some], pa.string()), pa.array(n[some])], ["language", "pair", "n"])

    own = texts.select("language", F.col(column).alias("text")).mapInArrow(run, "language string, pair string, n long")
    return own.groupBy("language", "pair").agg(F.sum("n").alias("n"))


def profiles(texts: DataFrame, column: str = "text", language: str = "lang") -> DataFrame:
    """pair and language with its weight, of `texts`; pairs that a language lacks have that of a count of none."""
    known = texts.where(F.col(language).isNotNull())
    counts = stored(pairs(known.select(F.col(language).cast("string").alias("language"), F.col(column).alias("text")), "text"), "pairs")
    totals = {r.language: r.total for r in counts.groupBy("language").agg(F.sum("n").alias("total")).collect()}  # a row for each language
    if not totals:
        return counts.select("pair", "language", F.col("n").alias("weight"))
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])
    rows = counts.select("pair").distinct().withColumn("language", F.explode(F.array(*map(F.lit, totals)))).join(counts, ["pair", "language"], "left")
    share = (F.coalesce("n", F.lit(0)) + 1) / (total[F.col("language")] + ALPHABET * ALPHABET)
    return rows.select("pair", "language", F.round(1000 * F.log(share)).cast("long").alias("weight"))


def detected(texts: DataFrame, model: DataFrame, column: str = "sample") -> DataFrame:
    """doc_id, language and margin (its score over the next best's, by pair, in thousandths): null without a letter."""
    rows = model.collect()  # at most ALPHABET squared rows for each language
    place, names = {x: i for i, x in enumerate(PAIRS)}, sorted({r.language for r in rows})
    weight, known = (np.zeros((ALPHABET * ALPHABET, len(names)), np.int64) for _ in range(2))
    for r in rows:
        weight[place[r.pair], names.index(r.language)], known[place[r.pair], names.index(r.language)] = r.weight, 1

    def best(text: str | None) -> tuple[str | None, int | None]:
        n = counted(text)
        some = np.flatnonzero(n)
        size, score = n[some] @ known[some], n[some] @ weight[some]
        order = [i for i in np.argsort(-score, kind="stable") if size[i]]  # of equal scores the first name
        if not order:
            return None, None
        return names[order[0]], int((score[order[0]] - score[order[1]]) // size[order[0]]) if len(order) > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], ["doc_id", "language", "margin"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", F.col(column).alias("text")).mapInArrow(run, f"doc_id {kind}, language string, margin long")


def resolved(explicit: Column, source: Column, found: Column, default: str, supported: tuple[str, ...] = ("it", "en")) -> Column:
    """The language to use: the one asked for, else the source's if supported, else the one found if supported, else the default."""
    given = F.nullif(F.lower(F.trim(explicit)), F.lit(""))
    return F.coalesce(given, F.when(source.isin(*supported), source), F.when(found.isin(*supported), found), F.lit(default))
