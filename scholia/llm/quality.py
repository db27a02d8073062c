"""Quality rules: base rules on words and lines, then tokeniser fertility.

Base measures (words are runs of characters other than ASCII white space): n_words, word_chars (code points in words),
n_symbols (characters of `#*$%&|<>`), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words
in 3-word windows found twice or more). base_failed: fewer than `least_words` words, or more than half of the words
repeated.

Fertility: a public sentence-piece vocabulary with byte fallback encodes each word; a text's measures are code points
per token, the share of byte-fallback tokens and the entropy of its tokens over the most that its length allows. Bands
are taken for each language (null: `und`) over all texts that pass the base rules: `width` interquartile ranges beyond
the quartiles, with a floor for the range. A text outside a band isn't kept.

Null and empty texts have no words and fail. Texts are measured whole. Rows without a doc_id are kept and measured;
rows that repeat are measured each by itself. Empty tables give no rows. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Symbols of the base rule (a fixed value).
SYMBOLS = b"#*$%&|<>"
#: Words a worker remembers the tokens of.
REMEMBERED = 400_000
#: The measures with a band: the sides that reject, and the least interquartile range.
BANDS = {"chars_per_token": ("low", "high", 0.05), "byte_share": (None, "high", 0.02), "entropy": ("low", None, 0.02)}


def default_vocabulary() -> str:
    """Where the public sentence-piece vocabulary is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Fertility:
    """Encodes words with one vocabulary; one for each Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.known: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Encodes the words not met before."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for w, ids in zip(some, self.model.encode([w.decode() for w in some], num_threads=1)):
                self.known[w] = np.array(ids, np.int32).tobytes()

    def measures(self, words: list[bytes], chars: int) -> tuple[float, float, float]:
        """Code points per token, share of byte tokens, entropy over its maximum."""
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
        if not len(ids):
            return 0.0, 0.0, 0.0
        ids = np.sort(ids)
        counts = np.diff(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])))
        share = counts / len(ids)
        most = np.log(min(len(ids), len(self.byte)))
        return chars / len(ids), float(self.byte[ids].mean()), float(-(share * np.log(share)).sum() / most) if most > 0 else 1.0


@lru_cache(maxsize=2)
def fertility(path: str) -> Fertility:
    """The worker's encoder for that vocabulary."""
    return Fertility(path)


def base(text: bytes) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: set[tuple] = set()
            again = {w for w in windows if w in seen or seen.add(w)}
            covered = bytearray(len(words))
            for i, w in enumerate(windows):
                if w in again:
                    covered[i : i + 3] = b"\x01\x01\x01"
            repeated = covered.count(1)
    return words, (len(words), len(joined.decode()), symbols, len(lines) - len(set(lines)), repeated)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *BANDS]


def measure(docs: DataFrame, vocabulary_path: str | None = None, least_words: int = 50) -> DataFrame:
    """doc_id, lang and the measures of each text."""
    path = vocabulary_path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fertility(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [base((t.as_py() or "").encode()) for t in part.column("text")]
                own.learn({w for words, _ in found for w in words})
                rows = [(*b, sum(map(len, map(own.known.__getitem__, words))) // 4, *own.measures(words, b[1])) for words, b in found]
                kinds = [pa.int64()] * 6 + [pa.float64()] * 3
                columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(9)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), *columns], ["doc_id", "lang", *NAMES])

    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{n} {'double' if n in BANDS else 'long'}" for n in NAMES)
    out = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {kinds}")
    return out.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def bands(measured: DataFrame, width: float = 4.0) -> DataFrame:
    """For each language the limits of each measure, from the quartiles of the texts that pass the base rules.

    A quartile is the least value, of those to four decimals, that has its share of the texts at or below it: counted exactly.
    """
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.round(m, 4).alias("v")) for m in BANDS]))
    counts = measured.where(~F.col("base_failed")).select("lang", values.alias("x")).groupBy("lang", "x.m", "x.v").agg(F.count("*").alias("n"))
    each = Window.partitionBy("lang", "m")
    below = F.sum("n").over(each.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select("lang", "m", "v", below.alias("below"), F.sum("n").over(each).alias("all"))
    at = lambda m, share: F.min(F.when((F.col("m") == m) & (F.col("below") >= share * F.col("all")), F.col("v")))
    rows = counts.groupBy("lang").agg(*[F.array(at(m, 0.25), at(m, 0.75)).alias(m) for m in BANDS])
    limits = []
    for m, (low, high, least) in BANDS.items():
        reach = width * F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(least))
        limits += [(F.col(m)[0] - reach if low else F.lit(None).cast("double")).alias(f"{m}_low"), (F.col(m)[1] + reach if high else F.lit(None).cast("double")).alias(f"{m}_high")]
    return rows.select("lang", *limits)


def judged(docs: DataFrame, vocabulary_path: str | None = None, least_words: int = 50, width: float = 4.0) -> DataFrame:
    """Every text's measures, base_failed and kept."""
    measured = written(measure(docs, vocabulary_path, least_words), "quality-measures")
    limits = written(bands(measured, width), "quality-bands")
    row = measured.join(limits, "lang", "left")
    within = F.lit(True)
    for m in BANDS:
        within &= (F.col(m) >= F.coalesce(f"{m}_low", F.lit(float("-inf")))) & (F.col(m) <= F.coalesce(f"{m}_high", F.lit(float("inf"))))
    return row.withColumn("kept", ~F.col("base_failed") & within).select("doc_id", "lang", *NAMES, "base_failed", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *NAMES[:5], "base_failed", "kept", *[F.round(m, 6).alias(m) for m in BANDS])
