"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content, Italian then English.
STOPWORDS_IT = "il la i le un una è e di a da in con su per tra fra che non mi ti si ci vi loro del della dei delle al alla ai alle sul sulla quel quello quella questo questa questi queste ma o se perché perche come essere avere ha sono era stato stata".split()
STOPWORDS_EN = "the a an is are was were be been being of to in on at with by for from and or but if not this that these those i you he she it we they what when where why how do does did".split()


#: Ranges whose compatibility decompositions aren't taken: Hangul syllables, and CJK compatibility ideographs.
KEPT = [(0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xD800, 0xDFFF)]


@lru_cache(maxsize=1)
def decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Characters of the basic plane whose decomposition (NFKD, without combining marks) is one other character, or several or none."""
    one, more = {}, {}
    for code in range(0x80, 0x10000):
        if any(lo <= code <= hi for lo, hi in KEPT):
            continue
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c:
            (one if len(plain) == 1 else more)[c] = plain
    return one, more


def unaccented(c: Column) -> Column:
    """Decomposed by compatibility (NFKD) and without combining marks, in the basic plane but for `KEPT`."""
    one, more = decompositions()
    gone = "".join(x for x, y in more.items() if not y)
    several = {x: y for x, y in more.items() if y}
    plain = F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, "".join(one) + gone, "".join(one.values())))
    table = F.str_to_map(F.lit("\x02".join(f"{x}\x01{y}" for x, y in several.items())), F.lit("\x02"), F.lit("\x01"))
    each = F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    # texts without such characters pass by; ASCII is told at once
    return F.when(plain.rlike(f"[\\x{{80}}-\\x{{FFFF}}&&[{''.join(several)}]]"), F.array_join(each, "")).otherwise(plain)


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def truncate_ellipsis(c: Column, n: int) -> Column:
    """At most n characters, the last of them an ellipsis if the text is longer."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def peek(c: Column, n: int) -> Column:
    """The text on one line, truncated."""
    return truncate_ellipsis(stripped(F.replace(c, F.lit("\n"), F.lit(" "))), n)


def excerpt(c: Column, n: int = 240) -> Column:
    """A source excerpt."""
    return peek(c, n)


def node_title(label: Column, text: Column, kind: Column, n: int = 60) -> Column:
    """A node's label, else its text on one line, else its kind capitalised."""
    flat = F.regexp_replace(stripped(text), r"\s+", " ")
    name = F.coalesce(kind, F.lit("paragraph"))
    last = F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))
    return F.coalesce(F.nullif(stripped(label), F.lit("")), F.nullif(truncate_ellipsis(flat, n), F.lit("")), last)


def normalize_text(c: Column) -> Column:
    """Lower case without accents and punctuation, single spaces."""
    plain = unaccented(F.lower(stripped(c)))
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}_]+", " "))


def normalize_token(c: Column) -> Column:
    """A word in lower case without punctuation."""
    return F.regexp_replace(F.lower(stripped(c)), r"[^\p{L}\p{N}_\s]+", "")


def content_words(c: Column, least: int = 4) -> Column:
    """The set of words of at least four letters that aren't stop words."""
    long = F.regexp_extract_all(F.lower(c), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0))
    return F.array_except(F.array_distinct(long), F.array(*map(F.lit, [*STOPWORDS_IT, *STOPWORDS_EN])))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; null if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def count_substring(c: Column, part: str) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def count_patterns(c: Column, patterns: list[str]) -> Column:
    """Matches of all patterns together."""
    total = F.lit(0).cast("long")
    for p in patterns:
        total += F.regexp_count(c, F.lit(p))
    return total


def mmss(seconds: Column) -> Column:
    """Whole seconds as MM:SS, minutes without bound."""
    s = F.floor(seconds)
    pad = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat(pad(F.floor(s / 60)), F.lit(":"), pad(s % 60))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    pick = lambda names, d: F.element_at(F.array(*map(F.lit, names)), (d + 1).cast("int"))
    return F.concat(pick(["", "M", "MM", "MMM"], F.floor(n / 1000)), pick(digits("C", "D", "M"), F.floor(n / 100) % 10), pick(digits("X", "L", "C"), F.floor(n / 10) % 10), pick(digits("I", "V", "X"), n % 10))


def alphabetic(n: Column) -> Column:
    """Bijective base-26 letters of 1 to 18278 (at most three)."""
    letter = lambda k: F.char(F.lit(97) + k)
    two, three = n - 27, n - 703
    return F.when(n <= 26, letter(n - 1)).when(n <= 702, F.concat(letter(F.floor(two / 26)), letter(two % 26))).otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))


def format_level(n: Column, depth: Column) -> Column:
    """A sibling number as written at that depth: arabic, from the third level roman, from the fourth letters."""
    return F.when(depth <= 2, n.cast("string")).when(depth == 3, roman(n)).otherwise(alphabetic(n))


def fallback_label(text: Column, kind: Column) -> Column:
    """The first six words, else the kind capitalised."""
    words = F.array_join(F.slice(F.split(stripped(text), r"\s+"), 1, 6), " ")
    return F.coalesce(F.nullif(words, F.lit("")), F.concat(F.upper(F.substring(kind, 1, 1)), F.substr(kind, F.lit(2))))


def clean_label(c: Column) -> Column:
    """Without white space at the ends, final dots and quotes around."""
    return F.regexp_replace(F.regexp_replace(stripped(c), r"\.+$", ""), "^[\"']+|[\"']+$", "")


def strip_fences(c: Column) -> Column:
    """What a fenced code block holds; else the text."""
    inner = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(c.contains("```") & (inner != ""), inner).otherwise(stripped(c))


def normalize_language(c: Column) -> Column:
    """it or en; null for anything else."""
    low = F.lower(stripped(c))
    return F.when(low.isin("it", "ita", "italian"), "it").when(low.isin("en", "eng", "english"), "en")


def detect_language(c: Column, default: str = "en") -> Column:
    """it or en by votes of stop words; the default where they tie."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    votes = lambda stop: F.size(F.filter(words, lambda w: w.isin(stop)))
    it, en = votes(STOPWORDS_IT), votes(STOPWORDS_EN)
    return F.when(it > en, "it").when(en > it, "en").otherwise(default)


def summarize_locator(kind: Column, lo: Column, hi: Column, label: Column) -> Column:
    """Where a passage stands in its source; page and slide 0 count as missing."""
    n = lambda c: c.cast("long").cast("string")
    span = lambda one, many: F.when(lo == hi, F.concat(F.lit(one), n(lo))).otherwise(F.concat(F.lit(many), n(lo), F.lit("-"), n(hi)))
    place = (
        F.when((kind == "pdf") & (lo > 0) & (hi > 0), span("p.", "p."))
        .when((kind == "slide") & (lo > 0) & (hi > 0), span("slide ", "slides "))
        .when((kind == "md") & lo.isNotNull() & hi.isNotNull(), F.concat(F.lit("char "), n(lo), F.lit("-"), n(hi)))
        .when((kind == "time") & lo.isNotNull() & hi.isNotNull(), F.concat(F.lit("T "), mmss(lo), F.lit("-"), mmss(hi)))
    )
    joined = F.concat_ws(", ", F.when(label != "", F.concat(F.lit("§"), label)), place)
    return F.when(joined == "", "(unknown location)").otherwise(joined)


def locator_fallback(summary: Column, excerpt_: Column, filename: Column) -> Column:
    """For an unknown location: the excerpt's first words, else the file's name, else the document."""
    flat = stripped(F.replace(stripped(F.coalesce(excerpt_, F.lit(""))), F.lit("\n"), F.lit(" ")))
    snippet = F.when(F.length(flat) > 60, F.concat(F.substring(flat, 1, 60), F.lit("…"))).otherwise(flat)
    quoted = F.when(flat != "", F.concat(F.lit('the paragraph starting with "'), snippet, F.lit('"')))
    return F.when(summary != "(unknown location)", summary).otherwise(F.coalesce(quoted, F.nullif(stripped(filename), F.lit("")), F.lit("the document")))


def word_at(c: Column, offset: Column) -> Column:
    """The run without white space around an offset; null where there is none."""
    left = F.regexp_extract(F.substr(c, F.lit(1), offset), r"[^\s]+\z", 0)
    right = F.regexp_extract(F.substr(c, offset + 1), r"^[^\s]*", 0)
    return F.nullif(F.concat(left, right), F.lit(""))
