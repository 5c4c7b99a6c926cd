"""Text normalization: compatibility forms, zero-width characters, case, look-alike digits, separators."""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gatewarden.rules import Normalize

# Fixed values.
ZERO_WIDTH = "​‌‍⁠﻿"
LEET_FROM, LEET_TO = "01|34@5$78", "oiieaasstb"
SEPARATORS = "-._*~"
SPELLED = r"[0-9A-Za-z](?:[-._*~][0-9A-Za-z]){3,}"


def zero_width(text: Column) -> Column:
    for c in ZERO_WIDTH:  # few texts have any; a search for each is cheaper than a look at every character
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def lower(text: Column) -> Column:
    """Case by character, whatever its neighbours: a final sigma is like any other."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def leet(text: Column) -> Column:
    return F.translate(text, LEET_FROM, LEET_TO)


def spaces(text: Column) -> Column:
    """Runs of space, tab and line ends become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r" [ \n\r\t]+|[\n\r\t][ \n\r\t]*", " "))


#: Stands for no character; put around matches. Texts that hold it all the same go the longer way.
MARK = "\uffff"


def let(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def parted(text: Column, pattern: str) -> Column:
    """The text cut at the matches of a pattern: what is before the first, the first, what is between, the second, and so on.

    One search: matches are marked where they stand, and the text is cut at the marks.
    """
    quick = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(pieces, found, lambda p, m: F.when(m.isNull(), F.array(p)).otherwise(F.array(p, m)))
    return F.when(F.contains(text, F.lit(MARK)), F.flatten(both)).otherwise(quick)


def interleaved(text: Column, pattern: str, change) -> Column:
    """The text with each match of a pattern changed by a function of a Column."""
    made = lambda parts: F.when(F.size(parts) > 1, F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, change(x)).otherwise(x)), "")).otherwise(text)
    return let(parted(text, pattern), made)


def collapse_separators(text: Column) -> Column:
    """``j-a-i-l`` becomes ``jail``: four or more ASCII letters or digits with a separator between each two."""
    return interleaved(text, SPELLED, lambda m: F.translate(m, SEPARATORS, ""))


def normalized(text: Column, options: Normalize = Normalize()) -> Column:
    """All steps but the compatibility form, in their fixed order."""
    if options.zero_width:
        text = zero_width(text)
    text = lower(text)
    if options.leet:
        text = leet(text)
    text = spaces(text)
    return collapse_separators(text) if options.separators else text


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # the array library's own function leaves characters decomposed
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


#: Runs of so many letters and more that no compatibility form changes are told by a pattern.
PLAIN_RUN = 64


@functools.cache
def plain_letters() -> str:
    """Inside of a character class: code points that stay as they are, and never join with what is before them.

    A text of these alone is its own compatibility form. The class need not be complete: texts with other letters are formed.
    """
    def plain(c: int) -> bool:
        x = chr(c)
        return not (0x1100 <= c <= 0x11FF or 0xD800 <= c <= 0xDFFF) and unicodedata.category(x)[0] != "M" and unicodedata.combining(x) == 0 and unicodedata.normalize("NFKC", x) == x

    runs: list[list[int]] = []
    for c in range(0x10000):
        if plain(c):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    # all of the first letters, and long runs beyond them
    chosen = [(a, b) for a, b in runs if a < 0x100 or b - a + 1 >= PLAIN_RUN]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in chosen)


def compatible(text: Column) -> Column:
    """The compatibility form; only texts with letters that it may change are sent to Python, as others are their own."""
    # a look at ASCII first, as most letters are of it and the class is long
    other = F.regexp_like(text, F.lit(rf"(?=[^\x00-\x7F])[^{plain_letters()}]"))
    return F.coalesce(_nfkc(F.when(other, text)), text)


def with_normalized(df: DataFrame, text: str, out: str, options: Normalize = Normalize()) -> DataFrame:
    """Adds the normalized text, in one read of the rows."""
    df = df.withColumn(out, compatible(F.col(text)) if options.nfkc else F.col(text))
    return df.withColumn(out, normalized(F.col(out), options))


def normalized_literal(pattern: str, options: Normalize = Normalize()) -> str:
    """What ``normalized`` makes of a rule's literal, on the driver. Empty results are refused."""
    if options.nfkc and not pattern.isascii():
        pattern = unicodedata.normalize("NFKC", pattern)
    if options.zero_width:
        pattern = pattern.translate({ord(c): None for c in ZERO_WIDTH})
    pattern = "".join(c.lower() for c in pattern)
    if options.leet:
        pattern = pattern.translate(str.maketrans(LEET_FROM, LEET_TO))
    import re

    pattern = re.sub(r"[ \n\r\t]+", " ", pattern).strip(" ")
    if options.separators:
        pattern = re.sub(SPELLED, lambda m: m[0].translate({ord(c): None for c in SEPARATORS}), pattern)
    if not pattern:
        raise ValueError("a literal that is empty once normalized would match everything")
    return pattern
