"""Keys, codes and dates from text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters dropped without a gap.
APOSTROPHES = "'’`"
OPENING, CLOSING = "([{", ")]}"


def _plain(text: str) -> str:
    depth, kept = 0, []
    for char in text:
        if char in OPENING:
            depth += 1
            kept.append(" ")
        elif char in CLOSING:
            depth = max(0, depth - 1)
            kept.append(" ")
        elif not depth:
            kept.append(char)
    bare = unicodedata.normalize("NFD", "".join(kept).lower())
    bare = unicodedata.normalize("NFC", "".join(c for c in bare if unicodedata.category(c) != "Mn"))
    bare = "".join(c for c in bare if c not in APOSTROPHES)
    spaced = "".join(c if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in bare)
    return " ".join(spaced.split())


@F.pandas_udf(StringType())
def _normal(text: pd.Series) -> pd.Series:
    distinct = {t: _plain(t or "") for t in text.unique()}
    return text.map(distinct)


def split_primary(artists: Column) -> Column:
    """First non-blank name of ``a;b;c``."""
    names = F.filter(F.transform(F.split(artists, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(names, F.lit(0))


def match_key(title: Column, artists: Column) -> Column:
    """``artist|title``, both without case, diacritics, brackets and punctuation; the title ends at its first `` - ``."""
    at = F.instr(title, " - ")
    short = F.when(at > 1, F.substr(title, F.lit(1), at - 1)).otherwise(title)
    return F.concat(_normal(F.coalesce(split_primary(artists), F.lit(""))), F.lit("|"), _normal(F.coalesce(short, F.lit(""))))


def split_credits(credits: Column) -> Column:
    """Names of ``a;b;c`` in order, trimmed, blanks dropped, one spelling (the first) for names equal but for case."""
    names = F.filter(F.transform(F.split(credits, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(
        names,
        F.array().cast("array<string>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x))),
    )


def derived_id(*parts: Column) -> Column:
    joined = F.concat_ws("\x1f", *(F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts))
    return F.concat(F.lit("csv:"), F.left(F.sha2(joined, 256), F.lit(32)))


def isrc(code: Column) -> Column:
    """The code without separators in upper case, or null if it isn't one."""
    bare = F.upper(F.regexp_replace(code, "[\\s-]", ""))
    return F.when(bare.rlike("^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), bare)


def release_date(raw: Column) -> tuple[Column, Column, Column]:
    """(year, precision, exact date) of ``yyyy``, ``yyyy-MM`` or ``yyyy-MM-dd``; nulls for anything else."""
    text = F.trim(raw)
    day = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    month = F.when(text.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.left(text, F.lit(4)).cast("int"))
    year = F.when(text.rlike("^[0-9]{4}$"), text.cast("int"))
    found = F.coalesce(F.year(day), month, year)
    found = F.when(found >= 1000, found)
    precision = F.when(found.isNull(), None).when(day.isNotNull(), "day").when(month.isNotNull(), "month").otherwise("year")
    return found, precision, F.when(found.isNotNull(), day)


def duration_label(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.concat((F.floor(seconds / 60)).cast("string"), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


#: Fixed value: characters that are kept of names.
MOST_CHARACTERS = 400


def truncated(text: Column, most: int = MOST_CHARACTERS) -> Column:
    return F.left(text, F.lit(most))
