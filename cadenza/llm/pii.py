"""Personal data in texts: regular expressions propose, checksums confirm, nearby words adjust the score.

Everything is made of built-in functions: no Python runs on the executors. ``split`` gives the stretches between the
matches of a pattern and ``regexp_extract_all`` the matches; both walk the same leftmost non-overlapping matches, so
running lengths give positions in code points. Running lengths are summed in blocks, and stretches of a text are cut from pieces
of bounded size, so that the work stays in proportion to a text with very many matches too. The patterns are possessive where nothing could follow a retry and
anchored at the start of a run of their own characters: the same matches, in time linear in the text and without a
stack that grows with it.

Defined results: a null text counts as the empty text, which has no spans; repeated rows give repeated results; an
empty table gives an empty one; texts of any length and number of matches are taken whole; all columns of the input
stay, but for one named as the result, which is replaced; the result's name is the caller's choice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
#: Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": "(?<![A-Za-z0-9_])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto",
    "ssn": "ssn|social security|tax",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT_BONUS, CONTEXT_REACH, ADDED_LEAST = 0.3, 40, 0.5
#: Values summed at once, and characters in one piece of a text; neither changes a result.
BLOCK, PIECE = 128, 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _codes(text: Column) -> Column:
    """Code of each character; of an empty text none."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substr(text, i, F.lit(1))))).otherwise(F.array().cast("array<int>"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    weighed = F.transform(_codes(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c - 48).otherwise((c - 48) * 2 - F.when(c - 48 > 4, 9).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces passes ISO 7064's check."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    return F.aggregate(_codes(turned), F.lit(0), lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97) == 1


def _octets(match: Column) -> Column:
    bare = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(bare, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return _octets(match)
    if kind == "card":
        return F.when(F.length(digits) <= 19, luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)") & ~match.rlike("^...-00-") & ~match.rlike("-0000$")
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each value all up to it, itself included, under ``join`` (a sum or a maximum of integers from 0).

    Block by block: appending to one array for each value would copy that array each time.
    """
    none = F.array().cast("array<int>")
    zero = F.lit(0)

    def grown(values: Column, first: Column) -> Column:
        """The running results of some values after ``first``."""
        start = F.struct(first.alias("last"), none.alias("all"))

        def step(state: Column, v: Column) -> Column:
            return _let(join(state["last"], v), lambda now: F.struct(now.alias("last"), F.concat(state["all"], F.array(now)).alias("all")))

        return F.aggregate(values, start, step, lambda state: state["all"])

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, join))
        return _let(grown(totals, zero), lambda ends: F.flatten(F.transform(blocks, lambda b, i: grown(b, F.when(i > 0, F.get(ends, i - 1)).otherwise(zero)))))

    def dealt(values: Column) -> Column:
        blocks = F.transform(F.sequence(zero, F.ceil(F.size(values) / BLOCK).cast("int") - 1), lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(values) > 0, _let(blocks, whole)).otherwise(none)

    return _let(values, dealt)


def _pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end`` of the text that ``pieces`` make."""
    first = F.floor(start / PIECE).cast("int")
    near = F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1)
    return F.substr(F.array_join(near, ""), start - first * PIECE + 1, end - start)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind: array of (kind, start, end, score), by start."""
    pattern = PATTERNS[kind]
    one = F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"))
    none = F.slice(F.array(one), 1, 0)

    def rated(pieces: Column, match: Column, end: Column) -> Column:
        start = end - F.length(match)
        # from the whole text: other matches, confirmed or not, don't cut the context short
        before, after = _cut(pieces, F.greatest(start - CONTEXT_REACH, F.lit(0)), start), _cut(pieces, end, end + CONTEXT_REACH)
        near = F.lower(before).rlike(CONTEXT[kind]) | F.lower(after).rlike(CONTEXT[kind])
        score = F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))

    def spans(matches: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
        placed = F.zip_with(matches, _running(lengths, lambda a, b: a + b), lambda m, e: F.struct(m.alias("match"), e.alias("end")))
        good = F.filter(placed, lambda p: confirmed(kind, p["match"]))
        scored = _let(_pieces(text), lambda pieces: F.transform(good, lambda p: rated(pieces, p["match"], p["end"])))
        return scored if kind in BASE_KINDS else F.filter(scored, lambda s: s["score"] >= ADDED_LEAST)

    found = _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: F.when(F.size(matches) > 0, spans(matches)).otherwise(none))
    return F.when(F.contains(text, F.lit(HINTS[kind])), found).otherwise(none) if kind in HINTS else found


def with_spans(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``df`` with ``out``: all spans, by kind as listed in ``BASE_KINDS`` and ``ADDED_KINDS`` and then by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(out, F.concat(*(kind_spans(text, k) for k in BASE_KINDS + ADDED_KINDS)))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark in place of each stretch that spans cover; overlapping ones give the mark of the first."""
    text = F.coalesce(text, F.lit(""))
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def marked(placed: Column, reached: Column, pieces: Column) -> Column:
        """Of each span that begins past all before it: the text since those, and its mark; then the text that is left."""
        kept = F.filter(
            F.transform(placed, lambda s, i: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), F.when(i > 0, F.get(reached, i - 1)).otherwise(F.lit(0)).alias("since"))),
            lambda s: s["start"] >= s["since"],
        )
        parts = F.transform(kept, lambda s: F.concat(_cut(pieces, s["since"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), _cut(pieces, F.element_at(reached, -1), F.length(text)))

    done = _let(placed, lambda p: _let(_running(F.transform(p, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda reached: _let(_pieces(text), lambda pieces: marked(p, reached, pieces))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, (s["kind"] == k for k in BASE_KINDS)))
