"""Scalar functions on columns: lists in text, labels, compact numbers, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_MARK = "␀"

#: How fragments of labels are written.
FRAGMENTS = {
    " And ": " and ",
    " Based ": "-Based ",
    " Eu ": " EU ",
    " For ": " for ",
    " Non ": " Non-",
    " Of ": " of ",
    " On ": " on ",
    " Or ": " or ",
    " Specific ": "-Specific ",
    " To ": " to ",
}
WHOLE_LABELS = {"Eea": "EU+IS+LI+NO", "Eea No Is": "EU+LI+NO"}
CODE_PREFIX = "^(STATEMENT_CATEGORY_|KEYWORD_)"


def parse_list(c: Column) -> Column:
    """Bracketed list text to an array; quotes go, empty items go, null stays null.

    Unquoted items are accepted, which is why this isn't a JSON parser.
    """
    inner = F.regexp_replace(c, r'^\[|\]$|"', "")
    return F.filter(F.split(inner, ","), lambda x: x != "")


def empty_to_null(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def group_lists(c: Column, groups: dict[str, list[str]]) -> Column:
    """Collapses a list text that equals a known list, in its order, to the group's name in brackets."""
    out = c
    for name, members in groups.items():
        literal = "[" + ",".join(f'"{m}"' for m in members) + "]"
        out = F.when(c == literal, F.lit(f'["{name}"]')).otherwise(out)
    return out


def title_case(c: Column) -> Column:
    """Capitals after anything that is no letter (digits, dashes, apostrophes), small letters elsewhere."""
    words = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def humanize(c: Column) -> Column:
    """A label from a code: prefix off, underscores to spaces, title case; two-letter capitals stay; null is —None—."""
    plain = F.translate(F.regexp_replace(c, CODE_PREFIX, ""), "_", " ")
    title = title_case(plain)
    for old, new in FRAGMENTS.items():
        title = F.replace(title, F.lit(old), F.lit(new))
    for old, new in WHOLE_LABELS.items():
        title = F.when(title == old, new).otherwise(title)
    short = (F.char_length(plain) == 2) & (plain == F.upper(plain))
    return F.when(c.isNull(), "—None—").when(short, plain).otherwise(title)


def normalize_code(c: Column, prefix: str) -> Column:
    """A user's spelling of a code: upper case, dashes and spaces to underscores, prefixed once."""
    code = F.translate(F.upper(F.trim(c)), "- ", "__")
    return F.when(code.startswith(prefix), code).otherwise(F.concat(F.lit(prefix), code))


def minify(c: Column) -> Column:
    """A non-negative number with three digits and K, M, B or T.

    The number of digits before the point decides unit and precision.
    """
    out = None
    for digits in range(13, 2, -1):
        unit, more = divmod(digits - 1, 3)
        shown = F.concat(F.format_number(c.cast("double") / 1000.0**unit, 2 - more), F.lit(" KMBT"[unit].strip()))
        out = shown if out is None else F.when(c < 10**digits, shown).otherwise(out)
    return F.when(c.isNotNull(), out)


def upper_limit(c: Column, digits: int = 2, floor: int = 100) -> Column:
    """The least number not under c and floor whose digits after the first ``digits`` are zeros."""
    at_least = F.when(c > floor, c).otherwise(F.lit(floor)).cast("long")
    zeros = F.greatest(F.floor(F.log10(at_least.cast("double"))) + 1 - digits, F.lit(0))
    step = F.rpad(F.lit("1"), (zeros + 1).cast("int"), F.lit("0")).cast("long")
    return at_least + F.pmod(-at_least, step)


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))


def ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def percent(a: Column, b: Column) -> Column:
    return ratio(a, b) * F.lit(100.0)
