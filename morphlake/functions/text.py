"""Columns for texts, numbers and dates with the language's own rules.

They differ from Spark's casts: texts of values read ``True``, ``None`` and
``1e+16``; numbers may have ``_`` between digits; only a few words are
booleans; dates are read and written by ``%`` directives.
"""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = " \t\n\r\x0b\x0c"


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integer(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def _double_text(x: Column) -> Column:
    """Shortest digits; an exponent only below 1e-4 and from 1e16 on."""
    shown = F.abs(x).cast("string")
    mantissa = F.regexp_replace(F.regexp_replace(shown, r"E.*$", ""), r"\.0$", "")
    exponent = F.regexp_extract(shown, r"E(-?\d+)$", 1).cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    placed = F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)).otherwise(
        F.when(F.length(digits) <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))).otherwise(
            F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.lit(400)))
        )
    )
    powered = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.length(F.abs(exponent).cast("string")), F.lit(2)), F.lit("0")))
    plain = F.when(~shown.contains("E"), shown).when((exponent >= -4) & (exponent < 16), placed).otherwise(powered)
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf")))
        .otherwise(F.concat(sign, plain))
    )


def as_text(x: Column, kind: T.DataType) -> Column:
    """The text of a value; a null reads ``None``."""
    if isinstance(kind, T.NullType):
        return F.lit("None")
    if isinstance(kind, T.BooleanType):
        shown = F.when(x, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        shown = _double_text(x.cast("double"))
    elif isinstance(kind, T.StringType) or is_number(kind):
        shown = x.cast("string")
    else:
        raise TypeError(f"text of {kind.simpleString()} is only known record by record")
    return F.when(x.isNull(), F.lit("None")).otherwise(shown)


def _stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANK))


def to_integer(x: Column, kind: T.DataType) -> Column:
    """Null where it cannot be read."""
    if isinstance(kind, T.StringType):
        text = _stripped(x)
        return F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("bigint"))
    if is_integer(kind):
        return x.cast("bigint")
    if is_number(kind):
        value = x.cast("double")
        # beyond 64 bits there is no integer column; such rows are errors
        return F.when(~F.isnan(value) & (value > -9.3e18) & (value < 9.3e18), value.try_cast("bigint"))
    return F.lit(None).cast("bigint")


_FLOAT = r"(?i)^[+-]?(?:(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?|inf(?:inity)?|nan)$"


def to_number(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        text = _stripped(x)
        plain = F.lower(F.replace(text, F.lit("_"), F.lit("")))
        special = (
            F.when(plain.endswith("nan"), F.lit(float("nan")))
            .when(plain.rlike(r"^-inf"), F.lit(float("-inf")))
            .when(plain.rlike(r"^\+?inf"), F.lit(float("inf")))
        )
        return F.when(text.rlike(_FLOAT), F.when(plain.rlike(r"nan|inf"), special).otherwise(plain.try_cast("double")))
    if is_number(kind):
        return x.cast("double")
    return F.lit(None).cast("double")


def to_boolean(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        return x
    if is_number(kind):
        return F.when(x == 1, F.lit(True)).when(x == 0, F.lit(False))
    if isinstance(kind, T.StringType):
        word = F.lower(x)
        return F.when(word.isin("true", "1", "yes"), F.lit(True)).when(word.isin("false", "0", "no"), F.lit(False))
    return F.lit(None).cast("boolean")


# -- dates -----------------------------------------------------------------

_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Directive: what it reads, and the part of a date it gives.
_READ = {
    "Y": (r"((?!0000)[0-9]{4})", "year"),
    "y": (r"([0-9]{2})", "short_year"),
    "m": (r"(1[0-2]|0[1-9]|[1-9])", "month"),
    "d": (r"(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])", "day"),
    "H": (r"(2[0-3]|[01][0-9]|[0-9])", "hour"),
    "M": (r"([0-5][0-9]|[0-9])", "minute"),
    "S": (r"(6[01]|[0-5][0-9]|[0-9])", "second"),  # 60 and 61 are read, and are no time
    "j": (r"(36[0-6]|3[0-5][0-9]|[12][0-9]{2}|0[1-9][0-9]|00[1-9]|[1-9][0-9]|0[1-9]|[1-9])", "day_of_year"),
    "b": ("((?i)" + "|".join(m[:3] for m in _MONTHS) + ")", "month_name"),
    "B": ("((?i)" + "|".join(_MONTHS) + ")", "month_name"),
}
#: Between the parts of a date, and what stands for it in texts.
_CUT, _NO_CUT = "\x01", "\x02"
_WRITE = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "j": "DDD"}


class DateFormatError(ValueError):
    """A directive that is not known."""


def _directives(form: str) -> list[tuple[str, str]]:
    """``(directive, "")`` and ``("", literal)`` in order."""
    out = []
    for m in re.finditer(r"%(.?)|[^%]+", form, re.DOTALL):
        if m[1] is None:
            out.append(("", m[0]))
        elif m[1] == "%":
            out.append(("", "%"))
        else:
            out.append((m[1], ""))
    return out


def date_pattern(form: str) -> tuple[str, dict[str, int]]:
    """The regular expression of a format, and which group each part of a date is."""
    pattern, parts = "", {}
    for directive, literal in _directives(form.replace(_CUT, _NO_CUT)):
        if literal:
            # white space in a format stands for any
            pattern += "".join(r"\s+" if c.isspace() else re.escape(c) for c in re.sub(r"\s+", " ", literal))
            continue
        if directive not in _READ:
            raise DateFormatError(f"%{directive} cannot be read")
        regex, part = _READ[directive]
        if part in parts:
            raise DateFormatError(f"%{directive} is given twice")
        pattern += regex
        parts[part] = len(parts) + 1
    return f"\\A(?:{pattern})\\z", parts


def _cut(text: Column, pattern: Column, n_parts: int) -> Column:
    found = _CUT + _CUT.join(f"${k}" for k in range(1, n_parts + 1))
    return F.split(F.regexp_replace(F.translate(text, _CUT, _NO_CUT), pattern, F.lit(found)), _CUT, -1)


def _full_year(short: Column) -> Column:
    return F.concat(F.when(short >= "69", F.lit("19")).otherwise(F.lit("20")), short)


def _month_number(name: Column) -> Column:
    names = "".join(m[:3] for m in _MONTHS)
    return ((F.position(F.lower(F.substring(name, 1, 3)), F.lit(names)) + 2) / 3).cast("int").cast("string")


def _day_date(year: Column, day_of_year: Column) -> Column:
    first = F.try_to_timestamp(F.concat(year, F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    return F.date_format(F.date_add(first.cast("date"), day_of_year.try_cast("int") - 1), "yyyy-M-d")


def read_date(text: Column, form: str) -> Column:
    """A timestamp, null where the text does not follow the format.

    The text is matched once: the parts come out of one replacement, cut at a
    character that the text cannot have any more, and are null without a match.
    Nothing stands in a branch, so Catalyst evaluates each expression once."""
    return read_date_at(text, *date_pattern(form))


def read_date_at(text: Column, pattern: str, parts: dict[str, int]) -> Column:
    """``read_date`` by what ``date_pattern`` says of the format."""
    cut = _cut(text, F.lit(pattern), len(parts))

    def get(part: str, default: str) -> Column:
        return F.btrim(F.get(cut, F.lit(parts[part]))) if part in parts else F.lit(default)

    year = get("year", "1900")
    if "short_year" in parts and "year" not in parts:
        year = _full_year(get("short_year", "00"))
    month = get("month", "1")
    if "month_name" in parts:
        month = _month_number(get("month_name", ""))
    if "day_of_year" in parts and not {"month", "month_name", "day"} & parts.keys():
        date = _day_date(year, get("day_of_year", "1"))
    else:
        date = F.concat(year, F.lit("-"), month, F.lit("-"), get("day", "1"))
    # a format without any directive still has to match
    matched = [] if parts else [F.get(cut, F.lit(1))]
    made = F.concat(*matched, date, F.lit(" "), get("hour", "0"), F.lit(":"), get("minute", "0"), F.lit(":"), get("second", "0"))
    return F.try_to_timestamp(made, F.lit("yyyy-M-d H:m:s"))


def read_date_by(text: Column, pattern: Column, parts: Column) -> Column:
    """``read_date`` where the format is data: the pattern, and the map from parts
    to groups, of ``date_pattern``."""
    groups = F.map_values(parts)
    found = F.concat(F.lit(_CUT), F.array_join(F.transform(groups, lambda k: F.concat(F.lit("$"), k.cast("string"))), _CUT))
    cut = F.split(F.regexp_replace(F.translate(text, _CUT, _NO_CUT), pattern, found), _CUT, -1)

    def from_cut(c: Column) -> Column:
        has = lambda part: F.try_element_at(parts, F.lit(part)).isNotNull()
        get = lambda part, default: F.when(has(part), F.btrim(F.get(c, F.try_element_at(parts, F.lit(part))))).otherwise(F.lit(default))
        year = F.when(has("short_year") & ~has("year"), _full_year(get("short_year", "00"))).otherwise(get("year", "1900"))
        month = F.when(has("month_name"), _month_number(get("month_name", ""))).otherwise(get("month", "1"))
        by_day = has("day_of_year") & ~has("month") & ~has("month_name") & ~has("day")
        date = F.when(by_day, _day_date(year, get("day_of_year", "1"))).otherwise(F.concat(year, F.lit("-"), month, F.lit("-"), get("day", "1")))
        matched = F.when(F.size(parts) == 0, F.get(c, F.lit(1))).otherwise(F.lit(""))
        made = F.concat(matched, date, F.lit(" "), get("hour", "0"), F.lit(":"), get("minute", "0"), F.lit(":"), get("second", "0"))
        return F.try_to_timestamp(made, F.lit("yyyy-M-d H:m:s"))

    return F.get(F.transform(F.array(cut), from_cut), F.lit(0))


def date_pieces(form: str) -> list[str]:
    """Patterns whose results side by side are a date in this format: one, but
    for directives of one letter side by side, which would run together."""
    pieces, last = [""], ""
    for literal, group in groupby(_directives(form), key=lambda d: not d[0]):
        if literal:
            pieces[-1] += "'" + "".join(text for _, text in group).replace("'", "''") + "'"
            last = ""
            continue
        for directive, _ in group:
            if directive not in _WRITE:
                raise DateFormatError(f"%{directive} cannot be written")
            if _WRITE[directive][0] == last:
                pieces.append("")
            last = _WRITE[directive][0]
            pieces[-1] += _WRITE[directive]
    return [] if pieces == [""] else pieces


def write_date_by(x: Column, pieces: Column) -> Column:
    """``write_date`` where the format is data: the list of ``date_pieces``."""
    made = F.array_join(F.transform(pieces, lambda p: F.call_function("date_format", x, p)), "")
    return F.when(x.isNotNull(), made)


def write_date(x: Column, form: str) -> Column:
    """A date as text; null for null."""
    return write_date_at(x, date_pieces(form))


def write_date_at(x: Column, pieces: list[str]) -> Column:
    """``write_date`` by what ``date_pieces`` says of the format."""
    if not pieces:
        return F.when(x.isNotNull(), F.lit(""))
    made = [F.date_format(x, piece) for piece in pieces]
    return F.concat(*made) if len(made) > 1 else made[0]


def split_item(text: Column, separator: str, index: int) -> Column:
    """An item of a text cut at a literal separator; null out of range.
    Negative indexes count from the end."""
    items = F.split(text, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    return F.get(items, F.lit(index) if index >= 0 else F.size(items) + index)
