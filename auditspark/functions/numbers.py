"""Exact comparison of JSON numbers with a decimal constant, in DataFrame functions only.

Spark's JSON functions read an exponent as a double and refuse very long numbers.  Where that would matter the number is
taken from a copy of the record in which every number outside strings is quoted, so that its spelling survives; most
records never need the copy.  A number is compared by sign, place of its first digit, and digits, whatever its length.

Undecided, and listed by ``number_doubt``, are records with a member given twice and texts that are no JSON value.
"""

from __future__ import annotations

import operator
import re

from pyspark.sql import Column, functions as F

from .records import variant, variant_type

NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_OPS = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
#: Powers of ten beyond this are compared as if they were this, and not accepted in a constant.
FAR = 1 << 60
#: Stands before a number in the copy, so that it is told from a string.
_MARK = "#"


def _spelled(text: str) -> tuple[int, int, str]:
    """(sign, place, digits) of a number: its value is sign * 0.digits * 10**place."""
    match = re.fullmatch(r"(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?", text)
    whole, fraction, power = match.group(2), match.group(3) or "", match.group(4) or "0"
    if len(power) > 18 or abs(int(power)) >= FAR:
        raise ValueError("a power of ten too large to compare with")
    led = (whole + fraction).lstrip("0")
    digits = led.rstrip("0")
    sign = 0 if not digits else -1 if match.group(1) else 1
    return sign, len(whole) + int(power) - (len(whole + fraction) - len(led)), digits


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _holds(text: Column, op: str, literal: str) -> Column:
    """Whether a text is a JSON number and ``number op literal``; a text that is no number is not taken apart."""
    return _once(text, lambda t: F.when(t.rlike(r"\A" + NUMBER + r"\z"), _once(_parts(t), lambda p: _compared(p, op, literal))).otherwise(F.lit(False)))


def _parts(text: Column) -> Column:
    """A number's sign, the digits before the point, all its digits without leading zeros, how many those zeros are, its power."""
    group = lambda pattern: F.regexp_extract(text, pattern, 1)
    split = F.struct(group(r"^-?([0-9]+)").alias("whole"), group(r"^-?[0-9]+\.([0-9]+)").alias("fraction"), group(r"[eE]([+-]?[0-9]+)\z").alias("power"))
    return _once(split, lambda s: _once(F.concat(s["whole"], s["fraction"]), lambda every: _once(F.ltrim(every, F.lit("0")), lambda led: F.struct(
        text.startswith("-").alias("minus"), F.length(s["whole"]).alias("whole"), (F.length(every) - F.length(led)).alias("zeros"),
        F.rtrim(led, F.lit("0")).alias("digits"), s["power"].alias("power")))))


def _compared(parts: Column, op: str, literal: str) -> Column:
    sign, place, digits = _spelled(literal)
    power, own_digits = parts["power"], parts["digits"]
    far = F.when(power.startswith("-"), -FAR).otherwise(FAR)
    exponent = F.when(power == "", 0).otherwise(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.coalesce(power.try_cast("bigint"), far))))
    own_place = parts["whole"] + exponent - parts["zeros"]
    own_sign = F.when(own_digits == "", 0).when(parts["minus"], -1).otherwise(1)
    below = (own_place < place) | ((own_place == place) & (own_digits < digits))
    equal = (own_place == place) & (own_digits == digits)
    # -1, 0 or 1: how the text's number lies to the constant
    size = F.when(equal, 0).when(below, -sign).otherwise(sign)
    lies = F.when(own_sign < sign, -1).when(own_sign > sign, 1).otherwise(size if sign else F.lit(0))
    return F.coalesce(_OPS[op](lies, F.lit(0)), F.lit(False))


def quoted_numbers(raw: Column) -> Column:
    """A copy of a JSON text in which numbers are marked strings.

    Escaped quotes and backslashes are blanked, so that every second piece between quotes lies outside strings.  A string
    that begins with the mark gets another one.
    """
    pieces = F.split(F.regexp_replace(raw, r'\\["\\]', "__"), '"')
    number = F.lit(r"(-?[0-9][-+.0-9eE]*)")
    return F.array_join(F.transform(pieces, lambda p, k: F.when(k % 2 == 0, F.regexp_replace(p, number, F.lit(f'"{_MARK}$1"')))
                                    .otherwise(F.regexp_replace(p, F.lit(f"^{_MARK}"), F.lit(_MARK * 2)))), '"')


def json_path(parts: list[str]) -> str:
    """Bracket path; member names may hold dots, blanks or one kind of quote."""
    quoted = []
    for part in parts:
        if "'" in part and '"' in part:
            raise ValueError(f"member name with both kinds of quotes: {part!r}")
        quoted.append(f'["{part}"]' if "'" in part else f"['{part}']")
    return "$" + "".join(quoted)


def spelled_copy(raw: str = "raw") -> Column:
    """The copy of a record in which numbers are marked strings, parsed; NULL where it is no JSON or gives a member twice."""
    return F.try_parse_json(quoted_numbers(F.col(raw)))


def number_doubt(raw: str = "raw", parsed: Column | None = None, copied: Column | None = None) -> Column:
    """Why the numbers of a record are not compared (they match nothing then), NULL for the other records."""
    unread = (variant(raw) if parsed is None else parsed).isNull() & (spelled_copy(raw) if copied is None else copied).isNull()
    twice = F.json_array_length(F.concat(F.lit("["), quoted_numbers(F.col(raw)), F.lit("]"))) == 1
    return F.when(F.col(raw).isNotNull() & unread, F.when(twice, "a member is given twice, so its number is not certain").otherwise("the text is no JSON value"))


def number_matches(field: str, op: str, literal: str, raw: str = "raw", parsed: Column | None = None,
                   copied: Column | None = None) -> Column:
    """Boolean column for ``field op literal``; ``resources.x`` means any element.  Records in doubt match nothing.

    Numbers and strings that spell one are compared.  ``parsed`` is the record as a variant, and ``copied`` its
    ``spelled_copy``, where a caller has made them as columns for several predicates.
    """
    if not re.fullmatch(NUMBER, literal):
        raise ValueError(f"{literal!r} is no number to compare with")
    if op not in _OPS:
        raise ValueError(f"unknown numeric comparison {op!r}")
    if '"' in field or "\\" in field:
        raise ValueError(f"numbers are not compared under a name with quotes or backslashes: {field!r}")
    v, parts = variant(raw) if parsed is None else parsed, field.split(".")
    copy = spelled_copy(raw) if copied is None else copied
    in_copy = lambda names: json_path([_MARK + n if n.startswith(_MARK) else n for n in names])

    def one(value: Column, path: str) -> Column:
        """A number is looked for where a member is, and a short whole one is compared as it is."""
        text, short = F.try_variant_get(value, path, "string"), r"-?(?:0|[1-9][0-9]{0,17})"
        quick = F.when(text.isNull(), F.lit(False))
        if re.fullmatch(short, literal):
            quick = quick.when(text.rlike(rf"\A{short}\z"), _OPS[op](text.cast("bigint"), F.lit(int(literal))))
        return quick.otherwise(_holds(text, op, literal))

    def marked(value: Column, path: str) -> Column:
        return _holds(F.regexp_replace(F.try_variant_get(value, path, "string"), f"^{_MARK}", ""), op, literal)

    if parts[0] != "resources" or len(parts) == 1:
        path = json_path(parts)
        return F.when(v.isNull() | (variant_type(v, path) == "DOUBLE"), marked(copy, in_copy(parts))).otherwise(one(v, path))
    path, whole = json_path(parts[1:]), json_path(parts)
    listed = lambda x: F.try_variant_get(x, "$.resources", "array<variant>")

    def within(x: Column, test, spell) -> Column:
        """A list, or one object."""
        return F.coalesce(F.exists(listed(x), lambda item: test(item, spell(parts[1:]))), test(x, spell(parts)))

    doubles = F.coalesce(F.exists(listed(v), lambda item: variant_type(item, path) == "DOUBLE"), variant_type(v, whole) == "DOUBLE", F.lit(False))
    return F.when(v.isNull() | doubles, within(copy, marked, in_copy)).otherwise(within(v, one, json_path))
