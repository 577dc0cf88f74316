"""Times written in files to UTC epoch seconds, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: From here on a number is milliseconds; beyond this many seconds a column was misread.
MILLIS_FROM, MOST_SECONDS = 1e11, 1e11
_ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[Tt ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*(Z|z|[+-]\d{2}:?\d{2})?)?$"
#: Codes of a custom format, and what they match.
_CODES = {"Y": r"(?<Y>\d{4})", "y": r"(?<y>\d{2})", "m": r"(?<m>\d{1,2})", "d": r"(?<d>\d{1,2})", "H": r"(?<H>\d{1,2})", "M": r"(?<M>\d{1,2})", "S": r"(?<S>\d{1,2})", "f": r"(?<f>\d+)", "z": r"(?<z>Z|z|[+-]\d{2}:?\d{2})", "b": r"(?<b>[A-Za-z]{3})[A-Za-z]*"}
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _group(x: Column, pattern: str, k: int) -> Column:
    got = F.regexp_extract(x, pattern, k)
    return F.when(got != "", got)


def _epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, fraction: Column, zone: Column) -> Column:
    """Seconds from the parts; null where they are no date. 24:00:00 is the next midnight and second 60 the next minute."""
    number = lambda x, other=0: F.coalesce(x.cast("int"), F.lit(other))
    date = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))
    h, m, s = number(hour), number(minute), number(second)
    good = (m < 60) & (s <= 60) & ((h < 24) | ((h == 24) & (m == 0) & (s == 0)))
    digits = F.regexp_replace(zone, "[^0-9]", "")
    away = F.when(zone.isNull() | zone.isin("Z", "z"), 0).otherwise((F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1))
    part = F.round(F.coalesce(F.concat(F.lit("0."), fraction).try_cast("double"), F.lit(0.0))).cast("long")
    days = F.unix_date(date.cast("date")).cast("long")  # the same day whatever the session's time zone
    return F.when(good, days * 86_400 + h * 3600 + m * 60 + s + part - away)


def iso_seconds(x: Column) -> Column:
    return F.when(x.rlike(_ISO), _epoch(*[_group(x, _ISO, k) for k in range(1, 9)]))


def number_seconds(x: Column, scale: float | None = None) -> Column:
    """Epoch seconds or milliseconds; by size where no scale is stated."""
    v = x.try_cast("double")
    s = F.round(v * (F.when(F.abs(v) >= MILLIS_FROM, 1e-3).otherwise(1.0) if scale is None else F.lit(scale)))
    return F.when(~F.isnan(v) & (F.abs(s) <= MOST_SECONDS), s.cast("long"))


def check_format(text: str) -> list[str]:
    """A custom format's codes in order; it must hold a year and no code that is not known."""
    codes, k = [], 0
    while k < len(text):
        if text[k] == "%":
            code = text[k + 1 : k + 2]
            if code != "%" and code not in _CODES or not code:
                raise ValueError(f"not a time format: {text}")
            codes.append(code)
            k += 1
        k += 1
    if "Y" not in codes and "y" not in codes:
        raise ValueError(f"a time format without a year: {text}")
    return codes


def custom_seconds(x: Column, text: str) -> Column:
    codes = [c for c in check_format(text) if c != "%"]
    pattern, k, seen = "", 0, []
    while k < len(text):
        if text[k] == "%":
            k += 1
            pattern += "%" if text[k] == "%" else "(" + _CODES[text[k]].split(">", 1)[1]
            seen += [] if text[k] == "%" else [text[k]]
        else:
            pattern += "".join("\\" + c if not c.isalnum() else c for c in text[k])
        k += 1
    pattern = f"^{pattern}$"
    part = {c: _group(x, pattern, seen.index(c) + 1) for c in set(codes)}
    none = F.lit(None).cast("string")
    short = part["y"].cast("int") if "y" in part else None
    year = part["Y"] if "Y" in part else F.when(short < 70, 2000 + short).otherwise(1900 + short).cast("string")
    month = part.get("m", F.lit("1"))
    if "b" in part:
        found = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(part["b"]))
        month = F.when(found > 0, found.cast("string"))
    return F.when(x.rlike(pattern), _epoch(year, month, part.get("d", F.lit("1")), part.get("H", none), part.get("M", none), part.get("S", none), part.get("f", none), part.get("z", none)))


def seconds(x, how: str = "auto") -> Column:
    """how: auto, iso, epoch_s, epoch_ms or a custom format with % codes. Null where the text is no such time."""
    x = F.trim(F.col(x) if isinstance(x, str) else x)
    if how == "iso":
        return iso_seconds(x)
    if how in ("epoch_s", "epoch_ms"):
        return number_seconds(x, 1.0 if how == "epoch_s" else 1e-3)
    if how != "auto":
        return custom_seconds(x, how)
    return F.when(x.try_cast("double").isNotNull(), number_seconds(x)).otherwise(iso_seconds(x))
