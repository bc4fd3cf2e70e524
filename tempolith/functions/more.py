"""Numeric, date, object, bit and geo functions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- numbers --------------------------------------------------------------------------------------


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def round_half_up(x: Column, digits: int = 0) -> Column:
    return F.round(x, digits)


def _decay(x: Column, origin: float, offset: float) -> Column:
    return F.greatest(F.lit(0.0), F.abs(x - origin) - offset)


def decay_gauss(x: Column, origin: float, scale: float, offset: float, decay: float) -> Column:
    s2 = -(scale**2) / (2 * math.log(decay))
    return F.exp(-(_decay(x, origin, offset) ** 2) / (2 * s2))


def decay_exp(x: Column, origin: float, scale: float, offset: float, decay: float) -> Column:
    return F.exp(math.log(decay) / scale * _decay(x, origin, offset))


def decay_linear(x: Column, origin: float, scale: float, offset: float, decay: float) -> Column:
    s = scale / (1 - decay)
    return F.greatest(F.lit(0.0), (s - _decay(x, origin, offset)) / s)


# --- dates ----------------------------------------------------------------------------------------

_UNITS = {"y": "YEAR", "year": "YEAR", "years": "YEAR", "m": "MONTH", "month": "MONTH", "months": "MONTH", "w": "WEEK", "week": "WEEK", "weeks": "WEEK", "d": "DAY", "day": "DAY", "days": "DAY",
          "h": "HOUR", "hour": "HOUR", "hours": "HOUR", "i": "MINUTE", "minute": "MINUTE", "minutes": "MINUTE", "s": "SECOND", "second": "SECOND", "seconds": "SECOND", "f": "MILLISECOND", "millisecond": "MILLISECOND", "milliseconds": "MILLISECOND"}
_MS = {"WEEK": 604800000, "DAY": 86400000, "HOUR": 3600000, "MINUTE": 60000, "SECOND": 1000, "MILLISECOND": 1}


def unit(name: str) -> str:
    return _UNITS[name.lower()]


def date_timestamp(t: Column) -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(t.cast("timestamp"))


def date_iso8601(t: Column) -> Column:
    return F.date_format(t.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_datestring(s: Column) -> Column:
    return F.try_to_timestamp(s).isNotNull() & s.rlike(r"^\d{4}")


def day_of_week(t: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(t) - 1


def iso_week(t: Column) -> Column:
    return F.weekofyear(t)


def iso_week_year(t: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), t).cast("int")


def leap_year(t: Column) -> Column:
    y = F.year(t)
    return (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))


def days_in_month(t: Column) -> Column:
    return F.dayofmonth(F.last_day(t.cast("date")))


def date_trunc(t: Column, name: str) -> Column:
    return F.date_trunc(unit(name), t.cast("timestamp"))


def date_round(ms: Column, amount: int, name: str) -> Column:
    """Milliseconds down to a whole number of units since 1970."""
    size = amount * _MS[unit(name)]
    return F.floor(ms / size) * size


def date_add(t: Column, amount: int, name: str) -> Column:
    return F.timestamp_add(unit(name), F.lit(amount), t.cast("timestamp"))


def date_subtract(t: Column, amount: int, name: str) -> Column:
    return date_add(t, -amount, name)


def date_diff(a: Column, b: Column, name: str, as_float: bool = False) -> Column:
    u = unit(name)
    if as_float and u in _MS:
        return (F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp"))) / float(_MS[u])
    return F.timestamp_diff(u, a.cast("timestamp"), b.cast("timestamp"))


def date_compare(a: Column, b: Column, down_to: str) -> Column:
    """Whether two times agree in all units from years down to one."""
    return date_trunc(a, down_to) == date_trunc(b, down_to)


#: Format tokens and what Spark's formatter calls them: fixed values.
_FORMAT = {"%yyyy": "yyyy", "%yy": "yy", "%mmmm": "MMMM", "%mmm": "MMM", "%mm": "MM", "%m": "M", "%dd": "dd", "%d": "d", "%hh": "HH", "%h": "H", "%ii": "mm", "%i": "m", "%ss": "ss", "%s": "s", "%fff": "SSS", "%q": "Q", "%x": "D", "%z": "XXX"}


def date_format(t: Column, pattern: str, zone: str | None = None) -> Column:
    """Date patterns such as %yyyy-%mm-%dd; %% is a percent sign."""
    t = t.cast("timestamp")
    if zone:
        t = F.from_utc_timestamp(t, zone)
    out, at = "", 0
    keys = "|".join(sorted(map(re.escape, _FORMAT), key=len, reverse=True))
    for m in re.finditer(rf"%%|{keys}", pattern):
        out += _quoted(pattern[at : m.start()]) + ("%" if m[0] == "%%" else _FORMAT[m[0]])
        at = m.end()
    return F.date_format(t, out + _quoted(pattern[at:]))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if re.search("[A-Za-z']", text) else text


# --- objects: maps of one value type ------------------------------------------------------------


def attributes(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def has(m: Column, key: str) -> Column:
    return F.map_contains_key(m, key)


def keep(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(*keys))


def unset(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def merge(*maps: Column) -> Column:
    """Later values win."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_without(out, m), m)
    return out


def _without(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))


def matches(m: Column, example: dict[str, str]) -> Column:
    ok = F.lit(True)
    for k, v in example.items():
        ok = ok & F.coalesce(F.try_element_at(m, F.lit(k)) == v, F.lit(False))
    return ok


def zip_object(keys: Column, values: Column) -> Column:
    return F.map_from_arrays(keys, values)


# --- bits -----------------------------------------------------------------------------------------


def bit_fold(a: Column, how: str) -> Column:
    """and, or, xor of an array of whole numbers."""
    zero = F.lit(-1 if how == "and" else 0).cast("long")
    f = {"and": lambda s, x: s.bitwiseAND(x), "or": lambda s, x: s.bitwiseOR(x), "xor": lambda s, x: s.bitwiseXOR(x)}[how]
    return F.aggregate(a, zero, lambda s, x: f(s, x.cast("long")))


def bit_negate(x: Column, bits: int) -> Column:
    return F.bitwise_not(x.cast("long")).bitwiseAND(F.lit((1 << bits) - 1))


def bit_shift_left(x: Column, n: int, bits: int) -> Column:
    return F.shiftleft(x.cast("long"), n).bitwiseAND(F.lit((1 << bits) - 1))


def bit_construct(positions: Column) -> Column:
    return F.aggregate(positions, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.pow(F.lit(2.0), x).cast("long")))


def bit_deconstruct(x: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.floor(x / F.pow(F.lit(2.0), i)) % 2 == 1)


def bit_to_string(x: Column, bits: int) -> Column:
    return F.lpad(F.bin(x.cast("long")), bits, "0")


def bit_from_string(s: Column) -> Column:
    return F.conv(s, 2, 10).cast("long")


# --- places -----------------------------------------------------------------------------------------

EARTH_M = 6371000.0


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.sin((p2 - p1) / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_range(lat1: Column, lon1: Column, lat2: Column, lon2: Column, low: float, high: float) -> Column:
    return distance_m(lat1, lon1, lat2, lon2).between(low, high)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a ring of (x, y): crossings of a ray, as one expression."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside = inside != crosses
    return inside
