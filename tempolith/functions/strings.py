"""String functions with 0-based positions, and name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find_first(s: Column, part: str, start: int = 0) -> Column:
    """Position from 0, -1 if absent."""
    return F.locate(part, s, start + 1) - 1


def find_last(s: Column, part: str) -> Column:
    at = F.locate(part[::-1], F.reverse(s))
    return F.when(at > 0, F.length(s) - at - len(part) + 1).otherwise(-1)


def substring0(s: Column, offset: int, length: int | None = None) -> Column:
    """From an offset counted from 0, or back from the end."""
    begin = F.lit(offset + 1 if offset >= 0 else offset)
    return F.substr(s, begin, F.lit(length)) if length is not None else F.substr(s, begin)


def substitute(s: Column, pairs: dict[str, str]) -> Column:
    for a, b in pairs.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def split0(s: Column, separator: str, limit: int = -1) -> Column:
    return F.split(s, f"\\Q{separator}\\E", limit)


def encode_uri_component(s: Column) -> Column:
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def crc32_hex(s: Column) -> Column:
    return F.lower(F.hex(F.crc32(s)))


def like(s: Column, pattern: str, insensitive: bool = False) -> Column:
    return s.ilike(pattern) if insensitive else s.like(pattern)


def ipv4_to_number(s: Column) -> Column:
    p = F.split(s, r"\.")
    part = lambda i: F.try_element_at(p, F.lit(i)).try_cast("long")
    ok = s.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    return F.when(ok, part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4))


def ipv4_from_number(n: Column) -> Column:
    byte = lambda k: (F.shiftright(n, k) % 256).cast("string")
    return F.when((n >= 0) & (n <= 4294967295), F.concat_ws(".", byte(24), byte(16), byte(8), byte(0)))


def is_ipv4(s: Column) -> Column:
    return ipv4_to_number(s).isNotNull()


def is_key(s: Column) -> Column:
    """Whether a string may be a document key."""
    return F.coalesce(s.rlike(r"^[A-Za-z0-9_\-:.@()+,=;$!*'%]{1,254}$"), F.lit(False))


def parse_identifier(s: Column) -> Column:
    """collection/key as a struct."""
    return F.struct(F.split_part(s, F.lit("/"), F.lit(1)).alias("collection"), F.split_part(s, F.lit("/"), F.lit(2)).alias("key"))


def edge_key(src: Column, dst: Column, kind: Column, n: int = 16) -> Column:
    """Deterministic key of an edge."""
    return F.substring(F.md5(F.concat_ws(":", src, dst, kind)), 1, n)


# --- names --------------------------------------------------------------------------------------

#: Words dropped from raw identifiers: fixed values.
KEYWORDS = ("reg", "wire", "input", "output", "assign")


def sanitize_id(s: Column) -> Column:
    """An identifier without keywords, white space and characters that keys can't have."""
    s = F.regexp_replace(s, rf"\b({'|'.join(KEYWORDS)})\b", "")
    s = F.regexp_replace(s, r"\s+", "")
    s = F.regexp_replace(s, r"[^a-zA-Z0-9_\-:.]", "_")
    return F.regexp_replace(s, r"^_+|_+$", "")


def normalize_name(s: Column, prefixes: tuple[str, ...]) -> Column:
    """Small letters, without the first known prefix, last dotted part, underscores as spaces."""
    s = F.lower(s)
    bare = F.coalesce(*[F.when(s.startswith(p), F.substr(s, F.lit(len(p) + 1))) for p in prefixes], s) if prefixes else s
    return F.trim(F.regexp_replace(F.substring_index(bare, ".", -1), "_+", " "))


def tokens_min3(s: Column) -> Column:
    """Distinct alphanumeric tokens of three or more characters."""
    return F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def acronym(s: Column) -> Column:
    """Initials of a name's words of letters and digits, in capitals."""
    w = F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda t: F.length(t) > 0)
    return F.upper(F.array_join(F.transform(w, lambda t: F.substring(t, 1, 1)), ""))


def expand_acronyms(s: Column, dictionary: dict[str, str]) -> Column:
    """Tokens, also cut before a capital after a small letter or digit, replaced by their expansion, others as they
    stand; null if nothing changes."""
    if not dictionary:
        return F.lit(None).cast("string")
    w = F.filter(F.split(s, "[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])"), lambda t: F.length(t) > 0)
    m = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in (kv[0].lower(), kv[1])])
    known = F.exists(w, lambda t: F.map_contains_key(m, F.lower(t)))
    return F.when(known, F.array_join(F.transform(w, lambda t: F.coalesce(F.try_element_at(m, F.lower(t)), t)), " "))


def strip_comments(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


def label_suffix(s: Column) -> Column:
    """After the first underscore; the whole label if there is none."""
    at = F.locate("_", s)
    return F.lower(F.when((at > 0) & (at < F.length(s)), F.substr(s, at + 1)).otherwise(s))
