"""Column expressions shared by the operators; all of them JVM-side."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CITATION = r"\[Memory\s+(\d+)\]"
HASH_DIM = 32  # SHA-256 has 32 bytes; longer embeddings tile them


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(strip(c)), F.lit(0)) == 0


def non_empty(c: Column | str) -> Column:
    """Null for null and for the empty text."""
    return F.nullif(col(c), F.lit(""))


def or_default(c: Column | str, default: str) -> Column:
    return F.coalesce(non_empty(c), F.lit(default))


def preview(c: Column | str, n: int = 300) -> Column:
    return F.substring(col(c), 1, n)


def index_text(title: Column | str = "title", content: Column | str = "content") -> Column:
    """Text that is embedded: title and content, skipping empty ones."""
    return F.concat_ws(" ", non_empty(title), non_empty(content))


def entity_key(tenant: Column | str, kind: str, external: Column | str) -> Column:
    return F.concat(or_default(tenant, "global"), F.lit(f":{kind}:"), col(external))


def source_key(tenant: Column | str, source_type: Column | str, source_id: Column | str) -> Column:
    tail = F.coalesce(F.concat(F.lit(":"), non_empty(source_id)), F.lit(""))
    return F.concat(or_default(tenant, "global"), F.lit(":source:"), col(source_type), tail)


def is_uuid(c: Column | str) -> Column:
    return F.coalesce(F.lower(col(c)).rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), F.lit(False))


def is_tz_aware(c: Column | str) -> Column:
    """An ISO-8601 text with a zone; null passes."""
    return F.coalesce(col(c).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(True))


def iso(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss")


def time_or_now(c: Column | str, now: datetime | None = None) -> Column:
    """The time itself, or ``now`` (the current time if none is given) where it is missing; without zone, in UTC."""
    at = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if now is None else F.lit(now)
    return F.coalesce(col(c).cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def token_count(c: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda t: t != ""))


def occurrences(c: Column | str, part: str) -> Column:
    return ((F.length(col(c)) - F.length(F.replace(col(c), F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def split_ids(c: Column | str) -> Column:
    """Items between commas, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(col(c), ","), strip), lambda x: x != "")


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(c), "[.!?]+"), strip), lambda s: s != "")


def citations(c: Column | str) -> Column:
    """Numbers cited as [Memory n], in order. A number beyond the long range is -1, which is never valid."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(CITATION), F.lit(1)), lambda x: F.coalesce(x.try_cast("long"), F.lit(-1)))


def hash_embedding(text: Column | str, dim: int = 128) -> Column:
    """Deterministic embedding: byte b of the text's SHA-256 becomes b / 128 - 1, tiled to ``dim``."""
    numbers = lambda digest: F.transform(F.sequence(F.lit(0), F.lit(HASH_DIM - 1)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 128.0 - 1.0)
    # the digest is an array's element, so that it is computed once and not for each of the 32 numbers
    own = F.transform(F.array(F.sha2(F.coalesce(col(text), F.lit("")), 256)), numbers)[0]
    tiles = -(-dim // HASH_DIM)
    return F.slice(F.flatten(F.array_repeat(own, tiles)), 1, dim) if tiles > 1 else F.slice(own, 1, dim)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def conjunction(parts: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, parts, F.lit(True))
