"""Scalar text functions as Column expressions (S1-S17, R1-R3, R19, W1, SRC3, SRC7, SRC9, SRC10).

Lengths and slices count code points. White space is the Unicode class plus U+FEFF. Everything but ``nfkc`` stays in
the JVM. All functions give null for null unless said otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"(?U)[\s\x{FEFF}]"
MASK = "[가림]"

# What counts as personal data, in the order in which it is masked.
PERSONAL = [
    r"(?<![A-Za-z0-9_])[0-9]{6}[-\s]?[0-9]{7}(?![A-Za-z0-9_])",
    r"(?i)https?://[^\s,]+",
    r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+",
    r"(?i)@[a-z0-9_.-]{2,}",
    r"(?:0[0-9]{1,2}[-\s]?)?[0-9]{3,4}[-\s]?[0-9]{4}",
    r"[가-힣]+(?:로|길)\s*[0-9]+(?:-[0-9]+)?(?:번지)?",
]


def _pandas_nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """S1. The only function that leaves the JVM (Arrow batches; ASCII is passed through)."""
    return F.pandas_udf(_pandas_nfkc, T.StringType())(c)


def squeeze(c: Column) -> Column:
    """S6. Runs of white space as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def without_space(c: Column) -> Column:
    """S6. No white space at all."""
    return F.regexp_replace(c, WS + "+", "")


def sha256(c: Column) -> Column:
    """S5. Hexadecimal digest of the UTF-8 text; of structs and maps by ``to_json``."""
    return F.sha2(c.cast("string"), 256)


def stable_id(*parts: Column) -> Column:
    """S16. A deterministic id instead of a random one."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def half_up(c: Column) -> Column:
    """S10. Rounds halves towards positive infinity, as BIGINT."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def percent(part: Column, whole: Column) -> Column:
    """S11. Percent with two decimals; 0 for an empty whole."""
    return F.when(whole > 0, F.floor(F.try_divide(part.cast("double"), whole) * 10000 + 0.5) / 100).otherwise(F.lit(0.0))


def paragraph_id(ordinal: Column) -> Column:
    """W1. p001, p002 ... (more digits from 1000 on)."""
    return F.format_string("p%03d", ordinal)


def _each(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


# The order of the steps is part of the meaning: &amp;lt; must come out as &lt;.
_BREAKS = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|h[1-6])>", "\n"), (r"<[^>]+>", " ")]
_ENTITIES = [(r"(?i)&nbsp;|&#160;", " "), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&amp;", "&")]


def split_paragraphs(c: Column) -> Column:
    """S2. HTML or plain text as an array of paragraphs, without blank ones; null gives an empty array."""
    lines = F.split(_each(F.coalesce(c, F.lit("")), _BREAKS + _ENTITIES), r"\n+")
    return F.filter(F.transform(lines, squeeze), lambda p: p != "")


def clean_text(c: Column) -> Column:
    """S3. Without tags and hard blanks, line breaks kept (at most one empty line)."""
    steps = [(r"<[^>]+>", " "), (r"(?i)&nbsp;|&#160;", " "), (r"\r", "\n"), (r"[\t ]+", " "), (r"\n{3,}", "\n\n"), (r"^[\s\x{FEFF}\x{00A0}]+|[\s\x{FEFF}\x{00A0}]+$", "")]
    return _each(c, steps)


def redact(c: Column) -> Column:
    """S4. STRUCT<text, redaction_count>: each kind masked in turn; null counts as ''."""
    text, count = F.coalesce(c, F.lit("")), F.lit(0)
    for p in PERSONAL:
        count = count + F.regexp_count(text, F.lit(p))
        text = F.regexp_replace(text, p, MASK)
    return F.struct(text.alias("text"), count.alias("redaction_count"))


def flexible_date(c: Column) -> Column:
    """SRC7. yyyyMMdd or yyyy.MM.dd as yyyy-MM-dd, '' for any other shape (the calendar isn't checked; see ``as_date``)."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    dashed = F.when(raw.rlike(r"^[0-9]{8}$"), F.regexp_replace(raw, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")).otherwise(
        F.regexp_replace(F.regexp_replace(raw, r"\.", "-"), "-+$", "")
    )
    return F.when(dashed.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), dashed).otherwise("")


def as_date(c: Column) -> Column:
    """A date, null where the calendar has none."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def article_parameter(c: Column) -> Column:
    """SRC3. 13-2 as 001302."""
    part = lambda i: F.coalesce(F.get(F.split(c, "-"), F.lit(i)), F.lit("0")).cast("int").cast("string")
    return F.concat(F.lpad(part(0), 4, "0"), F.lpad(part(1), 2, "0"))


def body_state(c: Column) -> Column:
    """SRC9. 'empty' or 'html' for answers that are none, else null."""
    t = squeeze(F.coalesce(c, F.lit("")))
    return F.when(t == "", "empty").when(t.rlike(r"(?i)^<(?:!doctype html|html[\s>])"), "html")


def mask_secrets(c: Column) -> Column:
    """SRC10. Values of key parameters in URLs as ***."""
    return F.regexp_replace(c, r"(?i)([?&](?:oc|apikey|api_key|authkey|key)=)[^&]+", "$1***")


def url_part(c: Column, part: str) -> Column:
    """S13. PROTOCOL, HOST ... of a URL, null for anything else."""
    return F.try_parse_url(c, F.lit(part))


def host_within(c: Column, domain: str) -> Column:
    """SRC10. Whether the host is the domain or below it."""
    host = F.lower(url_part(c, "HOST"))
    return F.coalesce((host == domain) | host.endswith("." + domain), F.lit(False))


def encode_component(c: Column) -> Column:
    """S13. Percent-encoded, blanks as %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def tokens(c: Column) -> Column:
    """R3. Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1)


def normalize_query(c: Column, limit: int = 4000) -> Column:
    """R1. Of a text in NFKC: blanks squeezed, at most one empty line, ends trimmed, at most ``limit`` code points."""
    steps = [(r"\r", "\n"), (r"[\t ]+", " "), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]
    return F.substring(_each(c, steps), 1, limit)


def query_terms(c: Column, most: int = 24) -> Column:
    """R2. Distinct words of two letters or digits and more, in order, at most ``most``."""
    words = F.transform(F.split(c, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), 1, most)


def snippet(c: Column, limit: int = 360) -> Column:
    """R19. The beginning of the text without tags."""
    return F.substring(F.regexp_replace(c, "<[^>]+>", " "), 1, limit)
