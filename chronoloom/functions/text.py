"""Text column expressions; the few order-dependent ones are vectorised UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_exact(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def normalise_fuzzy(c: Column) -> Column:
    """The exact form with anything but letters a-z, digits, apostrophes and blanks as a blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalise_exact(c), "[^a-z0-9' ]", " "), r"\s+", " "))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` and the lambdas in it use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters that are not blanks."""

    def of(chars: Column, n: Column) -> Column:
        parts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / n)
        return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p))).otherwise(0.0)

    return bound(F.filter(F.split(c, ""), lambda x: (x != " ") & (x != "")), lambda chars: of(chars, F.size(chars)))


def high_entropy(c: Column) -> Column:
    """Names that fuzzy matching may trust: (6 characters or 2 words) and 1.5 bits or more."""
    words = F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    return ((F.length(c) >= 6) | (words >= 2)) & (entropy(c) >= 1.5)


def shingles(c: Column) -> Column:
    """Three-character shingles without blanks: none of '', the text itself of one character, none of two."""
    none = F.array().cast("array<string>")

    def of(s: Column, n: Column) -> Column:
        return F.when(n == 1, F.array(s)).when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3)))).otherwise(none)

    return bound(F.replace(c, F.lit(" "), F.lit("")), lambda s: of(s, F.length(s)))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity: 1 for two empty sets, 0 if one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != "")


def word_overlap(a: Column, b: Column) -> Column:
    return F.arrays_overlap(words(a), words(b))


def search_terms(c: Column) -> Column:
    """Runs of a-z and 0-9, lower-cased."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def strip_html(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def fenced_json(c: Column) -> Column:
    """JSON inside a reply: a fenced block, else from the first brace to the last, or from the first bracket if it stands before any brace."""
    found = lambda rx: F.nullif(F.regexp_extract(c, rx, 1), F.lit(""))
    listed = F.when(found(r"(?s)^([^{]*\[)").isNotNull(), found(r"(?s)(\[.*\])"))
    return F.coalesce(found(r"(?s)```(?:json)?\s*(.*?)\s*```"), listed, found(r"(?s)(\{.*\})"), found(r"(?s)(\[.*\])"))


def upto_last_brace(c: Column) -> Column:
    return F.regexp_extract(c, r"(?s)^(.*\})", 1)


def without_last_line(c: Column) -> Column:
    """All lines but the last; '' for one line."""
    return F.when(F.instr(c, "\n") == 0, "").otherwise(F.regexp_replace(c, r"\n[^\n]*\z", ""))


def last_line_empty(c: Column) -> Column:
    return F.trim(F.substring_index(c, "\n", -1)) == ""


def valid_group_id(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9_-]*$")


def uuid_shape(c: Column) -> Column:
    return c.rlike(r"^.{8}-.{4}-.{4}-.{4}-.{12}$")


def escape_query(c: Column) -> Column:
    """Full-text operators escaped with a backslash."""
    return F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def token_estimate(c: Column) -> Column:
    """Words, split at blanks and punctuation, times 1.3, cut to a whole number."""
    n = F.size(F.filter(F.split(c, r"[ \n\t.,!?;:]+"), lambda x: x != ""))
    return F.floor(n * F.lit(1.3)).cast("int")


def escape_non_ascii(c: Column) -> Column:
    r"""Non-ASCII characters as \uXXXX (UTF-16 units)."""

    @F.pandas_udf("string")
    def esc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else "".join(x if ord(x) < 128 else "".join(f"\\u{u:04x}" for u in memoryview(x.encode("utf-16-le")).cast("H")) for x in t))

    return esc(c)


def append_overlap(a: Column, b: Column) -> Column:
    """``a`` and ``b`` joined with their longest common suffix / prefix written once."""

    @F.pandas_udf("string")
    def join(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            if s is None or t is None:
                return s or t
            return s + t[next(n for n in range(min(len(s), len(t)), -1, -1) if s.endswith(t[:n])) :]

        return pd.Series([one(s, t) for s, t in zip(x, y, strict=True)], dtype=object)

    return join(a, b)


def _piece(raw: bytes, most: int) -> list[bytes]:
    """An overlong paragraph in pieces: at the last sentence end, else line end, else blank beyond a third of the size, else hard."""
    out = []
    while len(raw) > most:
        head = raw[:most]
        ends = [(head.rfind(mark), len(keep)) for mark, keep in ((b". ", b"."), (b"! ", b"!"), (b"? ", b"?"), (b"\n", b""), (b" ", b""))]
        at = next((i + n for i, n in ends if i > most // 3), None)
        if at is None:
            at = most
            while at > 1 and raw[at] & 0xC0 == 0x80:
                at -= 1
        out.append(raw[:at])
        raw = raw[at:].lstrip()
    return [*out, raw] if raw else out


def chunk(text: str | None, most: int = 2048) -> list[str]:
    """Chunks of at most ``most`` UTF-8 bytes: whole paragraphs packed in order, overlong ones split at sentence ends."""
    raw = (text or "").encode()
    if len(raw) <= most:
        return [text or ""]
    out: list[bytes] = []
    pack: list[bytes] = []

    def flush():
        if pack:
            out.append(b"\n\n".join(pack))
            pack.clear()

    for para in raw.split(b"\n\n"):
        if pack and sum(map(len, pack)) + 2 * len(pack) + len(para) > most:
            flush()
        if len(para) > most:
            flush()
            out += _piece(para, most)
        else:
            pack.append(para)
    flush()
    return [s for s in (x.decode().strip() for x in out) if s]


def chunk_text(c: Column, most: int = 2048) -> Column:
    """Array of chunks of a text."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunk(t, most))

    return run(c)


def distinct_in_order(items: Column) -> Column:
    """A list's distinct values in order of their first place."""
    return F.array_distinct(items)


def is_present(c: Column) -> Column:
    """A text that is there and not blank."""
    return F.coalesce(F.trim(c), F.lit("")) != ""


def is_between(c: Column, low, high) -> Column:
    """A number that is there and lies within closed bounds."""
    return F.coalesce((c >= low) & (c <= high), F.lit(False))


def is_of_length(c: Column, low: int, high: int) -> Column:
    """A list that is there and has from ``low`` to ``high`` items."""
    return F.coalesce(F.size(c).between(low, high) & c.isNotNull(), F.lit(False))
