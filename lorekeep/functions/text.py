"""Text rules as plain Column expressions, all inside whole-stage codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, VariantType

from lorekeep import schemas as S

# Every code point with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The marks that tell content types apart, tested in this order on lower-cased text.
URL_PREFIXES = ("http://", "https://")
CODE_MARKS = ("```", "package ", "func ", "class ")
CHAT_MARKS = ("user:", "assistant:", "system:")


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def utrim(c: Column) -> Column:
    """Trims Unicode white space (``trim`` alone removes only U+0020)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def ulower(c: Column) -> Column:
    """Lower-cases code point by code point: no final-sigma rule, no expansion of dotted capital I."""
    for upper, lower in (("İ", "i"), ("Σ", "σ")):
        c = F.replace(c, F.lit(upper), F.lit(lower))
    return F.lower(c)


def alower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize_text(c: Column) -> Column:
    """Lower case, white-space runs as one space, no outer space.

    ``(?U)\\s`` is the White_Space property itself and runs about three times faster than a character
    class that lists its members.
    """
    return F.btrim(F.regexp_replace(ulower(c), r"(?U)\s+", " "))


def trimmed_lower(c: Column) -> Column:
    return utrim(ulower(c))


def is_blank(c: Column) -> Column:
    return utrim(nz(c)) == ""


def char_count(c: Column) -> Column:
    return F.char_length(c).cast("int")


def newline_count(c: Column) -> Column:
    return F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))


def line_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(newline_count(c) + 1).cast("int")


def _any_of(tests: list[Column]) -> Column:
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return hit


def content_type(c: Column) -> Column:
    low = ulower(c)
    return (
        F.when(_any_of([low.startswith(p) for p in URL_PREFIXES]), "url")
        .when(_any_of([low.contains(m) for m in CODE_MARKS]), "code")
        .when(_any_of([low.contains(m) for m in CHAT_MARKS]), "chat_transcript")
        .when(newline_count(c) > S.LONG_TEXT_MIN_NEWLINES, "long_text")
        .otherwise("text")
    )


def first_non_blank(*cols: Column) -> Column:
    """The first argument that is not blank, trimmed; else ``''``."""
    return F.coalesce(*[F.nullif(utrim(c), F.lit("")) for c in cols], F.lit(""))


def fallback_untrimmed(value: Column, default: Column) -> Column:
    """The value as it is unless blank."""
    return F.when(is_blank(value), default).otherwise(value)


def fallback_status(value: Column, batch_default: str | None = None) -> Column:
    default = batch_default if batch_default and batch_default.strip(WHITE_SPACE) else S.DEFAULT_STATUS
    return fallback_untrimmed(value, F.lit(default))


def fallback_title(content: Column) -> Column:
    text = utrim(content)
    return F.when(text == "", F.lit(S.UNTITLED)).otherwise(F.substring(text, 1, S.FALLBACK_TITLE_CHARS))


def keep_raw_if_short(content: Column) -> Column:
    text = utrim(content)
    return F.when(F.char_length(text) <= S.RAW_CONTENT_MAX_CHARS, text).otherwise(F.lit(""))


def clamp_confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_ts(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def lower_literal(text: str) -> str:
    """The code-point lower case of a Python string, equal to :func:`ulower` on a column."""
    return text.replace("İ", "i").replace("Σ", "σ").lower()


def keyword(query: str | None) -> str:
    return lower_literal((query or "").strip(WHITE_SPACE))


def contains_keyword(c: Column, word: str) -> Column:
    """``c LIKE %word%`` where the column side ignores A-Z case only.

    ``%`` and ``_`` typed by the user stay wildcards and a backslash is a plain character. The
    pattern goes to ``rlike`` with ASCII case folding, so the text is matched where it lies instead of
    being copied in lower case first.  Several pieces around ``%`` are each taken at their first place
    and never given back, which keeps the search linear in the text.
    """
    pieces = ["".join("." if ch == "_" else re.escape(ch) for ch in piece) for piece in word.split("%") if piece]
    if not pieces:
        return c.isNotNull()
    if len(pieces) == 1:
        return c.rlike("(?is)" + pieces[0])
    return c.rlike(r"(?is)\A" + "".join(f"(?>.*?{piece})" for piece in pieces))


def holds_one_value(text: Column) -> Column:
    """Whether ``text`` is one JSON value and nothing else.

    It is read as the first element of an array that ends with its own digest.  A text cannot contain its digest, so
    a bracket inside it that closes the array early leaves an array without it.
    """
    digest = F.sha2(text, 256)
    both = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')), ArrayType(VariantType()))
    last = F.try_variant_get(F.get(both, F.lit(1)), "$", "string")
    return F.coalesce((F.size(both) == 2) & (last == digest), F.lit(False))
