"""Text hygiene as column expressions.

Patterns run with Java's ``(?U)`` flag so that ``\\w \\d \\s \\b`` are Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom import constants as K


def _unicode(pattern: str, flags: str = "U") -> str:
    """Java form of a pattern; ``\\s`` also covers the ASCII separators."""
    inside = r"\s\x1c-\x1f"
    out, in_class = [], False
    for piece in _pieces(pattern):
        if piece == "[":
            in_class = True
        elif piece == "]":
            in_class = False
        elif piece == r"\s":
            piece = inside if in_class else K.BLANK
        out.append(piece)
    return (f"(?{flags})" if flags else "") + "".join(out)


def _pieces(pattern: str):
    it = iter(pattern)
    for ch in it:
        yield ch + next(it) if ch == "\\" else ch


def fill_placeholders(text: Column, product: Column) -> Column:
    name = F.coalesce(F.nullif(strip(product), F.lit("")), F.lit(K.DEFAULT_PRODUCT))
    for placeholder in K.PRODUCT_PLACEHOLDERS:
        text = F.replace(text, F.lit(placeholder), name)
    return F.replace(text, F.lit(K.ERROR_PLACEHOLDER), F.lit(K.ERROR_TOKEN))


def redact_email(text: Column) -> Column:
    return F.regexp_replace(text, _unicode(K.EMAIL_PATTERN), K.EMAIL_TOKEN)


def redact_phone(text: Column) -> Column:
    # The look-ahead only skips positions where no number can start.
    return F.regexp_replace(text, r"(?U)(?=[+(\d])" + _unicode(K.PHONE_PATTERN, ""), K.PHONE_TOKEN)


def redact_billing_zip(text: Column) -> Column:
    return F.regexp_replace(text, _unicode(K.BILLING_ZIP_PATTERN, "iU"), K.BILLING_ZIP_TOKEN)


def redact_handle(text: Column) -> Column:
    return F.regexp_replace(text, _unicode(K.HANDLE_PATTERN), K.HANDLE_TOKEN)


def redact_id_code(text: Column) -> Column:
    """Opt-in: the generic order-code pattern is not part of the default chain."""
    return F.regexp_replace(text, _unicode(K.ID_CODE_PATTERN), K.ID_CODE_TOKEN)


def join_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"[\r\n]+", " ")


def squeeze(text: Column) -> Column:
    """Runs of two or more blanks become one space; a lone tab stays."""
    return F.regexp_replace(text, f"(?U){K.BLANK}{K.BLANK}+", " ")


def strip(text: Column) -> Column:
    """Drop blanks of every kind at both ends (plain ``trim`` drops spaces only)."""
    return F.btrim(text, F.lit(K.BLANK_CHARS))


def normalise_space(text: Column) -> Column:
    """Join lines, squeeze, strip, without a regular expression for the line breaks.

    Turning every line break into a space equals joining runs of them first, because the
    squeeze that follows folds the runs.
    """
    spaced = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return strip(squeeze(spaced))


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def redact(text: Column) -> Column:
    """E-mail, phone, billing ZIP, handle, in this order.

    Two of the four patterns need an ``@``; texts without one skip them.
    """
    return _bind(
        text,
        lambda t: F.when(
            F.contains(t, F.lit("@")),
            redact_handle(redact_billing_zip(redact_phone(redact_email(t)))),
        ).otherwise(redact_billing_zip(redact_phone(t))),
    )


def clean_ticket_text(text: Column, product: Column, redact_ids: bool = False) -> Column:
    """Placeholders, redaction, whitespace; a missing text becomes ''."""
    cleaned = redact(fill_placeholders(F.coalesce(text, F.lit("")), product))
    if redact_ids:
        cleaned = redact_id_code(cleaned)
    return normalise_space(cleaned)


def clean_resolution_text(text: Column) -> Column:
    return normalise_space(F.coalesce(text, F.lit("")))


def is_blank(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) == 0


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"(?U){K.BLANK}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def contains_any(text: Column, terms) -> Column:
    """True where the text holds one of the terms as a substring."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def significant_words(text: Column) -> Column:
    """Distinct lower-case ASCII words of four letters and more.

    Word borders are ASCII too, hence look-arounds and not Java's ``\\b``.
    """
    pattern = r"(?<![A-Za-z0-9_])[a-z]{4,}(?![A-Za-z0-9_])"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))


def pii_flags(text: Column) -> dict[str, Column]:
    return {
        "email": F.regexp_like(text, F.lit(_unicode(K.EMAIL_PATTERN))),
        "phone": F.regexp_like(text, F.lit(_unicode(K.PHONE_PATTERN))),
        "billing_zip": F.regexp_like(text, F.lit(_unicode(K.BILLING_ZIP_PATTERN, "iU"))),
        "handle": F.regexp_like(text, F.lit(_unicode(K.HANDLE_PATTERN))),
    }
