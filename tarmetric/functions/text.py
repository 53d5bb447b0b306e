"""Free-text extraction as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tarmetric import params as P


#: All white space that ends a field, not blanks alone.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def longest_prefix(text: Column, words: list[str]) -> Column:
    """The longest dictionary word that ``text`` starts with, else NULL."""
    out = None
    for word in sorted(words, key=lambda w: (-len(w), w)):
        out = F.when(text.startswith(word), word) if out is None else out.when(text.startswith(word), word)
    return out


def district(description: Column) -> Column:
    return longest_prefix(stripped(description), P.DISTRICTS)


def movement_type(description: Column) -> Column:
    clean = F.lower(F.trim(F.regexp_replace(description, r"(?U)\s+", " ")))
    header = None
    for marker in P.HEADER_MARKERS:
        header = clean.contains(marker) if header is None else header | clean.contains(marker)
    return (
        F.when(header, "Other/Unspecified (source header artifact)")
        .when(longest_prefix(clean, P.MOVEMENT_TYPES).isNotNull(), F.initcap(longest_prefix(clean, P.MOVEMENT_TYPES)))
        .otherwise("Other/Unspecified")
    )


FULL_DATE = r"(\d{1,2})\s+(" + "|".join(P.MONTHS) + r")\s+(\d{4})"


def is_day_precise(text: Column) -> Column:
    return F.coalesce(text.rlike(FULL_DATE), F.lit(False))


def event_year(text: Column, slide_id: Column) -> Column:
    """Year of a full date in the text, else of the first ``/YYYY/`` in the id if 1900 to 2100."""
    in_text = F.regexp_extract(text, FULL_DATE, 3)
    in_id = F.regexp_extract(slide_id, r"/(\d{4})/", 1)
    id_year = F.when(in_id != "", in_id.cast("int"))
    return F.when(is_day_precise(text), in_text.cast("int")).otherwise(F.when(id_year.between(1900, 2100), id_year))


def is_negative_observation(text: Column) -> Column:
    """True where any keyword occurs anywhere in the lower-cased text (substring match)."""
    pattern = "|".join(re.escape(k) for k in P.NEGATIVE_KEYWORDS)
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))
