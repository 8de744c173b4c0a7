"""Text expressions: joined fields, fixed decimals, percent encoding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that stay as they are in the first encoding of a request.
KEPT = "/:=&?#+!$,;'@()*[]"


def six_decimals(c: Column | str) -> Column:
    """The exact binary value at six decimals, ties to even; formatting by a pattern like %.6f would round the shortest decimal instead."""
    return F.replace(F.format_number(F.col(c) if isinstance(c, str) else c, 6), F.lit(","), F.lit(""))


def _form_encode(c: Column) -> Column:
    """Percent-encode all but letters, digits and _.-~ ; a space becomes '+'."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_encode(c: Column, kept: str = "") -> Column:
    """Percent-encode all but letters, digits, _.-~ and the kept characters."""
    out = F.replace(_form_encode(c), F.lit("+"), F.lit("%20"))
    for ch in kept:
        out = F.replace(out, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return out


def form_encode(c: Column) -> Column:
    return _form_encode(c)
