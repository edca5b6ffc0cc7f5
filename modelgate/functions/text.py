"""Text and number-formatting column expressions (JVM-side, no UDF).

Number formats follow Python's format mini-language as used in reasons and
reports: ``{:,.0f}``, ``{:+,.0f}``, ``{:.1%}``, ``{:+.1%}``, ``{:.0%}`` and
``{:.4f}``. ``format_number`` rounds half-even on the binary value like
Python does (``format_string`` would round half-up), so it is the base.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

import re

from modelgate.fixed import CHECK_LABELS

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill(template: str, **values: Column) -> Column:
    """A fixed-text template with ``{name}`` placeholders filled by columns
    (null if any filled value is null)."""
    parts, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(values[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return parts[0] if len(parts) == 1 else F.concat(*parts)

# Whitespace as Python's str.split() sees it.
_WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _special(x: Column, text: Column) -> Column:
    """NaN and infinities print as Python prints them."""
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .otherwise(text)
    )


def _signed(text: Column) -> Column:
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def thousands(x: Column) -> Column:
    """``{:,.0f}``: 1234567.5 -> '1,234,568'."""
    x = x.cast("double")
    return _special(x, F.format_number(x, 0))


def signed_thousands(x: Column) -> Column:
    """``{:+,.0f}``."""
    return _signed(thousands(x))


def _plain(x: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def percent(x: Column, digits: int = 1) -> Column:
    """``{:.1%}`` (digits=1) or ``{:.0%}`` (digits=0)."""
    scaled = x.cast("double") * 100.0
    return F.concat(_special(scaled, _plain(scaled, digits)), F.lit("%"))


def signed_percent(x: Column, digits: int = 1) -> Column:
    """``{:+.1%}``."""
    return _signed(percent(x, digits))


def fixed(x: Column, digits: int = 4) -> Column:
    """``{:.4f}``."""
    x = x.cast("double")
    return _special(x, _plain(x, digits))


def humanize_check(name: Column) -> Column:
    """Check name -> reviewer wording; unknown names get '_' -> ' '."""
    mapping = F.create_map(*[F.lit(v) for kv in CHECK_LABELS.items() for v in kv])
    return F.coalesce(F.try_element_at(mapping, name), F.regexp_replace(name, "_", " "))


def humanize_checks(names: Column) -> Column:
    """Array of check names -> comma-separated reviewer wording."""
    return F.array_join(F.transform(names, humanize_check), ", ")


def sanitize_token(x: Column, lower: bool = False, default: str = "review") -> Column:
    """Identifier-safe token.

    ``lower=False`` keeps case, '-' and '_' (outer blanks trimmed first, then
    outer '-'/'_' trimmed); ``lower=True`` lower-cases and maps every
    non-alphanumeric (including '_') to '-', then trims outer '-'.
    """
    if lower:
        cleaned = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "-")
        cleaned = F.regexp_replace(cleaned, r"^-+|-+$", "")
    else:
        stripped = F.regexp_replace(x, f"^{_WS}+|{_WS}+$", "")
        cleaned = F.regexp_replace(stripped, r"[^\p{L}\p{N}_-]", "-")
        cleaned = F.regexp_replace(cleaned, r"^[-_]+|[-_]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default))


def review_id(ts: Column, model_name: Column, model_version: Column, thread_id: Column) -> Column:
    """``<yyyyMMddTHHmmssZ>-<model>-v<version>-<thread>``; ``ts`` is an input
    column (UTC), never the wall clock."""
    return F.concat_ws(
        "-",
        F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"),
        sanitize_token(model_name, lower=True),
        F.concat(F.lit("v"), sanitize_token(model_version, lower=True)),
        sanitize_token(thread_id, lower=True),
    )


def collapse_whitespace(x: Column) -> Column:
    """``' '.join(text.split())``."""
    trimmed = F.regexp_replace(x, f"^{_WS}+|{_WS}+$", "")
    return F.regexp_replace(trimmed, f"{_WS}+", " ")


def compact_text(x: Column, limit: int = 240) -> Column:
    """Collapse whitespace and cut to ``limit`` characters ending in '...'."""
    text = collapse_whitespace(x)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def baseline_wording(x: Column) -> Column:
    """Replace every 'champion' (any case) by 'Baseline' when its first letter
    is upper case, else by 'baseline'."""
    upper_first = F.regexp_replace(x, r"C(?i:hampion)", "Baseline")
    return F.regexp_replace(upper_first, r"(?i)champion", "baseline")


def strip_text(x: Column) -> Column:
    """Python ``str.strip()`` (character-set trim, no regex)."""
    from modelgate.functions.parse import WHITESPACE

    return F.btrim(x, F.lit(WHITESPACE))
