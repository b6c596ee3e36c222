"""Text rules as Column expressions: stripping, line splitting, let-binding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _chars(*points: int) -> str:
    return "".join(map(chr, points))


# The code points that Python's str.strip removes.
PY_SPACE = _chars(
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

# The code points that JavaScript's trim removes and its whitespace class matches.
JS_SPACE = _chars(
    *range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF,
)

# The separators at which Python's str.splitlines breaks. The inner ones are
# what is left of them inside a line that a line reader has already cut at LF and CR.
_INNER = _chars(0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)
INNER_BREAK = f"[{_INNER}]"
LINE_BREAK = f"\r\n|[\n\r{_INNER}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name so that ``body`` evaluates it once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pystrip(text: Column) -> Column:
    return F.btrim(text, F.lit(PY_SPACE))


def jstrim(text: Column) -> Column:
    return F.btrim(text, F.lit(JS_SPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return F.coalesce(pystrip(text), F.lit("")) == ""


def js_blank(text: Column) -> Column:
    return F.coalesce(jstrim(text), F.lit("")) == ""


def splitlines(text: Column, pattern: str = LINE_BREAK) -> Column:
    """Lines of a text; a separator at the very end opens no further line."""
    return let(
        F.split(text, pattern),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a),
    )
