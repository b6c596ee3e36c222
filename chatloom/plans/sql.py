"""SQL text shared by the comparison queries."""

from __future__ import annotations

# White space and line breaks by Python's own rules, apart from the operators' lists.
PY_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
LINE_BREAK = "\r\n|[" + "".join(c for c in map(chr, range(0x3001)) if len(f"a{c}b".splitlines()) == 2) + "]"
# The white space of JavaScript.
JS_SPACE = "".join(map(chr, (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(PY_SPACE)})"


def jstrip(x: str) -> str:
    return f"trim({x}, {lit(JS_SPACE)})"


def lines(x: str) -> str:
    """List of lines; a separator at the very end opens no further line."""
    cut = f"regexp_split_to_array({x}, {lit(LINE_BREAK)})"
    return f"(CASE WHEN {cut}[-1] = '' THEN {cut}[:-2] ELSE {cut} END)"


def numbered(select: str, listed: str, name: str = "line") -> str:
    """Rows of a list with positions from 0."""
    return f"SELECT * EXCLUDE (_l), unnest(_l) AS {name}, generate_subscripts(_l, 1) - 1 AS n FROM (SELECT {select}, {listed} AS _l"


LF = lit("\n")

# Conversations after cleaning: blank messages dropped, and only those with a user and an
# assistant message; ``n`` counts messages from 0.
CLEAN_TURNS = f"""
clean AS (SELECT conv_id, turn, role, {strip("text")} AS content FROM conversations),
valid AS (
  SELECT conv_id FROM clean WHERE content <> '' GROUP BY conv_id
  HAVING bool_or(role = 'user') AND bool_or(role = 'assistant')
),
sample_rows AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, content
  FROM clean JOIN valid USING (conv_id) WHERE content <> ''
)"""

# Predictions for the assistant turns: the turn before, or the gold text itself, or none.
PREDICTIONS = """
gold AS (SELECT conv_id, turn AS turn_no, text AS gold FROM conversations WHERE role = 'assistant'),
pairs AS (
  SELECT g.conv_id, g.turn_no, g.gold,
    CASE WHEN (g.conv_id + g.turn_no) % 7 = 0 OR p.conv_id IS NULL THEN ''
         WHEN (g.conv_id + g.turn_no) % 3 = 0 THEN g.gold
         ELSE coalesce(p.text, '') END AS pred
  FROM gold g LEFT JOIN conversations p ON p.conv_id = g.conv_id AND p.turn = g.turn_no - 1
)"""


def tokens(x: str) -> str:
    return f"[t FOR t IN string_split(replace(lower({strip(x)}), {LF}, ' '), ' ') IF t <> '']"


def f_measure(hits: str, n_pred: str, n_gold: str) -> str:
    p, r = f"({hits}::DOUBLE / {n_pred})", f"({hits}::DOUBLE / {n_gold})"
    return f"CASE WHEN {n_pred} = 0 OR {n_gold} = 0 OR {hits} = 0 THEN 0.0 ELSE 2.0::DOUBLE * {p} * {r} / ({p} + {r}) END"
