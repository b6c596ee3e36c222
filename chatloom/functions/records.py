"""Probing JSON values of unknown shape, with the truth rules of the source formats.

These are SQL expression texts: a value goes in as text (a column, a field, a lambda variable) and
an expression comes out, to be nested further and handed to ``F.expr`` once. Converters combine
dozens of them, and building such trees from Column objects would take seconds.
"""

from __future__ import annotations

from collections.abc import Callable

_SENTINEL = "@@chatloom:end@@"


def lit(text: str | None) -> str:
    """SQL literal of a text."""
    if text is None:
        return "cast(null as string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def case(*branches: tuple[str, str], otherwise: str = "null") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"


def strict_json(raw: str) -> str:
    """Parse exactly one JSON value, or null.

    Spark's parser ignores whatever follows the first value. The text is therefore parsed as the
    first element of an array closed by a sentinel: trailing garbage or a second value moves or
    loses the sentinel. A text that holds the sentinel itself takes a two-parse check instead.
    """
    closed = lit(f',"{_SENTINEL}"]')
    framed = f"try_parse_json(concat('[', {raw}, {closed}))"
    once = bind(
        framed, "w", f"CASE WHEN try_variant_get(w, '$[1]', 'string') = {lit(_SENTINEL)} THEN try_variant_get(w, '$[0]', 'variant') END"
    )
    as_field = f"""try_parse_json(concat('{{"r":', {raw}, '}}'))"""
    as_item = f"try_parse_json(concat('[', {raw}, ']'))"
    twice = (
        f"CASE WHEN {as_field} IS NOT NULL AND size(try_variant_get({as_item}, '$', 'array<variant>')) = 1 "
        f"THEN try_variant_get({as_item}, '$[0]', 'variant') END"
    )
    return f"CASE WHEN contains({raw}, {lit(_SENTINEL)}) THEN {twice} ELSE {once} END"


def key_path(key: str) -> str:
    """JSON path of one top-level key, whatever characters it holds."""
    if "'" not in key:
        return f"$['{key}']"
    if '"' not in key:
        return f'$["{key}"]'
    raise ValueError(f"a key may not hold both kinds of quotes: {key!r}")


def field(value: str, key: str) -> str:
    """Value under a key: SQL null when absent, a variant null when the JSON says null."""
    return at(value, key_path(key))


def at(value: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({value}, {lit(path)}, '{kind}')"


def items(value: str) -> str:
    """Elements of a JSON array, or null when the value is no array."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def is_object(value: str) -> str:
    return f"(try_variant_get({value}, '$', 'map<string,variant>') IS NOT NULL)"


def describe(value: str, js: bool = False) -> str:
    """Kind and text of a value; the text of a scalar follows Python's ``str`` or JavaScript's ``String``."""
    probe = f"named_struct('kind', coalesce(schema_of_variant({value}), 'ABSENT'), 'text', try_variant_get({value}, '$', 'string'))"
    scripted = case(("p.kind IN ('DOUBLE', 'FLOAT')", f"regexp_replace(p.text, {lit(r'^(-?[0-9]+)[.]0$')}, '$1')"), otherwise="p.text")
    text = scripted if js else case(
        ("p.kind = 'BOOLEAN'", "initcap(p.text)"),
        # An integral decimal of ordinary size was written with a fraction part: 1.0.
        (f"startswith(p.kind, 'DECIMAL') AND p.kind RLIKE {lit(r'^DECIMAL\(\d+,0\)$')} AND length(p.text) <= 18", "concat(p.text, '.0')"),
        otherwise="p.text",
    )
    return bind(probe, "p", f"named_struct('kind', p.kind, 'text', {text})")


def _false_scalar(d: str) -> str:
    number = lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    zero = lit(r"^-?0(\.0+)?(E0)?$")
    return (
        f"({d}.kind IN ('ABSENT', 'VOID') OR ({d}.kind = 'STRING' AND {d}.text = '') OR ({d}.kind = 'BOOLEAN' AND lower({d}.text) = 'false')"
        f" OR ({d}.kind <> 'STRING' AND {d}.text RLIKE {zero} AND {d}.kind RLIKE {number}))"
    )


def py_falsy(d: str) -> str:
    """Python truth of a described value: null, "", 0, false, [] and {} are false."""
    return f"({_false_scalar(d)} OR ({d}.kind <> 'STRING' AND {d}.text IN ('[]', '{{}}')))"


def js_falsy(d: str) -> str:
    """JavaScript truth of a described value: as in Python, but [] and {} are true."""
    return _false_scalar(d)


def first_truthy(*values: str, falsy: Callable[[str], str] = py_falsy) -> str:
    """Text of the first true value, or null when all are false."""
    picked = [bind(describe(v, falsy is js_falsy), "d", f"CASE WHEN NOT {falsy('d')} THEN d.text END") for v in values]
    return f"coalesce({', '.join(picked)})" if len(picked) > 1 else picked[0]


def is_truthy(value: str, falsy: Callable[[str], str] = py_falsy) -> str:
    return bind(describe(value, falsy is js_falsy), "d", f"NOT {falsy('d')}")


def described_text(d: str, null_text: str | None, missing_text: str | None) -> str:
    return case((f"{d}.kind = 'ABSENT'", lit(missing_text)), (f"{d}.kind = 'VOID'", lit(null_text)), otherwise=f"{d}.text")


def py_text(value: str, null_text: str | None = None, missing_text: str | None = None) -> str:
    """Text of a value; JSON null and a missing key map to the given texts."""
    return bind(describe(value), "d", described_text("d", null_text, missing_text))
