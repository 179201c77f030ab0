"""String helpers: trimming, masking, hashing, pattern search, literal lookups."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaylight.fixed import REQUIRED_TEXT, WHITESPACE


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def non_empty(c: Column) -> Column:
    """Text of ``c``, null when empty: the truth test used by every first-field search."""
    return F.nullif(c.cast("string"), F.lit(""))


def first_non_empty(columns: Sequence[Column]) -> Column:
    return F.coalesce(*[non_empty(c) for c in columns]) if columns else F.lit(None).cast("string")


def lookup(table: Mapping, key: Column) -> Column:
    """Value of ``key`` in a small literal table, null when absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def printed(c: Column, dtype: T.DataType) -> Column:
    """Text of a value as a hash input: booleans print capitalised, the rest as Spark casts."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def regex(pattern: str, unicode: bool = True) -> str:
    """Case-insensitive Java form of ``pattern``; ``unicode`` widens \\w, \\d, \\s and \\b."""
    return ("(?iU)" if unicode else "(?i)") + pattern


def literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found_sql(text: str, pattern: str, unicode: bool = True) -> str:
    """SQL condition: the pattern occurs in ``text``.

    A plain containment test comes first when one is known. Folding differs for three letters
    outside ASCII: a long s folds to S in upper case only, a Kelvin sign to k in lower case only,
    so the case used depends on the text looked for.
    """
    hit = f"{text} RLIKE {literal(regex(pattern, unicode))}"
    held = REQUIRED_TEXT.get(pattern)
    if held is None:
        return hit
    if not held.isalpha():
        return f"contains({text}, {literal(held)}) AND {hit}"
    fold = "upper" if "s" in held else "lower"
    return f"contains({fold}({text}), {fold}({literal(held)})) AND {hit}"


def mask_sql(
    text: str,
    patterns: Sequence[str],
    mask_char: str = "*",
    mask_length: int = 8,
    unicode: bool = True,
) -> str:
    """SQL text replacing each match by ``mask_char`` repeated min(match length, ``mask_length``)
    times.

    Patterns run in order, each over the text left by the one before; each intermediate text is
    bound once, so the plan grows with the number of patterns only. A row without a match pays for
    one search. SQL text rather than columns: the expression is long, and one call builds it.
    """
    for pattern in patterns:
        java = literal(regex(pattern, unicode))
        stars = (
            f"transform(regexp_extract_all(t, {java}, 0), "
            f"m -> repeat({literal(mask_char)}, least(length(m), {mask_length})))"
        )
        covered = (
            f"array_join(zip_with(split(t, {java}, -1), {stars}, "
            "(a, b) -> concat(a, coalesce(b, ''))), '')"
        )
        hit = found_sql("t", pattern, unicode)
        text = f"get(transform(array({text}), t -> CASE WHEN {hit} THEN {covered} ELSE t END), 0)"
    return text


#: A JSON string; a key is taken with its colon. Runs of plain characters are taken whole and never given
#: back, so long texts cost one pass.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+'


def mask_json_sql(
    text: str,
    patterns: Sequence[str],
    mask_char: str = "*",
    mask_length: int = 8,
    unicode: bool = True,
) -> str:
    """SQL text masking the string values inside JSON text; keys, numbers and layout stay.

    Each value is decoded, masked and encoded again, so the text is still JSON. A value without a match keeps
    its spelling. Text that is not JSON is masked as it stands.
    """
    java = literal(JSON_STRING)
    decoded = "get(from_json(concat('[', v, ']'), 'array<string>'), 0)"
    masked = mask_sql("d", patterns, mask_char, mask_length, unicode)
    encoded = "substring(to_json(array(m)), 2, length(to_json(array(m))) - 2)"
    value = (
        f"get(transform(transform(array({decoded}), d -> named_struct('d', d, 'm', {masked})), "
        f"p -> CASE WHEN endswith(v, ':') OR p.m IS NULL OR p.m = p.d THEN v ELSE get(transform(array(p.m), m -> {encoded}), 0) END), 0)"
    )
    values = f"transform(regexp_extract_all(j, {java}, 0), v -> {value})"
    joined = f"array_join(zip_with(split(j, {java}, -1), {values}, (a, b) -> concat(a, coalesce(b, ''))), '')"
    plain = mask_sql("j", patterns, mask_char, mask_length, unicode)
    body = f"CASE WHEN try_parse_json(j) IS NULL THEN {plain} ELSE {joined} END"
    return f"get(transform(array({text}), j -> {body}), 0)"


#: What a walk over JSON text must see: strings, brackets and commas; numbers and words between them change nothing.
JSON_TOKEN = JSON_STRING + r"|[{}\[\],]"
FINDINGS = "array<struct<path:string,type:string,text:string>>"


def hits_sql(text: str, path: str, patterns: Sequence[tuple[str, str]], unicode: bool = True) -> str:
    """SQL array of ``struct(path, type, text)``, one per (type, pattern) that occurs in ``text``."""
    cases = ", ".join(
        f"CASE WHEN {found_sql(text, pattern, unicode)} THEN named_struct('path', {path}, 'type', {literal(kind)}, 'text', {text}) END"
        for kind, pattern in patterns
    )
    return f"array_compact(array({cases}))"


def json_hits_sql(text: str, name: str, patterns: Sequence[tuple[str, str]], unicode: bool = True) -> str:
    """``hits_sql`` of every string value inside JSON text, with its path below ``name``: ``name.user.mail[0]``.

    The tokens are folded with a stack of what is open: an object counts -1, a list the place it is at. Only
    findings are kept. Text that is not JSON is one string of its own.
    """
    top = "element_at(s.stack, -1)"
    below = "slice(s.stack, 1, size(s.stack) - 1)"
    own = f"CASE WHEN size(s.stack) = 0 THEN {literal(name)} WHEN {top}.at < 0 THEN concat({top}.base, '.', s.key) ELSE concat({top}.base, '[', {top}.at, ']') END"
    decoded = "get(from_json(concat('[', {0}, ']'), 'array<string>'), 0)"
    value = f"get(transform(array(named_struct('d', {decoded.format('t')}, 'p', {own})), x -> {hits_sql('x.d', 'x.p', patterns, unicode)}), 0)"

    def state(stack: str = "s.stack", key: str = "s.key", out: str = "s.out") -> str:
        return f"named_struct('stack', {stack}, 'key', {key}, 'out', {out})"

    opened = "concat(s.stack, array(named_struct('base', {0}, 'at', {1})))"
    key = decoded.format("regexp_replace(t, '\\\\s*:$', '')")
    step = (
        f"CASE WHEN endswith(t, ':') THEN {state(key=key)} "
        f"WHEN startswith(t, '\"') THEN {state(out=f'concat(s.out, {value})')} "
        f"WHEN t = '{{' THEN {state(stack=opened.format(own, -1))} WHEN t = '[' THEN {state(stack=opened.format(own, 0))} "
        f"WHEN t = ',' THEN CASE WHEN {top}.at < 0 THEN s ELSE {state(stack=f'concat({below}, array(named_struct({chr(39)}base{chr(39)}, {top}.base, {chr(39)}at{chr(39)}, {top}.at + 1)))')} END "
        f"ELSE {state(stack=below)} END"
    )
    start = f"named_struct('stack', cast(array() AS array<struct<base:string,at:int>>), 'key', cast(NULL AS string), 'out', cast(array() AS {FINDINGS}))"
    walked = f"aggregate(regexp_extract_all(j, {literal(JSON_TOKEN)}, 0), {start}, (s, t) -> {step}, s -> s.out)"
    plain = hits_sql("j", literal(name), patterns, unicode)
    body = f"CASE WHEN j IS NULL THEN cast(array() AS {FINDINGS}) WHEN try_parse_json(j) IS NULL THEN {plain} ELSE {walked} END"
    return f"get(transform(array({text}), j -> {body}), 0)"


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` evaluated once, however often the body uses it.

    Without the binding a chain of rewrites would repeat its input in every branch, and the plan
    would grow exponentially with the number of steps.
    """
    return F.get(F.transform(F.array(c), body), F.lit(0))


def hash_text(c: Column, salt: str = "", algorithm: str = "sha256") -> Column:
    """Hex digest of salt + text; an unknown algorithm falls back to sha256."""
    salted = F.concat(F.lit(salt), c)
    if algorithm == "md5":
        return F.md5(salted)
    if algorithm == "sha1":
        return F.sha1(salted)
    return F.sha2(salted, 256)


def expand_template(c: Column, pattern: str, template: str) -> Column:
    """``template`` with ``\\N`` replaced by group N of the first match of ``pattern`` in ``c``."""
    parts = [
        F.regexp_extract(c, pattern, int(piece[1:]))
        if re.fullmatch(r"\\\d", piece)
        else F.lit(piece)
        for piece in re.split(r"(\\\d)", template)
        if piece
    ]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def whole_match(c: Column, pattern: str) -> Column:
    """True when the pattern matches the entire value (label matchers are anchored)."""
    return c.rlike(rf"\A(?:{pattern})\z")
