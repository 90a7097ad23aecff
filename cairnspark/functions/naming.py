"""Output names from a template with {name}, {srcext} and {ext}."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnspark.functions.paths import extension, stem

DEFAULT = "{name}.{ext}"
NAME_BYTES = 255
_FIELD = re.compile(r"\{([^{}]*)\}")


def problem(template: str) -> str | None:
    """Why a template can't be used, None if it can."""
    if not template.strip():
        return "it is empty"
    if "/" in template:
        return "it has a slash"
    fields, rest = _FIELD.findall(template), _FIELD.sub("", template)
    if "{" in rest or "}" in rest:
        return "its braces don't match"
    if odd := [f for f in fields if f not in ("name", "ext", "srcext")]:
        return f"it has an unknown field {{{odd[0]}}}"
    if "name" not in fields:
        return "it lacks {name}"
    return None if template.endswith(".{ext}") else "it doesn't end in .{ext}"


def usable(template: Column) -> Column:
    """Whether problem() finds nothing wrong with templates of a column."""
    pattern = F.lit(_FIELD.pattern)
    fields, rest = F.regexp_extract_all(template, pattern, F.lit(1)), F.regexp_replace(template, pattern, F.lit(""))
    known = F.forall(fields, lambda f: f.isin("name", "ext", "srcext"))
    return (F.trim(template) != "") & ~template.contains("/") & ~rest.rlike("[{}]") & known & F.array_contains(fields, "name") & template.endswith(".{ext}")


def render(template: str, path: Column, target: Column) -> Column:
    """The output name of a path. The template is taken apart on the driver, so a stem that holds a field stays as it is."""
    body = template[: -len(".{ext}")] if template.endswith(".{ext}") else "{name}"
    values = {"name": stem(path), "srcext": extension(path), "ext": target}
    parts, at = [], 0
    for m in _FIELD.finditer(body):
        parts.append(F.lit(body[at : m.start()]))
        parts.append(values.get(m[1], F.lit(m[0])))
        at = m.end()
    parts.append(F.lit(body[at:]))
    return fit(F.translate(F.concat(*parts), "/", "_"), dotted(target))


def dotted(ext: Column) -> Column:
    return F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext))


def fit(name: Column, tail: Column) -> Column:
    """name and tail within NAME_BYTES of UTF-8, cutting name between characters.

    The longest prefix of up to NAME_BYTES characters that fits is picked from its byte lengths; names that fit as they
    are, nearly all, skip that.
    """
    room = F.lit(NAME_BYTES) - F.octet_length(tail)
    lengths = F.sequence(F.lit(0), F.least(F.length(name), F.greatest(room, F.lit(0))))
    best = F.array_max(F.filter(lengths, lambda n: F.octet_length(F.substring(name, F.lit(1), n)) <= room))
    return F.when(F.octet_length(name) <= room, F.concat(name, tail)).otherwise(F.concat(F.substring(name, F.lit(1), F.coalesce(best, F.lit(0))), tail))
