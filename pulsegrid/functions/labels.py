"""Label handling: selectors, rewriting, names, keys and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(labels: Column, name: str) -> Column:
    """Value of a label; a missing label reads as the empty string."""
    return F.coalesce(labels[name], F.lit(""))


def matches(value: Column, op: str, operand: str) -> Column:
    """Label matcher; regular expressions are anchored on both sides."""
    if op == "=":
        return value == operand
    if op == "!=":
        return value != operand
    if op == "=~":
        return value.rlike(f"^(?:{operand})$")
    if op == "!~":
        return ~value.rlike(f"^(?:{operand})$")
    raise ValueError(f"unknown matcher {op!r}")


def select_labels(labels: Column, *matchers: tuple[str, str, str] | None) -> Column:
    """Conjunction of matchers; absent ones are skipped, none at all selects everything."""
    condition = F.lit(True)
    for m in matchers:
        if m:
            condition = condition & matches(label(labels, m[0]), m[1], m[2])
    return condition


def escape(value: Column) -> Column:
    """Escapes of the exposition text: backslash, line feed, double quote."""
    return F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def unescape(value: Column) -> Column:
    hold = F.lit("\u0000")
    out = F.replace(value, F.lit("\\\\"), hold)
    out = F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(out, hold, F.lit("\\"))


def render_labels(labels: Column) -> Column:
    """``k="v"`` pairs in label order; the identity of a label set as text."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"'))
        ),
        ",",
    )


def label_replace(labels: Column, dst: str, replacement: str, src: str, regex: str) -> Column:
    """New value of ``dst``: the replacement where ``src`` matches entirely, else what it was.

    An empty ``src`` with an empty ``regex`` sets a constant.
    """
    current = label(labels, dst)
    source = label(labels, src) if src else F.lit("")
    anchored = f"^(?:{regex})$"
    return F.when(source.rlike(anchored), F.regexp_replace(source, anchored, replacement)).otherwise(current)


def with_label(labels: Column, name: str, value: Column) -> Column:
    """Label set with one label set (and removed when the value is empty)."""
    rest = F.map_filter(labels, lambda k, _: k != F.lit(name))
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def sanitize(value: Column, length: int = 200) -> Column:
    """Fixed pattern: characters allowed in a label value; everything else becomes an underscore."""
    return F.substring(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._:/@+ -]", "_"), 1, length)


def image_tag(image: Column) -> Column:
    """Text after the last colon of the last path segment, else ``latest``."""
    last = F.element_at(F.split(image, "/"), -1)
    return F.when(F.contains(last, F.lit(":")), F.substring_index(last, ":", -1)).otherwise(F.lit("latest"))


def is_commit_version(version: Column) -> Column:
    return version.rlike(r"^(?:.+-[0-9a-f]{7})$")


def app_name(name: Column, keep: str) -> Column:
    return F.when(name == keep, name).otherwise(F.regexp_replace(name, "^app-", ""))


def component_of(feature: Column) -> Column:
    """Component named by a feature (``cpu_<c>`` or ``ram_<c>_mb``), else null."""
    cpu = F.regexp_extract(feature, r"^cpu_([a-z0-9-]+)$", 1)
    ram = F.regexp_extract(feature, r"^ram_([a-z0-9-]+)_mb$", 1)
    return F.nullif(F.concat(cpu, ram), F.lit(""))


def signature(expressions: Column) -> Column:
    """Fingerprint of the feature formulas of a model."""
    return F.substring(F.sha2(F.concat_ws("\n", expressions), 256), 1, 16)


def incident_key(fingerprint: Column, name: Column, node: Column, starts_at: Column) -> Column:
    base = F.coalesce(F.nullif(fingerprint, F.lit("")), F.concat(name, F.lit(":"), F.coalesce(node, F.lit(""))))
    return F.concat(base, F.lit(":"), F.coalesce(starts_at, F.lit("")))


def action_key(node: Column, action: Column, arg: Column) -> Column:
    return F.concat_ws(":", node, F.coalesce(action, F.lit("None")), F.coalesce(arg, F.lit("")))


def annotate(template: str, labels: Column, value: Column, decimals: int = 0) -> Column:
    """Text with ``{name}`` replaced by labels and ``{value}`` by the rounded value."""
    parts = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if piece == "{value}":
            parts.append(F.format_string(f"%.{decimals}f", value))
        elif piece.startswith("{"):
            parts.append(label(labels, piece[1:-1]))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
