"""Prompt templates with ``$name`` / ``${name}`` placeholders and ``$$`` escapes.

The template is split once on the driver into literal parts and placeholder
names; the prompt column is then a single ``concat`` of literals and columns.
Substituting by chained ``replace`` would be wrong: a context that itself
contains ``$query`` would be expanded a second time.
"""

from __future__ import annotations

from string import Template

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = Template.pattern  # compiled by the standard library


def split_template(template: str) -> list[tuple[str, str]]:
    """Parts of a template: ``("lit", text)`` and ``("var", name)`` in order."""
    parts: list[tuple[str, str]] = []
    buf: list[str] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        buf.append(template[pos : m.start()])
        pos = m.end()
        if m.group("escaped") is not None:
            buf.append("$")
        elif m.group("invalid") is not None:
            raise ValueError(f"invalid placeholder in template at index {m.start()}")
        else:
            if buf:
                parts.append(("lit", "".join(buf)))
                buf = []
            parts.append(("var", m.group("named") or m.group("braced")))
    buf.append(template[pos:])
    lit = "".join(buf)
    if lit:
        parts.append(("lit", lit))
    return parts


def identifiers(template: str) -> set[str]:
    return {name for kind, name in split_template(template) if kind == "var"}


def substitute(template: str, query: Column, context: Column | None = None) -> Column:
    """Prompt column: both ``$context`` and ``$query`` when the template names
    exactly those two, otherwise only ``$query`` (any other name is an error)."""
    parts = split_template(template)
    names = {n for k, n in parts if k == "var"}
    values = {"query": query}
    if names == {"context", "query"}:
        if context is None:
            raise ValueError("template needs a context column")
        values["context"] = context
    missing = names - set(values)
    if missing:
        raise KeyError(f"template placeholders without a value: {sorted(missing)}")
    cols = [F.lit(v) if k == "lit" else values[v] for k, v in parts]
    return F.concat(*cols) if cols else F.lit("")
