"""Parameterised SQL.

Scripts written with ``${key.name}`` placeholders are run with Spark's own
parameter markers: each key gets a marker of its own and its value is
bound, never pasted into the text.  Identifiers are bound through
``IDENTIFIER(${...})``.

* Inside a quoted string, ``'a${k}b'`` becomes ``concat('a', :k, 'b')``.
  Where the grammar wants a literal (``LOCATION '...'``) Spark rejects that.
* Inside a quoted identifier a placeholder is rejected: use IDENTIFIER.
* Comments are left alone.  A placeholder without a value, or a ``${`` left
  over, is an error before anything runs.

A script may hold several statements, parted by semicolons outside quotes
and comments; they run in order and the last one's result is returned.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_PLACEHOLDER = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}")
# What a script is made of: comments, quoted strings, quoted identifiers, semicolons, anything else.
_TOKEN = re.compile(r"(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|\\.|'')*')"
                    r"|(?P<name>`[^`]*`|\"(?:[^\"\\]|\\.)*\")|(?P<end>;)|(?P<other>[^-/'`\";]+|.)", re.DOTALL)


class _Markers:
    """One parameter marker for each key, however similar the keys are."""

    def __init__(self, replacements: dict[str, Any]) -> None:
        self.replacements, self.names = replacements, {}

    def marker(self, key: str) -> str:
        if key not in self.replacements:
            raise KeyError(f"no value for placeholder ${{{key}}}")
        name = self.names.setdefault(key, f"p{len(self.names)}_" + re.sub(r"\W", "_", key))
        return f":{name}"

    def args(self) -> dict[str, Any]:
        return {name: self.replacements[key] for key, name in self.names.items()}


def _bind_text(literal: str, markers: _Markers) -> str:
    """A quoted string with placeholders as a concatenation."""
    parts = _PLACEHOLDER.split(literal[1:-1])
    if len(parts) == 1:
        return literal
    pieces = [markers.marker(p) if k % 2 else f"'{p}'" for k, p in enumerate(parts) if k % 2 or p]
    return pieces[0] if len(pieces) == 1 else f"concat({', '.join(pieces)})"


def split_script(script: str) -> list[list[tuple[str, str]]]:
    """The statements of a script, each as its (kind, text) pieces."""
    statements: list[list[tuple[str, str]]] = [[]]
    for m in _TOKEN.finditer(script):
        if m.lastgroup == "end":
            statements.append([])
        else:
            statements[-1].append((m.lastgroup, m.group()))
    return [s for s in statements if any(kind != "comment" and text.strip() for kind, text in s)]


def _bind(statement: list[tuple[str, str]], replacements: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    markers, out = _Markers(replacements), []
    # Neighbouring plain pieces are joined first: a placeholder may hold a character that parts them.
    joined: list[tuple[str, str]] = []
    for kind, text in statement:
        if kind == "other" and joined and joined[-1][0] == "other":
            joined[-1] = ("other", joined[-1][1] + text)
        else:
            joined.append((kind, text))
    for kind, text in joined:
        if kind == "comment":
            out.append(text)
            continue
        bound = _bind_text(text, markers) if kind == "text" else text
        if kind == "name" and "${" in text:
            raise ValueError(f"a quoted identifier cannot be bound, use IDENTIFIER: {text}")
        if kind == "other":
            bound = _PLACEHOLDER.sub(lambda m: markers.marker(m.group(1)), text)
        if "${" in bound:
            raise ValueError(f"malformed placeholder near {bound[bound.index('${'):][:40]!r}")
        out.append(bound)
    return "".join(out).strip(), markers.args()


def bind_template(script: str, replacements: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """One statement and the argument map for ``spark.sql``."""
    statements = split_script(script)
    if len(statements) != 1:
        raise ValueError(f"expected one statement, found {len(statements)}")
    return _bind(statements[0], replacements)


def run_sql(spark: SparkSession, text: str, args: dict[str, Any] | list[Any] | None = None) -> DataFrame:
    """Any SQL text, with named (``:name``) or positional (``?``) markers."""
    return spark.sql(text, args=args) if args else spark.sql(text)


def run_template(spark: SparkSession, script: str, replacements: dict[str, Any]) -> DataFrame:
    """Run a script; every statement is bound before the first one runs."""
    bound = [_bind(s, replacements) for s in split_script(script)]
    if not bound:
        raise ValueError("the script holds no statement")
    for text, args in bound[:-1]:
        run_sql(spark, text, args)
    return run_sql(spark, *bound[-1])
