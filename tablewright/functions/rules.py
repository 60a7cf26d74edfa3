"""Rules written as text, one ``condition => outcome`` a line.

Columns stand between dollar signs and texts between double quotes; conditions may use comparisons,
``AND``, ``OR``, ``NOT``, ``IN (…)`` and ``MISSING $column$``.  Lines that start with ``//``, empty lines and
lines without an arrow are no rules.  The condition ``TRUE`` or ``FALSE`` sets the default.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .conditions import rule_column

_PART = re.compile(r'"(?P<text>[^"]*)"|MISSING\s+\$(?P<missing>[^$]+)\$|\$(?P<column>[^$]+)\$')


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _sql(written: str) -> str:
    """An expression of rule text as Spark SQL; what stands in quotes stays as it is."""

    def part(found: re.Match) -> str:
        if found["text"] is not None:
            return "'" + found["text"].replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"({_name(found['missing'])} IS NULL)" if found["missing"] else _name(found["column"])

    return _PART.sub(part, written)


def read_rules(text: str) -> list[tuple[str, Column]]:
    """The rules of a text in order, as :func:`rule_column` takes them."""
    rules = []
    for line in map(str.strip, text.strip().split("\n")):
        condition, arrow, outcome = line.partition("=>")
        if arrow and not line.startswith("//"):
            rules.append((_sql(condition.strip()), F.expr(_sql(outcome.strip()))))
    return rules


def rule_text_column(df: DataFrame, name: str, text: str) -> DataFrame:
    """Column by rule text; see :func:`rule_column` for what wins and for the default."""
    return rule_column(df, name, read_rules(text))
