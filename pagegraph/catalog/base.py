"""A catalogue of queries."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import bounded_batches


class Catalogue:
    def __init__(self):
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function (spark, data dir) -> DataFrame with its SQL. Where it has Python in tasks, that sees small batches, as texts are long."""

        def add(f):
            @functools.wraps(f)
            def run(spark, d):
                bounded_batches(spark, 256, 8)
                return f(spark, d)

            self.functions[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


Rules = list[tuple[str, str]]


def rewritten(t: Column, rules: Rules) -> Column:
    """A text with patterns replaced one after the other; \1 refers to a group."""
    for pattern, new in rules:
        t = F.regexp_replace(t, pattern, re.sub(r"\\(\d)", r"$\1", new.replace("{", r"\{").replace("}", r"\}")))
    return t


def rewritten_sql(expression: str, rules: Rules) -> str:
    """The same in SQL."""
    for pattern, new in rules:
        pattern, new = pattern.replace("'", "''"), new.replace("'", "''")
        expression = f"regexp_replace({expression}, '{pattern}', '{new}', 'g')"
    return expression
