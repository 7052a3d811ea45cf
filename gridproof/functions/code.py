"""Checks of model-written code as text."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fragments that make code unsafe.
BANNED_FRAGMENTS = ("subprocess", "socket", "requests", "urllib", "http://", "https://", "os.system", "popen", "eval(", "exec(", "rmtree", "unlink(", "remove(", "rmdir(", "d:/", "d:\\", "c:/", "c:\\")
#: Modules that code must not import.
BANNED_IMPORTS = ("subprocess", "socket", "requests", "urllib", "httpx")


def banned_fragment(code: Column) -> Column:
    """The first banned fragment in the code, whatever its case; null if there is none."""
    low = F.lower(code)
    return F.coalesce(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in BANNED_FRAGMENTS])


@F.pandas_udf(StringType())
def banned_import(code: pd.Series) -> pd.Series:
    """The first banned module that the code imports, 'syntax error' where it doesn't parse, else null."""

    def found(text):
        if text is None:
            return None
        try:
            nodes = list(ast.walk(ast.parse(text)))
        except (SyntaxError, ValueError):
            return "syntax error"
        names = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
        return next((n for n in names if n.partition(".")[0] in BANNED_IMPORTS), None)

    return code.map(found)
