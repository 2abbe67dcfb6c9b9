"""Content keys and derived columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.strip() takes off.
PY_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def qid(qa_type: Column, persona: Column, environment: Column, question: Column) -> Column:
    """'q' and 16 hex digits of the content: stable however rows are sharded or renumbered.  Null parts count as empty."""
    parts = [F.coalesce(qa_type, F.lit("")), *(py_strip(F.coalesce(c, F.lit(""))) for c in (persona, environment, question))]
    return F.concat(F.lit("q"), F.substring(F.sha1(F.concat_ws("\0", *parts)), 1, 16))


def track(seed_type: Column) -> Column:
    return F.when(seed_type.isin("reg", "dynamic_reg"), "reg").otherwise("generic")


def missing_to_null(x: Column) -> Column:
    """Empty text and the word nan both mean missing."""
    stripped = py_strip(x)
    return F.when((stripped == "") | (stripped == "nan"), None).otherwise(x)


def qid_or(own: Column, qa_type: Column, persona: Column, environment: Column, question: Column) -> Column:
    """A relation's own key where it has one, else that of the content."""
    return F.coalesce(own, qid(qa_type, persona, environment, question))
