"""Function blocks, generated problems and tests as text.  Code is parsed, never run.

Line rules are column expressions; what has to keep track of blocks and brackets is an Arrow UDF.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from qaloom.functions.keys import let, py_strip

# Libraries and functions that no helper stands behind.
LIBRARIES = ("sklearn", "typing", "pandas", "scipy", "itertools", "datetime", "collections", "statistics")
BUILT_IN = ("len", "range", "enumerate", "zip", "sum", "min", "max", "abs", "round", "sorted")

_TEXTS = ArrayType(StringType())
BLOCK = StructType([StructField("function_name", StringType()), StructField("file_name", StringType()), StructField("parameters", MapType(StringType(), StringType())), StructField("objectives", _TEXTS), StructField("import_lines", _TEXTS), StructField("function_def", StringType())])
PROBLEM = StructType([StructField("statement", StringType()), StructField("function_name", StringType()), StructField("file_name", StringType()), StructField("import_lines", _TEXTS), StructField("function_def", StringType()), StructField("referenced", ArrayType(StructType([StructField("names", StringType()), StructField("module", StringType())])))])


def lines_of(x: Column) -> Column:
    return F.split(F.coalesce(x, F.lit("")), "\n", -1)


def unfenced(text: Column) -> Column:
    """What a code fence holds, or all of a text without one; ".py" goes from imports."""
    out = text
    for fence in ("```Python", "```python"):
        inner = py_strip(F.split_part(F.split_part(out, F.lit(fence), F.lit(2)), F.lit("```"), F.lit(1)))
        out = F.when(F.contains(out, F.lit(fence)), inner).otherwise(out)
    return F.replace(out, F.lit(".py import"), F.lit(" import"))


def import_line(line: Column) -> Column:
    """An import of the codebase as one from the modules themselves."""
    out = line
    for prefix in ("from .", "from C.", "from Codebase.", "from codebase."):
        out = F.replace(out, F.lit(prefix), F.lit("from "))
    return py_strip(out)


def _places(rows: Column, marker: str) -> Column:
    return F.filter(F.transform(rows, lambda x, i: F.when(F.contains(x, F.lit(marker)), i)), lambda i: i.isNotNull())


def objectives(problem: Column) -> Column:
    """The bullets between "Objectives:" and "Return Values:", dashes and all, a line each."""

    def listed(rows: Column, ends: Column) -> Column:
        upto = lambda i: F.coalesce(F.array_min(F.filter(ends, lambda e: e > i)), F.size(rows))
        part = lambda i: F.filter(F.slice(rows, i + 2, F.greatest(upto(i) - i - 1, F.lit(0))), lambda x: (F.length(x) > 1) & py_strip(x).startswith("-"))
        return F.array_join(F.transform(F.flatten(F.transform(_places(rows, "Objectives:"), part)), py_strip), "\n")

    return let(lines_of(problem), lambda rows: let(_places(rows, "Return Values:"), lambda ends: listed(rows, ends)))


def scrubbed_objectives(problem: Column, names: Column) -> Column:
    """A problem whose objectives mention none of the names; what stands before and after them is as it was.  Null without
    objectives."""
    head, tail = F.split_part(problem, F.lit("Objectives:"), F.lit(1)), F.split_part(problem, F.lit("Objectives:"), F.lit(2))
    part = F.split_part(tail, F.lit("Return Values:"), F.lit(1))
    after = F.split_part(problem, F.lit("Return Values:"), F.lit(2))
    bare = F.aggregate(names, part, lambda acc, n: F.replace(acc, n, F.lit("")))
    return F.when(F.contains(problem, F.lit("Objectives:")), F.concat(head, F.lit("Objectives:"), bare, F.lit("Return Values:"), after))


def asserts_at_end(code: Column, last: int = 5) -> Column:
    """Whether one of the last lines is an assert that looks at a value: no comment, no None, no shape."""
    rows = lines_of(code)
    end = F.slice(rows, F.greatest(F.size(rows) - last + 1, F.lit(1)), F.lit(last))
    has = lambda x, t: F.contains(x, F.lit(t))
    return F.exists(end, lambda x: has(x, "assert") & ~py_strip(x).startswith("#") & ~has(x, "None") & ~has(x, ".shape"))


def called_functions(code: Column) -> Column:
    """Names that assignments after a "def " line call, in order: plain names with brackets right of the first "=", but
    built-in ones.  What follows several such lines is listed for each."""
    starts = lambda rows: F.filter(F.transform(rows, lambda x, i: F.when(x.startswith("def "), i)), lambda i: i.isNotNull())
    right = lambda x: py_strip(F.split_part(x, F.lit("="), F.lit(2)))
    name = lambda x: py_strip(F.split_part(right(x), F.lit("("), F.lit(1)))
    call = lambda x: F.contains(x, F.lit("=")) & F.contains(right(x), F.lit("(")) & F.contains(right(x), F.lit(")")) & ~name(x).rlike(r"[ .\[]") & ~name(x).isin(*BUILT_IN)
    after = lambda rows, i: F.transform(F.filter(F.slice(rows, i + 2, F.size(rows)), call), name)
    return let(lines_of(code), lambda rows: F.flatten(F.transform(starts(rows), lambda i: after(rows, i))))


def imports_helper(test: Column, names: Column) -> Column:
    """Whether a test imports one of the helpers by name."""
    return F.exists(names, lambda n: F.contains(test, F.concat(F.lit("import "), n)))


def described_counts(problem: Column) -> Column:
    """n_parameters and n_returns: the bullets of a problem's "Parameters:" (up to "Objectives:") and "Return Values:"."""
    def counts(rows: Column) -> Column:
        begin, end, back = (F.get(_places(rows, m), F.lit(0)) for m in ("Parameters:", "Objectives:", "Return Values:"))
        dashes = lambda a, b: F.size(F.filter(F.slice(rows, a + 2, F.greatest(b - a - 1, F.lit(0))), lambda x: F.contains(x, F.lit("-"))))
        upto = F.when(end > begin, end).otherwise(F.size(rows))
        return F.struct(F.coalesce(dashes(begin, upto), F.lit(0)).alias("n_parameters"), F.coalesce(dashes(back, F.size(rows)), F.lit(0)).alias("n_returns"))

    return let(lines_of(problem), counts)


def defined_counts(code: str | None) -> tuple[int, int]:
    """Parameters of a definition's head, commas within brackets aside, and values of its last return."""
    head = re.search(r"\(", code or "")
    n, depth, some = 0, 0, False
    for c in (code or "")[head.end() :] if head else "":
        if c in "[({":
            depth += 1
        elif c in "])}":
            if depth == 0:
                break
            depth -= 1
        elif c == "," and depth == 0:
            n, some = n + some, False
            continue
        some = some or not c.isspace()
    returned = [x.strip() for x in (code or "").split("\n") if "return " in x]
    return n + some, len(returned[-1].removeprefix("return ").split(",")) if returned else 0


@F.pandas_udf(StructType([StructField("n_parameters", IntegerType()), StructField("n_returns", IntegerType())]))
def definition_counts(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([defined_counts(c) for c in code], columns=["n_parameters", "n_returns"])


def signature_agrees(code: Column, problem: Column) -> Column:
    """Whether a definition takes and returns as many values as its problem describes."""
    has, wants = definition_counts(code), described_counts(problem)
    return (has["n_parameters"] == wants["n_parameters"]) & (has["n_returns"] == wants["n_returns"])


def _where(rows: list[str], at: int, stop: Callable[[str], bool]) -> int:
    """The first line from `at` on that stops a part; the end without one."""
    return next((i for i in range(at, len(rows)) if stop(rows[i])), len(rows))


def _bullets(rows: list[str]) -> list[str]:
    return [x.strip()[1:].strip() for x in rows if len(x) > 1 and x.strip().startswith("-")]


_HEAD = re.compile(r"Function(.*?)in file([^:]*)")
_INDENTED = re.compile(r"^(\t| {4})")


def function_blocks(text: str | None) -> list[dict]:
    """Each block of "Parameters:", "Objectives:", a head line 'Function "f" in file "m.py":', imports and a definition.

    A definition ends with its first return at the first level of indent, or before the first line that isn't indented.
    Blocks with a function inside the function, and blocks that break off, are left out."""
    rows = re.sub(r"```(Python)?", "", text or "").split("\n")
    out = []
    for start in (i for i, x in enumerate(rows) if "Parameters:" in x):
        aims = _where(rows, start + 1, lambda x: "Objectives:" in x)
        head = _where(rows, aims + 1, lambda x: "Function" in x and "in file" in x)
        begin = _where(rows, head + 1, lambda x: "def " in x)
        found = _HEAD.search(rows[head]) if head < len(rows) else None
        if found is None or begin == len(rows):
            continue
        body = begin + 1
        while body < len(rows) and (not rows[body].strip() or rows[body][0] in " \t") and not re.match(r"(\t| {4})(def|return) ", rows[body]):
            body += 1
        if body < len(rows) and re.match(r"(\t| {4})def ", rows[body]):
            continue
        closed = body < len(rows) and _INDENTED.match(rows[body])
        pairs = [p.split(":") for p in _bullets(rows[start + 1 : aims])]
        name, file = (re.sub("[\"']", "", g).strip() for g in found.groups())
        out.append({
            "function_name": name, "file_name": file, "parameters": {p[0].strip(): p[1].strip() for p in pairs if len(p) > 1}, "objectives": _bullets(rows[aims + 1 : head]),
            "import_lines": [x.strip() for x in rows[head + 1 : begin] if "import " in x], "function_def": "\n".join(rows[begin : body + bool(closed)]).rstrip("\n"),
        })
    return out


@F.pandas_udf(ArrayType(BLOCK))
def functions_in(text: pd.Series) -> pd.Series:
    return text.map(function_blocks)


def definitions(text: str | None, file: str | None) -> list[dict]:
    """Every definition of a file's text, from its "def " to the next; all carry the file's imports."""
    rows = (text or "").split("\n")
    starts = [i for i, x in enumerate(rows) if "def " in x and "import " not in x]
    imports = [x.strip() for x in rows if "import " in x]
    bodies = ["\n".join(rows[a:b]).strip() for a, b in zip(starts, [*starts[1:], len(rows)], strict=True)]
    return [{"function_name": b.split("(")[0].split("def ")[1].strip(), "file_name": file, "parameters": {}, "objectives": [], "import_lines": imports, "function_def": b} for b in bodies]


@F.pandas_udf(ArrayType(BLOCK))
def definitions_in(text: pd.Series, file: pd.Series) -> pd.Series:
    """definitions() of code without its fence (see unfenced)."""
    return pd.Series([definitions(t, f) for t, f in zip(text, file, strict=True)])


def generated_problem(text: str | None) -> dict | None:
    """A reply with a problem's statement, a head 'Function f in m.py:', imports and a definition; None if it lacks a part.

    referenced: names and module of each import from a module that is no library."""
    body = (text or "").strip()
    for fence in ("```Python", "```python"):
        if body.startswith(fence):
            body = body.split(fence)[1].strip().replace(".py:\n", f".py:\n\n{fence}\n")
    rows = body.split("\n")
    head = _where(rows, 0, lambda x: x.replace("#", "").strip().startswith("Function ") and " in " in x)
    begin = _where(rows, head + 1, lambda x: x.startswith("def "))
    statement = "\n".join(rows[:head]).partition("Parameters:")[2].strip()
    if begin >= len(rows):
        return None
    bare = lambda x: re.sub("[\"'`]", "", x).strip()
    left, right = rows[head].split(" in ")[:2]
    name, file = bare(left.partition("Function")[2]), bare(right.split(":")[0]).split(" ")[-1]
    kept: list[str] = []
    for x in "\n".join(rows[begin:]).strip().replace("```python", "").replace("```", "").split("\n"):
        if x and not x.startswith("def ") and x.strip() and x[0] not in " \t)":
            break
        kept += [x] if x else []
    imports = [x for x in rows[head + 1 : begin] if "import" in x]
    outside = [x.partition(" import ") for x in imports if x.strip().startswith("from ") and " import " in x]
    own = [(a.strip()[5:].strip(), names.strip()) for a, _, names in outside]
    tidy = lambda x: re.sub(r"from (?:\.|C\.|Codebase\.|codebase\.)", "from ", x).strip()
    return {
        "statement": f"Parameters:\n{statement}\n\nThe name of the function you create should be {name}", "function_name": name, "file_name": file, "import_lines": [tidy(x) for x in imports],
        "function_def": "\n".join(kept), "referenced": [{"names": names, "module": m.split(".")[-1]} for m, names in own if not any(k in m for k in LIBRARIES)],
    }


@F.pandas_udf(PROBLEM)
def problem_in(text: pd.Series) -> pd.DataFrame:
    found = [generated_problem(t) or dict.fromkeys(PROBLEM.names) for t in text]
    return pd.DataFrame(found, columns=PROBLEM.names)


def functions_text(functions: Column) -> Column:
    """Blocks as function_blocks reads them, one after another."""
    params = lambda f: F.array_join(F.transform(F.map_entries(f["parameters"]), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    aims = lambda f: F.array_join(F.transform(f["objectives"], lambda o: F.concat(F.lit("- "), o, F.lit("\n"))), "")
    one = lambda f: F.concat(F.lit("Parameters:\n"), params(f), F.lit("Objectives:\n"), aims(f), F.lit("\n"), bare_function_text(f))
    return F.array_join(F.transform(functions, one), "")


def bare_function_text(f: Column, quote: str = '"') -> Column:
    """A block without its description."""
    imports = F.array_join(F.transform(f["import_lines"], lambda x: F.concat(x, F.lit("\n"))), "")
    return F.concat(F.lit(f"Function {quote}"), f["function_name"], F.lit(f"{quote} in file {quote}"), f["file_name"], F.lit(f"{quote}:\n\n"), imports, F.lit("\n"), f["function_def"], F.lit("\n\n"))


def context_text(functions: Column) -> Column:
    """The functions by file, files in order of appearance, each file's imports once."""
    files = F.array_distinct(F.transform(functions, lambda f: f["file_name"]))
    own = lambda n: F.filter(functions, lambda f: f["file_name"] == n)
    imports = lambda n: F.array_join(F.array_distinct(F.flatten(F.transform(own(n), lambda f: f["import_lines"]))), "\n")
    defs = lambda n: py_strip(F.array_join(F.transform(own(n), lambda f: f["function_def"]), "\n\n"))
    one = lambda n: F.concat(F.lit("File: "), n, F.lit(":\n\n```Python\n"), imports(n), F.lit("\n\n"), defs(n), F.lit("\n```"))
    return F.array_join(F.transform(files, one), "\n\n")
