"""Parsers of model text as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.keys import PY_SPACE, py_strip

# Code fences, numbered lines, verdict lines, bold text, and the phrases that begin a conclusion.
FENCE = r"^\s*```[a-zA-Z]*\s*$"
NUMBERED = r"^\s*(\d+)\s*[.)]\s*(.+?)\s*$"
VERDICT = r"(?i)^\s*(\d+)\s*[.)]\s*(yes|no|unsure)\b"
BOLD = r"^\*\*(.*?)\*\*$"
CONCLUSIONS = ("In conclusion,", "In summary,", "To summarize")


def py_tokens(x: Column) -> Column:
    """Python's lower().split()."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), PY_SPACE + "+"), lambda t: t != "")


def lines(x: Column) -> Column:
    return F.split(F.coalesce(x, F.lit("")), "\n", -1)


def escape_newlines(x: Column) -> Column:
    return F.replace(x, F.lit("\n"), F.lit("\\n"))


def unescape_newlines(x: Column) -> Column:
    return F.replace(x, F.lit("\\n"), F.lit("\n"))


def bullet_points(answer: Column) -> Column:
    """Non-empty lines, stripped, without one leading dash."""
    kept = F.filter(F.transform(lines(answer), py_strip), lambda t: t != "")
    return F.transform(kept, lambda t: F.when(t.startswith("-"), py_strip(F.substring(t, F.lit(2), F.length(t)))).otherwise(t))


def numbered_lines(text: Column) -> Column:
    """Bodies of lines like "3. body" or "3) body", in order, whatever the numbers; fences are skipped, ** taken off."""
    kept = F.filter(lines(text), lambda t: ~t.rlike(FENCE) & t.rlike(NUMBERED))
    body = F.transform(kept, lambda t: py_strip(F.regexp_extract(t, NUMBERED, 2)))
    bare = F.transform(body, lambda t: py_strip(F.regexp_replace(t, BOLD, "$1")))
    return F.filter(bare, lambda t: t != "")


def verdict_lines(text: Column, expected: Column) -> Column:
    """Yes, No or Unsure for each index 1..expected: the first line that names it counts, none means Unsure."""
    own = F.filter(lines(text), lambda t: ~t.rlike(r"^\s*```") & t.rlike(VERDICT))
    pairs = F.transform(own, lambda t: F.struct(F.regexp_extract(t, VERDICT, 1).try_cast("int").alias("i"), F.initcap(F.lower(F.regexp_extract(t, VERDICT, 2))).alias("v")))
    first = lambda k: F.get(F.filter(pairs, lambda p: p["i"] == k), F.lit(0))["v"]
    return F.when(expected > 0, F.transform(F.sequence(F.lit(1), F.greatest(expected, F.lit(1))), lambda k: F.coalesce(first(k), F.lit("Unsure")))).otherwise(F.array().cast("array<string>"))


def strip_titles(text: Column) -> Column:
    """Without the lines that speak of a title, in whatever case."""
    kept = F.filter(lines(text), lambda t: ~F.contains(F.lower(t), F.lit("title")))
    return py_strip(F.array_join(kept, "\n"))


def is_conclusion(line: Column, dash: bool = False) -> Column:
    """Whether a point (dash: or a bullet) is the conclusion."""
    low = F.lower(py_strip(line))
    return low.startswith("conclusion:") | low.startswith("- conclusion:") if dash else low.startswith("conclusion:")


def strip_conclusions(text: Column) -> Column:
    """Without the lines or bullets of a conclusion."""
    return py_strip(F.array_join(F.filter(lines(text), lambda t: ~is_conclusion(t, True)), "\n"))


def cut_document(text: Column) -> Column:
    """What stands after the first "Title:" (up to a second one), under that title again, up to the first phrase that begins
    a conclusion; a text without a title from its beginning."""
    out = F.when(F.contains(text, F.lit("Title:")), F.concat(F.lit("Title: "), py_strip(F.split_part(text, F.lit("Title:"), F.lit(2))))).otherwise(text)
    for marker in CONCLUSIONS:
        out = F.substring_index(out, marker, 1)
    return py_strip(out)


def answer_number(reply: Column) -> Column:
    """The number after "the answer is ", without marks and separators; null if there is none."""
    low = F.regexp_replace(py_strip(F.lower(reply)), r"\.$", "")
    tail = F.when(F.contains(low, F.lit("the answer is ")), F.split_part(low, F.lit("the answer is "), F.lit(2)))
    word = F.get(py_tokens(F.regexp_replace(tail, r"\*\*|[<>{}\[\]]|\\\[|\\\]", "")), F.lit(0))
    return word_to_number(word)


def word_to_number(word: Column) -> Column:
    plain = F.regexp_replace(word, r"[$,%]", "")
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.cast("double"))


def truth_number(answer: Column) -> Column:
    """The number after "####", else the last line's."""
    last = F.when(F.contains(answer, F.lit("####")), F.substring_index(answer, "####", -1)).otherwise(F.substring_index(answer, "\n", -1))
    return word_to_number(py_strip(last))


def number_matches(reply: Column, answer: Column) -> Column:
    return F.coalesce(F.abs(answer_number(reply) - truth_number(answer)) < 1e-5, F.lit(False))


def said_true(reply: Column, marker: str) -> Column:
    """Whether the text before `marker` says true; null where the marker is lacking or neither word stands."""
    head = F.lower(F.when(F.contains(reply, F.lit(marker)), F.split_part(reply, F.lit(marker), F.lit(1))))
    return F.when(F.contains(head, F.lit("true")), True).when(F.contains(head, F.lit("false")), False)


def graded_correct(reply: Column, reference_compatible: bool = True) -> Column:
    """Whether a grader's reply says correct.  The reference takes "incorrect" for "correct", as one word holds the other;
    reference_compatible=False does not."""
    low = F.lower(reply)
    return F.contains(low, F.lit("correct")) if reference_compatible else low.rlike(r"\bcorrect\b")


def evaluated(reply: Column, style: str = "verdict") -> Column:
    """An evaluator's mark as a whole number.  "score": the first word, without its last character if it holds a stop or comma,
    0 if that is no number; "step-by-step": 1 if the final verdict line says so or the last line holds "correct" (which
    "incorrect" does too); else 1 if the first word holds "true"."""
    stripped = py_strip(F.coalesce(reply, F.lit("")))
    word = F.coalesce(F.get(F.filter(F.split(stripped, PY_SPACE + "+"), lambda t: t != ""), F.lit(0)), F.lit(""))
    if style == "score":
        bare = F.when(word.rlike("[.,]"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
        return F.coalesce(F.when(bare.rlike(r"^[+-]?\d+$"), bare.try_cast("int")), F.lit(0))
    if style == "step-by-step":
        return (F.contains(reply, F.lit("FINAL VERDICT: Correct")) | F.contains(F.lower(F.substring_index(stripped, "\n", -1)), F.lit("correct"))).cast("int")
    return F.contains(F.lower(word), F.lit("true")).cast("int")


def graded_or_error(prediction: Column, reply: Column) -> Column:
    """The grader's reply; predictions that are lacking, empty or an error are false without one."""
    lacks = prediction.isNull() | py_strip(prediction).isin("", "error")
    return F.when(lacks, F.lit("False. Error in prediction.")).otherwise(reply)


def rating(text: Column, may_lack: bool = False) -> Column:
    """yes, no or (may_lack) n/a; null for what the instrument doesn't allow."""
    low = F.lower(py_strip(text))
    out = F.when(low.isin("y", "yes", "1", "true"), "yes").when(low.isin("n", "no", "0", "false"), "no")
    return out.when(low.isin("n/a", "na", "not applicable"), "n/a") if may_lack else out


def key_values(text: Column, separator: str | None = None) -> Column:
    """"k=v,k=v" as a map of stripped texts, or of lists where values are parted by `separator`; null if a part has no "="
    or a key repeats."""
    parts = F.split(text, ",")
    pair = lambda x: F.split(x, "=", 2)
    value = lambda x: py_strip(F.get(pair(x), F.lit(1)))
    many = (lambda x: F.filter(F.transform(F.split(value(x), re.escape(separator)), py_strip), lambda y: y != "")) if separator else value
    keys = F.transform(parts, lambda x: py_strip(F.get(pair(x), F.lit(0))))
    fits = F.forall(parts, lambda x: F.contains(x, F.lit("="))) & (F.size(F.array_distinct(keys)) == F.size(keys))
    return F.when(fits, F.map_from_arrays(F.when(fits, keys).otherwise(F.array().cast("array<string>")), F.when(fits, F.transform(parts, many)).otherwise(F.array().cast("array<array<string>>" if separator else "array<string>"))))


def first_bucket(text: Column, buckets: list[tuple[str, str]], other: str) -> Column:
    """The first bucket whose pattern the lower-cased text holds."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.rlike(p), F.lit(n)) for n, p in buckets), F.lit(other))


def all_buckets(text: Column, buckets: list[tuple[str, str]]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*(F.when(low.rlike(p), F.lit(n)) for n, p in buckets)), lambda x: x.isNotNull())


def families(text: Column, pattern: str, other: str = "OTHER") -> Column:
    """What the pattern's group takes from a text's first line, stripped; `other` where it doesn't match there."""
    head = F.substring_index(py_strip(text), "\n", 1)
    return F.coalesce(F.nullif(py_strip(F.regexp_extract(head, r"^\s*(?:" + pattern + ")", 1)), F.lit("")), F.lit(other))


def json_list_size(text: Column) -> Column:
    """Elements of a JSON list; null for anything else."""
    return F.json_array_length(text)


def empty_bullets(points: Column) -> Column:
    """Empty points before the last filled one (interior), after it (trailing), and filled ones."""
    filled = F.transform(points, lambda t: py_strip(F.coalesce(t, F.lit(""))) != "")
    last = F.coalesce(F.array_max(F.transform(filled, lambda x, i: F.when(x, i + 1))), F.lit(0))
    inside = F.size(F.filter(filled, lambda x, i: ~x & (i < last)))
    return F.struct(inside.alias("interior"), (F.size(points) - last).alias("trailing"), F.size(F.filter(filled, lambda x: x)).alias("filled"))


def decoded_json_list(text: Column, levels: int = 4) -> Column:
    """A list of strings that may be encoded up to `levels` times over."""
    out, now = [], text
    for _ in range(levels):
        out.append(F.from_json(now, "array<string>"))
        now = F.get_json_object(now, "$")
    return F.coalesce(*out)


def renumbered_map(m: Column) -> Column:
    """A map with numbers as text keys: in numeric order, numbered anew from 1.  Keys that are no number follow, by text."""
    return F.map_from_entries(F.transform(in_order(m), lambda e, i: F.struct((i + 1).cast("string").alias("key"), e["v"].alias("value"))))


def in_order(m: Column) -> Column:
    """A map's entries (k, v) in the order of their keys as numbers; keys that are none follow, by text."""
    place = lambda e: F.struct(F.coalesce(e["key"].try_cast("long"), F.lit((1 << 63) - 1)).alias("n"), e["key"].alias("k"))
    keys = F.array_sort(F.transform(F.map_entries(m), place))
    return F.transform(keys, lambda x: F.struct(x["k"].alias("k"), F.try_element_at(m, x["k"]).alias("v")))


def siblings(values: Column) -> Column:
    """For each element, all others by place: equal values don't hide each other."""
    return F.transform(values, lambda v, i: F.struct(v.alias("own"), F.filter(values, lambda w, j: j != i).alias("others")))


def assembled_documents(relevant: Column, adversarial: Column, seed: Column) -> Column:
    """Both lists in an order drawn by hash, each headed "Document k:"."""
    both = F.concat(relevant, adversarial)
    drawn = F.array_sort(F.transform(both, lambda d, i: F.struct(F.sha1(F.concat_ws("|", seed, i.cast("string"))).alias("h"), d.alias("d"))))
    return F.array_join(F.transform(drawn, lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), x["d"])), "\n\n")


def prompt(template: str, slots: dict[str, Column]) -> Column:
    """A template with {name} slots; a value that looks like a slot stays as it is, and so does a slot without a value."""
    parts = re.split(r"\{(\w+)\}", template)
    filled = [F.lit(p) if k % 2 == 0 else F.coalesce(slots[p], F.lit("")) if p in slots else F.lit("{" + p + "}") for k, p in enumerate(parts)]
    return F.concat(*filled)
