"""Structured parts of model replies: questions, answers, documents, points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaloom.functions.keys import PY_SPACE, let, py_strip
from qaloom.functions.text import in_order, is_conclusion, renumbered_map

#: The quotes that may wrap an answer, whichever stands on which side.
QUOTES = "\"'“”‘’"


def strip_quotes(x: Column) -> Column:
    """Without quotes on both sides, however many, and without blanks around."""
    bare = py_strip(x)
    wrapped = lambda t: (F.length(t) >= 2) & t.rlike(f"^[{QUOTES}]") & t.rlike(f"[{QUOTES}]$")
    inner = lambda t: py_strip(F.substring(t, F.lit(2), F.length(t) - 2))
    most = F.length(F.regexp_extract(bare, f"^(?:[{QUOTES}]|{PY_SPACE})*", 0))
    return F.aggregate(F.sequence(F.lit(0), most), bare, lambda acc, _: F.when(wrapped(acc), inner(acc)).otherwise(acc))


def _first(rows: Column, prefix: str) -> Column:
    """Place of the first line that begins so; null without any."""
    return F.get(F.filter(F.transform(rows, lambda x, i: F.when(x.startswith(prefix), i)), lambda i: i.isNotNull()), F.lit(0))


def _last(rows: Column, prefix: str) -> Column:
    found = F.filter(F.transform(rows, lambda x, i: F.when(x.startswith(prefix), i)), lambda i: i.isNotNull())
    return F.get(found, F.size(found) - 1)


def qa_reply(reply: Column, adversarial: bool = False) -> Column:
    """question, answer and documents of a reply; null for what it lacks.

    The documents begin at the first line "Document 1".  Before it, the last line "Question" counts, with what stands after
    its colon, or the next line if that is nothing; and the last line "Answer", up to the first line "Document 1 Title".
    adversarial: an empty question lacks too."""

    def parts(rows: Column) -> Column:
        begin, title = _first(rows, "Document 1"), _first(rows, "Document 1 Title")
        head = F.slice(rows, F.lit(1), F.coalesce(begin, F.size(rows)))
        q, a = _last(head, "Question"), _last(head, "Answer")
        line = F.get(rows, q)
        own = F.when(F.contains(line, F.lit(":")), py_strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))))
        after = F.get(rows, q + 1)
        question = let(own, lambda x: F.when(x == "", F.coalesce(py_strip(after) if adversarial else after, x)).otherwise(x))
        body = F.array_join(F.slice(rows, a + 1, F.greatest(title - a, F.lit(0))), "\n")
        answer = F.when(F.contains(body, F.lit("Answer:")), py_strip(F.split_part(body, F.lit("Answer:"), F.lit(2))))
        documents = F.array_join(F.slice(rows, begin + 1, F.size(rows)), "\n")
        return F.struct((F.nullif(question, F.lit("")) if adversarial else question).alias("question"), answer.alias("answer"), documents.alias("documents"))

    return let(F.split(py_strip(reply), "\n", -1), parts)


def document_points(info: Column, bullets_only: bool = False) -> Column:
    """The points of each document, in order, as arrays.

    A heading with another number than the one before begins the next document, whatever the number.  Text after its colon
    is a point, unless it is a title.  Lines of up to two characters are none; of other lines one dash goes.
    bullets_only: headings only count, and only lines with a dash are points."""
    heading = lambda x: x.startswith("Document") & (F.length(x) > 2)
    label = lambda x: F.nullif(F.regexp_extract(x, r"^Document\s+(\d+)", 1), F.lit(""))
    bare = lambda x: F.when(x.startswith("-"), py_strip(F.substring(x, F.lit(2), F.length(x)))).otherwise(x)

    def inline(x: Column) -> Column:
        rest = F.substring(x, F.instr(x, ":") + 1, F.length(x))
        return F.when(F.contains(x, F.lit(":")) & ~F.contains(F.lower(x), F.lit("title:")) & (F.length(rest) > 2), bare(py_strip(rest)))

    def point(x: Column) -> Column:
        long = F.length(x) > 2
        if bullets_only:
            return F.when(long & ~heading(x), let(py_strip(x), lambda t: F.when(t.startswith("-"), bare(t))))
        return F.when(long, let(py_strip(x), lambda t: F.when(heading(x), inline(t)).when(t != "", bare(t))))

    def begins(rows: Column) -> Column:
        """Places of the headings whose number is another than the one before."""
        numbered = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("i"), F.when(heading(x), label(x)).alias("n"))), lambda x: x["n"].isNotNull())
        before = lambda own, k: F.when(k == 0, F.lit("1")).otherwise(F.get(own, k - 1)["n"])
        return let(numbered, lambda own: F.transform(F.filter(own, lambda x, k: x["n"] != before(own, k)), lambda x: x["i"]))

    def grouped(rows: Column, at: Column) -> Column:
        points = F.transform(rows, lambda x, i: F.struct((F.size(F.filter(at, lambda b: b <= i)) + 1).alias("d"), point(x).alias("p")))
        docs = lambda kept: F.transform(F.sequence(F.lit(1), F.size(at) + 1), lambda d: F.transform(F.filter(kept, lambda x: x["d"] == d), lambda x: x["p"]))
        return let(F.filter(points, lambda x: x["p"].isNotNull()), docs)

    return let(F.split(F.coalesce(info, F.lit("")), "\n", -1), lambda rows: let(begins(rows), lambda at: grouped(rows, at)))


def as_map(docs: Column) -> Column:
    """Documents in order as a map from "1", "2", ..."""
    return F.map_from_entries(F.transform(docs, lambda d, i: F.struct((i + 1).cast("string").alias("key"), d.alias("value"))))


def covers(points: Column, pool: Column) -> Column:
    """Whether every point is in the pool as often as it is asked for."""
    times = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    return F.forall(F.array_distinct(points), lambda x: times(points, x) <= times(pool, x))


def pool_of(document_map: Column) -> Column:
    return F.flatten(F.map_values(document_map))


def spliced(text: Column, flagged: Column, corrected: Column) -> Column:
    """The text with a point corrected in place; null if it doesn't hold the point word for word."""
    return F.when((F.length(flagged) > 0) & F.contains(text, flagged), F.replace(text, flagged, corrected))


def without_points(document_map: Column, removed: Column) -> Column:
    """A document map without some points; documents that lose all of theirs go, the rest are numbered anew."""
    kept = F.transform_values(document_map, lambda k, v: F.filter(v, lambda p: ~F.array_contains(removed, p)))
    return renumbered_map(F.map_filter(kept, lambda k, v: F.size(v) > 0))


def without_conclusions(points: Column) -> Column:
    return F.filter(points, lambda p: ~is_conclusion(p))


def documents_info(document_map: Column) -> Column:
    """Each document's heading and points, in numeric order, a blank line between documents."""
    block = lambda e: F.concat(F.lit("Document "), e["k"], F.lit(" Answer points assigned:\n"), F.array_join(F.transform(e["v"], lambda p: F.concat(F.lit("- "), p, F.lit("\n"))), ""))
    return py_strip(F.array_join(F.transform(in_order(document_map), block), "\n"))


def reply_documents(reply: Column, end: str = "Question:") -> Column:
    """The documents of a reply, from each heading "Document n:" on: heading, what stands before `end`, and what stands after
    the last "Text:" under that word again."""
    heads = F.regexp_extract_all(reply, F.lit(r"(Document \d+:)"), F.lit(1))
    parts = F.slice(F.split(reply, r"Document \d+:", -1), F.lit(2), F.size(heads))
    body = lambda x: F.concat(py_strip(F.split_part(x, F.lit(end), F.lit(1))), F.lit("\nText:\n"), py_strip(F.substring_index(x, "Text:", -1)))
    return F.zip_with(heads, parts, lambda h, x: F.concat(h, F.lit("\n"), body(x)))
