"""Verification of questions against their documents, with recorded replies.

A pass is a relation of prompts (one row a document, or a document and a point), a join with the recorded replies, a parse,
and a join back: every pass runs over all rows at once.  A reply that is lacking changes nothing and is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions import responses as R
from qaloom.functions import text as X
from qaloom.functions.keys import py_strip
from qaloom.functions.prompts import filled
from qaloom.operators.responder import known_replies, replay
from qaloom.tables import written

# What replies are parsed by.
EXTRA, RELEVANT = "Extra Points Mentioned", "Relevant Points"
NOTHING = ("none of the points in the document", "document does not provide any information")
NO_ANSWER = "no relevant information found in this document."


def prompt(kind: str, **slots: Column) -> Column:
    return filled("verify", kind, **slots)


def says(reply: Column, word: str, before: str) -> Column:
    """Whether the word stands in a reply before a marker (anywhere, if the marker is lacking)."""
    return F.contains(F.lower(F.split_part(reply, F.lit(before), F.lit(1))), F.lit(word))


def stated(reply: Column, marker: str) -> Column:
    """What follows a marker's colon, up to the next colon; null without the marker."""
    tail = F.when(F.contains(reply, F.lit(marker)), F.split_part(reply, F.lit(marker), F.lit(2)))
    return F.when(F.contains(tail, F.lit(":")), py_strip(F.split_part(tail, F.lit(":"), F.lit(2))))


def extra_points(reply: Column, marker: str = EXTRA, avoid: tuple[str, ...] = NOTHING) -> Column:
    """What must leave a document by a check's reply; null if nothing does."""
    found = stated(reply, marker)
    vague = F.lit(False)
    for a in avoid:
        vague |= F.contains(F.lower(found), F.lit(a))
    return F.when(~says(reply, "false", marker) & ~vague, found)


def present(reply: Column) -> Column:
    """Whether a presence check finds its point there and relevant; null without a reply, false if a part is lacking."""
    head = F.split_part(reply, F.lit("Explanation for Relevance"), F.lit(1))
    relevance = F.when(F.contains(head, F.lit("Relevance:")), F.contains(F.lower(F.split_part(head, F.lit("Relevance:"), F.lit(2))), F.lit("true")))
    return F.when(reply.isNotNull(), says(reply, "true", "Explanation for Presence") & F.coalesce(relevance, F.lit(False)))


def absent_conclusion(reply: Column) -> Column:
    """The same where the document must hold the point and not the conclusion."""
    head = F.split_part(reply, F.lit("Explanation for Absence"), F.lit(1))
    part = F.when(F.contains(head, F.lit("Absence of Conclusion:")), F.contains(F.lower(F.split_part(head, F.lit("Absence of Conclusion:"), F.lit(2))), F.lit("true")))
    return F.when(reply.isNotNull(), says(reply, "true", "Explanation for Presence") & F.coalesce(part, F.lit(False)))


def on_topic(reply: Column) -> Column:
    """The last line "On_Topic: True" or "On_Topic: False"; null without one."""
    found = F.regexp_extract_all(reply, F.lit(r"(?m)^On_Topic:\s*(True|False)\s*$"), F.lit(1))
    return F.when(F.size(found) > 0, F.get(found, F.size(found) - 1) == "True")


def grounding(reply: Column) -> Column:
    """grounded, flagged and corrected of a grounding check: the points with which a reply says what to put for what."""
    head = F.split_part(reply, F.lit("Flagged Point"), F.lit(1))
    grounded = F.when(F.contains(head, F.lit("Grounded:")), ~F.contains(F.lower(F.split_part(head, F.lit("Grounded:"), F.lit(2))), F.lit("false")))
    line = lambda m: R.strip_quotes(F.nullif(F.regexp_extract(reply, rf"(?m)^{m}[^:\n]*:[^\S\n]*(.*)$", 1), F.lit("")))
    return F.struct(grounded.alias("grounded"), line("Flagged Point").alias("flagged"), line("Corrected Point").alias("corrected"))


def corrected_in_place(answer: Column, info: Column, replies: Column, most: int = 3) -> Column:
    """answer, info and discarded after up to `most` grounding checks whose replies stand in an array.

    A grounded reply ends the loop; otherwise the flagged point is put right in the answer and, where it stands there too,
    in the documents.  A point that the answer doesn't hold word for word discards the row, as does no grounded reply at all."""
    start = F.struct(answer.alias("answer"), info.alias("info"), F.lit("going").alias("state"))

    def step(acc: Column, reply: Column) -> Column:
        g = grounding(reply)
        miss = ~F.coalesce((F.length(g["flagged"]) > 0) & F.contains(acc["answer"], g["flagged"]), F.lit(False))
        going = acc["state"] == "going"
        ok = F.coalesce(g["grounded"], F.lit(True))
        state = F.when(~going, acc["state"]).when(ok, "kept").when(miss, "discarded").otherwise("going")
        put = lambda x: F.when(going & ~ok & ~miss, F.replace(x, g["flagged"], F.coalesce(g["corrected"], F.lit("")))).otherwise(x)
        return F.struct(put(acc["answer"]).alias("answer"), put(acc["info"]).alias("info"), state.alias("state"))

    done = F.aggregate(F.slice(replies, 1, most), start, step)
    return F.struct(done["answer"].alias("answer"), done["info"].alias("info"), (done["state"] != "kept").alias("discarded"))


def _removed(docs: DataFrame, recorded: DataFrame, points: Column) -> DataFrame:
    """docs: ..., question, doc, info.  Documents from which info must go take the reply's text."""
    asked = docs.withColumn("prompt", F.when(F.col("info").isNotNull(), prompt("remove", question=F.col("question"), points=points, info=F.col("info"), doc=F.col("doc"))))
    got = replay(asked, recorded)
    return got.withColumn("doc", F.coalesce(F.when(F.col("info").isNotNull(), py_strip("reply")), F.col("doc"))).drop("prompt", "reply", "info")


def verified_documents(rows: DataFrame, recorded: DataFrame, key: str = "key") -> DataFrame:
    """rows: key, question, docs (array), points (array of arrays, as long), adversarial (array of arrays).  recorded: prompt,
    reply.  Returns key, docs and adversarial after the passes: further points out of the documents; what an answer from
    a document alone holds beyond the points out; the same for adversarial documents; points that a document lacks, in."""
    recorded = written(known_replies(recorded), "replies")  # once for all passes
    at = rows.select(key, "question", F.posexplode(F.arrays_zip("docs", "points")).alias("no", "x"))
    docs = at.select(key, "question", "no", F.col("x.docs").alias("doc"), F.col("x.points").alias("own"))
    joined = F.array_join("own", "\n")
    asked = replay(docs.withColumn("prompt", prompt("extra", question=F.col("question"), points=joined, doc=F.col("doc"))), recorded)
    docs = _removed(asked.withColumn("info", extra_points(F.col("reply"))).drop("prompt", "reply"), recorded, joined)
    said = replay(docs.withColumn("prompt", prompt("predict", question=F.col("question"), doc=F.col("doc"))), recorded).withColumnRenamed("reply", "answer")
    some = F.lower(py_strip("answer")) != NO_ANSWER
    compared = replay(said.withColumn("prompt", F.when(some, prompt("compare", question=F.col("question"), points=joined, answer=F.col("answer")))), recorded)
    docs = written(_removed(compared.withColumn("info", extra_points(F.col("reply"), avoid=())).drop("prompt", "reply", "answer"), recorded, joined), "documents")  # two passes read them
    point = docs.select(key, "no", "question", "doc", F.posexplode("own").alias("p", "point"))
    checked = replay(point.withColumn("prompt", prompt("presence", question=F.col("question"), point=F.col("point"), doc=F.col("doc"))), recorded)
    lacking = checked.where(~present(F.col("reply"))).groupBy(key, "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "point"))), lambda x: x["point"]), "\n").alias("info"))  # one document's
    added = docs.join(lacking.hint("merge"), [key, "no"], "left").withColumn("prompt", F.when(F.col("info").isNotNull(), prompt("add", question=F.col("question"), info=F.col("info"), doc=F.col("doc"))))
    docs = replay(added, recorded).withColumn("doc", F.coalesce(py_strip("reply"), F.col("doc")))

    group = rows.select(key, "question", F.posexplode("adversarial").alias("g", "list")).select(key, "question", "g", F.posexplode("list").alias("no", "doc"))
    asked = replay(group.withColumn("prompt", prompt("extra_adv", question=F.col("question"), doc=F.col("doc"))), recorded)
    group = _removed(asked.withColumn("info", extra_points(F.col("reply"), RELEVANT, ())).drop("prompt", "reply"), recorded, F.lit(None).cast("string"))
    said = replay(group.withColumn("prompt", prompt("predict", question=F.col("question"), doc=F.col("doc"))), recorded)
    group = _removed(said.withColumn("info", F.when(F.lower(py_strip("reply")) != NO_ANSWER, F.col("reply"))).drop("prompt", "reply"), recorded, F.lit(None).cast("string"))

    listed = lambda d, by: d.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "doc"))), lambda x: x["doc"]).alias("list"))
    own = listed(docs, [key]).withColumnRenamed("list", "docs")
    adv = listed(group, [key, "g"]).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "list"))), lambda x: x["list"]).alias("adversarial"))  # one question's
    none = F.array().cast("array<string>")
    return rows.select(key).join(own.hint("merge"), key, "left").join(adv.hint("merge"), key, "left").select(key, F.coalesce("docs", none).alias("docs"), F.coalesce("adversarial", F.array().cast("array<array<string>>")).alias("adversarial"))


def _without_first(a: Column, x: Column) -> Column:
    at = F.array_position(a, x)
    return F.when(at > 0, F.concat(F.slice(a, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(a, at + 1, F.size(a)))).otherwise(a)


def without_hits(points: Column, docs: Column, answer: Column, hits: Column) -> Column:
    """points, docs and answer of a sibling that loses the hit points, one after another.

    The first equal point goes, and so it does from the first document that holds it; documents that are empty up to there
    go (all empty ones, if none holds it); of the answer the first line that is the point, with or without its dash, goes."""
    start = F.struct(points.alias("points"), docs.alias("docs"), X.lines(answer).alias("lines"))

    def step(acc: Column, p: Column) -> Column:
        holder = F.get(F.filter(F.transform(acc["docs"], lambda d, i: F.when(F.array_contains(d, p), i)), lambda i: i.isNotNull()), F.lit(0))
        left = F.transform(acc["docs"], lambda d, i: F.when(i == holder, _without_first(d, p)).otherwise(d))
        some = F.filter(left, lambda d, i: (F.size(d) > 0) | F.coalesce(i > holder, F.lit(False)))
        bare = lambda t: F.when(py_strip(t).startswith("-"), py_strip(F.substring(py_strip(t), F.lit(2), F.length(t)))).otherwise(py_strip(t))
        same = F.transform(acc["lines"], lambda t: (bare(t) == py_strip(p)) | (py_strip(t) == py_strip(p)))
        gone = F.array_position(same, F.lit(True))
        rows = F.filter(acc["lines"], lambda t, i: (i + 1 != gone) | (gone == 0))
        return F.struct(_without_first(acc["points"], p).alias("points"), some.alias("docs"), rows.alias("lines"))

    done = F.aggregate(hits, start, step)
    kept = F.when(F.size(hits) > 0, py_strip(F.array_join(done["lines"], "\n"))).otherwise(answer)
    return F.struct(done["points"].alias("points"), done["docs"].alias("docs"), kept.alias("answer"))


def cross_checks(groups: DataFrame, key: str = "ID") -> DataFrame:
    """key, j, k, point, question, prompt: each evidence point of a sibling against every other question of its group."""
    own = groups.select(key, "Questions", F.posexplode("Ans_Points").alias("j", "pts")).select(key, "Questions", "j", F.posexplode(R.without_conclusions(F.col("pts"))).alias("k", "point"))
    each = own.select(key, "j", "k", "point", F.posexplode("Questions").alias("q", "question")).where("q <> j").drop("q")
    return each.withColumn("prompt", prompt("cross_check", question=F.col("question"), point=F.col("point")))


def relevant(reply: Column) -> Column:
    """Whether a cross-check's reply says true after "Relevance:"; null without that marker."""
    return F.when(F.contains(reply, F.lit("Relevance:")), F.contains(F.lower(F.split_part(reply, F.lit("Relevance:"), F.lit(2))), F.lit("true")))


def cross_checked(groups: DataFrame, recorded: DataFrame, key: str = "ID") -> tuple[DataFrame, DataFrame]:
    """(groups, removed groups): points that are relevant to another question of the group go from points, documents and
    answer; siblings without evidence points or answer go; a group that loses all siblings is removed.

    groups: key, Questions, Answers, Documents_Info, Ans_Points, Doc_Ans_Points (documents as arrays), and any others."""
    checked = replay(cross_checks(groups, key), recorded)
    hit = checked.where(relevant(F.col("reply"))).select(key, "j", "k", "point").distinct()
    listed = hit.groupBy(key, "j").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "point"))), lambda x: x["point"]).alias("hits"))  # one answer's
    by_group = listed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("j", "hits"))).alias("_hits"))  # one group's siblings
    joined = groups.join(by_group, key, "left")
    none = F.array().cast("array<string>")
    hits = lambda i: F.coalesce(F.try_element_at("_hits", i), none)
    left = joined.withColumn("_s", F.transform("Questions", lambda q, i: F.struct(q.alias("q"), F.get("Documents_Info", i).alias("info"), without_hits(F.get("Ans_Points", i), F.get("Doc_Ans_Points", i), F.get("Answers", i), hits(i)).alias("x"))))
    lives = lambda s: (F.size(R.without_conclusions(s["x"]["points"])) > 0) & (py_strip(s["x"]["answer"]) != "")
    marked = left.withColumn("_k", F.filter("_s", lives))
    part = lambda f: F.transform("_k", f)
    rest = [c for c in groups.columns if c not in ("Questions", "Answers", "Documents_Info", "Ans_Points", "Doc_Ans_Points")]
    kept = marked.where(F.size("_k") > 0).select(
        *rest, part(lambda s: s["q"]).alias("Questions"), part(lambda s: s["x"]["answer"]).alias("Answers"), part(lambda s: R.documents_info(R.as_map(s["x"]["docs"]))).alias("Documents_Info"),
        part(lambda s: s["x"]["points"]).alias("Ans_Points"), part(lambda s: s["x"]["docs"]).alias("Doc_Ans_Points"),
    )
    return kept, marked.where(F.size("_k") == 0).select(*groups.columns).withColumn("Removed_Reason", F.lit("all_pairs_removed"))
