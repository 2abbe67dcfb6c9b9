"""Parsers over the driver's texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions import python_checks as C
from qaloom.functions import text as X
from qaloom.operators.responder import replay
from qaloom.plans.registry import query
from qaloom.tables import load

_SPLIT = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]+'), lambda x: x <> '')"


@query(f"SELECT conv_id, turn, len({_SPLIT.format('text')}) AS n_tokens, len(list_distinct({_SPLIT.format('text')})) AS n_distinct FROM conversations")
def tokens_py(spark, sf_dir):
    t = X.py_tokens(F.col("text"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


def _checklists(spark, sf_dir):
    """A checklist a conversation: its whole turns as numbered lines, line ends folded, some in bold, within a fence."""
    even = F.col("turn") % 2 == 0
    flat = X.py_strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    line = F.concat((F.col("turn") + 1).cast("string"), F.when(even, ". ").otherwise(") **"), flat, F.when(even, "").otherwise("**"))
    c = load(spark, sf_dir, "conversations")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda s: s["l"]), "\n")  # one conversation
    return c.groupBy("conv_id").agg(F.concat(F.lit("```\n"), rows, F.lit("\n```\nno line")).alias("checklist"))


@query("SELECT conv_id, md5(array_to_string(list(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') ORDER BY turn), '|')) AS digest, count(*) AS n FROM conversations WHERE coalesce(regexp_replace(text, '\\s+', '', 'g'), '') <> '' GROUP BY conv_id")
def numbered_lines(spark, sf_dir):
    body = X.numbered_lines(F.col("checklist"))
    return _checklists(spark, sf_dir).select("conv_id", F.md5(F.array_join(body, "|")).alias("digest"), F.size(body).cast("long").alias("n")).where("n > 0")


@query("""SELECT user_id, array_to_string(list(v ORDER BY i), ',') AS verdicts FROM (SELECT u.user_id, i, coalesce(any_value(CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN 'No' END) , 'Unsure') AS v
 FROM (SELECT DISTINCT user_id FROM events) u, range(1, 6) r(i) LEFT JOIN (SELECT user_id, CAST(event_id % 7 AS BIGINT) AS idx, event_type, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS k
 FROM events WHERE event_type IN ('click', 'view')) e ON e.user_id = u.user_id AND e.idx = i AND e.k = 1 GROUP BY u.user_id, i) GROUP BY user_id""")
def verdict_lines(spark, sf_dir):
    """Replies "i. yes" out of events: repeated, lacking and out-of-range indices."""
    e = load(spark, sf_dir, "events")
    said = F.when(F.col("event_type") == "click", "YES").when(F.col("event_type") == "view", "no").otherwise("hm")
    line = F.concat(F.lit(" "), (F.col("event_id") % 7).cast("string"), F.lit(") "), said)
    reply = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda s: s["l"]), "\n").alias("reply"))  # one user's few events
    return reply.select("user_id", F.array_join(X.verdict_lines(F.col("reply"), F.lit(5)), ",").alias("verdicts"))


_LINES = "string_split(coalesce(text, ''), chr(10))"
_PY = "regexp_replace(x, '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')"


@query(f"SELECT doc_id, len(list_filter({_LINES}, lambda x: {_PY} <> '')) AS n_points, md5(array_to_string(list_filter(list_transform({_LINES}, lambda x: {_PY}), lambda x: x <> ''), '|')) AS digest FROM documents")
def bullets(spark, sf_dir):
    p = X.bullet_points(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", F.size(p).alias("n_points"), F.md5(F.array_join(p, "|")).alias("digest"))


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS p FROM documents), f AS (SELECT doc_id, len(p) AS n, list_transform(p, lambda x: {_PY} <> '') AS k FROM l),
 m AS (SELECT doc_id, n, coalesce(len(k) - list_position(list_reverse(k), true) + 1, 0) AS last, len(list_filter(k, lambda x: x)) AS filled FROM f)
 SELECT doc_id, last - filled AS interior, n - last AS trailing, filled FROM m""")
def empty_bullets(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", X.empty_bullets(X.lines(F.col("text"))).alias("b")).select("doc_id", "b.*")


@query(f"""SELECT doc_id, md5(regexp_replace(array_to_string(list_filter({_LINES}, lambda x: NOT contains(lower(x), 'title')), chr(10)), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')) AS digest FROM documents""")
def strip_title(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(X.strip_titles(F.coalesce("text", F.lit("")))).alias("digest"))


@query("""SELECT item_id, regexp_replace('Title: ' || regexp_replace(split_part(text, ' the ', 1), '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g') AS kept FROM benchmark""")
def doc_cut(spark, sf_dir):
    """Documents wrapped as a model returns them: talk before the title, a conclusion after the text."""
    b = load(spark, sf_dir, "benchmark")
    raw = F.concat(F.lit("Sure.\nTitle: "), F.substring_index("text", " the ", 1), F.lit(" In summary, "), F.col("text"))
    return b.select("item_id", X.cut_document(raw).alias("kept"))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS number, (o_orderkey % 3 <> 0) AS matches FROM orders""")
def answer_number(spark, sf_dir):
    """Replies that give an order's price in a sentence; a third of the truths are off by one."""
    o = load(spark, sf_dir, "orders")
    price = F.format_number(F.round("o_totalprice", 2), 2)
    reply = F.concat(F.lit("So the total adds up. The answer is **$"), price, F.lit("**."))
    truth = F.concat(F.lit("work\n#### "), F.format_number(F.round("o_totalprice", 2) + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0), 2))
    return o.select("o_orderkey", X.answer_number(reply).alias("number"), X.number_matches(reply, truth).alias("matches"))


@query("""WITH k AS (SELECT event_id, json_keys(props) AS ks, props FROM events) SELECT event_id, len(ks) AS n_keys, array_to_string(list_sort(ks), ',') AS names FROM k""")
def json_decode(spark, sf_dir):
    """JSON text encoded twice over, decoded by levels."""
    e = load(spark, sf_dir, "events")
    keys = F.json_object_keys("props")
    twice = F.to_json(F.struct(F.to_json(keys).alias("x")))
    back = X.decoded_json_list(F.get_json_object(twice, "$.x"))
    return e.select("event_id", F.size(back).alias("n_keys"), F.array_join(F.array_sort(back), ",").alias("names"))


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) AS k, role FROM conversations WHERE role <> 'system'""")
def map_renumber(spark, sf_dir):
    """Maps from number text to a turn lose their system turns, go back in numeric order and are numbered anew."""
    entry = F.struct((F.col("turn") + 8).cast("string"), "role")  # 8, 9, 10, ...: in the order of texts 10 comes first
    m = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # one conversation
    left = F.map_filter("m", lambda k, v: v != "system")
    return m.select("conv_id", F.explode(X.renumbered_map(left)).alias("k", "role"))


@query("""SELECT a.conv_id, a.turn, count(b.turn) AS n_others, count(*) FILTER (b.role = a.role) AS n_like FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY a.conv_id, a.turn""")
def sibling_repair(spark, sf_dir):
    """Each turn with all other turns of its conversation, by place."""
    c = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))  # one conversation
    x = c.select("conv_id", F.explode(X.siblings(F.col("t"))).alias("x"))
    return x.select("conv_id", "x.own.turn", F.size("x.others").cast("long").alias("n_others"), F.size(F.filter("x.others", lambda o: o["role"] == F.col("x.own.role"))).cast("long").alias("n_like"))


@query("""WITH b AS (SELECT item_id, text, sha1(CAST(item_id // 4 AS VARCHAR) || '|' || CAST(item_id % 4 AS VARCHAR)) AS h FROM benchmark)
 SELECT item_id // 4 AS grp, array_to_string(list_transform(list(text ORDER BY h), lambda x, i: 'Document ' || CAST(i AS VARCHAR) || ':' || chr(10) || x), chr(10) || chr(10)) AS context FROM b GROUP BY item_id // 4""")
def doc_assembly(spark, sf_dir):
    """Two relevant and two other documents in an order drawn by hash."""
    g = load(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / 4).alias("grp")).agg(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda s: s["text"]).alias("d"))  # four items
    return g.select("grp", X.assembled_documents(F.slice("d", 1, 2), F.slice("d", 3, 2), F.col("grp").cast("string")).alias("context"))


BUCKETS = [("license", r"license|copyright"), ("markup", r"[#*$%&|<>]{2,}"), ("list", r"\n\s*[-•]"), ("short", r"^\S+(\s+\S+){0,30}\s*$")]


@query("""SELECT CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'license' WHEN regexp_matches(lower(text), '[#*$%&|<>]{2,}') THEN 'markup' WHEN regexp_matches(lower(text), '\\n\\s*[-•]') THEN 'list'
 WHEN regexp_matches(lower(text), '^\\S+(\\s+\\S+){0,30}\\s*$') THEN 'short' ELSE 'none' END AS bucket, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL""")
def first_bucket(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy(X.first_bucket(F.col("text"), BUCKETS, "none").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH t AS (SELECT doc_id, quality, unnest(CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN ['license'] ELSE [] END || CASE WHEN regexp_matches(lower(text), '[#*$%&|<>]{2,}') THEN ['markup'] ELSE [] END || ['all']) AS tag FROM documents JOIN labels USING (doc_id))
 SELECT tag, count(*) AS n, round(avg(quality), 6) AS rate FROM t GROUP BY tag""")
def tag_rates(spark, sf_dir):
    """Rates of overlapping tags beside that of all rows."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    tags = F.concat(X.all_buckets(F.col("text"), BUCKETS[:2]), F.array(F.lit("all")))
    return d.select("quality", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("rate"))


@query(f"""SELECT source, round(avg(len({_SPLIT.format('text')})), 6) AS mean_words, max(len({_SPLIT.format('text')})) AS max_words, round(avg(len({_LINES})), 6) AS mean_lines FROM documents GROUP BY source""")
def structural_means(spark, sf_dir):
    words = F.size(X.py_tokens(F.col("text")))
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.round(F.avg(words), 6).alias("mean_words"), F.max(words).alias("max_words"), F.round(F.avg(F.size(X.lines(F.col("text")))), 6).alias("mean_lines"))


@query("""SELECT stage, count(*) FILTER (contains(t, ' the ')) AS n_hits, count(*) AS n FROM (SELECT 'documents' AS stage, text AS t FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY stage""")
def stage_trace(spark, sf_dir):
    """In which stage's texts a phrase turns up."""
    each = [load(spark, sf_dir, t).select(F.lit(t).alias("stage"), F.col(c).alias("t")) for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"), ("benchmark", "text"))]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.groupBy("stage").agg(F.count_if(F.contains("t", F.lit(" the "))).alias("n_hits"), F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AND 1 > greatest(1e-6, (2 * o_orderkey + 3) * 1e-3) AS off FROM orders) SELECT k, reason IS NULL AS ok, reason FROM (SELECT k, CASE WHEN k % 13 = 0 THEN 'no calculation' WHEN k % 11 = 0 THEN 'too few steps' WHEN off THEN 'mismatch' WHEN k % 7 = 0 THEN 'unparsed step' WHEN k % 3 = 0 THEN 'independent steps' END AS reason FROM d)""")
def numeric_grounding(spark, sf_dir):
    """Calculations out of orders: whether each holds, and why not.  A wrong step, a step without a value, steps that don't build on
    each other, too few steps, none."""
    k = F.col("o_orderkey")
    bad = F.when(k % 5 == 0, 1).otherwise(0)
    first = F.when(k % 3 == 0, F.concat(F.lit("Step 1: base = 0.5 + 0.25 = 0.75"))).otherwise(F.concat(F.lit("Step 1: base = "), k.cast("string"), F.lit(" + 1 = "), (k + 1).cast("string")))
    second = F.concat(F.lit("\nStep 2: twice = "), (k + 1).cast("string"), F.lit(" * 2 = "), (2 * k + 2 + bad).cast("string"))
    third = F.when(k % 11 == 0, "").when(k % 7 == 0, "\nStep 3: half").otherwise(F.concat(F.lit("\nStep 3: half = "), (4 * k).cast("string"), F.lit(" / 4 = "), k.cast("string"), F.lit(".0")))
    text = F.concat(F.when(k % 13 == 0, "Sums:\n").otherwise("Calculation:\n"), first, second, third, F.lit("\nQuestion: ?\nStep 4: no"))
    return load(spark, sf_dir, "orders").select(k.alias("k"), C.numeric_grounding(text).alias("x")).select("k", "x.*")


@query("""WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x1c-\\x1f\\x{85}\\x{a0}]+'), lambda x: x <> '') AS ws FROM documents),
 g AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)),
 p AS (SELECT a.doc_id, a.i, b.i - a.i AS d FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.h = b.h AND a.i < b.i), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS run FROM p),
 l AS (SELECT doc_id, min(i) AS s, count(*) + 7 AS n FROM r GROUP BY doc_id, d, run), b AS (SELECT doc_id, arg_max((s, n), (n, -s)) AS x FROM l GROUP BY doc_id)
 SELECT w.doc_id, CASE WHEN x IS NULL THEN '' ELSE array_to_string(list_slice(ws, x[1], x[1] + x[2] - 1), ' ') END AS phrase FROM w LEFT JOIN b ON b.doc_id = w.doc_id""")
def repeated_phrase(spark, sf_dir):
    """The longest phrase of eight words or more that a text holds twice."""
    return load(spark, sf_dir, "documents").select("doc_id", C.repeated_phrase(F.col("text")).alias("phrase"))


@query("""WITH r AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), q AS (SELECT conv_id, turn + 1 AS turn, text AS question FROM conversations WHERE role <> 'assistant')
 SELECT conv_id, turn, length(question) AS question_chars, length(text) AS reply_chars, CASE WHEN text IS NULL THEN FALSE ELSE contains(lower(text), 'correct') END AS graded FROM q LEFT JOIN r USING (conv_id, turn)""")
def replay_solve_eval(spark, sf_dir):
    """Questions become prompts, recorded replies answer them, a grader's rule marks the replies."""
    c = load(spark, sf_dir, "conversations")
    asked = c.where("role <> 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    asked = asked.withColumn("prompt", X.prompt("Q {id}: {question}", {"id": F.concat_ws("/", "conv_id", "turn"), "question": F.col("question")}))
    recorded = c.where("role = 'assistant'").join(asked.select("conv_id", "turn", "prompt"), ["conv_id", "turn"]).select("prompt", F.col("text").alias("reply"))
    got = replay(asked, recorded)  # a question without a reply is wrong
    return got.select("conv_id", "turn", F.length("question").alias("question_chars"), F.length("reply").alias("reply_chars"), F.coalesce(X.graded_correct(F.col("reply")), F.lit(False)).alias("graded"))
