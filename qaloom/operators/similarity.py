"""Token-set similarity, exact joins on it, duplicates and order-dependent selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaloom.functions.text import py_tokens
from qaloom.operators.relations import first_of, positions
from qaloom.tables import written


def jaccard(a: Column, b: Column) -> Column:
    """Per cent of the tokens of either set that both have; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 100.0).otherwise(100.0 * F.size(F.array_intersect(a, b)) / union)


def token_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(py_tokens(text)))


def token_classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row a distinct token set (the empty one too): rep (its least key), tokens, members."""
    sets = rows.select(key, token_set(F.col(text)).alias("tokens"))
    return sets.groupBy("tokens").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("members"))


def meetings(sets: DataFrame, least: int, by: Sequence[str] = ()) -> DataFrame:
    """i < j: pairs of sets (rep, tokens) that could be `least` per cent alike.

    Two sets that are so alike share one of their first size - ceil(t size) + 1 tokens in any common order; tokens are
    ordered rarest first, so few sets meet at one.  A meeting doesn't count if what is left of either set from there on can't
    reach the threshold.  by: columns in which the pair must agree."""
    each = sets.select(*by, "rep", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
    freq = each.groupBy(*by, "t").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(freq, [*by, "t"]).groupBy(*by, "rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("o"))  # one text's tokens
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(least) / F.lit(100)) + 1
    first = ordered.select(*by, "rep", "n", F.posexplode(F.slice("o", F.lit(1), keep.cast("int"))).alias("p", "x")).select(*by, "rep", "n", "p", "x.t", "x.df").where("df > 1")
    a, b = (first.select(*by, "t", F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("p").alias(f"p{k}")) for k in "ij")
    fits = (F.col("ni") * 100 >= F.col("nj") * least) & (F.col("nj") * 100 >= F.col("ni") * least)
    needed = (F.col("ni") + F.col("nj")) * least  # (100 + least) * intersection >= least * (ni + nj)
    rest = F.least(F.col("ni") - F.col("pi"), F.col("nj") - F.col("pj"))
    reach = F.lit(100 + least) * rest >= needed  # what a pair can still share from here on; its first meeting has the most
    return a.join(b, [*by, "t"]).where((F.col("i") < F.col("j")) & fits & reach).select("i", "j").distinct()


def similar_pairs(rows: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """i < j (classes' representatives), members of both and their similarity >= `least` per cent.  Exact.

    Equal sets are one class: copies are counted, not paired.  The empty set is alike to itself alone.
    """
    classes = written(token_classes(rows, key, text), "classes")
    return pairs_of_classes(classes, least)


#: Rows of a block of classes at least, blocks at most, and bits of a class's digest a token at least.
BLOCK_ROWS, BLOCKS, TOKEN_BITS = 2_048, 32, 3


def digests(sets: DataFrame) -> DataFrame:
    """rep, n, bits of sets (rep, tokens): bit h mod width says whether an odd number of a set's tokens has the hash h.

    Each bit in which two digests differ stands for a token that one of the sets lacks, so they tell how much two sets differ at
    least.  A width is a power of two that grows with the set; the halves of a digest, one xor the other, are that of half the width."""
    hashed = sets.select("rep", F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("h"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, h = batch.column(1).to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy().view(np.uint64)
                width = 1 << np.clip(np.ceil(np.log2(n * TOKEN_BITS)).astype(np.int64), 7, 13)
                first = np.cumsum(width) - width
                bit = np.repeat(first, n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
                packed = np.packbits((np.bincount(bit, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
                bits = [packed[a // 8 : (a + w) // 8] for a, w in zip(first.tolist(), width.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["rep", "n", "bits"])

    return hashed.mapInArrow(run, f"rep {sets.schema['rep'].dataType.simpleString()}, n int, bits binary")


def close_digests(placed: DataFrame, spans: list[tuple[int, int, int]], least: int) -> DataFrame:
    """x, y: places of sets that by their digests could be `least` per cent alike.

    placed: block, pos, n, bits, in the order of n; spans: block, least and greatest n.  Blocks meet two by two where their sizes allow
    it, so what is held is two blocks' digests, and only pairs that pass are rows."""
    tasks = [(a, b) for a, lo, hi in spans for b, low, _ in spans if a <= b and low * least <= hi * 100]
    dealt = placed.sparkSession.createDataFrame([(t, k, s) for t, pair in enumerate(tasks) for s, k in enumerate(pair) if s == 0 or pair[0] != pair[1]], "task int, block long, side int")
    met = placed.join(F.broadcast(dealt), "block").select("task", "side", "pos", "n", "bits").repartition(len(tasks), "task")

    def run(table):
        import numpy as np
        import pyarrow as pa

        side, pos, n = (table.column(c).to_numpy() for c in ("side", "pos", "n"))
        order, raw = np.lexsort((pos, side)), table.column("bits").to_pylist()
        cut = int((side == 0).sum())
        mine, other = order[:cut], order[cut:]
        same = not len(other)
        other = mine if same else other
        ratio, wide = (100 - least) / (100 + least), np.array([len(x) // 8 for x in raw])
        nj, xs, ys = n[other].astype(np.int64), [], []
        most = (nj * ratio).astype(np.float32)
        for words in np.unique(wide[mine]).tolist():
            from_ = int(np.searchsorted(wide[other], words))  # sizes ascend, and so do widths

            def folded(k):
                x = np.frombuffer(raw[k], np.uint64)
                while len(x) > words:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                return x

            if from_ == len(other):
                continue
            matrix = np.ascontiguousarray(np.stack([folded(k) for k in other[from_:]]).T)
            for i in np.flatnonzero(wide[mine] == words).tolist():
                k = mine[i]
                lo = max(i + 1, from_) if same else from_
                hi = int(np.searchsorted(nj, n[k] * 100 // least, "right"))
                if lo >= hi:
                    continue
                digest, differ = folded(k), np.zeros(hi - lo, np.uint16)
                for w in range(words // 2):
                    differ += np.bitwise_count(matrix[w, lo - from_ : hi - from_] ^ digest[w])
                bound = np.float32(int(n[k]) * ratio + 0.01)
                near = np.flatnonzero(differ - most[lo:hi] <= bound)  # most pairs differ by too much in half of the bits
                if len(near):
                    differ = differ[near]
                    for w in range(words // 2, words):
                        differ += np.bitwise_count(matrix[w, lo - from_ + near] ^ digest[w])
                    near = near[differ - most[lo + near] <= bound]
                if len(near):
                    xs.append(np.full(len(near), pos[k]))
                    ys.append(pos[other[lo + near]])
        none = [np.zeros(0, np.int64)]
        return pa.table({"x": np.concatenate(xs or none), "y": np.concatenate(ys or none)})

    return met.groupBy("task").applyInArrow(run, "x long, y long")


def pairs_of_classes(classes: DataFrame, least: int) -> DataFrame:
    sets = classes.where(F.size("tokens") > 0).select("rep", "tokens", "members")
    placed = written(positions(written(digests(sets), "digests"), ["n", "rep"], "pos"), "placed")
    rows = max(BLOCK_ROWS, -(-placed.count() // BLOCKS))
    placed = placed.withColumn("block", F.floor(F.col("pos") / rows))
    spans = [tuple(r) for r in placed.groupBy("block").agg(F.min("n"), F.max("n")).collect()]  # BLOCKS at most
    if not spans:
        met = sets.select(F.col("rep").alias("i"), F.col("rep").alias("j")).limit(0)
    else:
        close = written(close_digests(placed, spans, least), "close")
        of = lambda p, r: placed.select(F.col("pos").alias(p), F.col("rep").alias(r))
        named = close.join(of("x", "a").hint("merge"), "x").join(of("y", "b").hint("merge"), "y")
        met = named.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))
    met = met.join(sets.toDF("i", "ti", "members_i").hint("merge"), "i").join(sets.toDF("j", "tj", "members_j").hint("merge"), "j")
    return met.withColumn("similarity", jaccard(F.col("ti"), F.col("tj"))).where(F.col("similarity") >= least).select("i", "j", "members_i", "members_j", "similarity")


def greedy_selection(edges: DataFrame) -> DataFrame:
    """edges i < j.  node, kept, blocker for every node: in order, a node is kept unless an earlier kept one is its
    neighbour; blocker is the least such.  Chains are resolved round by round: a node whose earlier neighbours are all
    dropped is kept, one with a kept earlier neighbour is dropped.  Each round's state is a table."""
    edges = written(edges.select("i", "j").distinct(), "edges")
    nodes = edges.select(F.col("i").alias("node")).union(edges.select(F.col("j").alias("node"))).distinct()
    state = written(nodes.withColumn("kept", F.lit(None).cast("boolean")), "state")
    while state.where("kept is null").take(1):
        earlier = edges.join(state.select(F.col("node").alias("i"), F.col("kept").alias("k")), "i")
        seen = earlier.groupBy(F.col("j").alias("node")).agg(F.max(F.coalesce("k", F.lit(False))).alias("hit"), F.min(F.when(F.col("k") == F.lit(False), 1).otherwise(0)).alias("free"))
        now = state.join(seen, "node", "left")
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit").isNull(), True).when(F.col("hit"), False).when(F.col("free") == 1, True)
        state = written(now.select("node", kept.alias("kept")), "state")
    by = edges.join(state.where("kept").select(F.col("node").alias("i")), "i").groupBy(F.col("j").alias("node")).agg(F.min("i").alias("blocker"))
    return state.join(by, "node", "left").withColumn("blocker", F.when(~F.col("kept"), F.col("blocker")))


def similarity_histogram(pairs: DataFrame, classes: DataFrame, bounds: list[int]) -> DataFrame:
    """bound, n: pairs of rows at least so alike, copies counted as the pairs that they make."""
    among = classes.agg(F.sum(F.col("members") * (F.col("members") - 1) / 2).cast("long").alias("copies"))
    across = pairs.agg(*(F.coalesce(F.sum(F.when(F.col("similarity") >= b, F.col("members_i") * F.col("members_j"))), F.lit(0)).alias(f"b{b}") for b in bounds))
    one = across.crossJoin(among)  # one row each
    return one.select(F.explode(F.array(*(F.struct(F.lit(b).alias("bound"), (F.col(f"b{b}") + F.coalesce("copies", F.lit(0))).alias("n")) for b in bounds))).alias("x")).select("x.*")


def scoped_histogram(rows: DataFrame, key: str, text: str, batch: str, kind: str, bounds: Sequence[int]) -> DataFrame:
    """bound, total, cross_batch, cross_type: pairs of rows at least so alike, all of them and those whose batches or types
    differ.  Pairs are products of the classes' sizes, never rows."""
    own = rows.select(F.col(key).alias("k"), token_set(F.col(text)).alias("tokens"), F.col(batch).alias("batch"), F.col(kind).alias("kind"))
    classes = written(own.groupBy("tokens").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    parts = written(own.join(classes.select("tokens", "rep"), "tokens").groupBy("rep", "batch", "kind").agg(F.count(F.lit(1)).alias("n")), "parts")
    across = pairs_of_classes(classes, min(bounds)).select("i", "j", F.floor("similarity").alias("s"), (F.col("members_i") * F.col("members_j")).cast("double").alias("total"))
    inside = classes.select(F.col("rep").alias("i"), F.col("rep").alias("j"), F.lit(100).cast("long").alias("s"), (F.col("members") * (F.col("members") - 1) / 2).cast("double").alias("total"))
    pairs = written(across.union(inside), "pairs")

    def alike(c: str) -> DataFrame:
        """Pairs of rows that agree in a column, by pair of classes."""
        n = parts.groupBy("rep", c).agg(F.sum("n").alias("n"))
        met = pairs.join(n.toDF("i", "c", "x"), "i").join(n.toDF("j", "d", "y"), "j").where(F.col("c").eqNullSafe(F.col("d")))
        each = F.when(F.col("i") == F.col("j"), F.col("x") * (F.col("x") - 1) / 2).otherwise(F.col("x") * F.col("y"))
        return met.groupBy("i", "j").agg(F.sum(each).alias(f"same_{c}"))

    every = pairs.join(alike("batch"), ["i", "j"], "left").join(alike("kind"), ["i", "j"], "left").fillna(0.0, ["same_batch", "same_kind"])
    at = lambda b, x: F.coalesce(F.sum(F.when(F.col("s") >= b, x)), F.lit(0.0)).cast("long")
    total, batches, kinds = F.col("total"), F.col("total") - F.col("same_batch"), F.col("total") - F.col("same_kind")
    row = every.agg(*(F.struct(F.lit(b).alias("bound"), at(b, total).alias("total"), at(b, batches).alias("cross_batch"), at(b, kinds).alias("cross_type")).alias(f"b{b}") for b in bounds))
    return row.select(F.explode(F.array(*(f"b{b}" for b in bounds))).alias("x")).select("x.*")


def exact_duplicates(rows: DataFrame, ident: str, key: str, batch: str) -> DataFrame:
    """`rows` with kept (the first of its identity by key), matched_batch (the first one's) and cross_batch of the others."""
    first = rows.groupBy(ident).agg(F.min(key).alias("_k"), F.min_by(batch, key).alias("_b"))
    dropped = F.col(key) != F.col("_k")
    out = rows.join(first, ident).withColumn("kept", ~dropped).withColumn("matched_batch", F.when(dropped, F.col("_b")))
    return out.withColumn("cross_batch", F.when(dropped, ~F.col("_b").eqNullSafe(F.col(batch)))).drop("_k", "_b")


def near_duplicates(rows: DataFrame, key: str, text: str, batch: str, kind: str, least: int, scope: str = "cross_batch", cross_type: bool = False) -> DataFrame:
    """key, kept, matched (the least kept key that blocks a row) and similarity, for every row.

    In the order of keys a row is dropped if an earlier kept one is `least` per cent alike, of the same type (or any:
    cross_type) and of another batch (scope "cross_batch"), or any ("all"); "none" drops nothing.  Rows of one token set,
    batch and type are blocked by the same rows, so their first stands for them: the selection runs over such groups, and
    copies are never paired."""
    slim = rows.select(F.col(key).alias("k"), token_set(F.col(text)).alias("tokens"), F.col(batch).alias("batch"), F.col(kind).alias("kind"))
    if scope == "none":
        return slim.select(F.col("k").alias(key), F.lit(True).alias("kept"), F.lit(None).cast(slim.schema["k"].dataType).alias("matched"), F.lit(None).cast("double").alias("similarity"))
    classes = written(slim.groupBy("tokens").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    own = written(slim.join(classes.select("tokens", "rep"), "tokens").select("k", "rep", "batch", "kind"), "members")
    groups = written(own.groupBy("rep", "batch", "kind").agg(F.min("k").alias("head")), "groups")
    pairs = pairs_of_classes(classes, least).select("i", "j", "similarity")
    alike = pairs.union(pairs.select("j", "i", "similarity")).union(classes.select("rep", "rep", F.lit(100.0)))
    a, b = (groups.select(F.col("rep").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("batch", "kind", "head"))) for k in "ij")
    allowed = F.lit(True) if scope == "all" else ~F.col("batch_i").eqNullSafe(F.col("batch_j"))
    allowed &= F.lit(True) if cross_type else F.col("kind_i").eqNullSafe(F.col("kind_j"))
    near = written(alike.join(a, "i").join(b, "j").where(allowed), "near")  # head_i may block the rows of group j
    chosen = greedy_selection(near.where("head_i < head_j").select(F.col("head_i").alias("i"), F.col("head_j").alias("j")))
    lost = chosen.where("not kept").select(F.col("node").alias("head_i"))
    blocks = near.join(lost, "head_i", "left_anti")
    met = own.join(blocks.select(F.col("j").alias("rep"), F.col("batch_j").alias("batch"), F.col("kind_j").alias("kind"), "head_i", "similarity"), ["rep", "batch", "kind"]).where("head_i < k")
    hit = met.groupBy("k").agg(F.min("head_i").alias("matched"), F.min_by("similarity", "head_i").alias("similarity"))
    return own.select("k").join(hit, "k", "left").select(F.col("k").alias(key), F.col("matched").isNull().alias("kept"), "matched", "similarity")


def admitted(candidates: DataFrame, key: str, text: str, group: Sequence[str], least: int = 60) -> DataFrame:
    """key, kept, blocker: in the order of keys a candidate is admitted to its group unless an admitted one is `least` per
    cent alike.  What is discarded later on still blocks, so discards aren't an input."""
    by = ["_g"]  # one text for all of a group's columns, so that null is a group too
    slim = candidates.select(F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("_g"), F.col(key).alias("k"), token_set(F.col(text)).alias("tokens"))
    classes = written(slim.groupBy(*by, "tokens").agg(F.min("k").alias("rep")), "classes")
    sets = classes.select("rep", "tokens")
    met = meetings(classes, least, by).join(sets.toDF("i", "ti"), "i").join(sets.toDF("j", "tj"), "j")
    edges = met.where(jaccard(F.col("ti"), F.col("tj")) >= least).select("i", "j")
    chosen = greedy_selection(edges)
    own = slim.join(classes, [*by, "tokens"]).select("k", "rep")
    # a copy is blocked by its first, if that is admitted, else by what blocks the first
    out = own.join(chosen.withColumnRenamed("node", "rep"), "rep", "left")
    blocker = F.when(F.coalesce("kept", F.lit(True)), F.when(F.col("k") != F.col("rep"), F.col("rep"))).otherwise(F.col("blocker"))
    return out.select(F.col("k").alias(key), blocker.alias("blocker")).withColumn("kept", F.col("blocker").isNull())


def scenario_similarity(p: Column, e: Column, q: Column, f: Column) -> Column:
    """Mean of the similarities of two scenarios' personas and environments, given as token sets."""
    return (jaccard(p, q) + jaccard(e, f)) / 2


def similar_scenarios(rows: DataFrame, key: str, persona: str, environment: str, least: int) -> DataFrame:
    """i < j, similarity: scenarios alike by `least` per cent on average of both parts.

    One of the parts is so alike then, so pairs meet through the distinct token sets of either part.  Scenarios of equal
    sets are one, under their least key."""
    sets = rows.select(F.col(key).alias("k"), token_set(F.col(persona)).alias("p"), token_set(F.col(environment)).alias("e"))
    one = written(sets.groupBy("p", "e").agg(F.min("k").alias("k")), "scenarios")

    def through(c: str) -> DataFrame:
        classes = written(one.groupBy(F.col(c).alias("tokens")).agg(F.min("k").alias("rep")), "parts")
        met = meetings(classes, least)
        both = met.union(met.select("j", "i")).union(classes.select("rep", "rep"))
        tagged = one.join(classes.withColumnRenamed("tokens", c), c).select("rep", "k")
        return both.join(tagged.toDF("i", "a"), "i").join(tagged.toDF("j", "b"), "j").where("a < b").select("a", "b")

    met = through("p").union(through("e")).distinct()
    a, b = one.select(F.col("k").alias("a"), F.col("p").alias("pa"), F.col("e").alias("ea")), one.select(F.col("k").alias("b"), F.col("p").alias("pb"), F.col("e").alias("eb"))
    scored = met.join(a, "a").join(b, "b").withColumn("similarity", scenario_similarity(F.col("pa"), F.col("ea"), F.col("pb"), F.col("eb")))
    return scored.where(F.col("similarity") >= least).select(F.col("a").alias("i"), F.col("b").alias("j"), "similarity")


def admitted_scenarios(candidates: DataFrame, key: str, persona: str, environment: str, valid: Column, prior: DataFrame | None = None, least: int = 60) -> DataFrame:
    """key, admitted, reason ("area", "alike" or null) and blocker of every candidate.

    In the order of keys a candidate is admitted if its area is valid and no admitted or prior scenario is `least` per
    cent alike; one with an invalid area is never admitted and blocks nothing.  Prior scenarios (same columns, keys
    of their own below all others) block but are not returned."""
    marked = written(candidates.select(F.col(key).alias("k"), F.col(persona).alias("p"), F.col(environment).alias("e"), F.coalesce(valid, F.lit(False)).alias("ok")), "candidates")
    pool = marked.where("ok").select("k", "p", "e", F.lit(False).alias("before"))
    if prior is not None:
        pool = pool.union(prior.select(F.col(key), F.col(persona), F.col(environment), F.lit(True)))
    pool = written(pool, "pool")
    sets = pool.select("k", "before", token_set(F.col("p")).alias("ps"), token_set(F.col("e")).alias("es"))
    classes = written(sets.groupBy("ps", "es").agg(F.min("k").alias("rep"), F.bool_or("before").alias("before")), "classes")
    edges = written(similar_scenarios(pool, "k", "p", "e", least), "alike")
    held = classes.where("before").select("rep")  # what is prior is kept, whatever it resembles
    free = edges.join(held.withColumnRenamed("rep", "j"), "j", "left_anti")
    chosen = greedy_selection(free)
    own = sets.where("not before").join(classes.select("ps", "es", "rep"), ["ps", "es"]).join(chosen.withColumnRenamed("node", "rep"), "rep", "left")
    blocker = F.when(F.coalesce("kept", F.lit(True)), F.when(F.col("k") != F.col("rep"), F.col("rep"))).otherwise(F.col("blocker"))
    judged = own.select("k", blocker.alias("blocker"))
    reason = F.when(~F.col("ok"), "area").when(F.col("blocker").isNotNull(), "alike")
    return marked.join(judged, "k", "left").select(F.col("k").alias(key), reason.isNull().alias("admitted"), reason.alias("reason"), "blocker")


def dissimilar_draws(rows: DataFrame, key: str, persona: str, environment: str, wanted: int, seed: int, below: int = 20, tries: int = 8) -> DataFrame:
    """key, other, nth: up to `wanted` other rows of each, drawn by hash, less than `below` per cent alike.

    tries * wanted places are drawn for a row, so the draw ends, even where nearly all rows are alike; repeats, the row
    itself and rows too much alike are passed over.  No pair but those drawn is looked at."""
    placed = written(positions(rows.select(F.col(key).alias("k"), F.col(persona).alias("p"), F.col(environment).alias("e")), ["k"], "pos"), "placed")
    n = placed.count()
    sets = placed.select("k", "pos", token_set(F.col("p")).alias("ps"), token_set(F.col("e")).alias("es"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("k").cast("string"), F.col("t").cast("string")))
    drawn = sets.select("k", "ps", "es", F.explode(F.sequence(F.lit(1), F.lit(tries * wanted))).alias("t"))
    drawn = drawn.withColumn("pos", F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(max(n, 1))))
    others = sets.select("pos", F.col("k").alias("other"), F.col("ps").alias("qs"), F.col("es").alias("fs"))
    met = drawn.join(others.hint("merge"), "pos").where("k <> other")  # stored, the rows are too small to tell what a broadcast would hold
    far = met.where(scenario_similarity(F.col("ps"), F.col("es"), F.col("qs"), F.col("fs")) < below).groupBy("k", "other").agg(F.min("t").alias("t"))
    listed = far.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("t", "other"))), 1, wanted).alias("own"))  # tries * wanted at most
    return listed.select("k", F.posexplode("own").alias("nth", "x")).select(F.col("k").alias(key), F.col("x.other").alias("other"), (F.col("nth") + 1).alias("nth"))


def first_by_text(rows: DataFrame, text: str, key: str) -> DataFrame:
    """The first row of each text, by key."""
    return first_of(rows, [text], [key])
