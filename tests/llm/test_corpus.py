import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from qaloom.llm import ann, ngram_join, passage_dedup, preference, quality, queries, sharding
from qaloom.llm.components import components as cluster
from tests.llm.helpers import SCHEMA, components, hard, hard_rows, measures, prose, shingles


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.label for r in cluster(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def near_copies(n=160):
    rng = random.Random(9)
    texts = []
    seeds = [prose(rng, rng.choice([40, 80, 200])).split() for _ in range(8)]
    for i in range(n):
        w = list(seeds[i % 8])
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    return texts


def check_components(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {i: (len(shingles(t)), c) for i, (t, c) in enumerate(zip(texts, components(texts), strict=True))}


def test_ngram_join_equals_all_pairs(spark):
    check_components(spark, near_copies())


def test_ngram_join_with_large_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 4)
    check_components(spark, near_copies(90))


def test_ngram_join_on_hard_rows(spark):
    rows = hard_rows()[:18]
    texts = [r[1] for r in rows]
    want = components(texts)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_components(hard(spark, rows)).collect()}
    for i, r in enumerate(rows):
        assert got[r[0], len(shingles(r[1]))] == rows[want[i]][0]
    assert ngram_join.ngram_components(hard(spark, [])).count() == 0


def test_passages(spark):
    rng = random.Random(4)
    passage = prose(rng, 60)
    edited = passage.split()
    edited[10] = "other"
    clean = [(i, prose(rng, 100) + "\n" + prose(rng, 50)) for i in range(20)]
    planted = [(100, prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30)), (101, prose(rng, 25) + " " + passage + " " + prose(rng, 33)), (102, " ".join(edited)), (103, passage.upper()), (104, None), (105, "")]
    docs = spark.createDataFrame([*clean, *planted], "doc_id long, text string").repartition(3)
    got = passage_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {100, 101, 102, 103}
    assert {r.doc_id for r in got if r.removed_words == 0} == {100}
    for r in got:
        text = dict(planted)[r.doc_id].encode()
        inside = set(text[r.start : r.end].decode().lower().split())
        assert len(inside - set(passage.lower().split()) - {"other"}) <= 2
    kept = {r.doc_id: r.text for r in passage_dedup.without_repeats(docs.withColumn("uid", F.lit(1))).collect()}
    assert {i: kept[i] for i, _ in clean} == dict(clean) and kept[100] == dict(planted)[100] and kept[104] is None and kept[105] == ""
    assert len(kept[101].split()) < 95 and len(kept[103].split()) < 25
    assert passage_dedup.without_repeats(hard(spark)).count() == len(hard_rows())
    assert passage_dedup.repeated_passages(hard(spark, [])).count() == 0


def test_bands_reach_the_promised_recall():
    rng = random.Random(8)
    import pyarrow as pa

    a, b = [], []
    for _ in range(300):  # 100 words with edits that leave a similarity of about 0.75 or more
        w = prose(rng, 100).split()
        v = list(w)
        for _ in range(2):
            v[rng.randrange(100)] = "zz"
        a.append(" ".join(w))
        b.append(" ".join(v))
    x, y = (passage_dedup.Units(pa.array(t)).bands()[1] for t in (a, b))
    assert (x == y).any(axis=1).mean() >= 0.99


def test_measures_and_verdicts(spark):
    docs = hard(spark)
    got = quality.quality_verdicts(docs).collect()
    want = sorted((r.doc_id or -1, *measures(r.text)) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality_verdicts(hard(spark, [])).count() == 0


def test_thresholds_adapt_and_merge(spark):
    rng = random.Random(6)
    plain = [(i, prose(rng, 50), "en", "big") for i in range(300)]
    symbols = [(1000 + i, " ".join(w + "||" for w in prose(rng, 50).split()), "xx", "code") for i in range(300)]
    junk = [(2000 + i, " ".join(w + "***" for w in prose(rng, 50).split()), "en", ["big", "tiny"][i % 2]) for i in range(10)]
    docs = spark.createDataFrame([*plain, *symbols, *junk], "doc_id long, text string, lang string, source string").repartition(4)
    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert kept == {r[0] for r in plain + symbols}  # a source whose texts all have symbols keeps them


def test_sketch_quantiles_are_close(spark):
    values = np.sort(np.random.default_rng(1).lognormal(1, 1, 4000))
    rows = spark.createDataFrame([("g", "m", float(v)) for v in values], "g string, measure string, x double").repartition(7)
    sketch = rows.withColumn("bucket", quality.bucket(F.col("x"))).groupBy("g", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))
    got = quality.quantiles(sketch, ["g"], {"a": 0.25, "b": 0.9}).first()
    assert abs(got.a / values[999] - 1) < 0.07 and abs(got.b / values[3599] - 1) < 0.07


def test_shards(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([1, 5, 60]))) for i in range(3000)] + [(10_000 + i, "copy " * 30) for i in range(1500)] + [(None, None), (5, "x " * 500), (5, "x " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard_by_bytes(docs, 24).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and set(size.index) == set(range(24)) and size.max() - size.min() < 0.1 * size.mean() + 1100
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(got["size"], got["text_crc32"], strict=True)) == want
    assert sharding.shard_by_bytes(hard(spark, [])).count() == 0 and sharding.shard_by_bytes(hard(spark)).count() == len(hard_rows())


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 32)).astype("float32")
    x[7] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 32), (3002, [float("nan")] * 32), (3003, [1.0, None] * 16), (3004, [1.0] * 5), (None, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.nearest(table, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(1500), d))[:10]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id], rtol=1e-14)
        hits += len(set(true) & set(own.vec_id))
    assert len(got) == 150 and hits / 150 >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, round(r.score, 6)) for r in ann.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 0.0), (1, 1.414214)]
    assert ann.nearest(table.where("false"), F.col("vec_id") == 0).count() == 0


def test_preference(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "assistant", "Hello there"), (1, 2, "user", "bye"), (2, 0, "assistant", ""), (3, 0, "user", "alone"), (None, 0, "user", "x"), (4, 0, None, None), (4, 0, "user", "b"), (4, 0, "user", "b"), (4, 3, "assistant", "é" * 9)]
    rows += [(9, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(2500)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = preference.preference_query(conv.withColumn("pair_id", F.lit(1)).withColumn("nth", F.lit(1))).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"}))
    want = con.execute(preference.PREFERENCE_SQL).fetchdf()
    key = ["pair_id", "part", "turn", "nth"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want[got.columns].sort_values(key).reset_index(drop=True), check_dtype=False)
    for (_, part), g in got.groupby(["pair_id", "part"]):
        text = "".join(g.sort_values("start").rendered)
        for r in g.itertuples():
            assert text[r.start :].startswith(r.rendered) and (part != "prompt" or r.loss_start == r.loss_end)
    assert preference.preference_query(conv.where("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.createDataFrame(hard_rows(), SCHEMA).coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        seen.append((name, sorted((r.doc_id, len(r.text)) for r in now.collect())))
    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert {i for i, _ in seen[0][1]} == kept
    ids = [i for i, _ in seen[0][1]]
    texts = {r[0]: r[1] for r in hard_rows()}
    group = components([texts[i] for i in ids])
    assert [i for i, _ in seen[1][1]] == sorted({ids[g] for g in group})
    assert [i for i, _ in seen[2][1]] == [i for i, _ in seen[1][1]]
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count_distinct("doc_id")).first()[0] == len(seen[2][1])


def test_pieces_of_a_line_do_not_depend_on_what_follows():
    line = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    texts = [line, f"{line}\nnext", f"{line}\nother words", line]
    units = passage_dedup.Units(pa.array(texts, pa.string()))
    found = [set(units.digest[(units.text == t) & (units.level == passage_dedup.PIECE)].tolist()) for t in range(len(texts))]
    assert found[0] and all(f == found[0] for f in found)
    for word in range(60):  # the last word is the one that could see its neighbour
        a, b = (passage_dedup.Units(pa.array([f"{line} v{word}", after], pa.string())) for after in ("x", "y z"))
        assert (a.digest[a.text == 0] == b.digest[b.text == 0]).all()


def lines_of(words: str, size: int) -> str:
    w = words.split()
    return "\n".join(" ".join(w[i : i + size]) for i in range(0, len(w), size))


def test_passages_of_short_lines(spark):
    rng = random.Random(12)
    verse = {n: lines_of(prose(rng, n), 3) for n in (51, 500)}
    rows = [(i, lines_of(prose(rng, 200), 1 + i % 4)) for i in range(8)]
    for n, v in verse.items():
        rows += [(10 * n, v), (10 * n + 1, v), (10 * n + 2, lines_of(prose(rng, 90), 4) + "\n" + v + "\n" + lines_of(prose(rng, 90), 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = passage_dedup.repeated_passages(docs).toPandas()
    assert set(got.doc_id) == {i for i, _ in rows[8:]}
    for n in verse:
        assert (got[got.doc_id.isin([10 * n, 10 * n + 1, 10 * n + 2])].groupby("doc_id").n_words.sum() == n).all()
    kept = {r.doc_id: r.text or "" for r in passage_dedup.without_repeats(docs).collect()}
    assert all(kept[i] == t for i, t in rows[:8])
    for n, v in verse.items():
        assert kept[10 * n] == v and kept[10 * n + 1].strip() == "" and len(kept[10 * n + 2].split()) == 180
    units = passage_dedup.Units(pa.array([verse[500]]))
    assert units.words[units.level == passage_dedup.PIECE].sum() > 490


def test_every_passage_of_51_words(spark):
    rng = random.Random(13)
    rows, planted = [], {}
    for i in range(150):  # in longer lines, 80 other words on both sides; of every third, 50 words only
        passage = prose(rng, 50 if i % 3 == 0 else 51)
        for k in range(2):
            rows.append((1000 * k + i, f"{prose(rng, 80)} {passage} {prose(rng, 80)}"))
            planted[1000 * k + i] = passage
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in passage_dedup.repeated_passages(docs).collect()}
    assert set(got) == {i for i in planted if i % 1000 % 3}
    for i, r in got.items():
        assert dict(rows)[i].encode()[r.start : r.end].decode() == planted[i] and (r.n_words, r.removed_words) == (51, 51 * (i >= 1000))
    kept = {r.doc_id: r.text for r in passage_dedup.without_repeats(docs).collect()}
    for i, t in rows:
        assert kept[i] == (t.replace(planted[i], "") if i >= 1000 and i in got else t)


def test_windows_equal_all_pairs(spark):
    rng = random.Random(14)
    base = [prose(rng, 70).split() for _ in range(6)] + [["the"] * 200, ["a", "b", "c"] * 40]
    texts = []
    for _ in range(40):
        w = []
        for _ in range(4):
            part = rng.choice(base)
            a = rng.randrange(len(part) // 2)
            w += part[a : a + rng.randrange(40, 90)] + prose(rng, rng.randrange(3)).split()
        texts.append(lines_of(" ".join(w), rng.choice([2, 9, 60])))
    size, holders = passage_dedup.PASSAGE_WORDS, {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - size + 1):
            holders.setdefault(tuple(w[j : j + size]), set()).add(i)
    covered = lambda keep: {(i, j + d) for i, t in enumerate(texts) for w in [t.split()] for j in range(len(w) - size + 1) if keep(i, holders[tuple(w[j : j + size])]) for d in range(size)}
    numbered = spark.createDataFrame([(i, -i, t) for i, t in enumerate(texts)], "uid long, k long, t string")  # the last is the first by key
    corpus = passage_dedup.Corpus(passage_dedup.common.bucketed(numbered, "uid"))
    rows = passage_dedup.common.written(passage_dedup._read(corpus.texts()), "rows")
    got = passage_dedup.exact_spans(corpus, rows).join(corpus.rank, "pos").collect()
    assert {(r.uid, r.word + d) for r in got for d in range(r.words)} == covered(lambda i, who: len(who) > 1)
    assert {(r.uid, r.word + d) for r in got if r.elsewhere for d in range(r.words)} == covered(lambda i, who: max(who) > i)


def test_scan_keeps_exact_copies():
    rng, dim = np.random.default_rng(4), 64
    turn, lost = ann.rotation(dim), 0
    for x in rng.normal(size=(300, dim)) * 3:
        copies = np.repeat(x[None], 30, 0)
        rotated = copies @ turn
        blocks = [np.ascontiguousarray(rotated[:, a : a + ann.COLUMNS]) for a in range(0, dim, ann.COLUMNS)]
        q, _, d = ann.scan(x[None], x[None] @ turn, np.zeros(1), blocks, copies, dim)
        lost += len(q) < 30 or d.max() > 0
    assert lost == 0


def test_neighbours_that_the_tests_abandon(spark):
    rng, dim = np.random.default_rng(5), 64
    x = rng.normal(size=(1500, ann.COLUMNS)) @ ann.rotation(dim)[:, : ann.COLUMNS].T  # all distance is in the first block
    x[1000:] = x[1000]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ann.nearest(table, F.col("vec_id") % 100 == 0).toPandas()
    assert (got.groupby("query_id").size() == 10).all() and got.query_id.nunique() == 15
    assert (got[got.query_id >= 1000].score == 0).all()


def test_row_numbers_outlast_other_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(15)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 30 + i % 7) + (f" {passage}" if i % 20 == 7 else "")) for i in range(120)]
    rows += [(1000 + i, rows[i][1]) for i in range(0, 120, 6)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(path)
    real, conf, count = passage_dedup.common.written, "spark.sql.files.maxPartitionBytes", [0]
    old = spark.conf.get(conf)

    def turn():
        count[0] += 1
        spark.conf.set(conf, old if count[0] % 2 else "2000")

    def written(*a, **k):
        turn()
        return real(*a, **k)

    try:
        monkeypatch.setattr(passage_dedup.common, "written", written)
        got = queries.op3_passage_dedup(spark, str(tmp_path)).collect()
        assert {r.doc_id for r in got if r.doc_id < 1000} >= {i for i, _ in rows if i % 20 == 7}
        texts = dict(rows)
        for r in got:
            if r.doc_id % 20 == 7:
                assert passage in texts[r.doc_id].encode()[r.start : r.end].decode()
        monkeypatch.setattr(passage_dedup.common, "written", real)
        spark.conf.set(conf, old)
        kept = corpus_pipeline.one_of_near_copies(spark, spark.read.parquet(path), str(tmp_path))
        spark.conf.set(conf, "2000")
        want = components([t for _, t in rows])
        assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[c][0] for c in want})
    finally:
        spark.conf.set(conf, old)


def test_neighbours_of_copies_in_an_ordered_table(spark):
    rng, dim = np.random.default_rng(6), 64
    distinct = rng.normal(size=(101, dim)) * 3
    x = np.repeat(distinct, 40, axis=0)  # ordered by cluster
    rows = [(i, v.tolist(), 1, "v", 2, 3.0) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, uid int, v string, list int, bound double").repartitionByRange(6, "vec_id")
    got = ann.nearest(table, F.col("vec_id") % 100 == 0).toPandas()
    assert got.query_id.nunique() == 41 and (got.score == 0).all()
    for q, own in got.groupby("query_id"):  # ties go to the smaller ids
        copies = [i for i in range(q // 40 * 40, q // 40 * 40 + 40) if i != q]
        assert list(own.sort_values("rank").vec_id) == copies[:10]


def test_recall_at_64_dimensions_in_order_of_topics(spark):
    rng, dim = np.random.default_rng(7), 64
    topics = rng.normal(size=(30, dim)) * 2
    x = np.concatenate([t + rng.normal(size=(150, dim)) for t in topics])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartitionByRange(6, "vec_id")
    got = ann.nearest(table, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(own.vec_id))
    assert len(got) == 450 and hits / 450 >= 0.9


def test_scratch_tables_go(spark, tmp_path):
    from pathlib import Path

    from qaloom.llm import common

    folder = Path(common.shared_folder(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(near_copies(40))], "doc_id long, text string")
    assert ngram_join.ngram_components(docs).count() == 40 and passage_dedup.repeated_passages(docs).count() > 0
    left = {p.name.split("-")[0] for p in folder.iterdir()} - {n.split("-")[0] for n in before}
    assert left <= {"components", "passages"}
    assert spark.catalog.listTables() == [] or all(not t.name.startswith("qaloom_") for t in spark.catalog.listTables())


def test_one_text_of_megabytes(spark):
    rng = random.Random(16)
    passage = prose(rng, 70)
    long = prose(rng, 250_000) + " " + passage
    docs = spark.createDataFrame([(1, long), (2, "a " * 60 + passage), (3, prose(rng, 90))], "doc_id long, text string")
    got = {r.doc_id: r for r in passage_dedup.repeated_passages(docs).collect()}
    assert set(got) == {1, 2} and long.encode()[got[1].start : got[1].end].decode() == passage
    assert {r.doc_id: r.n_shingles for r in ngram_join.ngram_components(docs).collect()} == {i: len(shingles(t)) for i, t in ((1, long), (2, "a " * 60 + passage), (3, docs.where("doc_id = 3").first().text))}


def test_twins_of_the_queries(spark):
    """DuckDB's answers on the driver's small table, where it is."""
    import os

    from qaloom.llm import queries as q

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    for name in ("op2_ngram_jaccard_join", "op5_quality_rules"):
        got, want = q.queries()[name](spark, sf).toPandas(), con.execute(q.oracle_sql()[name]).fetchdf()
        pd.testing.assert_frame_equal(got.sort_values("doc_id").reset_index(drop=True), want[got.columns].sort_values("doc_id").reset_index(drop=True), check_dtype=False)


def test_verdicts_on_hard_rows_equal_sql(spark):
    rows = hard_rows()[:18]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]  # SQL joins by doc_id
    got = quality.quality_verdicts(hard(spark, rows)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r[0], r[1], r[2], r[3]) for r in rows], columns=["doc_id", "text", "lang", "source"]))
    want = con.execute(queries.oracle_sql()["op5_quality_rules"]).fetchdf()
    pd.testing.assert_frame_equal(got.sort_values("doc_id").reset_index(drop=True), want[got.columns].sort_values("doc_id").reset_index(drop=True), check_dtype=False)


def test_passages_met_in_rounds_are_the_same_and_leave_no_unit_rows(spark, monkeypatch):
    rng = random.Random(17)
    passage = [" ".join(rng.choices("abcdefghijkl", k=60)) for _ in range(6)]
    texts = [" ".join(rng.choices("mnopqrstuvw", k=30)) + "\n" + passage[i % 6] + "\n" + " ".join(rng.choices("mnopqrstuvw", k=30)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.start, r.end, r.n_words, r.removed_words) for r in passage_dedup.repeated_passages(docs).collect())
    plain = found()
    assert len({k for k, *_ in plain}) == 40
    monkeypatch.setattr(passage_dedup, "ROUND_BYTES", 1)
    assert found() == plain
    common = passage_dedup.common
    common.ready(spark)
    with common.scratch():
        corpus = passage_dedup.Corpus(common.bucketed(docs.select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("k"), F.col("text").alias("t")), "uid"))
        rows = common.written(passage_dedup._read(corpus.texts()), "rows", by="level")
        spans = common.written(passage_dedup.exact_spans(corpus, rows), "spans")
        folder = spark._jvm.org.apache.hadoop.fs.Path(common._open[-1][id(rows)][1])
        left = {f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder) if f.isDirectory()}
        assert spans.count() and f"level={passage_dedup.LINE}" in left and f"level={passage_dedup.UNIT}" not in left
