"""Operators of the core against hand-made cases, brute force and SQL."""

import hashlib
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodecast.functions import scoring
from lodecast.functions import text as T
from lodecast.operators import audit, budget, contamination, messages, metrics, pool, sampling, validation
from lodecast.plans import registry
from lodecast.sources import files

MSG = "array<struct<role:string,content:string>>"


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in cols.items()))
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_canonical_messages(spark):
    rows = [
        (1, [(" User ", "a\t b"), ("ASSISTANT", "c\x1fd")]), (2, None), (3, []), (4, [("user", "a")]), (5, [("user", "a"), ("assistant", "  ")]),
        (6, [("user", "a"), ("assistant", "b"), ("tool", "c")]), (7, [("user", None), ("assistant", "b")]),
    ]
    got = {r.i: r.m for r in spark.createDataFrame(rows, f"i int, m {MSG}").select("i", messages.canonical_messages(F.col("m")).alias("m")).collect()}
    assert [tuple(x) for x in got[1]] == [("user", "a b"), ("assistant", "c d")]
    assert all(got[k] is None for k in range(2, 8))


@pytest.mark.parametrize(("n", "label"), [(0, "0-255"), (255, "0-255"), (256, "256-511"), (1536, "1536-2048"), (2048, "1536-2048")])
def test_length_bin(spark, n, label):
    assert one(spark, T.length_bin, n=n) == label


def test_length_bin_fails_outside(spark):
    with pytest.raises(Exception, match="outside of all bins"):
        one(spark, T.length_bin, n=2049)


def test_runs_and_shingles(spark):
    assert one(spark, lambda c: T.has_run(c, 10), t="x" + "a" * 10) and not one(spark, lambda c: T.has_run(c, 10), t="a" * 9)
    assert one(spark, T.shingles, t="abcde") == ["abcde"] and one(spark, T.shingles, t="abcdef") == ["abcde", "bcdef"] and one(spark, T.shingles, t="") == [""]
    assert one(spark, lambda c: T.repetition_excess(T.ascii_words(c)), t="a a a a b b b c") == 3


def test_extraction(spark):
    assert [one(spark, scoring.extract_number, t=x) for x in ("#### 1,234 then 5", "it is -5.50", "none", "#### 1 #### 2")] == ["1234", "-5.50", None, "2"]
    option = lambda r, t: one(spark, scoring.extract_option, r=r, t=t)
    assert option("(A) or (B)", "(B)") == "(B)" and option("The answer is c", "(C)") == "(C)" and option("so TRUE", "True") == "True"
    assert option("It is a Red Fox.", "red fox") == "red fox" and option("x\nlast line. \n", "other") == "last line" and option("", "other") is None


def test_largest_remainder(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, t bigint")
    assert {r.k: r.quota for r in budget.largest_remainder(df, "k", "t", 10).collect()} == {"a": 4, "b": 3, "c": 3}
    assert budget.largest_remainder(df.where("t > 1"), "k", "t", 10).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(0, 120))
def test_subset_sum(tokens, target):
    items = [(t, f"r{k}") for k, t in enumerate(tokens)]
    got = budget.subset_sum(items, target)
    reachable = {0}
    for t in tokens:
        reachable |= {x + t for x in reachable}
    assert (got is not None) == (target in reachable)
    if got is not None:
        assert len(set(got)) == len(got) and sum(dict((i, t) for t, i in items)[i] for i in got) == target


def test_exact_fit_swaps():
    assert sorted(budget.fit_exactly([(5, "a"), (3, "b")], [(4, "c")], 9)) == ["a", "c"]
    assert budget.fit_exactly([(5, "a")], [(7, "c")], 9) == ["a"]


def test_greedy_take_skips(spark):
    rows = spark.createDataFrame([("g", 1, 6, 1), ("g", 2, 5, 2), ("g", 3, 3, 3), ("g", 4, 1, 4)], "g string, i bigint, t bigint, p int")
    quotas = spark.createDataFrame([("g", 10)], "g string, quota bigint")
    assert sorted(r.i for r in budget.greedy_take(rows, "g", "i", "t", "p", quotas).collect()) == [1, 3, 4]


@pytest.mark.parametrize("total", [0, 5, 9, 100])
def test_water_fill(spark, total):
    sizes = {"a": 1, "b": 7, "c": 3}
    got = {r.k: r.taken for r in sampling.water_fill(spark.createDataFrame(list(sizes.items()), "k string, n int"), "k", "n", total).collect()}
    want, left = dict.fromkeys(sizes, 0), total
    while left and any(want[k] < sizes[k] for k in sizes):
        for k in sorted(sizes):
            if left and want[k] < sizes[k]:
                want[k] += 1
                left -= 1
    assert got == want


def test_rank_buckets_differ_from_ntile(spark):
    got = sampling.rank_buckets(spark.range(1318).withColumn("g", F.lit(1)), "g", [F.col("id")], 4).groupBy("bucket").count().orderBy("bucket").collect()
    assert [r["count"] for r in got] == [330, 329, 330, 329]


def test_coverage(spark):
    rows = [(1, ["a"]), (2, ["a", "b"]), (3, ["c"]), (4, ["c"]), (5, [])]
    got = [r.i for r in sampling.coverage_greedy(spark.createDataFrame(rows, "i int, f array<string>"), "i", "f", 3, 1).collect()]
    assert len(got) == 3 and {x for i, f in rows if i in got for x in f} == {"a", "b", "c"}


def test_overlap(spark):
    train = contamination.prompts(spark.createDataFrame([(1, "The  Quick brown fox jumps"), (2, "the quick brown fox jumped"), (3, "else"), (4, None)], "i int, t string"), "i", "t", "train_id")
    ev = contamination.prompts(spark.createDataFrame([(7, "the quick brown fox jumps"), (8, "The quick brown fox jumps ")], "i int, t string"), "i", "t", "eval_id")
    assert [tuple(r) for r in contamination.exact_overlap(train, ev).collect()] == [(1, 8)]
    near = contamination.near_overlap(train, ev).collect()
    assert [(r.train_id, r.ratio) for r in near] == [(2, round(2 * 24 / 51, 6))]


def test_first_of_equal_and_capped(spark):
    df = spark.createDataFrame([("h", "b", 1), ("h", "a", 2), ("k", "a", 1)], "h string, s string, r int")
    assert sorted((r.h, r.s) for r in pool.first_of_equal(df, "h", ["s", "r"]).collect()) == [("h", "a"), ("k", "a")]
    assert pool.capped(spark.range(50).withColumn("g", F.lit("x")), "g", "id", 7).count() == 7


def test_seed_statistics(spark):
    seeds = spark.createDataFrame([("a1", "s", 1, "m", 0.5)], "adapter string, strategy string, seed int, metric string, value double")
    assert metrics.strategy_metrics(seeds).first().sd == 0.0


def test_spearman(spark):
    df = spark.createDataFrame([("d", 1, 2), ("d", 2, 2), ("d", 2, 5), ("c", 1, 1), ("c", 1, 2), ("e", 1, 1)], "g string, a int, b int")
    got = {r.g: r.rho for r in audit.spearman(df, "g", "a", "b").collect()}
    assert got["c"] is None and got["e"] is None and got["d"] == pytest.approx(0.5)


def test_empty_tables(spark, tiny):
    empty = spark.read.parquet(f"{tiny}/records.parquet").where("false").withColumn("stratum", F.lit(1)).withColumn("n", F.lit(2))
    assert messages.candidate_rows(empty).count() == 0 and messages.structural_flags(empty).count() == 0
    out = spark.read.parquet(f"{tiny}/eval_outputs.parquet").where("false")
    items = spark.read.parquet(f"{tiny}/eval_items.parquet")
    assert validation.completeness(out, items).count() == 0 and metrics.seed_metrics(out).count() == 0


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n[1]\n{bad\n{"a": 2}\n')
    lines = files.checked_lines(spark, str(p), "a int")
    assert [r.error for r in lines.orderBy("line_no").collect()] == [None, "blank", "not an object", "bad json", None]
    assert [r.a for r in files.valid_prefix(lines).collect()] == [1] and sorted(r.a for r in files.valid_rows(lines).collect()) == [1, 2]
    with pytest.raises(Exception, match="line"):
        files.strict_rows(lines).collect()
    got = files.file_index(spark, str(tmp_path), "*.jsonl").collect()
    assert got[0].path == "x.jsonl" and got[0].bytes == p.stat().st_size


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "records", "eval_items", "eval_outputs", "judge_results", "embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    df = registry.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(round(v, 8) if isinstance(v, float) else v for v in (r[c] for c in cols))) for r in df.collect())
    q = con.execute(registry.ORACLES[name])
    at = [[d[0] for d in q.description].index(c) for c in cols]
    theirs = sorted(repr(tuple(round(v, 8) if isinstance(v, float) else v for v in (r[i] for i in at))) for r in q.fetchall())
    assert mine == theirs


def test_permutation_changes_nothing(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source").collect()
    a = {tuple(r) for r in pool.capped(spark.createDataFrame(rows), "source", "doc_id", 2).collect()}
    random.Random(1).shuffle(rows)
    assert a == {tuple(r) for r in pool.capped(spark.createDataFrame(rows), "source", "doc_id", 2).collect()}


def test_metrics_take_every_attempt(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/eval_outputs.parquet").schema
    score = lambda x: None if x is None else (None, None, None, None, None, x)
    made = [(1, 1, "i1", None), (2, 2, "i1", True), (3, 3, "i1", False), (3, 3, "i1", False), (4, 1, "i2", True), (5, 2, "i2", True), (6, 1, None, False)]
    rows = [(i, "a-1", "random", 1, a, "bbh", "t", x, "(A)", "r", score(v), None) for i, a, x, v in made]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/eval_outputs.parquet")
    got = {n: registry.QUERIES[n](spark, str(tmp_path)).collect() for n in ("score_unpivot", "metrics_seed", "metrics_strategy", "group_macro_worst")}
    assert sorted((r.example_id, r.value) for r in got["score_unpivot"]) == [("i1", 0.0), ("i1", 1.0), ("i2", 1.0), ("i2", 1.0)]
    assert [r.value for r in got["metrics_seed"]] == [0.75] and [r["mean"] for r in got["metrics_strategy"]] == [0.75] and [r.macro for r in got["group_macro_worst"]] == [0.75]


def test_top_up_over_all_strata(spark):
    rows = spark.createDataFrame([("b", 1, 3, 1), ("a", 2, 4, 2), ("a", 3, 2, 1), ("a", 4, 5, 3), ("b", 5, 1, 2), ("b", 6, 2, 3)], "g string, i bigint, t bigint, p int")
    top = lambda chosen, target: sorted(r.i for r in budget.top_up(rows, rows.where(F.col("i").isin(chosen)).select("g", "i"), "g", "i", "t", "p", target).collect())
    # 6 are missing: of a's leftovers 2 (4 tokens) fits and 4 (5) no more; of b's, 5 (1) fits and 6 (2) no more; nothing else fits.
    assert top([1, 3], 11) == [1, 2, 3, 5]
    assert top([1, 3], 5) == [1, 3] and top([1, 3], 4) == [1, 3] and top([], 6) == [2, 3]


def test_exact_fit_is_topped_up(spark):
    # All documents of sf0.001 fit the target; those of sf0.01 do not.
    folder = "/root/testdata/sf0.01"
    rows = pool.numbered(registry._capped(spark, folder).select("source", "doc_id", "token_count"), "source", pool.random_order(13, "doc_id")).collect()
    order, tokens = {r.doc_id: (r.source, r.position) for r in rows}, {r.doc_id: r.token_count for r in rows}
    mine = {r.doc_id for r in registry._taken(spark, folder).collect()}
    total = sum(tokens[i] for i in mine)
    for i in sorted(order.keys() - mine, key=order.get):
        if total + tokens[i] <= registry.TARGET:
            total += tokens[i]
            mine.add(i)
    want = budget.fit_exactly([(tokens[i], i) for i in sorted(mine)], [(tokens[i], i) for i in tokens.keys() - mine], registry.TARGET)
    assert sorted(r.doc_id for r in registry.QUERIES["exact_fit"](spark, folder).collect()) == sorted(want)


def test_documents_without_source(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("text IS NOT NULL")
    assert docs.where("source IS NULL").count() > 0
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    every = registry.QUERIES["doc_quality_all"](spark, tiny)
    assert ids(every) == ids(docs)
    # Documents with a source have the score that the SQL checks.
    assert every.join(docs.where("source IS NOT NULL").select("doc_id"), "doc_id").exceptAll(registry.QUERIES["doc_quality"](spark, tiny)).count() == 0
    assert sum(r.n for r in registry.QUERIES["script_guess"](spark, tiny).collect()) == docs.count()


def test_votes_of_training_prompts(spark, tiny, tmp_path):
    asked = ["The quick  brown fox jumps", "the quick brown fox jumped over", "entirely other words here", "The quick brown fox jumps", "abc"]
    items = [("bbh", "1", "the quick brown fox jumps"), ("bbh", "2", "Entirely other words there"), ("gsm8k", "1", "abc"), ("gsm8k", "2", "the quick brown fox jumps over the lazy dog")]
    kinds = {t: spark.read.parquet(f"{tiny}/{t}.parquet").schema for t in ("records", "eval_items")}
    make = lambda name, rows: spark.createDataFrame([tuple(r.get(f.name) for f in kinds[name]) for r in rows], kinds[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    make("records", [{"example_id": f"r{k}", "messages": [(" User", q), ("assistant", "x")]} for k, q in enumerate(asked)])
    make("eval_items", [{"benchmark": b, "example_id": i, "prompt": p} for b, i, p in items])
    norm = lambda t: " ".join(t.lower().split())
    runs = lambda t: {t[k : k + 5] for k in range(max(1, len(t) - 4))}
    want = set()
    for k, q in enumerate(map(norm, asked)):
        for b, i, p in ((b, i, norm(p)) for b, i, p in items):
            both = len(runs(q) & runs(p))
            jaccard = both / len(runs(q) | runs(p))
            if both and jaccard >= 0.35 and max(len(q), len(p)) <= 1.5 * min(len(q), len(p)):
                want.add((f"r{k}", f"{b}/{i}", both, round(jaccard, 9)))
    assert len(want) > 4
    assert {(r.train_id, r.eval_id, r.votes, r.jaccard) for r in registry.QUERIES["candidate_votes_train"](spark, str(tmp_path)).collect()} == want


def test_contrasts_of_all_treatments(spark, tiny, tmp_path):
    schema = spark.read.parquet(f"{tiny}/eval_outputs.parquet").schema
    values = {"random": [0, 0, 1, 0], "quality": [1, 0, 1, 0], "diversity": [1, 1, 1, 0]}
    rows = [(10 * a + i, k, k, 1, 1, "bbh", "t", f"i{i}", "(A)", "r", (None, None, None, None, None, bool(v)), None) for a, (k, vs) in enumerate(values.items()) for i, v in enumerate(vs)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/eval_outputs.parquet")
    got = {r.treatment: r for r in registry.QUERIES["bootstrap_contrasts"](spark, str(tmp_path)).collect()}
    assert registry.ALL_REPLICATES == 10_000 and {k: (r.n, r["mean"]) for k, r in got.items()} == {"quality": (4, 0.25), "diversity": (4, 0.5)}
    for k, r in got.items():
        diff = [t - b for b, t in zip(values["random"], values[k], strict=True)]
        draws = [[int(hashlib.md5(f"{rep}:{j}".encode()).hexdigest()[:8], 16) % 4 for j in range(4)] for rep in range(10_000)]
        means = sorted(sum(diff[i] for i in x) / 4 for x in draws)
        assert (r.low, r.high) == (means[249], means[9749])
