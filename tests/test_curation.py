"""Selection, ranks, dealing, judge stage, audits, sources and gates against hand-made cases and brute force."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodecast.functions import language, plugins, scoring
from lodecast.functions import text as T
from lodecast.operators import audit, budget, contamination, judge, messages, metrics, pool, ranks, sampling, selection, validation
from lodecast.plans import registry
from lodecast.runtime import table
from lodecast.sources import files
from lodecast.streaming import streams

MSG = "array<struct<role:string,content:string>>"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_numbered_equals_row_number(spark):
    rnd = random.Random(1)
    rows = [(("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])), rnd.randrange(40), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, i int").withColumn("_size", F.lit(1)).drop("_size")
    got = {r.i: r.position for r in ranks.numbered(df, "g", [F.col("v").desc(), F.col("i").asc()]).collect()}
    want, n = {}, {}
    for g, _, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        n[g] = n.get(g, 0) + 1
        want[i] = n[g]
    assert got == want
    assert ranks.numbered(df.where("false"), "g", [F.col("i")]).count() == 0


def test_filled_equals_rounds(spark):
    rnd = random.Random(2)
    rows, want = [], {}
    for g in range(25):
        sizes = {f"k{k}": rnd.randrange(0, 9) for k in range(rnd.randrange(1, 7))}
        total = rnd.randrange(0, 30)
        left, got = total, dict.fromkeys(sizes, 0)
        while left and any(got[k] < sizes[k] for k in sizes):
            for k in sorted(sizes):
                if left and got[k] < sizes[k]:
                    got[k] += 1
                    left -= 1
        rows += [(g, k, s, total) for k, s in sizes.items()]
        want |= {(g, k): v for k, v in got.items()}
    df = spark.createDataFrame(rows, "g int, k string, s int, total int")
    assert {(r.g, r.k): r.taken for r in ranks.filled(df, ["g"], ["k"], "s", "total").collect()} == want


def test_subset_sum_limits():
    assert budget.subset_sum([(3, "a"), (5, "b")], 0) == [] and budget.subset_sum([(3, "a")], -1) is None and budget.subset_sum([], 4) is None
    many = [(k, f"r{k:03d}") for k in range(1, 60)]
    assert budget.subset_sum(many, 1500, most=20) is None and budget.subset_sum(many, 1500, most=None) is not None
    # The first combination of a total is kept: by tokens, then id.
    assert budget.subset_sum([(2, "b"), (2, "a"), (4, "c")], 4) == ["a", "b"]
    # A pair of rows beyond the first 12 must go out: found without a limit only.
    chosen, others = [(10 + k, f"c{k:02d}") for k in range(14)], [(24, "x")]
    total = sum(t for t, _ in chosen)
    target = total - 22 - 23 + 24 + 24
    assert sum(dict((i, t) for t, i in chosen + others + [(24, "y")])[i] for i in budget.fit_exactly(chosen, others + [(24, "y")], target, None, None)) == target


def conversations(spark, n=120):
    rnd = random.Random(4)
    words = "the lamp door house river garden mill stone paper table with from near what why of and to in".split()
    say = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randrange(12, 60))) + "."
    rows = [(f"s{k % 3}", k, [("user", say()), ("assistant", say())]) for k in range(n)]
    return spark.createDataFrame(rows + [("s9", 0, rows[0][2]), (None, 5, None), ("s1", 7, [("user", " ")])], f"source string, source_row bigint, messages {MSG}").withColumn("stratum", F.lit("x"))


@pytest.mark.parametrize("strategy", selection.STRATEGIES)
def test_selection_meets_its_target(spark, strategy):
    rows = conversations(spark)
    manifest, before = selection.select(rows, strategy, 2_000, seed=13, floor=0.1)
    got = manifest.orderBy("place").collect()
    assert sum(r.token_count for r in got) == 2_000 and len({r.example_id for r in got}) == len(got) and [r.place for r in got] == list(range(1, len(got) + 1))
    assert [(r.source, r.source_row, r.example_id) for r in got] == sorted((r.source, r.source_row, r.example_id) for r in got)
    assert "s9" not in {r.source for r in got}
    assert sum(r.n_tokens for r in before.collect()) <= 2_000
    summary = selection.summary(manifest, 2_000)
    assert summary.first().exact and validation.fixed_budget_gate(summary, 2_000).first().passed and not validation.fixed_budget_gate(summary).first().passed
    assert files.manifest(manifest, tokens="words_and_marks").count() == len(got) and files.manifest(manifest, most_rows=3).count() == 3
    fails(files.manifest(manifest.withColumn("token_count", F.col("token_count") + 1), tokens="words_and_marks"), "bad manifest row")
    assert selection.select(rows.where("false"), strategy, 10)[0].count() == 0


def test_diversity_order(spark):
    assert [selection.cluster_count(n) for n in (1, 2, 5, 6, 20, 30)] == [1, 2, 2, 2, 4, 5]
    vectors = selection.hashed_words(["red lamp"] * 5 + ["blue door"] * 5)
    label = selection.k_means(vectors, 2, 1)
    assert len(set(label[:5])) == len(set(label[5:])) == 1 and label[0] != label[5] and np.allclose(np.linalg.norm(vectors, axis=1), 1)
    rows = [(f"e{k}", "s", k, "b", "st", 5, 0.9 - k / 100, "red lamp" if k < 6 else "blue door", None) for k in range(9)] + [("f", "s", 3, "b", "few", 5, 0.9, "x", None), ("g", "s", 1, "b", "few", 5, 0.9, "y", None)]
    df = spark.createDataFrame(rows, f"example_id string, source string, source_row bigint, length_bin string, stratum string, token_count int, quality_score double, text string, messages {MSG}")
    got = [(r.stratum, r.example_id) for r in selection.ordered(df, "diversity", 13).orderBy("stratum", "position").collect()]
    assert got[:2] == [("few", "g"), ("few", "f")]
    line = [i for s, i in got if s == "st"]
    assert {line[0], line[1]} == {"e0", "e6"} and {line[2], line[3]} == {"e1", "e7"} and len(line) == 9
    assert selection.ordered(df, "quality", 1, floor=0.85).where("stratum = 'st'").count() == 6


def test_replaced(spark):
    rows = lambda ids: spark.createDataFrame([(i, i * 2) for i in ids], "i int, v int")
    got = selection.replaced(rows([1, 2, 3]), rows([2]), rows([3, 4]), "i").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (3, 6), (4, 8)]


def test_plugins(spark):
    plugins.register(plugins.TOKENS, "letters", F.length)
    rows = conversations(spark, 6)
    a, b = (messages.candidate_rows(rows, 10_000, t).agg(F.sum("token_count")).first()[0] if t == "words_and_marks" else None for t in ("words_and_marks", "letters"))
    assert a and b is None
    with pytest.raises(KeyError, match="no tokens named"):
        plugins.named(plugins.TOKENS, "nobody")
    with pytest.raises(ValueError, match="unknown kind"):
        plugins.register("x", "y", len)


@pytest.mark.parametrize(
    ("text", "want"),
    [("123 !", None), ("", None), ("한국어", "ko"), ("ไทย", "th"), ("Привет мир", "ru"), ("България щит", "bg"), ("हिन्दी", "hi"), ("سلام گل", "fa"), ("سلام", "ur"), ("der Hund und die Katze", "de"), ("plain words here", "en"), ("että ja on", "fi"), (None, None)],
)
def test_language_guess(spark, text, want):
    assert value(spark, language.language_guess(F.lit(text).cast("string"))) == want


def test_structural_flags(spark):
    rows = [("a", [("User", "hi there"), ("Assistant", "yes")]), ("b", None), ("c", []), ("d", [("user", "x" * 12), ("assistant", " ".join(["word"] * 9) + "\x00")]), ("e", [("assistant", None), ("user", "q")])]
    got = {r.example_id: {k for k, v in r.asDict().items() if v is True} for r in messages.structural_flags(spark.createDataFrame(rows, f"example_id string, messages {MSG}")).collect()}
    assert got["a"] == {"messages_is_list", "valid_message_items", "has_user", "has_assistant", "assistant_last", "short_assistant_word_count"}
    assert got["b"] == set() and got["c"] == {"messages_is_list", "valid_message_items", "short_assistant_word_count"}
    assert got["d"] == {"messages_is_list", "valid_message_items", "has_user", "has_assistant", "assistant_last", "nonempty_assistant", "null_byte", "long_repeated_character_run"}
    assert got["e"] == {"messages_is_list", "has_user", "has_assistant", "nonempty_assistant", "short_assistant_word_count"}


def test_judge(spark):
    assert judge.first_object('x {a} {"b": {"c": 1}} {"d": 2}') == '{"b": {"c": 1}}' and judge.first_object("{[") is None and judge.first_object(None) is None
    full = {"correctness": 1, "instruction_following": 2.9, "clarity": "3", "self_containedness": 4, "overall_quality": 5}
    cases = [
        ({"scores": full, "confidence": 0.5}, (True, 15, 0.5, False)), ({"scores": full | {"clarity": True}, "confidence": "0.25", "uncertain": True}, (False, 12, 0.25, True)),
        ({"scores": full | {"clarity": 6, "correctness": "x"}, "confidence": 2}, (False, 11, None, False)), ({"scores": 3, "confidence": 0}, (False, 0, 0.0, False)), (None, (False, 0, None, True)),
    ]
    df = spark.createDataFrame([(k, None if c is None else "So: " + json.dumps(c) + " end") for k, (c, _) in enumerate(cases)], "k int, answer string")
    got = judge.with_object(df, "answer").select("k", judge.normal_judgement(F.col("object")).alias("j")).orderBy("k").collect()
    assert [(r.j.parse_ok, sum(r.j.scores.values()), r.j.confidence, r.j.uncertain) for r in got] == [w for _, w in cases]
    m = spark.createDataFrame([([("user", "a"), ("assistant", "b"), ("user", "c")],)], f"messages {MSG}")
    x = m.select(judge.split_messages(F.col("messages")).alias("s")).first()["s"]
    assert (x.user, x.assistant) == ("a\n\nc", "b")
    fails(m.select(judge.split_messages(F.slice("messages", 1, 1))), "missing user or assistant")
    a, b = (value(spark, judge.judge_prompt(F.lit("Q%s"), F.lit("A"), v)) for v in "ab")
    assert a != b and "<USER>\nQ%s\n</USER>" in a and "<ASSISTANT>\nA\n</ASSISTANT>" in b


def test_judged_records(spark, tiny):
    rows = table(spark, tiny, "judge_results")
    records = table(spark, tiny, "records")
    assert judge.judged_records(rows.unionByName(rows), records).count() == judge.judged_records(rows, records).count()
    fails(judge.judged_records(rows, records.where("false")), "in no record")
    judged = spark.createDataFrame([("s", 5.0), ("s", 5.0), ("t", 4.5)], "source string, overall double")
    assert {r.source: (r.n, r.mean_overall, r.at_maximum) for r in judge.source_means(judged).collect()} == {"s": (2, 5.0, True), "t": (1, 4.5, False)}
    assert {r.degenerate for r in judge.score_distribution(judged.where("source = 's'")).collect()} == {True} and not judge.score_distribution(judged).first().degenerate
    assert judge.structural_checks(rows.where("false"), records).first()["items"] == 0


def test_audit_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("a", None), ("b", None), (None, 2.0)], "g string, v double")
    got = {r.g: (r.n_rows, r.n, r["mean"], r["median"], r.least, r.most) for r in audit.score_statistics(df, "g", "v").collect()}
    assert got == {"a": (3, 2, 2.5, 2.5, 1.0, 4.0), "b": (1, 0, None, None, None, None), "unknown": (1, 1, 2.0, 2.0, 2.0, 2.0)}
    m = spark.createDataFrame([("x", "1"), ("y", "1"), ("x", "2"), ("x", None)], "m string, i string")
    assert [tuple(r) for r in audit.membership(m, "m", "i").collect()] == [("1", "x,y", 2)]
    assert tuple(audit.membership_counts(m, "m", "i").first()) == (2, 4, 2, 1)
    assert audit.score_mismatches(spark.createDataFrame([(0.5, 0.5), (0.5, 0.6), (None, 0.0), (None, 0.1)], "a double, b double"), "a", "b").count() == 2
    assert tuple(audit.found_in(m, m.where("m = 'y'"), "i").first()) == (4, 2)
    one, two = spark.createDataFrame([("1", 9), ("1", 3)], "i string, r int"), spark.createDataFrame([("1", 0), ("2", 5)], "i string, r int")
    assert sorted((r.i, r.r) for r in audit.first_wins([one, two], "i", ["r"]).collect()) == [("1", 3), ("2", 5)]
    assert [r.r for r in audit.first_rows(two, ["r"], 1).collect()] == [0]


def test_audit_counts(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 50), ("c", 50), ("d", 2)], "k string, n bigint")
    got = {r.k: r.taken for r in sampling.audit_counts(sizes, "k", "n", 30, 1).collect()}
    # 8, 8, 7, 7 by division; a and d have 1 and 2, the missing 12 go in rounds to b and c.
    assert got["a"] == 1 and got["d"] == 2 and sorted((got["b"], got["c"])) == [13, 14] and sum(got.values()) == 30
    assert sum(r.taken for r in sampling.audit_counts(sizes, "k", "n", 500, 1).collect()) == 103


def test_validation(spark, tiny):
    schema = table(spark, tiny, "eval_outputs").schema
    score = (None, None, None, None, True, None)
    rows = [(1, "r", "s", 1, 1, "gsm8k", "m", "g1", "1", "one", score, None), (2, "r", "s", 1, 1, "gsm8k", "m", "g1", "1", " ", score, None), (3, "r", "s", 1, 1, "gsm8k", "m", "g9", "1", "w " * 128, score, None), (4, "r", "s", 1, 1, "gsm8k", "m", None, "1", "x", None, None)]
    out = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([("gsm8k", "g1", None), ("gsm8k", "g2", None), ("bbh", "b1", None)], "benchmark string, example_id string, instruction_id_list array<string>")
    got = {r.benchmark: r for r in validation.completeness(out, items).collect()}
    g = got["gsm8k"]
    assert (g.n_rows, g.expected, g.ids, g.duplicate_ids, g.missing_ids, g.extra_ids, g.malformed, g.empty_responses, g.possibly_cut, g.min_tokens, g.max_tokens, g.scored, g.complete) == (4, 2, 2, 1, 1, 1, 2, 1, 1, 1, 128, 2, False)
    assert (got["bbh"].n_rows, got["bbh"].missing_ids) == (0, 1)
    assert sorted((r.benchmark, r.example_id, r.fault) for r in validation.faulty_ids(out, items).collect()) == [("bbh", "b1", "missing"), ("gsm8k", "g1", "duplicate"), ("gsm8k", "g2", "missing"), ("gsm8k", "g9", "extra")]
    assert tuple(validation.completeness_total(validation.completeness(out, items)).first()) == (2, False, 1, 2)
    whole = validation.completeness(out.where("output_id = 1"), items.where("example_id = 'g1'"))
    assert whole.first().complete
    audit_row = spark.createDataFrame([("automatic structural audit", False, 8, 80, 0, 20, 20)], "audit_type string, human_ratings_performed boolean, manifest_count int, total_manifest_rows int, mismatches int, sampled int, found_in_manifests int")
    assert validation.audit_gate(audit_row, 8, 80, 20).first().passed and not validation.audit_gate(audit_row.withColumn("mismatches", F.lit(None)), 8, 80, 20).first().passed


def test_alignment(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "o int, i string")
    b = spark.createDataFrame([(0, "x", "one"), (1, "q", "two")], "o int, i string, said string")
    assert sorted(tuple(r) for r in validation.alignment(a, b, "o", "i").collect()) == [(1, "y", "q"), (2, "z", None)]
    fails(validation.zipped(a, b, "o", "i"), "not those of the inputs")
    assert sorted((r.o, r.said) for r in validation.zipped(a, b.where("o = 0"), "o", "i").collect() if r.said) == [(0, "one")]
    fails(validation.zipped(a.where("o = 0"), b, "o", "i"), "not those of the inputs")
    x = value(spark, validation.named_run(F.lit("run=random= 13")))
    assert (x.name, x.strategy, x.seed) == ("run", "random", 13)
    fails(spark.range(1).select(validation.named_run(F.lit("run=random"))), "not name=strategy=seed")
    assert [r.i for r in sampling.rejoined(spark.createDataFrame([(2,)], "o int"), a, "o").collect()] == ["z"]
    fails(sampling.rejoined(spark.createDataFrame([(7,)], "o int"), a, "o"), "no row at 7")
    assert [r.i for r in streams.not_done(a, b, "i").orderBy("i").collect()] == ["y", "z"]


def test_metric_tables(spark):
    seeds = spark.createDataFrame([("a", "s", 13, "m", 0.25), ("b", "s", 42, "m", 0.75), ("c", "t", 13, "m", 0.5)], "adapter string, strategy string, seed int, metric string, value double")
    got = {r.strategy: (r.seed_13, r.seed_42, r.n_runs, r["mean"], r.sd) for r in metrics.seed_columns(seeds, [13, 42]).collect()}
    assert got == {"s": (0.25, 0.75, 2, 0.5, pytest.approx(0.3535533905932738)), "t": (0.5, None, 1, 0.5, 0.0)}
    assert {r.strategy: r.seeds for r in metrics.seed_lists(seeds).collect()} == {"s": "13,42", "t": "13"}
    assert {(r.family, r.n) for r in sampling.family_counts(spark.createDataFrame([(["a", "a", "b"],), (["b", None],), (None,)], "f array<string>"), "f").collect()} == {("a", 1), ("b", 2)}


def test_overlap_blocks(spark):
    rnd = random.Random(8)
    say = lambda: "".join(rnd.choice("abcd ") for _ in range(30))
    ev = [(k, say()) for k in range(12)]
    tr = [(100 + k, "".join(rnd.choice("abcd ") if rnd.random() < 0.04 else c for c in rnd.choice(ev)[1])) for k in range(30)]
    train, evaluation = spark.createDataFrame(tr, "train_id int, norm string"), spark.createDataFrame(ev, "eval_id int, norm string")
    want = set()
    for i, x in tr:
        for j, y in ev:
            a, b = contamination.runs_of(x, 5), contamination.runs_of(y, 5)
            if len(a & b) >= 0.35 * len(a | b):
                want.add((i, j, len(a & b)))
    for chars in (10, 70, 10_000):
        assert {(r.train_id, r.eval_id, r.votes) for r in contamination.shingle_votes(train, evaluation, block_chars=chars).collect()} == want
    one, many = ({(r.train_id, r.eval_id, r.ratio) for r in contamination.near_overlap(train, evaluation, 0.8, None, block_chars=c).collect()} for c in (10_000, 40))
    assert one == many and one
    assert contamination.near_overlap(train, evaluation.where("false")).count() == 0


def test_scoring_forms(spark):
    option = lambda r, t: value(spark, scoring.extract_option(F.lit(r), F.lit(t)))
    assert option("so (B)", " (B) ") == "(B)" and option("a\r\nlast.", "zz") == "last" and option("one two", "zz") == "two"
    assert value(spark, scoring.evaluation_prompt(F.lit("ifeval"), F.lit("p"))) == "p" and value(spark, scoring.evaluation_prompt(F.lit("bbh"), F.lit("p"))).startswith("p\n\n")


def test_sources(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(7)], "v int").coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(k,) for k in range(20, 24)], "v int").repartition(2, "v").write.parquet(f"{tmp_path}/b")
    got = files.streams_of(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, 3).collect()
    assert sorted((r.source_row, r.v) for r in got if r.source == "a") == [(0, 0), (1, 1), (2, 2)] and sorted(r.source_row for r in got if r.source == "b") == [0, 1, 2]
    files.write_jsonl(spark.createDataFrame([("ü", 1)], "t string, n int"), f"{tmp_path}/j", one_file=True)
    assert [tuple(r) for r in files.read_jsonl(spark, f"{tmp_path}/j", "t string, n int").collect()] == [("ü", 1)]
    (tmp_path / "bad.jsonl").write_text('{"t": 1}\n{x\n')
    fails(files.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "t int"), "(?i)malformed")
    files.write_csv(spark.createDataFrame([(1, "a,b")], "n int, t string"), f"{tmp_path}/c", ["t", "n"], one_file=True)
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c").collect()] == [("a,b", "1")]
    (tmp_path / "d.json").write_text('{\n "a": [1, 2]\n}')
    assert files.read_json_document(spark, f"{tmp_path}/d.json").first().a == [1, 2]
    assert json.loads(files.summary_json(spark.createDataFrame([(1, "x")], "a int, b string"))) == {"a": 1, "b": "x"}
    with pa.OSFile(f"{tmp_path}/t.arrow", "wb") as f, pa.ipc.new_file(f, pa.schema([("a", pa.int32())])) as w:
        w.write_table(pa.table({"a": pa.array([1, 2], pa.int32())}))
    assert sorted(r.a for r in files.read_arrow(spark, f"{tmp_path}/t.arrow").collect()) == [1, 2]
    with pytest.raises(ValueError, match="more than"):
        files.read_arrow(spark, f"{tmp_path}/t.arrow", most_bytes=3)
    shot = files.snapshot(spark.createDataFrame([("m", "q"), ("m", "p"), ("n", "r")], "c string, p string"), "bench", "c", ["p"])
    assert sorted((r.p, r.example_id) for r in shot.collect()) == [("p", "bench-m-test-0000"), ("q", "bench-m-test-0001"), ("r", "bench-n-test-0000")]
    report = files.markdown_report("T", {"part": spark.createDataFrame([(1, "a|b", None)], "n int, t string, z string")})
    assert "## part" in report and "| 1 | a\\|b |  |" in report
    with pytest.raises(ValueError, match="more than 2 rows"):
        files.markdown_table(spark.range(5), 2)
    x = value(spark, files.padded(F.array(F.lit(5), F.lit(6)), 4, 0))
    y = value(spark, files.padded(F.array(F.lit(5), F.lit(6)), 3, 0, left=True))
    assert (list(x.ids), list(x["mask"]), list(x.labels)) == ([5, 6, 0, 0], [1, 1, 0, 0], [5, 6, -100, -100]) and list(y.ids) == [0, 5, 6]
    fails(spark.range(1).select(files.padded(F.array(F.lit(5), F.lit(6)), 1, 0)), "more ids")
    assert value(spark, files.utc_stamp()).endswith("+00:00")


def test_line_numbers_over_blocks(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 37) for k in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        got = files.numbered_lines(spark, f"{tmp_path}/big.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert [r.line for r in sorted(got, key=lambda r: r.line_no)] == lines and sorted(r.line_no for r in got) == list(range(1, 4001))


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, "a", 10 + k), (k + 10, "b", 5), (0, "a", 10)], "i int, g string, t int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in.parquet")
    feed = lambda: streams.table_stream(spark, str(tmp_path), "in")
    counts = streams.drained(streams.running_counts(feed(), "g", "t"), f"{tmp_path}/counts", "complete")
    assert {(r.g, r.n_rows, r.n_tokens) for r in counts.collect()} == {("a", 6, 63), ("b", 3, 15)}
    assert streams.drained(streams.dedup(feed(), "i"), f"{tmp_path}/dedup").count() == 6
    streams.capped_sample(feed(), "g", "i", 2, f"{tmp_path}/kept", f"{tmp_path}/kept_progress").awaitTermination()
    want = {tuple(r) for r in pool.capped(table(spark, str(tmp_path), "in").dropDuplicates(["i"]).select("i", "g"), "g", "i", 2).select("i", "g").collect()}
    assert {(r.i, r.g) for r in spark.read.parquet(f"{tmp_path}/kept/v2").collect()} == want
    streams.resumable_output(feed(), f"{tmp_path}/out", f"{tmp_path}/out_progress").awaitTermination()
    streams.resumable_output(feed(), f"{tmp_path}/out", f"{tmp_path}/out_progress").awaitTermination()
    assert spark.read.json(f"{tmp_path}/out").count() == 9


def test_in_batches(spark):
    got = streams.in_batches(spark.range(0, 300, 1, 1), 128, lambda b: b.assign(n=len(b)), "id bigint, n bigint").collect()
    assert sorted(r.id for r in got) == list(range(300)) and {r.n for r in got} == {128, 44}
    assert streams.in_batches(spark.range(0), 128, lambda b: b, "id bigint").count() == 0


def test_every_query_runs(spark, tiny):
    for name in ("select_quality", "select_before_top_up", "canonical_pool", "near_overlap_late", "near_overlap", "exact_fit", "coverage_greedy"):
        assert registry.QUERIES[name](spark, tiny).schema.names


def test_blank(spark):
    assert value(spark, T.is_blank(F.lit("\x1f  "))) and not value(spark, T.is_blank(F.lit(" a")))


def test_near_overlap_aligns_only_what_may_reach_the_ratio():
    import difflib
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(40)]
    base = " ".join(rnd.choices(words, k=60))
    texts = [" ".join(rnd.sample(base.split(), 60)) for _ in range(12)] + [base[:200] + "x" + base[201:], base + " ende"]
    at = contamination.letter_places(base)
    for x in [*texts, "", "abc", base]:
        match = difflib.SequenceMatcher(None, base, x, autojunk=False)
        row = [0] * (len(x) + 1)
        for c in base:
            last = 0
            for j, d in enumerate(x, 1):
                last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
        assert contamination.longest_common(at, len(base), x) == row[-1] >= sum(b.size for b in match.get_matching_blocks())


def test_near_overlap_of_shuffled_texts_is_quick(spark):
    # Same words in another order: letters and runs allow the ratio, the order doesn't; aligning all 900 pairs takes minutes.
    import random
    import time

    rnd = random.Random(4)
    base = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(110)]
    rows = [" ".join(rnd.sample(base, 110)) for _ in range(60)]
    train = spark.createDataFrame([(k, x) for k, x in enumerate(rows[:30])] + [(99, rows[40].replace("a", "b", 2))], "train_id int, norm string")
    evaluation = spark.createDataFrame([(k, x) for k, x in enumerate(rows) if k >= 30], "eval_id int, norm string")
    began = time.time()
    assert [(r.train_id, r.eval_id) for r in contamination.near_overlap(train, evaluation).collect()] == [(99, 40)]
    assert time.time() - began < 30
