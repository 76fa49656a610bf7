"""Leaks of short items, answers, items without rare runs, and through markup of any length."""

import random

from lodecast.llm import leakage


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id int, text string")
    i = spark.createDataFrame(items, "benchmark string, example_id string, prompt string, target string")
    return {(r.doc_id, r.example_id) for r in leakage.leaked_items(d, i, **kw).collect()}


WORDS = [f"w{k}" for k in range(500)]
rnd = random.Random(21)
LONG = " ".join(rnd.choices(WORDS, k=40))


def test_items_shorter_than_a_passage(spark):
    items = [("b", "nine", "which of these seven lamps hangs over nobody", None), ("b", "two", "Quorvex Halimar", None), ("b", "long", LONG, None)]
    docs = [(1, "they asked which of these seven lamps hangs over nobody today"), (2, "which of these seven lamps hangs"), (3, "it was Quorvex, Halimar said"), (4, "Quorvex alone"), (5, " ".join(LONG.split()[:8]))]
    assert found(spark, docs, items) == {(1, "nine"), (3, "two")}


def test_answers_are_searched_where_named(spark):
    answer = " ".join(rnd.choices(WORDS, k=20))
    items, docs = [("b", "i", LONG, answer), ("b", "none", LONG.upper(), None)], [(1, f"so {answer} then"), (2, f"so {LONG} then")]
    assert found(spark, docs, items) == {(2, "i"), (2, "none")}
    assert found(spark, docs, items, prompt_cols=("prompt", "target")) == {(1, "i"), (2, "i"), (2, "none")}


def test_items_without_rare_runs(spark):
    # Every run of three words stands in more than RARE items, each time in another neighbourhood.
    runs = [" ".join(rnd.choices(WORDS, k=3)) for _ in range(14)]
    items = []
    for k in range(12):
        order = list(runs)
        random.Random(k).shuffle(order)
        items.append(("b", f"i{k}", " ".join(order), None))
    got = found(spark, [(1, f"intro {items[0][2]} end")], items)
    assert (1, "i0") in got


def test_passage_of_common_runs_of_an_item_with_rare_ones(spark):
    # Each run of the passage stands in six other items, never beside the next one; the rest of its item is its own.
    passage = rnd.sample(WORDS, 12)
    items = [("b", "own", " ".join([*(f"own{k}" for k in range(15)), *passage]), None)]
    for j in range(6):
        apart = [[*passage[k : k + 3], f"f{j}x{k}", f"g{j}x{k}"] for k in range(10)]
        items.append(("b", f"other{j}", " ".join(w for part in apart for w in part), None))
    changed = [*passage[:5], "new", *passage[6:]]
    docs = [(1, f"intro {' '.join(passage)} end"), (2, f"intro {' '.join(passage[:9])} end"), (3, f"{items[1][2]} and no more"), (4, f"intro {' '.join(changed)} end")]
    assert found(spark, docs, items) == {(1, "own"), (3, "other0"), (4, "own")}


def test_markup_of_any_length(spark):
    part = LONG.split()[:20]
    half = lambda mark: " ".join(part[:10]) + mark + " ".join(part[10:])
    docs = [(1, half(f' <a title="{"x" * 900}"> ')), (2, half(" <!-- " + "y z " * 3000 + "--> ")), (3, "<!-- open " * 2000 + " ".join(part)), (4, half(" <b>")), (5, half(" <!-- one --> <!-- two --> "))]
    assert found(spark, docs, [("b", "i", LONG, None)]) == {(k, "i") for k in range(1, 6)}


def test_one_prompt_in_several_spellings(spark):
    # Items that differ in one number of forty words are one prompt; of ten words they are not, and what they share doesn't count.
    alike = [("b", f"a{k}", f"{LONG} costs {k} coins", None) for k in range(3)]
    assert found(spark, [(1, f"say {LONG} costs 1 coins")], alike) == {(1, "a0"), (1, "a1"), (1, "a2")}
    head = " ".join(rnd.choices(WORDS, k=11))
    apart = [("b", f"c{k}", head + " " + " ".join(rnd.choices(WORDS, k=15)), None) for k in range(3)]
    assert found(spark, [(1, head), (2, apart[1][2])], apart) == {(2, "c1")}


def test_offsets_through_comments(spark):
    d = spark.createDataFrame([(1, "ab <!-- c --> " + LONG)], "doc_id int, text string")
    i = spark.createDataFrame([("b", "i", LONG)], "benchmark string, example_id string, prompt string")
    hit = leakage.leaked_items(d, i).first()
    assert ("ab <!-- c --> " + LONG)[hit.start : hit.end] == LONG
