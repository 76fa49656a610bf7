"""Operators for training data: brute force, exact round trips, edge cases and planted cases."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodecast.llm import bpe, leakage, mixture, pairs, queries, reading, systematic, textstats, tokens, tongues, truncation, variety
from lodecast.runtime import table

NAMES = {"records": "example_id", "documents": "doc_id", "eval_outputs": "output_id"}


@pytest.fixture(scope="module")
def tk():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", "Hello  world\n\n it's 1,234 <|endoftext|> café naïve", "x" * 500, "ab" * 300, "  lead\t\ttabs  nbsp ", "日本語のテキスト。" * 30, "🙂🙂 emoji", "\x00\x1f odd"]


def test_pieces_against_tokenizer(tk):
    e, pattern = bpe.PieceEncoder(bpe.load()), bpe.python_pattern()
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("abcde é1 ") for _ in range(n)) for n in (5, 60, 200, 900)]
    assert [list(x) for x in e.encode(texts, pattern)] == [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert bpe.load() == bpe.load("/opt/tokenizers/byte_bpe_50k.json")


def test_recursion_equals_heap():
    e = bpe.PieceEncoder(bpe.load())
    rnd = random.Random(7)
    words = ["".join(rnd.choice("etaoin shrdlu") for _ in range(n)).encode() for n in range(2, 150, 7)]
    e.recurse([w.decode() for w in words], words)
    assert all(list(e.known[w.decode()]) == list(e.contract(w)) for w in words)


def test_encode_documents(spark, tiny, tk):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*TEXTS, None, TEXTS[2]])], "doc_id bigint, text string, ids int")
    got = tokens.encode_documents(docs).orderBy("doc_id").collect()
    assert [list(r.ids) for r in got] == [tk.encode(t or "", add_special_tokens=False).ids for t in [*TEXTS, None, TEXTS[2]]]
    back = tokens.decode_ids(tokens.encode_documents(docs)).orderBy("doc_id").collect()
    assert [r.text for r in back] == [*TEXTS, "", TEXTS[2]]
    assert tokens.encode_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 10**6])
def test_token_counts(spark, tiny, tk, hot):
    docs = table(spark, tiny, "documents")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, tokens.pieces(F.col("text")), ["doc_id"], hot=hot).collect()}
    assert got == {r.doc_id: len(tk.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_unusable_counts(spark, tk):
    m = [("user", "one two three"), ("assistant", None)]
    rows = [("a", 3, None, m), ("b", 7, None, m), ("c", None, None, m), ("d", 0, None, m), ("e", 2, "one two three", None), ("f", 1, "one two three", None), ("g", 5, None, None)]
    df = spark.createDataFrame(rows, "example_id string, token_count int, text string, messages array<struct<role:string,content:string>>").withColumn("piece", F.lit(1))
    assert {r.example_id for r in tokens.unusable_counts(df).collect()} == {"b", "c", "d", "f", "g"}


def test_defects():
    q = "Explain how the red lamp was moved to the old house. It took five days until the work was done."
    good = "The lamp was moved on Monday. Two men carried it through the garden and into the hall."
    assert pairs.defect(q, good) is None
    assert [pairs.defect(q, a) for a in (None, "", " ​", "N/A", "[no answer]", "—", "...")] == ["empty"] * 7
    assert [pairs.defect(q, a) for a in ("I'm sorry, but I can't help with that request.", "Thank you for asking. Sadly, no answer will be given here.", "Lo siento, no puedo ayudar con eso.")] == ["refusal"] * 3
    assert pairs.defect(q, "I can't recommend the red lamp highly enough. " + good) is None
    assert [pairs.defect(q, a) for a in (q, q.upper(), "Your question: " + q, q + "\n" + q, q.replace(".", ""), "It took five days until the work was done. Explain how the red lamp was moved to the old house.")] == ["echo"] * 6
    assert pairs.defect(q, q + " " + good + " " + good) is None
    assert pairs.defect(q, good + " Then the second group of men was") == "truncated"
    assert pairs.defect(q, good + " Then the second gro[truncated]") == "truncated"
    assert pairs.defect(q, good + "\n\nBest wishes,\nTom") is None and pairs.defect(q, good + "\n- one lamp\n- two doors") is None
    french = "Le livre est sur la table dans la maison et les enfants ne sont pas là avec nous. Il y a du pain pour tous."
    assert pairs.defect(q, french) == "wrong_language" and pairs.defect(q + " Please answer in French.", french) is None


def test_longest_common():
    rnd = random.Random(3)
    for _ in range(50):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert pairs.longest_common(a, b) == t[-1][-1]


def test_pairs_of(spark):
    m = [("system", "s"), (" User", "q1"), ("user ", "q2"), ("ASSISTANT", "a2"), (None, "x"), ("user", None)]
    df = spark.createDataFrame([("a", m), ("b", None), ("c", [])], "example_id string, messages array<struct<role:string,content:string>>")
    got = pairs.pairs_of(df).orderBy("pair_no").collect()
    assert [(r.pair_no, r.question, r.answer, r.context) for r in got] == [(1, "q1", None, "s"), (2, "q2", "a2", "s"), (3, None, None, "s")]
    assert {(r.pair_no, r.defect) for r in pairs.broken_pairs(df.unionByName(df)).collect()} >= {(1, "empty"), (3, "empty")}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("", "empty"), ("- one\n- two red\n- three\n- four", "list"), ("a,b,c\nx,1,2\ny,3,4\nz,5,6", "table"), ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |", "table"),
        ("<>#$%^&*()_+=-|\\/~<>#$%^&*()_+=-|\\/~", "junk"), ("The cat sat on the mat and it was glad. Then the dog came in and they played for an hour.", "prose"),
        ("我们昨天检查了红色的雨伞。下雨以后他们回家了。老师整理了旧的表格。", "prose"), ("xkcd qwrt zxcv bnmp lkjh gfds qzxw vbnt mlkp wsxz rfvt", "junk"),
    ],
)
def test_kinds(text, kind):
    assert textstats.profile(text)[-1] == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Red umbrella large size wooden handle north depot\nBlue suitcase small size leather handle south depot\nGrey backpack medium size canvas strap west depot\nGreen raincoat large size yellow lining east depot\nBlack trolley small size rubber wheels main depot", "list"),
        ("Plan of the trip\n  Visit the old harbour with the group before noon\n    Check the boats and the ropes at the pier\n    Ask the captain for the list of the crew\n  Walk to the tower and look at the bells\n    Take the stairs on the left of the door", "list"),
        ("Item   Town  Units\nlamps  Bonn  12\nropes  Kiel  34\nsails  Jena  56\nmasts  Ulm   78", "table"), ("Item  Town  Units\nlamp  Bonn  12 kg\nrope  Kiel  34 kg\nsail  Jena  56 kg\nmast  Ulms  78 kg", "table"),
        ("The cat sat on the mat.  It was glad about\nthe sun.  Then the dog came in and they\nplayed for an hour.  At the end of the day\nthe two of them slept.  It was a good one.", "prose"),
    ],
)
def test_kinds_by_shape(text, kind):
    assert textstats.profile(text)[-1] == kind


def test_profiles_keep_rows(spark):
    df = spark.createDataFrame([("a", None, 0.5), ("b", "", None), ("b", "", None)], "example_id string, text string, quality_score double").withColumn("kind", F.lit("x"))
    got = textstats.text_profiles(df).collect()
    assert len(got) == 3 and sorted(str(r.kind) for r in got) == ["None", "empty", "empty"]


def test_languages():
    assert [tongues.main_language(t) for t in ("Der Hund ist im Haus und die Katze ist auf dem Dach.", "El perro está en la casa y los gatos no están.", "Мы вчера проверили сумки.", "x1 y2", None)] == ["de", "es", "ru", None, None]


def brute_groups(texts: dict) -> set:
    known: dict = {}
    bag = {i: Counter(variety.word_hashes(t, known).tolist()) for i, t in texts.items() if t and t.strip()}
    parent = {i: i for i in bag}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(bag)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n, m = sum(bag[a].values()), sum(bag[b].values())
            if max(n, m) - sum((bag[a] & bag[b]).values()) <= 0.2 * max(n, m):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(root(i), i) for i in ids if root(i) != i}


def test_groups_against_brute_force(spark):
    records = table(spark, "/root/testdata/sf0.01", "records")
    rows = records.groupBy("example_id").agg(F.min(variety.whole_text()).alias("t")).collect()
    want = brute_groups({r.example_id: r.t for r in rows})
    got = {(r.a, r.b) for r in variety.similar_groups(records).collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want


def test_hot_groups_and_edges(spark):
    base = "the red lamp was moved to the old house by two men who came from the town on monday morning with a car"
    rows = [(f"c{k:03d}", base) for k in range(200)] + [(f"d{k:03d}", base.replace("lamp", f"word{k}")) for k in range(100)] + [("x", None), ("y", ""), ("z", "?!")]
    df = spark.createDataFrame(rows, "example_id string, text string").withColumn("messages", F.expr("cast(null as array<struct<role:string,content:string>>)")).withColumn("key", F.lit(1))
    got = variety.similar_groups(df).collect()
    assert {r.a for r in got} == {"c000"} and len(got) == 299
    assert variety.similar_groups(df.where("false")).count() == 0
    dense = {r.example_id: r.density for r in variety.densities(df).collect()}
    assert dense["c000"] >= 200 and dense["x"] == 1.0
    assert variety.varied_subset(df, 7, 1).count() == 7


def test_weighted_sample(spark):
    df = spark.range(1000).withColumn("w", F.when(F.col("id") < 100, 5.0).otherwise(1.0))
    a = {r.id for r in systematic.weighted_sample(df, "w", 140, 3, "id", 1000).collect()}
    assert len(a) == 140 and 35 <= sum(i < 100 for i in a) <= 65
    assert systematic.weighted_sample(df, "w", 5000, 3, "id", 1000).count() == 1000
    assert systematic.weighted_sample(df, "w", 0, 3, "id", 1000).count() == 0


def test_mixture(spark, monkeypatch):
    rec = spark.createDataFrame([(f"e{k}", "A b" if k % 3 else "c", "s" if k % 2 else "t") for k in range(300)] + [("n", None, "s")], "example_id string, source string, length_bin string")
    mix = spark.createDataFrame([("m", "a-b", "s", 0.5, 0, 0.3), ("m", "a-b", "t", 0.4, 0, 0.3), ("m", "c", "s", 0.0, 5, 0.3), ("m", "c", "t", 0.1, 60, 0.3)], "mix_name string, source string, length_bin string, target_share double, min_rows int, sample_share double")
    sample, report = mixture.mixture_sample(rec, mix, 1)
    rows = {(r.source, r.length_bin): r for r in report.collect()}
    got = Counter((r.source, r.length_bin) for r in sample.collect())
    assert got[("c", "t")] == 50 and got[("c", "s")] == 5 and all(got[k] == r.selected for k, r in rows.items()) and sum(got.values()) == 90
    assert {tuple(r) for r in mixture.unfilled(rec, mix).collect()} == {("m", "c", "t")}
    first = {r.example_id for r in sample.collect()}
    monkeypatch.setattr(systematic, "RANGE_ROWS", 10)
    assert {r.example_id for r in mixture.mixture_sample(rec, mix, 1)[0].collect()} == first


def test_leaks(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    prompts = [" ".join(rnd.choices(words, k=40)) for _ in range(4)]
    opening = "all of these items start with the very same long opening sentence here"
    prompts[2], prompts[3] = opening + " " + prompts[2], opening + " " + prompts[3]
    items = spark.createDataFrame([("b", f"i{k}", p) for k, p in enumerate(prompts)] + [("b", "copy", prompts[0].upper()), ("b", "null", None)], "benchmark string, example_id string, prompt string").withColumn("doc_id", F.lit(1))
    part = prompts[0].split()[5:19]
    edited = [w if k % 7 else "changed" for k, w in enumerate(prompts[1].split()[3:33])]
    rows = [
        (1, "intro " + " ".join(part) + " outro"), (2, " ".join(prompts[0].split()[:9])), (3, " ".join(edited)), (4, opening), (5, None), (6, ""),
        (7, "<b>" + "</b> <i>".join(part).replace("w1", "w1") + "</i>"), (8, "> " + "\n> ".join(part)), (9, " ".join(prompts[2].split()[13:30])),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = leakage.leaked_items(docs, items)
    assert {(r.doc_id, r.example_id) for r in got.collect()} == {(1, "i0"), (1, "copy"), (3, "i1"), (7, "i0"), (7, "copy"), (8, "i0"), (8, "copy"), (9, "i2")}
    hit = got.where("doc_id = 1 AND example_id = 'i0'").first()
    assert rows[0][1][hit.start : hit.end] == " ".join(part)
    blocks = leakage.leaked_items(docs, items, block=50)
    assert {(r.doc_id, r.example_id) for r in blocks.collect()} >= {(1, "i0"), (3, "i1"), (8, "i0"), (9, "i2")}
    assert leakage.leaked_items(docs.where("false"), items).count() == 0 and leakage.leaked_items(docs, items.where("false")).count() == 0


def test_cut_responses(spark, tiny):
    out = table(spark, "/root/testdata/sf0.01", "eval_outputs")
    cut = spark.createDataFrame([(10**9, "The committee met on Monday. After that the second gro"), (10**9 + 1, '{"a": ["b", "c'), (10**9 + 2, "42"), (10**9 + 3, "It was done. All of it was good."), (10**9 + 4, "   "), (10**9 + 5, None), (10**9 + 6, "```\nx = 1\n```")], "output_id bigint, response string")
    got = {r.output_id for r in truncation.cut_responses(out.select("output_id", "response").unionByName(cut)).where(f"output_id >= {10**9}").collect()}
    assert got == {10**9, 10**9 + 1}
    assert truncation.cut_responses(out.where("false")).count() == 0


def test_reading(spark, tiny):
    hard = "Notwithstanding the methodological heterogeneity of institutional representations, probabilistic generalisations necessitate multidimensional operationalisation of terminological considerations. " * 5
    easy = "The cat sat on the mat. The dog ran to the tree. I like the red ball. We had fun in the sun. " * 5
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, hard), (-2, easy), (-3, easy.replace(".", "")), (-4, "- a\n- b"), (-5, None)], "doc_id bigint, text string"))
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(docs, table(spark, "/root/testdata/sf0.01", "doc_grades")).where("doc_id < 0").collect()}
    assert got == {-1: "advanced", -2: "elementary", -3: "elementary"}
    assert reading.reading_levels(docs.where("false"), table(spark, tiny, "doc_grades")).count() == 0


def test_held_out_grades(spark):
    d = "/root/testdata/sf0.1"
    docs, grades = table(spark, d, "documents"), table(spark, d, "doc_grades")
    held = reading.school_years(grades).withColumnRenamed("years", "truth").where("pmod(hash(doc_id), 3) = 0")
    rest = grades.join(held.select("doc_id"), "doc_id", "left_anti")
    both = reading.reading_levels(docs, rest).join(held, "doc_id").select("years", "truth").toPandas()
    assert len(both) > 150 and (both.years - both.truth).abs().mean() < 1.3


def test_queries_have_the_columns(spark, tiny):
    want = {"p1_found": ["example_id", "pair_no", "defect"], "p4_found": ["mix_name", "source", "length_bin"], "p5_found": ["example_id", "kind"], "p8_found": ["doc_id", "benchmark", "example_id"], "p9_found": ["doc_id", "reading_level"]}
    for name, cols in want.items():
        assert queries.QUERIES[name](spark, tiny).columns == cols
