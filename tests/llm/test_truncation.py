import random
import re

from tallyloom.llm import truncation

SUBJECTS = ["claimant", "broker", "tenant", "adjuster"]
THINGS = ["kitchen", "sailboat", "warehouse", "orchard"]


def corpus():
    texts = []
    for i in range(400):
        s, t = SUBJECTS[i % 4], THINGS[i // 4 % 4]
        texts.append(f"The {s} keeps the {t} and pays ${100 + i},500. A limit of {i} percent applies each time the {t} burns, so the waiver controls.")
    return texts


def test_cuts_are_told_from_ends(spark):
    cut = ["The claimant keeps the kitchen and pays $120,500. A limit of 12 perc", "The broker keeps the", "The tenant keeps the orchard and pays ", "A limit of 3 percent applies each time the…", "A limit of 3 percent app..."]
    whole = ["A limit of 3 percent applies each time the kitchen burns, so the waiver controls", "The claimant keeps the kitchen and pays $160,500", "N/A", "", "   ", "...", "Does the waiver?"]
    base = corpus()
    rows = [(i, t, 0) for i, t in enumerate(base)] + [(1000 + i, t, 0) for i, t in enumerate(cut)] + [(2000 + i, t, 0) for i, t in enumerate(whole)] + [(3000, None, 0), (1001, cut[1], 0)]
    texts = spark.createDataFrame(rows, "id bigint, body string, n int")
    got = {r.id for r in truncation.cut_texts(texts, "id", "body").collect()}
    assert got == {1000 + i for i in range(len(cut))}


def test_copies_of_a_cut_text_count_once(spark):
    base = corpus()
    broken = ["A limit of 3 percent applies each time the", "The claimant keeps the kitchen and pays $120,500. A limit of 12 perc"]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, broken[i % 2]) for i in range(400)]
    texts = spark.createDataFrame(rows, "id bigint, body string")
    assert {r.id for r in truncation.cut_texts(texts, "id", "body").collect()} == {1000 + i for i in range(400)}


def test_own_end_does_not_vote(spark):
    rare = [f"The {SUBJECTS[i % 4]} keeps the {THINGS[i // 4 % 4]} once the disputed premium of ${900 + i} was paid." for i in range(20)]
    rows = list(enumerate([*corpus(), *rare])) + [(1000, "The tenant keeps the orchard once the disputed")]
    texts = spark.createDataFrame(rows, "id bigint, body string")
    assert {r.id for r in truncation.cut_texts(texts, "id", "body").collect()} == {1000}


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], "id bigint, body string")
    assert truncation.cut_texts(empty, "id", "body").count() == 0
    long = spark.createDataFrame([(1, "a-" * 60_000), (2, "x" * 200_000), (3, "word " * 50_000)], "id bigint, body string")
    assert truncation.cut_texts(long, "id", "body").count() <= 3


def test_share_by_run(spark):
    texts = spark.createDataFrame([(1, "r", "x"), (2, "r", "y"), (3, None, "z")], "pred_id bigint, run string, reason string")
    cut = spark.createDataFrame([(2,)], "pred_id bigint")
    got = {r.run: (r.n_replies, r.n_cut, r.share_cut) for r in truncation.share_by_run(texts, cut).collect()}
    assert got == {"r": (2, 1, 0.5), None: (1, 0, 0.0)}


def test_words_take_few_passes_over_a_text(spark):
    assert truncation._words("p").count("replace(") <= 4

    def one_mark_at_a_time(text):
        for old, new in [*((m, "") for m in truncation._BARE), ("…", "."), ("!", "."), ("?", "."), ("\t", " "), ("\r", " "), ("\n", " . ")]:
            text = text.replace(old, new)
        text = " " + re.sub("[A-Z]++(?=-?9)", "A", re.sub("[0-8]", "9", text)).lower() + " "
        for old, new in [*((f" {t}. ", f" {t} ") for t in truncation._TITLES), *((f"{m} ", f" {m} ") for m in ",;:.")]:
            text = text.replace(old, new)
        return [w for w in text.split(" ") if w]

    rng = random.Random(5)
    parts = [*",;:.…!?-\t\r\n “)*'é", "a", "Q", "AB", "9", "40", " mr. x", " Dr. ", " sra.", " Mrs. x", "e.g. "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    texts = ["q,9 mr. x", *(t for t in texts if not re.search(r"(?i)\b(mr|mrs|dr|sra)\b[\W_]+\1\b", t))]  # a title that stands twice is tested below
    rows = spark.createDataFrame([(t,) for t in texts], "p string").selectExpr("p", f"{truncation._words('p')} as w").collect()
    assert [r.w for r in rows] == [one_mark_at_a_time(r.p) for r in rows] and len(rows) > 2000


def test_a_repeated_title_is_split_as_its_pieces_are(spark):
    rows = spark.createDataFrame([("Mr. Mr. Ames paid.",)], "p string")
    whole, pieces = rows.selectExpr(f"{truncation._words('p')} as w", f"flatten(array({', '.join(truncation._words(repr(x)) for x in 'Mr. Mr. Ames paid.'.split())})) as x").first()
    assert whole == pieces == ["mr", "mr", "ames", "paid", "."]
