from pyspark.sql import functions as F

from tallyloom.functions import parsing, replies, similarity
from tallyloom.operators import modelcall
from tallyloom.sources import blocks, documents, keys, sinks

TEXT = """1. Which item lists the parts
of a kite?
A. sail and spar
B. hull and keel
stray line
C. wheel and axle
D. lens and barrel

2. Pick the even number.
A. 3
B. 4
B. 5
C. 6

no number here
A. x

2. Again
A. 1
"""


def read(spark, dialect, text=TEXT):
    frame = spark.createDataFrame([("f", text)], "path string, text string")
    return sorted((r.question_number, r.stem, dict(r.choices)) for r in blocks.items(frame, dialect).collect())


def test_dialects(spark):
    first = {"A": "sail and spar", "B": "hull and keel", "C": "wheel and axle", "D": "lens and barrel"}
    assert read(spark, "stripping") == [(1, "Which item lists the parts of a kite?", first), (2, "Again", {"A": "1"}), (2, "Pick the even number.", {"A": "3", "B": "5", "C": "6"})]
    assert read(spark, "mapped") == [(1, "Which item lists the parts", first), (2, "Again", {"A": "1"})]
    assert read(spark, "strict") == [(1, "Which item lists the parts", first)]
    assert read(spark, "lookahead")[0] == (1, "Which item lists the parts of a kite?", {**first, "B": "hull and keel stray line"})
    assert read(spark, "lenient", "1) What\nis it?\na) one\n\nmore\nB. two\n2. empty\n") == [(1, "What is it?", {"A": "one more", "B": "two"})]


def test_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("f", TEXT)], "path string, text string")
    items = blocks.items(frame).where("question_number = 1")
    sinks.write_blocks(items, str(tmp_path / "out"))
    again = blocks.items(blocks.read_texts(spark, str(tmp_path / "out"))).where("question_number = 1").first()
    assert again.stem == items.first().stem and again.choices == items.first().choices


def test_keys(spark):
    text = "# note\n1 A\n2 b\n3 ?\n4\tC # x\n2 D\n5) a\nzz\n"
    lines = blocks.read_lines(spark.createDataFrame([("f", text)], "path string, text string"))
    read_key = lambda d: {r.question_number: r.gold for r in keys.answer_key(lines, d).collect()}
    assert read_key("letters") == {1: "A", 2: "D"}
    assert read_key("marked") == {1: "A", 2: "D", 4: "C", 5: "A"}
    assert read_key("any")[3] is None and read_key("any")[2] == "D"
    assert {r.reference for r in keys.explanation_key(lines).collect()} >= {"A", "D"}


def test_prediction_files(spark, tmp_path):
    (tmp_path / "one_reasoned.csv").write_text('question_number,answer,reason\n1,A,"x, ""y""\nz"\n1,b,later\nx,C,bad\n2,,blank\n')
    (tmp_path / "two.csv").write_text("question_number,option,answer,reason\n1,,D,r\n2,C,A,r\n")
    got = {(r.run, r.question_number): (r.letter, r.reason) for r in keys.predictions(spark, str(tmp_path)).collect()}
    assert got == {("one_reasoned", 1): ("B", "later"), ("two", 1): ("D", "r"), ("two", 2): ("C", "r")}
    judge = {(r.run, r.question_number): r.letter for r in keys.predictions(spark, str(tmp_path), prefer="answer", keep_blank=True).collect()}
    assert judge[("two", 2)] == "A" and judge[("one_reasoned", 2)] is None


def test_html(spark):
    page = '<div class="mcq" data-n="4"><p class="q">Stem <b>x</b></p><ol class="choices"><li>1</li><li>2</li><li>3</li><li>4</li></ol><span class="key">b</span></div><div class="mcq"><p class="q">no key</p></div>'
    r = documents.html_items(spark.createDataFrame([(1, page), (2, None)], "page_id bigint, html string")).first()
    assert (r.question_number, r.stem, r.choices["D"], r.gold) == (4, "Stem x", "4", "B")


def test_item_parsers():
    assert parsing.wrapped("aa bb cc", 5) == ["aa bb", "cc"] and parsing.wrapped(None) == [] and parsing.wrapped("x" * 7, 5) == ["xxxxx", "xx"]
    assert parsing.paragraphs(["one", "two.", "(three)"]) == "one \n\ntwo.\n\n(three)"
    assert parsing.folded_options(["One", "two more", "Three", "Four", "Five", "Six"]) == ["One two more", "Three", "Four", "Five Six"]
    assert parsing.folded_options(["a", "b"]) == [] and parsing.folded_options(None) == [] and parsing.folded_options(["A", "B", "C", "D", "E"]) == ["A", "B", "C", "D E"]
    assert parsing.folded_options(["Total loss of cargo P e r i l s", "Two", "Three"]) == ["Total loss of cargo", "P e r i l s", "Two", "Three"]
    assert parsing.peeled_options("stem A one B two C three D four") == {"A": "one", "B": "two", "C": "three", "D": "four"}
    assert parsing.peeled_options("stem a one c two d three") == {"A": "one", "B": "", "C": "two", "D": "three"} and parsing.peeled_options("a b") == parsing.peeled_options(None) == {}
    card = parsing.numbered_item(["Which one", "is it?", "1. a long enough option", "that wraps", "2. two", "3. three", "4. four", "A long enough option that wraps"])
    assert card == {"stem": "Which one is it?", "options": ["a long enough option that wraps", "two", "three", "four"], "answer": "A"}
    assert parsing.numbered_item(["Q", "1. a", "2. b", "3. c", "4. d", "2. b"])["answer"] == "B" and parsing.numbered_item(None)["answer"] is None


def test_reply_parsers(spark):
    cases = [
        ("OPTION: B\nREASON: because x\nmore", ("B", "because x more"), ("B", "because x"), "B"), ("ANSWER: A\nOPTION: c) no", ("C", "ANSWER: A\nOPTION: c) no"), ("C", "ANSWER: A\nOPTION: c) no"), None),
        ("OPTION: A, B, C or D", ("A", "OPTION: A, B, C or D"), ("A", "OPTION: A, B, C or D"), "A"), ("Option A covers fire.", (None, "Option A covers fire."), (None, "Option A covers fire."), None),
        ("B. because of fire damage", ("B", "B. because of fire damage"), (None, "B. because of fire damage"), "B"), ("B. " + "because of fire damage and smoke " * 3, (None, None), (None, None), None),
        ("Well.\nThe correct answer is D", ("D", "Well.\nThe correct answer is D"), (None, "Well.\nThe correct answer is D"), "D"), ("(c)", ("C", "(c)"), (None, "(c)"), "C"),
        ("OPTION: B because the binder still stood", ("B", "the binder still stood"), ("B", "OPTION: B because the binder still stood"), None), (None, (None, ""), (None, "PARSE_FAILED: empty response"), None), ("\0 ", (None, ""), (None, "PARSE_FAILED: empty response"), None),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, reply string")
    got = {r.i: r for r in frame.select("i", replies.strict(F.col("reply")).alias("s"), replies.simple(F.col("reply")).alias("m"), replies.loose_letter(F.col("reply")).alias("l")).collect()}
    for i, (_, strict, simple, loose) in enumerate(cases):
        assert got[i].s.letter == strict[0] and (strict[1] is None or got[i].s.reason == strict[1]), i
        assert got[i].m.letter == simple[0] and (simple[1] is None or got[i].m.reason == simple[1]), i
        assert loose is None or got[i].l == loose, i


def test_forced_letters_and_reasons(spark):
    import hashlib

    data = [("The answer is B", "s"), ("maybe A or C", "s"), ("none", "some stem"), (None, "x"), (None, None)]
    frame = spark.createDataFrame(data, "reply string, stem string")
    hashed = lambda s: "ABCD"[int(hashlib.sha256(s.encode()).hexdigest(), 16) % 4]
    assert [r.x for r in frame.select(replies.forced(F.col("reply"), F.col("stem")).alias("x")).collect()] == ["B", "C", hashed("some stem"), hashed("x"), hashed("")]
    texts = ["FORMAT FIX. You reply", "You must choose", "OPTION: A OPTION: B", "The binder stood for a whole month. And more.", None]
    said = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in said.select(replies.is_echo(F.col("t")).alias("x")).collect()] == [True, True, True, False, False]
    raws = F.array(F.lit("A. one\nThe binder stood for a whole month. And more."), F.lit("REASON: you must\n\nREASON: later"))
    one = spark.range(1).select(replies.clean_reason(F.lit("YOU MUST"), raws, F.lit(False)).alias("a"), replies.clean_reason(F.lit("own"), raws, F.lit(False)).alias("b"), replies.clean_reason(F.lit(None).cast("string"), F.array(F.lit("x")), F.lit(True)).alias("c")).first()
    assert tuple(one) == ("one The binder stood for a whole month.", "own", replies.NO_REASON_FORCED)
    long = "The roof was wet. " * 12
    out = spark.range(1).select(replies.exported_reason(F.lit("Question 4: the tenant signed the form first. Format fix. x")).alias("a"), replies.exported_reason(F.lit(long + "REASON: the policy lapsed in May")).alias("b")).first()
    assert tuple(out) == ("the tenant signed the form first.", (long + "REASON: the policy lapsed in May").strip()) and "policy" in out.b


def test_best_terms_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(3, 40)))
    stems, terms = [(i, word()) for i in range(30)], [(i, word(), "d") for i in range(20)]
    got = {r.id: (r.pos, round(r.score, 9)) for r in similarity.best_terms(spark.createDataFrame(stems, "id int, stem string"), spark.createDataFrame(terms, "pos int, term string, definition string")).collect()}
    for i, s in stems:
        scored = [(similarity.ratio(s, t), -p) for p, t, _ in terms]
        best = max(scored)
        assert got.get(i) == ((-best[1], round(best[0], 9)) if best[0] >= similarity.STEM_REJECT else None)


def test_model_stages(spark):
    import pytest

    items = spark.createDataFrame([("c", 1, "s", {"A": "x", "B": "y"}), ("c", 3, "s", {"A": "x", "B": "y"}), ("c", 2, "s", {"A": "x"})], "corpus string, question_number int, stem string, choices map<string,string>")
    got = {r.question_number: (r.option, r.reason) for r in modelcall.answered(items, modelcall.CyclingClient()).collect()}
    assert got[1][0] == "A" and got[3][0] == "C" and got[2] == ("", modelcall.SKIPPED)
    with pytest.raises(ValueError, match="must not hold"):
        modelcall.answered(items.withColumnRenamed("stem", "gold"), modelcall.CyclingClient())
    groups = modelcall.reviewed(items, modelcall.JsonClient({"duplicate_groups": [[1, 3], [2]]})).collect()
    assert [r.members for r in groups] == [[1, 3]]
    frame = items.selectExpr("question_number", "stem as prompt")
    scored = modelcall.scored(frame, modelcall.JsonClient({"score": 2.9}), "score", 0, 3).first()
    assert (scored.score, scored.notes) == (2, "")
    assert modelcall.scored(frame, modelcall.JsonClient({"score": "2.9"}), "score", 0, 3).first().notes == "parse_error"


def test_until_quota(spark):
    accepted = spark.createDataFrame([(0, "first")], "n int, stem string")
    ask = lambda turn, _: spark.range(3).select((F.col("id") + 10 * (turn + 1)).cast("int").alias("n"), F.concat(F.lit(f"stem {turn} "), "id").alias("stem"))
    assert modelcall.until_quota(ask, accepted, 6, "stem", "n").count() == 6
    same = lambda turn, _: accepted
    assert modelcall.until_quota(same, accepted, 6, "stem", "n").count() == 1


def test_sinks(spark, tmp_path):
    log = spark.createDataFrame([("t", "a|b", 1.0)], "model string, notes string, accuracy double")
    assert sinks.log_line(log).first().value == "| t | a/b | 1.0 |"
    sinks.append_run(log, str(tmp_path / "log"))
    sinks.append_run(log, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    sinks.write_key(spark.createDataFrame([(2, None), (1, "A")], "question_number int, gold string"), str(tmp_path / "key"), ["sample"])
    assert [r.value for r in spark.read.text(str(tmp_path / "key")).collect()] == ["# sample", "1 A", "2 ?"]
    assert "| t | a|b | 1.00 |" in sinks.markdown_table(log)
