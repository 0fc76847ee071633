from tallyloom.llm import pairs

STEM = "A broker told the tenant that the insurer would accept a warehouse. Which document proves the waiver to the broker?"
CHOICES = {"A": "the form as signed", "B": "a refund of $500", "C": "ninety days", "D": None}
GOOD = "The waiver exists to stop a gain from fire, and the broker should keep the copy."


def test_one_defect_each(spark):
    replies = [
        (1, 1, "A", GOOD, None), (2, 1, "A", None, "empty"), (3, 1, "A", " ​ ", "empty"), (4, 1, "A", "REASON:", "empty"), (5, 1, "A", "n/a", "empty"), (6, 1, "A", "[no text]", "empty"),
        (7, 1, None, GOOD, "empty"), (8, 1, "N/A", GOOD, "empty"), (9, 1, "E", GOOD, None), (10, 1, "A", "I'm sorry, but I can't help with exam questions.", "refusal"),
        (11, 1, None, "Request declined.", "refusal"), (12, 1, "A", "I cannot agree with the view that fire ends the waiver.", None), (13, 1, "A", "The notice read “no puedo responder”, and the waiver stays in force for the broker.", None),
        (14, 1, "A", "El asegurado debía avisar a la compañía en un plazo de 52 días.", "other_language"), (15, 2, "A", "El asegurado debía avisar a la compañía en un plazo de 52 días.", None),
        (16, 2, "A", GOOD, "other_language"), (17, 9, "A", "El asegurado debía avisar a la compañía en un plazo de 52 días.", None), (18, 1, "B", STEM, "copies_question"),
        (19, 1, "B", "You asked: “" + STEM.upper() + "”", "copies_question"), (20, 1, "B", STEM.replace("told", "tolds").replace(" the ", "  the ") + "\nA. the form as signed\nB. a refund of $500", "copies_question"),
        (21, 1, "B", STEM + " " + GOOD, None), (22, 1, "B", "The waiver says “no cover", "truncated"), (23, 9, "B", STEM, None), (24, 3, "B", "Ninety days after the loss the broker must act.", None),
    ]
    options = spark.createDataFrame([(i, "c", "r", q, o, r, 0) for i, q, o, r, _ in replies], "pred_id bigint, corpus string, run string, question_number int, option string, reason string, defect int")
    answers = spark.createDataFrame([], "pred_id bigint, corpus string, run string, question_number int, answer string, reason string")
    questions = spark.createDataFrame(
        [(1, "c", 1, STEM, CHOICES), (2, "c", 2, "¿Qué documento tiene que presentar el asegurado a la compañía por los daños?", None), (3, "c", 3, None, None), (8, "c", 1, "twin", None)],
        "item_id bigint, corpus string, question_number int, stem string, choices map<string,string>",
    )
    got = {r.pred_id: r.defect for r in pairs.broken(options, answers, questions).collect()}
    assert got == {i: x for i, _, _, _, x in replies if x}


def test_hot_questions_are_spread(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HOT", 5)
    rows = [(i, "c", "r", 1 if i % 3 else 2 + i, "A", STEM if i % 2 else GOOD) for i in range(60)]
    options = spark.createDataFrame(rows, "pred_id bigint, corpus string, run string, question_number int, option string, reason string")
    questions = spark.createDataFrame([(i, "c", i, STEM, CHOICES) for i in range(1, 70)], "item_id bigint, corpus string, question_number int, stem string, choices map<string,string>")
    answers = options.limit(0).withColumnRenamed("option", "answer")
    wanted = {i: "copies_question" for i in range(1, 60, 2)}
    assert {r.pred_id: r.defect for r in pairs.broken(options, answers, questions).collect()} == wanted
    monkeypatch.setattr(pairs, "MOST_HOT", 0)
    assert {r.pred_id: r.defect for r in pairs.broken(options, answers, questions).collect()} == wanted


def test_automata():
    a = pairs.SuffixAutomaton("abcbc")
    assert a.covered("zbcbcz", 3) == [False, True, True, True, True, False] and a.covered("", 2) == []
    p = pairs.PhraseAutomaton(["a b c", "b d", "c"])
    assert p.found("a b d".split()) and p.found("x c".split()) and not p.found("a b a".split()) and not p.found([])


def test_suffix_automaton_equals_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(60):
        s, t = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(2))
        wanted = [any(i <= k < j and t[i:j] in s for i in range(len(t)) for j in range(i + 3, len(t) + 1)) for k in range(len(t))]
        assert pairs.SuffixAutomaton(s).covered(t, 3) == wanted


def test_empty(spark):
    options = spark.createDataFrame([], "pred_id bigint, corpus string, run string, question_number int, option string, reason string")
    questions = spark.createDataFrame([], "item_id bigint, corpus string, question_number int, stem string, choices map<string,string>")
    assert pairs.broken(options, options.withColumnRenamed("option", "answer"), questions).count() == 0


def test_no_shortcut_hides_a_defect():
    listed = pairs.squashed("A 12 months B 24 months C 36 months D 48 months")
    source = pairs.squashed("How long? 12 months 24 months 36 months 48 months")
    assert pairs.may_copy(listed, source) and pairs.is_copy(listed, pairs.SuffixAutomaton(source))
    assert pairs.is_unusable("Reason: " * 12) and pairs.is_unusable("- " * 45 + "n/a") and pairs.is_unusable(" " * 45 + "Reason:")
    assert pairs.is_unusable(" " * 80 + "N/A") and pairs.is_unusable("\u200b" * 90 + "Answer: N/A")
    assert not pairs.is_unusable(" " * 80 + "The binder holds.")
    assert pairs.without_lead(" " * 60 + "Answer: yes") == "yes"


def test_bounds_before_the_automaton_lose_no_copy():
    import random

    rng = random.Random(7)
    alphabet, kept = "abcdefgh ,.é", 0
    for _ in range(3000):
        prompt = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 160)))
        reply = list(prompt[rng.randint(0, 8) : rng.randint(20, 200)])
        for k in range(rng.randint(6, 15), len(reply), rng.randint(9, 15)):
            reply[k] = rng.choice("xyz")
        reply = rng.choice(["", "so: ", "zzzz zzzz zzzz zzzz "]) + "".join(reply) + rng.choice(["", "?", " qqqqq qqqqq", " qqqqq qqqqq qqqqq qqqqq"])
        source = pairs.squashed(prompt)
        if source and pairs.is_copy(pairs.squashed(reply), pairs.SuffixAutomaton(source)):
            kept += 1
            assert pairs.may_copy(reply.lower(), source)
    assert kept > 100


def test_delimiters():
    inside = ["He said “no", "see (page 3", "the form [as signed", 'He wrote "no cover', "«no “cover”", "(a “b)  “c"]
    outside = ["He said “no”.", "a) first b) second", 'a 5" pipe', 'He wrote "no cover".', "(see [page 3])", "“a (b”", "One (of two. The form holds.", 'the "A" form and the ("B") form', ""]
    assert [pairs.ends_inside(x) for x in inside] == [True] * len(inside)
    assert [pairs.ends_inside(x) for x in outside] == [False] * len(outside)


def test_bounds_look_few_pieces_up():
    class Source(str):
        looked = 0

        def __contains__(self, piece):
            self.looked += 1
            return str.__contains__(self, piece)

    source = Source(pairs.squashed(STEM))
    assert not pairs.may_copy("zqxj " * 40, source) and 0 < source.looked <= 5


def test_words_and_letters_equal_expressions():
    import random
    import re

    rng = random.Random(11)
    parts = [*"abzAZ09'’ .,-_\n\t\x00é", "İ", "K", "n't", "''"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        lower = text.lower()
        plain = lower.replace("’", "'")
        assert pairs.spoken_words(text) == re.findall(r"[a-z]+(?:'[a-z]+)*" if plain.isascii() else r"[^\W\d_]+(?:['’][^\W\d_]+)*", plain)
        assert pairs.squashed(text) == re.sub(r"[^a-z0-9]+" if lower.isascii() else r"[\W_]+", "", lower)
