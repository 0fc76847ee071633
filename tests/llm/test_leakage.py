import random

from tallyloom.llm import leakage


def brute(docs, items, run=12):
    found = set()
    for d, t in docs:
        w = leakage.words(t)
        spans = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        for i, q in items:
            v = leakage.words(q)
            if any(tuple(v[k : k + run]) in spans for k in range(len(v) - run + 1)):
                found.add((d, i))
    return found


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(40)]
    items = [(f"q{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 30)))) for i in range(60)]
    docs = []
    for d in range(300):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            w = items[rng.randrange(60)][1].split()
            n = rng.choice([10, 11, 12, 13, 30])
            at = rng.randrange(len(text) + 1)
            text[at:at] = w[:n]
        docs.append((d, "\n-- ".join(text).upper()))
    docs += [(900, None), (901, ""), (902, items[3][1] + " ... " + items[4][1]), (902, items[3][1])]
    items += [("null", None), ("short", "a b c"), ("twin", items[3][1])]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, id string")
    held = spark.createDataFrame([(i, q, ["t1"]) for i, q in items], "id string, question string, choices array<string>")
    wanted = brute([x for x in docs if x[1]], [x for x in items if x[1]])
    got = [tuple(r) for r in leakage.leaks(frame, held).collect()]
    assert set(got) == wanted and len(got) == len(wanted) > 40
    assert leakage.leaked_items(leakage.leaks(frame, held), frame, held).count() == len({i for _, i in wanted})


def test_several_indexes_and_empty_tables(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    held = spark.createDataFrame([("a", text), ("b", text + " x"), ("c", "y " + text)], "id string, question string")
    monkeypatch.setattr(leakage, "MAX_ITEMS", 2)
    assert sorted(r.id for r in leakage.leaks(frame, held).collect()) == ["a", "b", "c"]
    assert leakage.leaks(frame, held.limit(0)).count() == leakage.leaks(frame.limit(0), held).count() == 0
