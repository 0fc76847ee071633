from tallyloom.llm import copies, nearcopies

ITEMS = "item_id bigint, stem string, choices map<string,string>, n_copies int"


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_formatting_does_not_tell_items_apart(spark):
    items = spark.createDataFrame(
        [
            (5, "What is  a Kite?", {"A": "sail", "B": "Hull."}, 1),
            (3, "what is a kite", {"B": "SAIL", "A": "hull"}, 1),
            (4, "what is a kite", {"A": "sail"}, 1),
            (9, None, {"A": "x"}, 1),
            (8, "...", {"A": "X"}, 1),
            (7, None, None, 1),
            (6, "", {}, 1),
            (1, "Año", {"A": None, "B": "é"}, 1),
            (2, "ano", {"B": "e"}, 1),
            (3, "what is a kite", {"B": "SAIL", "A": "hull"}, 1),
            (None, "what is a kite", {"B": "SAIL", "A": "hull"}, 1),
        ],
        ITEMS,
    )
    assert rows(copies.copies(items)) == [(3, 5), (6, 7), (8, 9)]
    kept = copies.collapsed(items)
    assert {r.item_id: r.n_copies for r in kept.collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 6: 2, 8: 2}


def test_hot_keys_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(copies, "HOT", 3)
    items = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"stem {i}", {"A": "a"}, 0) for i in range(60)], ITEMS)
    wanted = [(0, i) for i in range(3, 60, 3)]
    assert rows(copies.copies(items)) == wanted
    monkeypatch.setattr(copies, "BROADCAST_KEYS", 0)
    assert rows(copies.copies(items)) == wanted


def test_empty_table(spark):
    items = spark.createDataFrame([], ITEMS)
    assert copies.copies(items).count() == copies.collapsed(items).count() == nearcopies.near_pairs(items).count() == 0


def brute_pairs(data, threshold=0.6):
    import re

    def squash(x):
        return "".join(c for c in (x or "").lower() if c.isalnum())

    sets, keys = {}, {}
    for i, stem, choices, _ in data:
        members = set()
        for f in [stem, *(choices or {}).values()]:
            w = re.findall(r"[^\W_]+", (f or "").lower())
            members |= set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w)
        sets[i], keys[i] = members, (squash(stem), tuple(sorted(squash(x) for x in (choices or {}).values())))
    ids = sorted(sets)
    return [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if keys[a] != keys[b] and (u := len(sets[a] | sets[b])) and len(sets[a] & sets[b]) / u >= threshold]


def near_data():
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    data = []
    for i in range(0, 240, 4):
        stem = [rng.choice(words) for _ in range(rng.randint(3, 30))]
        for j in range(4):
            edited = list(stem)
            for _ in range(j * rng.randint(0, 2)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            data.append((i + j, " ".join(edited), {"A": rng.choice(words), "B": "the same choice"}, 0))
    data += [(900, None, {"A": "one"}, 0), (901, None, None, 0), (902, "", {"A": "One!"}, 0), (903, "word", {"A": "one"}, 0)]
    return data


def test_near_pairs_equal_brute_force(spark, monkeypatch):
    data = near_data()
    items = spark.createDataFrame(data, ITEMS)
    wanted = brute_pairs(data)
    assert len(wanted) > 50
    assert rows(nearcopies.near_pairs(items)) == wanted
    monkeypatch.setattr(nearcopies, "BLOCK", 16)  # hot buckets in several blocks
    monkeypatch.setattr(nearcopies, "SMALL", 4)
    monkeypatch.setattr(nearcopies, "TILE", 8)
    assert rows(nearcopies.near_pairs(items)) == wanted


def test_groups_keep_every_item_and_link(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h", None, 0), (2, "A b c d e f g h!", None, 0), (3, "a b c d e f g x", None, 0), (4, "other text", None, 0), (1, "a b c d e f g h", None, 0)], ITEMS)
    assert sorted((tuple(r) for r in nearcopies.near_groups(items).collect()), key=repr) == [(1, 1, 3), (2, 1, None), (3, 3, 1), (4, 4, None)]


def test_few_counters_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "COUNTERS", 4)
    monkeypatch.setattr(nearcopies, "BLOCK", 64)
    data = near_data()
    assert rows(nearcopies.near_pairs(spark.createDataFrame(data, ITEMS))) == brute_pairs(data)
