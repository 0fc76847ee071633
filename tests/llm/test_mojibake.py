from pyspark.sql import functions as F

from tallyloom.llm import mojibake

CLEAN = [
    "El agente explicó la cláusula con atención.", "La compañía no pagó según el contrato.", "L’assuré a évalué la perte à la pièce.", "Der Verlust wurde später geschätzt, müssen wir prüfen.",
    "Полис покрывает ущерб от пожара до суммы.", "The insurer’s share is ½ of £200 – “collapse” said the café.",
]


def garble(text, true, taken):
    return "".join(mojibake._table(taken)[b] for b in text.encode(true, "ignore"))


def test_learns_and_restores(spark):
    rows = [(i, CLEAN[i % 6]) for i in range(240)]
    broken = [
        (1000, garble(CLEAN[0], "utf-8", "cp1252"), CLEAN[0]), (1001, garble(CLEAN[1], "utf-8", "cp437"), CLEAN[1]), (1002, garble(CLEAN[2], "utf-8", "cp1252"), CLEAN[2]),
        (1003, garble(CLEAN[4], "utf-8", "cp1251"), CLEAN[4]), (1004, garble(CLEAN[5], "utf-8", "cp1252"), CLEAN[5]), (1005, garble(CLEAN[3], "cp1252", "cp850"), CLEAN[3]),
        (1006, garble(CLEAN[0], "cp1252", "cp850"), CLEAN[0]), (1007, garble(CLEAN[1], "utf-8", "cp1252"), CLEAN[1]), (1008, "explic� la cl�usula", None),
    ]
    rows += [(i, t) for i, t, _ in broken] + [(2000, None), (2001, ""), (2002, "plain"), (2003, "Søvick and Čelmere, naïve"), (1000, CLEAN[1])]
    documents = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, n_lost int, v int")
    assert {r.doc_id for r in mojibake.garbled(documents).collect()} == {i for i, _, _ in broken}
    restored = {r.doc_id: (r.text, r.n_lost) for r in mojibake.restored(documents).collect()}
    for i, _, original in broken:
        assert restored[i][0] == original if original else restored[i][1] == 2


def test_copies_of_a_garbled_text_count_once(spark):
    turned = [garble(CLEAN[3], "cp1252", "cp850"), garble(CLEAN[0], "cp1252", "cp850")]
    rows = [(i, f"{CLEAN[i % 6]} {i}") for i in range(240)] + [(1000 + i, turned[i % 2]) for i in range(120)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled(documents).collect()} == {1000 + i for i in range(120)}
    assert {r.text for r in mojibake.restored(documents).collect()} == {CLEAN[3], CLEAN[0]}


def test_every_run_of_a_place_is_a_partner(spark):
    often, rare = ["полис", "ущерб", "пожар", "сумма", "договор"], ["банк", "страхование", "выплата"]
    words = [w for w in often for _ in range(40)] + [w for w in rare for _ in range(10)]
    rows = [(i, f"{w} {i}") for i, w in enumerate(words)] + [(1000 + i, garble(w, "utf-8", "koi8-r")) for i, w in enumerate(rare)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = mojibake.runs(documents).withColumn("r", F.lit(" ")).groupBy("l", "run", "r").agg(F.count("*").alias("n"), F.count("*").alias("rows"))
    assert "utf-8>koi8-r" in mojibake.learned(counts, mojibake.twin_runs(documents))[0]


def test_chains_undo():
    chain = mojibake.Chain("utf-8", "cp1252", 2)
    twice = garble(garble("añadió ”", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert chain.undo(twice) == "añadió ”" and chain.undo("añadió") is None


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string")
    assert mojibake.garbled(documents).count() == mojibake.restored(documents).count() == 0


def test_one_clean_twin_each_is_enough(spark):
    clean = [
        "Der Käufer zahlt.", "Die Prämie für May.", "Ein Überfall in Bonn.", "Der Schaden an der Tür.", "Das Öl lief aus.", "Zwei Häuser brannten.", "Ein großer Verlust.", "Die Größe zählt.", "Vor dem März.", "Am Fluß gebaut.",
        "Jährlich gekündigt.", "Ein Brief aus Köln.", "Die Höhe fehlt.", "Nach Prüfung klar.", "Schön war es nie.", "Ein Äußeres zählt.",
    ]
    garbled = [t.encode("utf-8").decode("cp1252", "ignore") if all(c not in t for c in "ÜÖß") else t.encode("utf-8").decode("latin-1") for t in clean]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(garbled)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in mojibake.garbled(documents).collect()} == {100 + i for i in range(len(clean))}
    assert {r.doc_id: r.text for r in mojibake.restored(documents).collect()} == {100 + i: t for i, t in enumerate(clean)}
