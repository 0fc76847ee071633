from tallyloom.llm import scans


def noise(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "rec_id bigint, text string, noise string")
    fields = scans.fields([("t", frame, "rec_id", "text")])
    found = {}
    for r in scans.noise(fields).collect():
        found.setdefault(r.rec_id, set()).add(r.noise)
    return found, {r.rec_id: r.text for r in scans.repaired(fields).collect()}


def test_kinds_of_noise_and_repair(spark):
    base = [
        "The insured received a certified request about the condominium modern policy.\nThe third-party administrator argued.",
        "The Harbor Manual\nThe tenant received the policy\nbefore renewal.",
        "THE HARBOR MANUAL\nThe tenant received the policy\nbefore renewal.",
        "~ the harbor manual ~\nThe tenant received the policy\nbefore renewal.",
    ] * 12
    odd = [
        "The insured rec-\neived a certified request.",
        "The third-\nparty administrator argued.",
        "The insured received\nPage 12\na request.",
        "17   THE HARBOR MANUAL\nThe tenant received the policy.",
        "The tenaut received the policy.",
        "The p0licy of the tcnant",
        "The condorninium poli¢y\nof the ﬁnder",
        "The Harbor Manual",
        "The insured re¬\n\n[44]\n\nceived the policy.",
    ]
    found, repaired = noise(spark, [*base, *odd, "", None, "x" * 50_000, "- 5 -"])
    n = len(base)
    assert all(i not in found for i in range(0, n, 4)) and all(found[i] == {"header"} for i in range(n) if i % 4)
    assert {i - n: v for i, v in found.items() if i >= n} == {
        0: {"hyphen"}, 2: {"page_number"}, 3: {"header", "page_number"}, 5: {"glyph"}, 6: {"glyph"}, 8: {"hyphen", "page_number"}, 12: {"page_number"},
    }
    assert repaired[n] == "The insured received a certified request."
    assert repaired[n + 1] == "The third-party administrator argued."
    assert repaired[n + 2] == "The insured received a request."
    assert repaired[n + 5] == "The policy of the tenant"
    assert repaired[n + 8] == "The insured received the policy."


def test_copies_of_a_misread_field_count_once(spark):
    base = [f"The tenant received the certified policy number {chr(97 + i // 26)}{chr(97 + i % 26)}z before renewal." for i in range(60)]
    found, repaired = noise(spark, base + ["The tcnant received the policy."] * 30)
    assert found == {60 + i: {"glyph"} for i in range(30)}
    assert {repaired[60 + i] for i in range(30)} == {"The tenant received the policy."}


def test_a_running_header_needs_no_second_style(spark):
    pages = [f"The Harbor Manual\nThe tenant received the {w} policy\nbefore renewal." for w in ("certified", "modern", "valued", "lapsed") for _ in range(50)]
    found, repaired = noise(spark, pages + [f"The tenant of {x} paid\nthe second premium." for x in ("Salcott", "Pelbury") for _ in range(20)])
    assert {i for i, v in found.items() if v == {"header"}} == set(range(200)) and set(found) == set(range(200))
    assert repaired[0] == "The tenant received the certified policy before renewal."


def test_repairs_keep_other_words_and_case(spark):
    base = [f"The tenant saw the stone and the binder of number {chr(97 + i // 26)}{chr(97 + i % 26)}z before the renewal." for i in range(60)]
    found, repaired = noise(spark, [*base, "Near tbestone tbe tenant saw TBE stone. Tbe binder"])
    assert found[60] == {"glyph"} and repaired[60] == "Near tbestone the tenant saw THE stone. The binder"


def test_distance():
    assert scans.distance("narned", "named") < 0.5 and scans.distance("uncler", "under") < 0.5
    assert scans.distance("barn", "bark") >= 1 and scans.distance("same", "same") == 0


def test_empty_and_repeated(spark):
    frame = spark.createDataFrame([], "rec_id bigint, text string")
    assert scans.noise(scans.fields([("t", frame, "rec_id", "text")])).count() == 0
    twice = spark.createDataFrame([(1, "a\n[3]\nb"), (1, "a\n[3]\nb"), (1, "other")], "rec_id bigint, text string")
    got = scans.fields([("t", twice, "rec_id", "text")])
    assert [r.noise for r in scans.noise(got).collect()] == ["page_number"]
    assert sorted(r.text for r in scans.repaired(got).collect()) == ["a b", "other"]
