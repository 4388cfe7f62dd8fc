import re

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as T
from tallymark.operators import containment as C

PAGE = (
    "Harbour Robotics raised $15 million in a Series B round in March 2022, the company said on Monday. "
    "It was founded in 2017 by Ana Lim and employs 1,200 people in Bergen, Norway. Dr. Osei leads research. "
    "The firm sold 40% of its ferry unit for $3 billion and kept the rest of the business for now."
)
TEXTS = [PAGE, "", "Nothing here", "1,234.50 and 3.0% of 20 m² or 5k users, 7 Mn", "Series B, Class A and Yesterday I", "٤٢ and ２０２２"]


def words(t):
    return re.findall(r"[a-z0-9']+", t.lower())


def normal(n):
    return re.sub(r"\.0+$", "", n.replace(",", ""))


def test_scalars_agree_with_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.col("t")
    rows = df.select(t, T.words(t).alias("w"), T.ngrams(T.words(t), 3).alias("g"), T.numbers(t).alias("n"), T.quantities(t).alias("q"), T.letter_identifiers(t).alias("i")).collect()
    for r in rows:
        w = words(r.t)
        assert r.w == w
        assert set(r.g) == {" ".join(w[k : k + 3]) for k in range(len(w) - 2)}
        assert set(r.n) == {normal(x) for x in re.findall(r"\d+(?:[.,]\d+)*", r.t)}
        quantities = set()
        for m in re.finditer(r"(\d+(?:[.,]\d+)*)\s*(?:(%|[A-Za-z]+)\b|(%))", r.t):
            if (s := T.SCALES.get((m[2] or m[3]).lower())) is not None:
                quantities.add(f"{normal(m[1])} {s}")
        assert set(r.q) == quantities
    assert rows[4].i == ["Series B", "Class A"]


def tiers(spark, *claims, page=PAGE):
    c = C.claim_features(spark.createDataFrame([(k, c) for k, c in enumerate(claims)], "k int, claim string"))
    p = C.page_features(spark.createDataFrame([(page,)], "text string"))
    return sorted(C.with_tier(c.crossJoin(p)).select("k", "tier", "note", "quoted", "topical").collect())


@pytest.mark.parametrize(
    ("claim", "tier", "part"),
    [
        ("raised $15 million in a Series B round in March 2022", "verified", ""),
        ("raised $15.0 million in a Series B round in March 2022", "verified", ""),
        ("Harbour Robotics raised $15 billion in a Series B round", "unsupported", "15 billion"),
        ("Harbour Robotics raised $15 million in a Series C round", "unsupported", "Series C"),
        ("Harbour Robotics raised money led by Sequoia", "unsupported", "Sequoia"),
        ("It was founded in 2022 by Ana Lim", "low_match", "2022"),
        ("the people of the company kept selling ferry units", "low_match", "shares vocabulary"),
        ("penguins dislike marmalade", "unsupported", "not found"),
        (None, "unsupported", "not found"),
    ],
)
def test_tiers(spark, claim, tier, part):
    (r,) = tiers(spark, claim)
    assert r.tier == tier and part in r.note
    assert 0 <= r.quoted <= 1 and 0 <= r.topical <= 1


def test_thin_page_is_unverified(spark):
    (r,) = tiers(spark, "anything at all", page="too short")
    assert (r.tier, r.quoted, r.topical) == ("unverified", 0.0, 0.0)


def test_first_word_passes_and_possessive_differs(spark):
    a, b = tiers(spark, "Zanzibar was founded in 2017 by Ana Lim", "The people of Bergen's board")
    assert "Zanzibar" not in a.note
    assert b.tier == "unsupported" and "Bergen's" in b.note


def test_opener_and_title_in_later_sentence(spark):
    a, b = tiers(spark, "It employs people. Moreover Ana Lim leads.", "It employs people. Sequoia led the round.")
    assert "Moreover" not in a.note and "Sequoia" in b.note


def test_counts_are_whole_and_blocking(spark):
    df = spark.createDataFrame([("verified",), ("broken",), ("verified",)], "tier string")
    counts = C.tier_counts(df)
    assert {r.tier: r.n for r in counts.collect()} == dict.fromkeys(C.TIERS, 0) | {"verified": 2, "broken": 1}
    assert C.blocking_reason(counts).first().reason == "disqualifying"
    assert C.blocking_reason(C.tier_counts(df.where("tier = 'verified'"))).first().reason is None
    unchecked = C.tier_counts(spark.createDataFrame([("unverified",)], "tier string"))
    assert C.blocking_reason(unchecked, strict=True).first().reason == "unchecked"


def test_salience_agrees_with_drafts(spark):
    from tallymark.operators.drafts import salience

    texts = ['The port of Oslo may hold "900" crates', "nothing at all", "", "He said it. Oslo grew by 4%", "It's 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.salience(F.col("t")).alias("s"), T.salience_tags(F.col("t")).alias("g")).collect()
    assert [(r.s, r.g) for r in rows] == [salience(t) for t in texts]
