import pytest
from pyspark.sql import functions as F

from weftline.llm import consensus, names

ACTORS = [
    (1, "NZRU", "Northern Zabumatonese Renewal Union", "x"), (2, "TSG", "Tasmeri Salvation Guard", None), (3, "WDNLA", "Western Drogivogori National Liberation Army", "x"),
    (4, None, "Southern Zabumatonese Renewal Union", "x"), (5, "RPF", "Revolutionary Wexuban Popular Front", "x"), (6, "X", None, "x"), (None, "Y", "Nobody's Own Front", "x"), (7, None, None, None),
]
CASES = {
    "Northern Zabumatonese Renewal Union": 1, "NORTHERN  ZABUMATONESE_RENEWAL/UNION .": 1, "N.Z.R.U.": 1, "nzru": 1, "the Northern Zabumatonese Renewal Union (NZRU)": 1,
    "Guard for the Salvation of the Tasmeri": 2, "Tasmeri Salwation Guard rebels": 2, "TASMERI SALVATI0N GUARD": 2, "West. Drogivogori Natl. Lib. Army": 3, "Drogivogori National Liberation Army": 3,
    "Eastern Zabumatonese Renewal Union": -1, "Zabumatonese Renewal Union": -1, "Tasmeri police": -1, "army": -1, "Rev. Wexuban Popular Front aka RPF": 5, "Rénéwal Üníon Zabumatonese Southern": 4,
    "Tasmeri Unity Guard": -1, "\tTasmeri  Salvation Guard ": 2, "x" * 5000: -1,
}


def test_names(spark):
    actors = spark.createDataFrame(ACTORS, "actorid long, namedata string, nameorigfulleng string, actor_location string")
    typed = spark.createDataFrame([(n,) for n in CASES] * 2 + [(None,), (" ",), ("",)], "entered_name string")
    for block in (100_000, 3):
        got = [tuple(r) for r in names.map_names(typed, actors, block).collect()]
        assert len(got) == len(CASES) and dict(got) == CASES, {k: v for k, v in dict(got).items() if CASES[k] != v}
    assert {r[1] for r in names.map_names(typed, actors.limit(0)).collect()} == {-1}
    assert names.map_names(typed.limit(0), actors).count() == 0


def test_blocks_change_no_answer(spark, folder):
    from weftline.session import table

    actors, articles = table(spark, folder, "actor"), table(spark, folder, "articles_raw")
    typed = articles.select(F.explode(F.array("actor1name", "actor2name")).alias("n")).distinct()
    one, six = ({r[0]: r[1] for r in names.map_names(typed, actors, block).collect()} for block in (100_000, 100))
    assert one == six and len({v for v in one.values()}) > 50


def test_many_ambiguous_words_end():
    matcher = names.Matcher([(1, "Alta Balta Calta", None)])
    assert matcher.match(["x"] * 1 + [f"y{i}" for i in range(60)], [[("alta", 1.0), ("balta", 1.0), ("calta", 1.0)]] * 61) == (99.0, set())


@pytest.mark.parametrize("a,b,n", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abcd", "xbyd", 2), ("abc", "xyz", 3)])
def test_slips(a, b, n):
    assert names.slips(a, b, 2) == n


COLUMNS = "globaleventid long, coding_round int, coder_1_id string, coder_2_id string, any_fatalities_mentioned_coder_1 string, any_fatalities_mentioned_coder_2 string, any_physical_violence_mentioned_coder_1 string, any_physical_violence_mentioned_coder_2 string, answer string"



def test_all_words_as_near_are_kept():
    """A typed word that is one slip from six words of the list may stand for any of them; the rest of the name tells which."""
    ends = "bcdfgh"
    counts = [(f"mar{c}", 1, False) for c in ends] + [(w, 1, False) for w in ("north", "south", "east", "west", "upper", "lower")]
    known = names.Words(counts).look("marz")
    assert [w for w, _ in names.readings("marz", known)] == [f"mar{c}" for c in ends]
    matcher = names.Matcher([(i, f"{side} mar{c}", None) for i, (c, side) in enumerate(zip(ends, ("north", "south", "east", "west", "upper", "lower")))])
    read = [names.readings(t, names.Words(counts).look(t)) for t in ("lower", "marz")]
    assert matcher.match(["lower", "marz"], read) == (1.0, {5})
    word = lambda i, j: f"v{chr(97 + i)}{chr(97 + j)}k"
    many = [[(word(i, j), 1.0) for j in range(20)] for i in range(8)]
    big = names.Matcher([(1, " ".join(word(i, 19 - i) for i in range(8)), None)])
    assert big.match([f"t{chr(97 + i)}x" for i in range(8)], many) == (8.0, {1})


def made(n=400):
    import random

    rng = random.Random(4)
    truth, rows = {}, []
    noise = {"good1": 0.9, "good2": 0.9, "fair": 0.75, "yes": None, "turned": 0.1}
    for i in range(n):
        truth[i] = rng.choice(["yes", "no", "no", "yes", "unclear"])
        for r in range(1, 4):
            pair = rng.sample(sorted(noise), 2)
            say = [("yes" if c == "yes" else truth[i] if rng.random() < noise[c] else rng.choice(["yes", "no", "unclear"]) if c != "turned" else {"yes": "no", "no": "yes", "unclear": "unclear"}[truth[i]]) for c in pair]
            forms = [rng.choice([s, s.upper() + " ", s[0]]) if s != "unclear" else rng.choice(["?", "Unclear"]) for s in say]
            rows += [(i, r, pair[0], pair[1], *forms, None, "no", "clash")] * rng.choice([1, 1, 2])
    return truth, rows


def test_consensus_finds_turned_coders(spark, monkeypatch):
    truth, rows = made()
    df = spark.createDataFrame(rows + [(None, 1, "a", "b", "yes", "no", "yes", "no", None), (9999, 1, None, "", "yes", "yes", "yes", "yes", None)], COLUMNS)
    ballots, model = consensus.fit(df)
    got = {(r.globaleventid, r.field_name): r for r in consensus.consensus(ballots, model).collect()}
    hits = [got[i, "any_fatalities_mentioned"].answer == v for i, v in truth.items()]
    assert sum(hits) / len(hits) > 0.9
    assert all(got[i, "any_physical_violence_mentioned"].answer == "no" for i in truth) and (9999, "any_fatalities_mentioned") not in got
    assert got[0, "any_fatalities_mentioned"].n_votes <= 6 and 0 <= got[0, "any_fatalities_mentioned"].pair_agreement <= 1
    monkeypatch.setattr(consensus, "MAP_ROWS", 0)
    again = {(r.globaleventid, r.field_name): r.answer for r in consensus.consensus(*consensus.fit(df)).collect()}
    assert again == {k: r.answer for k, r in got.items()}
    rate = {r.coder_id: r.accuracy for r in consensus.coder_reliability(model).where("field_name = 'any_fatalities_mentioned'").collect()}
    assert rate["good1"] > 0.8 > 0.5 > rate["turned"] and rate["yes"] < 0.6


def test_votes_of_two_rounds_are_left_out_together(spark):
    # The same coder twice on every article, against one other: their own second vote must not speak for them.
    rows = [(i, r, "twice", "other", "yes", "no", None, None, None) for i in range(30) for r in (1, 2)]
    rows += [(i, 3, "other", "third", "no", "no", None, None, None) for i in range(30)]
    ballots, model = consensus.fit(spark.createDataFrame(rows, COLUMNS))
    rate = {r.coder_id: (r.n_votes, r.accuracy) for r in consensus.coder_reliability(model).collect()}
    assert rate["twice"][0] == 60 and rate["other"][0] == 90 and rate["third"][1] > rate["twice"][1]
    assert {r.answer for r in consensus.consensus(ballots, model).collect()} == {"no"} and consensus.consensus(ballots, model).first().n_votes == 6
    with pytest.raises(RuntimeError):
        consensus.fit(spark.createDataFrame(rows, COLUMNS), most_rounds=1, tolerance=0.0)


def test_consensus_of_nothing_and_agreement(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert consensus.consensus(*consensus.fit(empty)).count() == 0 and consensus.field_agreement(consensus.votes(empty)).count() == 0
    same = spark.createDataFrame([(i, 1, "a", "b", v, v, None, None, None) for i, v in enumerate(["yes", "no"] * 5)], COLUMNS)
    assert consensus.field_agreement(consensus.votes(same)).first().alpha == pytest.approx(1.0)
    assert consensus.votes(same).select(F.count_distinct("globaleventid")).first()[0] == 10
