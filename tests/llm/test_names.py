import pytest

from quernstone.llm import names as N

FIRMS = [
    ("A", "Ostrinfell Trust Company, Inc.", ["Ostro", "OTLTC", None]), ("B", "Skellofell National Bank LLC", None), ("C", "Skellofell Federal Credit Union, Ltd.", []), ("D", "Tarnovquay Financial Holdings, Inc", [" x "]),
    ("E", "Bank of Skelloworth & Co.", ["SEHB"]), ("F", None, None),
]


@pytest.fixture(scope="module")
def stars():
    return N.Stars(FIRMS)


@pytest.mark.parametrize(
    ("text", "own", "want"),
    [
        ("I paid through Ostrinfell Trust Company, Inc.. They said no", None, {"A"}),
        ("with ostrinfeil trst co, and OTSRINFELL", None, {"A"}),
        ("at Ostro today", None, {"A"}), ("at OTLTC today", None, {"A"}),
        ("at Skellofell Nat. Bnk in May", None, {"B"}), ("with Federal Credit Union, Skellofell", None, {"C"}), ("from Skellofell Fed. Cr. Un.", None, {"C"}),
        ("at Skellofell", None, set()), ("at Skellofell", "C", {"C"}),
        ("through TarnovquayFinancial!", None, {"D"}), ("at tarnovquay-financial", None, {"D"}), ("with Tarnovq uay Financial", None, {"D"}), ("Tarnov-quay's", None, {"D"}),
        ("Skelloworth Bank and the Bk of Skellowoath", None, {"E"}),
        ("the bank, the company, my wallet, XXXX", "A", set()), ("with Skellofell FCU", None, {"C"}), ("at skellofellnational bank", None, {"B"}), ("at Copperbellow Financial and the Bank of Ubberly", "A", set()),
        (None, None, set()), ("", None, set()),
    ],
)
def test_spellings(stars, text, own, want):
    found = [ids for _, ids, guess in stars.mentions(text) if not guess]
    assert {i for ids in found for i in (ids if len(ids) == 1 else {own} & {*ids})} == want


def test_distance_counts_exchanges_once():
    assert N.distance("abcd", "abdc", 2) == 1 and N.distance("abc", "abc", 0) == 0 and N.distance("abc", "xyz", 1) == 2 and N.distance("a", "abcd", 2) == 3


def test_one_slip_meets_with_the_stated_recall(stars):
    import random

    r, met, n = random.Random(4), 0, 0
    for core in stars.by_core:
        for _ in range(600):
            i = r.randrange(1, len(core) - 1)
            slip = r.choice([core[:i] + core[i + 1 :], core[:i] + "q" + core[i:], core[:i] + core[i + 1] + core[i] + core[i + 2 :]])
            n += 1
            met += any(set(stars.targets[t]) & stars.by_core[core] for t in stars.nearest(slip)[1])
    assert met / n >= N.RECALL - 0.001


def test_in_spark(spark):
    firms = spark.createDataFrame(FIRMS, "cid string, name string, aliases array<string>")
    df = spark.createDataFrame([("1", "at Ostro", None), ("2", None, "A"), ("3", "", None), (None, "at Skellofell", "B"), ("1", "at Ostro", None)], "id string, text string, own string")
    got = sorted((r["id"] or "", r["cid"]) for r in N.link(df, "id", "text", "own", firms, "cid", "name", "aliases").collect())
    assert got == [("", "B"), ("1", "A")]
    assert N.link(df.limit(0), "id", "text", "own", firms, "cid", "name", "aliases").count() == 0
    assert N.link(df, "id", "text", "own", firms.limit(0), "cid", "name", "aliases").count() == 0


def test_shared_spelling_goes_where_most_records_point(spark):
    firms = spark.createDataFrame(FIRMS, "cid string, name string, aliases array<string>")
    rows = [(f"b{i}", "at Skellofell", "B") for i in range(5)] + [("c", "at skellofell", "C"), ("x", "at Skellofell", "A"), ("y", "at Skelo", "C"), ("w", "with skelo", "C"), ("z", "at SKELO", "A")]
    df = spark.createDataFrame(rows, "id string, text string, own string")
    got = {(r["id"], r["cid"]) for r in N.link(df, "id", "text", "own", firms, "cid", "name", "aliases").collect()}
    assert got == {(f"b{i}", "B") for i in range(5)} | {("c", "B"), ("x", "B"), ("y", "C"), ("w", "C"), ("z", "C")}


@pytest.mark.parametrize("ending", ["", "ers", "kins", "quay", "y"])
def test_a_nickname_of_any_ending_is_learned_from_the_records(spark, ending):
    firms = spark.createDataFrame(FIRMS, "cid string, name string, aliases array<string>")
    nick = "Tarn" + ending
    rows = [(f"d{i}", f"they at {nick} lost it", "D") for i in range(4)] + [("o", f"the {nick.lower()} people", "A"), ("n", "the tarnished ring", "A"), ("m", "a tarnished coin", "D")]
    df = spark.createDataFrame(rows, "id string, text string, own string")
    df = df.unionAll(spark.range(200).selectExpr("concat('x', id)", "'nothing'", "'A'"))
    got = {(r["id"], r["cid"]) for r in N.link(df, "id", "text", "own", firms, "cid", "name", "aliases").collect()}
    assert got == {(f"d{i}", "D") for i in range(4)} | {("o", "D")}


def test_plain_initials_are_learned_from_the_records(spark):
    firms = spark.createDataFrame(FIRMS, "cid string, name string, aliases array<string>")
    rows = [(f"c{i}", "The SFCU says no", "C") for i in range(3)] + [("o", "my sister left SFCU", "A"), ("n", "the SFX team", "C"), ("once", "The SNB did", "B")]
    df = spark.createDataFrame(rows, "id string, text string, own string")
    df = df.unionAll(spark.range(200).selectExpr("concat('x', id)", "'nothing'", "'A'"))
    got = {(r["id"], r["cid"]) for r in N.link(df, "id", "text", "own", firms, "cid", "name", "aliases").collect()}
    assert got == {(f"c{i}", "C") for i in range(3)} | {("o", "C")}
