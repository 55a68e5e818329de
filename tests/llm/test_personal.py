import pytest

from quernstone.llm import personal as P

CASES = [
    ("Contact: jane.doe+x@mail.example now", [("email", "jane.doe+x@mail.example")]),
    ("forward the file to k_priya [at] web [dot] way [dot] test.", [("email", "k_priya [at] web [dot] way [dot] test")]),
    ("I signed up with leon at quick dot invalid years ago", [("email", "leon at quick dot invalid")]),
    ("Tweets to @helpdesk12 went unread.", []),
    ("I can be reached at +1(285)555.0134 after work", [("phone", "+1(285)555.0134")]),
    ("Ring me ((654) 555-0130) before noon. My cell is 555-0194", [("phone", "(654) 555-0130"), ("phone", "555-0194")]),
    ("I will not sign off on case number 8005554846. The receipt shows item 212-555-5131-X.", []),
    ("(ss# 985-39-5303). My license 363 963 894 B was scanned at the counter", [("identity_number", "985-39-5303"), ("identity_number", "363 963 894 B")]),
    ("The case carries number GL670501 under reference 4957-0237-87", []),
    ("I live at 95 E Thistle St. apt. 216, Oxmoor. The branch on Orrin Place has moved. The 12 Orchard Plan 66 was cancelled.", [("street_address", "95 E Thistle St.")]),
    ("I spoke with Bernice Aberickle who took notes. Grace at table 12 of it.", [("person_name", "Bernice Aberickle")]),
    ("I was told by Mr. O'Kadesko to wait. Signed: D. Braladze", [("person_name", "O'Kadesko"), ("person_name", "D. Braladze")]),
    ("I dealt with Svetlana Morozova there.", [("person_name", "Svetlana Morozova")]),
    ("I met Priyanka Chatterjee at the branch.", [("person_name", "Priyanka Chatterjee")]),
    ("Please ask for Bohdan Zelenko tomorrow. I emailed Wei-Ling Zhang twice.", [("person_name", "Bohdan Zelenko"), ("person_name", "Wei-Ling Zhang")]),
    ("I bought it at Green Valley. I paid from Elmwood Heights. I met with Harrow Lakeside Bank in May.", []),
    ("We moved from 87 Vesper Dr apt. 909 in the summer. Two men came to 8699 Vesper Dr asking for me.", [("street_address", "87 Vesper"), ("street_address", "8699 Vesper")]),
    ("My name is Tullombe, Ingrid. my son saw it. My mother never had this.", [("person_name", "Tullombe, Ingrid")]),
]


@pytest.fixture(scope="module")
def weights(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/complaints.parquet").select("complaint_id", "narrative")
    return P.train(P.propose(rows, "complaint_id", "narrative"))


@pytest.mark.parametrize(("text", "want"), CASES)
def test_details(weights, text, want):
    spans = P.candidates(text)
    keep = P.accepted([s.start for s in spans], [s.end for s in spans], [s.features for s in spans], weights)
    got = [(P.KINDS[spans[i].kind], spans[i].start) for i in keep]
    assert got == [(k, text.index(s)) for k, s in want]


def test_redaction_keeps_the_rest(weights):
    assert P.redacted("Cc jane@mail.example. I paid $5.", weights) == "Cc [EMAIL]. I paid $5."
    assert P.redacted(None, weights) is None and P.redacted("", weights) == "" and P.redacted("Nothing here.", weights) == "Nothing here."


def test_in_spark(spark, weights):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "Cc jane@mail.example."), ("c", "Cc jane@mail.example."), (None, "My cell is 555-0194")], "id string, text string")
    found, w = P.find(df, "id", "text")
    assert {r["start_pos"] for r in found.where("kind = 'email'").collect()} == {3} and found.where("kind = 'email'").count() == 2
    assert P.find(df.limit(0), "id", "text")[0].count() == 0
    assert [r["text"] for r in P.redact(df, "text", weights).orderBy("id").collect()][1:3] == [None, ""]


def test_reliabilities_tell_a_good_labeler_from_a_random_one():
    counts = {}
    for good, bad, n in ((2, 2, 40), (2, 0, 40), (0, 2, 40), (0, 0, 40)):  # votes of three labelers, two of which agree
        counts[good + 3 * good + 9 * bad] = n
    post, chance = P.reliabilities(counts, 3)
    assert post[2 + 6 + 18] > 0.9 and post[2 + 6] > 0.9 and post[0] < 0.1
    assert chance[1, 0, 2] > 0.8 > chance[1, 2, 2]


def test_long_text_and_positions_in_code_points(weights):
    text = "🙂 ß " * 5000 + "Cc jane@mail.example."
    spans = P.candidates(text)
    assert [(P.KINDS[s.kind], s.start) for s in spans] == [("email", text.index("jane"))]


def test_of_overlapping_spans_the_likelier_is_taken():
    weights = P.np.zeros(P.BUCKETS)
    weights[:4] = [1.0, 2.0, 0.5, -1.0]
    starts, ends = [0, 3, 10, 12, 20], [5, 8, 15, 13, 25]
    assert P.accepted(starts, ends, [[0], [1], [2], [1], [3]], weights) == [1, 3]
    assert P.accepted(starts, ends, [[0], [0], [2], [2], [3]], weights) == [0, 2]


def test_the_sample_that_reaches_the_driver_is_bounded_in_all(spark, monkeypatch):
    monkeypatch.setattr(P, "SAMPLE", 100)
    seen = []
    monkeypatch.setattr(P, "_fit", lambda features, y: seen.append(len(features)) or P.np.zeros(P.BUCKETS))
    letters = "char(97 + id % 26), char(97 + id div 26 % 26), char(97 + id div 676)"
    rows = spark.range(4000).selectExpr("id", f"concat({letters}, ': ann@mail.example ', {letters}) as text").repartition(8)
    P.train(P.propose(rows, "id", "text"))
    assert 60 <= seen[0] <= 150
