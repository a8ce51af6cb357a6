import pytest

from rankweave.operators import merging
from rankweave.operators.matching import VenueIndex, cross_type

from .helpers import venue, venues


@pytest.fixture(scope="module")
def base(spark):
    return venues(
        spark, venue(0, "c1", "Alpha Conference on Testing", "conference", aliases=["Alpha Conf", "alpha conf."], acronyms=["A. C. T."]),
        venue(1, "j1", "Beta Journal"), venue(2, "j2", "Gamma", acronyms=["ACT", "foobar"]), venue(3, "j3", "Delta", aliases=["Beta Journal"]),
    )


def match(spark, base, *rows):
    df = spark.createDataFrame([(k, c, t) for k, (c, t) in enumerate(rows)], "k int, candidate string, cut boolean")
    return [r.match for r in VenueIndex(base).match(df, truncated="cut").orderBy("k").collect()]


def test_outcomes(spark, base):
    got = match(spark, base, ("ALPHA conference on testing!", False), ("alpha  conf", None), ("act", False), ("A.C.T", False), ("foobar", False), ("foo bar", False),
                (None, False), (" .", True), ("Gamma", True), ("Gamma 2026", False), ("Beta Journal", False))
    assert [(m.status, m.reason, m.matched_by, m.confidence, m.venue_id) for m in got] == [
        ("matched", None, "canonicalName", "high", "c1"), ("matched", None, "alias", "high", "c1"), ("ambiguous", "key-conflict", None, None, None),
        ("ambiguous", "key-conflict", None, None, None), ("matched", None, "acronym", "medium", "j2"), ("unmatched", "no-exact-match", None, None, None),
        ("unmatched", "missing-candidate", None, None, None), ("unmatched", "missing-candidate", None, None, None), ("unmatched", "truncated-source", None, None, None),
        ("unmatched", "no-exact-match", None, None, None), ("ambiguous", "key-conflict", None, None, None)]
    assert got[2].candidates == ["c1", "j2"] and got[10].candidates == ["j1", "j3"] and got[1].matched_value == "Alpha Conf"


def test_conflicts(spark, base):
    index = VenueIndex(base)
    got = {(r.namespace, r.key): r.ids for r in index.conflicts().collect()}
    assert got == {("acronym", "act"): ["c1", "j2"], ("name", "beta journal"): ["j1", "j3"]}
    crossed = venues(spark, venue(0, "a", "XYZ"), venue(1, "b", "Other", "conference", acronyms=["X.Y.Z"]), venue(2, "c", "Third", "conference", acronyms=["xyz"]))
    rows = {(r.namespace, r.key): r.ids for r in VenueIndex(crossed).conflicts().collect()}
    assert rows[("cross", "xyz")] == ["a", "b", "c"]
    told = {r.namespace: r.all_types_differ for r in cross_type(VenueIndex(crossed).conflicts(), crossed).collect()}
    assert told["cross"] is False


def test_ids_are_checked(spark):
    with pytest.raises(ValueError, match="Duplicate venue id: a"):
        VenueIndex(venues(spark, venue(0, "a", "X"), venue(1, " a ", "Y")))
    with pytest.raises(ValueError, match="must not be empty"):
        VenueIndex(venues(spark, venue(0, " ", "X")))


def test_probe_side_is_not_shuffled(spark, base):
    df = spark.createDataFrame([("x",)], "candidate string")
    plan = VenueIndex(base).match(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


def test_told_outcomes_are_those_of_match(spark, base):
    texts = ["ALPHA conference on testing!", "alpha  conf", "act", "A.C.T", "foobar", "foo bar", None, " .", "Gamma", "Gamma 2026", "Beta Journal", "none"]
    df = spark.createDataFrame([(k, c, k == 8) for k, c in enumerate(texts)], "k int, candidate string, cut boolean")
    index = VenueIndex(base)
    matched = {r.k: r.match.asDict() for r in index.match(df, truncated="cut").collect()}
    told = index.tell(df, truncated="cut")
    for r in told.collect():
        want = matched[r.k]
        assert {c: v for c, v in r.match.asDict().items() if c != "acronym"} == {c: v for c, v in want.items() if c != "candidates"}
    owners = {}
    for r in index.owners_of(told, "k").collect():
        owners.setdefault(r.k, []).append(r.venue_id)
    assert {k: sorted(v) for k, v in owners.items()} == {k: m["candidates"] for k, m in matched.items() if m["candidates"]}


def test_a_key_of_very_many_venues_makes_no_list(spark):
    many = spark.range(50_000).selectExpr("concat('v', id) as id", "'journal' as type", "if(id < 40000, 'Common Name', concat('Own ', id)) as canonical_name",
                                          "cast(array() as array<string>) as aliases", "cast(null as array<string>) as acronyms", "cast(id as int) as pos")
    index = VenueIndex(many, checked=False)
    told = index.tell(spark.createDataFrame([(1, "common name"), (2, "own 45000"), (3, "x")], "k int, candidate string"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan and plan.count("BroadcastHashJoin") == 2
    assert {r.k: (r.match.status, r.match.venue_id) for r in told.collect()} == {1: ("ambiguous", None), 2: ("matched", "v45000"), 3: ("unmatched", None)}
    assert index.owners_of(told, "k").count() == 40_000


def test_conflicts_of_one_name_stay_rows(spark):
    """Plans of conflicts have no list of a key's owners in a row of each owner."""
    made = lambda n: spark.range(n).selectExpr("concat('p', id) as id", "if(id % 2 = 0, 'journal', 'conference') as type", "'One name' as canonical_name", "cast(array() as array<string>) as aliases",
                                               "if(id = 0, array('one name'), null) as acronyms", "cast(id as int) as pos")
    new = merging.new_conflicts(made(3000), made(2999))
    assert {(r.namespace, r.n, r.all_types_differ) for r in new.collect()} == {("name", 3000, False), ("cross", 3000, False)}
    assert "collect_set" not in new._jdf.queryExecution().optimizedPlan().toString()
    assert merging.new_conflicts(made(50), made(50)).isEmpty() and merging.new_conflicts(made(2), made(3)).where("all_types_differ").count() == 2
    told = cross_type(VenueIndex(made(40)).conflicts(), made(40))
    assert {(r.namespace, len(r.ids), r.all_types_differ) for r in told.collect()} == {("name", 40, False), ("cross", 40, False)}
