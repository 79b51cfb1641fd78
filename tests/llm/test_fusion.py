"""Surviving records, place names, spelling variants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import canon, names, survivors

LISTING = "ord long, source string, org_name string, opportunity_title string, description_short string, description_long string, last_scraped string, schedule struct<raw: string>, name string, gid int"
RANKS = "source string, trust_rank long, label string"


def fused(spark, rows, ranks=((" Curated", 0, None), ("feed", 3, None))):
    df = spark.createDataFrame([(o, s, "Org", "T", d, None, at, (raw,), "clash", 1) for o, s, d, at, raw in rows], LISTING)
    got = survivors.fuse(df, spark.createDataFrame(list(ranks), RANKS)).collect()
    return {r["group_key"]: (r["source_key"], r["scraped_key"], r["schedule_key"]) for r in got}


def test_each_field_gets_its_best_row(spark):
    rows = [
        (1, "feed", "d", "2026-01-03T00:00:00Z", "Mondays"), (2, "CURATED ", " D ", "2026-01-01", "TBD"), (3, None, "d", "1767484800", "9:30 AM"),  # 2026-01-04
        (4, "curated", "d", "Jan 02, 2026 00:00 UTC", None), (5, "who", "d", "unknown", "varies"), (6, "feed", "other", None, "Mondays"),
    ]
    assert fused(spark, rows) == {1: (4, 3, 3)}


def test_ties_nulls_and_nothing_said(spark):
    assert fused(spark, [(1, None, "d", None, None), (2, None, "d", None, "N/A"), (3, None, None, None, None)]) == {1: (1, 1, -1)}
    assert fused(spark, [(9, "feed", None, "2026-01-01", "Fri"), (4, "feed", "", "2026-01-01T00:00:00+00:00", "Fri")]) == {4: (4, 4, 4)}
    assert fused(spark, []) == {}
    assert fused(spark, [(1, "a", "d", None, None), (2, "b", "d", None, None)], ()) == {1: (1, 1, -1)}


@pytest.mark.parametrize(("typed", "micros"), [("1970-01-02", 86_400_000_000), ("1970-01-01 01:00", 3_600_000_000), ("1970-01-01T00:00:00,5+0030", -1_799_500_000), ("January 1, 1970 00:01", 60_000_000), ("Jan 1, 1970 00:01 UTC", 60_000_000), ("1.5", 1_500_000), ("soon", None), ("2026-13-40", None), (" ", None)])
def test_instants(spark, typed, micros):
    assert spark.createDataFrame([(typed,)], "v string").select(survivors.instant(F.col("v")).alias("r")).first()["r"] == micros


@pytest.mark.parametrize(("raw", "says"), [("Saturdays", True), ("starts May 03, 2026", True), ("2026-02-08 17:00", True), ("7 PM", True), ("3/14", True), ("Flexible", False), ("May be arranged", False), ("Schedule: ", False), ("See organizer's page", False), ("", False)])
def test_what_names_a_time(spark, raw, says):
    assert spark.createDataFrame([(raw,)], "v string").select(F.col("v").rlike(survivors.NAMES_TIME).alias("r")).first()["r"] is says


def test_copied_votes_are_discounted():
    """Sources 1 and 2 share false values; 0 and 3 are right alone. Without copy detection two copies would win."""
    patterns = {((0, 1), (3, 1)): 60, ((0, 1), (1, 1), (2, 1), (3, 1)): 60, ((0, 1), (1, 2), (2, 2), (3, 1)): 40, ((0, 1), (1, 2), (2, 2)): 10}
    accuracy, depend, posterior = survivors.estimate(patterns)
    assert accuracy[0] > 0.9 > accuracy[1]
    assert depend[1, 2] > 0.9 and depend.get((0, 1), 0) < depend[1, 2]
    post = posterior[(0, 1), (1, 2), (2, 2)]
    assert post[1] > post[2]
    assert sum(post.values()) <= 1 + 1e-9


def test_posteriors_come_with_the_groups(spark):
    df = spark.createDataFrame([(o, s, "Org", f"T{o // 10}", "d", None, "2026-01-01", (raw,), None, None) for o, s, raw in [(1, "curated", "Mon 9:00"), (2, "feed", "mon  9:00"), (3, "x", "Tue"), (11, "feed", None), (12, "feed", None)]], LISTING)
    got = {r["group_key"]: (r["schedule"], r["claims"]) for r in survivors.fuse(df, spark.createDataFrame([("curated", 0, None), ("feed", 1, None)], RANKS)).collect()}
    assert got == {1: ("mon 9:00", 3), 11: (None, None)}



@pytest.mark.parametrize("ranked", [0, 9])
def test_every_source_has_an_accuracy_of_its_own(spark, ranked):
    """Two sources, unlisted or beyond the seven most trusted ones: one always agrees with two others, one never does. Where
    only these two speak, the first must win."""
    ranks = [(f"rank{i}", i, None) for i in range(ranked - 2)] + ([("good", 7, None), ("bad", 8, None)] if ranked else [("x", 0, None)])
    says = [(g, s, raw) for g in range(30) for s, raw in (("curated", "Mon 9:00"), ("feed", "Mon 9:00"), ("good", "Mon 9:00"), ("bad", f"Fri {g % 12}:00"))] + [(30, "good", "Tue"), (30, "bad", "Fri")]
    df = spark.createDataFrame([(i, s, "Org", f"T{g}", "d", None, "2026-01-01", (raw,), None, None) for i, (g, s, raw) in enumerate(says)], LISTING)
    last = survivors.fuse(df, spark.createDataFrame(ranks, RANKS)).where("group_key = 120").first()
    assert last["schedule"] == "tue" and last["schedule_p"] > 0.9 and last["source"] == "good"


GAZ = [(1, "Sorvery"), (2, "Lake Ulbombe"), (3, "Zimrery"), (4, "Zimrery Hills"), (5, "North Zimrery Hills"), (6, "Fort Haskith"), (7, "Quorvingo Springs"), (8, "Sorvery"), (9, None), (10, " ")]
TOWNS = [
    ("Sorvery", None, 1), ("sorvery tx 00934", None, 1), ("Sorvmerzy", None, -1), ("Sorvry", None, 1), ("Sorveery", None, 1), ("Sovrery", None, 1), ("Qurvingo Springs", None, 7), ("Zmirery", None, 3), ("Lk. Ulbombe", None, 2), ("Zimrery Hills (TX)", None, 4), ("N. Zimrery Hls", None, 5),
    ("281 Gristmill RdSorvery", None, 1), ("Near Ft Haskith", None, 6), ("City of Sorvery", "1 A St, Zimrery, TX, 00001", 1), ("Zimrery & nearby towns", None, 3), ("East Zimrery", None, 3), ("Quorvingo Sprgs", None, 7), ("Sórvery area", None, 1),
    ("McSorvery", "1 A St, Sorvery, TX, 00001", -1), ("Sorveryburg", None, -1), ("Ulbombe", None, -1), ("Haskith Grove", None, -1),
    ("Virtual", "8 Zimrery St, Sorvery, TX, 00934", 1), (None, "The Depot, 5 Hop St, Zimrery Hills TX 00001", 4), ("TBD", "Zimrery - Rookery Hall", 3), ("N/A", "Rookery Hall\n6406 Tenmile Dr\nSorvery, TX 00794", 1), ("-", "9 SORVERY AVE, LAKE ULBOMBE", 2),
    ("Online", "Sundial Library, Room 4", -1), (" ", "Address shared after sign-up", -1), ("00417", None, -1), ("Nowhere", "1 A St, Sorvery, TX, 00001", -1), ("Sorvery " * 3000, None, -1),
]


def test_towns(spark):
    rows = spark.createDataFrame([(i, c, f, "x") for i, (c, f, _) in enumerate(TOWNS)] + [(900, None, None, None), (901, " ", "", None), (902, "Sorvery", None, None), (902, "Sorvery", None, None)], "ord long, c string, f string, asked string")
    gaz = spark.createDataFrame(GAZ, "id long, name string")
    got = canon.match_places(rows, "ord", F.col("c"), F.col("f"), gaz)
    found = [(r["key"], r["id"]) for r in got.collect()]
    assert sorted(x for x in found if x[0] < 900) == [(i, t) for i, (_, _, t) in enumerate(TOWNS)]
    assert sorted(x for x in found if x[0] >= 900) == [(902, 1), (902, 1)]
    assert {r["id"] for r in canon.match_places(rows, "ord", F.col("c"), F.col("f"), gaz.limit(0)).collect()} == {-1}


def test_slips():
    assert [canon.slips(*x) for x in (("abcd", "abcd"), ("abcd", "acbd"), ("abcd", "abd"), ("abcd", "abbcd"), ("abcd", "xbcz"), ("", "ab"), ("ca", "abc"), ("junction", "junicon"))] == [0, 1, 1, 1, 2, 2, 2, 2]


SAME = [
    ["Bosmilek Rokbonud Community Volunteer Center", "bosmilek rokbonud community volunteer center ", "Bosmilek  Rokbonud Cmty Vol. Ctr.", "The Bosmilek Rokbonud Community Volunteer Center, Inc.", "Bosmilek Rokbonud CVC", "Bosmilek Rokobnud Community Volunteer Center", "BRCVC – Bosmilek Rokbonud Community Volunteer Center", "Community Volunteer Center, Bosmilek Rokbonud", "BosmilekRokbonud Community Volunteer Center", "Bosmilek Rokbonud Community Volunteer Center | Sign-Up Hub"],
    ["Dorothy Birlitat-Rokluvin Scholarship Society", "D. Birlitat-Rokluvin Scholarship Society", "Birlitat-Rokluvin, Dorothy Scholarship Society", "Scholarship Society of Dorothy Birlitat-Rokluvin", "Dot Birlitat Rokluvin Schol. Soc", "Dörothy Birlitat-Rokluvin Scholarship Society (DBRSS)"],
    ["William Birlitat-Rokluvin Scholarship Society", "Bill Birlitat-Rokluvin Scholarship Society"],
    ["Farkigok Runcirid Legal Aid Society", "Legal Aid Society - Farkigok Runcirid", "Farkigok Runcirid LAS"],
    ["Farkigok Runcirid Literacy Center", "Farkigok Runcirid LC", "Farkigok Runcirid Literacy Center (TX)"],
    ["Gokvufim Sattewak Youth Troop 825", "Gokvufim Sattewak YT 825"],
    ["Gokvufim Sattewak Youth Troop 852"],
    ["???"],
]


def test_spellings(spark):
    rows = [(n, i) for i, group in enumerate(SAME) for n in group for _ in range(3 if n == group[0] else 1)] + [(None, 0), ("  ", 0)]
    got = set(map(tuple, names.variants(spark.createDataFrame(rows, "org_name string, token int"), "org_name").collect()))
    assert got == {(a, b) for group in SAME for a in group for b in group if a < b}


def test_no_spellings(spark):
    df = spark.createDataFrame([(None,), ("",)], "org_name string")
    assert names.variants(df, "org_name").count() == 0
    assert names.variants(df.limit(0), "org_name").count() == 0


def test_misspelt_words_of_many_forms(spark):
    """A misspelling that more data repeats is still read as the word it stands for."""
    rng = random.Random(1)
    names_ = [f"{''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=10))} Food Pantry" for _ in range(80)]
    typed = [n.title().replace("Pantry", "Pantyr") for n in names_[::27]]
    rows = [(n.title(),) for n in names_] + [(n,) for n in typed]
    assert len(typed) == 3
    got = set(map(tuple, names.variants(spark.createDataFrame(rows, "org_name string"), "org_name").collect()))
    assert got == {(n.replace("Pantyr", "Pantry"), n) for n in typed}


def test_a_hot_body_keeps_its_name_as_key(spark):
    """Whatever the share of the forms that a body's name is in."""
    rng = random.Random(2)
    rest = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) + " Food Pantry" for _ in range(5000)]
    purposes = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(80)]
    rows = [*rest, *[f"Bosmilek Rokbonud {p} Volunteers" for p in purposes], "Bosmilek Rokbonud Community Volunteer Center", "Bosmilek Rokbonud CVC", "Bosmilek Rokbonud Cmnty Volunteer Center"]
    got = names.entities(spark.createDataFrame([(n,) for n in rows], "org_name string"), "org_name").where("name like 'Bosmilek%C%'")
    found = {r["name"]: r["entity"] for r in got.collect()}
    assert len({found[n] for n in rows[-3:]}) == 1
    assert sum(e == found[rows[-1]] for e in found.values()) == 3


def linked(spark, rows):
    return set(map(tuple, names.variants(spark.createDataFrame([(n,) for n in rows], "org_name string"), "org_name").collect()))


def test_a_slip_in_many_forms(spark):
    """A slip counts by its context, however many forms have it; names that differ by a letter elsewhere too stay apart."""
    wexmor = [(f"Wexmoor {p}", f"Wexmor {p}") for p in ("Food Bank", "Food Pantry", "Animal Shelter", "Arts Council", "Literacy Center")]
    apart = [f"Hansatol {p}" for p in ("Youth Choir", "Book Fair", "Tree Watch")] + [f"Hansatal {p}" for p in ("Boat Crew", "Chess Club", "Youth Choir")]
    assert linked(spark, [n for pair in wexmor for n in pair] + apart) == set(wexmor)


def test_meetings_against_all_pairs(spark, monkeypatch):
    """Prefixes lose no pair that agrees; nor does dealing out crowded meetings."""
    rng = random.Random(3)
    syllables = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lnrst"]
    word = lambda n: "".join(rng.choices(syllables, k=n)).title()
    firsts = [word(3) for _ in range(12)]
    rows = set()
    for _ in range(60):
        full = f"{rng.choice(firsts)} {word(3)} {rng.choice(['Food Bank', 'Food Pantry', 'Community Volunteer Center', 'Arts Council'])}"
        rows.add(full)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(1, len(full) - 1)
            rows.add(rng.choice([full[:at] + full[at + 1 :], full[:at] + rng.choice("aeiou") + full[at:], full.replace("Community Volunteer Center", "CVC"), full.upper()]))
    rows = sorted(rows)
    forms = {n: names.Form(i, names.tokens_of(n), [1.0] * len(names.tokens_of(n)), 1) for i, n in enumerate(rows)}
    usual = linked(spark, rows)
    direct = {(a, b) for a in rows for b in rows if a < b and (r := names.agree(forms[a], forms[b])) is not None and not r[2] and not r[3]}
    assert direct <= usual and len(usual) > 50
    monkeypatch.setattr(names, "SPLIT", 3)
    assert linked(spark, rows) == usual


def test_bigrams_find_all_slips():
    rng = random.Random(4)
    for _ in range(3000):
        t = "".join(rng.choices("abcdefgh", k=rng.randrange(4, 14)))
        u = list(t)
        for _ in range(1 if len(t) < 8 else 2):
            at = rng.randrange(len(u) - 1)
            u[at : at + 2] = rng.choice([[u[at + 1], u[at]], [u[at]], ["x", u[at + 1]], [u[at], "y", u[at + 1]]])
        u = "".join(u)
        if u != t and names.near(t, u) is not None:
            assert set(names.signatures(t, {})) & set(names.signatures(u, {})), (t, u)


def test_names_of_common_words_only(spark):
    same = ["Volunteer Community Center", "Volunteer Cmnty Center", "Center, Volunteer Community"]
    rows = [(n,) for n in [*same, "Food Fund", "Food Foundation"]]
    got = set(map(tuple, names.variants(spark.createDataFrame(rows, "org_name string"), "org_name").collect()))
    assert got == {(a, b) for a in same for b in same if a < b}


def test_every_unlisted_source_has_a_vote(spark):
    """Three unlisted sources that agree, against a later one of their kind."""
    said = [("a", "Mon 9:00", 1), ("b", "Mon 9:00", 2), ("c", "Mon 9:00", 3), ("d", "Tue 9:00", 4)]
    df = spark.createDataFrame([(10 * g + o, s, "Org", f"T{g}", "d", None, f"2026-01-0{o}", (raw,), None, None) for g in range(3) for s, raw, o in said], LISTING)
    ranks = spark.createDataFrame([("curated", 0, None), ("feed", 1, None)], RANKS)
    got = survivors.fuse(df, ranks).collect()
    assert {(r["schedule"], r["claims"]) for r in got} == {("mon 9:00", 4)} and len(got) == 3
