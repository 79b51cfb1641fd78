"""Edge cases that the tables do not have."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import dates, geo, tags, text, web
from tallyfold.operators import dedup, expiry, facets, merge, models, normalise, places, quota, search, triage
from tallyfold.operators.corpus import within_budget
from tallyfold.plans import discovery, smart_search
from tallyfold.sources import files, pages
from tallyfold.storage import new_folder
from tallyfold.streaming import runs

LISTING = (
    "ord long, id string, source string, source_url string, org_id string, org_name string, org_url string, opportunity_title string, description_short string, description_long string, cause_tags array<string>, unified_tags array<string>, is_virtual boolean, "
    "schedule struct<date: string, time: string, duration: string, recurring: boolean, raw: string>, address struct<full: string, city: string, state: string, zip: string>, status string, last_scraped string, expiry struct<kind: string, ends_on: string, model: string, checked_at: string>, "
    "geo struct<city: string, state: string, lat: double, lng: double, precision: string, resolved_from: string>"
)


def listings(spark, *rows):
    names = [x.split(" ")[0] for x in LISTING.replace("struct<date: string, time: string, duration: string, recurring: boolean, raw: string>", "s").replace("struct<full: string, city: string, state: string, zip: string>", "s").replace("struct<kind: string, ends_on: string, model: string, checked_at: string>", "s").replace("struct<city: string, state: string, lat: double, lng: double, precision: string, resolved_from: string>", "s").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], LISTING)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


def schedule(date=None, raw=None, recurring=None):
    return (date, None, None, recurring, raw)


def test_signals_decide_about_duplicates(spark):
    base = {"source": "idealist", "org_name": "A", "opportunity_title": "T", "description_short": "d"}
    collapse = [base | {"ord": 1, "schedule": schedule("Mon")}, base | {"ord": 2}]
    keep = [base | {"ord": 3, "org_name": "B", "schedule": schedule("Mon")}, base | {"ord": 4, "org_name": "B", "schedule": schedule("Tue")}]
    blank = [base | {"ord": 5, "org_name": "C"}, base | {"ord": 6, "org_name": "c  "}]
    got = dedup.within_source(listings(spark, *collapse, *keep, *blank)).collect()
    assert sorted((r["ord"], r["keeper_ord"]) for r in got) == [(2, 1), (6, 5)]


def test_unknown_sources_lose_and_inactive_rows_do_not_count(spark):
    base = {"org_name": "A", "opportunity_title": "T", "description_short": "d"}
    rows = listings(spark, base | {"ord": 1, "source": "who"}, base | {"ord": 2, "source": "voly_dallas"}, base | {"ord": 3, "source": "curated", "status": "inactive"})
    assert [(r["ord"], r["keeper_ord"]) for r in dedup.across_sources(rows).collect()] == [(1, 2)]


def test_empty_tables(spark):
    none = listings(spark)
    for f in (dedup.within_source, dedup.across_sources, expiry.collapsed, facets.bodies, facets.by_cause, facets.by_town, places.centroids):
        assert f(none).count() == 0
    assert facets.timing(none).first()["all_rows"] == 0


def test_completeness_counts_what_holds_something(spark):
    full = listings(spark, {"ord": 1, "id": "x", "org_name": "", "cause_tags": [], "unified_tags": ["a"], "is_virtual": False})
    assert full.select(dedup.completeness().alias("n")).first()["n"] == 3


@pytest.mark.parametrize(("typed", "day"), [("Nov 4, 2026", "2026-11-04"), ("Nov 04, 2026", "2026-11-04"), ("November 4, 2026", None), ("", None), (None, None), ("Nov 44, 2026", None)])
def test_named_days(spark, typed, day):
    got = one(spark, typed, dates.named_day)
    assert (str(got) if got else None) == day


@pytest.mark.parametrize(("typed", "micros"), [("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01T01:00:00+01:00", 0), ("1970-01-01 00:00:00", 0), ("60", 60_000_000), ("unknown", None), ("", None), (None, None), ("1970-01-01T00:00:00.5-00:30", 1_800_500_000)])
def test_instants(spark, typed, micros):
    assert one(spark, typed, dates.epoch_micros) == micros


def test_instants_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Chicago")
    try:
        assert one(spark, "1970-01-01 00:00:00", dates.epoch_micros) == 0
        assert one(spark, 0 + 90061, normalise.iso_of_seconds, "long") == "1970-01-02T01:01:01+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_expiry_rules(spark):
    rows = listings(spark, {"ord": 1, "expiry": ("one_time", "2026-05-01", None, None)}, {"ord": 2, "expiry": ("one_time", "2026-04-30", None, None)}, {"ord": 3}, {"ord": 4, "status": "inactive", "expiry": ("one_time", "2020-01-01", None, None)})
    assert [r["ord"] for r in rows.where(expiry.expired("2026-05-01")).collect()] == [2]
    kind, ends = expiry.settled(F.col("k"), F.col("e"))
    got = spark.createDataFrame([("one_time", "soon"), ("later", "2026-01-01"), ("ongoing", None)], "k string, e string").select(kind.alias("k"), ends.alias("e")).collect()
    assert [tuple(r) for r in got] == [("unknown", None), ("unknown", "2026-01-01"), ("ongoing", None)]


def test_weekdays(spark):
    assert [one(spark, d, dates.weekday_label, "array<int>") for d in ([], [1], [1, 3], [1, 3, 5])] == [None, "Weekly on Tue", "Weekly on Tue & Thu", "Weekly on Tue, Thu & Sat"]


@pytest.mark.parametrize(("key", "town"), [("mcallen", None), ("12 main st allen", "Allen"), ("north richland hills tx", "North Richland Hills"), ("", None)])
def test_whole_words_and_the_longest_name(spark, key, town):
    gaz = spark.createDataFrame([(1, "Allen", 1.0, 2.0), (2, "Richland Hills", 1.0, 2.0), (3, "North Richland Hills", 1.0, 2.0)], "gaz_id long, city string, lat double, lng double")
    bodies = spark.createDataFrame([], "id string, city string")
    rows = listings(spark, {"ord": 1, "address": (None, key, None, None)})
    assert places.resolved(rows, gaz, bodies).first()["city"] == town


def test_towns_as_typed(spark):
    assert [one(spark, t, geo.clean_town) for t in ("Plano, TX", "N/A", "Call 555", "a b c d", " ", "Cedar Hill ")] == ["Plano", None, None, None, None, "Cedar Hill"]


def test_names_and_slugs(spark):
    assert one(spark, "The Warren Center, Inc.", text.body_name) == "warren center"
    assert one(spark, "Food Bank Agency Posted By", text.clean_body_name) == "Food Bank"
    assert one(spark, "Fort  Worth", text.slug) == "fort-worth"
    assert one(spark, "one two three", lambda c: text.clipped(c, 8)) == "one two…"
    assert one(spark, "", text.clipped) is None


def test_tags(spark):
    assert one(spark, ["Food", "food", "Instagram", "See More Tags", "helpOut", None, " "], tags.tidy_tags, "array<string>") == ["Food"]
    assert one(spark, "Mental Health & Hunger", tags.label_causes) == ["health", "mental_health", "food_security"]
    assert one(spark, "knitting", tags.label_causes) == ["community"]
    assert one(spark, "food_security", tags.tag_label) == "Food security"


def test_pages(spark):
    html = "<script>x</script><p>A&amp;B&nbsp;<b>c</b></p>"
    assert one(spark, html, web.plain) == "A&B c"
    assert one(spark, "<nav>no</nav><h1>Yes</h1><p> </p>", web.page_text) == "Yes"
    assert one(spark, '<a href="/x">1</a><a class="b" href="http://y">2</a>', web.links) == ["/x", "http://y"]
    assert [one(spark, u, web.host) for u in ("https://www.A.org/b", "a.org", "", None)] == ["a.org", "a.org", "", ""]


def test_blocklist_knows_subdomains(spark):
    asked = spark.createDataFrame([("m.yelp.com",), ("notyelp.com",), ("yelp.com",), ("",)], "domain string")
    got = triage.blocked(asked, "domain", spark.createDataFrame([("yelp.com",)], "domain string"))
    assert sorted(r["domain"] for r in got.collect()) == ["m.yelp.com", "yelp.com"]


def test_known_names_either_way_and_short_ones(spark):
    asked = spark.createDataFrame([("warren center north",), ("ab",), ("zzz",), ("b",)], "name string")
    known = spark.createDataFrame([("warren center",), ("xaby",)], "name string")
    assert sorted(r["name"] for r in triage.known_names(asked, known).collect()) == ["ab", "b", "warren center north"]


def test_search_lines():
    assert search.parsed('"food pantry" Plano') == ["food pantry", "plano"]
    assert search.parsed('"open') == ['"open']
    assert search.parsed("") == []


def test_filters_and_ladder():
    f = search.Filters(city="X", date_start="2026-01-01")
    assert len(f.ladder()) == 3  # the last two rungs are equal
    assert len(search.Filters().ladder()) == 1


def corpus(spark):
    rows = [("a", "listing", "book sorting", [1.0, 0.0], "X", ["arts"], False, None), ("b", "listing", "sorting books", [0.0, 1.0], "Y", ["legal"], True, None), ("c", "listing", None, None, None, None, None, None), ("d", "organization", "books", [0.0, 0.0], "X", [], False, None)]
    return spark.createDataFrame(rows, "id string, type string, content string, embedding array<float>, city string, causes array<string>, is_virtual boolean, event_date date")


def test_hybrid_merges_rankings(spark):
    got = {r["id"]: r["score"] for r in search.hybrid(corpus(spark), [1.0, 0.0], "sorted books").collect()}
    assert got == pytest.approx({"a": 2 / 61, "b": 2 / 62})
    assert search.hybrid(corpus(spark), [1.0, 0.0], "").count() == 2
    assert search.hybrid(corpus(spark).limit(0), [1.0, 0.0], "books").count() == 0


def test_relaxing_stops_at_enough_hits(spark):
    hits, rung = search.relaxed(corpus(spark), [1.0, 0.0], "books", search.Filters(city="nowhere"), least=1)
    assert (rung, hits.count()) == (1, 2)


def test_picks_keep_order_and_range(spark):
    hits = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    got = search.picked(hits, [2, 9, 2, 1]).orderBy("pick").collect()
    assert [r["id"] for r in got] == ["y", "x"]


def test_admission_by_quota(spark):
    day = quota.DAY
    rows = [(1, "a", 0), (2, "a", 1), (3, "a", 2), (4, "b", 3), (5, "c", 4), (6, "a", day), (7, "a", day + 1)]
    log = spark.createDataFrame(rows, "id long, ip_hash string, at long")
    got = {r["id"]: (r["allowed"], r["reason"]) for r in quota.admissions(log, per_ip=2, overall=3).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "ip"), 4: (True, None), 5: (False, "global"), 6: (True, None), 7: (True, None)}


def test_rolling_counts_exclude_the_start(spark):
    log = spark.createDataFrame([(1, "a", 0), (2, "a", quota.DAY), (3, "a", quota.DAY - 1), (4, "b", 0), (5, "a", 0)], "id long, ip_hash string, at long")
    got = {r["id"]: r["n"] for r in quota.rolling(log, ["ip_hash"], "n").collect()}
    assert got == {1: 2, 5: 2, 3: 3, 2: 2, 4: 1}


def test_snapshots_and_overrides(spark):
    old = listings(spark, {"ord": 1, "id": "a", "opportunity_title": "old", "unified_tags": ["arts"]}, {"ord": 2, "id": "b"}, {"ord": 3})
    new = listings(spark, {"ord": 4, "id": "a", "opportunity_title": "new"}, {"ord": 5, "id": "c"})
    got = {r["id"]: (r["status"], r["opportunity_title"], r["unified_tags"], r["seen_in"]) for r in merge.merge_snapshots(old, new).collect()}
    assert got == {"a": ("active", "new", ["arts"], "both"), "b": ("inactive", None, None, "old"), "c": ("active", None, None, "new")}
    rows = spark.createDataFrame([("a", "rejected"), ("b", "passed"), ("c", "passed")], "id string, qc_status string")
    won = merge.overridden(rows, spark.createDataFrame([("a", "keep"), ("b", "reject")], "id string, verdict string"), "id")
    assert {r["id"]: r["qc_status"] for r in won.collect()} == {"a": "passed", "b": "rejected", "c": "passed"}


@pytest.mark.parametrize(("raw", "value"), [('```json\n[1]\n```', [1]), ("nothing", None), ('{"a": 1}', {"a": 1}), (None, None)])
def test_replies(raw, value):
    assert models.reply_of(raw) == value


def test_filters_are_made_safe():
    f = models.checked_filters({"causes": ["arts", "arts", "golf"], "date_start": "2026-05-02", "date_end": "2026-05-01", "virtual": "yes", "city": " "})
    assert f == {"city": None, "causes": ["arts"], "virtual": None, "date_start": None, "date_end": None}
    assert models.checked_filters("text")["causes"] == []
    assert models.answer_of('{"answer": "x", "picks": [2, 2, 9, true]}', 3) == {"answer": "x", "picks": [2]}
    assert models.answer_of("plain", 3) == {"answer": "plain", "picks": None}


def test_failed_replies_leave_rows_untouched(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    got = models.called(rows, "id", lambda r: [{"n": 1} if x["id"] == 1 else "broken" for x in r], "n long")
    assert [tuple(r) for r in models.stamped(rows.select("id"), got, "id", "n", 0).orderBy("id").collect()] == [(1, 1), (2, 0)]


def test_raw_snapshots_keep_empty_objects_apart(spark, tmp_path):
    path = tmp_path / "volops_a.json"
    path.write_text(json.dumps([{"id": "1", "schedule": {}, "flag": False, "n": 0}, {"id": "2", "schedule": {"date": None}, "s": "", "l": [], "qc": {"x": 1}}]))
    (tmp_path / "volops_b.json").write_text("not json")
    rows = files.json_array(spark, [f"{tmp_path}/volops_a.json", f"{tmp_path}/volops_b.json", f"{tmp_path}/gone.json"])
    got = rows.select("stem", "ord", files.filled(F.col("raw")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("volops_a", 0, 3), ("volops_a", 1, 2)]


def test_logs_and_outputs(spark, tmp_path):
    assert tuple(files.run_log(spark, f"{tmp_path}/none").first()) == (True, -1, 0)
    (tmp_path / "log").write_text("a -> 0 raw results\nGiving up on it\n")
    assert tuple(files.run_log(spark, f"{tmp_path}/log").first()) == (False, 0, 1)
    assert files.outputs(has_new=True, n=2) == "has_new=true\nn=2\n"
    assert files.settings("# c\nA=1\nB='x=y'\n") == {"A": "1", "B": "x=y"}
    posts = spark.createDataFrame([(3, "now", "r/a", "T|x", "u")], "score int, created string, subreddit string, title string, url string")
    assert "| 3 | r/a | [T/x](u) |" in files.digest(posts, "2026-01-01")


def test_replacing_a_table(spark):
    path = new_folder(spark, "replace")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_page_cleaning(spark):
    assert one(spark, "Share Opportunity Description  Do it. Respond Share", normalise.clean_description) == "Do it."
    assert one(spark, "Location 12 Main St", normalise.clean_location) == "12 Main St"
    assert one(spark, "Calendar Until TX", normalise.clean_location) is None
    assert one(spark, "Phone\n\n 12 \nAddress", lambda c: normalise.after_label(c, "phone")) == "12"
    assert one(spark, {"fr": "a"}, normalise.of_language, "map<string,string>") == "a"


def test_search_plan(spark):
    hits, got = smart_search.answer(corpus(spark), "legal books", lambda _: [1.0, 0.0], "2026-05-01", reply=lambda _: '{"answer": "Here", "picks": [1]}')
    assert got == {"answer": "Here", "picks": [1]} and hits.count() == 1
    with pytest.raises(ValueError, match="characters"):
        smart_search.answer(corpus(spark), " ", lambda _: [1.0], "2026-05-01")


def test_discovery_plan(spark):
    c = spark.createDataFrame([(1, "Green Mile", "https://green.org", "volunteer volunteer"), (2, "Known", "https://known.org", "volunteer"), (3, "No", None, "")], "id long, name string, url string, text string")
    empty = spark.createDataFrame([], "domain string")
    got = discovery.proposed(c, empty, empty, spark.createDataFrame([("known.org",)], "domain string"), spark.createDataFrame([], "name string"))
    assert [tuple(r) for r in got.collect()] == [(1, 0.7)]


def test_pages_by_structure():
    root = pages.tree("<nav>x</nav><h1 class='a title'>A &amp; <b>B</b></h1><div><i class='dot'></i>Plano</div><h2>What you need</h2><p>Gloves<br>Hat</p><script>1<2</script><h2>More</h2>")
    assert pages.by_class(root, "h1", "title") == "A & B"
    assert pages.beside_icon(root, "dot") == "Plano"
    assert pages.below_heading(root, "need") == "Gloves Hat"
    assert pages.by_class(root, "h1", "gone") is None and pages.below_heading(root, "gone") is None
    assert pages.profile(pages.tree(None))["website"] is None
    got = pages.profile(pages.tree('<p>Address</p><p>1 Main St</p><p>Cedar Hill, TX 75104</p><a href="https://facebook.com/a">f</a><a href="http://a.org">s</a><a href="mailto:x@a.org?cc=y">m</a> 12-1234567'))
    assert got == {"website": "http://a.org", "email": "x@a.org", "ein": "12-1234567", "city": "Cedar Hill", "state": "TX", "zip": "75104", "notes": None}


def test_streamed_quota_equals_batch(spark, sf_dir):
    from tallyfold.queries import QUERIES

    a, b = (sorted(map(tuple, QUERIES[n](spark, sf_dir).collect())) for n in ("quota_admission", "stream_quota"))
    assert a == b


def test_stamps_are_asked_for_once(spark):
    from tallyfold.streaming import runs

    path = new_folder(spark, "stamps")
    spark.createDataFrame([(1, "Every Friday"), (1, "Every Friday"), (2, None)], "ord long, raw string").write.parquet(path)
    stream = spark.readStream.schema("ord long, raw string").parquet(path)
    got = runs.stamped(stream, "ord", models.when, "kind string", "ledger").collect()
    assert sorted(map(tuple, got)) == [(1, "ongoing"), (2, "unclear")]


def test_the_whole_order_keeps_every_row(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000 % 1000).alias("v"), "id").repartition(7)
    got = expiry.in_order(F.desc("v"), F.col("id"))(rows).collect()
    want = sorted(((r["v"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert len(got) == 3000 and [(r["v"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
    assert expiry.in_order(F.col("id"))(rows.limit(0)).count() == 0


def test_websearch_syntax(spark):
    texts = ["Sort food at the pantry", "food pantry shift", "pantry food", "Animals need walks", "animal rescue league", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def hits(q):
        return [r["i"] for r in df.where(search.websearch(F.col("t"), q)).orderBy("i").collect()]

    assert hits("food pantry") == [0, 1, 2]
    assert hits('"food pantry"') == [0, 1]  # stop words do not part a phrase
    assert hits("food -sorting") == [1, 2]
    assert hits('"food pantry" or animals -"rescue league"') == [0, 1, 3]
    assert hits('"food pantry') == [0, 1]
    assert hits("") == hits("the of") == hits("or") == []


def test_steps_are_retried():
    waits, left = [], [2]

    def step():
        left[0] -= 1
        if left[0] >= 0:
            raise OSError("busy")
        return 7

    assert files.retried(step, sleep=waits.append) == 7 and waits == [1.0, 2.0]
    left[0] = 9
    with pytest.raises(OSError):
        files.retried(step, tries=3, sleep=waits.append)


def test_a_table_survives_a_crash_between_its_moves(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.replace_table(spark.range(3), path)
    os.rename(path, f"{path}.last")  # as a crash would leave it
    files.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and sorted(os.listdir(tmp_path)) == ["t"]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.range(4).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    assert runs.drained(stream(), "ids", path=f"{tmp_path}/run").count() == 4
    spark.range(4, 6).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r["id"] for r in runs.drained(stream(), "ids", path=f"{tmp_path}/run").collect()) == [0, 1, 2, 3, 4, 5]


def test_budget_of_a_hot_group(spark):
    rows = [("hot", i, "x" * (i % 7)) for i in range(3000)] + [("cold", 1, "abcdef"), ("cold", 2, None), ("cold", 3, "")]
    got = within_budget(spark.createDataFrame(rows, "g string, o long, t string"), "g", "o", "t", each=5, total=100).collect()
    want, left = [], 100
    for g, o, t in rows[:3000]:
        if t and left:
            want.append((g, o, t[:5][:left]))
            left -= len(want[-1][2])
    assert sorted(map(tuple, got)) == sorted([*want, ("cold", 1, "abcde")])


def test_one_source_of_a_scrape(spark):
    old = spark.createDataFrame([(1, "a", "x", "active"), (2, "b", "y", "active"), (3, "c", "x", None), (4, None, "x", "active")], "ord long, id string, source string, status string")
    new = spark.createDataFrame([(5, "a", "x", "active"), (6, "d", "x", None), (7, "e", "y", None)], "ord long, id string, source string, status string")
    got = {r["id"]: r["status"] for r in merge.merge_scraped(old, new, "x").collect()}
    assert got == {"a": "active", "b": "active", "c": "inactive", "d": "active"}


def test_only_whole_tag_names_are_boilerplate(spark):
    df = spark.createDataFrame([("<header>gone</header><headers>kept</headers><form >gone</form ><formula>x</formula>",)], "h string")
    assert df.select(web.page_text(F.col("h"))).first()[0] == "kept\nx"
