"""Deduplication, snapshot merging and expiry of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import dates
from tallyfold.functions.text import squeezed
from tallyfold.operators import dedup, expiry, merge
from tallyfold.queries.registry import DUP_KEY, FILLED, LISTINGS, SIGNAL, epoch, query
from tallyfold.queries.registry import squeezed as sq
from tallyfold.storage import table

TODAY = "2026-05-01"
NOW_MICROS = 1_780_272_000_000_000  # 2026-06-01 00:00 UTC
_ROWS = f"SELECT ord, {sq('source')} AS src, md5(concat_ws(chr(0), {DUP_KEY})) AS k, {SIGNAL} AS signal, {FILLED} AS filled FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive'"


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volops_dallasdoinggood")


@query(f"""WITH r AS ({_ROWS}), g AS (SELECT src, k, arg_min(ord, (-filled, ord)) AS keeper_ord FROM r GROUP BY src, k HAVING count(*) > 1 AND count(DISTINCT signal) <= 1)
SELECT r.ord, g.keeper_ord FROM r JOIN g ON r.src = g.src AND r.k = g.k WHERE r.ord <> g.keeper_ord""")
def dedup_within_source(spark: SparkSession, d: str) -> DataFrame:
    return dedup.within_source(_listings(spark, d))


@query(f"""WITH r AS (SELECT *, CASE src WHEN 'curated' THEN 0 WHEN 'volunteergarland' THEN 1 WHEN 'volunteermckinney' THEN 1 WHEN 'dallasdoinggood' THEN 1 WHEN 'idealist' THEN 2 WHEN 'voly_dallas' THEN 2 ELSE 3 END AS tier FROM ({_ROWS})),
g AS (SELECT k, arg_min(ord, (tier, -filled, ord)) AS keeper_ord FROM r GROUP BY k HAVING count(*) > 1 AND count(DISTINCT signal) <= 1 AND count(DISTINCT src) > 1)
SELECT r.ord, g.keeper_ord FROM r JOIN g ON r.k = g.k WHERE r.ord <> g.keeper_ord""")
def dedup_cross_source(spark: SparkSession, d: str) -> DataFrame:
    return dedup.across_sources(_listings(spark, d))


@query(f"SELECT ord, {FILLED} AS filled, {SIGNAL} AS signal FROM {LISTINGS}")
def completeness_signal(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", dedup.completeness().alias("filled"), dedup.schedule_signal().alias("signal"))


@query(f"SELECT id, ord, opportunity_title FROM {LISTINGS} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_seen(_listings(spark, d).select("id", "ord", "opportunity_title"), "id", "ord")


@query(f"SELECT id, ord, opportunity_title FROM {LISTINGS} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1")
def last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return dedup.last_written(_listings(spark, d).select("id", "ord", "opportunity_title"), "id", "ord")


@query(f"SELECT {sq('org_name')} AS body, arg_max(ord, ({FILLED}, -ord)) AS ord, max({FILLED}) AS filled FROM {LISTINGS} GROUP BY 1")
def argmax_keeper(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", squeezed(F.col("org_name")).alias("body"), dedup.completeness().alias("filled"))
    return rows.groupBy("body").agg(F.max_by("ord", F.struct("filled", -F.col("ord"))).alias("ord"), F.max("filled").alias("filled"))


_LAST = "SELECT id, opportunity_title, unified_tags, expiry.kind AS kind FROM {t} WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1"


@query(f"""WITH o AS ({_LAST.format(t=LISTINGS)}), n AS ({_LAST.format(t='volops_batches')})
SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'active' ELSE 'inactive' END AS status,
 CASE WHEN n.id IS NOT NULL THEN n.opportunity_title ELSE o.opportunity_title END AS opportunity_title,
 array_to_string(coalesce(n.unified_tags, o.unified_tags), '|') AS unified_tags, coalesce(n.kind, o.kind) AS expiry_kind,
 CASE WHEN n.id IS NOT NULL AND o.id IS NOT NULL THEN 'both' WHEN n.id IS NOT NULL THEN 'new' ELSE 'old' END AS seen_in
FROM o FULL OUTER JOIN n ON o.id = n.id""")
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = merge.merge_snapshots(_listings(spark, d), table(spark, d, "volops_batches"))
    return merged.withColumn("unified_tags", F.array_join("unified_tags", "|"))


@query(f"""SELECT ord, org_id FROM {LISTINGS} WHERE org_id IS NULL OR org_id NOT IN (SELECT org_id FROM volops_batches WHERE org_id IS NOT NULL)
UNION ALL SELECT ord, org_id FROM volops_batches WHERE org_id IS NOT NULL""")
def org_replace(spark: SparkSession, d: str) -> DataFrame:
    return merge.replace_bodies(_listings(spark, d), table(spark, d, "volops_batches"))


@query(f"SELECT ord, id FROM volops_batches b WHERE NOT EXISTS (SELECT 1 FROM {LISTINGS} v WHERE v.id = b.id)")
def digest_new(spark: SparkSession, d: str) -> DataFrame:
    return merge.new_since(table(spark, d, "volops_batches").select("ord", "id"), _listings(spark, d)).select("ord", "id")


@query(f"SELECT id, name FROM orgs WHERE coalesce(active, true) AND id NOT IN (SELECT org_id FROM {LISTINGS} WHERE org_id IS NOT NULL)")
def pending_orgs(spark: SparkSession, d: str) -> DataFrame:
    return merge.pending(table(spark, d, "orgs"), _listings(spark, d), "id", "org_id").select("id", "name")


@query(f"""SELECT v.ord, CASE WHEN o.active THEN 'passed' WHEN NOT o.active THEN 'rejected' WHEN v.status = 'inactive' THEN 'rejected' ELSE 'passed' END AS qc_status
FROM {LISTINGS} v LEFT JOIN orgs o ON v.org_id = o.id""")
def overrides_win(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", "org_id", F.when(F.col("status") == "inactive", F.lit("rejected")).otherwise(F.lit("passed")).alias("qc_status"))
    by_body = table(spark, d, "orgs").where("active is not null").select(F.col("id").alias("org_id"), F.when(F.col("active"), F.lit("keep")).otherwise(F.lit("reject")).alias("verdict"))
    return merge.overridden(rows, by_body, "org_id").select("ord", "qc_status")


@query(f"""SELECT id, min(ord) AS ord FROM volops_batches WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM {LISTINGS} WHERE id IS NOT NULL) GROUP BY id""")
def append_new_entries(spark: SparkSession, d: str) -> DataFrame:
    return merge.appended(_listings(spark, d), table(spark, d, "volops_batches").select("id", "ord"), "id", "ord")


@query(f"""SELECT ord, CASE WHEN schedule.recurring THEN 'ongoing' WHEN NOT schedule.recurring AND d IS NOT NULL THEN 'one_time' END AS kind,
 CASE WHEN NOT schedule.recurring THEN d END AS ends_on
FROM (SELECT ord, schedule, CASE WHEN regexp_matches(trim(schedule.date), '^[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}$') THEN strftime(try_strptime(trim(schedule.date), '%b %d, %Y'), '%Y-%m-%d') END AS d FROM {LISTINGS})""")
def rule_expiry(spark: SparkSession, d: str) -> DataFrame:
    kind, ends = expiry.rule_kind()
    return _listings(spark, d).select("ord", kind.alias("kind"), ends.alias("ends_on"))


@query(f"SELECT ord, 'event date passed (' || expiry.ends_on || ')' AS reason FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive' AND expiry.ends_on < '{TODAY}'")
def expire_past(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).where(expiry.expired(TODAY))
    return rows.select("ord", F.concat(F.lit("event date passed ("), F.col("expiry.ends_on"), F.lit(")")).alias("reason"))


@query(f"""SELECT ord, id, org_name, opportunity_title, 'expired' AS category, source_url FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive' AND expiry.ends_on < '{TODAY}'""")
def rejection_log(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).where(expiry.expired(TODAY))
    return rows.select("ord", "id", "org_name", "opportunity_title", F.lit("expired").alias("category"), "source_url")


@query(f"SELECT ord FROM {LISTINGS} WHERE coalesce({epoch('last_scraped')}, 0) >= {NOW_MICROS} - 90 * 86400000000")
def ttl_last_seen(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).where(expiry.seen_since(NOW_MICROS - 90 * 86_400_000_000)).select("ord")


@query(f"SELECT ord, {epoch('last_scraped')} AS at FROM {LISTINGS}")
def scraped_instant(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", dates.epoch_micros(F.col("last_scraped")).alias("at"))


@query(f"""SELECT ord, row_number() OVER (ORDER BY coalesce(expiry.ends_on, '9999'), ord)::int AS rank FROM {LISTINGS} ORDER BY coalesce(expiry.ends_on, '9999'), ord LIMIT 50""")
def upcoming_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", F.coalesce(F.col("expiry.ends_on"), F.lit("9999")).alias("ends"))
    return expiry.latest_first(50, F.col("ends"), F.col("ord"))(rows).select("ord", "rank")


@query(f"""SELECT ord, row_number() OVER (ORDER BY coalesce(last_scraped, '') DESC, ord)::int AS rank FROM {LISTINGS} ORDER BY coalesce(last_scraped, '') DESC, ord LIMIT 50""")
def recent_sort(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", F.coalesce("last_scraped", F.lit("")).alias("seen"))
    return expiry.latest_first(50, F.col("seen").desc(), F.col("ord"))(rows).select("ord", "rank")


@query(f"""SELECT ord, row_number() OVER (ORDER BY coalesce(expiry.ends_on, '9999'), ord) AS rank FROM {LISTINGS}""")
def upcoming_order(spark: SparkSession, d: str) -> DataFrame:
    """Every listing, the next to end first."""
    rows = _listings(spark, d).select("ord", F.coalesce(F.col("expiry.ends_on"), F.lit("9999")).alias("ends"))
    return expiry.in_order(F.col("ends"), F.col("ord"))(rows).select("ord", "rank")


@query(f"""SELECT ord, row_number() OVER (ORDER BY coalesce(last_scraped, '') DESC, ord) AS rank FROM {LISTINGS}""")
def recent_order(spark: SparkSession, d: str) -> DataFrame:
    """Every listing, the latest first."""
    rows = _listings(spark, d).select("ord", F.coalesce("last_scraped", F.lit("")).alias("seen"))
    return expiry.in_order(F.col("seen").desc(), F.col("ord"))(rows).select("ord", "rank")


@query(f"""SELECT ord, row_number() OVER (ORDER BY coalesce(opportunity_title, ''), ord) AS rank FROM {LISTINGS}""")
def title_order(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot's output order: every listing by title, binary."""
    rows = _listings(spark, d).select("ord", F.coalesce("opportunity_title", F.lit("")).alias("title"))
    return expiry.in_order(F.col("title"), F.col("ord"))(rows).select("ord", "rank")


@query(f"""SELECT ord, rank FROM (SELECT ord, row_number() OVER (ORDER BY coalesce(last_scraped, '') DESC, ord)::int AS rank FROM {LISTINGS}) WHERE rank BETWEEN 13 AND 24""")
def page_two(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", F.coalesce("last_scraped", F.lit("")).alias("seen"))
    return dedup.page(rows, [F.col("seen").desc(), F.col("ord")], 2, 12).select("ord", "rank")


@query(f"""WITH x AS (SELECT ord, schedule.recurring AS rec, expiry.ends_on AS ends, coalesce(CASE WHEN regexp_matches(schedule.date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(schedule.date AS date) END,
 CASE WHEN regexp_matches(trim(schedule.date), '^[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}$') THEN try_strptime(trim(schedule.date), '%b %d, %Y')::date END) AS d,
 CASE WHEN regexp_matches(expiry.ends_on, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(expiry.ends_on AS date) END AS e, expiry.kind AS kind FROM {LISTINGS})
SELECT ord, CASE WHEN d IS NOT NULL AND NOT coalesce(rec, false) THEN CASE WHEN year(d) = 2026 THEN strftime(d, '%b %-d') ELSE strftime(d, '%b %-d, %Y') END
 WHEN e IS NOT NULL AND kind = 'one_time' THEN CASE WHEN year(e) = 2026 THEN strftime(e, '%b %-d') ELSE strftime(e, '%b %-d, %Y') END
 WHEN e IS NOT NULL AND kind = 'ongoing' THEN 'Through ' || CASE WHEN year(e) = 2026 THEN strftime(e, '%b %-d') ELSE strftime(e, '%b %-d, %Y') END END AS label FROM x""")
def date_label(spark: SparkSession, d: str) -> DataFrame:
    own, ends = dates.any_day(F.col("schedule.date")), dates.iso_day(F.col("expiry.ends_on"))
    label = F.when(own.isNotNull() & ~F.coalesce(F.col("schedule.recurring"), F.lit(False)), dates.day_label(own, 2026))
    label = label.when(ends.isNotNull() & (F.col("expiry.kind") == "one_time"), dates.day_label(ends, 2026))
    label = label.when(ends.isNotNull() & (F.col("expiry.kind") == "ongoing"), F.concat(F.lit("Through "), dates.day_label(ends, 2026)))
    return _listings(spark, d).select("ord", label.alias("label"))


@query(f"""SELECT ord, CASE WHEN expiry.kind = 'one_time' AND coalesce(expiry.ends_on, '') <> '' THEN true ELSE false END AS is_event,
 CASE WHEN expiry.kind = 'one_time' AND regexp_matches(expiry.ends_on, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN expiry.ends_on END AS event_date FROM {LISTINGS}""")
def event_rows(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", F.coalesce(expiry.is_event(), F.lit(False)).alias("is_event"), expiry.event_date().alias("event_date"))


_CLOCK = "CASE WHEN regexp_matches({x}, '(?i)^\\s*\\d{{1,2}}:\\d{{2}}\\s*[AP]M\\s*$') THEN (regexp_extract({x}, '(\\d{{1,2}}):(\\d{{2}})', 1)::int % 12) * 60 + regexp_extract({x}, '(\\d{{1,2}}):(\\d{{2}})', 2)::int + CASE WHEN regexp_matches({x}, '(?i)PM\\s*$') THEN 720 ELSE 0 END END"


@query(f"""WITH x AS (SELECT ord, schedule.time AS t, {_CLOCK.format(x="split_part(schedule.time, ' - ', 1)")} AS starts, {_CLOCK.format(x="split_part(schedule.time, ' - ', 2)")} AS ends FROM {LISTINGS})
SELECT ord, starts, ends, (CASE WHEN (starts // 60) % 12 = 0 THEN 12 ELSE (starts // 60) % 12 END)::varchar || ':' || lpad((starts % 60)::varchar, 2, '0') || CASE WHEN starts // 60 >= 12 THEN ' PM' ELSE ' AM' END AS shown FROM x""")
def time_ranges(spark: SparkSession, d: str) -> DataFrame:
    start = dates.clock_minutes(F.split_part(F.col("schedule.time"), F.lit(" - "), F.lit(1)))
    end = dates.clock_minutes(F.split_part(F.col("schedule.time"), F.lit(" - "), F.lit(2)))
    return _listings(spark, d).select("ord", start.alias("starts"), end.alias("ends"), dates.clock_label(start).alias("shown"))


@query(f"""WITH r AS (SELECT ord, {sq('org_name')} AS body, {sq('opportunity_title')} AS title, cause_tags,
 coalesce(CASE WHEN regexp_matches(schedule.date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(schedule.date AS date) END, CASE WHEN regexp_matches(trim(schedule.date), '^[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}$') THEN try_strptime(trim(schedule.date), '%b %d, %Y')::date END) AS day FROM {LISTINGS}),
g AS (SELECT body, title, count(*) AS n, min(day) AS first_day, list_sort(list(DISTINCT isodow(day) - 1) FILTER (day IS NOT NULL)) AS days, arg_min(ord, (coalesce(day, date '9999-12-31'), ord)) AS first_ord,
 arg_min(cause_tags, (coalesce(day, date '9999-12-31'), ord)) AS tags FROM r WHERE title <> '' GROUP BY body, title),
w AS (SELECT *, list_transform(coalesce(days, []), lambda d: ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][d + 1]) AS names FROM g)
SELECT first_ord, n, n > 1 AS recurring, strftime(first_day, '%Y-%m-%d') AS first_day,
 CASE WHEN n > 1 AND len(names) > 0 THEN 'Weekly on ' || CASE WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[1:len(names)-1], ', ') || ' & ' || names[len(names)] END END AS weekdays,
 coalesce((SELECT string_agg(t, '|' ORDER BY p) FROM (SELECT t, min(p) AS p FROM (SELECT unnest(tags) AS t, generate_subscripts(tags, 1) AS p) WHERE t IS NOT NULL GROUP BY t)), CASE WHEN tags IS NOT NULL THEN '' END) AS tags FROM w""")
def occurrence_collapse(spark: SparkSession, d: str) -> DataFrame:
    return expiry.collapsed(_listings(spark, d))


@query()
def curation_pipeline(spark: SparkSession, d: str) -> DataFrame:
    from tallyfold.plans import curation

    return curation.indexed(_listings(spark, d), table(spark, d, "volops_batches"), table(spark, d, "gazetteer"), table(spark, d, "orgs"), TODAY)


_DUPS = f"WITH r AS ({_ROWS}), g AS (SELECT src, k, arg_min(ord, (-filled, ord)) AS keeper_ord FROM r GROUP BY src, k HAVING count(*) > 1 AND count(DISTINCT signal) <= 1), inside AS (SELECT r.ord FROM r JOIN g ON r.src = g.src AND r.k = g.k WHERE r.ord <> g.keeper_ord)"


@query(_DUPS + f""", l AS (SELECT *, CASE src WHEN 'curated' THEN 0 WHEN 'volunteergarland' THEN 1 WHEN 'volunteermckinney' THEN 1 WHEN 'dallasdoinggood' THEN 1 WHEN 'idealist' THEN 2 WHEN 'voly_dallas' THEN 2 ELSE 3 END AS tier FROM r WHERE ord NOT IN (SELECT ord FROM inside)),
h AS (SELECT k, arg_min(ord, (tier, -filled, ord)) AS keeper_ord FROM l GROUP BY k HAVING count(*) > 1 AND count(DISTINCT signal) <= 1 AND count(DISTINCT src) > 1), across AS (SELECT l.ord FROM l JOIN h ON l.k = h.k WHERE l.ord <> h.keeper_ord),
e AS (SELECT ord FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive' AND expiry.ends_on < '{TODAY}')
SELECT ord, CASE WHEN ord IN (SELECT ord FROM inside) OR ord IN (SELECT ord FROM across) THEN 'duplicate' ELSE 'expired' END AS category FROM (SELECT ord FROM inside UNION SELECT ord FROM across UNION SELECT ord FROM e)""")
def curation_rejects(spark: SparkSession, d: str) -> DataFrame:
    from tallyfold.plans import curation

    return curation.rejected(_listings(spark, d), TODAY)
