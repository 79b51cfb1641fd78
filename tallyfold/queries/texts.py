"""Text, HTML, links, JSON and corpus projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions import tags, text, web
from tallyfold.functions.dates import iso_day
from tallyfold.operators import corpus, normalise
from tallyfold.queries.places import TOWN
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.queries.registry import TAXONOMY as TAX
from tallyfold.storage import table

_HTML = "'<div><script>var x = 1;</script><style>p {}</style><nav>Home | About</nav><h1>' || coalesce(opportunity_title, '') || '</h1><p>' || coalesce(description_short, '') || '&nbsp;&amp; more</p><footer>Fine print</footer></div>'"
_ENT = "replace(replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&rsquo;', '’'), '&mdash;', '—'), '&amp;', '&')"
_HOST = "coalesce(regexp_replace(lower(regexp_extract({x}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)', 1)), '^www\\.', ''), '')"
_PATH = "lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1))"
_LEGAL = "|".join(text.LEGAL_WORDS)
BODY = f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({{x}}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\bthe\\b', ' ', 'g'), '\\b({_LEGAL})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
HOST = _HOST


def _listings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "volops_dallasdoinggood")


def _html(rows: DataFrame) -> DataFrame:
    return rows.select("ord", F.expr(_HTML).alias("html"))


@query(f"SELECT ord, nullif(trim(regexp_replace({_ENT.format(x=f'''regexp_replace(regexp_replace({_HTML}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')''')}, '[\\s\\x{{00A0}}]+', ' ', 'g')), '') AS plain FROM {LISTINGS}")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return _html(_listings(spark, d)).select("ord", web.plain(F.col("html")).alias("plain"))


@query(f"""WITH t AS (SELECT ord, {_ENT.format(x=f'''regexp_replace(regexp_replace({_HTML}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>', chr(10), 'g'), '<[^>]+>', chr(10), 'g')''')} AS t FROM {LISTINGS})
SELECT ord, substr(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{{00A0}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)), 1, 12000) AS page FROM t""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return _html(_listings(spark, d)).select("ord", web.page_text(F.col("html")).alias("page"))


_A = "'<p>' || coalesce('<a class=\"x\" href=\"' || source_url || '\">Details</a>', '') || coalesce(' <a href=\"' || org_url || '\">Volunteer</a>', '') || '</p>'"


@query(f"SELECT ord, unnest(regexp_extract_all({_A}, '(?i)<a[^>]*\\shref=\"([^\"]*)\"', 1)) AS link, generate_subscripts(regexp_extract_all({_A}, '(?i)<a[^>]*\\shref=\"([^\"]*)\"', 1), 1)::int AS nth FROM {LISTINGS}")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", F.expr(_A).alias("html"))
    return rows.select("ord", F.posexplode(web.links(F.col("html"))).alias("at", "link")).select("ord", "link", (F.col("at") + 1).alias("nth"))


_SCORE = f"(CASE WHEN contains({_PATH.format(x='u')}, 'volunteer') THEN 3 ELSE 0 END + CASE WHEN regexp_matches({_PATH.format(x='u')}, 'get.?involved|ways.?to.?(help|serve|give)') THEN 2 ELSE 0 END + CASE WHEN contains({_PATH.format(x='u')}, 'opportunit') THEN 1 ELSE 0 END - CASE WHEN contains(u, '?') THEN 2 ELSE 0 END - CASE WHEN regexp_matches({_PATH.format(x='u')}, '/app/|sign.?up|register|/login|/apply|/form') THEN 3 ELSE 0 END)"


@query(f"""WITH l AS (SELECT id, list_concat([volunteer_url], coalesce(fallback_urls, [])) AS us FROM orgs), u AS (SELECT id, unnest(us) AS u, generate_subscripts(us, 1) AS p FROM l)
SELECT id, arg_max(u, ({_SCORE}, -p)) AS url, max({_SCORE})::int AS score FROM u WHERE u IS NOT NULL GROUP BY id""")
def best_volunteer_url(spark: SparkSession, d: str) -> DataFrame:
    urls = F.concat(F.array("volunteer_url"), F.coalesce("fallback_urls", F.array().cast("array<string>")))
    rows = table(spark, d, "orgs").select("id", F.posexplode(urls).alias("p", "u")).where("u is not null").withColumn("s", web.help_score(F.col("u")))
    return rows.groupBy("id").agg(F.max_by("u", F.struct("s", -F.col("p"))).alias("url"), F.max("s").alias("score"))


@query(f"""WITH u AS (SELECT id, unnest(list_concat([volunteer_url], coalesce(fallback_urls, []))) AS u FROM orgs), s AS (SELECT u, max({_SCORE})::int AS score FROM u WHERE u IS NOT NULL AND regexp_matches(lower(u), '{web.HELP_HINT}') AND trim({_PATH.format(x='u')}, '/') <> '' GROUP BY u),
r AS (SELECT u, score, {_HOST.format(x='u')} AS site, row_number() OVER (PARTITION BY {_HOST.format(x='u')} ORDER BY score DESC, u) AS n FROM s) SELECT u AS url, site, score FROM r WHERE n <= 3""")
def link_ranking(spark: SparkSession, d: str) -> DataFrame:
    urls = F.concat(F.array("volunteer_url"), F.coalesce("fallback_urls", F.array().cast("array<string>")))
    rows = table(spark, d, "orgs").select(F.explode(urls).alias("url")).where(F.lower("url").rlike(web.HELP_HINT) & ~web.is_home(F.col("url")))
    best = rows.withColumn("score", web.help_score(F.col("url"))).groupBy("url").agg(F.max("score").alias("score")).withColumn("site", web.host(F.col("url")))
    top = best.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "url")))
    return top.where("n <= 3").select("url", "site", "score")


@query(f"SELECT ord, {_HOST.format(x='org_url')} AS host, nullif(array_to_string(list_reverse(list_reverse(string_split(regexp_replace({_HOST.format(x='org_url')}, '^\\.+', ''), '.'))[1:2]), '.'), '') AS registrable FROM {LISTINGS}")
def domain_of(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", web.host(F.col("org_url")).alias("host"), web.registrable(F.col("org_url")).alias("registrable"))


_HEAD = "coalesce(nullif(trim(regexp_extract(opportunity_title, '^(.*?)(?:\\s*[–—:|]\\s*|\\s+-\\s+|$)', 1)), ''), nullif(trim(opportunity_title), ''))"


@query(f"""SELECT ord, CASE WHEN {_HOST.format(x='org_url')} NOT IN ('', 'signup-hub.example') THEN nullif(array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(split_part({_HOST.format(x='org_url')}, '/', 1), '\\.[^.]*$', ''), '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), '') ELSE {_HEAD} END AS name FROM {LISTINGS}""")
def org_name_guess(spark: SparkSession, d: str) -> DataFrame:
    h = web.host(F.col("org_url"))
    return _listings(spark, d).select("ord", F.when(~h.isin("", "signup-hub.example"), web.name_from_domain(h)).otherwise(web.title_head(F.col("opportunity_title"))).alias("name"))


@query(f"SELECT ord, {BODY.format(x='org_name')} AS body FROM {LISTINGS}")
def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", text.body_name(F.col("org_name")).alias("body"))


@query("SELECT gaz_id, regexp_replace(lower(city), '\\s+', '-', 'g') AS slug, trim(regexp_replace(lower(city), '[^a-z0-9]+', '_', 'g'), '_') AS id_slug FROM gazetteer")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gazetteer").select("gaz_id", text.slug(F.col("city")).alias("slug"), text.id_slug(F.col("city")).alias("id_slug"))


@query(f"SELECT ord, CASE WHEN length(description_long) > 200 THEN regexp_replace(substr(description_long, 1, 200), ' [^ ]*$', '') || '…' WHEN length(description_long) > 0 THEN description_long END AS short FROM {LISTINGS}")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", text.clipped(F.col("description_long"), 200).alias("short"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(text, '{text.EMAIL}'), '|') AS emails, array_to_string(regexp_extract_all(text, '{text.PHONE}'), '|') AS phones, try_cast(replace(nullif(regexp_extract(text, '\\d[\\d,]*'), ''), ',', '') AS bigint) AS first_number FROM documents")
def pii_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.emails(F.col("text")), "|").alias("emails"), F.array_join(text.phones(F.col("text")), "|").alias("phones"), text.spoken_number(F.col("text")).alias("first_number"))


_CHROME = "'Shift  Calendar Until Friday Opportunity Description  ' || coalesce(description_short, '') || '  Respond Share now'"


@query(f"SELECT ord, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_CHROME}, '(?is)^.*?Opportunity Description', ''), '[\\s\\x{{00A0}}]+', ' ', 'g'), '(?is)\\s*(?:Details\\s+|Calendar\\s+)?Get Connected Icon.*$|\\s*Respond(?: as Team| Share)\\b.*$', ''), '[\\s\\x{{00A0}}]+', ' ', 'g')), '') AS body FROM {LISTINGS}")
def clean_description(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", normalise.clean_description(F.expr(_CHROME)).alias("body"))


_LOC = "trim(regexp_replace(trim(regexp_replace('Location Dot ' || address.\"full\", '[\\s\\x{00A0}]+', ' ', 'g')), '(?i)^(?:\\s*(?:Location|Dot|Shift)\\b)+', ''))"


@query(f"SELECT ord, CASE WHEN NOT regexp_matches({_LOC}, '{normalise.NOT_AN_ADDRESS}') AND regexp_matches({_LOC}, '{normalise.ADDRESS_SIGN}') THEN {_LOC} END AS location FROM {LISTINGS}")
def clean_location(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", normalise.clean_location(F.concat(F.lit("Location Dot "), F.col("address.full"))).alias("location"))


@query(f"SELECT ord, nullif(trim(regexp_extract(address.\"full\", '([A-Za-z .''-]+),\\s*([A-Z]{{2}}),?\\s*(\\d{{5}})', 1)), '') AS city, nullif(regexp_extract(address.\"full\", '([A-Za-z .''-]+),\\s*([A-Z]{{2}}),?\\s*(\\d{{5}})', 2), '') AS state, nullif(regexp_extract(address.\"full\", '([A-Za-z .''-]+),\\s*([A-Z]{{2}}),?\\s*(\\d{{5}})', 3), '') AS zip FROM {LISTINGS}")
def address_parts(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", normalise.city_state_zip(F.col("address.full")).alias("a")).select("ord", "a.*")


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
p AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x: starts_with(lower(x), 'contact')), true) AS pos FROM l) SELECT doc_id, CASE WHEN pos > 0 THEN ls[pos + 1] END AS value FROM p""")
def field_after(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", normalise.after_label(F.col("text"), "Contact").alias("value"))


_CAUSES = "[" + ", ".join(f"CASE WHEN contains(lower(l), '{n}') THEN '{c}' END" for n, c in tags.LABEL_CAUSES) + "]"
_NEEDLES = "[" + ", ".join(f"'{n}'" for n, _ in tags.LABEL_CAUSES) + "]"


@query(f"""WITH x AS (SELECT ord, array_to_string(cause_tags, ', ') AS l FROM {LISTINGS}), h AS (SELECT ord, l, list_filter({_CAUSES}, lambda c: c IS NOT NULL) AS h FROM x)
SELECT ord, CASE WHEN coalesce(l, '') = '' THEN '' WHEN len(h) = 0 THEN 'community' ELSE array_to_string(list_filter(h, lambda c, i: list_position(h, c) = i), '|') END AS causes FROM h""")
def map_causes(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", F.array_join(tags.label_causes(F.array_join("cause_tags", ", ")), "|").alias("causes"))


@query("SELECT row_no, json_extract_string(item, '$.org_name') AS org_name, coalesce(nullif(json_extract_string(item, '$.opportunity_title'), ''), nullif(json_extract_string(item, '$.name'), ''), 'Untitled') AS title FROM opportunities")
def parse_reply(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("item"), F.lit("\n```"))
    rows = table(spark, d, "opportunities").select("row_no", normalise.parsed_json(fenced, "org_name string, opportunity_title string, name string").alias("r"))
    return rows.select("row_no", F.col("r.org_name").alias("org_name"), F.coalesce(text.first_filled(F.col("r.opportunity_title"), F.col("r.name")), F.lit("Untitled")).alias("title"))


@query("""WITH h AS (SELECT json_extract_string(item, '$.id') AS id, json_extract_string(item, '$.org_name') AS org_name, coalesce(nullif(json_extract_string(item, '$.opportunity_title'), ''), nullif(json_extract_string(item, '$.name'), ''), 'Untitled') AS title FROM opportunities)
SELECT nullif(id, '') AS id, nullif(org_name, '') AS org_name, title, CASE WHEN id <> '' THEN 'https://www.board.example/need/' || id END AS url, CASE WHEN length(title) > 30 THEN regexp_replace(substr(title, 1, 30), ' [^ ]*$', '') || '…' WHEN length(title) > 0 THEN title END AS short FROM h""")
def normalise_hits(spark: SparkSession, d: str) -> DataFrame:
    return normalise.hits(table(spark, d, "opportunities"), "item", "https://www.board.example")


@query("SELECT event_id, (json_extract_string(props, '$.k'))::int AS k, '{\"type\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS packed FROM events")
def nested_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"))
    return rows.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), F.col("p.k").alias("k"))).alias("packed"))


@query("SELECT id, sha256(trim(split_part(ip_hash || ', 10.0.0.1', ',', 1))) AS hashed FROM search_log")
def client_hash(spark: SparkSession, d: str) -> DataFrame:
    header = F.concat("ip_hash", F.lit(", 10.0.0.1"))
    return table(spark, d, "search_log").select("id", F.sha2(F.trim(F.element_at(F.split(header, ","), 1)), 256).alias("hashed"))


@query(f"""SELECT ord, len(coalesce(cause_tags, []))::int AS n, list_has_any(coalesce(cause_tags, []), ['Food', 'Pets']) AS overlap, list_contains(coalesce(cause_tags, []), 'Arts') AS has_arts, array_to_string(list_sort(list_distinct(coalesce(cause_tags, []))), '|') AS once, array_to_string(coalesce(cause_tags, [])[1:2], '|') AS first_two FROM {LISTINGS}""")
def array_ops(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("cause_tags", F.array().cast("array<string>"))
    return _listings(spark, d).select(
        "ord", F.size(t).alias("n"), F.arrays_overlap(t, F.array(F.lit("Food"), F.lit("Pets"))).alias("overlap"), F.array_contains(t, "Arts").alias("has_arts"),
        F.array_join(F.array_sort(F.array_distinct(t)), "|").alias("once"), F.array_join(F.slice(t, 1, 2), "|").alias("first_two"),
    )


@query(f"""WITH x AS (SELECT ord, CASE WHEN regexp_matches(expiry.ends_on, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(expiry.ends_on AS date) END AS e, try_cast(substr(expiry.checked_at, 1, 10) AS date) AS s FROM {LISTINGS}) SELECT ord, CASE WHEN s <= e THEN s END AS starts, CASE WHEN s <= e THEN e END AS ends FROM x""")
def window_guard(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", iso_day(F.col("expiry.ends_on")).alias("e"), F.substring("expiry.checked_at", 1, 10).try_cast("date").alias("s"))
    fine = F.col("s") <= F.col("e")
    return rows.select("ord", F.when(fine, F.col("s")).alias("starts"), F.when(fine, F.col("e")).alias("ends"))


@query("SELECT gaz_id, repeat('●', least(gaz_id % 8, 5)::int) || repeat('○', greatest(5 - gaz_id % 8, 0)::int) AS bar FROM gazetteer")
def score_bars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gazetteer").select("gaz_id", text.score_bar(F.col("gaz_id") % 8).alias("bar"))


@query(f"SELECT ord, trim(regexp_replace(coalesce(opportunity_title, '') || ' [1], see [12].', '\\s*\\[\\d+\\]', '', 'g')) AS shown FROM {LISTINGS}")
def answer_text(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", F.trim(F.regexp_replace(F.concat(F.coalesce("opportunity_title", F.lit("")), F.lit(" [1], see [12].")), r"\s*\[\d+\]", "")).alias("shown"))


@query("""WITH s AS (SELECT source, doc_id, substr(text, 1, 3500) AS piece FROM documents WHERE length(text) > 0 AND source IS NOT NULL), b AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s)
SELECT source, doc_id, substr(piece, 1, greatest(0, 8000 - used)::bigint) AS piece FROM b WHERE used < 8000""")
def text_budget(spark: SparkSession, d: str) -> DataFrame:
    return corpus.within_budget(table(spark, d, "documents").where("source is not null"), "source", "doc_id", "text")


_TAGS = "CASE WHEN len(coalesce(unified_tags, [])) > 0 THEN unified_tags ELSE coalesce(cause_tags, []) END"
_EVENT = "CASE WHEN expiry.kind = 'one_time' AND regexp_matches(expiry.ends_on, '^\\d{4}-\\d{2}-\\d{2}$') THEN expiry.ends_on END"


@query(f"""SELECT ord, concat_ws(chr(10), nullif(opportunity_title, ''), 'Organization: ' || nullif(org_name, ''), 'Location: ' || {TOWN}, CASE WHEN coalesce(is_virtual, false) THEN 'Format: virtual / remote' END, 'Causes: ' || nullif(array_to_string({_TAGS}, ', '), ''),
 CASE WHEN {_EVENT} IS NOT NULL THEN 'When: ' || {_EVENT} || ' (one-time event)' WHEN expiry.kind = 'ongoing' THEN 'Availability: ongoing' END, coalesce(nullif(description_long, ''), nullif(description_short, ''))) AS chunk FROM {LISTINGS}""")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", corpus.chunk().alias("chunk"))


@query(f"""WITH v AS (SELECT * FROM {LISTINGS} WHERE status IS DISTINCT FROM 'inactive'), r AS (SELECT lower(trim(org_name)) AS key, {_TAGS} AS tags, {TOWN} AS city FROM v WHERE lower(trim(org_name)) <> ''),
c AS (SELECT key, string_agg(t, '|' ORDER BY t) AS causes FROM (SELECT DISTINCT key, unnest(tags) AS t FROM r) GROUP BY key), y AS (SELECT key, min(city) AS city FROM r GROUP BY key)
SELECT coalesce(nullif(id, ''), 'listing:' || coalesce(opportunity_title, '')) AS id, 'listing' AS type, {TOWN} AS city, array_to_string(coalesce(unified_tags, []), '|') AS causes, coalesce(is_virtual, false) AS is_virtual, {_EVENT} AS event_date FROM v
UNION ALL SELECT 'org:' || y.key, 'organization', y.city, coalesce(c.causes, ''), false, NULL FROM y LEFT JOIN c USING (key)""")
def corpus_entries(spark: SparkSession, d: str) -> DataFrame:
    return corpus.entries(_listings(spark, d))


@query(f"""SELECT ord, json_extract_string(j, '$.title') AS title, length(json_extract_string(j, '$.description'))::int AS n FROM (SELECT ord, to_json({{'title': substr(opportunity_title, 1, 200), 'description': substr(coalesce(nullif(description_long, ''), nullif(description_short, '')), 1, 700)}}) AS j FROM {LISTINGS})""")
def judge_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = _listings(spark, d).select("ord", corpus.for_judging().alias("j"))
    return rows.select("ord", F.get_json_object("j", "$.title").alias("title"), F.length(F.get_json_object("j", "$.description")).alias("n"))


@query(f"SELECT ord, CASE WHEN coalesce(is_virtual, false) THEN 'Virtual' WHEN nullif(trim(address.city), '') IS NOT NULL AND nullif(trim(address.state), '') IS NOT NULL THEN trim(address.city) || ', ' || trim(address.state) ELSE nullif(trim(address.city), '') END AS place, coalesce(nullif(trim(schedule.raw), ''), nullif(schedule.date, ''), CASE WHEN schedule.recurring THEN 'recurring' WHEN NOT schedule.recurring THEN 'one-time' END) AS moment FROM {LISTINGS}")
def card_labels(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("ord", corpus.where_label().alias("place"), corpus.when_label().alias("moment"))


@query(f"SELECT ord, array_to_string(list_filter(list_transform(string_split(array_to_string(list_concat(coalesce(unified_tags, []), coalesce(cause_tags, [])), ' , '), ','), lambda x: trim(x)), lambda x: list_contains({TAX}, x)), ',') AS tags FROM {LISTINGS}")
def drafts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    typed = F.array_join(F.concat(F.coalesce("unified_tags", none), F.coalesce("cause_tags", none)), " , ")
    return _listings(spark, d).select("ord", F.array_join(normalise.tags_from_text(typed, tags.TAXONOMY), ",").alias("tags"))


@query("SELECT event_id, strftime(make_timestamp((event_id * 1000003 % 2000000000) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events WHERE event_id > 0")
def unix_to_iso(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_id > 0").select("event_id", normalise.iso_of_seconds(F.col("event_id") * 1000003 % 2000000000).alias("at"))
