"""Pages made of listings, read back by their structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import web
from tallyfold.queries.registry import LISTINGS, query
from tallyfold.sources import pages
from tallyfold.storage import table

_ESC = "replace(replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_DETAIL = f"concat('<html><body><script>ignore()</script><h1 class=\"big title\">', {_ESC.format(x='opportunity_title')}, '</h1><div><i class=\"icon-org\"></i><b>', {_ESC.format(x='org_name')}, '</b></div><h2>Requirements</h2><p>', {_ESC.format(x='status')}, '<br>only</p><h2>Other</h2><p>no</p></body></html>')"
_PROFILE = f"concat('<html><head><meta name=\"description\" content=\"', {_ESC.format(x='name')}, '\"></head><body><p>Address</p><p>1 Main St</p><p>', coalesce(city, 'Nowhere'), ', ', coalesce(state, 'TX'), ' 75001</p><a href=\"https://facebook.com/x\">F</a>', coalesce(concat('<a href=\"', volunteer_url, '\">Site</a>'), ''), '<a href=\"mailto:a@x.org?subject=1\">Mail</a> EIN 12-3456789</body></html>')"
_TRIM = "trim(regexp_replace({x}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'))"


@query(f"""SELECT ord, nullif({_TRIM.format(x="coalesce(opportunity_title, '')")}, '') AS title, nullif({_TRIM.format(x="coalesce(org_name, '')")}, '') AS org, trim(coalesce(status, '') || ' only') AS needs FROM {LISTINGS}""")
def detail_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "volops_dallasdoinggood").select("ord", F.expr(_DETAIL).alias("html"))
    return pages.read(rows, "ord", "html", ("title", "org", "needs"), _detail)


def _detail(root: pages.Node) -> dict:
    return {"title": pages.by_class(root, "h1", "title"), "org": pages.beside_icon(root, "icon-org"), "needs": pages.below_heading(root, "requirement")}


@query("SELECT id, volunteer_url AS website, 'a@x.org' AS email, '12-3456789' AS ein, coalesce(city, 'Nowhere') AS city, coalesce(state, 'TX') AS state, '75001' AS zip, left(trim(name), 300) AS notes FROM orgs")
def profile_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orgs").select("id", F.expr(_PROFILE).alias("html"))
    return pages.read(rows, "id", "html", ("website", "email", "ein", "city", "state", "zip", "notes"), pages.profile)


@query("SELECT gaz_id, CASE WHEN gaz_id < 80 THEN ((gaz_id // 12) + 1) * 12 END::int AS next_offset FROM gazetteer")
def next_page(spark: SparkSession, d: str) -> DataFrame:
    """List pages name the first, this and, before the end, later pages; the next is the nearest beyond."""
    this = F.floor(F.col("gaz_id") / 12) * 12

    def link(n: Column) -> Column:
        return F.concat(F.lit('<a href="/need/?offset='), n.cast("string"), F.lit('">p</a>'))

    more = F.when(F.col("gaz_id") < 80, F.concat(link(this + 24), link(this + 12))).otherwise(F.lit(""))
    html = F.concat(link(F.lit(0)), link(this), more)
    return table(spark, d, "gazetteer").select("gaz_id", pages.next_offset(web.links(html), this.cast("int")).alias("next_offset"))


@query("""WITH u AS (SELECT id, unnest(list_concat([volunteer_url], coalesce(fallback_urls, []))) AS url, generate_subscripts(list_concat([volunteer_url], coalesce(fallback_urls, [])), 1) AS nth FROM orgs)
SELECT id, arg_min(url, nth) AS url FROM u WHERE url IS NOT NULL AND NOT suffix(url, '/volunteer') GROUP BY id""")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """The main address has no content here, so the first fallback that has some is taken."""
    urls = F.concat(F.array("volunteer_url"), F.coalesce("fallback_urls", F.array().cast("array<string>")))
    return pages.first_with_content(table(spark, d, "orgs"), "id", urls, lambda u: F.when(u.endswith("/volunteer"), F.lit("")).otherwise(u)).select("id", "url")


@query("SELECT event_id, (ts - INTERVAL 6 HOUR)::date AS day FROM events")
def local_day(spark: SparkSession, d: str) -> DataFrame:
    """The day at a fixed distance from UTC."""
    return table(spark, d, "events").select("event_id", (F.col("ts").cast("timestamp_ntz") - F.expr("INTERVAL 6 HOURS")).cast("date").alias("day"))


@query("""WITH l AS (SELECT event_id // 25 AS page, user_id FROM events), f AS (SELECT user_id, min(page) AS page FROM l GROUP BY user_id), n AS (SELECT DISTINCT page FROM l WHERE page NOT IN (SELECT page FROM f))
SELECT user_id, page FROM f WHERE page < coalesce((SELECT min(page) FROM n), 1000000000)""")
def crawl_until_nothing_new(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "events").select(F.expr("event_id div 25").alias("page"), "user_id")
    return pages.until_nothing_new(listed, "page", "user_id")
