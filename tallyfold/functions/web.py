"""HTML fragments, links and domains, by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfold.functions.text import blank_as_null

#: Entities that fragments use; others stay as they are. Fixed values.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "’"), ("&mdash;", "—"), ("&amp;", "&"))
#: Parts of a page that hold no content. Fixed values.
BOILERPLATE = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript", "svg")
#: Words of a link that lead to places to help. A fixed pattern.
HELP_HINT = r"volunteer|get.?involved|ways.?to.?(help|give|serve)|join.?us|serve|opportunit|give.?back|help.?out|lend.?a.?hand"


#: What an address scores for looking like a page of places to help: pattern, points for its path. Fixed values.
HELP_POINTS = ((r"volunteer", 3), (r"get.?involved|ways.?to.?(help|serve|give)", 2), (r"opportunit", 1), (r"/app/|sign.?up|register|/login|/apply|/form", -3))
QUERY_POINTS = -2  # for an address with a query. A fixed value.


def unescaped(c: Column) -> Column:
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def plain(c: Column) -> Column:
    """A fragment as one line of text: scripts and styles dropped, tags as spaces, entities resolved."""
    t = F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    t = unescaped(F.regexp_replace(t, r"<[^>]+>", " "))
    return blank_as_null(F.trim(F.regexp_replace(t, r"[\s\x{00A0}]+", " ")))


def page_text(c: Column, most: int = 12_000) -> Column:
    """A page's text without its boilerplate, one line a block, blank lines dropped, cut at ``most``."""
    t = c
    for tag in BOILERPLATE:
        t = F.regexp_replace(t, rf"(?is)<{tag}(?=[\s/>])[^>]*>.*?</{tag}\s*>", "\n")
    t = unescaped(F.regexp_replace(t, r"<[^>]+>", "\n"))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{00A0}]+", " "))), lambda x: x != "")
    return F.substring(F.array_join(lines, "\n"), 1, most)


def host(url: Column) -> Column:
    """The host of an address, lower case, without leading www.; empty if there is none."""
    h = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]*)", 1))
    return F.coalesce(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def registrable(url: Column) -> Column:
    """The last two labels of a host."""
    h = F.regexp_replace(host(url), r"^\.+", "")
    return blank_as_null(F.substring_index(h, ".", -2))


def path(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def is_home(url: Column) -> Column:
    return F.trim(path(url), F.lit("/")) == ""


def links(html: Column) -> Column:
    """The addresses of a fragment's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]*\shref="([^"]*)\""""), F.lit(1))


def help_score(url: Column) -> Column:
    """How much an address looks like a page of places to help; sign-up forms and queries count against it."""
    total = F.when(url.contains("?"), QUERY_POINTS).otherwise(0)
    for pattern, points in HELP_POINTS:
        total = total + F.when(path(url).rlike(pattern), points).otherwise(0)
    return total


def name_from_domain(domain: Column) -> Column:
    """``green-mile.org`` as ``Green Mile``."""
    core = F.regexp_replace(F.regexp_replace(domain, r"\.[^.]*$", ""), r"[-_]+", " ")
    return blank_as_null(F.initcap(F.trim(core)))


def title_head(title: Column) -> Column:
    """What stands before the first dash, colon or bar of a title."""
    return F.coalesce(blank_as_null(F.trim(F.regexp_extract(title, r"^(.*?)(?:\s*[–—:|]\s*|\s+-\s+|$)", 1))), blank_as_null(F.trim(title)))
