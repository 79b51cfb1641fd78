"""Mapping free-entered values to a canonical list (problem 6).

1. Rows are brought down to their distinct pairs of values first; only these go on, and the answers are joined back.
2. Values are normalised: case, accents, state and zip, a street typed in front, wrappings such as "near" or "area",
   abbreviations. A value made of nothing but words like "online" or "various" names no place, and the next value of
   the row is asked: the town of a full address.
3. Candidates come from an inverted index of character trigrams: names and entries are joined by trigram, rarer
   ones weigh more (inverse entry frequency), and the sum over common ones gives the weighted cosine. Candidates above LOOSE
   only serve to normalise spelling: words of the name that are a slip or two (a missing, doubled, wrong or swapped
   letter) from a word of the entry are written as there.
4. The names so spelt are looked up in the index again. A candidate is accepted if its weighted cosine reaches THRESHOLD
   and its score is above that of any other entry by MARGIN; the score is the cosine, less SLIP for every letter put
   right and NTH for every wrapping taken off, and a little for the cosine of the name as typed.
5. What is not accepted is reported as -1.

Both sides of steps 3 and 4 are joins by key, so the list may be of any length. A hot value is one value from step 1 on; in
the end its rows meet one small row, which adaptive execution splits. Nulls and blanks: a row without any value
gives no row. Repeated rows each give their row. Very long texts are cleaned like others, in whole; empty
lists report every row as -1. Entries with the same name: the smallest id.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.storage import materialize

LOOSE = 0.15  # of a name before its spelling is put right: two letters swapped leave a short name few of its trigrams
THRESHOLD = 0.9
SLIP, NTH, TYPED = 0.1, 0.04, 0.2
MARGIN = 0.004
NONE = -1

#: Abbreviated parts of place names, by place: at the start of a name, at its end. Fixed values.
FIRST_PARTS = {"ft": "fort", "lk": "lake", "st": "saint", "ste": "saint", "mt": "mount", "n": "north", "no": "north", "nth": "north", "s": "south", "so": "south", "sth": "south", "e": "east", "w": "west", "pt": "port"}
LAST_PARTS = {"hts": "heights", "hgts": "heights", "ht": "heights", "hls": "hills", "hl": "hills", "spgs": "springs", "spg": "springs", "sprgs": "springs", "sprg": "springs", "jct": "junction", "jctn": "junction", "xing": "crossing", "crssg": "crossing", "crsg": "crossing", "vlg": "village", "bch": "beach", "cty": "city"}
#: Words around a place name that do not change the place.
BEFORE = ("city of", "town of", "village of", "near", "nr", "downtown", "uptown", "midtown", "central", "greater", "around", "outside", "in", "east", "west", "north", "south", "old town")
AFTER = ("and nearby towns", "nearby towns", "and nearby", "and vicinity", "vicinity", "and surrounding area", "and surrounding areas", "surrounding area", "surrounding areas", "metro area", "metro", "area", "region", "or online", "and online", "online", "or virtual", "virtual", "or remote", "remote", "hybrid", "usa", "us")
#: A value made only of such words names no place.
NO_PLACE = frozenset("n a na tbd tba tbc unknown unspecified none null nil multiple various varies varied several many different all any sites site locations location places place venues venue areas virtual virtually online remote remotely hybrid from home at your own work countywide citywide statewide nationwide worldwide anywhere everywhere see map website page link listing description details below ask the coordinator organizer contact us for to be determined announced confirmed zoom phone video call via private residence address shared given after sign up signup and or of in county city wide not applicable available".split())
STATE = re.compile(r"[\s,]*(?:\(\s*(?:tx|texas|ok|oklahoma)\.?\s*\)|\b(?:tx|texas|ok|oklahoma)\b\.?)[\s,]*$")
ZIP = re.compile(r"[\s,]*\b\d{5}(?:-\d{4})?\s*$")
STREET = r"(?:street|st|road|rd|drive|dr|lane|ln|avenue|ave|boulevard|blvd|parkway|pkwy|court|ct|place|pl|way|trail|trl|circle|cir|highway|hwy|terrace|ter|loop)"
GLUED = re.compile(rf"^\s*\d+\s+.*?[a-z](?:Street|St|Road|Rd|Drive|Dr|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Parkway|Pkwy|Court|Ct|Place|Pl|Way|Trail|Circle)\.?(?=[A-Z])|^\s*\d+\s+.*?\s(?:Street|St|Road|Rd|Drive|Dr|Lane|Ln|Avenue|Ave|Boulevard|Blvd|Parkway|Pkwy|Court|Ct|Place|Pl|Way|Trail|Circle)\.?(?=[A-Z])")
STREET_LINE = re.compile(rf"^\s*\d+\s+.*\b{STREET}\b\.?\s*(?:(?:apt|suite|ste|unit|#)\s*\S+)?\s*$")


def folded(text: str) -> str:
    """Without accents, lower case, curly signs made plain."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("’", "'")


def _stripped(text: str) -> tuple[str, bool]:
    """Without state and zip at the end, and whether there were any."""
    had = False
    while True:
        shorter = STATE.sub("", ZIP.sub("", text))
        if shorter == text or not shorter.strip(" ,"):
            return text, had
        text, had = shorter, True


def words(text: str) -> str:
    """Letters and digits of a name, one space between words, abbreviated parts written out."""
    w = re.findall(r"[^\W_]+", text.replace("&", " and "))
    if len(w) > 1:
        w[0] = FIRST_PARTS.get(w[0], w[0])
        w[-1] = LAST_PARTS.get(w[-1], w[-1])
    return " ".join(w)


def readings(name: str) -> list[str]:
    """The name as typed, then without the words wrapped around it."""
    out, seen = [name], {name}
    at = 0
    while at < len(out):
        n = out[at]
        at += 1
        for b in BEFORE:
            if n.startswith(b + " ") and n[len(b) + 1 :] not in seen:
                out.append(words(n[len(b) + 1 :]))
                seen.add(out[-1])
        for a in AFTER:
            if n.endswith(" " + a) and n[: -len(a) - 1] not in seen:
                out.append(words(n[: -len(a) - 1]))
                seen.add(out[-1])
    return out


def place_name(value: str | None) -> str | None:
    """What a value typed as a city says, or None if it names no place at all."""
    if value is None or not value.strip():
        return None
    value = GLUED.sub("", unicodedata.normalize("NFKD", value))
    text, _ = _stripped(folded(value))
    parts = re.findall(r"[^\W_]+", text)  # as typed: "n/a" is no abbreviated north
    if not parts or all(p in NO_PLACE or p.isdigit() for p in parts):
        return None
    return words(text)


def town_name(value: str | None) -> str | None:
    """The town that a full address gives, or None if it gives none.

    The town is the last part before state and zip, if either stands there or a street line goes before it, or
    what stands before a dash and a venue."""
    if value is None or not value.strip():
        return None
    text, had = _stripped(folded(value))
    parts = [p for p in re.split(r"\s*[,\n\r;|]+\s*", text.strip(" ,\n\t")) if p.strip()]
    if not parts:
        return None
    last = parts[-1]
    street = any(STREET_LINE.match(p) for p in parts[:-1])
    if STREET_LINE.match(last):  # a street alone, or a street after its town
        return None
    if len(parts) > 1 and (had or street):
        return place_name(last)
    dash = re.split(r"\s+[-–—]\s+", text.strip())
    if len(dash) > 1:
        return place_name(dash[0])
    if len(parts) == 1 and had:
        return place_name(last)
    return None


def slips(a: str, b: str) -> int:
    """Damerau-Levenshtein distance: neighbours swapped count one, also where letters between them were lost."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    far = n + m
    seen: dict[str, int] = {}  # the last row of each letter of a
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        match = 0  # the last column of this row with equal letters
        x, above, here = a[i - 1], d[i], d[i + 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            k, last = seen.get(y, 0), match
            if x == y:
                best, match = above[j], j
            else:
                best = 1 + min(above[j], here[j], above[j + 1])
            here[j + 1] = min(best, d[k][last] + (i - k - 1) + 1 + (j - last - 1))
        seen[x] = i
    return d[n + 1][m + 1]


def respelt(name: str, entry: str) -> tuple[str, int] | None:
    """The name with its words written as in the entry where they are slips of those, and the number of slips; None if
    there are too many: one, two in a name of eleven letters or more, none in words of one or two letters. Words that
    are no slips stay as they are."""
    if name == entry:
        return name, 0
    most = 1 if len(entry) < 11 else 2
    x, y = name.split(), entry.split()
    if len(x) == len(y):
        total, out = 0, []
        for v, w in zip(x, y):
            d = 0 if v == w else slips(v, w)
            if d > most or (d and min(len(v), len(w)) < 3):
                out.append(v)
            else:
                total += d
                out.append(w)
        return (" ".join(out), total) if total <= most else None
    if abs(len(name) - len(entry)) < 3 and slips(name.replace(" ", ""), entry.replace(" ", "")) <= 1:  # a space too many or too few
        return entry, 1
    return name, 0


def trigrams(name: Column) -> Column:
    padded = F.concat(F.lit("  "), name, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def resolve(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(asked, id): the accepted entry of every name of ``names`` (asked); names without one are left out.

    entries: (id long, name string), as written in the list."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, name, nth = [], [], []
            for a in b.column("asked").to_pylist():
                for i, r in enumerate(readings(a)):
                    asked.append(a)
                    name.append(r)
                    nth.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(asked, pa.string()), pa.array(name, pa.string()), pa.array(nth, pa.int32())], ["asked", "name", "nth"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([words(folded(n)) for n in b.column("name").to_pylist()], pa.string())], ["id", "name"])

    listed = entries.where("id is not null and trim(name) <> ''").mapInArrow(cleaned, "id long, name string").groupBy("name").agg(F.min("id").alias("id")).where("name <> ''")
    grams = listed.select("id", F.col("name").alias("entry"), F.explode(trigrams(F.col("name"))).alias("g"))
    known = grams.groupBy("g").agg(F.count("*").alias("df"))
    size = listed.count()
    weight = F.log(1 + size / F.coalesce(F.col("df"), F.lit(1)))
    weighed = grams.join(known, "g").withColumn("w", weight)
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("entry_norm"))

    def cosines(names: DataFrame, least: float) -> DataFrame:
        """(name, id, entry, cosine): the entries whose weighted cosine with a name is high enough, by the index."""
        typed = names.select("name", F.explode(trigrams(F.col("name"))).alias("g")).join(known, "g", "left").withColumn("w", weight)
        own = typed.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        both = typed.join(weighed.select("g", "id", "entry", F.col("w").alias("we")), "g").groupBy("name", "id", "entry").agg(F.sum(F.col("w") * F.col("we")).alias("dot"))
        return both.join(own, "name").join(norms, "id").withColumn("cosine", F.col("dot") / (F.col("norm") * F.col("entry_norm"))).where(F.col("cosine") >= least).select("name", "id", "entry", "cosine")

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [respelt(n, e) for n, e in zip(b.column("name").to_pylist(), b.column("entry").to_pylist())]
            ok = pa.array([x is not None for x in got], pa.bool_())
            names = pa.array([x[0] if x else None for x in got], pa.string())
            out = pa.RecordBatch.from_arrays([b.column("name"), b.column("cosine"), names, pa.array([x[1] if x else 0 for x in got], pa.int32())], ["name", "typed", "spelt", "slips"])
            yield out.filter(ok)

    asked = materialize(names.select("asked").distinct().mapInArrow(read, "asked string, name string, nth int"), "asked")
    first = cosines(asked.select("name").distinct(), LOOSE).mapInArrow(spelt, "name string, typed double, spelt string, slips int")
    first = materialize(first.groupBy("name", "spelt").agg(F.max(F.struct(-F.col("slips"), "typed")).alias("m")).select("name", "spelt", (-F.col("m.col1")).alias("slips"), "m.typed"), "spelt")
    second = cosines(first.select(F.col("spelt").alias("name")).distinct(), THRESHOLD).where(F.abs(F.length("name") - F.length("entry")) < 3).withColumnRenamed("name", "spelt")  # trigrams are a set, repeated words the same
    good = asked.join(first, "name").join(second, "spelt")
    score = F.col("cosine") - SLIP * F.col("slips") - NTH * F.col("nth") + TYPED * F.col("typed")
    best = good.groupBy("asked", "id").agg(F.max(score).alias("score"))
    ranked = best.groupBy("asked").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("below"), "id"))).alias("c"))
    top, other = F.element_at("c", 1), F.try_element_at("c", F.lit(2))
    return ranked.where(other.isNull() | (other["below"] - top["below"] >= MARGIN)).select("asked", top["id"].alias("id"))


def match_places(rows: DataFrame, key: str, city: Column, full: Column, entries: DataFrame) -> DataFrame:
    """(key, id): one row per row with something typed in either value; -1 where no entry of the list is meant."""
    both = rows.select(F.col(key).alias("key"), city.cast("string").alias("city"), full.cast("string").alias("full")).where(F.col("city").isNotNull() | F.col("full").isNotNull())

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool((c or "").strip() or (f or "").strip()) for c, f in zip(b.column("city").to_pylist(), b.column("full").to_pylist())]
            b = b.filter(pa.array(keep, pa.bool_()))
            names = [place_name(c) or town_name(f) for c, f in zip(b.column("city").to_pylist(), b.column("full").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("city"), b.column("full"), pa.array(names, pa.string())], ["city", "full", "asked"])

    # the second value counts only where the first names no place; most pairs of values are of few kinds
    pairs = both.select("city", "full").distinct()
    wanted = materialize(pairs.mapInArrow(asked, "city string, full string, asked string"), "wanted")
    answers = wanted.join(resolve(wanted.where("asked is not null"), entries), "asked", "left").select("city", "full", F.coalesce("id", F.lit(NONE)).cast("long").alias("id"))
    same = both["city"].eqNullSafe(answers["city"]) & both["full"].eqNullSafe(answers["full"])
    return both.join(answers, same).select(both["key"], answers["id"])
