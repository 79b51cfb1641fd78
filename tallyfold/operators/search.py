"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about a document. Fixed values.
STOP_WORDS = frozenset("a an and are as at be but by for from has have i in is it its of on or our that the their this to was we were will with you your".split())
POOL, RESULTS, FUSION, LEAST_HITS = 120, 16, 60, 3


def parsed(text: str) -> list[str]:
    """The terms of a search line: quoted phrases and words, lower case. An open quote is part of its word."""
    terms = [(m[1] if m[1] is not None else m[2]).strip().lower() for m in re.finditer(r'"([^"]+)"|(\S+)', text or "")]
    return [t for t in terms if t]


def has_all(hay: Column, terms: list[str]) -> Column:
    """Whether a text contains every term; no terms match everything."""
    keep = F.lit(True)
    for t in terms:
        keep &= hay.contains(t)
    return keep


def hits_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text contains, anywhere."""
    low = F.lower(text)
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity with a fixed vector in double precision; null without a direction or of another length."""
    q = F.lit([float(x) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    v = vector.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(vector) == len(query)) & (size > 0) & F.lit(norm > 0), dot / (size * (norm or 1.0)))


def stem(word: Column) -> Column:
    """A light English stem: plural and verb endings off words that stay long enough."""
    s = F.when((F.length(word) > 4) & word.endswith("ies"), F.concat(F.regexp_replace(word, "ies$", ""), F.lit("y"))).otherwise(F.when((F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", "")).otherwise(word))
    s = F.when((F.length(s) > 5) & s.endswith("ing"), F.regexp_replace(s, "ing$", "")).otherwise(s)
    return F.when((F.length(s) > 4) & s.endswith("ed"), F.regexp_replace(s, "ed$", "")).otherwise(s)


def stem_word(w: str) -> str:
    w = w[:-3] + "y" if len(w) > 4 and w.endswith("ies") else (w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w)
    w = w[:-3] if len(w) > 5 and w.endswith("ing") else w
    return w[:-2] if len(w) > 4 and w.endswith("ed") else w


def lexemes(text: Column) -> Column:
    """The stems of a text's words without stop words, in order."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*sorted(STOP_WORDS)))
    return F.transform(words, stem)


def websearch(text: Column, query: str) -> Column:
    """Whether a text matches a query as search engines take them: all words, "phrases" word by word, ``or`` between
    alternatives (it binds less than the rest), ``-`` before what must not occur. Stop words are left out; a query of
    nothing else matches nothing, an unclosed quote reaches to the end."""
    lex = lexemes(text)
    line = F.concat(F.lit(" "), F.array_join(lex, " "), F.lit(" "))
    alternatives: list[list[Column]] = [[]]
    for sign, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query.lower()):
        if bare == "or" and not sign:
            alternatives.append([])
            continue
        stems = [stem_word(w) for w in re.findall("[a-z0-9]+", quoted or bare) if w not in STOP_WORDS]
        if stems:
            hit = line.contains(f" {' '.join(stems)} ") if len(stems) > 1 else F.array_contains(lex, stems[0])
            alternatives[-1].append(~hit if sign else hit)
    found = F.lit(False)
    for terms in filter(None, alternatives):
        every = F.lit(True)
        for t in terms:
            every &= t
        found |= every
    return found


def lexical_rank(text: Column, query: str) -> Column:
    """Frequency of the query's stems, damped by the text's length; null unless every stem occurs."""
    stems = sorted({stem_word(w) for w in re.findall("[a-z0-9]+", query.lower()) if w not in STOP_WORDS})
    if not stems:
        return F.lit(None).cast("double")
    lex = lexemes(text)
    counts = [F.size(lex) - F.size(F.array_remove(lex, s)) for s in stems]
    total, every = F.lit(0), F.lit(True)
    for c in counts:
        total = total + c
        every &= c > 0
    return F.when(every, total / (1 + F.log(1.0 + F.size(lex))))


@dataclass(frozen=True)
class Filters:
    """What a search is limited to; what is not set limits nothing."""

    type: str | None = "listing"
    city: str | None = None
    causes: tuple[str, ...] = ()
    virtual: bool | None = None
    date_start: str | None = None
    date_end: str | None = None
    today: str | None = None

    def keep(self) -> Column:
        """Only the filters that are set become predicates, so that they reach the scan. Undated rows pass any date."""
        out = F.lit(True)
        if self.type is not None:
            out &= F.col("type") == self.type
        if self.city is not None:
            out &= F.lower("city") == self.city.lower()
        if self.causes:
            out &= F.arrays_overlap("causes", F.array(*map(F.lit, self.causes)))
        if self.virtual is not None:
            out &= F.col("is_virtual") == self.virtual
        for bound, side in ((self.date_start, "ge"), (self.date_end, "le"), (self.today, "ge")):
            if bound is not None:
                day = F.lit(bound).cast("date")
                out &= F.col("event_date").isNull() | (F.col("event_date") >= day if side == "ge" else F.col("event_date") <= day)
        return out

    def ladder(self) -> list[Filters]:
        """From strict to loose: without dates, without the town too, nothing but the type. Equal rungs once."""
        rungs = [self, replace(self, date_start=None, date_end=None), replace(self, date_start=None, date_end=None, city=None), replace(self, city=None, causes=(), virtual=None, date_start=None, date_end=None)]
        return [r for i, r in enumerate(rungs) if r not in rungs[:i]]


def _ranked(rows: DataFrame, score: str, pool: int) -> DataFrame:
    """(id, rank): a sorted limit, then ranks over the few rows left, instead of one task sorting everything."""
    top = rows.where(F.col(score).isNotNull()).orderBy(F.desc(score), "id").limit(pool)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc(score), "id")).alias("rank"))


def nearest(rows: DataFrame, query: list[float], k: int = 8, of_type: str | None = None) -> DataFrame:
    """(id, score) of the k rows nearest to a vector."""
    if of_type is not None:
        rows = rows.where(F.col("type") == of_type)
    return rows.select("id", cosine(F.col("embedding"), query).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def hybrid(rows: DataFrame, query: list[float], text: str, filters: Filters | None = None, results: int = RESULTS, pool: int = POOL, fusion: int = FUSION) -> DataFrame:
    """(id, score): reciprocal rank fusion of the vector and the lexical ranking of the rows that pass the filters."""
    base = rows.where((filters or Filters()).keep())
    vec = _ranked(base.select("id", cosine(F.col("embedding"), query).alias("s")), "s", pool).withColumnRenamed("rank", "vec_rank")
    lex = _ranked(base.select("id", lexical_rank(F.col("content"), text).alias("s")), "s", pool).withColumnRenamed("rank", "lex_rank")
    one = F.lit(1.0)
    fused = vec.join(lex, "id", "full_outer").select("id", (F.coalesce(one / (fusion + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(one / (fusion + F.col("lex_rank")), F.lit(0.0))).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(results)


def relaxed(rows: DataFrame, query: list[float], text: str, filters: Filters, least: int = LEAST_HITS) -> tuple[DataFrame, int]:
    """The hits of the first rung of the ladder with enough of them, and its number. At most four small jobs."""
    ladder = filters.ladder()
    for i, rung in enumerate(ladder):
        hits = hybrid(rows, query, text, rung)
        if i == len(ladder) - 1 or len(hits.take(least)) >= least:
            return hits, i
    raise AssertionError


def picked(hits: DataFrame, picks: list[int]) -> DataFrame:
    """The hits at the 1-based places a model picked, in its order; places out of range or named twice are ignored."""
    order = list(dict.fromkeys(picks))
    places = hits.sparkSession.createDataFrame([(p, i) for i, p in enumerate(order)], "rank int, pick int")
    return hits.join(places, "rank")
