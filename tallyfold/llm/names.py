"""Variant spellings of names typed by people (problem 4): a set-similarity join on token q-grams, verified softly.

1. Distinct spellings become forms, multisets of tokens: case, accents, punctuation, legal and decorative additions, an
   acronym of the whole name beside it, and stop words go; usual abbreviations are written out. Forms of equal tokens in
   another order are one form.
2. Set-similarity join of the tokens on their padded, numbered bigrams. Two tokens within the slips that ``near`` allows
   share at least three bigrams (two if short), except for two swaps in six or seven letters. The bigrams are
   ordered by rarity and cut to the prefix in which the first three shared ones must lie (at most nine); tokens meet
   under triples of prefix bigrams (pairs, if short), which are selective however many tokens there are.
3. Prefix-filtered join of the forms on weighted tokens. A token weighs by inverse form frequency, that of its most
   frequent similar token at most, so that a slip weighs what its word weighs. Linked forms share SHARE of their squared weight at
   least, hence one of the rarest tokens, those before the rest falls below SHARE; under these, and under the more
   frequent tokens similar to them, forms meet. Tokens in many forms are no key where rarer ones stand beside them.
4. Where forms meet they are compared softly: every token must have a counterpart, an equal one, a slip, a nickname, an
   initial, an abbreviation, two tokens typed as one, or an acronym of several. The counterparts' similarity, weighted by
   rarity, must reach LEAST_SCORE. A token without counterpart (another purpose, given name, number) keeps bodies apart.
   Frequent forms come first; a form joins the best earlier one it agrees with, one that stands for no cluster yet
   is also held against the members, so a meeting costs its forms times its bodies, not all pairs. A form that
   agrees equally well with different bodies through an initial, nickname, abbreviation or acronym joins none.
5. A slip or unlisted abbreviation counts only if it is one in context: at least SUPPORT of the forms with the rarer token must agree, but
   for it, with a form that has the other. So a slip is found however often it is repeated, while two
   real words or names that differ by a letter stay apart. Linked forms are one body: components.

Null and blank names take no part; names of nothing but punctuation are linked to nothing. Repeated rows only
weigh. A body with very many spellings gives as many pairs as the result demands; ``entities`` gives one row
per spelling instead. A meeting of more than SPLIT forms is dealt out by a second token that linked forms must share. Very
long names are compared in whole. Empty input: empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.canon import slips
from tallyfold.llm.components import components
from tallyfold.storage import materialize, spread

STOP = frozenset("the of and at for a an in to".split())
#: Usual abbreviations in names of bodies. Fixed values.
ABBREVIATIONS = {
    "assn": "association", "assoc": "association", "bk": "bank", "cmte": "committee", "comm": "community", "cmty": "community", "comte": "committee", "cncl": "council", "co": "county", "ctr": "center",
    "cntr": "center", "centre": "center", "dept": "department", "dpt": "department", "fam": "family", "fdn": "foundation", "fndn": "foundation", "found": "foundation", "gdns": "gardens", "hlth": "health",
    "inst": "institute", "ktchn": "kitchen", "lge": "league", "lit": "literacy", "mem": "memorial", "meml": "memorial", "min": "ministries", "mins": "ministries", "neighbours": "neighbors", "netwk": "network", "ntwk": "network",
    "pks": "parks", "ptnrs": "partners", "ptrs": "partners", "resq": "rescue", "schol": "scholarship", "soc": "society", "sr": "senior", "svc": "services", "svcs": "services", "trng": "training", "trp": "troop", "vets": "veterans",
    "vol": "volunteer", "vols": "volunteers", "yth": "youth",
}
#: Given names with their short forms. Fixed values.
GIVEN = [
    "abigail abby", "alexander alex alec sandy", "alexandra alex sandra", "alfred al fred", "andrew andy drew", "anthony tony", "barbara barb", "benjamin ben benny", "catherine cathy cate", "charles charlie chuck", "christina tina chris",
    "christopher chris kit", "daniel dan danny", "david dave davy", "deborah deb debbie", "donald don", "dorothy dot dottie dolly", "edward ed eddie ted ned", "eleanor nell ellie nora", "elizabeth liz beth betty eliza lizzie bess libby", "eugene gene",
    "florence flo", "frances fran frannie", "francis frank", "franklin frank", "frederick fred freddy freddie", "gabriel gabe", "george", "gerald jerry", "gregory greg", "harold hal harry", "henry hank harry", "jacob jake", "james jim jimmy", "jennifer jen jenny", "john jack johnny",
    "jonathan jon", "joseph joe joey", "josefina josie pepa fina", "josephine jo josie", "judith judy", "katherine kate kathy katie kay kit", "kenneth ken", "lawrence larry", "leonard len", "louis lou", "margaret maggie meg peggy marge greta", "maria mary", "martha marty patty",
    "matthew matt", "michael mike mick", "nathaniel nate nathan", "nicholas nick", "pamela pam", "patricia pat patty tricia", "patrick pat", "peter pete", "philip phil", "raymond ray", "rebecca becky", "richard rick dick rich", "robert bob rob bobby bert", "ronald ron", "samuel sam", "samantha sam",
    "stephen steve", "steven steve", "susan sue susie", "theodore ted theo teddy", "theresa terry tess", "thomas tom tommy", "timothy tim", "victoria vicky", "vincent vince", "virginia ginny", "walter walt", "william bill will billy liam",
]
_CLASSES = [frozenset(g.split()) for g in GIVEN]
_SPELT: dict[str, list[str]] = {}
for _short, _long in ABBREVIATIONS.items():
    if len(_short) > 4:
        _SPELT.setdefault(_long, []).append(_short)
GIVEN_NAMES = frozenset().union(*_CLASSES)
_CLASS_OF = {n: [c for c in _CLASSES if n in c] for n in GIVEN_NAMES}
ADDITION = re.compile(
    r"\(\s*501\s*\(?c\)?\s*\(?3\)?\s*\)|\(\s*(?:tx|texas)\s*\)|[\s|,;–—-]+(?:volunteers?\s+needed|sign[\s-]?up(?:\s+hub)?|main\s+office|head\s*quarters|a\s+non[\s-]?profit(?:\s+organi[sz]ation)?|non[\s-]?profit)\s*$|\s+at\s+the\s+annex\s*$|[\s,]+(?:inc|incorporated|llc|l\.l\.c|ltd|corp|corporation|co)\.?\s*$|\b501\s?\(?c\)?\s?\(?3\)?"
)
SHARE = 0.3  # of a form's squared weight that a linked form shares
LEAST_SCORE = 0.8
HARM = 1.5  # a slip takes so many letters' share of a token's similarity
SUPPORT = 0.5
SPLIT = 4096  # forms that meet in one task at most; beyond, they meet again under a second token


def folded(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return text.replace("’", "").replace("'", "").replace("`", "")


def tokens_of(name: str) -> list[str]:
    """The telling tokens of a name, in order."""
    text = " " + folded(re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", name)).strip()
    while (shorter := ADDITION.sub(" ", text).rstrip(" .,;|-–—")) != text.rstrip(" .,;|-–—"):
        text = shorter
    aside = re.findall(r"\(\s*([a-z]{2,8})\s*\)", text)
    lead = re.match(r"\s*([a-z]{2,8})\s+[–—-]\s+", text)
    words = [w for w in re.findall(r"[a-z0-9]+", text) if w not in STOP]
    for a in [*aside, *([lead[1]] if lead else [])]:
        if a in words and len(words) > 2:
            rest = list(words)
            rest.remove(a)
            if slips(a, "".join(w[0] for w in rest if not w.isdigit())) <= 1:
                words = rest
    return [ABBREVIATIONS.get(w, w) for w in words]


def near(a: str, b: str) -> int | None:
    """The slips between two tokens, None if too many: one, two in tokens of six letters or more (one of them may
    have lost a letter)."""
    if a == b:
        return 0
    if a.isdigit() or b.isdigit() or min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2:
        return None
    if len(set(a) ^ set(b)) > 4:  # a slip changes two letters at most
        return None
    d = slips(a, b)
    return d if d <= (2 if len(a) + len(b) >= 12 else 1) else None


def is_abbreviation(short: str, word: str) -> bool:
    """Letters of the word in order, from its first: its beginning, or up to its last letter, or without vowels."""
    if not 2 <= len(short) < len(word) or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short) and (word.startswith(short) or short[-1] == word[-1] or not set(short[1:]) & set("aeiou"))


def bigrams(token: str) -> list[str]:
    """The bigrams of a token between its ends, repeated ones numbered, so that they form a set."""
    padded, seen, out = f" {token} ", {}, []
    for x, y in zip(padded, padded[1:]):
        n = seen[x + y] = seen.get(x + y, -1) + 1
        out.append(x + y + (str(n) if n else ""))
    return out


def signatures(token: str, rarity: dict[str, int]) -> list[str]:
    """The sets of bigrams under which a token meets those similar to it."""
    grams = sorted(bigrams(token), key=lambda g: (rarity.get(g[:2], 0), g))
    out = []
    if len(token) <= 5:
        out += ["2" + "|".join(c) for c in combinations(grams, 2)]
    if len(token) >= 5:
        # two slips spoil six bigrams at most; three of the others lie in this prefix
        prefix = grams[: len(grams) - max(3, len(grams) - 6) + 3]
        out += ["3" + "|".join(c) for c in combinations(prefix, 3)]
    return out


@lru_cache(1 << 18)
def relation(t: str, u: str) -> tuple[float, str] | None:
    """How similar two different tokens are, and by what; None if they are no counterparts."""
    of_t, of_u = _CLASS_OF.get(t, ()), _CLASS_OF.get(u, ())
    if any(u in c for c in of_t):
        return 0.95, "nick"
    short, long_ = sorted((t, u), key=len)
    if len(short) == 1:
        first = {long_[0]}.union(*[{n[0] for n in c} for c in _CLASS_OF.get(long_, ())])
        return (0.9, "initial") if short in first and len(long_) > 1 else None
    if of_t and of_u:
        return None
    d = near(t, u)
    if d is None and min(len(t), len(u)) > 4:  # a slip of another way to write the word
        d = min((x for a, b in ((t, u), (u, t)) for w in _SPELT.get(b, ()) if (x := near(a, w)) is not None), default=None)
    if d is not None:
        return 1 - HARM * d / max(len(t), len(u)), "slip"
    if any(len(n) > 4 and near(a, n) == 1 for a, classes in ((t, of_u), (u, of_t)) for c in classes for n in c):
        return 0.8, "nick"
    if is_abbreviation(short, long_):
        return 0.6 + 0.4 * len(short) / len(long_), "short"
    return None


#: What the kinds of counterparts cost where several bodies agree with a form; the lossy ones can mean several bodies.
COST = {"slip": 1, "glued": 1, "nick": 2, "initial": 4, "short": 3, "acronym": 3}
LOSSY = frozenset(("nick", "initial", "short", "acronym"))


class Form:
    """A name's tokens in order, its numbers apart."""

    __slots__ = ("name", "words", "numbers", "weights", "rows")

    def __init__(self, name: int, tokens: list[str], weights: list[float], rows: int):
        self.name, self.rows = name, rows
        self.numbers = sorted(t for t in tokens if t.isdigit())
        kept = [(t, w) for t, w in zip(tokens, weights) if not t.isdigit()]
        self.words, self.weights = [t for t, _ in kept], [w for _, w in kept]


def _acronym(a: list[int], x: Form, b: list[int], y: Form) -> tuple[int, list[int]] | None:
    """A token of x among ``a`` that is made of the initials of consecutive tokens of y among ``b``."""
    for i in a:
        t = x.words[i]
        if 2 <= len(t) <= len(b):
            for s in range(len(b) - len(t) + 1):
                run = b[s : s + len(t)]
                if all(y.words[j][0] == c for j, c in zip(run, t)):
                    return i, run
    return None


def agree(x: Form, y: Form) -> tuple[int, float, list[tuple[str, str]], bool] | None:
    """(cost, score, slips, whether by a lossy relation) if every token of either form has a counterpart and the weighted similarity
    of the counterparts is high enough, else None."""
    if x.numbers != y.numbers:
        return None
    a, b = list(range(len(x.words))), list(range(len(y.words)))
    total = got = 0.0
    at: dict[str, list[int]] = {}
    for j in b:
        at.setdefault(y.words[j], []).append(j)
    left, taken = [], set()
    for i in a:
        same = at.get(x.words[i])
        if same:
            j = same.pop()
            taken.add(j)
            w = max(x.weights[i], y.weights[j])
            total, got = total + w, got + w
        else:
            left.append(i)
    right = [j for j in b if j not in taken]
    cost, found, lossy = 0, [], False
    if len(left) != len(right):
        if not left or not right:
            return None
        few, f, many, m = (left, x, right, y) if len(left) < len(right) else (right, y, left, x)
        hit = _acronym(few, f, many, m)
        if hit:
            few.remove(hit[0])
            w = sum(m.weights[j] for j in hit[1])
            for j in hit[1]:
                many.remove(j)
            total, got, cost, lossy = total + w, got + 0.9 * w, cost + COST["acronym"], True
        else:
            for i in list(few):
                pair = next(((j, k, d) for j, k in combinations(many, 2) if min(len(m.words[j]), len(m.words[k])) > 2 and (d := near(f.words[i], m.words[j] + m.words[k])) is not None), None)
                if pair:
                    few.remove(i)
                    many.remove(pair[0])
                    many.remove(pair[1])
                    w = m.weights[pair[0]] + m.weights[pair[1]]
                    total, got, cost = total + w, got + w * (1 - HARM * pair[2] / len(f.words[i])), cost + COST["glued"]
                    break
        if len(left) != len(right):
            return None
    if left:
        rated = sorted(((r, i, j) for i in left for j in right if (r := relation(x.words[i], y.words[j])) is not None), key=lambda r: (-r[0][0], r[1], r[2]))
        free, open_ = set(left), set(right)
        for (sim, kind), i, j in rated:
            if i in free and j in open_:
                free.remove(i)
                open_.remove(j)
                w = max(x.weights[i], y.weights[j])
                total, got, cost = total + w, got + w * sim, cost + COST[kind]
                lossy |= kind in LOSSY
                if kind in ("slip", "short"):
                    found.append((x.words[i], y.words[j]))
        if free:
            return None
    score = got / total if total else float(not x.numbers and not y.numbers or x.numbers == y.numbers)
    return (cost, score, found, lossy) if score >= LEAST_SCORE else None


def linked(forms: list[Form]) -> Iterator[tuple[int, int, list[tuple[str, str]]]]:
    """(form, earlier form, slips between them) of forms that meet: each with the best one it agrees with."""

    def fullness(f: Form) -> tuple:
        return (sum(len(w) == 1 for w in f.words), -len(f.words), -f.rows, f.words, f.name)

    heads: list[tuple[Form, list[Form]]] = []
    for f in sorted(forms, key=fullness):
        hits = [(*r, n) for n, (h, _) in enumerate(heads) if (r := agree(f, h)) is not None]
        if not hits:
            inner = [(*r, n, m) for n, (_, members) in enumerate(heads) for m in members if (r := agree(f, m)) is not None and not r[3]]
            if inner:
                best = min(inner, key=lambda r: (r[0], -r[1], r[4]))
                yield f.name, best[5].name, best[2]
                heads[best[4]][1].append(f)
            heads.append((f, []))
            continue
        best = min(hits, key=lambda r: (r[0], -r[1], r[4]))
        tied = [r for r in hits if r[0] == best[0] and r[3] and r[4] != best[4]]
        if tied and any(agree(heads[best[4]][0], heads[r[4]][0]) is None for r in tied):
            continue  # it may mean either
        yield f.name, heads[best[4]][0].name, best[2]
        heads[best[4]][1].append(f)


def _similar(tokens: DataFrame) -> DataFrame:
    """(token, other): tokens of four letters or more that are within some slips of each other, both ways.

    tokens: (token), distinct."""
    words = tokens.select("token").where((F.length("token") >= 4) & ~F.col("token").rlike("^[0-9]+$"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[str, int] = {}
            for t in b.column("token").to_pylist():
                for g in bigrams(t):
                    count[g[:2]] = count.get(g[:2], 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["gram", "n"])

    # bigrams of a-z, 0-9 and the end: 37 * 37 at most, whatever the data
    rarity = {r["gram"]: r["n"] for r in words.mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    shared = tokens.sparkSession.sparkContext.broadcast(rarity)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, sign = [], []
            for t in b.column("token").to_pylist():
                s = signatures(t, shared.value)
                token += [t] * len(s)
                sign += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.string()), pa.array(sign, pa.int64())], ["token", "sign"])

    made = spread(words).mapInArrow(signed, "token string, sign long")
    other = made.select(F.col("token").alias("other"), "sign")
    pairs = made.join(other, "sign").where((F.col("token") < F.col("other")) & (F.abs(F.length("token") - F.length("other")) <= 2)).select("token", "other").distinct()

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([near(t, u) is not None for t, u in zip(b.column("token").to_pylist(), b.column("other").to_pylist())], pa.bool_()))

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(pairs.repartition(parts).mapInArrow(close, "token string, other string"), "similar")
    return found.unionByName(found.select(F.col("other").alias("token"), F.col("token").alias("other")))


def _glued(tokens: DataFrame) -> DataFrame:
    """(token, other): tokens that are two others run together, with each of the two."""
    cut = F.explode(F.sequence(F.lit(4), F.length("token") - 4)).alias("cut")
    halves = tokens.where((F.length("token") >= 8) & F.col("token").rlike("^[a-z]+$")).select("token", cut).select("token", F.expr("substring(token, 1, cut)").alias("left"), F.expr("substring(token, cut + 1)").alias("right"))
    both = halves.join(tokens.select(F.col("token").alias("left")), "left").join(tokens.select(F.col("token").alias("right")), "right")
    return both.select("token", F.explode(F.array("left", "right")).alias("other"))


def _rarest(rest: list[dict]) -> set[str]:
    """The two rarest tokens, and those that they may be slips of; of nothing the empty one."""
    return {k for y in sorted(rest, key=lambda y: (-y["weight"], y["token"]))[:2] for k in (y["token"], *y["others"])} or {""}


def _acronyms(forms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(form, acronym, start, size): runs of two to eight tokens whose initials some form has as a token."""
    words = forms.select("form", F.filter("tokens", lambda t: ~t.rlike("^[0-9]+$")).alias("w")).where(F.size("w") > 1)
    initials = words.select("form", F.array_join(F.transform("w", lambda t: F.substring(t, 1, 1)), "").alias("i"))
    starts = initials.select("form", "i", F.explode(F.sequence(F.lit(1), F.length("i") - 1)).alias("start"))
    runs = starts.select("form", "i", "start", F.explode(F.sequence(F.lit(2), F.least(F.lit(8), F.length("i") - F.col("start") + 1))).alias("size"))
    runs = runs.select("form", F.expr("substring(i, start, size)").alias("acronym"), (F.col("start") - 1).alias("start"), "size")
    return runs.join(tokens.select(F.col("token").alias("acronym")), "acronym", "left_semi")


def entities(df: DataFrame, column: str) -> DataFrame:
    """(name, entity): one row per distinct spelling that is not blank; entity is the same for spellings of one body."""
    names = df.select(F.col(column).cast("string").alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("rows"))

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [bool(n.strip()) for n in b.column("name").to_pylist()]
            b = b.filter(pa.array(keep, pa.bool_()))
            tokens = [tokens_of(n) for n in b.column("name").to_pylist()]
            ids = [xxhash.xxh3_64_intdigest(" ".join(sorted(t))) - (1 << 63) if t else None for t in tokens]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("rows"), pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.string()))], ["name", "rows", "form", "tokens"])

    names = materialize(names.mapInArrow(formed, "name string, rows long, form long, tokens array<string>"), "names")
    # of several orders of the tokens the one of most rows
    forms = names.where("form is not null").groupBy("form").agg(F.sum("rows").alias("rows"), F.max_by("tokens", F.struct("rows", "name")).alias("tokens"))
    forms = materialize(forms, "forms")
    n_forms = max(1, forms.count())
    exploded = forms.select("form", F.explode(F.array_distinct("tokens")).alias("token"))
    tokens = materialize(exploded.groupBy("token").agg(F.count("*").alias("forms")), "tokens")
    similar = _similar(tokens)
    # the most frequent of a token and those similar to it
    rated = similar.join(tokens.select(F.col("token").alias("other"), F.col("forms").alias("other_forms")), "other")
    kept = rated.join(tokens, "token").where(F.struct("other_forms", "other") > F.struct("forms", "token"))
    also = kept.groupBy("token").agg(F.collect_set("other").alias("others"), F.max("other_forms").alias("most"))
    glued = _glued(tokens).groupBy("token").agg(F.collect_set("other").alias("halves"))
    known = tokens.join(also, "token", "left").join(glued, "token", "left")
    acronyms = materialize(_acronyms(forms, tokens), "acronyms")
    known = known.join(acronyms.select(F.col("acronym").alias("token"), F.lit(True).alias("stands")).distinct(), "token", "left")
    known = known.select("token", "stands", F.log(1 + n_forms / F.greatest("forms", F.coalesce("most", "forms"))).alias("weight"), F.concat(F.coalesce("others", F.array()), F.coalesce("halves", F.array())).alias("others"))
    placed = forms.select("form", F.posexplode("tokens").alias("pos", "token")).join(known, "token")
    weighed = placed.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "weight", "others", "stands"))).alias("t")).join(forms.select("form", "rows"), "form")
    weighed = weighed.join(acronyms.groupBy("form").agg(F.collect_list(F.struct("acronym", "start", "size")).alias("runs")), "form", "left")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for form, rows, t, runs in zip(*[b.column(c).to_pylist() for c in ("form", "rows", "t", "runs")]):
                words, weights = [x["token"] for x in t], [x["weight"] for x in t]
                plain = sorted((x for x in t if not x["token"].isdigit()), key=lambda x: (-x["weight"], x["token"]))
                numbers = " ".join(sorted(w for w in words if w.isdigit()))
                rest = total = sum(x["weight"] ** 2 for x in plain)
                keys: set[str] = set()
                for x in plain:
                    if rest < SHARE * total:
                        break
                    keys |= {x["token"], *x["others"]}
                    rest -= x["weight"] ** 2
                # an acronym and its words meet under it and the rarest token beside it
                typed = [x for x in t if not x["token"].isdigit()]
                for x in typed:
                    if x["stands"]:
                        keys |= {f"\x03{x['token']}\x03{k}" for k in _rarest([y for y in typed if y is not x])}
                for r in runs or ():
                    keys |= {f"\x03{r['acronym']}\x03{k}" for k in _rarest(typed[: r["start"]] + typed[r["start"] + r["size"] :])}
                second = sorted({y for x in plain for y in (x["token"], *x["others"], "\x00" + x["token"][0])})
                for k in keys:
                    for o, v in zip(out, (f"{k}\x01{numbers}", form, words, weights, rows, [s for s in second if s != k] or [""])):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.int64(), pa.list_(pa.string())))], ["key", "form", "words", "weights", "rows", "second"])

    meeting = materialize(weighed.mapInArrow(keyed, "key string, form long, words array<string>, weights array<double>, rows long, second array<string>"), "meetings")
    crowd = meeting.groupBy("key").count().where("count > 1")
    meeting = meeting.join(crowd, "key").withColumn("hot", F.col("count") > SPLIT)
    few = meeting.where("not hot").select("key", "form", "words", "weights", "rows")
    many = meeting.where("hot").select(F.explode("second").alias("also"), "key", "form", "words", "weights", "rows").select(F.concat_ws("\x02", "key", "also").alias("key"), "form", "words", "weights", "rows")

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Form]] = {}
        for b in batches:
            for key, form, words, weights, rows in zip(*[b.column(c).to_pylist() for c in ("key", "form", "words", "weights", "rows")]):
                held.setdefault(key, []).append(Form(form, words, weights, rows))
        a, c, s = [], [], []
        for forms_ in held.values():
            for x, y, found in linked(forms_):
                a.append(x)
                c.append(y)
                s.append([{"t": t, "u": u} for t, u in found])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.list_(pa.struct([("t", pa.string()), ("u", pa.string())])))], ["a", "b", "slips"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed, as the work is in Python
    links = few.unionByName(many).repartition(parts, "key").mapInArrow(resolved, "a long, b long, slips array<struct<t:string,u:string>>").distinct()
    links = materialize(links, "links")
    good = links.where(F.size("slips") == 0).select("a", "b").unionByName(_supported(links.where(F.size("slips") > 0), tokens))
    groups = components(good)
    return names.join(groups.select(F.col("node").alias("form"), "component"), "form", "left").select("name", F.coalesce(F.col("component").cast("string"), F.col("form").cast("string"), F.concat(F.lit("\x00"), "name")).alias("entity"))


def _supported(links: DataFrame, tokens: DataFrame) -> DataFrame:
    """(a, b): the links all of whose slips are slips in context."""
    # each slip from the rarer token to the other, with the forms that have the rarer one
    each = links.select("a", "b", F.posexplode("slips").alias("nth", "s")).select("a", "b", "nth", F.col("s.t").alias("t"), F.col("s.u").alias("u"))
    n = tokens.select("token", "forms")
    each = each.join(n.toDF("t", "nt"), "t").join(n.toDF("u", "nu"), "u")
    swap = F.struct("nu", "u") < F.struct("nt", "t")
    each = each.select("a", "b", "nth", F.when(swap, F.col("u")).otherwise(F.col("t")).alias("t"), F.when(swap, F.col("t")).otherwise(F.col("u")).alias("u"), F.least("nt", "nu").alias("n"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("of"))
    support = each.groupBy("t", "u").agg((F.count_distinct("of") / F.max("n")).alias("share"))
    ok = each.join(support, ["t", "u"]).groupBy("a", "b").agg(F.min("share").alias("share"))
    return ok.where(F.col("share") >= SUPPORT).select("a", "b")


def variants(df: DataFrame, column: str) -> DataFrame:
    """(name_a, name_b), name_a < name_b: all pairs of spellings of one body."""
    found = materialize(entities(df, column), "entities")
    a = found.select("entity", F.col("name").alias("name_a"))
    return a.join(found.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
