"""Sentence boundaries across languages and scripts (problem 9) by a hidden-event language model.

Lines come first: list items and headings are units of their own, the other lines form paragraphs. Between the words of
a paragraph stand hidden events, boundary or none; the model is an n-gram model with the event as a token:

    P(event | word before with its mark)  x  P(word after | event)  x  P(word next to it | event)

Words after are taken as typed, so that case is part of what the model sees; unknown words back off to their shape (script
and case), unknown words before to their mark, quote and the shape of what follows. Candidates that follow each other at once such as
"J. R." form a chain, whose event depends on the one before; a forward-backward pass over the chain gives the
posteriors. Those above one half are boundaries.

Where a paragraph has marks, an event without any is none: its candidates are the gaps at end marks (with closing quotes), also where
the space is missing, and in Thai at spaces. Speech in quotes or brackets is no place for a gap. A paragraph without any mark has events
between all of its words; their counts (``WORDS``) come from all words of all texts, case and punctuation put aside. Thai
without spaces has them between all characters, with the characters before and after as words.
Chinese and Japanese without marks stay whole: nothing is learnt of their boundaries within runs.

All counts are expected counts over the whole corpus, from ROUNDS of estimation. The first round begins with a guess from marks,
case and the word lists below; the lists have no other part. Counts are kept in tables of 2**CELL_BITS cells, so the
model has the same size however large the corpus is. Texts are read once: what the model needs of every
candidate is written to a table, over which the rounds and the decision run as array operations.

Null texts, null keys and texts of nothing but white space give no row. Repeated rows give their rows again.
Texts of any length are cut in whole. Unclosed quotes are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.storage import materialize, spread

CELL_BITS = 18
ROUNDS = 2
CLOSERS = "\"'”’»›」』）)]】》〉“"
OPENERS = "\"'“‘«‹「『（([【《〈„¿¡—–-"
STRONG = "!?！？。｡؟।॥"
ENDS = STRONG + ".…"
PAIRS = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "‘": "’"}
OPENING = re.compile('[“«‹「『（(\\[【《〈‘„"]')
MARKS = re.compile("[" + re.escape("".join([*PAIRS, *PAIRS.values(), '"'])) + "]")
#: Short words that a point may follow without ending a sentence, where the model starts from. Fixed values.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof rev sgt capt lt col gen st ft mt ave rd blvd jr sr inc co corp assn dept vs approx sq sec no nos p pp vol fig ed eds e.g i.e eg ie cf al u.s u.k a.m p.m am pm jan feb mar apr jun jul aug sept sep oct nov dec "
    "mon tue tues wed thu thur thurs fri sat sun mo lb lbs oz min hr hrs tel ext "
    "m mm mme mmes mlle env ex av bd p.ex c.-à-d nr hr fr hrn bzw ca usw z b d h u a s vgl evtl ggf inkl str tel abs "
    "sra srta sres ud uds vd vds núm num pág págs ej a.m p.m ee uu dña d डॉ श्री कु स्व प्रो د أ م ดร น พ.ศ ค.ศ".split()
)
#: Of these, the ones that also stand at the end of a sentence. Fixed values.
EITHER = frozenset("etc usw a.m p.m am pm inc co corp jr sr u.s u.k st ave rd ft m h no al min hr mo lb".split())
#: Of these, the ones that end a sentence where a capital follows. Fixed values.
FINAL = frozenset("etc usw a.m p.m am pm".split())
#: Month names that a number with a point may stand before. Fixed values.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember januari februari mars maj juni juli augusti oktober".split())
CLOSING = CLOSERS.replace("“", "")  # which closes only what „ opened
SHUT = re.compile(rf"\s*[{re.escape(CLOSERS)}]*\s*")
SPACE = re.compile(r"\s*")
DASHES = re.compile("[—– ]*")
LEADING = re.compile(rf"[{re.escape(OPENERS)} \n\r\t\u00a0\u202f]*")
CANDIDATE = re.compile(rf"[{re.escape(ENDS)}]+[{re.escape(CLOSING)}]*")
LIST_ITEM = re.compile(r"\s*(?:[-*•·‣▪◦]\s+\S|\(?(\d{1,3})[.)]\s+\S|\(?[a-z]\)\s+\S)")
WORD = re.compile(r"\S+")
_CJK = r"⺀-鿿가-힯豈-﫿＀-￯"
CJK = re.compile(f"[{_CJK}]")
THAI = re.compile(r"[฀-๿]")
MASK = (1 << CELL_BITS) - 1


def _cell(kind: str, *parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join((kind, *parts))) & MASK


def script(word: str) -> str:
    """The script of a word, told by its first letter's block."""
    c = word[:1]
    if THAI.match(c):
        return "thai"
    if CJK.match(c) or "\u3040" <= c <= "\u30ff":
        return "east"
    return "latin" if c < "\u0370" else str(ord(c[0]) >> 7)


class Gap:
    """A candidate: the place after its end mark, the words around it as the model sees them, and the first guess."""

    __slots__ = ("at", "left", "right", "next", "kind", "prior", "chained")

    def __init__(self, at: int, left: str, right: str, next_: str, kind: str, prior: float, chained: bool):
        self.at, self.left, self.right, self.next, self.kind, self.prior, self.chained = at, left, right, next_, kind, prior, chained


def lines_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of runs of lines: item, heading or text (a paragraph, or a line of Thai)."""
    lines = []
    at = 0
    for line in re.split("(\r\n|[\n\r  \u0085\x0b\x0c])", text):
        if line and line.strip("\n\r  \u0085\x0b\x0c"):
            lines.append((at, at + len(line), line))
        elif line and len(line) <= 2 and not line.strip():
            lines.append((at, at, ""))  # a break; a line between two of them is empty
        at += len(line)
    # (start, end, line); consecutive breaks mean a blank line
    rows: list[tuple[int, int, str]] = []
    breaks = 0
    for start, end, line in lines:
        if not line:
            breaks += 1
            if breaks == 2:
                rows.append((start, start, ""))
            continue
        if line.strip():
            rows.append((start, end, line))
        elif rows and rows[-1][2]:
            rows.append((start, start, ""))
        breaks = 0
    widest = max((len(r[2].rstrip()) for r in rows), default=0)
    out: list[tuple[int, int, str]] = []
    open_ = False  # a paragraph line without end mark came before
    for i, (start, end, line) in enumerate(rows):
        if not line:
            open_ = False
            out.append((start, start, "break"))
            continue
        body = line.strip()
        ended = _ends(body)
        m = LIST_ITEM.match(line)
        if m and (not open_ or m[1] is None):
            kind, open_ = "item", False
        elif not open_ and not ended and _is_heading(body, rows[i + 1][2].strip() if i + 1 < len(rows) else None, widest):
            kind, open_ = "heading", False
        else:
            kind, open_ = "text", not ended
        if kind == "text" and out and out[-1][2] == "text" and not (THAI.search(body) and THAI.search(text[out[-1][0] : out[-1][1]][-12:] + body[:12])):
            out[-1] = (out[-1][0], end, "text")
        else:
            out.append((start, end, kind))
    return [r for r in out if r[2] != "break"]


def _ends(body: str) -> bool:
    return bool(re.search(rf"[{re.escape(ENDS)}:：;][{re.escape(CLOSERS)}]*$", body))


def _is_heading(body: str, following: str | None, widest: int) -> bool:
    if len(body) > 60 or len(body.split()) > 8 or body.endswith((",", "،", "，", "、")) or re.search(r"[a-zß-ÿ]{3,}[.!?](?:\s|[A-ZÀ-Þ])|[。！？]", body):
        return False  # a whole sentence lies in it
    if not following:
        return True
    first = following.split()[0]
    if following[0].islower() and not body[0].islower():
        return False
    # a line that was broken for width had no room for the next word
    return CJK.search(body) is not None or len(body) + 1 + len(first) <= 0.8 * max(widest, 50)


def shielded(text: str) -> list[tuple[int, int]]:
    """Spans from an opening quote or bracket to behind its partner, outermost ones, in order. A partner is sought to the
    end of the text, which is a paragraph: all are found in one pass, with a stack for each kind of bracket."""
    n = len(text)
    partner: dict[int, int] = {}
    stacks: dict[str, list[int]] = {close: [] for close in PAIRS.values()}
    low, straight = [], []  # what may close „ and "
    for m in MARKS.finditer(text):
        j, c = m.start(), m.group()
        if c in PAIRS:
            stacks[PAIRS[c]].append(j)
        elif stacks.get(c):
            partner[stacks[c].pop()] = j
        if c in "“”\"":
            low.append(j)
        if c == '"' and j and not text[j - 1].isspace() and (j + 1 == n or not text[j + 1].isalnum()):
            straight.append(j)
    out: list[tuple[int, int]] = []
    i = 0
    while m := OPENING.search(text, i):
        i, c = m.start(), m.group()
        end = -1
        if c in PAIRS and not (c == "‘" and i and text[i - 1].isalnum()):
            end = partner.get(i, -2) + 1
        elif c == "„" or c == '"' and (i == 0 or text[i - 1].isspace() or text[i - 1] in "([—–-:,"):
            closers = low if c == "„" else straight
            k = bisect_right(closers, i)
            end = closers[k] + 1 if k < len(closers) else -1
        if end > 0:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out


NUMBER = re.compile(r"\d+(?:[., ]\d+)*")
AROUND = OPENERS + CLOSERS + ",;:"
LEFT_CHARS, RIGHT_CHARS = 6, 6  # of scripts without spaces: so many characters count as a word


def _token(word: str) -> str:
    """A word as the model sees it on the left: folded, numbers as one, without quotes around."""
    return NUMBER.sub("0", word.strip(AROUND).casefold()) or word[:1]


def _shape(word: str) -> str:
    """Script and case of a word's first letter: what is known of a word never seen."""
    c = word[:1]
    return script(word) + ("U" if c.isupper() else "l" if c.islower() else "0" if c.isdigit() else "-")


def _word_before(part: str, end: int) -> str:
    """The run of characters before a place, back to white space or a character of a script without spaces."""
    at = end
    while at and not (c := part[at - 1]).isspace() and not "\u2e80" <= c <= "\uffef":
        at -= 1
    return part[at:end]


def gaps_of(text: str, start: int, end: int) -> list[Gap]:
    """The candidates of a paragraph in order; the paragraph's end is none."""
    part = text[start:end]
    spans = shielded(part)
    upper = sum(map(str.isupper, part))
    cased = 0 < upper < 0.7 * (upper + sum(map(str.islower, part)))
    out: list[Gap] = []
    k = 0
    last = 0
    tail = len(part.rstrip())
    for m in CANDIDATE.finditer(part):
        mark, at = m.group(), m.end()
        while k < len(spans) and spans[k][1] < m.start() + 1:
            k += 1
        inside = next((s for s in spans[k : k + 2] if s[0] < m.start() < s[1]), None)
        if inside:
            # the end mark before the closing quote may end the sentence around it
            if m.end() < inside[1] and not SHUT.fullmatch(part, m.end(), inside[1]):
                continue
            at = inside[1]
            if CANDIDATE.match(part, at):  # a further mark behind the quote comes on its own
                continue
        if at >= tail:
            break
        if out and start + at <= out[-1].at:
            continue
        next_ = SPACE.match(part, at).end()
        spaced = next_ > at
        lead = LEADING.match(part, next_).end()
        head = part[lead : lead + 1]
        word = _word_before(part, m.start())
        token = _token(word) if word else part[max(0, m.start() - 2) : m.start()]
        if token == "0":
            ahead = m.start() - len(word)
            while ahead and part[ahead - 1].isspace():
                ahead -= 1
            if before := _word_before(part, ahead):
                token = f"{_token(before)} 0"
        stop = part[next_ : next_ + 1]
        if stop and stop in ",;:，；：、،؛)）":
            continue
        if not spaced and not inside:
            east = CJK.search(part[m.start() - 1 : m.start()]) or CJK.search(stop) or mark[0] in "。！？"
            glued = head.isupper() and len(word) > 1 and word[-1:].islower() and not re.search(r"[@/]|www", word)
            if "." in mark and not east and not glued:
                continue
            if mark[0] in "!?" and not east and not glued and not (head.isdigit() or stop in OPENERS):
                continue
            if "." in mark and east and not inside:
                continue
        elif not spaced and inside and not (CJK.search(stop) or head.isupper() or mark[0] in "。！？।؟"):
            continue
        right = WORD.match(part, lead)
        rtok = NUMBER.sub("0", right.group().strip(AROUND)).rstrip(".!?…") if right else head
        if CJK.search(rtok):
            rtok, more = rtok[:2], rtok[2:4]
        elif right:
            more = WORD.search(part, right.end())
            more = NUMBER.sub("0", more.group()) if more else ""
        else:
            more = ""
        chained = bool(out) and out[-1].at > start + m.start() - len(word) - 3 and not inside
        lower = head.islower() and cased and (right is None or right.group().islower() or not any(map(str.isupper, right.group())))
        told = ""
        if inside:
            opened = part[last : inside[0]].strip()
            told = "”" if not opened else ("i”" if opened[-1] in ":：,，、" else "m”")
        dashed = stop in "—–" and stop != "" and part[(d := DASHES.match(part, next_).end()) : d + 1].islower()
        prior = _prior(mark, token, stop, dashed, head, rtok.casefold(), lower, told, bool(inside) and part[inside[0]] in "(（[【")
        kind = f"{mark[:1]}{len(mark) > 1}{told}{_shape(rtok)}{spaced}{lower}{token[-1:] == '0'}"
        out.append(Gap(start + at, token + mark[:1] + told, rtok, more, kind, prior, chained))
        if prior > 0.5:
            last = at
    if THAI.search(part):
        out = _with_spaces(part, start, spans, out)
    return out


def _prior(mark: str, token: str, stop: str, dashed: bool, head: str, right: str, low: bool, told: str, bracket: bool) -> float:
    """What the marks and the case of a candidate suggest before anything is counted. told: how a quote began, if
    one ends here: with the sentence, introduced by a colon or comma, or in its midst."""
    caseless = not (head.isupper() or head.islower())
    if told:
        if bracket:
            return 0.02 if low or told != "”" else 0.7
        if stop in "—–-" or low:
            return 0.01
        if told == "”":  # who says it comes after
            return 0.05 if caseless and not head.isdigit() else 0.6
        return 0.97 if told == "i”" else 0.3
    if dashed:
        return 0.01
    if "…" in mark or ".." in mark:
        return 0.02 if low else (0.1 if caseless else 0.8)
    if mark[0] in STRONG:
        return 0.05 if low else 0.995
    short = token.strip(".")
    if short in FINAL:
        return 0.02 if low else (0.5 if caseless else 0.9)
    if short in ABBREVIATIONS or (len(short) == 1 and short.isalpha()):
        return 0.01 if low else (0.3 if short in EITHER and not caseless else 0.03)
    if token.endswith("0") and not caseless:
        return 0.1 if low else (0.03 if right in MONTHS else 0.9)
    return 0.1 if low else 0.97


def _with_spaces(part: str, start: int, spans: list[tuple[int, int]], marked: list[Gap]) -> list[Gap]:
    """Thai sentences end at a space; one beside a number, a quote or an abbreviation hardly does."""
    taken = {g.at for g in marked}
    out = list(marked)
    for m in re.finditer(r"\s+", part.rstrip()):
        at = m.start()
        if start + at in taken or not at or any(a < at < b for a, b in spans):
            continue
        before, after = part[at - 1], part[m.end() : m.end() + 1]
        if not (THAI.match(before) or THAI.match(after)):
            continue
        inner = before.isdigit() or after.isdigit() or before in ".,:" or after in OPENERS or before in CLOSERS or not (THAI.match(before) and THAI.match(after))
        left = part[max(0, at - LEFT_CHARS) : at].split()[-1]
        right = part[m.end() : m.end() + RIGHT_CHARS].split()[0]
        more = part[m.end() + RIGHT_CHARS : m.end() + 2 * RIGHT_CHARS]
        wide = "\n" in m.group() or len(m.group()) > 1
        prior = (0.97 if wide else 0.9) if not inner else (0.3 if wide and not after.isdigit() and before not in ".,:" and after not in OPENERS else 0.02)
        kind = f"_{inner}{wide}{_shape(before)}{_shape(after)}"
        out.append(Gap(start + at, "_" + _token(left), _token(right), more, kind, prior, False))
    out.sort(key=lambda g: g.at)
    return out


#: Tables of expected counts: what stands before a gap, by event; what stands after, word and shape, by event; kinds of gaps by event; the word next to it by event. Then the words of all texts, case and marks put aside: ends, all, starts, pairs within sentences.
KINDS = ("left1", "left0", "right1", "right0", "kind1", "kind0", "next1", "next0")
WORDS = ("end", "word", "start", "pair")
TRUST = 4.0  # a guess or a backed-off probability counts as so many observations
WEIGHT = 0.5  # of what stands after against what stands before: the two words after tell much the same
BESIDE = 20  # characters without a boundary between them to one with
UNSEEN = 1e-3  # share of a shape that one word never seen takes, whatever the event
#: What the parser writes of a document.
PARSED = "key long, unit_from array<int>, unit_to array<int>, unit array<int>, upto array<int>, onward array<int>, left array<int>, right array<int>, next array<int>, kind array<int>, shape array<int>, chain array<int>, prior array<float>, sort array<tinyint>"
MARKED, WORDY, UNSPACED = 0, 1, 2  # sorts of gaps: at marks and spaces, between words, between characters


@lru_cache(1 << 18)
def _left_cells(left: str) -> tuple[int, int]:
    return _cell("l", left), _cell("l", "\x01" + left)


@lru_cache(1 << 18)
def _right_cells(right: str) -> tuple[int, int]:
    return _cell("r", right), _cell("s", _shape(right))


@lru_cache(1 << 18)
def _next_cell(word: str) -> int:
    return _cell("x", word)


@lru_cache(1 << 18)
def _plain(word: str) -> int:
    """The cell of a word of running text, case and marks put aside."""
    return _cell("w", NUMBER.sub("0", word.strip(AROUND + ENDS).casefold()))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cells of pairs of cells."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def parsed(text: str) -> list[list]:
    """The columns of PARSED after the key, for one text."""
    unit_from, unit_to, rows = [], [], []
    for start, end, kind in lines_of(text):
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if a == b:
            continue
        u = len(unit_from)
        unit_from.append(a)
        unit_to.append(b)
        if kind != "text":
            continue
        gaps = gaps_of(text, start, end)
        for i, g in enumerate(gaps):
            left, linked = _left_cells(g.left)
            right, shape = _right_cells(g.right)
            next_ = _next_cell(g.next)
            at = g.at
            before = at
            while before > a and text[before - 1].isspace():
                before -= 1
            while at < b and text[at].isspace():
                at += 1
            rows.append((u, before, at, left, right, next_, linked if g.chained and i else -1, _cell("k", g.kind), shape, g.prior, MARKED))
        if not gaps and not CANDIDATE.search(text, start, end):
            rows += _unmarked(text, a, b, u)
    cols = list(zip(*rows)) if rows else [()] * 11
    unit, before, at, left, right, next_, linked, kinds, shape, prior, sort = cols
    return [unit_from, unit_to, unit, before, at, left, right, next_, linked, kinds, shape, prior, sort]


def _inner(run: str) -> Iterator[tuple[int, int, int]]:
    """(place, cell before, cell after) of all places within a run of unspaced script; near its ends fewer characters stand beside."""
    for at in range(1, len(run)):
        if unicodedata.category(run[at]) != "Mn":
            yield at, _left_cells("_" + _token(run[max(0, at - LEFT_CHARS) : at]))[0], _right_cells(_token(run[at : at + RIGHT_CHARS]))[0]


def _unmarked(text: str, a: int, b: int, u: int) -> list[tuple]:
    """The events of a paragraph without marks: between all its words, whatever stands beside, and within Thai words between all
    characters."""
    part = text[a:b]
    words = [(m.start(), m.end()) for m in WORD.finditer(part)]
    out: list[tuple] = []
    for i, (s, e) in enumerate(words):
        if i:
            out.append((u, a + words[i - 1][1], a + s, _plain(part[words[i - 1][0] : words[i - 1][1]]), _plain(part[s:e]), 0, -1, 0, 0, 0.0, WORDY))
        if THAI.search(part, s, e):
            out += [(u, a + s + at, a + s + at, left, right, 0, -1, 0, 0, 0.0, UNSPACED) for at, left, right in _inner(part[s:e])]
    return out


class Model:
    """Expected counts around gaps, in tables of fixed size."""

    def __init__(self, tables: np.ndarray, words: np.ndarray | None = None):
        self.t = dict(zip(KINDS, tables))
        self.w = dict(zip(WORDS, words)) if words is not None else None
        self.n1, self.n0 = (max(1.0, float(self.t[k].sum()) / 2) for k in ("right1", "right0"))

    def tables(self) -> tuple[np.ndarray, np.ndarray | None]:
        return np.stack([self.t[k] for k in KINDS]), None if self.w is None else np.stack([self.w[k] for k in WORDS])

    def event(self, left: np.ndarray, kind: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """P(boundary | word before), backing off to the kind of gap, and from there to the first guess."""
        one, none = self.t["kind1"][kind], self.t["kind0"][kind]
        known = (one + TRUST * prior) / (one + none + TRUST)
        one, none = self.t["left1"][left], self.t["left0"][left]
        return np.clip((one + TRUST * known) / (one + none + TRUST), 1e-3, 1 - 1e-3)

    def after(self, event: int, right: np.ndarray, shape: np.ndarray, next_: np.ndarray) -> np.ndarray:
        """P(the two words after | event), the first backing off to its shape."""
        t, u, n = self.t[f"right{event}"], self.t[f"next{event}"], (self.n0, self.n1)[event]
        first = (t[right] + TRUST * UNSEEN * (t[shape] + 1) / (n + 1)) / (n + TRUST)
        return (first * (u[next_] + TRUST) / (n + TRUST)) ** WEIGHT

    def between_words(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """P(boundary) between two words without a mark."""
        n = max(1.0, float(self.w["word"].sum()))
        ends = max(1.0, float(self.w["start"].sum()))
        rate = ends / n
        end = (self.w["end"][left] + TRUST * rate) / (self.w["word"][left] + TRUST)
        start = (self.w["start"][right] + TRUST * 1e-5) / (ends + TRUST)
        within = (self.w["word"][right] - self.w["start"][right] + TRUST * 1e-5).clip(1e-5) / (n - ends + TRUST)
        pair = self.w["pair"][_mixed(left, right)]
        go = (pair + TRUST * within) / (self.w["word"][left] - self.w["end"][left] + TRUST)
        one, none = end * start, (1 - end) * go
        return one / (one + none)

    def between_characters(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """P(boundary) between two characters of unspaced script: what stands around as end and start of sentences, against how
        often both stand side by side within spaces."""
        n = max(1.0, float(self.t["right1"][_cell("s", _shape("ก"))]))  # sentences of this script
        one = self.t["left1"][left] * self.t["right1"][right] / n
        none = BESIDE * (self.w["pair"][_mixed(left, right)] + 1)
        return one / (one + none)


def posteriors(g: dict[str, np.ndarray], model: Model | None) -> np.ndarray:
    """P(boundary) of every gap. Gaps in chains (``chain``: the cell of the word before where the gap before is a boundary) go
    through a forward-backward pass, the others have their posterior at once."""
    if model is None:
        return g["prior"].astype(np.float64)
    p = model.event(g["left"], g["kind"], g["prior"])
    none, one = (1 - p) * model.after(0, g["right"], g["shape"], g["next"]), p * model.after(1, g["right"], g["shape"], g["next"])
    out = one / (one + none)
    chained = g["chain"] >= 0
    if chained.any():
        q = np.where(chained, model.event(np.maximum(g["chain"], 0), g["kind"], g["prior"] * 0.5), p)
        after = np.flatnonzero(chained)
        first = after[~chained[after - 1]] - 1
        for a in first.tolist():
            b = a + 1
            while b < len(p) and chained[b]:
                b += 1
            out[a:b] = _forward_backward(p[a:b], q[a:b], none[a:b] / (1 - p[a:b]), one[a:b] / p[a:b])
    if model.w is not None:
        for sort, rated in ((WORDY, model.between_words), (UNSPACED, model.between_characters)):
            at = np.flatnonzero(g["sort"] == sort)
            if len(at):
                out[at] = _spaced_out(rated(g["left"][at], g["right"][at]), g["unit"][at])
    return out


def _forward_backward(p: np.ndarray, q: np.ndarray, go: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posteriors of a chain: p and q are P(boundary) after no boundary and after one."""
    n = len(p)
    ahead = []
    a = (1.0, 0.0)
    for i in range(n):
        x = (a[0] * (1 - p[i]) + a[1] * (1 - q[i])) * go[i], (a[0] * p[i] + a[1] * q[i]) * start[i]
        a = (x[0] / (x[0] + x[1]), x[1] / (x[0] + x[1]))
        ahead.append(a)
    back, out = (1.0, 1.0), np.empty(n)
    for i in range(n - 1, -1, -1):
        none, one = ahead[i][0] * back[0], ahead[i][1] * back[1]
        out[i] = one / (none + one)
        x = ((1 - p[i]) * go[i] * back[0] + p[i] * start[i] * back[1], (1 - q[i]) * go[i] * back[0] + q[i] * start[i] * back[1])
        back = (x[0] / (x[0] + x[1]), x[1] / (x[0] + x[1]))
    return out


def _spaced_out(p: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The chain of events between all words: hardly ever do two boundaries follow each other at once."""
    out = p.copy()
    edges = np.append(np.flatnonzero(np.diff(unit, prepend=-1)), len(p))
    for a, b in zip(edges, edges[1:]):
        if (p[a:b] > 0.01).any():
            x = np.clip(p[a:b], 1e-9, 1 - 1e-9)
            # the word's own evidence as emission; the event depends on the event before
            out[a:b] = _forward_backward(np.full(b - a, 0.5), np.full(b - a, 0.02), 1 - x, x)
    return out


COLUMNS = tuple(c.split()[0] for c in PARSED.split(", "))


def _arrays(b: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The gaps of a batch as flat arrays, with the first gap and the first unit of every document."""
    lists = {c: b.column(c) for c in COLUMNS[1:]}
    g = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
    offsets = [np.concatenate([[0], np.cumsum(pc.list_value_length(lists[c]).to_numpy(zero_copy_only=False).astype(np.int64))]) for c in ("unit", "unit_from")]
    if len(g["unit"]):  # units are numbered through the batch
        g["unit"] = g["unit"] + np.repeat(offsets[1][:-1], np.diff(offsets[0]))
    return g, offsets[0], offsets[1]


def _sums(tables: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = tables.ravel()
    at = np.flatnonzero(flat)
    for i in range(0, len(at), 50_000):
        p = at[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(flat[p])], ["cell", "n"])


def _summed(df: DataFrame, n_tables: int) -> np.ndarray:
    """The tasks' tables added up; six decimals, so that sums do not depend on the order of the tasks."""
    got = df.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # tables of a fixed size
    flat = np.zeros(n_tables * (MASK + 1))
    flat[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return np.round(flat, 6).astype(np.float32).reshape(n_tables, -1)


def _counted(g: dict[str, np.ndarray], p: np.ndarray, t: np.ndarray) -> None:
    """Add the expected counts of a batch of gaps."""
    at = np.flatnonzero(g["sort"] == MARKED)
    if not len(at):
        return
    p, x = p[at], {c: g[c][at] for c in ("left", "right", "next", "kind", "shape", "chain")}
    size = MASK + 1
    for one, weight in ((1, p), (0, 1 - p)):
        t[0 if one else 1] += np.bincount(x["left"], weight, size)
        t[2 if one else 3] += np.bincount(x["right"], weight, size) + np.bincount(x["shape"], weight, size)
        t[6 if one else 7] += np.bincount(x["next"], weight, size)
        t[4 if one else 5] += np.bincount(x["kind"], weight, size)
    c = np.flatnonzero(x["chain"] >= 0)
    if len(c):
        before = p[c - 1]
        t[0] += np.bincount(x["chain"][c], p[c] * before, size)
        t[1] += np.bincount(x["chain"][c], (1 - p[c]) * before, size)


def parse(df: DataFrame, key: str, text: str) -> DataFrame:
    """PARSED of every text, a written table."""
    picked = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key is not null and text is not null")
    kinds = {"array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()), "array<tinyint>": pa.list_(pa.int8()), "long": pa.int64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in PARSED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                cols = list(zip(*[parsed(x) for x in part.column("text").to_pylist()]))
                flat = dict(zip(("unit_from", "unit_to", "unit", "upto", "onward", "left", "right", "next", "chain", "kind", "shape", "prior", "sort"), cols))
                yield pa.RecordBatch.from_arrays([part.column("key"), *[pa.array(flat[f.name], f.type) for f in list(schema)[1:]]], schema=schema)

    return materialize(spread(picked).mapInArrow(run, PARSED), "gaps")


def count_words(df: DataFrame, text: str) -> np.ndarray:
    """WORDS over all texts: split and coded by Arrow, only a batch's different words are looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros((len(WORDS), MASK + 1))
        for b in batches:
            lists = pc.utf8_split_whitespace(b.column("text"))
            coded = lists.flatten().dictionary_encode()
            names = coded.dictionary.to_pylist()
            if not names:
                continue
            cells = np.array([_plain(w) for w in names], np.int64)
            marks = np.array([w.rstrip(CLOSERS)[-1:] in ENDS and w.rstrip(CLOSERS) != "" for w in names])
            code = coded.indices.to_numpy()
            for n, w in zip(np.bincount(code, minlength=len(names)).tolist(), names):
                if THAI.search(w):
                    for _, left, right in _inner(w):
                        t[3][_mixed(np.array([left]), np.array([right]))[0]] += n
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            cell, end = cells[code], marks[code]
            next_ = np.flatnonzero(doc[1:] == doc[:-1])
            ends = end[next_]
            size = MASK + 1
            t[0] += np.bincount(cell[next_], ends, size)
            t[1] += np.bincount(cell[next_], minlength=size)
            t[2] += np.bincount(cell[next_ + 1], ends, size)
            t[3] += np.bincount(_mixed(cell[next_], cell[next_ + 1]), ~ends, size)
        yield from _sums(t)

    texts = df.select(F.col(text).cast("string").alias("text")).where("text is not null")
    return _summed(texts.mapInArrow(run, "cell int, n double"), len(WORDS))


def fit(gaps: DataFrame, words: np.ndarray | None, rounds: int = ROUNDS) -> Model | None:
    """The model of a corpus: expected counts over all its gaps, summed by Spark, round by round."""
    model = None
    sc = gaps.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(None if model is None else model.tables())

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = Model(*shared.value) if shared.value is not None else None
            t = np.zeros((len(KINDS), MASK + 1))
            for b in batches:
                g, _, _ = _arrays(b)
                if len(g["unit"]):
                    _counted(g, posteriors(g, now), t)
            yield from _sums(t)

        model = Model(_summed(gaps.mapInArrow(count, "cell int, n double"), len(KINDS)), words)
    return model


def _cut(g: dict[str, np.ndarray], p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, start, end) of the sentences of a batch."""
    at = np.flatnonzero(p > 0.5)
    units = np.arange(len(g["unit_from"]))
    unit = np.concatenate([units, g["unit"][at]]) if len(at) else units
    start = np.concatenate([g["unit_from"], g["onward"][at]])
    order = np.lexsort((start, unit))
    unit, start = unit[order], start[order]
    # a sentence reaches to the next boundary of its unit, or to the unit's end
    stop = np.concatenate([g["unit_to"], g["upto"][at]])
    stop_unit = np.concatenate([units, g["unit"][at]]) if len(at) else units
    stop = stop[np.lexsort((stop, stop_unit))]
    keep = start < stop
    return unit[keep], start[keep], stop[keep]


def cut(text: str, model: Model | None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text."""
    cols = dict(zip(("unit_from", "unit_to", "unit", "upto", "onward", "left", "right", "next", "chain", "kind", "shape", "prior", "sort"), parsed(text)))
    g = {k: np.array(v, np.float64 if k == "prior" else np.int64) for k, v in cols.items()}
    _, start, end = _cut(g, posteriors(g, model) if len(g["unit"]) else np.zeros(0))
    return list(zip(start.tolist(), end.tolist()))


def sentences(df: DataFrame, key: str, text: str, rounds: int = ROUNDS) -> DataFrame:
    """(key, start_at, end_at): one row per sentence of every text."""
    gaps = parse(df, key, text)
    model = fit(gaps, count_words(df, text), rounds)
    shared = df.sparkSession.sparkContext.broadcast(None if model is None else model.tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Model(*shared.value) if shared.value is not None else None
        for b in batches:
            g, _, first = _arrays(b)
            unit, start, end = _cut(g, posteriors(g, now) if len(g["unit"]) else np.zeros(0))
            keys = np.repeat(b.column("key").to_numpy(), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(keys[unit], pa.int64()), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["key", "start_at", "end_at"])

    return gaps.mapInArrow(run, "key long, start_at long, end_at long")
