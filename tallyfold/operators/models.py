"""Model calls as pluggable batch functions.

A model is a function from a list of records (dicts) to a list of replies, called with at most ``batch`` records at
once inside the tasks. The stand-ins below are deterministic and need no network; they follow the same contracts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.tags import TAXONOMY

Model = Callable[[list[dict]], list[object]]


def called(rows: DataFrame, key: str, model: Model, schema: str, batch: int = 10) -> DataFrame:
    """(key, *schema): replies of a model, one object a record. Records without a reply, or with one that is no object, give
    no row, so that a later left join leaves them untouched and the next run tries again."""
    names = [x.split()[0] for x in schema.split(", ")]
    kind = rows.schema[key].dataType.simpleString()
    target = rows.sparkSession.createDataFrame([], f"{key} {kind}, {schema}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = b.to_pylist()
            out: list[dict] = []
            for i in range(0, len(records), batch):
                part = records[i : i + batch]
                for r, reply in zip(part, model(part)):
                    if isinstance(reply, dict):
                        out.append({key: r[key]} | {n: reply.get(n) for n in names})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, target)


def reply_of(raw: str | None) -> object:
    """A model's text as a value: code fences off; None if it is no JSON."""
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", (raw or "").strip(), flags=re.I)
    try:
        return json.loads(body)
    except ValueError:
        return None


def tag(records: list[dict]) -> list[object]:
    """The causes of the taxonomy whose words a text contains."""
    return [{"tags": "|".join(t for t in TAXONOMY if t.replace("_", " ") in (r["text"] or "").lower())} for r in records]


def judge(records: list[dict]) -> list[object]:
    """Keep or reject, with a category and a reason; records without a title get no reply."""
    out: list[object] = []
    for r in records:
        if not (r["title"] or "").strip():
            out.append(None)
        elif len((r["text"] or "").strip()) < 40:
            out.append({"decision": "reject", "category": "no_content", "reason": "no description"})
        else:
            out.append({"decision": "keep", "category": None, "reason": None})
    return out


def when(records: list[dict]) -> list[object]:
    """Kind and end of a schedule, as a model would read its free text."""
    out: list[object] = []
    for r in records:
        raw = r["raw"] or ""
        day = re.search(r"\d{4}-\d{2}-\d{2}", raw)
        out.append({"kind": "one_time" if day else ("ongoing" if re.search(r"(?i)every|weekly|days\b", raw) else "unclear"), "ends_on": day[0] if day else None})
    return out


def embed(records: list[dict], dims: int = 16) -> list[object]:
    """Signed hashes of a text's words, as a vector of length one."""
    out: list[object] = []
    for r in records:
        v = [0.0] * dims
        for w in re.findall(r"[a-z0-9]+", (r["text"] or "").lower()):
            h = hashlib.md5(w.encode()).digest()
            v[h[0] % dims] += 1.0 if h[1] & 1 else -1.0
        n = sum(x * x for x in v) ** 0.5
        out.append({"vector": [x / n for x in v] if n else v})
    return out


def extract(records: list[dict]) -> list[object]:
    """The list items of a page as listings, joined by bars."""
    return [{"items": "|".join(re.findall(r"(?m)^[-*•] (.+)$", r["text"] or ""))} for r in records]


def investigate(records: list[dict], mini: Model, full: Model) -> list[object]:
    """Two stages: a cheap model looks at all, a better one at what it lets through."""
    first = mini(records)
    passed = [r for r, f in zip(records, first) if isinstance(f, dict) and f.get("promising")]
    second = iter(full(passed))
    return [next(second) if isinstance(f, dict) and f.get("promising") else {"decision": "reject", "confidence": 0.0, "stage": "mini"} for f in first]


def promising(records: list[dict]) -> list[object]:
    return [{"promising": "volunteer" in (r["text"] or "").lower()} for r in records]


def decide(records: list[dict]) -> list[object]:
    return [{"decision": "accept" if (r["text"] or "").lower().count("volunteer") > 1 else "reject", "confidence": round(min(1.0, 0.5 + 0.1 * (r["text"] or "").lower().count("volunteer")), 2), "stage": "full"} for r in records]


def filters_of(query: str, today: str, towns: list[str] = ()) -> dict:
    """What a search line limits, by rules: a town it names, causes, virtual, a month. An inverted window is dropped."""
    low = query.lower()
    months = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    town = next((t for t in sorted(towns, key=len, reverse=True) if re.search(rf"\b{re.escape(t.lower())}\b", low)), None)
    month = next((i for i, m in enumerate(months, 1) if re.search(rf"\b{m}\b", low)), None)
    start = f"{today[:4]}-{month:02d}-01" if month else None
    return checked_filters({"city": town, "causes": [t for t in TAXONOMY if t.replace("_", " ") in low], "virtual": True if re.search(r"\b(virtual|remote|online)\b", low) else None, "date_start": start, "date_end": f"{today[:4]}-{month:02d}-28" if month else None})


def checked_filters(raw: object) -> dict:
    """A parsed reply made safe: unknown causes, malformed dates and inverted windows dropped, causes once each."""
    f = raw if isinstance(raw, dict) else {}
    iso = re.compile(r"^\d{4}-\d{2}-\d{2}$")
    start, end = (x if isinstance(x, str) and iso.match(x) else None for x in (f.get("date_start"), f.get("date_end")))
    if start and end and start > end:
        start = end = None
    causes = list(dict.fromkeys(c for c in f.get("causes") or [] if c in TAXONOMY)) if isinstance(f.get("causes"), list) else []
    city = f.get("city")
    return {"city": city.strip() or None if isinstance(city, str) else None, "causes": causes, "virtual": f.get("virtual") if isinstance(f.get("virtual"), bool) else None, "date_start": start, "date_end": end}


def answer_of(raw: str | None, hits: int) -> dict:
    """A grounded answer and the places it picks; a reply that is no envelope is the answer itself and picks nothing."""
    got = reply_of(raw)
    if not isinstance(got, dict) or not isinstance(got.get("answer"), str):
        return {"answer": (raw or "").strip(), "picks": None}
    picks = [p for p in got.get("picks") or [] if isinstance(p, int) and not isinstance(p, bool) and 1 <= p <= hits] if isinstance(got.get("picks"), list) else []
    return {"answer": got["answer"].strip(), "picks": list(dict.fromkeys(picks))}


def stamped(rows: DataFrame, replies: DataFrame, key: str, column: str, fallback: object = None) -> DataFrame:
    """Replies joined back by key; rows without one keep the fallback."""
    return rows.join(replies, key, "left").withColumn(column, F.coalesce(F.col(column), F.lit(fallback)))
