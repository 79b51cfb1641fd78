"""A search from the typed line to the picked listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators import models, search

MOST_CHARACTERS = 300


def answer(corpus: DataFrame, line: str, embed: Callable[[str], list[float]], today: str, towns: list[str] = (), reply: Callable[[str], str] | None = None) -> tuple[DataFrame, dict]:
    """(hits with their rank, the answer): filters are read from the line, the ladder finds hits, a model may pick some."""
    line = line.strip()
    if not line or len(line) > MOST_CHARACTERS:
        raise ValueError(f"a search line has 1 to {MOST_CHARACTERS} characters")
    f = models.filters_of(line, today, list(towns))
    filters = search.Filters(city=f["city"], causes=tuple(f["causes"]), virtual=f["virtual"], date_start=f["date_start"], date_end=f["date_end"], today=today)
    hits, _ = search.relaxed(corpus, embed(line), line, filters)
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # sixteen rows
    if reply is None:
        return ranked, {"answer": "", "picks": None}
    shown = ranked.orderBy("rank").collect()
    got = models.answer_of(reply("\n".join(f"[{r['rank']}] {r['id']}" for r in shown)), len(shown))
    return (ranked if got["picks"] is None else search.picked(ranked, got["picks"])), got
