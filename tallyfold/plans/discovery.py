"""Finding bodies that are not covered yet: triage, investigation in two stages, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.operators import models, triage


def proposed(candidates: DataFrame, blocklist: DataFrame, ledger: DataFrame, domains: DataFrame, names: DataFrame, mini: models.Model = models.promising, full: models.Model = models.decide) -> DataFrame:
    """(id, confidence) of the candidates (id, name, url, text) that pass triage and both models, the best ten."""
    kept = triage.triaged(candidates, blocklist, ledger, domains, names).where(F.col("reason") == "keep").select("id")
    pages = candidates.join(kept, "id", "left_semi").select("id", "text")
    verdicts = models.called(pages, "id", lambda r: models.investigate(r, mini, full), "decision string, confidence double, stage string")
    return triage.accepted(verdicts).select("id", "confidence")
