"""Retraining: search on old and new rows, then save the next version."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..sources.registry import ModelStore, with_newer
from .tuning import SearchResult, search


def update_model(store: ModelStore, name: str, df: DataFrame, features: Sequence[str], label: str, id_col: str,
                 now: dt.datetime | None = None, **settings) -> tuple[int, SearchResult]:
    """Search on the rows of the latest version and the new rows ``df``, save as the next version, and log the event.

    Of rows with one id the new one counts. The new rows are kept with the
    version, which names the one it followed; so every version can tell all the
    rows it was trained on. Returns the new id and the search result.
    """
    before = store.latest(name)
    old = store.training_rows(name, before["version"], id_col) if before else None
    rows = df if old is None else with_newer(old, df, id_col)
    result = search(rows, features, label, id_col, **settings)
    parent = before["version"] if before else None
    model_id = store.save(result.model, name, result.model_type, result.metrics, result.params, result.importance, now, df, parent)
    store.log_training(model_id, "retrained", {"metric": result.metric, "score": str(result.score), "parent": parent or ""}, now)
    return model_id, result
