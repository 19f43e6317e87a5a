"""The commercial tables of a store as the views that rules read."""

from __future__ import annotations

from assay.engine.store import Store
from assay.rules.predicates import ALLOWED


def register(store: Store) -> None:
    """Views of what the store holds now; a view lists its files once, so call this again after appending."""
    for name in ALLOWED:
        df = store.latest(name, "feed_expectation_id").drop("seq") if name == "feed_expectation" else store.read(name)
        df.createOrReplaceTempView(name)
