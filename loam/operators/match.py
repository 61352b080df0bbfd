"""Fuzzy one-to-one matching of titles, and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame

LEAST = 0.45


def match_titles(wanted: list[str], offered: list[str], least: float = LEAST) -> list[int | None]:
    """For each wanted title the index of an offered one: equal first, then the most alike of those left, if alike enough."""
    from difflib import SequenceMatcher

    free = dict(enumerate(offered))
    out: list[int | None] = []
    for title in wanted:
        hit = next((i for i, t in free.items() if t == title), None)
        if hit is None and free:
            ratio, i = max((SequenceMatcher(None, title, t).ratio(), -i) for i, t in free.items())
            hit = -i if ratio >= least else None
        if hit is not None:
            del free[hit]
        out.append(hit)
    return out


def match_decks(skeleton: DataFrame, slides: DataFrame, least: float = LEAST) -> DataFrame:
    """deck, ord, title, matched: titles of a deck's outline and the generated slides'. A deck is a few dozen slides;
    decks are independent groups."""

    def run(key, a, b):
        import pandas as pd

        a, b = a.sort_values("ord"), b.sort_values("ord")
        offered = b["title"].tolist()
        found = match_titles(a["title"].tolist(), offered, least)
        return pd.DataFrame({"deck": key[0], "ord": a["ord"], "title": a["title"], "matched": [None if i is None else offered[i] for i in found]})

    return skeleton.groupBy("deck").cogroup(slides.groupBy("deck")).applyInPandas(run, "deck string, ord int, title string, matched string")


def deep_merge(base: dict, patch: dict) -> dict:
    """patch over base: dictionaries merge, all else (lists too) is replaced. Neither is changed."""
    out = dict(base)
    for k, v in patch.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


class Routes:
    """Capabilities with a primary and a backup provider: the first that is there and doesn't fail answers."""

    def __init__(self, **providers):
        self.providers = {k: [p for p in v if p] for k, v in providers.items()}

    def call(self, capability: str, *args):
        errors = []
        for provider in self.providers.get(capability, []):
            try:
                return provider(*args)
            except Exception as e:  # noqa: BLE001  the backup is tried on any failure
                errors.append(f"{type(e).__name__}: {e}")
        raise RuntimeError(f"no provider for {capability}: {'; '.join(errors) or 'none set'}")
