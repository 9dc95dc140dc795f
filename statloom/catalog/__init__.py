"""Registered queries by area: name -> (callable, comparison SQL or None)."""


def all_queries() -> dict:
    from statloom.catalog import accounts, charts, cleaning, statistics, streams

    out: dict = {}
    for area in (statistics, cleaning, charts, accounts, streams):
        out |= area.QUERIES
    return out
