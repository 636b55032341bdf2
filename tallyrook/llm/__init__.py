"""Training-data operators. Each module holds one operator, its query and, where SQL can say it, its oracle."""

from importlib import import_module

MODULES = ("shards", "mixing", "rules", "urls", "bpe", "binary", "ordered_minhash", "vectors", "katz", "passages", "neighbours", "importance", "alignment")


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
