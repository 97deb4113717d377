"""All registered queries and their oracles."""

from __future__ import annotations

from labelmill.plans import collection, evaluation, labelling, syntax, texts, training, vectors

_MODULES = (evaluation, labelling, texts, collection, syntax, vectors, training)


def _collect(attribute: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        found = getattr(module, attribute)
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(found)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLES")
