"""Score tables in saved pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The values that a page's serialised state holds for each model.
FIELDS = {"accuracy": float, "stderr": float, "cost_per_test": float, "latency": float, "provider": str}
_NAME = re.compile(r"[a-z0-9_.\-]+/[A-Za-z0-9_.\-]+")
_START = re.compile(r'"overall":\[0,(?=\{)')
_UPDATED = re.compile(r'"updated":\[0,"([0-9-]+)"\]')
SCHEMA = "page_id bigint, model string, accuracy double, stderr double, cost_per_test double, latency double, provider string, updated string"


def _plain(x):
    """Serialised values are pairs of a tag and the value."""
    return x[1] if isinstance(x, list) and len(x) == 2 else x


def tables_of(html: str) -> tuple[dict, str | None]:
    """Models with their fields, from the overall table that names providers, else from the last that has accuracies; and when the page was updated."""
    best = {}
    for at in _START.finditer(html):
        try:
            table, _ = json.JSONDecoder().raw_decode(html, at.end())
        except ValueError:
            continue
        models = {name: {k: _plain(v) for k, v in body.items()} for name, pair in table.items() if _NAME.fullmatch(name) and isinstance(body := _plain(pair), dict)}
        named = any("provider" in m for m in models.values())
        if named or not best and any("accuracy" in m for m in models.values()):
            best = models
        if named:
            break
    updated = _UPDATED.search(html)
    return best, updated[1] if updated else None


def scores(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) to one row per model; pages without a table, null ones too, give none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                models, updated = tables_of(html or "")
                for name, m in models.items():
                    rows.append((page, name, *[m[k] if isinstance(m.get(k), kind | int if kind is float else kind) else None for k, kind in FIELDS.items()], updated))
            yield pd.DataFrame(rows, columns=["page_id", "model", *FIELDS, "updated"])

    return pages.select("page_id", "html").mapInPandas(read, SCHEMA)
