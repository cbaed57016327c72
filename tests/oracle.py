"""Rows of a query and of its DuckDB text in one comparable form."""

from __future__ import annotations

import math
import os

import duckdb


def plain(v):
    if v is None or str(v) in ("<NA>", "nan", "NaT"):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else float(v) + 0.0
    return str(v)


def table(pdf) -> tuple[list[str], list[tuple]]:
    names = sorted(pdf.columns)
    rows = [tuple(map(plain, r)) for r in pdf[names].astype(object).itertuples(index=False)]
    return names, sorted(rows, key=lambda r: tuple((x is None, "" if rough(x) else str(x)) for x in r) + tuple(round(x, 6) for x in r if rough(x)))


def rough(v) -> bool:
    """A number that is not whole: it orders rows last and need not agree in its last digits."""
    return isinstance(v, float) and v != int(v) if isinstance(v, float) and math.isfinite(v) else False


def close(a, b) -> bool:
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(close, a, b))
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


def duck(sql: str, sf_dir: str):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c.execute(sql).fetchdf()


def same(pdf, sql: str, sf_dir: str) -> None:
    names, rows = table(pdf)
    other, wanted = table(duck(sql, sf_dir))
    assert names == other
    assert len(rows) == len(wanted)
    wrong = [(a, b) for a, b in zip(rows, wanted, strict=True) if not close(a, b)]
    assert not wrong, f"{len(wrong)} of {len(rows)} rows differ, such as {wrong[:3]}"
