"""Row comparison across engines."""

from __future__ import annotations

import datetime
import decimal
import math


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted(tuple(canon(r[c]) for c in names) for r in frame.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(canon(r[k]) for k in order) for r in got.fetchall())
