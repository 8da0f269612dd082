"""Pieces of DuckDB SQL for the oracles of the clip queries."""

from __future__ import annotations

import re

from frameloom.functions import formulas as fm

#: The clip of 16 x 16 frames, complete ones only.
PX = """n AS (SELECT CAST(count(*) // 256 AS INT) AS n FROM events),
px AS (SELECT CAST(event_id // 256 AS INT) AS f, CAST((event_id % 256) // 16 AS INT) AS y, CAST(event_id % 16 AS INT) AS x,
              CAST(least(65535, greatest(0, floor(value * 100 + 0.5))) AS INT) AS v FROM events, n WHERE event_id // 256 < n.n)"""
PX32 = PX.replace("256", "1024").replace("16", "32")
RGB = """ev AS (SELECT event_id AS i, CAST(least(65535, greatest(0, floor(value * 100 + 0.5))) AS INT) AS v FROM events),
rgb AS (SELECT CAST(a.i // 256 AS INT) AS f, CAST((a.i % 256) // 16 AS INT) AS y, CAST(a.i % 16 AS INT) AS x, a.v AS r, b.v AS g, c.v AS b
        FROM ev a JOIN ev b ON b.i = a.i + 1 JOIN ev c ON c.i = a.i + 2)"""
EMB = """emb AS (SELECT id, p // 8 AS y, p % 8 AS x, CAST(floor((CAST(e AS DOUBLE) + 1) * 2048 + 0.5) AS INT) AS v
        FROM (SELECT vec_id AS id, unnest(embedding) AS e, unnest(range(64)) AS p FROM embeddings))"""


def samples(w: int) -> str:
    """Samples of a window of ``w`` frames without motion."""
    return f"""{PX},
lo AS (SELECT px.*, least(greatest(f - {w // 2}, 0), greatest(n.n - {w}, 0)) AS lo, least({w}, n.n) AS w FROM px, n),
s AS (SELECT a.f, a.y, a.x, CAST(a.v AS DOUBLE) AS c, b.f AS nf, CAST(b.v AS DOUBLE) AS s
      FROM lo a JOIN px b ON a.y = b.y AND a.x = b.x AND (b.f = a.f OR (b.f BETWEEN a.lo AND a.lo + a.w - 1 AND a.x + 2 < 16 AND a.y + 2 < 16)))"""


SAMPLES = samples(15)
SG = "616D"


def duck(expression: str) -> str:
    """A formula in DuckDB's dialect."""
    out = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", r"CAST(\1 AS DOUBLE)", expression)
    out = re.sub(r"\bDIV\b", "//", out)
    return re.sub(r"shiftright\(([^()]*(?:\([^()]*\))?[^()]*), (\d+)\)", r"((\1) >> \2)", out)


def z(v: str) -> str:
    return duck(fm.stabilise(v, SG))


def px_of(x: str) -> str:
    return duck(fm.to_pixel(x))


def back(x: str) -> str:
    return px_of(fm.unstabilise(x, SG))


def sig(v: str) -> str:
    return duck(fm.noise_sigma(v, SG))
