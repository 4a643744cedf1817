"""Gradient descent as recursive DuckDB SQL: the oracle of ``operators.descent``.

Tables the steps start from (common-table expressions of the caller):

* ``gr`` (gid, spe, total, warm, ...): the models;
* ``rl`` (gid, id, slot, j, x): feature j of every training row, j = -1 is the constant 1;
* ``rq`` (gid, id, k, q): target k of every training row;
* ``s0`` (gid, k, j, p, m, v): the parameters (j = -1: bias), or, for low-rank models, ``s0`` (gid, part, i, j, p, m, v)
  with parts A (i: rank), B (j: rank) and b, and ``w0`` (gid, k, j, p) the frozen weights.

``descent_sql`` adds ``st``: s0 with t = 0, then the state after every step t with the step's loss, n, rate and grad_norm;
and ``hs`` (t, gid, loss, n, rate, grad_norm), t counted from 0.
"""

from __future__ import annotations

from shotgrid.operators.descent import Optimiser

_LOG_SOFTMAX = """SELECT gid, id, k, z, z - mx - ln(sum(exp(z - mx)) OVER (PARTITION BY gid, id)) AS ls
    FROM (SELECT *, max(z) OVER (PARTITION BY gid, id) AS mx FROM {source})"""


def rate_sql(opt: Optimiser) -> str:
    return (f"{opt.rate!r} * CASE WHEN t < warm THEN t / greatest(CAST(warm AS DOUBLE), 1.0) "
            f"ELSE greatest(0.0, (total - t) / greatest(CAST(total - warm AS DOUBLE), 1.0)) END")


def merged_sql(state: str, scale: float) -> str:
    """(gid, k, j, p): base and adapters as one matrix, and the bias."""
    return f"""SELECT w.gid, w.k, w.j, w.p + {scale!r} * sum(b.p * a.p) AS p FROM w0 w
      JOIN {state} b ON b.gid = w.gid AND b.part = 'B' AND b.i = w.k JOIN {state} a ON a.gid = w.gid AND a.part = 'A' AND a.i = b.j AND a.j = w.j
      GROUP BY w.gid, w.k, w.j, w.p
    UNION ALL SELECT gid, i, -1, p FROM {state} WHERE part = 'b'"""


def descent_sql(steps: int | str, opt: Optimiser, self_taught: bool = False, low_rank_scale: float | None = None) -> str:
    low = low_rank_scale is not None
    keys = "gid, part, i, j" if low else "gid, k, j"
    parts = []
    if low:
        parts.append(f"w_ AS ({merged_sql('st', low_rank_scale)})")
    weights = "w_" if low else "st"
    parts.append(f"""z_ AS (SELECT rl.gid, rl.id, w.k, sum(rl.x * w.p) AS z FROM rl JOIN gr USING (gid) JOIN {weights} w ON w.gid = rl.gid AND w.j = rl.j
    WHERE rl.slot = (SELECT max(t) FROM st) % gr.spe AND (SELECT max(t) FROM st) < gr.total GROUP BY ALL)""")
    parts.append(f"l_ AS ({_LOG_SOFTMAX.format(source='z_')})")
    if self_taught:
        parts.append("y_ AS (SELECT gid, id, k, z + q AS z FROM z_ JOIN rq USING (gid, id, k))")
        parts.append(f"x_ AS ({_LOG_SOFTMAX.format(source='y_')})")
        parts.append("""u_ AS (SELECT l.gid, l.id, l.k, l.ls, x.ls AS lt, sum(exp(x.ls) * (x.ls - l.ls)) OVER (PARTITION BY l.gid, l.id) AS kl
    FROM l_ l JOIN x_ x USING (gid, id, k))""")
        parts.append("d_ AS (SELECT gid, id, k, exp(ls) - exp(lt) + exp(lt) * (lt - ls - kl) AS dz, exp(lt) * (lt - ls) AS part FROM u_)")
    else:
        parts.append("""d_ AS (SELECT gid, id, k, exp(ls) * sum(q) OVER (PARTITION BY gid, id) - q AS dz,
    CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END - q * ls AS part FROM l_ JOIN rq USING (gid, id, k))""")
    parts.append("n_ AS (SELECT gid, sum(part) / count(DISTINCT id) AS loss, count(DISTINCT id) AS n FROM d_ GROUP BY gid)")
    parts.append("""g_ AS (SELECT d.gid, d.k, rl.j, sum(d.dz * rl.x) / any_value(n.n) AS g FROM d_ d JOIN rl USING (gid, id)
    JOIN n_ n ON n.gid = d.gid GROUP BY ALL)""")
    if low:
        scale = repr(low_rank_scale)
        parts.append(f"""gg_ AS (SELECT g.gid, 'A' AS part, b.j AS i, g.j, {scale} * sum(b.p * g.g) AS g FROM g_ g JOIN st b ON b.gid = g.gid
      AND b.part = 'B' AND b.i = g.k WHERE g.j >= 0 GROUP BY ALL
    UNION ALL SELECT g.gid, 'B', g.k, a.i, {scale} * sum(g.g * a.p) FROM g_ g JOIN st a ON a.gid = g.gid AND a.part = 'A' AND a.j = g.j GROUP BY ALL
    UNION ALL SELECT gid, 'b', k, -1, g FROM g_ WHERE j = -1)""")
    else:
        parts.append("gg_ AS (SELECT gid, k, j, g FROM g_)")
    parts.append("r_ AS (SELECT gid, sqrt(sum(g * g)) AS grad_norm FROM gg_ GROUP BY gid)")
    if opt.momentless:
        m, v, change = "m", "v", "g"
    else:
        m, v = f"(m * {opt.beta1!r} + g * {1 - opt.beta1!r})", f"(v * {opt.beta2!r} + g * g * {1 - opt.beta2!r})"
        change = f"({m} / (1 - pow({opt.beta1!r}, t + 1))) / (sqrt({v} / (1 - pow({opt.beta2!r}, t + 1))) + {opt.eps!r})"
    step = ",\n".join(parts)
    return f"""st AS (SELECT 0 AS t, {keys}, CAST(p AS DOUBLE) AS p, CAST(m AS DOUBLE) AS m, CAST(v AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS loss,
    CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS rate, CAST(NULL AS DOUBLE) AS grad_norm FROM s0
  UNION ALL (WITH {step}
  SELECT t + 1, {keys}, CASE WHEN g IS NULL THEN p ELSE p - ({rate_sql(opt)}) * ({change} + p * {opt.decay!r}) END,
    CASE WHEN g IS NULL THEN m ELSE {m} END, CASE WHEN g IS NULL THEN v ELSE {v} END,
    n_.loss, n_.n, CASE WHEN n_.n IS NOT NULL THEN {rate_sql(opt)} END, r_.grad_norm
  FROM st LEFT JOIN gg_ USING ({keys}) JOIN gr USING (gid) LEFT JOIN n_ USING (gid) LEFT JOIN r_ USING (gid) WHERE t < {steps})),
hs AS (SELECT DISTINCT t - 1 AS t, gid, loss, n, rate, grad_norm FROM st WHERE n IS NOT NULL)"""


def scores_sql(rows: str, weights: str, keys: str) -> str:
    """(keys, domain, loss, accuracy): models ``weights`` (keys, k, j, p) on rows ``rows`` (domain, id, label, j, x)."""
    return f"""SELECT {keys}, domain, avg(-ls) FILTER (k = label) AS loss,
      sum(CASE WHEN k = label AND best THEN 1.0 ELSE 0.0 END) / count(DISTINCT id) AS accuracy FROM (
      SELECT *, z - mx - ln(sum(exp(z - mx)) OVER (PARTITION BY {keys}, domain, id)) AS ls,
             row_number() OVER (PARTITION BY {keys}, domain, id ORDER BY z DESC, k) = 1 AS best
      FROM (SELECT *, max(z) OVER (PARTITION BY {keys}, domain, id) AS mx FROM (
        SELECT {keys}, e.domain, e.id, e.label, w.k, sum(e.x * w.p) AS z FROM {rows} e JOIN {weights} w ON w.j = e.j
        GROUP BY {keys}, e.domain, e.id, e.label, w.k))) GROUP BY {keys}, domain"""
