"""SQL text that solves a dense system ``sys(i, j, a)`` exactly, right-hand sides in columns j >= n."""


def solved(n: int, rhs: int = 1) -> str:
    """CTEs ending in ``x(idx, x0, ..)``; the surrounding statement must be WITH RECURSIVE."""
    columns = ", ".join(f"m[t.i][len(m) + {k + 1}] AS x{k}" for k in range(rhs))
    return f"""m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(CAST(a AS DOUBLE) ORDER BY j) AS r FROM sys GROUP BY i)),
  g(k, m) AS (SELECT 1, m FROM m0 UNION ALL SELECT k + 1, list_transform(m, lambda r, q: CASE WHEN q = k THEN list_transform(r, lambda v: v / r[k])
      ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END) FROM g WHERE k <= len(m)),
  x AS (SELECT t.i - 1 AS idx, {columns} FROM g, range(1, {n + 1}) t(i) WHERE k = len(m) + 1)"""
