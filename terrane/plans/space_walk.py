"""Walks on product spaces without an edge table.

The neighbours of a state differ from it at one site, so they are the other rows of its mask group at that site. A product
with the rate matrix collects the values and vector entries of each group (at most one row per allele) and sums rate
times entry there. Sites are handled in two blocks that share a shuffle each: two exchanges of n rows a product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from terrane.operators.spaces import Space, block_partition, site_blocks
from terrane.plans.solvers import Apply, conjugate_gradient, num
from terrane.session import cut

# rate of a step that changes the value by d, and its symmetric form; 1 where the values are equal
RATE = "IF(abs({d}) <= 1e-8D OR {s} = 0D, 1D, {s} / (-expm1(-({s}))))"
SYMMETRIC = "IF(abs({d}) <= 1e-8D OR {s} = 0D, 1D, {s} / (exp(0.5D * {s}) - exp(-0.5D * {s})))"


def neighbour_sums(df: DataFrame, space: Space, ns: float, columns: dict[str, str], form: str = RATE, y: str = "y") -> DataFrame:
    """Add ``out`` = sum over the neighbours j of rate(i, j) v_j for each ``{out: v}``."""
    outs = list(columns)
    names = [f"`{c}`" for c in df.columns if c not in outs]
    cell = ", ".join([f"'y', `{y}`", *[f"'v{k}', `{v}`" for k, v in enumerate(columns.values())]])
    d = f"(x.y - `{y}`)"
    rate = form.format(d=d, s=f"({num(ns)} * {d})")
    df = df.selectExpr(*names, *[f"0D AS `{o}`" for o in outs])
    for block in site_blocks(space):
        df, key = block_partition(df, space, block)
        for s in block:
            group = ", ".join([key, *[space.digit_sql(t) for t in block if t != s]])
            df = df.selectExpr("*", f"collect_list(named_struct({cell})) OVER (PARTITION BY {group}) AS _near")
            # the row itself is in its group, at rate 1
            sums = [f"`{o}` + aggregate(_near, 0D, (a, x) -> a + {rate} * x.v{k}) - `{v}` AS `{o}`" for k, (o, v) in enumerate(columns.items())]
            df = df.selectExpr(*names, key, *sums)
        df = df.drop(key)
    return df


def generator_applied(nodes: DataFrame, space: Space, ns: float, v: str = "v", out: str = "u", y: str = "y") -> DataFrame:
    """``out`` = Q v for the rate matrix of a complete landscape."""
    df = neighbour_sums(nodes.withColumn("_one", F.lit(1.0)), space, ns, {out: v, "_leave": "_one"}, RATE, y)
    return df.withColumn(out, F.col(out) - F.col("_leave") * F.col(v)).drop("_leave", "_one")


def hitting_probability_on_space(nodes: DataFrame, space: Space, ns: float, one: DataFrame, zero: DataFrame, y: str = "y", out: str = "q", rtol: float = 1e-9) -> DataFrame:
    """Probability of reaching ``one`` before ``zero`` from every state of a complete landscape ``(idx, y)``.

    The system on the other states is made symmetric by the root of the stationary weights and solved by conjugate
    gradients; a step is one :func:`neighbour_sums`.
    """
    top = nodes.agg(F.max(y)).first()[0]
    marked = nodes.select("idx", F.col(y).cast("double").alias("y"))
    marked = marked.join(one.select("idx", F.lit(1.0).alias("_one")), "idx", "left").join(zero.select("idx", F.lit(0.0).alias("_zero")), "idx", "left")
    marked = marked.withColumns({"known": F.coalesce("_one", "_zero"), "target": F.coalesce("_one", F.lit(0.0)), "unit": F.lit(1.0)}).drop("_one", "_zero")
    marked = neighbour_sums(marked, space, ns, {"into": "target", "leave": "unit"}, RATE)
    root = F.exp(F.lit(0.5 * ns) * (F.col("y") - F.lit(top)))
    system = cut(marked.withColumns({"open": F.col("known").isNull(), "root": root, "b": F.when(F.col("known").isNull(), root * F.col("into")).otherwise(0.0)}))

    def apply(df: DataFrame, cols: Sequence[str], outs: Sequence[str]) -> DataFrame:
        df = neighbour_sums(df, space, ns, dict(zip(outs, cols)), SYMMETRIC)
        held = [f"`{c}`" for c in df.columns if c not in outs]
        return df.selectExpr(*held, *[f"IF(open, leave * `{c}` - `{o}`, 0D) AS `{o}`" for c, o in zip(cols, outs)])

    solver: Apply = apply
    solved = conjugate_gradient(system.select("idx", "y", "open", "leave", "b", "known", "root"), solver, ["b"], "leave", rtol)
    q = solved.select("idx", F.coalesce("known", F.col("x_b") / F.col("root")).alias(out))
    return nodes.join(q, "idx")
