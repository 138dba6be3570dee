"""Transition paths: committors, reactive flows, reachability, bottlenecks and pathways."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from terrane.plans.solvers import Chain, bicgstab, by_target, conjugate_gradient, edge_apply
from terrane.plans.walk import backward_rates, jump_chain, leaving_rates, with_ends
from terrane.session import Stored, cut

INF = float("inf")


def _dirichlet(nodes: DataFrame, rates: DataFrame, unknown: str, rhs: str, reversible: bool, p: str = "p", rtol: float = 1e-9) -> DataFrame:
    """Solve leave_i q_i - sum over unknown j of Q_ij q_j = rhs_i on the unknown states: ``(idx, q)``.

    With detailed balance the system is made symmetric by sqrt(pi) and solved by preconditioned
    conjugate gradients, otherwise by BiCGSTAB.
    """
    inside = cut(nodes.where(F.col(unknown)).select("idx", p, rhs))
    system = cut(inside.join(leaving_rates(rates), "idx"))
    kept = with_ends(rates.select("i", "j", "rate"), inside, [p])
    if reversible:
        w = F.sqrt(F.col(f"{p}_i") / F.col(f"{p}_j")) * F.col("rate")
        edges = by_target(kept.select("i", "j", w.alias("w")))
        system = system.withColumn("b", F.sqrt(p) * F.col(rhs))
        x = conjugate_gradient(system.select("idx", p, "leave", "b"), edge_apply(edges, "leave", sign=-1.0), ["b"], "leave", rtol)
        out = cut(x.select("idx", (F.col("x_b") / F.sqrt(p)).alias("q")))
    else:
        edges = by_target(kept.select("i", "j", F.col("rate").alias("w")))
        x = bicgstab(system.select("idx", "leave", F.col(rhs).alias("b")), edge_apply(edges, "leave", sign=-1.0), "b", rtol)
        out = cut(x.select("idx", F.col("x").alias("q")))
    edges.unpersist()
    return out


def _into(rates: DataFrame, target: DataFrame) -> DataFrame:
    """``(idx, into)``: total rate from every state into a set."""
    t = target.select(F.col("idx").alias("j"))
    return rates.join(t, "j", "left_semi").groupBy(F.col("i").alias("idx")).agg(F.sum("rate").alias("into"))


def hitting_probability(nodes: DataFrame, rates: DataFrame, one: DataFrame, zero: DataFrame, reversible: bool = True, out: str = "q") -> DataFrame:
    """Probability of reaching ``one`` before ``zero`` from every state."""
    marked = nodes.join(one.select("idx", F.lit(1.0).alias("_one")), "idx", "left").join(zero.select("idx", F.lit(0.0).alias("_zero")), "idx", "left")
    marked = marked.join(_into(rates, one), "idx", "left")
    marked = marked.withColumns({"_known": F.coalesce("_one", "_zero"), "_rhs": F.coalesce("into", F.lit(0.0))})
    marked = cut(marked.withColumn("_unknown", F.col("_known").isNull()))
    q = _dirichlet(marked, rates, "_unknown", "_rhs", reversible)
    solved = marked.join(q, "idx", "left").withColumn(out, F.coalesce("_known", "q", F.lit(0.0)))
    return solved.select(*nodes.columns, out)


def committors(nodes: DataFrame, rates: DataFrame, start: DataFrame, end: DataFrame, avoid: DataFrame | None = None, reversible: bool = True) -> DataFrame:
    """Nodes with ``q_forward`` and ``q_backward``; ``nodes`` needs the stationary ``p``."""
    if start.select("idx").intersect(end.select("idx")).limit(1).count():
        raise ValueError("start and end states overlap")
    zero = lambda s: s.select("idx") if avoid is None else s.select("idx").union(avoid.select("idx")).distinct()
    forward = hitting_probability(nodes, rates, end.select("idx"), zero(start), reversible, "q_forward")
    if avoid is None and reversible:
        return forward.withColumn("q_backward", 1.0 - F.col("q_forward"))
    back = rates if reversible else backward_rates(rates, nodes)
    backward = hitting_probability(nodes, back, start.select("idx"), zero(end), reversible, "q_backward")
    return forward.join(backward.select("idx", "q_backward"), "idx")


def hitting_through(nodes: DataFrame, rates: DataFrame, target: DataFrame, through: DataFrame, reversible: bool = True) -> DataFrame:
    """Probability that the last step into ``target`` comes from a ``through`` state."""
    marked = nodes.join(target.select("idx", F.lit(1.0).alias("_known")), "idx", "left")
    gate = _into(rates, target).join(through.select("idx"), "idx", "left_semi")
    marked = marked.join(gate, "idx", "left").withColumns({"_rhs": F.coalesce("into", F.lit(0.0)), "_unknown": F.col("_known").isNull()})
    marked = cut(marked)
    q = _dirichlet(marked, rates, "_unknown", "_rhs", reversible)
    solved = marked.join(q, "idx", "left").withColumn("q", F.coalesce("_known", F.col("q"), F.lit(0.0)))
    return solved.select(*nodes.columns, "q")


def reactive_probabilities(nodes: DataFrame) -> DataFrame:
    """``joint`` and ``conditional`` probability of being on a reactive path."""
    joint = nodes.withColumn("joint", F.col("q_forward") * F.col("q_backward") * F.col("p"))
    return joint.withColumn("conditional", F.col("joint") / joint.agg(F.sum("joint")).scalar())


def effective_flows(nodes: DataFrame, rates: DataFrame) -> DataFrame:
    """``(i, j, eff_flow)``: net reactive flow max(0, f_ij - f_ji) along every edge."""
    e = with_ends(rates.where("i <> j").select("i", "j", "rate"), nodes, ["p", "q_forward", "q_backward"])
    f = F.col("p_i") * F.col("q_backward_i") * F.col("rate") * F.col("q_forward_j")
    there = e.select("i", "j", f.alias("f"))
    back = there.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("f")).alias("f"))
    return there.unionByName(back).groupBy("i", "j").agg(F.sum("f").alias("eff_flow")).where("eff_flow > 0")


def reactive_rate(flows: DataFrame, start: DataFrame) -> DataFrame:
    """One row: total net flow out of the start set."""
    return flows.join(start.select(F.col("idx").alias("i")), "i", "left_semi").agg(F.sum("eff_flow").alias("rate"))


def reactive_jumps(nodes: DataFrame, rates: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """``(i, j, p)`` of the walk conditioned on reaching the end: rates times q_j / q_i, none back
    into the start, none out of the end; the start keeps its own rates."""
    ends = nodes.select("idx", "q_forward")
    ends = ends.join(start.select("idx", F.lit(True).alias("_start")), "idx", "left").join(end.select("idx", F.lit(True).alias("_end")), "idx", "left")
    ends = ends.withColumns({"at_start": F.col("_start").isNotNull(), "at_end": F.col("_end").isNotNull()})
    e = with_ends(rates.where("i <> j").select("i", "j", "rate"), ends, ["q_forward", "at_start", "at_end"])
    e = e.where("not at_end_i and not at_start_j")
    tilted = F.when(F.col("at_start_i"), F.col("rate")).when(F.col("q_forward_i") > 0, F.col("rate") * F.col("q_forward_j") / F.nullif("q_forward_i", F.lit(0.0))).otherwise(0.0)
    return jump_chain(e.select("i", "j", tilted.alias("rate")), nodes)


# --- graph sweeps -------------------------------------------------------------------------------

def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(idx, hops)`` of every state that can be reached: breadth first until nothing is new."""
    reached = frontier = cut(seeds.select("idx").distinct().withColumn("hops", F.lit(0)))
    k = 0
    while True:
        k += 1
        step = frontier.join(edges.select(F.col("i").alias("idx"), "j"), "idx").select(F.col("j").alias("idx")).distinct()
        new = Stored(step.join(reached, "idx", "left_anti").withColumn("hops", F.lit(k)), {"n": F.count(F.lit(1))})
        if not new.measures["n"]:
            return reached
        frontier = new.table
        reached = reached.unionByName(frontier)
        if k % 8 == 0:
            reached = cut(reached)


def has_path(edges: DataFrame, start: DataFrame, end: DataFrame) -> bool:
    return reachable(edges, start).join(end.select("idx"), "idx", "left_semi").limit(1).count() > 0


def widest_capacities(edges: DataFrame, start: DataFrame, weight: str = "w") -> DataFrame:
    """``(idx, cap)``: largest smallest-edge of any path from the start set."""
    caps = start.select("idx").distinct().withColumns({"cap": F.lit(INF), "fresh": F.lit(True)})
    chain = Chain()
    while True:
        step = caps.where("fresh").select(F.col("idx").alias("i"), "cap").join(edges.select("i", "j", F.col(weight).alias("_w")), "i")
        offers = step.groupBy(F.col("j").alias("idx")).agg(F.max(F.least("cap", "_w")).alias("offer"))
        merged = caps.join(offers, "idx", "full")
        better = F.col("offer").isNotNull() & (F.col("cap").isNull() | (F.col("offer") > F.col("cap")))
        merged = merged.select("idx", F.when(better, F.col("offer")).otherwise(F.col("cap")).alias("cap"), better.alias("fresh"))
        caps, measured = chain.store(merged, {"fresh": F.count_if(F.col("fresh"))})
        if not measured["fresh"]:
            return caps.select("idx", "cap")


def bottleneck(edges: DataFrame, start: DataFrame, end: DataFrame, weight: str = "w") -> DataFrame:
    """One row: the smallest flow on the best path between two sets (null when there is none)."""
    return widest_capacities(edges, start, weight).join(end.select("idx"), "idx", "left_semi").agg(F.max("cap").alias("min_flow"))


def best_paths(edges: DataFrame, start: DataFrame, weight: str = "w", max_sweeps: int = 10_000) -> DataFrame:
    """``(idx, weights, nodes)``: for every state the path whose sorted weights are largest.

    Paths are compared by their smallest weight, then the next smallest, and so on; fewer weights
    win a tie, and then the smaller node numbers. A table row carries its own path, so a sweep is
    one join and one aggregate. Adding an edge never reverses a comparison, so sweeps settle.
    """
    label = lambda c: F.array((-F.col(c)).cast("bigint"))
    state = start.select("idx").distinct().select("idx", F.struct(F.array(F.lit(INF)).alias("weights"), label("idx").alias("neg")).alias("best"), F.lit(True).alias("fresh"))
    chain = Chain()
    for _ in range(max_sweeps):
        step = state.where("fresh").select(F.col("idx").alias("i"), "best").join(edges.select("i", "j", F.col(weight).alias("_w")), "i")
        step = step.where(~F.array_contains("best.neg", -F.col("j")))
        longer = F.struct(
            F.sort_array(F.concat("best.weights", F.array("_w"))).alias("weights"), F.concat("best.neg", label("j")).alias("neg")
        )
        offers = step.groupBy(F.col("j").alias("idx")).agg(F.max(longer).alias("offer"))
        merged = state.join(offers, "idx", "full")
        better = F.col("offer").isNotNull() & (F.col("best").isNull() | (F.col("offer") > F.col("best")))
        merged = merged.select("idx", F.when(better, F.col("offer")).otherwise(F.col("best")).alias("best"), better.alias("fresh"))
        state, measured = chain.store(merged, {"fresh": F.count_if(F.col("fresh"))})
        if not measured["fresh"]:
            break
    else:
        raise RuntimeError(f"paths still grow after {max_sweeps} sweeps")
    return state.select("idx", F.col("best.weights").alias("weights"), F.transform("best.neg", lambda x: -x).alias("nodes"))


def pathway(edges: DataFrame, start: DataFrame, end: DataFrame, weight: str = "w") -> DataFrame:
    """At most one row ``(weights, nodes, eff_flow)``: the dominant pathway between two sets."""
    found = best_paths(edges, start, weight).join(end.select("idx"), "idx", "left_semi")
    best = found.agg(F.max(F.struct("weights", F.transform("nodes", lambda x: -x).alias("neg"))).alias("b")).where("b is not null")
    return best.select("b.weights", F.transform("b.neg", lambda x: -x).alias("nodes"), F.element_at("b.weights", 1).alias("eff_flow"))


def pathways(flows: DataFrame, start: DataFrame, end: DataFrame, n: int = 20) -> DataFrame:
    """``(path, step, i, j, eff_flow, eff_flow_p)``: dominant pathways, each subtracted from the flows."""
    spark = flows.sparkSession
    left = cut(flows.select("i", "j", F.col("eff_flow").alias("w")))
    rate = reactive_rate(left.withColumnRenamed("w", "eff_flow"), start).first()[0] or 0.0
    rows = []
    for path in range(n):
        row = pathway(left, start, end).first()
        if row is None:
            break
        links = list(zip(row.nodes, row.nodes[1:]))
        rows += [(path, step, i, j, row.eff_flow, row.eff_flow / rate) for step, (i, j) in enumerate(links)]
        used = spark.createDataFrame(links, "i bigint, j bigint").withColumn("used", F.lit(row.eff_flow))
        smaller = left.join(used, ["i", "j"], "left").select("i", "j", (F.col("w") - F.coalesce("used", F.lit(0.0))).alias("w"))
        left = cut(smaller.where("w > 0"))  # the weakest edge of the path is exactly used up
    return spark.createDataFrame(rows, "path int, step int, i bigint, j bigint, eff_flow double, eff_flow_p double")


def bottleneck_edge(edges: DataFrame, start: DataFrame, end: DataFrame, weight: str = "w") -> DataFrame:
    """At most one row ``(i, j, min_flow)``: the weakest edge of the dominant pathway between two sets."""
    best = pathway(edges, start, end, weight)
    step = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda k: F.struct(F.element_at("nodes", k).alias("i"), F.element_at("nodes", k + 1).alias("j")))
    links = best.where("size(nodes) > 1").select(F.explode(step).alias("e"), F.col("eff_flow").alias("min_flow")).select("e.i", "e.j", "min_flow")
    on_path = links.join(edges.select("i", "j", F.col(weight).alias("_w")), ["i", "j"]).where("_w = min_flow")
    return on_path.groupBy("min_flow").agg(F.min(F.struct("i", "j")).alias("e")).select("e.i", "e.j", "min_flow")


def max_min_path(nodes: DataFrame, edges: DataFrame, start: int, end: int, y: str = "y") -> DataFrame:
    """One row ``(weights, nodes)``: path whose lowest node value is largest, then the next lowest."""
    spark = nodes.sparkSession
    one = lambda v: spark.range(1).select(F.lit(int(v)).cast("bigint").alias("idx"))
    entering = edges.select("i", "j").join(nodes.select(F.col("idx").alias("j"), F.col(y).cast("double").alias("w")), "j")
    return pathway(entering, one(start), one(end)).select("weights", "nodes")


def _is_prime(n: int) -> bool:
    """Exact below 2^32 (Miller-Rabin with the bases 2, 7 and 61)."""
    if n < 2 or any(n % q == 0 and n != q for q in (2, 3, 5, 7, 61)):
        return False
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for base in (2, 7, 61):
        x = pow(base, d, n)
        if n == base or x in (1, n - 1):
            continue
        if all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def moduli(bits: float) -> list[int]:
    """Distinct primes below 2^31 whose product has more than ``bits`` bits."""
    found, product, n = [], 1, 2 ** 31 - 1
    while product.bit_length() <= bits + 1:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def from_residues(residues: Sequence[int], primes: Sequence[int]) -> int:
    """The smallest number with these remainders."""
    x, m = 0, 1
    for r, q in zip(residues, primes):
        x += m * ((r - x) * pow(m, -1, q) % q)
        m *= q
    return x


def path_number(edges: DataFrame, start: int, end: int, max_length: int) -> int:
    """Number of paths of at most ``max_length`` steps from start to end; exact, however large.

    A sweep takes the counts one step on and writes them: one join, one aggregate, one stored table. Counts travel as
    remainders modulo as many primes as the bound (the largest number of ways out, by the length) asks for.
    """
    spark = edges.sparkSession
    out = cut(edges.select(F.col("i").alias("idx"), "j"))
    widest = out.groupBy("idx").count().agg(F.max("count")).first()[0] or 1
    primes = moduli(max_length * math.log2(max(widest, 2)) + math.log2(max_length + 1))
    columns = [f"n{k}" for k in range(len(primes))]
    here = spark.range(1).select(F.lit(int(start)).cast("bigint").alias("idx"), *[F.lit(1).cast("bigint").alias(c) for c in columns])
    total, chain = [0] * len(primes), Chain()
    for _ in range(max_length):
        # a sum has at most as many terms as there are edges, each below 2^31
        step = here.join(out, "idx").groupBy(F.col("j").alias("idx")).agg(*[F.pmod(F.sum(c), F.lit(q)).alias(c) for c, q in zip(columns, primes)])
        at_end = {c: F.sum(F.when(F.col("idx") == F.lit(int(end)), F.col(c))) for c in columns}
        here, found = chain.store(step, {"rows": F.count(F.lit(1)), **at_end})
        total = [(t + (found[c] or 0)) % q for t, c, q in zip(total, columns, primes)]
        if not found["rows"]:
            break
    if chain.last is not None:
        chain.last.drop()
    return from_residues(total, primes)


def count_paths(edges: DataFrame, start: int, end: int, max_length: int) -> DataFrame:
    """One row: number of paths from start to end in an acyclic edge table; a bigint, or text where it has more digits."""
    n = path_number(edges, start, end, max_length)
    return edges.sparkSession.createDataFrame([(n if n < 2 ** 63 else str(n),)], "n_paths bigint" if n < 2 ** 63 else "n_paths string")
