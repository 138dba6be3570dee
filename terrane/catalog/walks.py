"""Random walks, transition paths and embeddings on the line-item and part landscapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane.catalog import query
from terrane.catalog.elimination import solved
from terrane.catalog.selections import LINE_EDGES, PART_EDGES
from terrane.catalog.views import CUSTOMER, CUSTOMER_LENGTH, LINE, LINE_SPACE, PART, PART_SPACE, customer_dna, line_landscape, part_landscape, r6
from terrane.operators import spaces as S
from terrane.plans import embedding as E, paths as P, space_hitting as H, space_modes as M, space_walk as X, walk as W
from terrane.session import cut

NS = 2.0
r9 = lambda c: F.round(c, 9).alias(c)

_PI = "w AS (SELECT idx, seq, y, exp(2.0*(y - (SELECT max(y) FROM line_landscape))) AS e FROM line_landscape), pi AS (SELECT idx, seq, y, e/(SELECT sum(e) FROM w) AS p FROM w)"
_RATES = f"""{LINE_EDGES}, {_PI}, s AS (SELECT e.i, e.j, 2.0*(b.y - a.y) AS s FROM edges e JOIN line_landscape a ON a.idx = i JOIN line_landscape b ON b.idx = j),
  rates AS (SELECT i, j, s/(exp(0.5*s)-exp(-0.5*s)) AS sym, s/(1-exp(-s)) AS rate FROM s)"""


def walk(spark, sf):
    """(nodes with p, rates) of the line-item landscape at a fixed Ns."""
    nodes = W.stationary_frequencies(line_landscape(spark, sf).select("idx", "seq", "y"), NS)
    rates = W.transition_rates(nodes, LINE_SPACE.edges(spark), NS, LINE_SPACE.n)
    return cut(nodes), cut(rates)


def state_set(spark, *seqs):
    return spark.createDataFrame([(LINE_SPACE.rank(s),) for s in seqs], "idx bigint")


@query(f"WITH {LINE}, {_PI} SELECT idx, round(p, 9) AS p FROM pi")
def stationary_distribution(spark, sf):
    return W.stationary_frequencies(line_landscape(spark, sf), NS).select("idx", r9("p"))


@query(f"""WITH {LINE}, g AS (SELECT unnest([0.0, 0.5, 1.0, 4.0, 16.0]::DOUBLE[]) AS ns), m AS (SELECT max(y) AS top FROM line_landscape)
  SELECT ns, round(sum(y*exp(ns*(y-top)))/sum(exp(ns*(y-top))), 6) AS mean_function FROM line_landscape, g, m GROUP BY 1""")
def stationary_mean_sweep(spark, sf):
    return W.stationary_sweep(line_landscape(spark, sf), [0.0, 0.5, 1.0, 4.0, 16.0]).select("ns", r6("mean_function").alias("mean_function"))


@query(f"""WITH RECURSIVE {LINE}, ys AS (SELECT list(y) AS ys, max(y) AS top, avg(y) + 0.5*(max(y)-avg(y)) AS target FROM line_landscape),
  b(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1000.0::DOUBLE UNION ALL
    SELECT k + 1, CASE WHEN m < target THEN mid ELSE lo END, CASE WHEN m < target THEN hi ELSE mid END FROM (
      SELECT k, lo, hi, (lo+hi)/2 AS mid, target, list_sum(list_transform(ys, lambda v: v*exp((lo+hi)/2*(v-top))))/list_sum(list_transform(ys, lambda v: exp((lo+hi)/2*(v-top)))) AS m FROM b, ys WHERE k < 60))
  SELECT round(lo, 5) AS ns FROM b WHERE k = 60""")
def calibrated_ns(spark, sf):
    """Selection strength whose stationary mean is half-way between the mean and the maximum."""
    nodes = cut(line_landscape(spark, sf))
    mean, top = nodes.agg(F.avg("y"), F.max("y")).first()
    return spark.range(1).select(F.round(F.lit(W.calibrate_ns(nodes, mean + 0.5 * (top - mean))), 5).alias("ns"))


@query(f"WITH {_RATES} SELECT i, j, round(sym, 9) AS sym, round(rate, 9) AS rate FROM rates")
def transition_rates(spark, sf):
    nodes = line_landscape(spark, sf)
    return W.transition_rates(nodes, LINE_SPACE.edges(spark), NS, LINE_SPACE.n).select("i", "j", r9("sym"), r9("rate"))


@query(f"WITH {_RATES} SELECT i, j, round(rate, 9) AS rate FROM rates UNION ALL SELECT i, i, round(-sum(rate), 9) FROM rates GROUP BY i")
def rate_matrix(spark, sf):
    _, rates = walk(spark, sf)
    return W.with_diagonal(rates).select("i", "j", r9("rate"))


_FREQS = [[0.2, 0.3, 0.5], [0.4, 0.6], [0.1, 0.1, 0.2, 0.1, 0.2, 0.1, 0.2]]
_EXCHANGE = [[1.0, 2.0, 0.5], [1.5], [1.0 + 0.1 * k for k in range(21)]]
_SQL_F = " * ".join(f"[{', '.join(map(str, f))}][CAST(({{k}})//{st}%{r} AS INT)+1]" for f, st, r in zip(_FREQS, (14, 7, 1), (3, 2, 7)))
_SQL_X = "CASE " + " ".join(
    f"WHEN i//{st}%{r} = {a} AND j//{st}%{r} = {b} OR i//{st}%{r} = {b} AND j//{st}%{r} = {a} THEN {x!r}"
    for xs, st, r in zip(_EXCHANGE, (14, 7, 1), (3, 2, 7))
    for x, (a, b) in zip(xs, [(a, b) for a in range(r) for b in range(a + 1, r)])
) + " END"


@query(f"""WITH {_RATES}, x AS (SELECT i, j, {_SQL_X} AS exchange, {_SQL_F.format(k='j')} AS p0j, s FROM s)
  SELECT i, j, round(CAST(exchange AS DOUBLE), 9) AS exchange, round(CAST(exchange*p0j AS DOUBLE), 9) AS neutral, round(exchange*p0j*42.0*s/(1-exp(-s)), 9) AS rate FROM x""")
def neutral_and_selected_rates(spark, sf):
    """Site-specific mutation model, alone and combined with selection."""
    nodes = line_landscape(spark, sf).withColumn("p0", W.neutral_frequencies(LINE_SPACE, _FREQS))
    edges = W.neutral_edges(spark, LINE_SPACE, _EXCHANGE, _FREQS)
    chosen = W.transition_rates(nodes, edges.select("i", "j", "exchange"), NS, LINE_SPACE.n, p0="p0", exchange="exchange")
    both = edges.select("i", "j", "exchange", F.col("rate").alias("neutral")).join(chosen.select("i", "j", "rate"), ["i", "j"])
    return both.select("i", "j", r9("exchange"), r9("neutral"), r9("rate"))


_P0 = " * ".join(f"pow({f}, length(seq) - length(replace(seq, '{a}', '')))" for a, f in zip("ACGT", (0.1, 0.2, 0.3, 0.4)))


@query(f"""WITH {PART_EDGES}, n AS (SELECT idx, seq, y, {_P0} AS p0 FROM part_landscape), s AS (SELECT e.i, e.j, 0.1*(b.y-a.y) AS s, a.p0 AS pi, b.p0 AS pj,
    CASE WHEN translate(a.seq, 'GT', 'AC') = translate(b.seq, 'GT', 'AC') THEN 2.5 ELSE 1.0 END AS x FROM edges e JOIN n a ON a.idx = i JOIN n b ON b.idx = j)
  SELECT i, j, round(CASE WHEN s = 0 THEN 1.0 ELSE s/(exp(0.5*s)-exp(-0.5*s)) END * sqrt(pi*pj)*1024*x, 9) AS sym, round(CASE WHEN s = 0 THEN 1.0 ELSE s/(1-exp(-s)) END * pj*1024*x, 9) AS rate FROM s""")
def hky_substitution_rates(spark, sf):
    """Named nucleotide model (transition/transversion and base frequencies) with selection."""
    freqs, exchange = W.dna_model("HKY85", 5, dict(zip("ACGT", (0.1, 0.2, 0.3, 0.4))), {"a": 1.0, "b": 2.5})
    nodes = part_landscape(spark, sf).withColumn("p0", W.neutral_frequencies(PART_SPACE, freqs))
    edges = W.neutral_edges(spark, PART_SPACE, exchange, freqs).select("i", "j", "exchange")
    return W.transition_rates(nodes, edges, 0.1, PART_SPACE.n, p0="p0", exchange="exchange").select("i", "j", r9("sym"), r9("rate"))


_MODELS = ("F81", "K80", "K81", "TN93", "SYM", "GTR")
_CLASS_RATES = {"a": 1.0, "b": 2.5, "c": 0.7, "d": 1.3, "e": 3.0, "f": 0.4}
_BASES = (0.1, 0.2, 0.3, 0.4)
_PAIR_SQL = "CASE " + " ".join(
    f"WHEN model = '{m}' AND x IN ('{a}{b}', '{b}{a}') THEN {_CLASS_RATES.get(c, 1.0)!r}"
    for m in _MODELS for c, (a, b) in zip(W.DNA_MODELS[m], ("AC", "AG", "AT", "CG", "CT", "GT"))) + " END"


@query(f"""WITH {PART_EDGES}, l AS (SELECT e.i, e.j, a.seq AS s, b.seq AS t FROM edges e JOIN part_landscape a ON a.idx = i JOIN part_landscape b ON b.idx = j),
  x AS (SELECT i, j, t, (SELECT max(substr(s, CAST(k AS INT), 1) || substr(t, CAST(k AS INT), 1)) FROM range(1, 6) r(k) WHERE substr(s, CAST(k AS INT), 1) <> substr(t, CAST(k AS INT), 1)) AS x FROM l),
  m(model) AS (VALUES {', '.join(f"('{m}')" for m in _MODELS)})
  SELECT model, i, j, round(CAST({_PAIR_SQL} AS DOUBLE) * CASE WHEN model IN ('K80', 'K81', 'SYM') THEN pow(0.25, 5) ELSE {_P0.replace('seq', 't')} END, 12) AS rate FROM x, m""")
def named_model_rates(spark, sf):
    """Neutral rates of the other named nucleotide models on the observed states."""
    seen, out = part_landscape(spark, sf).select("idx"), None
    for m in _MODELS:
        freqs, exchange = W.dna_model(m, 5, dict(zip("ACGT", _BASES)), _CLASS_RATES)
        edges = W.neutral_edges(spark, PART_SPACE, exchange, freqs)
        edges = edges.join(seen.withColumnRenamed("idx", "i"), "i", "left_semi").join(seen.withColumnRenamed("idx", "j"), "j", "left_semi")
        rows = edges.select(F.lit(m).alias("model"), "i", "j", F.round("rate", 12).alias("rate"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_RATES} SELECT i, j, round(rate/sum(rate) OVER (PARTITION BY i), 9) AS p FROM rates")
def jump_chain(spark, sf):
    nodes, rates = walk(spark, sf)
    return W.jump_chain(rates, nodes).select("i", "j", r9("p"))


@query(f"WITH {_RATES} SELECT r.j AS i, r.i AS j, round(r.rate*a.p/b.p, 9) AS rate FROM rates r JOIN pi a ON a.idx = r.i JOIN pi b ON b.idx = r.j")
def backward_rates(spark, sf):
    nodes, rates = walk(spark, sf)
    return W.backward_rates(rates, nodes).select("i", "j", r9("rate"))


def _boundary(one: str, zero: str) -> str:
    """System of the probability of reaching ``one`` before ``zero`` (conditions on idx k)."""
    edge = lambda c: f"({c.format(k='i')})"
    fixed = f"({one.format(k='i')} OR {zero.format(k='i')})"
    return f"""sys AS (SELECT a.idx AS i, b.idx AS j, CASE WHEN {fixed.replace('i', 'a.idx')} THEN CASE WHEN a.idx = b.idx THEN 1.0 ELSE 0.0 END
      WHEN a.idx = b.idx THEN l.leave ELSE -coalesce(r.rate, 0) END AS a
    FROM line_landscape a CROSS JOIN line_landscape b JOIN (SELECT i, sum(rate) AS leave FROM rates GROUP BY 1) l ON l.i = a.idx LEFT JOIN rates r ON r.i = a.idx AND r.j = b.idx
    UNION ALL SELECT idx, 42, CASE WHEN {one.format(k='idx')} THEN 1.0 ELSE 0.0 END FROM line_landscape)"""


_START, _END, _AVOID = "AF1", "RO7", "NF4"
_S, _E, _A = (LINE_SPACE.rank(x) for x in (_START, _END, _AVOID))
_Q = _boundary(f"{{k}} = {_E}", f"{{k}} = {_S}")


@query(f"WITH RECURSIVE {_RATES}, {_Q}, {solved(42)} SELECT idx, round(x0, 6) AS q_forward, round(1 - x0, 6) AS q_backward FROM x")
def committor_probabilities(spark, sf):
    """Probability of reaching the end before the start, from every state."""
    nodes, rates = walk(spark, sf)
    q = P.committors(nodes, rates, state_set(spark, _START), state_set(spark, _END))
    return q.select("idx", r6("q_forward").alias("q_forward"), r6("q_backward").alias("q_backward"))


@query(f"WITH RECURSIVE {_RATES}, {_Q}, {solved(42)} SELECT idx, round(x0, 6) AS q FROM x")
def committor_on_space(spark, sf):
    """The same probabilities on the product space itself, without an edge table."""
    nodes = cut(line_landscape(spark, sf).select("idx", "y"))
    q, _ = H.hitting_probability(nodes, LINE_SPACE, NS, state_set(spark, _END), state_set(spark, _START))
    return q.select("idx", r6("q").alias("q"))


WORD_SPACE = S.Space.regular(CUSTOMER_LENGTH, "ACGT")
_STRIDES = ", ".join(f"({4 ** s})" for s in range(CUSTOMER_LENGTH))


@query(f"""WITH {CUSTOMER}, m AS (SELECT row_id % {4 ** CUSTOMER_LENGTH} AS idx, avg(y)/1000.0 AS y FROM customer_dna GROUP BY 1),
  n AS (SELECT t.i AS idx, coalesce(m.y, 0.0) AS y, (t.i % 17)/17.0 AS v FROM range({4 ** CUSTOMER_LENGTH}) t(i) LEFT JOIN m ON m.idx = t.i),
  e AS (SELECT a.idx AS i, a.idx + (b - a.idx//s%4)*s AS j FROM n a, (VALUES {_STRIDES}) st(s), range(4) r(b) WHERE b <> a.idx//s%4),
  r AS (SELECT e.i, 0.5*(b.y - a.y) AS s, abs(b.y - a.y) <= 1e-8 AS flat, b.v - a.v AS dv FROM e JOIN n a ON a.idx = e.i JOIN n b ON b.idx = e.j)
  SELECT i AS idx, round(sum(CASE WHEN flat THEN 1.0 ELSE s/(1-exp(-s)) END * dv), 6) + 0.0 AS u FROM r GROUP BY 1""")
def rates_applied_on_space(spark, sf):
    """Rate matrix times a vector on all 65,536 eight-letter words, in two shuffles and without edges."""
    seen = customer_dna(spark, sf).groupBy(WORD_SPACE.idx_of("seq").alias("idx")).agg((F.avg("y") / 1000.0).alias("y"))
    nodes = spark.range(WORD_SPACE.n).withColumnRenamed("id", "idx").join(seen, "idx", "left")
    nodes = nodes.select("idx", F.coalesce("y", F.lit(0.0)).alias("y"), (F.col("idx") % 17 / 17.0).alias("v"))
    return X.generator_applied(nodes, WORD_SPACE, 0.5).select("idx", (F.round("u", 6) + F.lit(0.0)).alias("u"))


@query(f"WITH RECURSIVE {_RATES}, {_boundary(f'{{k}} = {_E}', f'{{k}} IN ({_S}, {_A})')}, {solved(42)} SELECT idx, round(x0, 6) AS q_forward FROM x")
def committor_with_avoided_state(spark, sf):
    nodes, rates = walk(spark, sf)
    q = P.committors(nodes, rates, state_set(spark, _START), state_set(spark, _END), state_set(spark, _AVOID))
    return q.select("idx", r6("q_forward").alias("q_forward"))


@query(f"""WITH RECURSIVE {_RATES}, t AS (SELECT rates.i, sum(rate) AS into_t FROM rates WHERE j = {_E} GROUP BY 1),
  sys AS (SELECT a.idx AS i, b.idx AS j, CASE WHEN a.idx = {_E} THEN CASE WHEN a.idx = b.idx THEN 1.0 ELSE 0.0 END
      WHEN a.idx = b.idx THEN l.leave WHEN b.idx = {_E} THEN 0.0 ELSE -coalesce(r.rate, 0) END AS a
    FROM line_landscape a CROSS JOIN line_landscape b JOIN (SELECT i, sum(rate) AS leave FROM rates GROUP BY 1) l ON l.i = a.idx LEFT JOIN rates r ON r.i = a.idx AND r.j = b.idx
    UNION ALL SELECT idx, 42, CASE WHEN idx = {_E} THEN 1.0 WHEN seq IN ('RF7', 'AO7') THEN coalesce(into_t, 0.0) ELSE 0.0 END FROM line_landscape LEFT JOIN t ON t.i = idx), {solved(42)}
  SELECT idx, round(x0, 6) AS q FROM x""")
def hitting_through_states(spark, sf):
    """Probability that the last step into the end comes from one of two states."""
    nodes, rates = walk(spark, sf)
    q = P.hitting_through(nodes, rates, state_set(spark, _END), state_set(spark, "RF7", "AO7"))
    return q.select("idx", r6("q").alias("q"))


_FLOW = f"""{_RATES}, {_Q}, {solved(42)}, f AS (SELECT r.i, r.j, p.p*(1-a.x0)*r.rate*b.x0 AS f FROM rates r JOIN pi p ON p.idx = r.i JOIN x a ON a.idx = r.i JOIN x b ON b.idx = r.j),
  flow AS (SELECT a.i, a.j, a.f - b.f AS w FROM f a JOIN f b ON b.i = a.j AND b.j = a.i WHERE a.f > b.f)"""


def flows(spark, sf):
    nodes, rates = walk(spark, sf)
    q = P.committors(nodes, rates, state_set(spark, _START), state_set(spark, _END))
    return cut(P.effective_flows(q, rates))


@query(f"WITH RECURSIVE {_FLOW} SELECT a.i, a.j, round(a.f - b.f, 8) + 0.0 AS net_flow FROM f a JOIN f b ON b.i = a.j AND b.j = a.i WHERE a.i < a.j")
def effective_flows(spark, sf):
    """Net reactive flow along every edge, from the smaller to the larger state (negative against it)."""
    signed = flows(spark, sf).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (F.when(F.col("i") < F.col("j"), 1.0).otherwise(-1.0) * F.col("eff_flow")).alias("w"))
    pairs = LINE_SPACE.edges(spark).where("i < j").join(signed, ["i", "j"], "left")
    return pairs.select("i", "j", (F.round(F.coalesce("w", F.lit(0.0)), 8) + F.lit(0.0)).alias("net_flow"))


@query(f"WITH RECURSIVE {_FLOW} SELECT round(sum(w), 8) AS rate FROM flow WHERE i = {_S}")
def total_reactive_rate(spark, sf):
    return P.reactive_rate(flows(spark, sf), state_set(spark, _START)).select(F.round("rate", 8).alias("rate"))


@query(f"WITH RECURSIVE {_RATES}, {_Q}, {solved(42)}, j AS (SELECT idx, x0*(1-x0)*p AS joint FROM x JOIN pi USING (idx)) SELECT idx, round(joint, 8) + 0.0 AS joint, round(joint/(SELECT sum(joint) FROM j), 6) + 0.0 AS conditional FROM j")
def reactive_state_probabilities(spark, sf):
    nodes, rates = walk(spark, sf)
    q = P.committors(nodes, rates, state_set(spark, _START), state_set(spark, _END))
    out = P.reactive_probabilities(q)
    return out.select("idx", (F.round("joint", 8) + F.lit(0.0)).alias("joint"), r6("conditional").alias("conditional"))


@query(f"""WITH RECURSIVE {_RATES}, {_Q}, {solved(42)}, t AS (SELECT r.i, r.j, CASE WHEN r.i = {_S} THEN r.rate ELSE r.rate*b.x0/a.x0 END AS rate FROM rates r JOIN x a ON a.idx = r.i JOIN x b ON b.idx = r.j
    WHERE r.i <> {_E} AND r.j <> {_S})
  SELECT i, j, round(rate/sum(rate) OVER (PARTITION BY i), 6) AS p FROM t UNION ALL SELECT {_E}, {_E}, 1.0""")
def reactive_jump_chain(spark, sf):
    nodes, rates = walk(spark, sf)
    q = P.committors(nodes, rates, state_set(spark, _START), state_set(spark, _END))
    return P.reactive_jumps(q, rates, state_set(spark, _START), state_set(spark, _END)).select("i", "j", r6("p").alias("p"))


_UPHILL = f"""{PART_EDGES}, up AS (SELECT i, j FROM edges JOIN part_landscape a ON a.idx = i JOIN part_landscape b ON b.idx = j WHERE b.y > a.y)"""


@query(f"""WITH RECURSIVE {_UPHILL}, r(idx) AS (SELECT idx FROM part_landscape WHERE seq = 'ACGTA' UNION SELECT j FROM r JOIN up ON up.i = r.idx) SELECT idx FROM r""")
def reachable_uphill(spark, sf):
    """States that strictly increasing steps can reach from a word."""
    nodes = cut(part_landscape(spark, sf).select("idx", "seq", "y"))
    up = cut(W.with_ends(PART_SPACE.edges(spark), nodes, ["y"]).where("y_j > y_i").select("i", "j"))
    return P.reachable(up, nodes.where("seq = 'ACGTA'")).select("idx")


_WIDEST = f"""{LINE_EDGES}, n AS (SELECT list(y ORDER BY idx) AS ys FROM line_landscape), w AS (SELECT list(r ORDER BY i) AS w FROM (SELECT a.idx AS i, list(CASE WHEN hamming(a.seq, b.seq) = 1 THEN a.y*b.y ELSE 0.0 END ORDER BY b.idx) AS r
    FROM line_landscape a, line_landscape b GROUP BY 1)),
  c(k, caps) AS (SELECT 0, list_transform(ys, lambda v, q: CASE WHEN q = {_S + 1} THEN CAST('inf' AS DOUBLE) ELSE 0.0 END) FROM n
    UNION ALL SELECT k + 1, list_transform(caps, lambda v, q: greatest(v, list_max(list_transform(caps, lambda u, s: least(u, w[s][q]))))) FROM c, w WHERE k < 42)"""


@query(f"WITH RECURSIVE {_WIDEST} SELECT t.i AS idx, round(caps[t.i + 1], 6) AS cap FROM c, range(42) t(i) WHERE k = 42 AND t.i <> {_S}")
def widest_path_capacities(spark, sf):
    """Largest smallest-edge over all paths from a state to every other."""
    nodes = cut(line_landscape(spark, sf).select("idx", "y"))
    edges = cut(W.with_ends(LINE_SPACE.edges(spark), nodes, ["y"]).select("i", "j", (F.col("y_i") * F.col("y_j")).alias("w")))
    out = P.widest_capacities(edges, state_set(spark, _START))
    return out.where(F.col("idx") != _S).select("idx", r6("cap").alias("cap"))


@query(f"WITH RECURSIVE {_WIDEST} SELECT round(caps[{_E + 1}], 6) AS min_flow FROM c WHERE k = 42")
def flow_bottleneck(spark, sf):
    nodes = cut(line_landscape(spark, sf).select("idx", "y"))
    edges = cut(W.with_ends(LINE_SPACE.edges(spark), nodes, ["y"]).select("i", "j", (F.col("y_i") * F.col("y_j")).alias("w")))
    return P.bottleneck(edges, state_set(spark, _START), state_set(spark, _END)).select(r6("min_flow").alias("min_flow"))


@query(f"""WITH RECURSIVE {_WIDEST}, caps AS (SELECT t.i AS idx, caps[t.i + 1] AS cap FROM c, range(42) t(i) WHERE k = 42), m AS (SELECT cap AS w FROM caps WHERE idx = {_E}),
  e AS (SELECT e.i, e.j, a.y*b.y AS w FROM edges e JOIN line_landscape a ON a.idx = e.i JOIN line_landscape b ON b.idx = e.j)
  SELECT round(w, 6) AS min_flow, EXISTS (SELECT 1 FROM e WHERE e.w = m.w) AS is_edge FROM m""")
def flow_bottleneck_edge(spark, sf):
    """The edge that limits the dominant pathway carries the bottleneck flow."""
    nodes = cut(line_landscape(spark, sf).select("idx", "y"))
    edges = cut(W.with_ends(LINE_SPACE.edges(spark), nodes, ["y"]).select("i", "j", (F.col("y_i") * F.col("y_j")).alias("w")))
    found = P.bottleneck_edge(edges, state_set(spark, _START), state_set(spark, _END))
    return found.join(edges, ["i", "j"]).select(r6("min_flow").alias("min_flow"), (F.col("w") == F.col("min_flow")).alias("is_edge"))


@query()
def dominant_pathways(spark, sf):
    """Top pathways with their share of the total flow (checked on small graphs in the tests)."""
    return P.pathways(flows(spark, sf), state_set(spark, _START), state_set(spark, _END))


_DIRECT = f"""{PART_EDGES}, d AS (SELECT idx, y, hamming(seq, 'AAAAA') AS ds, hamming(seq, 'CGCGC') AS de FROM part_landscape),
  up AS (SELECT e.i, e.j, b.y FROM edges e JOIN d a ON a.idx = e.i JOIN d b ON b.idx = e.j WHERE b.ds > a.ds AND b.de < a.de),
  walks(here, nodes, ys) AS (SELECT 0::BIGINT, [0::BIGINT], []::DOUBLE[] UNION ALL SELECT j, list_append(nodes, j), list_append(ys, up.y) FROM walks JOIN up ON up.i = walks.here)"""
_TARGET = PART_SPACE.rank("CGCGC")


@query(f"""WITH RECURSIVE {_DIRECT} SELECT array_to_string(list_transform(list_sort(ys), lambda v: CAST(CAST(round(v*100) AS BIGINT) AS VARCHAR)), ',') AS weights FROM walks WHERE here = {_TARGET}
  ORDER BY list_sort(ys) DESC LIMIT 1""")
def best_direct_path(spark, sf):
    """Node values, sorted, of the path whose lowest value is largest (then the next lowest)."""
    nodes = cut(part_landscape(spark, sf).select("idx", "seq", "y"))
    edges = cut(S.max_min_edges(nodes, PART_SPACE.edges(spark), "AAAAA", "CGCGC", 5, bypasses=False))
    row = P.max_min_path(nodes, edges, 0, _TARGET)
    finite = F.filter("weights", lambda v: v < float("inf"))
    return row.select(F.array_join(F.transform(finite, lambda v: F.round(v * 100).cast("bigint").cast("string")), ",").alias("weights"))


@query(f"WITH RECURSIVE {_DIRECT} SELECT count(*) AS n_paths FROM walks WHERE here = {_TARGET}")
def direct_path_count(spark, sf):
    nodes = part_landscape(spark, sf)
    edges = S.max_min_edges(nodes, PART_SPACE.edges(spark), "AAAAA", "CGCGC", 5, bypasses=False)
    return P.count_paths(edges, 0, _TARGET, 5)


@query(f"""WITH RECURSIVE {_UPHILL}, walks(here, k) AS (SELECT idx, 0 FROM part_landscape WHERE seq = 'ACGTA' UNION ALL SELECT j, k + 1 FROM walks JOIN up ON up.i = walks.here WHERE k < 4)
  SELECT count(*) AS n_paths FROM walks WHERE here = (SELECT arg_max(idx, y) FROM part_landscape WHERE hamming(seq, 'ACGTA') = 2) AND k > 0""")
def uphill_path_count(spark, sf):
    """Strictly increasing paths of at most four steps to the best state two changes away."""
    nodes = cut(part_landscape(spark, sf).select("idx", "seq", "y"))
    up = cut(W.with_ends(PART_SPACE.edges(spark), nodes, ["y"]).where("y_j > y_i").select("i", "j"))
    near = F.expr(" + ".join(f"IF(substr(seq, {s + 1}, 1) <> substr('ACGTA', {s + 1}, 1), 1, 0)" for s in range(5))) == 2
    end = nodes.where(near).agg(F.max_by("idx", "y")).first()[0]
    return P.count_paths(up, PART_SPACE.rank("ACGTA"), end, 4)


@query(f"""WITH RECURSIVE {_RATES}, l AS (SELECT i, sum(rate) AS leave, sum(sym) AS outs FROM rates GROUP BY 1), b AS (SELECT max(leave + outs) AS bound FROM l),
  a AS (SELECT x.idx AS i, z.idx AS j, CASE WHEN x.idx = z.idx THEN 1 - l.leave/bound ELSE coalesce(r.sym, 0)/bound END - sqrt(x.p*z.p) AS a
    FROM pi x CROSS JOIN pi z JOIN l ON l.i = x.idx CROSS JOIN b LEFT JOIN rates r ON r.i = x.idx AND r.j = z.idx),
  m0 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(a ORDER BY j) AS r FROM a GROUP BY 1)),
  g(k, m, e) AS (SELECT 0, m, m FROM m0 UNION ALL SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda v: v / list_sum(list_transform(range(1, 43), lambda d: q[d][d])))), e FROM (
    SELECT k, e, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS q FROM g WHERE k < 24)),
  v AS (SELECT list_dot_product(list_transform(e, lambda r: list_dot_product(r, m[1])), m[1]) / list_dot_product(m[1], m[1]) AS top FROM g WHERE k = 24)
  SELECT round((1 - top)*bound, 6) AS decay_rate FROM v, b""")
def slowest_decay_rate(spark, sf):
    """Smallest non-zero rate of the walk, by the Krylov solver."""
    nodes, rates = walk(spark, sf)
    _, decay = E.diffusion_axes(nodes, rates, 1)
    return decay.select(r6("decay_rates").alias("decay_rate"))


@query()
def diffusion_axes(spark, sf):
    """Embedding in the slowest modes (compared with dense eigenvectors in the tests)."""
    nodes, rates = walk(spark, sf)
    placed, _ = E.diffusion_axes(nodes, rates, 2)
    return placed.select("idx", "seq", "axis_1", "axis_2", "p")


FOUR_SPACE = S.Space.regular(4, "ACGT")


def word_means(spark, sf, space):
    """``(idx, y)``: mean account balance (1,000s) per customer key modulo the states, zero where there is no customer."""
    seen = customer_dna(spark, sf).groupBy(F.pmod("row_id", F.lit(space.n)).alias("idx")).agg((F.avg("y") / 1000.0).alias("y"))
    nodes = spark.range(space.n).withColumnRenamed("id", "idx").join(seen, "idx", "left")
    return cut(nodes.select("idx", F.coalesce("y", F.lit(0.0)).alias("y")))


def _slowest_sql(k: int) -> str:
    """k smallest non-zero rates of the 256-state walk: powers of the shifted matrix, each mode taken out once it is found."""
    matrix = "list_transform(q, lambda r: list_transform(r, lambda v: v / list_sum(list_transform(range(1, 257), lambda d: q[d][d]))))"
    steps, held = [], "m0"
    for c in range(k):
        steps.append(f"""g{c}(n, m) AS (SELECT 0, m FROM {held} UNION ALL SELECT n + 1, {matrix} FROM (
    SELECT n, list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c))) AS q FROM g{c} WHERE n < 20)),
  v{c} AS (SELECT list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) AS v FROM (
    SELECT m[(SELECT arg_max(i, abs(m[i][i])) FROM range(1, 257) t(i))] AS u FROM g{c} WHERE n = 20)),
  t{c} AS (SELECT list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS top FROM {held}, v{c}),
  m{c + 1} AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - top * v[i] * v[j])) AS m FROM {held}, v{c}, t{c})""")
        held = f"m{c + 1}"
    return ",\n  ".join(steps)


@query(f"""WITH RECURSIVE {CUSTOMER}, s AS (SELECT row_id % 256 AS idx, avg(y)/1000.0 AS y FROM customer_dna GROUP BY 1),
  n AS (SELECT t.i AS idx, coalesce(s.y, 0.0) AS y FROM range(256) t(i) LEFT JOIN s ON s.idx = t.i),
  pi AS (SELECT idx, exp(0.5*(y - (SELECT max(y) FROM n))) / (SELECT sum(exp(0.5*(y - (SELECT max(y) FROM n)))) FROM n) AS p FROM n),
  e AS (SELECT a.idx AS i, b.idx AS j, 0.5*(b.y - a.y) AS s FROM n a, n b WHERE a.idx <> b.idx AND
    (a.idx//64 <> b.idx//64)::INT + (a.idx//16%4 <> b.idx//16%4)::INT + (a.idx//4%4 <> b.idx//4%4)::INT + (a.idx%4 <> b.idx%4)::INT = 1),
  r AS (SELECT i, j, CASE WHEN abs(s) < 1e-9 THEN 1.0 ELSE s/(exp(0.5*s)-exp(-0.5*s)) END AS sym, CASE WHEN abs(s) < 1e-9 THEN 1.0 ELSE s/(1-exp(-s)) END AS rate FROM e),
  l AS (SELECT i, sum(rate) AS leave, sum(sym) AS outs FROM r GROUP BY 1), b AS (SELECT max(leave + outs) AS bound FROM l),
  a AS (SELECT x.idx AS i, z.idx AS j, CASE WHEN x.idx = z.idx THEN 1 - l.leave/bound ELSE coalesce(r.sym, 0)/bound END - sqrt(x.p*z.p) AS a
    FROM pi x CROSS JOIN pi z JOIN l ON l.i = x.idx CROSS JOIN b LEFT JOIN r ON r.i = x.idx AND r.j = z.idx),
  m0 AS (SELECT list(q ORDER BY i) AS m FROM (SELECT i, list(a ORDER BY j) AS q FROM a GROUP BY 1)),
  {_slowest_sql(3)}
  SELECT 1 AS k, round((1 - t0.top)*bound, 6) AS decay_rate FROM t0, b UNION ALL SELECT 2, round((1 - t1.top)*bound, 6) FROM t1, b
  UNION ALL SELECT 3, round((1 - t2.top)*bound, 6) FROM t2, b""")
def space_decay_rates(spark, sf):
    """Three slowest rates of the walk on 256 words, without an edge table."""
    _, decay, _ = M.diffusion_axes_on_space(word_means(spark, sf, FOUR_SPACE), FOUR_SPACE, 0.5, 3, rtol=1e-6)
    return decay.select("k", r6("decay_rates").alias("decay_rate"))


@query()
def committor_on_words(spark, sf):
    """Probability of reaching the best of the 65,536 eight-letter words before the worst one."""
    nodes = word_means(spark, sf, WORD_SPACE)
    best, worst = nodes.agg(F.max_by("idx", F.struct("y", "idx")), F.min_by("idx", F.struct("y", "idx"))).first()
    one = lambda i: spark.createDataFrame([(i,)], "idx bigint")
    q, _ = H.hitting_probability(nodes, WORD_SPACE, 0.5, one(best), one(worst))
    return q.select("idx", r6("q").alias("q"))


@query()
def space_diffusion_axes(spark, sf):
    """Embedding of all 65,536 eight-letter words (compared with dense eigenvectors on small spaces in the tests)."""
    placed, _, _ = M.diffusion_axes_on_space(word_means(spark, sf, WORD_SPACE), WORD_SPACE, 0.2, 3, rtol=1e-6)
    return placed


@query()
def embedding_sweep(spark, sf):
    """Three axes at twelve selection strengths, from the neutral walk on, each started from the one before."""
    nodes = cut(line_landscape(spark, sf).select("idx", "seq", "y"))
    placed = M.ns_sweep_on_space(nodes, LINE_SPACE, E.sweep_targets(nodes, 12, pmin=0.0), k=3)
    return placed.join(nodes.select("idx", "seq"), "idx")
