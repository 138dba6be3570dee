"""Spaces of sequences: configuration, state tables, mutation graphs and validity reports.

A state's ``idx`` is its mixed-radix rank (last site fastest), so states, lookups and the
Hamming graph of a product space are plain arithmetic over ``range`` and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import ceil, prod

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from terrane.constants import DNA, codon_table
from terrane.functions.seqcols import (
    char_at, col, default_alphabet, hamming, literal_map, mask_site, total, translate,
)
from terrane.operators.ranking import hash_rank
from terrane.session import cut, small_rows

MAX_SITES = 100_000  # a sequence length that one row per site still fits


def int64(x) -> Column:
    return F.lit(int(x)).cast("bigint")


def quotient(a: Column, b: Column) -> Column:
    """Whole-number division; a division of doubles loses the low digits of a large index."""
    return F.call_function("div", a, b)


@dataclass(frozen=True)
class Space:
    """Alleles per site, in the order that defines the state index."""

    alleles: tuple[str, ...]

    @classmethod
    def regular(cls, length: int, alphabet: str) -> Space:
        return cls((alphabet,) * length)

    @classmethod
    def of(cls, length: int, n_alleles: int | None = None, kind: str = "custom") -> Space:
        return cls.regular(length, default_alphabet(n_alleles, kind))

    @property
    def length(self) -> int:
        return len(self.alleles)

    @property
    def radices(self) -> tuple[int, ...]:
        return tuple(len(a) for a in self.alleles)

    @property
    def strides(self) -> tuple[int, ...]:
        r = self.radices
        return tuple(prod(r[s + 1:]) for s in range(len(r)))

    @property
    def n(self) -> int:
        return prod(self.radices)

    @property
    def is_regular(self) -> bool:
        return len(set(self.radices)) == 1

    @property
    def alpha(self) -> int:
        if not self.is_regular:
            raise ValueError("needs a constant number of alleles across sites")
        return self.radices[0]

    @property
    def indexed(self) -> bool:
        """Whether every state has a 63-bit index."""
        return self.n < 2 ** 63

    def check_size(self) -> None:
        if not self.indexed:
            raise ValueError(f"{self.n} states have no 63-bit index")

    def digit_sql(self, site: int, idx: str = "idx") -> str:
        """SQL text for the ordinal of the allele a state index has at a site."""
        return "0L" if self.radices[site] == 1 else f"({idx} div {self.strides[site]}L % {self.radices[site]}L)"

    def digit(self, idx: Column | str, site: int) -> Column:
        """Ordinal of the allele a state index has at a site."""
        if isinstance(idx, str):
            return F.expr(self.digit_sql(site, idx))
        return F.lit(0).cast("bigint") if self.radices[site] == 1 else quotient(idx, int64(self.strides[site])) % self.radices[site]

    def seq_of(self, idx: Column | str) -> Column:
        return F.concat(*[
            F.substr(F.lit(a), (self.digit(idx, s) + 1).cast("int"), F.lit(1)) for s, a in enumerate(self.alleles)
        ])

    def idx_of(self, seq: Column | str) -> Column:
        """State index of a sequence; null when it is not in the space."""
        parts = []
        for s, (a, stride) in enumerate(zip(self.alleles, self.strides)):
            at = F.instr(F.lit(a), char_at(seq, s))
            parts.append(F.when(at > 0, (at - 1).cast("bigint") * int64(stride)))
        return F.when(F.length(col(seq)) == self.length, total(parts))

    def idx_or_fail(self, seq: Column | str) -> Column:
        """State index; a sequence outside the space stops the job.

        The last branch is never reached. It tells the optimizer that the index cannot be null, which
        keeps it from testing the whole expression again on every input row below a join.
        """
        outside = F.raise_error(F.concat(F.lit("outside the sequence space: "), col(seq))).cast("bigint")
        return F.coalesce(self.idx_of(seq), outside, F.lit(-1).cast("bigint"))

    def digits(self, seq: str) -> list[int]:
        """Ordinals of one given sequence (driver side)."""
        return [site.index(a) for site, a in zip(self.alleles, seq, strict=True)]

    def rank(self, seq: str) -> int:
        return sum(d * stride for d, stride in zip(self.digits(seq), self.strides))

    def states(self, spark: SparkSession) -> DataFrame:
        """``(idx, seq)`` of the whole space, generated without a shuffle."""
        self.check_size()
        return spark.range(self.n).select(F.col("id").alias("idx"), self.seq_of("id").alias("seq"))

    def sites(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s, a, o, len(site), stride)
            for s, (site, stride) in enumerate(zip(self.alleles, self.strides)) for o, a in enumerate(site)
        ]
        return spark.createDataFrame(rows, "site int, allele string, ord int, radix int, stride bigint")

    def moves(self) -> Column:
        """Literal array with one (site, stride, radix, target ordinal) per allele of the space."""
        return F.array(*[
            F.struct(F.lit(s).alias("site"), int64(stride).alias("stride"), int64(r).alias("radix"), int64(b).alias("b"))
            for s, (r, stride) in enumerate(zip(self.radices, self.strides)) for b in range(r)
        ])

    def expand_neighbours(self, df: DataFrame, idx: str = "idx", out: str = "j") -> DataFrame:
        """Each row once per state one substitution away: ``out``, ``site`` and ordinals ``a``, ``b``."""
        m = df.withColumn("_m", F.explode(self.moves()))
        m = m.withColumn("a", quotient(F.col(idx), F.col("_m.stride")) % F.col("_m.radix"))
        m = m.where(F.col("a") != F.col("_m.b"))
        return m.select(
            *df.columns, F.col("_m.site").alias("site"), "a", F.col("_m.b").alias("b"),
            (F.col(idx) + (F.col("_m.b") - F.col("a")) * F.col("_m.stride")).alias(out),
        )

    def edges(self, spark: SparkSession) -> DataFrame:
        """Hamming graph ``(i, j)``, both directions, without a join or a shuffle."""
        self.check_size()
        return self.expand_neighbours(spark.range(self.n).withColumnRenamed("id", "i"), "i").select("i", "j")


# --- space inference -----------------------------------------------------------------

def site_alleles(df: DataFrame, seq: str = "seq", order: str = "row_id") -> DataFrame:
    """``(site, allele, first_seen)``: alleles of every site with their first appearance."""
    cells = df.select(F.col(order).alias("_o"), F.posexplode(F.split(seq, "")).alias("site", "allele"))
    return cells.where(F.col("allele") != "").groupBy("site", "allele").agg(F.min("_o").alias("first_seen"))


def infer_space(
    df: DataFrame, seq: str = "seq", order: str | None = None, full: bool = True,
    regular: bool = False, shared_alleles: bool = False,
) -> Space:
    """Alleles per site in first-appearance order of ``order`` (the sequence itself by default)."""
    cells = site_alleles(df, seq, order or seq).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("first_seen", "allele"))).alias("seen"))
    rows = small_rows(cells.select("site", F.transform("seen", lambda x: x["allele"]).alias("alleles")), MAX_SITES, "sites")  # a row per site
    per_site = [list(r.alleles) for r in sorted(rows, key=lambda r: r.site)]
    length = len(per_site)
    if full:
        expected, found = prod(len(a) for a in per_site), df.select(seq).distinct().count()
        if expected != found:
            raise ValueError(f"{found} sequences given, {expected} expected from the alleles per site")
    if regular:
        if shared_alleles:
            union = sorted({a for site in per_site for a in site})
            per_site = [union] * length
        elif len({len(a) for a in per_site}) > 1:
            per_site = [_padded(site, max(len(a) for a in per_site)) for site in per_site]
    return Space(tuple("".join(a) for a in per_site))


def _padded(site: list[str], size: int) -> list[str]:
    fresh = (str(i) for i in range(size + len(site)) if str(i) not in site)
    return sorted(site + [next(fresh) for _ in range(size - len(site))])


# --- values on a space ---------------------------------------------------------------

def attach_values(space: Space, states: DataFrame, values: DataFrame, stop_y: float | None = None, y: str = "y") -> DataFrame:
    """Left join of values on the full space; rows with a stop ``*`` get ``stop_y``."""
    out = states.join(values.select("seq", y), "seq", "left")
    if stop_y is not None:
        out = out.withColumn(y, F.when(F.col("seq").contains("*"), F.lit(float(stop_y))).otherwise(F.col(y)))
    return out.select("idx", "seq", y)


def require_complete(df: DataFrame, y: str = "y") -> DataFrame:
    """Fail at run time on the first state without a value."""
    message = F.concat(F.lit("no value for state "), F.col("seq"))
    return df.withColumn(y, F.coalesce(F.col(y), F.raise_error(message).cast("double")))


def sequence_space(spark: SparkSession, values: DataFrame, space: Space | None = None, stop_y: float | None = None) -> tuple[Space, DataFrame]:
    """Space and node table from a complete table of values."""
    space = space or infer_space(values)
    return space, require_complete(attach_values(space, space.states(spark), values, stop_y))


# --- graphs over arbitrary sequence lists ----------------------------------------------

BLOCK_ROWS = 1024         # of one sequence that travel together
TASK_PAIRS = 1 << 23      # that a task of a join with copies returns


def _masked_cells(seq: str, length: int) -> Column:
    return F.explode(F.array(*[
        F.struct(mask_site(seq, s).alias("key"), F.lit(s).alias("site"), char_at(seq, s).alias("allele")) for s in range(length)
    ])).alias("c")


@dataclass(frozen=True)
class UnlistedEdges:
    """Edges between rows whose sequences repeat, held as the rows and the edges of the distinct sequences.

    Their pairs grow with the product of the copies; which rows a set of rows is joined with needs none of them.
    All joins merge: sets of rows and words may be large, and sizes guessed from compressed files would have them broadcast.
    """

    rows: DataFrame   # idx, seq
    words: DataFrame  # i, j: sequences

    def ends(self, frontier: DataFrame) -> DataFrame:
        """Distinct ``idx`` of the rows that an edge leads to from a row of ``frontier``."""
        left = self.rows.join(frontier.select("idx").hint("merge"), "idx", "left_semi").select(F.col("seq").alias("i")).distinct()
        met = self.words.join(left.hint("merge"), "i", "left_semi").select(F.col("j").alias("seq")).distinct()
        return self.rows.join(met.hint("merge"), "seq", "left_semi").select("idx").distinct()


def hamming_edges(nodes: DataFrame, length: int, idx: str = "idx", seq: str = "seq", copies: bool = False, listed: bool = True) -> DataFrame | UnlistedEdges:
    """Pairs at Hamming distance 1, by equality of masked sequences and different letters at the mask.

    Among distinct sequences a masked key is shared by at most one row per allele, so the self-join
    cannot blow up. ``copies`` is for tables where many rows have one sequence: see :func:`_edges_of_copies`.
    Without ``listed`` the same edges come as :class:`UnlistedEdges`, for searches that only ask where edges lead.
    """
    if not listed:
        rows = nodes.select(F.col(idx).alias("idx"), F.col(seq).alias("seq"))
        return UnlistedEdges(rows, hamming_edges(rows.select("seq").distinct().hint("merge"), length, "seq"))
    if copies:
        return _edges_of_copies(nodes, length, idx, seq)
    cells = _masked_cells(seq, length)
    side = lambda k: nodes.select(F.col(idx).alias(k), cells).select(k, "c.key", "c.site", F.col("c.allele").alias(f"allele_{k}"))
    return side("i").join(side("j"), ["key", "site"]).where("allele_i <> allele_j").select("i", "j")


def _edges_of_copies(nodes: DataFrame, length: int, idx: str, seq: str) -> DataFrame:
    """The same pairs where sequences repeat: blocks of equal sequences are joined, dealt out, and only then taken apart.

    The pairs grow with the product of the copies, so their number is counted first (from the distinct sequences) and decides
    how many tasks return them. A frequent sequence is split into blocks by the hash of its ids.
    """
    cells = _masked_cells(seq, length)
    words = nodes.groupBy(seq).agg(F.count(F.lit(1)).cast("double").alias("n")).select("n", cells)
    groups = words.groupBy("c.key", "c.site").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.max("n").alias("most"))
    size = groups.where("key IS NOT NULL").agg(F.sum(F.col("n") * F.col("n") - F.col("own")).alias("pairs"), F.max("most").alias("most")).first()
    block = F.pmod(F.xxhash64(F.col(idx)), int64(ceil((size.most or 1) / BLOCK_ROWS))).alias("block")
    # in a struct, as collect_list leaves null out
    blocks = nodes.select(F.col(idx).alias("id"), F.col(seq).alias("seq"), block).groupBy("seq", "block").agg(F.collect_list(F.struct("id")).alias("ids"))
    side = lambda k: blocks.select(F.col("ids.id").alias(f"ids_{k}"), F.col("block").alias(f"block_{k}"), _masked_cells("seq", length)).select(
        f"ids_{k}", f"block_{k}", "c.key", "c.site", F.col("c.allele").alias(f"allele_{k}"))
    met = side("i").join(side("j"), ["key", "site"]).where("allele_i <> allele_j")
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil((size.pairs or 0) / TASK_PAIRS))
    dealt = met.repartition(tasks, "key", "site", "allele_i", "block_i", "allele_j", "block_j")
    return dealt.select(F.explode("ids_i").alias("i"), "ids_j").select("i", F.explode("ids_j").alias("j"))


def hamming_ball(spark: SparkSession, centre: str, space: Space, d: int) -> DataFrame:
    """``(idx, seq, distance)`` of every sequence within ``d`` substitutions of ``centre``.

    The ball is built from sequences, so any length will do. ``idx`` is the state index of the space, or, where the space is
    too large to have one, a rank inside the ball.
    """
    own = F.array(*[F.lit(a) for a in centre])
    space.digits(centre)  # a centre outside the space stops here
    others = F.array(*[F.array(*[F.lit(x) for x in site if x != a]).cast("array<string>") for site, a in zip(space.alleles, centre)])
    ball = spark.range(1).select(F.lit(centre).alias("seq"), F.lit(0).alias("distance"), F.lit(0).alias("last"))
    shell = ball
    for k in range(1, d + 1):
        # sites change in increasing order, so every sequence of a shell is reached once
        sites = F.filter(F.sequence(F.lit(1), F.lit(space.length)), lambda s: s > F.col("last"))
        grown = shell.select("seq", F.explode(sites).alias("site"))
        grown = grown.select("seq", "site", F.explode(F.element_at(others, F.col("site"))).alias("allele"))
        changed = F.concat(F.substr("seq", F.lit(1), F.col("site") - 1), "allele", F.substr("seq", F.col("site") + 1, F.lit(space.length)))
        shell = grown.select(changed.alias("seq"), F.lit(k).alias("distance"), F.col("site").alias("last"))
        ball = ball.unionByName(shell)
    if space.indexed:
        return ball.select(space.idx_of("seq").alias("idx"), "seq", "distance")
    return hash_rank(ball, "seq", 0, "idx").select("idx", "seq", "distance")


def hamming_ball_of(df: DataFrame, centre: str, seq: str = "seq", alphabet: str | None = None) -> DataFrame:
    """The ball around ``centre`` that reaches the farthest sequence of ``df``.

    Alleles are those seen at each site with the centre's own, or ``alphabet`` at every site.
    """
    seen = df.agg(F.max(hamming(seq, F.lit(centre), len(centre))).alias("d"), F.max(F.length(seq)).alias("longest"), F.min(F.length(seq)).alias("shortest")).first()
    if {seen.longest, seen.shortest} - {len(centre), None}:
        raise ValueError("sequences and centre differ in length")
    if alphabet is None:
        alleles = _site_letters(df, seq)
        space = Space(tuple("".join(sorted({a, *alleles.get(s, "")})) for s, a in enumerate(centre)))
    else:
        space = Space.regular(len(centre), alphabet)
    return hamming_ball(df.sparkSession, centre, space, seen.d or 0)


def _site_letters(df: DataFrame, seq: str) -> dict[int, str]:
    cells = df.select(F.posexplode(F.split(seq, "")).alias("site", "allele")).where("allele <> ''")
    rows = cells.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("allele")), "").alias("alleles"))
    return {r.site: r.alleles for r in small_rows(rows, MAX_SITES, "sites")}


# --- codons ----------------------------------------------------------------------------

def codon_substitutions(table: str | Mapping[str, str] = "Standard") -> dict[tuple[str, str], int]:
    """Number of one-nucleotide codon changes between two residues (64 codons, driver side)."""
    codons = table if isinstance(table, Mapping) else codon_table(table)
    counts: dict[tuple[str, str], int] = {}
    for codon, residue in codons.items():
        for s in range(3):
            for base in DNA:
                other = codon[:s] + base + codon[s + 1:]
                if other != codon:
                    pair = (residue, codons[other])
                    counts[pair] = counts.get(pair, 0) + 1
    return counts


def codon_edges(space: Space, spark: SparkSession, table: str | Mapping[str, str] = "Standard") -> DataFrame:
    """Hamming edges of a residue space that one nucleotide change can make."""
    allowed = literal_map({a + b: True for a, b in codon_substitutions(table)})
    edges = space.expand_neighbours(spark.range(space.n).withColumnRenamed("id", "i"), "i")
    letters = F.array(*[F.lit(a) for a in space.alleles])
    site = F.element_at(letters, F.col("site") + 1)
    letter = lambda o: F.substr(site, (F.col(o) + 1).cast("int"), F.lit(1))
    return edges.where(F.element_at(allowed, F.concat(letter("a"), letter("b")))).select("i", "j")


def to_nucleotide_space(proteins: DataFrame, residues: int, spark: SparkSession, table="Standard", alphabet: str = DNA) -> tuple[Space, DataFrame]:
    """Landscape of every nucleotide sequence, valued by the protein it encodes."""
    space = Space.regular(3 * residues, alphabet)
    states = space.states(spark).withColumn("protein", translate("seq", table, space.length))
    joined = states.join(proteins.select(F.col("seq").alias("protein"), "y"), "protein", "left")
    return space, require_complete(joined.select("idx", "seq", "protein", "y"))


# --- product and grid spaces -------------------------------------------------------------

def product_edges(spark: SparkSession, radices: Sequence[int], links: Sequence[Sequence[tuple[int, int, float]]]) -> DataFrame:
    """Cartesian product of elementary graphs given as (a, b, weight) lists: ``(i, j, w)``."""
    n = prod(radices)
    moves = F.array(*[
        F.struct(
            int64(prod(radices[s + 1:])).alias("stride"), int64(radices[s]).alias("radix"),
            int64(a).alias("a"), int64(b).alias("b"), F.lit(float(w)).alias("w"),
        ) for s, site in enumerate(links) for a, b, w in site
    ])
    m = spark.range(n).select(F.col("id").alias("i"), F.explode(moves).alias("m"))
    m = m.where(quotient(F.col("i"), F.col("m.stride")) % F.col("m.radix") == F.col("m.a"))
    return m.select("i", (F.col("i") + (F.col("m.b") - F.col("m.a")) * F.col("m.stride")).alias("j"), F.col("m.w").alias("w"))


def product_states(spark: SparkSession, labels: Sequence[Sequence[str]]) -> DataFrame:
    """``(idx, label)`` with elementary labels joined by ``-``, last graph fastest."""
    radices = [len(x) for x in labels]
    digit = lambda s: (quotient(F.col("id"), int64(prod(radices[s + 1:]))) % radices[s] + 1).cast("int")
    parts = [F.element_at(F.array(*[F.lit(x) for x in site]), digit(s)) for s, site in enumerate(labels)]
    return spark.range(prod(radices)).select(F.col("id").alias("idx"), F.concat_ws("-", *parts).alias("label"))


def grid_space(spark: SparkSession, length: int, ndim: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(idx, label, x0..)`` and edges of a lattice."""
    links = [(a, a + d, 1.0) for a in range(length) for d in (1, -1) if 0 <= a + d < length]
    nodes = product_states(spark, [[str(x) for x in range(length)]] * ndim)
    for s in range(ndim):
        nodes = nodes.withColumn(f"x{s}", quotient(F.col("idx"), int64(length ** (ndim - 1 - s))) % length)
    return nodes, product_edges(spark, [length] * ndim, [links] * ndim)


def peak_surface(nodes: DataFrame, peaks: Sequence[Sequence[float]], sigma: float = 1.0, axes: Sequence[str] = ("x0", "x1")) -> DataFrame:
    """log-sum-exp over peaks of minus the L1 distance over sigma, added as ``y``."""
    d = [-total(F.abs(F.col(a) - F.lit(float(p))) for a, p in zip(axes, peak)) / F.lit(float(sigma)) for peak in peaks]
    top = F.greatest(*d) if len(d) > 1 else d[0]
    return nodes.withColumn("y", top + F.log(total(F.exp(x - top) for x in d)))


# --- graph summaries -----------------------------------------------------------------------

def degree_stats(edges: DataFrame) -> DataFrame:
    """One row: directed edge count, smallest and largest degree, regular or not."""
    degree = edges.groupBy("i").agg(F.count("*").alias("d"))
    return degree.agg(
        F.sum("d").alias("n_edges"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"),
        (F.min("d") == F.max("d")).alias("regular"),
    )


def validity_report(nodes: DataFrame, edges: DataFrame, weight: str = "w", tol: float = 1e-6) -> DataFrame:
    """One row of violation counts; a valid discrete space has zero in each."""
    there = edges.select("i", "j", F.col(weight).alias("w"), F.lit(0.0).alias("v"))
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("w"), F.col(weight).alias("v"))
    folded = there.unionByName(back).groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    pair_checks = folded.agg(
        F.count_if(F.col("i") == F.col("j")).alias("loops"),
        F.count_if(F.abs(F.col("w") - F.col("v")) > tol).alias("asymmetric"),
        F.count_if(F.col("w") < 0).alias("negative"),
    )
    ends = edges.select(F.col("i").alias("idx")).unionByName(edges.select(F.col("j").alias("idx"))).distinct()
    orphans = ends.join(nodes.select("idx"), "idx", "left_anti").agg(F.count("*")).scalar()
    missing = nodes.agg(F.count_if(F.col("y").isNull())).scalar()
    return pair_checks.withColumn("orphans", orphans).withColumn("missing_y", missing)


def neighbourhood(edges: DataFrame | UnlistedEdges, seeds: DataFrame, max_distance: int) -> DataFrame:
    """``(idx, hops)`` of every state within ``max_distance`` edges of the seeds."""
    if isinstance(edges, UnlistedEdges):
        ends = edges.ends
    else:
        ends = lambda frontier: frontier.join(edges, F.col("idx") == F.col("i")).select(F.col("j").alias("idx")).distinct()
    reached = seeds.select("idx").distinct().withColumn("hops", F.lit(0))
    frontier = reached
    for k in range(1, max_distance + 1):
        frontier = ends(frontier).join(reached.hint("merge"), "idx", "left_anti").withColumn("hops", F.lit(k))
        reached = reached.unionByName(frontier)
        if k % 3 == 0:
            reached = cut(reached)
            frontier = reached.where(F.col("hops") == k)
    return reached


def lower_neighbour_counts(nodes: DataFrame, space: Space, y: str = "y") -> DataFrame:
    """``n_lower`` per state: neighbours in the Hamming graph with a strictly lower value.

    Sequences that differ only at one site form a window group of at most one row per allele;
    rank - 1 inside it counts the lower ones. Sites are handled in two blocks that each need a
    single shuffle, and no edge is ever materialised.
    """
    out, counts = nodes, []
    for block in site_blocks(space):
        out, key = block_partition(out, space, block)
        for s in block:
            group = W.partitionBy(key, *rest_digits(space, block, s)).orderBy(y)
            out = out.withColumn(f"_lower{s}", F.rank().over(group) - 1)
            counts.append(F.col(f"_lower{s}"))
        out = out.drop(key)
    return out.withColumn("n_lower", total(counts).cast("bigint")).drop(*[f"_lower{s}" for s in range(space.length)])


def site_blocks(space: Space) -> list[list[int]]:
    """Split the sites so that a block holds about the square root of the states."""
    blocks: list[list[int]] = [[]]
    for s in range(space.length):
        held = prod(space.radices[t] for t in blocks[-1])
        if len(blocks) == 1 and blocks[0] and held * held >= space.n:
            blocks.append([])
        blocks[-1].append(s)
    return blocks


def block_key_sql(space: Space, block: Sequence[int]) -> str:
    """SQL text that is equal for all states that differ only inside ``block``."""
    rest = [s for s in range(space.length) if s not in block]
    return " + ".join(f"{space.digit_sql(s)} * {space.strides[s]}L" for s in rest) or "0L"


def block_partition(df: DataFrame, space: Space, block: Sequence[int], key: str = "_block") -> tuple[DataFrame, str]:
    """Shuffle once so that all states that differ only inside ``block`` are together."""
    return df.selectExpr("*", f"{block_key_sql(space, block)} AS {key}").repartition(key), key


def rest_digits(space: Space, block: Sequence[int], site: int) -> list[Column]:
    """Digits of the other sites of a block; with the block key they identify a mask group."""
    return [space.digit("idx", t) for t in block if t != site]


def local_optima(nodes: DataFrame, edges: DataFrame, y: str = "y") -> DataFrame:
    """States of any graph whose number of strictly lower neighbours is the largest found."""
    fi = nodes.select(F.col("idx").alias("i"), F.col(y).alias("_fi"))
    fj = nodes.select(F.col("idx").alias("j"), F.col(y).alias("_fj"))
    lower = edges.select("i", "j").join(fi, "i").join(fj, "j").where("_fi > _fj")
    counts = lower.groupBy("i").agg(F.count("*").alias("n_lower")).withColumnRenamed("i", "idx")
    counted = nodes.join(counts, "idx", "left").withColumn("n_lower", F.coalesce("n_lower", int64(0)))
    return counted.where(F.col("n_lower") == counted.agg(F.max("n_lower")).scalar())


def sequence_local_optima(nodes: DataFrame, space: Space, y: str = "y") -> DataFrame:
    """Same selection for sequences of a space, through ranks in mask groups."""
    counted = lower_neighbour_counts(nodes, space, y)
    return counted.where(F.col("n_lower") == counted.agg(F.max("n_lower")).scalar())


def max_min_edges(nodes: DataFrame, edges: DataFrame, start: str, end: str, length: int, bypasses: bool, monotonic: bool = False, y: str = "y") -> DataFrame:
    """Edges that do not lead away from ``end`` or back to ``start`` (strictly, without bypasses)."""
    d = nodes.select("idx", F.col(y).alias("y"), hamming("seq", F.lit(start), length).alias("ds"), hamming("seq", F.lit(end), length).alias("de"))
    side = lambda k: d.select(F.col("idx").alias(k), F.col("y").alias(f"y{k}"), F.col("ds").alias(f"ds{k}"), F.col("de").alias(f"de{k}"))
    e = edges.select("i", "j").join(side("i"), "i").join(side("j"), "j")
    e = e.where("dsj >= dsi and dej <= dei" if bypasses else "dsj > dsi and dej < dei")
    if monotonic:
        e = e.where("yj >= yi")
    return e.select("i", "j")
