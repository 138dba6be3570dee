"""Sequence and scalar derivations as Catalyst column expressions (no UDFs, no shuffles)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from terrane.constants import (
    ALPHABETS, AMBIGUITY, CODON_BASES, COMPLEMENT_FROM, COMPLEMENT_TO, LETTERS, MAX_EXPONENT, PROTEIN, codon_table,
)
from terrane.session import small_rows


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def char_at(seq: Column | str, site: int) -> Column:
    """Allele at a 0-based site."""
    return F.substring(col(seq), site + 1, 1)


def total(parts: Iterable[Column]) -> Column:
    return reduce(add, parts)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and projections read instead of repeating its expression.

    The optimizer copies an expression into every filter above it; it does not look into the output
    of a generator, so a one-element explode evaluates a long sequence expression once per row.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(value)).alias(name))


def literal_map(d: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def hamming(a: Column | str, b: Column | str, length: int | None = None) -> Column:
    """Mismatch count; a length difference is added, and may make it negative."""
    a, b = col(a), col(b)
    if length is not None:
        return total((char_at(a, s) != char_at(b, s)).cast("int") for s in range(length))
    shared = F.least(F.length(a), F.length(b))
    sites = F.when(shared > 0, F.sequence(F.lit(1), shared)).otherwise(F.array().cast("array<int>"))
    mismatches = F.aggregate(
        sites, F.lit(0), lambda n, s: n + (F.substr(a, s, F.lit(1)) != F.substr(b, s, F.lit(1))).cast("int")
    )
    return F.length(a) - F.length(b) + mismatches


def subsequence(seq: Column | str, positions: Sequence[int] | None) -> Column:
    if positions is None:
        return col(seq)
    return F.concat(*[char_at(seq, p) for p in positions])


def mask_site(seq: Column | str, site: int, mark: str = "_") -> Column:
    """The sequence with one site blanked: equal keys differ at most at that site."""
    seq = col(seq)
    return F.concat(F.substring(seq, 1, site), F.lit(mark), F.substr(seq, F.lit(site + 2), F.length(seq)))


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(col(seq)), COMPLEMENT_FROM, COMPLEMENT_TO)


def recode(seq: Column | str, code: Sequence[Mapping[str, str]], default: str = "X") -> Column:
    """Re-code every site through its own dictionary; unlisted alleles become ``default``."""
    return F.concat(*[
        F.coalesce(F.element_at(literal_map(d), char_at(seq, s)), F.lit(default)) for s, d in enumerate(code)
    ])


def custom_codon_table(rows: DataFrame) -> dict[str, str]:
    """(Codon, Letter) rows to a codon dictionary in DNA letters."""
    table = rows.select(F.translate("Codon", "U", "T").alias("c"), F.col("Letter").alias("r"))
    return {r.c: r.r for r in small_rows(table, 64, "codon table")}


def translate(seq: Column | str, table: str | int | Mapping[str, str] = "Standard", length: int | None = None) -> Column:
    """Nucleotides (DNA or RNA) to residues, whole codons only, ``X`` for unknown codons.

    A base is its place in TCAG order (U and lower case included), a codon the rank of its bases, so
    nothing is looked up in a table. With a known length the codons are unrolled into generated code.
    """
    codons = table if isinstance(table, Mapping) else codon_table(table)
    upper = CODON_BASES + CODON_BASES.replace("T", "U")
    places = F.lit(upper + upper.lower())
    residues = F.lit("X" + "".join(codons.get("".join(c), "X") for c in product(CODON_BASES, repeat=3)))
    dna = col(seq)

    def residue(word: Column, start: Column) -> Column:
        a, b, c = (F.instr(places, F.substr(word, start + k, F.lit(1))) for k in (1, 2, 3))
        rank = (a + 3) % 4 * 16 + (b + 3) % 4 * 4 + (c + 3) % 4 + 2
        return F.substr(residues, F.when(F.least(a, b, c) > 0, rank).otherwise(1), F.lit(1))

    if length is not None:
        return F.concat(*[residue(dna, F.lit(3 * k)) for k in range(length // 3)])
    n_codons = F.floor(F.length(dna) / 3).cast("int")
    index = F.when(n_codons > 0, F.sequence(F.lit(0), n_codons - 1)).otherwise(F.array().cast("array<int>"))
    # bound to a lambda variable, a derived sequence is not rebuilt for every codon
    words = F.transform(F.array(dna), lambda w: F.array_join(F.transform(index, lambda i: residue(w, i * 3)), ""))
    return words[0]


def one_hot(df: DataFrame, alleles: Sequence[str], key: str = "row_id", seq: str = "seq") -> DataFrame:
    """Sparse one-hot rows ``(key, site, allele)`` for the alleles listed at each site."""
    cells = F.posexplode(F.split(col(seq), "")).alias("site", "allele")
    allowed = F.array(*[F.lit(a) for a in alleles])
    return df.select(key, cells).where(
        F.instr(F.element_at(allowed, F.col("site") + 1), F.col("allele")) > 0
    )


def one_hot_wide(seq: Column | str, alleles: Sequence[str]) -> list[Column]:
    """One 0/1 column per (site, allele), named ``s<site>_<allele>``."""
    return [
        (char_at(seq, s) == a).cast("int").alias(f"s{s}_{a}") for s, site in enumerate(alleles) for a in site
    ]


def alphabet_type(alleles: Column) -> Column:
    """First of dna, rna, protein that holds every allele of an array column, else custom."""
    out = F.lit("custom")
    for name in ("protein", "rna", "dna"):
        known = F.array(*[F.lit(a) for a in ALPHABETS[name]])
        out = F.when(F.size(F.array_except(alleles, known)) == 0, name).otherwise(out)
    return out


def expected_logp(seq: Column | str, freqs: Mapping[str, float], length: int) -> Column:
    """Sum over sites of log frequency; null where an allele has no frequency."""
    logs = literal_map({a: float(f) for a, f in freqs.items()})
    return total(F.log(F.element_at(logs, char_at(seq, s))) for s in range(length))


def default_alphabet(n_alleles: int | None = None, kind: str = "custom") -> str:
    if kind in ALPHABETS:
        return ALPHABETS[kind]
    return "0123456789"[:n_alleles] if n_alleles <= 10 else LETTERS[:n_alleles]


def ambiguity_mapping(kind: str, length: int) -> list[Mapping[str, str]]:
    if kind in AMBIGUITY:
        return [AMBIGUITY[kind]] * length
    raise ValueError(f"no ambiguity codes for {kind!r}")


def expand_pattern(df: DataFrame, pattern: Column | str, mapping: Sequence[Mapping[str, str]], out: str = "seq") -> DataFrame:
    """One row per concrete sequence a pattern stands for, in expansion order ``ord``."""
    pattern = col(pattern)
    df = df.withColumn(out, F.lit("")).withColumn("ord", F.lit(0).cast("bigint"))
    for s, site in enumerate(mapping):
        options = F.element_at(literal_map(site), char_at(pattern, s))
        rest = [c for c in df.columns if c not in (out, "ord")]
        df = df.select(*rest, out, "ord", F.length(options).alias("_width"), F.posexplode(F.split(options, "")).alias("_o", "_a"))
        df = df.select(*rest, F.concat(out, "_a").alias(out), (F.col("ord") * F.col("_width") + F.col("_o")).alias("ord"))
    return df


def pattern_regex(pattern: str, mapping: Sequence[Mapping[str, str]]) -> str:
    """Anchored regular expression with one character class per site."""
    return "^" + "".join(f"[{site[c]}]" for c, site in zip(pattern, mapping)) + "$"


def protein_regex(pattern: str) -> str:
    return "^" + "".join("[" + (PROTEIN if c == "X" else c) + "]" for c in pattern) + "$"


def clamped_exp(v: Column | str) -> Column:
    return F.exp(F.least(col(v), F.lit(MAX_EXPONENT)))


def allele_indicator(seq: Column | str, position: int, allele: str) -> Column:
    return (char_at(seq, position) == allele).cast("int")


def enrichment(inputs: Column | str, selected: Column | str, wt_input: Column, wt_selected: Column) -> tuple[Column, Column]:
    """Log enrichment against the wild type with 0.5 pseudocounts, and its variance."""
    i, s = col(inputs) + 0.5, col(selected) + 0.5
    wi, ws = wt_input + 0.5, wt_selected + 0.5
    return F.log(s / i) - F.log(ws / wi), 1.0 / s + 1.0 / i + 1.0 / ws + 1.0 / wi


def a_to_sd(a: Column | str, n_faces: float) -> Column:
    return F.sqrt(F.lit(float(n_faces)) / col(a))


def sd_to_a(sd: Column | str, n_faces: float) -> Column:
    return F.lit(float(n_faces)) / (col(sd) * col(sd))


def log10_or_neg_inf(v: Column | str) -> Column:
    """log10 that keeps zero as minus infinity instead of null."""
    v = col(v)
    return F.when(v == 0, F.lit(float("-inf"))).otherwise(F.log10(v))
