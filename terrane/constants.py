"""Alphabets, ambiguity codes, complements, the genetic code and limits."""

from __future__ import annotations

from itertools import product

# --- fixed values -------------------------------------------------------------------
DNA = "ACGT"
RNA = "ACGU"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"dna": DNA, "rna": RNA, "protein": PROTEIN}

# IUPAC nucleotide codes
DNA_AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT",
    "X": "GATC", "N": "GATC",
}
RNA_AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "U": "U",
    "M": "AC", "R": "AG", "W": "AU", "S": "CG", "Y": "CU", "K": "GU",
    "V": "ACG", "H": "ACU", "D": "AGU", "B": "CGU",
    "X": "GAUC", "N": "GAUC",
}

# reverse complements are written in RNA letters; other characters are kept
COMPLEMENT_FROM = "UAGCNT[]"
COMPLEMENT_TO = "AUCGNA]["

# NCBI genetic codes 1 and 11, codons in TCAG order (they differ only in start codons)
CODON_BASES = "TCAG"
CODON_RESIDUES = {
    "Standard": "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    "Bacterial": "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
}
CODON_TABLE_IDS = {1: "Standard", 11: "Bacterial"}

MAX_EXPONENT = 500.0
# ------------------------------------------------------------------------------------

PROTEIN_AMBIGUITY = {**{a: a for a in PROTEIN}, "X": PROTEIN}
AMBIGUITY = {"dna": DNA_AMBIGUITY, "rna": RNA_AMBIGUITY, "protein": PROTEIN_AMBIGUITY}


def codon_table(name: str | int = "Standard") -> dict[str, str]:
    """Codon → residue, ``*`` for stops."""
    residues = CODON_RESIDUES[CODON_TABLE_IDS.get(name, name)]
    return {"".join(c): r for c, r in zip(product(CODON_BASES, repeat=3), residues)}
