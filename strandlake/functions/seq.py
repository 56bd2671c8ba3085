"""Sequence functions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Amino acids of the universal code, codons in the order t, c, a, g of each place.
UNIVERSAL = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# The other codes, as what differs from the universal one.
CODES = {
    1: {}, 2: {"aga": "*", "agg": "*", "ata": "M", "tga": "W"}, 3: {"ata": "M", "ctt": "T", "ctc": "T", "cta": "T", "ctg": "T", "tga": "W"}, 4: {"tga": "W"},
    5: {"aga": "S", "agg": "S", "ata": "M", "tga": "W"}, 6: {"taa": "Q", "tag": "Q"}, 9: {"aaa": "N", "aga": "S", "agg": "S", "tga": "W"}, 10: {"tga": "C"}, 11: {},
    12: {"ctg": "S"}, 13: {"aga": "G", "agg": "G", "ata": "M", "tga": "W"}, 14: {"aaa": "N", "aga": "S", "agg": "S", "taa": "Y", "tga": "W"}, 15: {"tag": "Q"}, 16: {"tag": "L"},
    21: {"tga": "W", "ata": "M", "aga": "S", "agg": "S", "aaa": "N"}, 22: {"tca": "*", "tag": "L"}, 23: {"tta": "*"}, 24: {"aga": "S", "agg": "K", "tga": "W"}, 25: {"tga": "G"}, 26: {"ctg": "A"},
}
# Letters and their complements.
IUPAC, IUPAC_COMPLEMENT = "acgturyswkmbdhvn", "tgcaayrswmkvhdbn"
# IUPAC letters as classes of bases.
CLASSES = {"r": "[ag]", "y": "[ct]", "s": "[cg]", "w": "[at]", "k": "[gt]", "m": "[ac]", "b": "[cgt]", "d": "[agt]", "h": "[act]", "v": "[acg]", "n": "[acgt]"}
BASES = "tcag"


def codons(code: int = 1) -> dict[str, str]:
    found = {a + b + c: UNIVERSAL[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    return found | CODES[code]


def code_string(code: int = 1) -> str:
    """64 amino acids in the order of UNIVERSAL."""
    table = codons(code)
    return "".join(table[a + b + c] for a in BASES for b in BASES for c in BASES)


def complement(s: Column) -> Column:
    return F.translate(s, IUPAC, IUPAC_COMPLEMENT)


def revcomp(s: Column) -> Column:
    return F.reverse(complement(s))


def kmers(s: Column, k: int, letters: str = "acgt") -> Column:
    """All overlapping words of ``k`` letters in order, in one pass over the text."""
    return F.regexp_extract_all(s, F.lit(f"(?=([{letters}]{{{k}}}))"), F.lit(1))


def in_frame(s: Column, frame: int = 0) -> Column:
    """Codons from ``frame`` on."""
    return F.regexp_extract_all(F.substring(s, frame + 1, 1 << 30) if frame else s, F.lit("[acgt]{3}"), F.lit(0))


def amino(codon: Column, code: int = 1) -> Column:
    table = F.create_map(*[F.lit(x) for kv in codons(code).items() for x in kv])
    return F.coalesce(F.try_element_at(table, codon), F.lit("X"))


def translate(s: Column, frame: int = 0, code: int = 1) -> Column:
    return F.array_join(F.transform(in_frame(s, frame), lambda c: amino(c, code)), "")


def motif(pattern: str) -> str:
    """A motif with IUPAC letters and alternatives (a|b) as a regular expression."""
    return "".join(CLASSES.get(c, c) for c in pattern.lower())


def prosite(pattern: str) -> str:
    """A PROSITE pattern as a regular expression: [..], {..}, x, (m,n), < and >."""
    out = pattern.rstrip(".").replace("-", "").replace("{", "[^").replace("}", "]").replace("(", "{").replace(")", "}").replace("x", ".")
    return out.replace("<", "^").replace(">", "$")




def tron(s: Column, code: int = 1) -> Column:
    """Every base replaced by the residue of the codon centred on it; the two ends are '-'; Ser of AGY is 'J', stop TGA is 'U'."""
    table = codons(code) | {"agt": "J", "agc": "J", "tga": "U"}
    by = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    inner = F.array_join(F.transform(kmers(s, 3), lambda c: F.try_element_at(by, c)), "")
    return F.when(F.length(s) < 3, F.repeat(F.lit("-"), F.length(s))).otherwise(F.concat(F.lit("-"), inner, F.lit("-")))


def runs(s: Column, letter: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"{letter}+"), F.lit(0))
