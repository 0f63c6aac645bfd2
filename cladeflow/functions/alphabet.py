"""Nucleotide symbols as sets of states: bit 0 is A, 1 is C, 2 is G, 3 is T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The IUPAC codes by the states they stand for.
STATES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT", "X": "ACGT", "O": "ACGT", "-": "ACGT", "?": "ACGT", ".": "ACGT",
}
#: Symbols that an alignment may have, in either case.
ALLOWED = "ACGTURYSWKMBDHVN-?."
#: Symbols that say nothing about a site: they don't count towards frequencies.
MISSING = "N-?."
ALL = 15
MASKS = {symbol: sum(1 << "ACGT".index(s) for s in states) for symbol, states in STATES.items()}


def mask_of(symbol: Column) -> Column:
    """The mask of one symbol; whatever is unknown may be any state."""
    codes = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.upper(symbol)), F.lit(ALL))
