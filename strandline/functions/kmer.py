"""Column functions on 31-letter windows, packed as 62-bit longs (first letter highest; A C G T = 0 1 2 3).

A packed window is never negative, so order as a long is order as a string.  Everything here is JVM-side and inside code
generation; strings are touched only when packing and unpacking.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

K = 31
BITS = 2 * K
ALL = (1 << BITS) - 1
#: The low bit of every letter.
ODD = 0x1555555555555555
BACK = 16
BACK_MASK = (1 << 2 * BACK) - 1


def _l(x: int) -> Column:
    return F.lit(x).cast("long")


def pack(text: Column) -> Column:
    """The packed window; null unless it is 31 letters of ACGT in either case."""
    return F.when(text.rlike("^[ACGTacgt]{31}$"), pack_clean(text))


def pack_clean(text: Column) -> Column:
    """As pack, for text that is known to be clean upper case or lower case letters."""
    return F.conv(F.translate(F.upper(text), "ACGT", "0123"), 4, 10).cast("long")


def unpack(kmer: Column, k: int = K) -> Column:
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def revcomp(kmer: Column) -> Column:
    """Swaps the 31 letters' order by halves, and complements them.  The word of 32 letters is moved down by the one letter that is not there."""
    x = kmer.bitwiseXOR(_l(ALL))
    for width, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = F.shiftrightunsigned(x, width).bitwiseAND(_l(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(_l(mask)), width))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 2)


def revcomp_text(text: Column) -> Column:
    """Keeps case; other characters stay as they are."""
    return F.reverse(F.translate(text, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def diff_mask(a: Column, b: Column) -> Column:
    """One bit, the lower of two, for each letter that differs."""
    x = a.bitwiseXOR(b)
    return x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(_l(ODD))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(diff_mask(a, b))


def hamming_lead(a: Column, b: Column) -> Column:
    """Differences in the first 15 letters; those of the last 16 are the rest."""
    return F.bit_count(diff_mask(a, b).bitwiseAND(_l(ALL ^ BACK_MASK)))


def rotate(kmer: Column) -> Column:
    """The last 16 letters first, then the first 15."""
    return F.shiftleft(kmer.bitwiseAND(_l(BACK_MASK)), 2 * (K - BACK)).bitwiseOR(F.shiftright(kmer, 2 * BACK))


def unrotate(rotated: Column) -> Column:
    lead = (1 << 2 * (K - BACK)) - 1
    return F.shiftleft(rotated.bitwiseAND(_l(lead)), 2 * BACK).bitwiseOR(F.shiftright(rotated, 2 * (K - BACK)))


def shifted(kmer: Column, by: Column) -> Column:
    """kmer >> by, for a shift that is itself a column."""
    return F.call_function("shiftright", kmer, by.cast("int"))


def base_at(kmer: Column, i: Column) -> Column:
    return shifted(kmer, F.lit(2 * (K - 1)) - 2 * i).bitwiseAND(F.lit(3)).cast("int")


def prefix(kmer: Column, p: int) -> Column:
    return F.shiftright(kmer, 2 * (K - p)).cast("int")


def prefix_mask(p: int) -> int:
    return ALL ^ ((1 << 2 * (K - p)) - 1)


def mismatch_positions(a: Column, b: Column) -> Column:
    """0-based, ascending."""
    m = diff_mask(a, b)
    return F.filter(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: shifted(m, F.lit(2 * (K - 1)) - 2 * i).bitwiseAND(F.lit(1)) == 1)


def characters(query: Column, variant: Column) -> Column:
    """4 * position + letter of the variant, for every difference, ascending."""
    return F.transform(mismatch_positions(query, variant), lambda p: 4 * p + base_at(variant, p))


def window(kmer: Column, k: int, w: Column | int) -> Column:
    """The k letters from offset w on, packed."""
    w = F.lit(w) if isinstance(w, int) else w
    return shifted(kmer, F.lit(2 * (K - k)) - 2 * w).bitwiseAND(_l((1 << 2 * k) - 1))


def letters_of(chars: Column) -> Column:
    """The label of a set of characters: position (from 1) and letter, joined by spaces."""
    return F.array_join(F.transform(chars, lambda c: F.concat((F.floor(c / 4) + 1).cast("string"), F.substring(F.lit("ACGT"), (c % 4 + 1).cast("int"), F.lit(1)))), " ")


def mirror(chars: Column) -> Column:
    """Characters as the other strand has them."""
    return F.transform(chars, lambda c: 4 * (K - 1 - F.floor(c / 4)).cast("int") + 3 - c % 4)


def strand(fwd_canonical: Column, flipped: Column) -> Column:
    return F.when(fwd_canonical != flipped, F.lit("+")).otherwise(F.lit("-"))


def percent_decode(text: Column) -> Column:
    """%XX only; what is malformed stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def gff_attribute(attributes: Column, key: str) -> Column:
    """Null if the key is not there."""
    found = F.regexp_extract(attributes, f"(?:^|;){key}=([^;]*)", 1)
    return F.when(attributes.rlike(f"(?:^|;){key}="), found)
