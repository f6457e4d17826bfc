"""Sequence expressions: barcodes, homing, masks, complements, distances."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGTN"


def revcomp(s: Column) -> Column:
    """Reverse complement."""
    return F.reverse(F.translate(s, "ACGTNacgtn", "TGCANtgcan"))


def hamming(a: Column, b: Column) -> Column:
    """Differing letters of two texts of one length; null for unequal lengths or nulls."""
    return F.when(F.length(a) == F.length(b), F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, v: s + v))


def homopolymer_fail(barcode: Column, threshold: int = 10) -> Column:
    """True for a barcode with an N, or with one letter ``threshold`` + 1 times in a row."""
    return barcode.contains("N") | barcode.rlike(r"(.)\1{%d}" % threshold)


def check_homing(homing: str) -> str:
    """The homing sequence in upper case; anything but A, C, G, T is an error."""
    h = homing.upper()
    if not re.fullmatch("[ACGT]+", h):
        raise ValueError(f"homing sequence {homing!r} must be made of A, C, G, T")
    return h


def homing_trim(seq: Column, homing: str, blen: int, max_blen: int | None = None, offset: int = 0) -> tuple[Column, Column]:
    """(letters to trim, pass): where the homing sequence first begins at blen + offset .. max_blen.

    Without a hit the default length is trimmed and the read fails.
    """
    homing, top = check_homing(homing), max_blen if max_blen is not None else blen
    at = F.lit(None).cast("int")
    for i in range(max(top, blen + offset), blen + offset - 1, -1):
        at = F.when(F.substring(seq, i + 1, len(homing)) == homing, i).otherwise(at)
    return F.coalesce(at, F.lit(blen + offset)) + len(homing), at.isNotNull().cast("int")


def canonical_barcode(h1: Column, h2: Column) -> tuple[Column, Column]:
    """(barcode, strand) of a pair: the smaller half first, so both strands of a duplex have one barcode."""
    return F.when(h1.isNotNull() & h2.isNotNull(), F.concat(F.least(h1, h2), F.greatest(h1, h2))), F.when(h1 <= h2, "F").otherwise("R")


def mask_prefix(seq: Column, qual: Column, n: int) -> tuple[Column, Column]:
    """The first n letters as N and their qualities as '#'."""
    return F.concat(F.lit("N" * n), F.substring(seq, F.lit(n + 1), F.length(seq))), F.concat(F.lit("#" * n), F.substring(qual, F.lit(n + 1), F.length(qual)))


def base_code(barcode: Column, n: int) -> Column:
    """Base-4 number of the first n letters (the bin of a barcode); null if one isn't A, C, G, T or the text is shorter."""
    head = F.substring(barcode, 1, n)
    return F.when(head.rlike("^[ACGT]{%d}$" % n), F.conv(F.translate(head, "ACGT", "0123"), 4, 10).cast("bigint"))


def ambiguous_fraction(seq: Column) -> Column:
    """Share of letters that are N."""
    return F.when(F.length(seq) > 0, (F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))) / F.length(seq))
