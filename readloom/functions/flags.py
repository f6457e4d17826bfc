"""Alignment flag bits and record gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the alignment format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, QCFAIL, DUP, SUPPLEMENTARY = (1 << i for i in range(12))
NOT_PRIMARY = SECONDARY | SUPPLEMENTARY


def any_of(flag: Column, mask: int) -> Column:
    """Is any bit of the mask set? A null flag has no bits."""
    return F.coalesce(flag, F.lit(0)).bitwiseAND(mask) != 0


def all_of(flag: Column, mask: int) -> Column:
    """Are all bits of the mask set?"""
    return F.coalesce(flag, F.lit(0)).bitwiseAND(mask) == mask


def gate(*, skip: int = 0, require: int = 0, min_mapq: int = 0, min_fm: int = 0, require_fp: bool = False, fm_default: int = 1, max_fm: int | None = None, duplex: bool | None = None) -> Column:
    """A record gate over flag, mapq, fm, fp, dr; cheap tests first. An absent FP passes, an absent FM is ``fm_default``."""
    fm = F.coalesce(F.col("fm"), F.lit(fm_default))
    ok = F.lit(True)
    if skip:
        ok = ok & ~any_of(F.col("flag"), skip)
    if require:
        ok = ok & all_of(F.col("flag"), require)
    if min_mapq:
        ok = ok & (F.col("mapq") >= min_mapq)
    if min_fm:
        ok = ok & (fm >= min_fm)
    if max_fm is not None:
        ok = ok & (fm <= max_fm)
    if require_fp:
        ok = ok & (F.coalesce(F.col("fp"), F.lit(1)) != 0)
    if duplex is not None:
        ok = ok & ((F.coalesce(F.col("dr"), F.lit(0)) != 0) == F.lit(duplex))
    return ok
