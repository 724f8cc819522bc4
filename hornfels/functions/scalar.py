"""Scalar functions of weighted rules' conditions, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(x: Column) -> Column:
    """Towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def lg(x: Column) -> Column:
    return F.log10(x)


def log(base: Column, x: Column) -> Column:
    return F.log(x) / F.log(base)


def strpos(s: Column, part: str) -> Column:
    """1 for the first character, 0 if the part is not there."""
    return F.instr(s, part)


def split_part(s: Column, sep: str, n: int) -> Column:
    """The n-th field from 1, empty beyond the last."""
    return F.split_part(s, F.lit(sep), F.lit(n))


def shift_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n)


def shift_right(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def round_even(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.bround(x, 0)


def initcap(s: Column) -> Column:
    """Each run of letters and digits with its first character in upper case and the others in lower case."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))))


def regex_replace(s: Column, pattern: str, by: str) -> Column:
    """The first match of ``pattern`` replaced by ``by``, whose dollars and backslashes stand for themselves."""
    plain = by.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(s, rf"(?s)\A(.*?)(?:{pattern})", f"$1{plain}")
