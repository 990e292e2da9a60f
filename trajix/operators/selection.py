"""Selections of atoms: predicates over the topology's table, and the small languages that name them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that the keywords stand for.
BACKBONE = ["N", "CA", "C", "O"]
AMINO_ACIDS = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split()
WATERS = ["HOH", "WAT", "SOL", "TIP3", "TIP4", "SPC"]


class InvalidSpec(ValueError):
    pass


class EmptySelection(ValueError):
    pass


def parse_ranges(spec: str) -> list[tuple[int, int]]:
    """Inclusive ranges of a text like "0,1,5-10", joined and in order; blanks and empty parts are passed over."""
    found = []
    for part in (p.strip(" \t") for p in spec.split(",")):
        if part:
            m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
            if not m or (m[2] is not None and int(m[2]) < int(m[1])):
                raise InvalidSpec(part)
            found.append((int(m[1]), int(m[2] or m[1])))
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def by_index(spec: str) -> Column:
    out = F.lit(False)
    for low, high in parse_ranges(spec):
        out = out | F.col("atom_index").between(low, high)
    return out


def by_keyword(keyword: str) -> Column:
    if keyword == "backbone":
        return F.col("name").isin(BACKBONE) & F.col("residue_name").isin(AMINO_ACIDS)
    return F.col("residue_name").isin({"protein": AMINO_ACIDS, "water": WATERS}[keyword])


def by_name(name: str) -> Column:
    return F.col("name") == name


def by_element(z: int) -> Column:
    return F.col("element") == z


def predicate(expression: str | Column | None) -> Column:
    """backbone, protein, water, "name X", "index SPEC" or a bare atom name; None is every atom."""
    if expression is None:
        return F.lit(True)
    if isinstance(expression, Column):
        return expression
    head, _, rest = expression.strip().partition(" ")
    if expression.strip() in ("backbone", "protein", "water"):
        return by_keyword(expression.strip())
    if head == "name":
        return by_name(rest.strip())
    return by_index(rest) if head == "index" else by_name(expression.strip())


def select(table: DataFrame, expression: str | Column | None) -> DataFrame:
    """Rows of a topology's table that the expression selects."""
    return table.where(predicate(expression))


def indices(table: DataFrame, expression: str | Column | None, allow_empty: bool = False) -> list[int] | None:
    """Atom indices in order, for operators that take a list; None for every atom.

    The list holds a part of one topology, not of the frames.
    """
    if expression is None:
        return None
    out = sorted(r[0] for r in select(table, expression).select("atom_index").distinct().collect())
    if not out and not allow_empty:
        raise EmptySelection(str(expression))
    return out


def parse_tuples(spec: str, arity: int) -> list[tuple[int, ...]]:
    """Index tuples of a text like "0-1,2-3" (pairs), "0-1-2" (triplets) or "0-1-2-3" (quartets)."""
    out = []
    for part in (p.strip() for p in spec.split(",")):
        if part:
            bits = part.split("-")
            if len(bits) != arity or not all(b.strip().isdigit() for b in bits):
                raise InvalidSpec(part)
            out.append(tuple(int(b) for b in bits))
    return out


def check_indices(used: list[int], n_atoms: int) -> None:
    if any(i < 0 or i >= n_atoms for i in used):
        raise IndexError("IndexOutOfRange")
