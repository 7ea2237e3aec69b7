"""Formula strings and masses as Column expressions.

A formula is an array<int> of ten counts in the order of ELEMENTS; invalid
strings give null. An ion is an array<int> of twelve (sodium and potassium
added), whose counts may be negative.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionflow.constants import ADDUCTS, ALPHABETICAL, ELECTRON, ELEMENTS, HILL, ION_ELEMENTS, LOSSES, MASS, shift

_TOKEN = "([A-Z][a-z]?)([1-9][0-9]*)?"


def _d(x: float) -> Column:
    return F.lit(float(x))


def parse_formula(text: Column) -> Column:
    """Counts of a formula string; null for charges, unknown elements, zero or broken counts, '' and null."""
    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1))
    counts = F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(2))
    known = F.forall(names, lambda e: e.isin(*ELEMENTS))
    pairs = F.arrays_zip(names.alias("e"), counts.alias("n"))

    def count(element: str) -> Column:
        own = F.filter(pairs, lambda p: p["e"] == element)
        n = F.aggregate(own, F.lit(0).cast("long"), lambda acc, p: acc + F.when(p["n"] == "", F.lit(1)).otherwise(p["n"].try_cast("int")))
        return n.try_cast("int")

    vector = F.array(*(count(e) for e in ELEMENTS))
    whole = (F.concat_ws("", tokens) == text) & (text != "") & known
    return F.when(whole & ~F.exists(vector, lambda n: n.isNull()), vector)


def _part(name: str, n: Column) -> Column:
    return F.when(n == 0, "").when(n == 1, name).otherwise(F.concat(F.lit(name), n.cast("string")))


def format_formula(vector: Column) -> Column:
    """Hill order with carbon, alphabetical without; counts of 1 are left out."""
    at = {e: F.element_at(vector, k + 1) for k, e in enumerate(ELEMENTS)}
    text = [F.concat(*(_part(e, at[e]) for e in order)) for order in (HILL, ALPHABETICAL)]
    return F.when(at["C"] > 0, text[0]).otherwise(text[1])


def exact_mass(vector: Column) -> Column:
    total = _d(0)
    for k, e in enumerate(ELEMENTS):
        total = total + F.element_at(vector, k + 1) * _d(MASS[e])
    return total


def dbe(vector: Column) -> Column:
    """Double bond equivalents: a feature, never a filter."""
    at = {e: F.element_at(vector, k + 1) for k, e in enumerate(ELEMENTS)}
    return 1 + at["C"] + (at["N"] + at["P"] - at["H"] - at["F"] - at["Cl"] - at["Br"] - at["I"]) / _d(2)


def ratios(vector: Column) -> tuple[Column, Column]:
    """Hydrogen and hetero atoms a carbon, of one carbon at least."""
    at = {e: F.element_at(vector, k + 1) for k, e in enumerate(ELEMENTS)}
    c = F.greatest(at["C"], F.lit(1))
    hetero = at["N"] + at["O"] + at["P"] + at["S"] + at["F"] + at["Cl"] + at["Br"] + at["I"]
    return at["H"] / c, hetero / c


def adduct_rows() -> list[tuple]:
    return [(name, charge, shift(delta, charge), [delta.get(e, 0) for e in ION_ELEMENTS]) for name, delta, charge in ADDUCTS]


def adducts(spark: SparkSession) -> DataFrame:
    """The ten adducts: adduct, charge, shift and the change of each ion count."""
    rows = ", ".join(f"('{n}', {z}, {s!r}D, array({', '.join(map(str, d))}))" for n, z, s, d in adduct_rows())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(adduct, charge, shift, delta)")


def with_adduct(df: DataFrame) -> DataFrame:
    """df with charge, shift and delta of its adduct, null where unknown; the dimension has ten rows."""
    return df.join(F.broadcast(adducts(df.sparkSession)), "adduct", "left")


def ion_counts(vector: Column, delta: Column) -> Column:
    return F.zip_with(F.concat(vector, F.array(F.lit(0), F.lit(0))), delta, lambda n, d: n + d)


def feasible(ion: Column) -> Column:
    return F.array_min(ion) >= 0


def mz(mass: Column, shift_: Column) -> Column:
    """Of singly charged ions, which all adducts are."""
    return mass + shift_


def neutral_mass(mz_: Column, shift_: Column) -> Column:
    return mz_ - shift_


def ppm(measured: Column, expected: Column) -> Column:
    return (measured - expected) / expected * _d(1e6)


def fragment_tolerance(mz_: Column, ppm_: float, da: float) -> Column:
    return F.greatest(_d(da), mz_ * _d(ppm_) * _d(1e-6))


def fragment_target(mz_: Column, charge: Column) -> Column:
    return mz_ + charge * _d(ELECTRON)


def loss_name(loss: Column) -> Column:
    """Which of the four neutral losses an ion vector is, else null."""
    out = None
    for name, delta in LOSSES:
        same = loss == F.array(*(F.lit(delta.get(e, 0)) for e in ION_ELEMENTS))
        out = F.when(same, name) if out is None else out.when(same, name)
    return out


# The same for single strings, on the driver.
def parse(text) -> list[int] | None:
    if not isinstance(text, str) or not re.fullmatch(f"(?:{_TOKEN})+", text):
        return None
    out = dict.fromkeys(ELEMENTS, 0)
    for name, n in re.findall(_TOKEN, text):
        if name not in out:
            return None
        out[name] += int(n or 1)
    return list(out.values())


def formatted(vector) -> str:
    n = dict(zip(ELEMENTS, map(int, vector)))
    return "".join(e + (str(n[e]) if n[e] > 1 else "") for e in (HILL if n["C"] else ALPHABETICAL) if n[e])


def mass_of(vector) -> float:
    return math.fsum(MASS[e] * int(n) for e, n in zip(ELEMENTS, vector))
