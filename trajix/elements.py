"""The chemical elements as a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Symbols by atomic number from 0 (unknown), standard masses in u, van der Waals radii in Å.
SYMBOLS = """
X H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc
Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po
At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og
""".split()
MASSES = [float(m) for m in """
0 1.008 4.003 6.941 9.012 10.811 12.011 14.007 15.999 18.998 20.180 22.990 24.305 26.982 28.086 30.974 32.060 35.450 39.948
39.098 40.078 44.956 47.867 50.942 51.996 54.938 55.845 58.933 58.693 63.546 65.380 69.723 72.630 74.922 78.971 79.904 83.798
85.468 87.620 88.906 91.224 92.906 95.950 97.000 101.070 102.906 106.420 107.868 112.411 114.818 118.710 121.760 127.600
126.904 131.293 132.905 137.327 138.905 140.116 140.908 144.242 145.000 150.360 151.964 157.250 158.925 162.500 164.930
167.259 168.934 173.045 174.967 178.490 180.948 183.840 186.207 190.230 192.217 195.084 196.967 200.592 204.383 207.200
208.980 209.000 210.000 222.000 223.000 226.000 227.000 232.038 231.036 238.029 237.000 244.000 243.000 247.000 247.000
251.000 252.000 257.000 258.000 259.000 266.000 267.000 268.000 269.000 270.000 269.000 278.000 281.000 282.000 285.000
286.000 289.000 290.000 293.000 294.000 294.000
""".split()]  # fmt: skip
RADII = [float(r) for r in """
1.00 1.20 1.40 1.82 1.53 1.92 1.70 1.55 1.52 1.47 1.54 2.27 1.73 1.84 2.10 1.80 1.80 1.75 1.88 2.75 2.31 2.11 1.95 1.06 1.13
1.19 1.26 1.13 1.63 1.40 1.39 1.87 2.11 1.85 1.90 1.85 2.02 3.03 2.49 1.61 1.42 1.33 1.75 2.00 1.20 1.22 1.63 1.72 1.58 1.93
2.17 2.06 2.06 1.98 2.16 3.43 2.68 1.83 1.86 1.62 1.79 1.76 1.74 1.96 1.69 1.66 1.63 1.61 1.59 1.57 1.54 1.53 1.40 1.22 1.26
1.30 1.58 1.22 1.75 1.66 1.55 1.96 2.02 2.07 1.97 2.02 2.20 3.48 2.83 2.12 1.84 1.60 1.86 1.71 1.67 1.66 1.65 1.64 1.63 1.62
1.61 1.60 1.59 1.58
""".split()] + [1.0] * 15  # fmt: skip
BIOLOGICAL = set("H C N O P S Na Mg K Ca Mn Fe Co Ni Cu Zn Se I".split())

BY_SYMBOL = {s.upper(): z for z, s in enumerate(SYMBOLS)}


def element_of(symbol: str | None) -> int:
    """Atomic number of a symbol in any case: its first two letters, else its first alone; 0 if unknown."""
    s = (symbol or "").strip(" ").upper()
    if not s:
        return 0
    if len(s) > 1 and s[1].isascii() and s[1].isalpha() and len(s[:2]) == 2 and s[:2] in BY_SYMBOL:
        return BY_SYMBOL[s[:2]]
    return BY_SYMBOL.get(s[0], 0)


def elements(spark: SparkSession) -> DataFrame:
    """z, symbol, mass, vdw_radius, is_biological: 119 rows."""
    rows = [(z, s, MASSES[z], RADII[z], s in BIOLOGICAL) for z, s in enumerate(SYMBOLS)]
    return spark.createDataFrame(rows, "z int, symbol string, mass double, vdw_radius double, is_biological boolean")


def by_number(z: Column, values: list) -> Column:
    """The value of an atomic number column; numbers out of range count as unknown."""
    return F.get(F.array(*map(F.lit, values)), F.when(z.between(0, 118), z).otherwise(0))
