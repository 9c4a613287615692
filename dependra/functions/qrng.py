"""Pseudo- and quasi-random points as Spark columns and small numpy helpers.

Every number follows from the row id, the column and the seed, so results don't
depend on partitioning and rows can be made again after a lost executor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .special import normal_score


def _seed(seeds: list[int] | tuple[int, ...] | None) -> int:
    """One number of a list of seeds; none means a random one."""
    if not seeds:
        return int(np.random.default_rng().integers(1, 1 << 62))
    out = 0
    for s in seeds:
        out = (out * 1_000_003 + int(s) + 12_345) % (1 << 62)
    return out


def uniform(row: Column, column: int, seed: int) -> Column:
    """A uniform number in (0, 1) from 52 bits of a hash of seed, column and row."""
    h = F.xxhash64(F.lit(seed), F.lit(column), row.cast("long"))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) * (2.0**-52)


def primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return out


def radical_inverse(row: Column, base: int, digits: int = 0, permutation: list[int] | None = None) -> Column:
    """Digits of ``row`` in ``base`` mirrored at the point; ``permutation`` maps digits (0 to 0)."""
    n = digits or int(np.ceil(63 * np.log(2) / np.log(base)))
    place = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k)
    digit = lambda k: F.pmod(F.floor(row / F.pow(F.lit(float(base)), k.cast("double"))), F.lit(base))
    mapped = digit if permutation is None else (lambda k: F.element_at(F.array(*(F.lit(int(x)) for x in permutation)), (digit(k) + 1).cast("int")))
    return F.aggregate(place, F.lit(0.0), lambda acc, k: acc + mapped(k) * F.pow(F.lit(float(base)), -(k.cast("double") + 1)))


def points(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Row ids 0 .. n - 1 as ``sample_id``."""
    return spark.range(0, n, 1, partitions or max(1, min(2000, n // 50_000 + 1))).withColumnRenamed("id", "sample_id")


def halton_scrambles(d: int, seeds: list[int] | None = None) -> list[tuple[int, list[int], float]]:
    """(base, digit permutation that fixes 0, shift) of each coordinate."""
    rng = np.random.default_rng(_seed(seeds))
    return [(base, [0, *(rng.permutation(base - 1) + 1).tolist()], float(rng.random())) for base in primes(d)]


def ghalton_rows(df: DataFrame, key: str, d: int, seeds: list[int] | None = None, most: int = 1 << 40) -> DataFrame:
    """``df`` with generalised Halton points u1 .. ud: radical inverses with scrambled digits.

    The integer column ``key`` (0 to ``most``) tells which point a row gets, so
    each row is made from itself.  Digit permutations fix 0 and are drawn from
    the seed; a random shift of each coordinate (modulo 1) keeps points off the
    faces of the cube.  A null key gets nulls.
    """
    cols = {}
    for j, (base, perm, shift) in enumerate(halton_scrambles(d, seeds)):
        digits = max(2, int(np.ceil(np.log(max(2, most + 1)) / np.log(base))) + 1)
        x = radical_inverse(F.col(key) + 1, base, digits, perm) + shift
        cols[f"u{j + 1}"] = F.when(F.col(key).isNotNull(), F.least(F.greatest(x - F.floor(x), F.lit(1e-12)), F.lit(1 - 1e-12)))
    return df.withColumns(cols)


def ghalton(spark: SparkSession, n: int, d: int, seeds: list[int] | None = None) -> DataFrame:
    """The first n generalised Halton points (sample_id, u1 .. ud), see ``ghalton_rows``."""
    return ghalton_rows(points(spark, n), "sample_id", d, seeds, n)


def _primitive_polynomials(count: int) -> list[tuple[int, int]]:
    """(degree, inner coefficients) of the first primitive polynomials over GF(2)."""
    out: list[tuple[int, int]] = []
    degree = 1
    while len(out) < count:
        order = (1 << degree) - 1
        factors = {p for p in range(2, order + 1) if order % p == 0 and all(p % q for q in range(2, int(p**0.5) + 1))}
        for inner in range(1 << max(0, degree - 1)):
            poly = (1 << degree) | (inner << 1) | 1

            def power(e: int, poly: int = poly, degree: int = degree) -> int:
                result, base = 1, 2 if degree > 1 else 2 ^ poly
                while e:
                    if e & 1:
                        result = _mul(result, base, poly, degree)
                    base = _mul(base, base, poly, degree)
                    e >>= 1
                return result

            if power(order) == 1 and all(power(order // p) != 1 for p in factors if p > 1 and order > 1):
                out.append((degree, inner))
                if len(out) == count:
                    break
        degree += 1
    return out


def _mul(a: int, b: int, poly: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a <<= 1
        if a >> degree & 1:
            a ^= poly
        b >>= 1
    return out


def sobol_directions(d: int, bits: int, rng: np.random.Generator) -> np.ndarray:
    """Direction numbers [d, bits]: initial ones are drawn (odd), the rest follow from the recurrence."""
    v = np.zeros((d, bits), np.uint64)
    v[0] = [1 << (bits - 1 - k) for k in range(bits)]
    for j, (s, inner) in enumerate(_primitive_polynomials(d - 1), 1):
        m = [int(rng.integers(0, 1 << k)) * 2 + 1 for k in range(min(s, bits))]
        m[0] = 1
        for k in range(s, bits):
            new = m[k - s] ^ (m[k - s] << s)
            for i in range(1, s):
                if inner >> (s - 1 - i) & 1:
                    new ^= m[k - i] << i
            m.append(new)
        v[j] = [m[k] << (bits - 1 - k) for k in range(bits)]
    return v


def sobol_shifts(d: int, bits: int, seeds: list[int] | None = None) -> np.ndarray:
    """The digital shift of each coordinate."""
    return np.random.default_rng(_seed(seeds)).integers(0, 1 << bits, d, dtype=np.uint64)


def sobol_rows(df: DataFrame, key: str, d: int, seeds: list[int] | None = None, bits: int = 40) -> DataFrame:
    """(key, u1 .. ud): scrambled Sobol points for the integer column ``key`` of ``df``.

    XOR of direction numbers by the Gray code of the key, and a digital shift.
    """
    v = sobol_directions(d, bits, np.random.default_rng(1))
    shift = sobol_shifts(d, bits, seeds)
    names = [f"u{j + 1}" for j in range(d)]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            i = pdf[key].to_numpy().astype(np.uint64)
            gray = i ^ (i >> np.uint64(1))
            x = np.tile(shift[:, None], (1, len(i)))
            for k in range(bits):
                x ^= np.where(gray >> np.uint64(k) & np.uint64(1), v[:, k : k + 1], np.uint64(0))
            yield pd.DataFrame({key: pdf[key], **dict(zip(names, (x + 0.5) * 2.0**-bits))})

    return df.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).mapInPandas(run, ", ".join([f"`{key}` long", *(f"{c} double" for c in names)]))


def sobol(spark: SparkSession, n: int, d: int, seeds: list[int] | None = None, bits: int = 40) -> DataFrame:
    """The first n scrambled Sobol points (sample_id, u1 .. ud), see ``sobol_rows``."""
    return sobol_rows(points(spark, n), "sample_id", d, seeds, bits)


def uniform_rows(df: DataFrame, key: str, d: int, qrng: bool = False, seeds: list[int] | None = None, most: int = 1 << 40) -> DataFrame:
    """(key, u1 .. ud): d independent uniforms for each row of ``df``, from its integer column ``key``.

    Rows of equal key get equal numbers; quasi-random: generalised Halton up to
    300 columns, else Sobol.
    """
    rows = df.select(F.col(key).cast("long").alias(key))
    if qrng:
        return ghalton_rows(rows, key, d, seeds, most) if d <= 300 else sobol_rows(rows, key, d, seeds)
    seed = _seed(seeds)
    return rows.select(key, *(uniform(F.col(key), j, seed).alias(f"u{j + 1}") for j in range(d)))


def simulate_uniform(spark: SparkSession, n: int, d: int, qrng: bool = False, seeds: list[int] | None = None) -> DataFrame:
    """n rows (sample_id, u1 .. ud) of independent uniforms, see ``uniform_rows``."""
    return uniform_rows(points(spark, n), "sample_id", d, qrng, seeds, n)


def normal_rows(df: DataFrame, key: str, d: int, qrng: bool = False, seeds: list[int] | None = None) -> DataFrame:
    """(key, z1 .. zd): standard normal numbers for each row of ``df``, see ``uniform_rows``."""
    u = uniform_rows(df, key, d, qrng, seeds)
    return u.select(key, *(normal_score(F.col(f"u{j + 1}")).alias(f"z{j + 1}") for j in range(d)))


def simulate_normal(spark: SparkSession, n: int, d: int, qrng: bool = False, seeds: list[int] | None = None) -> DataFrame:
    """Standard normal columns z1 .. zd of n rows."""
    u = simulate_uniform(spark, n, d, qrng, seeds)
    return u.select("sample_id", *(normal_score(F.col(f"u{j + 1}")).alias(f"z{j + 1}") for j in range(d)))
