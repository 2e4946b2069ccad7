"""Column expressions over count vectors (arrays) and multisets; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def product(v) -> Column:
    return F.aggregate(_c(v), F.lit(1.0), lambda a, x: a * x)


def total(v, zero: Column | None = None) -> Column:
    return F.aggregate(_c(v), F.lit(0).cast("long") if zero is None else zero, lambda a, x: a + x)


def fits(v, counts) -> Column:
    """Element-wise v <= counts."""
    return F.forall(F.zip_with(_c(v), _c(counts), lambda a, b: a <= b), lambda t: t)


def minus(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def plus(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def times(v, k) -> Column:
    return F.transform(_c(v), lambda x: x * k)


def is_zero(v) -> Column:
    return F.forall(_c(v), lambda x: x == 0)


def is_nonneg(v) -> Column:
    return F.forall(_c(v), lambda x: x >= 0)


def one_hot(n: int, at) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (j == _c(at)).cast("int"))


def vector_sum(vectors, width: int) -> Column:
    """Sum of an array of vectors of one width; zeros for an empty array."""
    return F.aggregate(_c(vectors), F.array_repeat(F.lit(0).cast("long"), width), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def ln_factorial(n) -> Column:
    """ln n! as a sum of logarithms; 0 for n = 0."""
    n = _c(n)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(n, F.lit(2)).cast("long")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double"))))


def ln_choose(n, k) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(_c(n) - _c(k))


def log_multinomial(counts) -> Column:
    """ln of the number of orders of a multiset with these multiplicities."""
    return ln_factorial(total(counts)) - F.aggregate(F.transform(_c(counts), ln_factorial), F.lit(0.0), lambda a, x: a + x)


def log_likelihood(counts, probs) -> Column:
    """ln of a multiset's probability: sum of n ln p plus its log multinomial; 0 for the empty one."""
    terms = F.zip_with(_c(counts), _c(probs), lambda n, p: F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) + log_multinomial(counts)


def slack(counts, used) -> Column:
    """Sum of what is left of the counts."""
    return total(minus(counts, used))


def max_multiplicity(counts, v) -> Column:
    """How often v fits into counts; null for a zero vector."""
    return F.array_min(F.filter(F.zip_with(_c(counts), _c(v), lambda c, x: F.when(x > 0, F.floor(c / x))), lambda m: m.isNotNull()))


def sparse_string(v, names: list[str]) -> Column:
    """'name=value' of the non-zero places."""
    pairs = F.zip_with(F.array(*map(F.lit, names)), _c(v), lambda n, x: F.when(x != 0, F.concat(n, F.lit("="), x.cast("string"))))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), ",")


def expand_multiset(elements, counts) -> Column:
    """Each element as often as its count, in order."""
    return F.flatten(F.transform(F.arrays_zip(_c(elements).alias("e"), _c(counts).alias("n")), lambda t: F.array_repeat(t["e"], t["n"].cast("int"))))


def same_multiset(a, b) -> Column:
    return F.array_sort(_c(a)) == F.array_sort(_c(b))


def ln_solution_bound(room, kinds) -> Column:
    """Upper bound of ln of the number of solutions: the lesser of the bound by type and the bound over all types.

    ``room`` is the array of how many elements each type must hold, ``kinds`` how many distinct elements it has.
    """
    by_type = F.aggregate(F.zip_with(_c(room), _c(kinds), lambda r, m: ln_choose(r + m - 1, m - 1)), F.lit(0.0), lambda a, x: a + x)
    r, m = total(room), total(kinds)
    return F.least(by_type, ln_choose(r + m - 1, m - 1))
