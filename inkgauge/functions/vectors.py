"""Array functions used for scores and embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import as_col, let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; a zero vector gives NaN."""
    a, b = as_col(a), as_col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return let(norm, lambda n: F.when(n == 0, F.lit(float("nan"))).otherwise(F.try_divide(dot(a, b), n)))


def softmax(arr: Column | str) -> Column:
    """Softmax, shifted by the maximum."""

    def norm(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda x, y: x + y), lambda t: F.transform(e, lambda v: v / t))

    def exps(a: Column) -> Column:
        return let(F.array_max(a), lambda m: F.transform(a, lambda v: F.exp(v - m)))

    return let(as_col(arr).cast("array<double>"), lambda a: let(exps(a), norm))


def argmax(arr: Column | str) -> Column:
    """0-based position of the first maximum."""
    arr = as_col(arr)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def positive_score(logits: Column | str) -> Column:
    """Class-1 value after softmax is applied twice: stays in [0.269, 0.731]."""
    return F.get(softmax(softmax(logits)), F.lit(1))


def one_hot(i: Column | str, n: int) -> Column:
    i = as_col(i)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, 1.0).otherwise(0.0))


def scale_255(arr: Column | str) -> Column:
    return F.transform(as_col(arr), lambda v: v.cast("double") / 255.0)


def standardize_const(arr: Column | str, mean: float = 0.1307, std: float = 0.3081) -> Column:
    return F.transform(as_col(arr), lambda v: (v.cast("double") - mean) / std)


def pool_concat(a: Column | str, b: Column | str) -> Column:
    """Concatenation of two state vectors."""
    return F.concat(as_col(a), as_col(b))


def mean_of(arr: Column) -> Column:
    return let(arr, lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double")) / F.size(a))


def std_pop_of(arr: Column) -> Column:
    """Population standard deviation of an array; an empty array gives NaN."""

    def spread(a: Column) -> Column:
        n = F.size(a).cast("double")
        return let(
            F.aggregate(a, F.lit(0.0), lambda x, y: x + y.cast("double")) / n,
            lambda m: F.sqrt(
                F.aggregate(a, F.lit(0.0), lambda x, y: x + (y.cast("double") - m) * (y.cast("double") - m)) / n
            ),
        )

    return let(arr, lambda a: F.when(F.size(a) == 0, F.lit(float("nan"))).otherwise(spread(a)))
