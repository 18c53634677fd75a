"""Signal features of array<double> cells as expressions: nothing leaves the JVM.

Scalar features give one double a cell (an empty cell gives 0), smooth ones an array of the
cell's length. Intermediate values are bound once (``let``), as a lambda would otherwise
compute them again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def total(c: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))


def mean(c: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return total(c, f) / F.size(c)


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a, b))


def _nonempty(c: Column, value: Column) -> Column:
    return F.when(F.size(c) == 0, 0.0).otherwise(value)


def mean_square(c: Column) -> Column:
    return _nonempty(c, mean(c, lambda x: x * x))


def rms(c: Column) -> Column:
    return F.sqrt(mean_square(c))


def variance(c: Column) -> Column:
    """Sample variance in two passes; 0 for a single value."""
    return F.when(F.size(c) <= 1, 0.0).otherwise(let(mean(c), lambda m: total(c, lambda x: (x - m) * (x - m)) / (F.size(c) - 1)))


def peak_peak(c: Column) -> Column:
    return _nonempty(c, F.array_max(c) - F.array_min(c))


def _top(c: Column) -> Column:
    return F.array_max(F.transform(c, F.abs))


def shape_factor(c: Column) -> Column:
    return _nonempty(c, _div(rms(c), mean(c, F.abs)))


def crest(c: Column) -> Column:
    return _nonempty(c, _div(_top(c), rms(c)))


def impulse(c: Column) -> Column:
    return _nonempty(c, _div(_top(c), mean(c, F.abs)))


def clearance(c: Column) -> Column:
    return _nonempty(c, _div(_top(c), F.pow(mean(c, lambda x: F.sqrt(F.abs(x))), F.lit(2.0))))


def _moment(c: Column, k: int, shift: float) -> Column:
    """k-th population moment over the k-th power of the sample deviation, less ``shift``; 0 where that is 0."""

    def of(m: Column) -> Column:
        deviation = F.sqrt(total(c, lambda x: (x - m) * (x - m)) / (F.size(c) - 1))
        return F.when(deviation == 0, 0.0).otherwise(F.try_divide(total(c, lambda x: F.pow(x - m, F.lit(float(k)))) / F.size(c), F.pow(deviation, F.lit(float(k)))) - shift)

    return F.when(F.size(c) < 2, 0.0).otherwise(let(mean(c), of))


def skewness(c: Column) -> Column:
    return _moment(c, 3, 0.0)


def kurtosis(c: Column) -> Column:
    return _moment(c, 4, 3.0)


def gini_index(c: Column) -> Column:
    n = F.size(c)
    ranked = F.array_sort(F.transform(c, F.abs))
    weighted = total(F.zip_with(ranked, F.sequence(F.lit(1), n), lambda x, i: x * i))
    return _nonempty(c, let(total(c, F.abs), lambda s: F.when(s == 0, 0.0).otherwise(F.try_divide(2.0 * weighted, n * s) - (n + 1) / n)))


def average_kurtosis(c: Column, n_segments: int = 10) -> Column:
    """Mean kurtosis of equal parts, the rest dropped; of the whole where a part would have one value."""
    part = F.floor(F.size(c) / n_segments).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n_segments - 1)), lambda i: kurtosis(F.slice(c, i * part + 1, part)))
    return F.when(F.size(c) < 2, 0.0).when(part < 2, kurtosis(c)).otherwise(mean(parts))


#: Features without settings, by name.
SCALAR: dict[str, Callable[[Column], Column]] = {
    "mean_square": mean_square,
    "variance": variance,
    "rms": rms,
    "peak_peak": peak_peak,
    "shape_factor": shape_factor,
    "crest": crest,
    "impulse": impulse,
    "clearance": clearance,
    "skewness": skewness,
    "kurtosis": kurtosis,
    "gini_index": gini_index,
}


def over_windows(c: Column, win: int, stride: int, padding: str, f: Callable[[Column], Column], kind: str) -> Column:
    """array<kind>: a function of one window for each element of a cell.

    The cell is extended circularly by what the windows need, before it (backward), after it
    (forward) or on both sides, by at most its own length on a side. With a stride every
    window's result is repeated ``stride`` times and the array is cut to the cell's length at the
    end (backward), the start (forward) or the middle. Windows are cut one at a time, so a cell
    takes the memory of its length and not of all its windows.
    """
    if win <= 0 or stride <= 0:
        raise ValueError("win and stride must be positive")
    n = F.size(c)
    need = F.greatest(F.lit(0), (n - 1) * stride + win - n)
    front = {"backward": need, "forward": F.lit(0), "bidirectional": F.floor(need / 2).cast("int")}[padding]
    back = F.least(need - front, n)
    front = F.least(front, n)

    def inside(padded: Column) -> Column:
        count = F.least(n, F.floor((F.size(padded) - win) / stride).cast("int") + 1)
        out = F.transform(F.sequence(F.lit(0), count - 1), lambda i: f(F.slice(padded, i * stride + 1, F.lit(win))))
        if stride > 1:
            repeated = F.flatten(F.transform(out, lambda v: F.array_repeat(v, stride)))
            skip = F.size(repeated) - n
            start = {"backward": skip, "forward": F.lit(0), "bidirectional": F.floor(skip / 2).cast("int")}[padding]
            out = F.slice(repeated, start + 1, n)
        return F.when(F.size(padded) < win, F.raise_error(F.lit("a window is longer than its padded signal")).cast(f"array<{kind}>")).otherwise(out)

    padded = F.concat(F.slice(c, n - front + 1, front), c, F.slice(c, F.lit(1), back))
    return F.when(n == 0, F.array().cast(f"array<{kind}>")).otherwise(let(padded, inside))


def windows(c: Column, win: int, stride: int = 1, padding: str = "backward") -> Column:
    """array<array<double>>: the windows themselves."""
    return over_windows(c, win, stride, padding, lambda w: w, "array<double>")


def _std(w: Column) -> Column:
    return let(mean(w), lambda m: F.when(F.size(w) < 2, float("nan")).otherwise(F.sqrt(F.try_divide(total(w, lambda x: (x - m) * (x - m)), (F.size(w) - 1).cast("double")))))


def _slope(w: Column) -> Column:
    n = F.size(w).cast("double")
    dot = total(F.zip_with(w, F.sequence(F.lit(0), F.size(w) - 1), lambda x, i: x * i))
    return (dot - total(w) * (n - 1) / 2) / (n * (n * n - 1) / 12)


def _energy(w: Column) -> Column:
    """Sum of squared magnitudes of the one-sided transform, in closed form."""
    n = F.size(w)
    alternating = total(F.zip_with(w, F.sequence(F.lit(0), n - 1), lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)))
    even = F.when(n % 2 == 0, alternating * alternating).otherwise(0.0)
    return (n * total(w, lambda x: x * x) + F.pow(total(w), F.lit(2.0)) + even) / 2


def gradient(c: Column) -> Column:
    """Central differences, one-sided at the ends."""
    n = F.size(c)

    def at(_: Column, i: Column) -> Column:
        inner = (F.get(c, i + 1) - F.get(c, i - 1)) / 2
        return F.when(i == 0, F.get(c, i + 1) - F.get(c, i)).when(i == n - 1, F.get(c, i) - F.get(c, i - 1)).otherwise(inner)

    return F.when(n == 1, F.raise_error(F.lit("a gradient needs two values")).cast("array<double>")).otherwise(F.transform(c, at))


def second_difference(c: Column) -> Column:
    """x[i+1] - 2 x[i] + x[i-1], mirrored at the ends; zeros for one value."""
    n = F.size(c)

    def at(x: Column, i: Column) -> Column:
        after = F.when(i == n - 1, F.get(c, n - 2)).otherwise(F.get(c, i + 1))
        before = F.when(i == 0, F.get(c, F.lit(1))).otherwise(F.get(c, i - 1))
        return after - 2 * x + before

    return F.when(n <= 1, F.transform(c, lambda x: F.lit(0.0))).otherwise(F.transform(c, at))


def smooth(c: Column, what: str, win: int = 30, stride: int = 1, padding: str = "backward") -> Column:
    """One of ``SMOOTH`` over a cell's windows."""
    if what == "slope" and win < 2:
        return F.transform(c, lambda x: F.lit(0.0))
    base, after = SMOOTH[what]
    out = over_windows(c, win, stride, padding, base, "double")
    return let(out, after) if after else out


SMOOTH: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column] | None]] = {
    "mean": (mean, None),
    "min": (F.array_min, None),
    "max": (F.array_max, None),
    "std": (_std, None),
    "slope": (_slope, None),
    "grad_mean": (mean, gradient),
    "grad_std": (_std, gradient),
    "grad2_mean": (mean, second_difference),
    "fft_energy": (_energy, None),
}
