"""Random draws that are pure functions of (seed, table, column, row, slot).

``rand(seed)`` depends on how rows are partitioned; these draws do not, so a table generated on
one executor or a thousand, or again after a lost executor, has the same values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

_MD5_DIGITS = 12  # 48 bits: exact in a DOUBLE and in a BIGINT of any engine
_MD5_RANGE = float(16**_MD5_DIGITS)
_FAST_RANGE = float(2**53)


@dataclass(frozen=True)
class Draw:
    """The source of randomness of one cell.

    The md5 form gives the same numbers in every engine, which makes generated tables comparable
    across engines; ``fast`` uses Spark's xxhash64 and is several times cheaper.
    """

    seed: int
    table: str
    column: str
    row: Column
    slot: Column | None = None
    fast: bool = False

    def child(self, name: str) -> Draw:
        return replace(self, column=f"{self.column}.{name}")

    def at(self, slot: Column) -> Draw:
        """The draw of one array or map position."""
        return replace(self, slot=slot)

    def _key(self, salt: str) -> list[Column]:
        name = f"{self.column}:{salt}" if salt else self.column
        parts = [F.lit(f"{self.seed}|{self.table}|{name}"), self.row]
        return parts if self.slot is None else [*parts, self.slot]

    def uniform(self, salt: str = "") -> Column:
        """Uniform in [0, 1)."""
        if self.fast:
            bits = F.shiftrightunsigned(F.xxhash64(*self._key(salt)), 11)
            return bits.cast("double") / F.lit(_FAST_RANGE)
        return F.conv(self.digits(_MD5_DIGITS, salt), 16, 10).cast("double") / F.lit(_MD5_RANGE)

    def digits(self, count: int, salt: str = "") -> Column:
        """Up to 32 hexadecimal digits."""
        text = F.concat_ws("|", *[part.cast("string") for part in self._key(salt)])
        return F.substring(F.md5(text), 1, count)

    def integer(self, low: int, high: int, salt: str = "") -> Column:
        """Uniform whole number in [low, high)."""
        return (F.floor(self.uniform(salt) * F.lit(float(high - low))) + F.lit(low)).cast("bigint")

    def pick(self, pool: Sequence[str], salt: str = "") -> Column:
        values = F.array(*[F.lit(value) for value in pool])
        return F.element_at(values, self.integer(1, len(pool) + 1, salt).cast("int"))

    def weighted(self, pool: Sequence[str], weights: Sequence[float], salt: str = "") -> Column:
        """One CASE over cumulative weights; the last value takes what rounding leaves."""
        chosen, bound, u = None, 0.0, self.uniform(salt)
        for value, weight in zip(pool[:-1], weights, strict=False):
            bound += weight
            hit = u < F.lit(round(bound, 12))
            chosen = F.when(hit, value) if chosen is None else chosen.when(hit, value)
        return F.lit(pool[-1]) if chosen is None else chosen.otherwise(pool[-1])

    def normal(self, mean: float, deviation: float) -> Column:
        """Normal by the Box-Muller transform of two uniforms."""
        radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - self.uniform("radius")))
        angle = F.cos(F.lit(6.283185307179586) * self.uniform("angle"))
        return F.lit(mean) + F.lit(deviation) * radius * angle

    def chance(self, rate: float, salt: str) -> Column:
        return self.uniform(salt) < F.lit(rate)
