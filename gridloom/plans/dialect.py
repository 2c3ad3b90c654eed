"""The little array language that grid formulas are written in, spelled for Spark SQL or DuckDB."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str
    #: Type of the grids' values in DuckDB; Spark's expressions are in double precision.
    real: str = "double"

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def number(self, x: float) -> str:
        return f"{x!r}D" if self.spark else f"({x!r}::double)" if self.real == "double" else f"({x!r}::double::{self.real})"

    def numbers(self, xs: list[float]) -> str:
        return f"array({', '.join(map(self.number, xs))})" if self.spark else f"[{', '.join(map(self.number, xs))}]"

    def build(self, count: int, var: str, body: str) -> str:
        """An array of ``count`` values of body, var running from 0."""
        return f"transform(sequence(0, {count - 1}), {var} -> {body})" if self.spark else f"list_transform(range(0, {count}), lambda {var}: {body})"

    def each(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})" if self.spark else f"list_transform({array}, lambda {var}: {body})"

    def numbers_only(self, array: str) -> str:
        """The array without what is not a number."""
        return f"filter({array}, x -> not isnan(x))" if self.spark else f"list_filter({array}, lambda x: not isnan(x))"

    def at(self, array: str, index: str) -> str:
        return f"{array}[{index}]" if self.spark else f"{array}[({index}) + 1]"

    def let(self, var: str, value: str, body: str) -> str:
        """body with value worked out once and named var."""
        return f"transform(array({value}), {var} -> {body})[0]" if self.spark else f"list_transform([{value}], lambda {var}: {body})[1]"

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def forward(self, line: str, factors: str) -> str:
        """y[0] = x[0], y[k] = x[k] - factors[k] * y[k - 1]."""
        if self.spark:
            return f"aggregate({line}, cast(array() as array<double>), (acc, x) -> concat(acc, array(if(size(acc) = 0, x, x - {factors}[size(acc)] * element_at(acc, -1)))))"
        return f"list_reduce(list_transform({line}, lambda x: [x]), lambda acc, x: list_append(acc, x[1] - {factors}[len(acc) + 1] * acc[len(acc)]))"

    def backward(self, line: str, pivots: str, m: int) -> str:
        """z[m - 1] = y[m - 1] / pivots[m - 1], z[k] = (y[k] - z[k + 1] / 3) / pivots[k]."""
        third = self.number(1.0 / 3)
        if self.spark:
            return f"reverse(aggregate(reverse({line}), cast(array() as array<double>), (acc, y) -> concat(acc, array(if(size(acc) = 0, y, y - {third} * element_at(acc, -1)) / {pivots}[{m - 1} - size(acc)]))))"
        start = f"list_reverse({line})"
        seeded = f"list_prepend([{start}[1] / {pivots}[{m}]], list_transform({start}[2:], lambda y: [y]))"
        return f"list_reverse(list_reduce({seeded}, lambda acc, y: list_append(acc, (y[1] - {third} * acc[len(acc)]) / {pivots}[{m} - len(acc)])))"

    def ordered_sum(self, array: str) -> str:
        """Sum from the left."""
        return f"aggregate({array}, 0.0D, (acc, x) -> acc + x)" if self.spark else f"list_reduce(list_prepend(0.0::double, {array}), lambda acc, x: acc + x)"


SPARK, DUCKDB, DUCKDB_FLOAT = Dialect("spark"), Dialect("duckdb"), Dialect("duckdb", "float")
