"""One declarative text per operator, for Spark SQL and for the DuckDB oracle.

Operators are written as SQL over table names; where the engines spell an
expression differently, the dialect spells it. Spark plans the text with
Catalyst like any other query.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from fractions import Fraction

from turnstile.settings import DEFAULTS, FIXTURE, Settings


@dataclass(frozen=True)
class Dialect:
    """Spellings of one engine, and what an operator is applied to.

    ``k`` holds the knobs. ``views`` names relations that stand for domain views
    (:mod:`turnstile.sources.bindings`); those not named are bound to the given
    tables, which Spark finds in the folder ``root``.
    """

    spark: bool
    root: str = ""
    k: Settings = DEFAULTS
    views: Mapping[str, str] = field(default_factory=dict)

    def t(self, table: str) -> str:
        if self.views and not self.root and self.spark:
            raise ValueError(f"a view that reads {table} in the given tables was not named; named are {sorted(self.views)}")
        return f"parquet.`{self.root}/{table}.parquet`" if self.spark else table

    # Arrays.
    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def struct(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{n}', {x}" for n, x in fields.items()) + ")"
        return "struct_pack(" + ", ".join(f"{n} := {x}" for n, x in fields.items()) + ")"

    def listed(self, x: str) -> str:
        """An aggregate: the values in any order."""
        return f"collect_list({x})" if self.spark else f"list({x})"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def overlap(self, a: str, b: str) -> str:
        """Histogram intersection: the sum of the smaller values."""
        if self.spark:
            return f"aggregate(zip_with({a}, {b}, (x, y) -> least(x, y)), 0D, (s, v) -> s + v)"
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: least(z[1], z[2])))"

    def each(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})" if self.spark else f"list_transform({array}, lambda {var}: {body})"

    def keep(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})" if self.spark else f"list_filter({array}, lambda {var}: {body})"

    def least_by(self, array: str, field: str) -> str:
        """The item of an array of structs with the smallest ``field``."""
        if self.spark:
            return f"element_at(array_sort({array}, (a, b) -> CASE WHEN a.{field} < b.{field} THEN -1 WHEN a.{field} > b.{field} THEN 1 ELSE 0 END), 1)"
        return f"list_reduce({array}, lambda a, b: CASE WHEN b.{field} < a.{field} THEN b ELSE a END)"

    def total(self, array: str) -> str:
        return f"aggregate({array}, 0D, (s, v) -> s + v)" if self.spark else f"list_sum({array})"

    def shares(self, array: str) -> str:
        """Each number over the array's total, which Spark is told to add up once, not once a number."""
        if self.spark:
            return f"element_at(transform(array({self.total(array)}), whole -> {self.each(array, 'x', 'x / whole')}), 1)"
        return self.each(array, "x", f"x / {self.total(array)}")

    def head(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})" if self.spark else f"{array}[1:{n}]"

    def last(self, array: str, n: int) -> str:
        if self.spark:
            return f"slice({array}, greatest(1, size({array}) - {n - 1}), {n})"
        return f"{array}[greatest(1, len({array}) - {n - 1}):]"

    def to_json(self, struct: str) -> str:
        return f"to_json({struct})" if self.spark else f"CAST(to_json({struct}) AS VARCHAR)"

    def octets(self, text: str) -> str:
        return f"octet_length({text})" if self.spark else f"octet_length(encode({text}))"

    def percent(self, x: str) -> str:
        """A number rounded to four digits and written with a sign and two; null of null.

        Both roundings are those of C: half away from zero of what is scaled, then of the binary number as it is.
        """
        if not self.spark:
            return f"CASE WHEN round({x}, 4) IS NOT NULL THEN printf('%+.2f %%', round({x}, 4)) END"
        let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
        scaled = let(f"abs(({x}) * 10000D)", "y", "(floor(y) + CASE WHEN y - floor(y) >= 0.5D THEN 1 ELSE 0 END) / 10000D")
        # Which of (2 c + 1) / 200 a double holds too large, or exactly with c odd: those go up where a number is that double.
        up = [c for c in range(100) if (off := Fraction((2 * c + 1) / 200) - Fraction(2 * c + 1, 200)) > 0 or (off == 0 and c % 2)]
        more = f"CASE WHEN a - floor(a) > (2 * c + 1) / 200D OR (a - floor(a) = (2 * c + 1) / 200D AND c IN ({', '.join(map(str, up))})) THEN 1 ELSE 0 END"
        whole = let(scaled, "a", let("floor((a - floor(a)) * 100)", "c", f"floor(a) * 100 + c + {more}"))
        return f"concat(CASE WHEN CAST({x} AS STRING) LIKE '-%' THEN '-' ELSE '+' END, {let(whole, 'h', "concat(CAST(h DIV 100 AS STRING), '.', lpad(CAST(h % 100 AS STRING), 2, '0'), ' %')")})"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def item(self, array: str, i: int) -> str:
        return f"element_at({array}, {i})" if self.spark else f"{array}[{i}]"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, '{by}')" if self.spark else f"array_to_string({array}, '{by}')"

    def sorted_list(self, value: str, order: str) -> str:
        """An aggregate: the values in their own order."""
        return f"array_sort(collect_list({value}))" if self.spark else f"list({value} ORDER BY {order})"

    def rows(self, array: str, alias: str, column: str) -> str:
        """A lateral table of an array's items."""
        return f"LATERAL VIEW explode({array}) {alias} AS {column}" if self.spark else f", unnest({array}) AS {alias}({column})"

    def numbers(self, first: str, last: str) -> str:
        return f"sequence({first}, {last})" if self.spark else f"generate_series({first}, {last})"

    def fail_unless(self, holds: str, message: str, value: str) -> str:
        """``value`` where ``holds`` is true or unknown; where it is false the query fails with the message."""
        fail = f"raise_error('{message}')" if self.spark else f"error('{message}')"
        return f"CASE WHEN coalesce({holds}, true) THEN {value} ELSE {fail} END"

    def metric_map(self, key: str, value: str) -> str:
        """An aggregate: a map from one row a key, no two alike."""
        if self.spark:
            return f"map_from_entries(array_sort(collect_list(struct({key}, {value}))))"
        return f"map_from_entries(list(struct_pack(k := {key}, v := {value}) ORDER BY {key}))"

    def entries(self, m: str) -> str:
        """A map as text, in the order of its keys: maps have no order of their own to compare by."""
        if self.spark:
            return f"array_join(transform(array_sort(map_entries({m})), e -> concat(e.key, '=', coalesce(CAST(e.value AS STRING), 'null'))), ',')"
        return f"array_to_string(list_transform(list_sort(map_entries({m})), lambda e: e.key || '=' || coalesce(CAST(e.value AS VARCHAR), 'null')), ',')"

    # Scalars.
    def us(self, ts: str) -> str:
        return f"unix_micros(CAST({ts} AS TIMESTAMP))" if self.spark else f"epoch_us({ts})"

    def matches(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE r'{pattern}')" if self.spark else f"regexp_matches({text}, '{pattern}')"

    def replace(self, text: str, pattern: str, by: str) -> str:
        if self.spark:
            return f"regexp_replace({text}, r'{pattern}', r'{by}')"
        return f"regexp_replace({text}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"

    def half_even(self, x: str, digits: int = 0) -> str:
        return f"bround({x}, {digits})" if self.spark else f"round_even({x}, {digits})"

    def json(self, text: str, field: str) -> str:
        return f"get_json_object({text}, '$.{field}')" if self.spark else f"json_extract_string({text}, '$.{field}')"

    def whole(self, x: str) -> str:
        """Floor as a whole number."""
        return f"CAST(floor({x}) AS BIGINT)"

    def pad(self, x: str, width: int) -> str:
        return f"lpad(CAST({x} AS STRING), {width}, '0')" if self.spark else f"lpad(CAST({x} AS VARCHAR), {width}, '0')"

    @property
    def text(self) -> str:
        return "STRING" if self.spark else "VARCHAR"


DUCKDB = Dialect(spark=False, k=FIXTURE)
