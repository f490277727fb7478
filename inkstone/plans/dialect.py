"""Query texts for two engines: Spark runs one, and the other is what it is held against."""

from __future__ import annotations


class Spark:
    name = "spark"

    def s(self, text: str) -> str:
        return "r'" + text.replace("'", r"\x27") + "'" if "'" in text else f"r'{text}'"

    def every(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, '{to}')"

    def part(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.s(pattern)}, {group})"

    def has(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.s(pattern)})"

    def find(self, x: str, y: str) -> str:
        return f"instr({x}, {y})"

    def number(self, x: str) -> str:
        return f"try_cast({x} AS INT)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def grams(self, x: str, n: int) -> str:
        return f"transform(sequence(1, greatest(length({x}) - {n} + 1, 1)), i -> substr({x}, i, {n}))"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def unnest(self, array: str, name: str) -> str:
        """A FROM item that follows a table."""
        return f"LATERAL VIEW explode({array}) AS {name}"

    def joined(self, x: str, order: str, by: str = ",") -> str:
        return f"listagg({x}, '{by}') WITHIN GROUP (ORDER BY {order})"

    text = "STRING"
    newline = "'\\n'"
    double = "DOUBLE"


class Duck(Spark):
    name = "duck"

    def s(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def every(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.s(pattern.replace('(?U)', ''))}, '{to.replace('$', chr(92))}', 'g')"

    def part(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.s(pattern)}, {group})"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.s(pattern)})"

    def find(self, x: str, y: str) -> str:
        return f"strpos({x}, {y})"

    def number(self, x: str) -> str:
        return f"TRY_CAST({x} AS INT)"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def grams(self, x: str, n: int) -> str:
        return f"list_transform(range(1, greatest(length({x}) - {n} + 1, 1) + 1), lambda i: substr({x}, i, {n}))"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def unnest(self, array: str, name: str) -> str:
        return f", LATERAL (SELECT unnest({array}) AS {name})"

    def joined(self, x: str, order: str, by: str = ",") -> str:
        return f"string_agg({x}, '{by}' ORDER BY {order})"

    text = "VARCHAR"
    newline = "chr(10)"


SPARK, DUCK = Spark(), Duck()
