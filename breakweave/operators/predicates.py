"""A predicate language over alignment properties, compiled to Column expressions.

A property value is a number or string, which may begin with an operator (`!`, `<`, `<=`, `>`, `>=`) or, for strings, begin or
end with `*`. Properties of a filter must all hold. A script names filters and combines their ids by a rule with `!`, `&`, `|` and
parentheses; without a rule any filter will do.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breakweave.operators.stats import has

#: property -> column expression; flags are booleans
NUMBERS = {"alignmentFlag": "flag", "insertSize": "isize", "mapQuality": "mapq", "matePosition": "mate_pos", "position": "pos", "length": "length(seq)"}
STRINGS = {"cigar": "cigar", "name": "qname", "queryBases": "seq", "reference": "rname", "mateReference": "mate_rname"}
BOOLEANS = {"isDuplicate": "duplicate", "isFailedQC": "failed", "isFirstMate": "first", "isPaired": "paired", "isProperPair": "proper", "isReverseStrand": "reverse", "isMateReverseStrand": "mate_reverse", "isSecondMate": "second"}
INVERTED = {"isMapped": "unmapped", "isMateMapped": "mate_unmapped", "isPrimaryAlignment": "secondary"}


def condition(name: str, value: str) -> Column:
    value = str(value)
    if name in BOOLEANS or name in INVERTED:
        wanted = value.strip().lower() in ("true", "1")
        found = has(F.col("flag"), BOOLEANS.get(name) or INVERTED[name])
        return found == F.lit(wanted != (name in INVERTED))
    if name in NUMBERS:
        return compared(F.expr(NUMBERS[name]), value, float)
    if name in STRINGS:
        return matched(F.col(STRINGS[name]), value)
    if name == "tag":
        tag, _, rest = value.partition(":")
        own = F.col("tags")[tag]
        return compared(own.cast("double"), rest, float) if re.match(r"^(!|[<>]=?)?-?\d", rest) else matched(own, rest)
    raise ValueError(f"unknown property {name}")


def compared(column: Column, value: str, kind=float) -> Column:
    op, number = re.match(r"^(!|<=|>=|<|>)?\s*(.*)$", value.strip()).groups()
    x = F.lit(kind(number))
    return {None: column == x, "!": column != x, "<": column < x, "<=": column <= x, ">": column > x, ">=": column >= x}[op]


def matched(column: Column, value: str) -> Column:
    if value.startswith("!"):
        return ~matched(column, value[1:])
    begins, ends = value.startswith("*"), value.endswith("*") and len(value) > 1
    core = value[begins : len(value) - ends]
    if begins and ends:
        return column.contains(core)
    return column.endswith(core) if begins else column.startswith(core) if ends else column == core


def compiled(script: str | dict) -> Column:
    """The condition of a whole script."""
    script = json.loads(script) if isinstance(script, str) else script
    filters = script.get("filters", [script])
    named = {str(f.get("id", k + 1)): reduce(Column.__and__, [condition(p, v) for p, v in f.items() if p != "id"], F.lit(True)) for k, f in enumerate(filters)}
    rule = script.get("rule")
    return Rule(rule, named).whole() if rule else reduce(Column.__or__, named.values())


class Rule:
    """Recursive descent over ids, `!`, `&`, `|` and parentheses."""

    def __init__(self, text: str, named: dict[str, Column]):
        self.words, self.named = re.findall(r"[!&|()]|[^\s!&|()]+", text), named

    def whole(self) -> Column:
        found = self.either()
        if self.words:
            raise ValueError(f"unexpected {self.words[0]}")
        return found

    def either(self) -> Column:
        found = self.both()
        while self.words[:1] == ["|"]:
            self.words.pop(0)
            found = found | self.both()
        return found

    def both(self) -> Column:
        found = self.one()
        while self.words[:1] == ["&"]:
            self.words.pop(0)
            found = found & self.one()
        return found

    def one(self) -> Column:
        if not self.words:
            raise ValueError("the rule ends too early")
        word = self.words.pop(0)
        if word == "!":
            return ~self.one()
        if word == "(":
            found = self.either()
            if self.words[:1] != [")"]:
                raise ValueError("a parenthesis is not closed")
            self.words.pop(0)
            return found
        return self.named[word]


def region(text: str, rname: str = "rname", pos: str = "pos") -> Column:
    """`chr`, `chr:start`, `chr:start..end` or `chr:start..chr:end`; positions are inclusive."""
    left, _, right = text.partition("..")
    chrom, _, start = left.partition(":")
    last_chrom, _, stop = right.partition(":") if ":" in right else (chrom, "", right)
    if last_chrom != chrom:
        return ((F.col(rname) == chrom) & (F.col(pos) >= int(start or 0))) | ((F.col(rname) == last_chrom) & (F.col(pos) <= int(stop)))
    found = F.col(rname) == chrom
    if start:
        found &= F.col(pos) >= int(start)
    return found & (F.col(pos) <= int(stop)) if stop else found


def select(df: DataFrame, script: str | dict) -> DataFrame:
    return df.where(compiled(script))
