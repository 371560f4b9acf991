"""Regular-expression helpers: flag handling and ``find_spans``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, END = "\u001e", "\u001f"
#: What stands for a mark that a text itself has: as long and as little a letter or blank.
STAND_IN = "\u001d"
#: Matches whose starts are summed one by one; their blocks are summed in turn.
BLOCK = 64


def java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    """Pattern with the flags that give it Unicode classes and \\n-only line ends."""
    flags = "dU" + ("iu" if ignore_case else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def let(value: Column, use) -> Column:
    """Bind ``value`` once and use it several times in one expression.

    Inside lambdas Spark does not share common subexpressions; a one-element
    array does.
    """
    return F.transform(F.array(value), use)[0]


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """First match (or group) or NULL."""
    return let(F.regexp_extract(text, pattern, group), lambda m: F.when(m != "", m))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches (or one group of each) as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_of(items: Column, key) -> Column:
    """Keep the first element for every ``key(element)``, in order."""
    return let(
        F.transform(items, key),
        lambda keys: F.filter(
            items, lambda x, i: F.array_position(keys, key(x)) == i.cast("long") + 1
        ),
    )


def find_spans(text: Column, pattern: str) -> Column:
    """``ARRAY<STRUCT<start INT, match STRING>>`` of all matches, 0-based starts.

    One regex pass marks each match, one split cuts at the marks, and the start
    of a match is the running length of what precedes it, summed block by block so that work grows with the
    number of matches. Starts count in the original text: characters that are used as marks are stood in for one by one.
    The row stays where it is: no explode, no shuffle.
    """
    clean = F.translate(text, MARK + END, STAND_IN * 2)
    none = F.expr("cast(array() as array<int>)")

    def running(widths: Column, start: Column) -> Column:
        """Sums of what precedes each width, the total last."""
        return F.aggregate(
            widths,
            F.struct(start.alias("at"), F.array(start).alias("all")),
            lambda s, w: F.struct((s["at"] + w).alias("at"), F.concat(s["all"], F.array(s["at"] + w)).alias("all")),
            lambda s: s["all"],
        )

    def locate(parts: Column) -> Column:
        count = F.size(parts) - 1
        numbers = F.when(count > 0, F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))).otherwise(none)
        width = lambda p: F.length(p) - 1
        own = lambda b: F.slice(parts, b * BLOCK + 2, F.lit(BLOCK))
        total = lambda b: F.aggregate(own(b), F.lit(0), lambda n, p: n + width(p))
        bases = running(F.transform(numbers, total), F.length(parts[0]))

        def block(base: Column, b: Column) -> Column:
            return let(
                running(F.transform(own(b), width), base),
                lambda starts: F.transform(
                    own(b), lambda p, i: F.struct(starts[i].alias("start"), F.substring_index(p, END, 1).alias("match"))
                ),
            )

        return F.flatten(F.transform(F.slice(bases, F.lit(1), F.size(numbers)), block))

    return let(F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{END}"), MARK), locate)
