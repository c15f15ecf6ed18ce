"""Match positions with SQL functions alone.

Spark's regexp functions return matched strings, not places. The places follow
from the pieces between matches: ``split`` with the same pattern gives the gaps,
so the n-th match starts after n + 1 gaps and n matches. All places are code
points, ends exclusive. Sums and overlaps are taken in sorted passes, so long texts
with many matches take time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACE = "array<struct<start:bigint,end:bigint,hit:string,part:string>>"


#: Elements that a fold copies its result for; longer arrays are folded block by block.
_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column], first: Column) -> Column:
    """array<bigint>: for each item the join of the values of all before it, ``first`` at the start.

    A fold that appends to an array copies it each time, so it is done in blocks of a fixed length,
    then over the blocks: near to linear in the number of items.
    """
    first = first.cast("bigint")
    none = F.expr("cast(array() as array<bigint>)")

    def fold(some: Column, of: Callable[[Column], Column]) -> Column:
        start = F.struct(first.alias("at"), none.alias("out"))
        return F.aggregate(some, start, lambda acc, x: F.struct(join(acc["at"], of(x).cast("bigint")).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def over(all_: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_)), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda at: fold(F.slice(all_, at, _BLOCK), value))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, fold(bs, lambda b: b["at"])["out"], lambda b, base: F.transform(b["out"], lambda x: join(base, x)))))

    return let(items, over)


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, hit, part>> of the leftmost non-overlapping matches; ``part`` is the group."""
    columns = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    if group:
        columns.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    length = lambda x: F.coalesce(F.char_length(x["hit"]), F.lit(0))

    def placed(x: Column, at: Column) -> Column:
        begin = at + F.char_length(x["gap"])
        return F.struct(begin.alias("start"), (begin + length(x)).alias("end"), x["hit"].alias("hit"), x["part" if group else "hit"].alias("part"))

    def found(pairs: Column) -> Column:
        ends = scan(pairs, lambda x: F.char_length(x["gap"]) + length(x), lambda a, b: a + b, F.lit(0))
        return F.filter(F.zip_with(pairs, ends, placed), lambda x: x["hit"].isNotNull())

    # Most texts have no match: they skip the rest.
    return let(F.arrays_zip(*columns), lambda pairs: F.when(F.size(pairs) > 1, found(pairs)).otherwise(no_places()))


def windows(text: Column, size: int = 1024, side: int = 64) -> Column:
    """The text in overlapping parts, for short substrings at many places: a substring walks its string from the start."""
    padded = F.concat(F.repeat(F.lit(" "), F.lit(side)), text)
    return F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / size).cast("int")), lambda i: F.substring(padded, i * size + 1, F.lit(size + 2 * side)))


def around(parts: Column, place: Column, before: int, after: int, size: int = 1024, side: int = 64) -> Column:
    """``before`` characters up to a place and ``after`` from it on, out of ``windows``; spaces stand before the text. Both at most ``side``."""
    i = F.floor(place / size).cast("int")
    return F.substring(F.get(parts, i), (place - i * size).cast("int") + side - before + 1, F.lit(before + after))


def cut_out(text: Column, gone: Column, mask: str) -> Column:
    """The text with ``mask`` for each of ``gone``, sorted spans apart from each other."""

    def joined_block(ps: Column) -> Column:
        base, end = F.element_at(ps, 1)["a"], F.element_at(ps, -1)["b"]
        segment = F.substring(text, base.cast("int") + 1, (end - base).cast("int"))
        return let(segment, lambda seg: F.array_join(F.transform(ps, lambda p: F.substring(seg, (p["a"] - base).cast("int") + 1, (p["b"] - p["a"]).cast("int"))), mask))

    def over(cut: Column) -> Column:
        a = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cut, lambda x: x["end"]))
        b = F.concat(F.transform(cut, lambda x: x["start"]), F.array(F.char_length(text).cast("bigint")))
        blocks = lambda ps: F.transform(F.sequence(F.lit(1), F.size(ps), F.lit(_BLOCK)), lambda at: let(F.slice(ps, at, _BLOCK), joined_block))
        return F.array_join(let(F.arrays_zip(a.alias("a"), b.alias("b")), blocks), mask)

    return let(gone, over)


def free_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``: one sorted pass each way, no pairs."""
    far = F.lit((1 << 62) - 1)

    def over(both: Column) -> Column:
        before = scan(both, lambda x: F.when(x["own"], F.lit(0)).otherwise(x["end"]), F.greatest, F.lit(0))
        after = F.reverse(scan(F.reverse(both), lambda x: F.when(x["own"], far).otherwise(x["start"]), F.least, far))
        clear = F.filter(F.arrays_zip(both.alias("x"), before.alias("before"), after.alias("after")), lambda z: z["x"]["own"] & (z["before"] <= z["x"]["start"]) & (z["after"] >= z["x"]["end"]))
        return F.transform(clear, lambda z: z["x"]["span"])

    def compared(s: Column, b: Column) -> Column:
        mine = F.transform(s, lambda x: F.struct(x["start"].alias("start"), F.lit(True).alias("own"), x["end"].alias("end"), x.alias("span")))
        theirs = F.transform(b, lambda x: F.struct(x["start"].alias("start"), F.lit(False).alias("own"), x["end"].alias("end"), F.when(F.lit(False), F.element_at(s, 1)).alias("span")))
        return let(F.sort_array(F.concat(mine, theirs)), over)

    return let(spans, lambda s: let(base, lambda b: F.when((F.size(s) == 0) | (F.size(b) == 0), s).otherwise(compared(s, b))))


def chains(spans: Column, touching: bool = False) -> Column:
    """Arrays of spans, by start, that hang together by overlaps (or by touching)."""

    def over(s: Column) -> Column:
        tops = scan(s, lambda x: x["end"], F.greatest, F.lit(-1))
        apart = lambda x, top: x["start"] > top if touching else x["start"] >= top
        heads = F.array_compact(F.transform(F.arrays_zip(s.alias("x"), tops.alias("top")), lambda z, i: F.when(apart(z["x"], z["top"]), i)))
        return let(heads, lambda h: F.transform(h, lambda at, k: F.slice(s, at + 1, F.coalesce(F.get(h, k + 1), F.size(s)) - at)))

    return let(F.sort_array(spans), over)


def no_places() -> Column:
    return F.expr(f"cast(array() as {_PLACE})")


def tagged(found: Column, kind: str, order: int) -> Column:
    """Places as array<struct<start, order, end, kind>>, the form that is sorted and joined."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind order, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])
