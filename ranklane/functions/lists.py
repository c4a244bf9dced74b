"""Rank edits as column expressions over arrays of distinct keys, best first.

Everything stays in the JVM: higher-order functions, no Python UDF. Arrays are bounded by the encoding's
length limit.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names under which the two edits are known.
STEP_NAMES = {
    "overexpress": "overexpress", "oe": "overexpress", "up": "overexpress", "delete": "delete", "kd": "delete", "ko": "delete", "knockdown": "delete", "knockout": "delete",
}
#: Marks a perturbation whose keys are all absent.
ABSENT = -100


def keys(values: Sequence[int]) -> Column:
    """A literal array of keys."""
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is computed once a row: within a lambda, an expression is computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def step_name(name: str) -> str:
    """The edit's own name; inhibit and activate have no semantics and are refused."""
    found = STEP_NAMES.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown or unimplemented edit {name!r}")
    return found


def delete(ids: Column, gone: Column) -> Column:
    """Without the given keys, order kept; absent keys change nothing."""
    return F.filter(ids, lambda x: ~F.array_contains(gone, x))


def overexpress(ids: Column, up: Column) -> Column:
    """The given keys first, in their order, and then the others; the length stays, so the tail falls off."""
    up = F.array_distinct(up)
    return F.slice(F.concat(up, delete(ids, up)), F.lit(1), F.size(ids))


def to_front(ids: Column, at: Column) -> Column:
    """The key at a 0-based position first."""
    return F.concat(F.slice(ids, at + 1, F.lit(1)), F.filter(ids, lambda x, i: i != at))


def apply_steps(ids: Column, steps: Sequence[tuple[str, Sequence[int]]]) -> Column:
    """Typed steps, left to right."""
    for name, tokens in steps:
        ids = delete(ids, keys(tokens)) if step_name(name) == "delete" else overexpress(ids, keys(tokens))
    return ids


def final_overexpressed(steps: Sequence[tuple[str, Sequence[int]]]) -> list[int]:
    """Keys that end up overexpressed: added by such steps, taken away by deletions."""
    out: dict[int, None] = {}
    for name, tokens in steps:
        if step_name(name) == "delete":
            for t in tokens:
                out.pop(t, None)
        else:
            out |= dict.fromkeys(tokens)
    return list(out)


def positions_of(ids: Column, wanted: Column) -> Column:
    """0-based positions of the wanted keys that are present, in their order; [ABSENT] if none is."""
    found = F.filter(F.transform(wanted, lambda t: (F.array_position(ids, t) - 1).cast("int")), lambda p: p >= 0)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ABSENT)))


def remaining(ids: Column, gone_at: Column) -> Column:
    """Keys whose 0-based position is not listed."""
    return F.filter(ids, lambda x, i: ~F.array_contains(gone_at, i))


def alignment_positions(positions: Column, length: Column, n: Column) -> Column:
    """Exactly n different positions to drop: the valid listed ones first, then from the end those not listed."""
    valid = F.array_distinct(F.filter(positions, lambda p: (p >= 0) & (p < length)))
    from_end = F.transform(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: (length - i).cast("int"))
    return F.slice(F.concat(valid, F.filter(from_end, lambda p: (p >= 0) & ~F.array_contains(valid, p))), F.lit(1), n)


def base_rank_norm(ids: Column) -> Column:
    """Each position over the last one; 0 for a list of one."""
    return F.transform(ids, lambda x, i: i / F.greatest(F.size(ids) - 1, F.lit(1)))


def quantize(value: Column, grid: float) -> Column:
    """Snapped to a grid, halves to even; unchanged for a grid of 0."""
    return F.rint(value / grid) * grid if grid > 0 else value


def clamp(value: Column, bound: float) -> Column:
    return F.greatest(F.lit(-abs(bound)), F.least(F.lit(abs(bound)), value))


def by_priority(ids: Column, priority: Column, grid: float = 0.0) -> Column:
    """Reordered by rising priority (an array beside ids); equal ones, after snapping, keep their order."""
    rows = F.zip_with(F.zip_with(priority, F.sequence(F.lit(1), F.size(ids)), lambda p, i: F.struct(quantize(p, grid).alias("p"), i.alias("i"))), ids, lambda r, t: F.struct(r["p"].alias("p"), r["i"].alias("i"), t.alias("t")))
    return F.when(F.size(ids) > 0, F.transform(F.array_sort(rows), lambda r: r["t"])).otherwise(ids)


def pin_front(before: Column, after: Column, pinned: Column) -> Column:
    """Pinned keys first as they stood before, the others as they stand after."""
    return F.concat(F.filter(before, lambda x: F.array_contains(pinned, x)), delete(after, pinned))


def keep_tail(current: Column, window: Column) -> Column:
    """The reordered window, with what lay behind it if it is a permutation of the list's beginning."""
    same = (F.size(current) > F.size(window)) & (F.array_sort(F.slice(current, F.lit(1), F.size(window))) == F.array_sort(window))
    return F.when(same, F.concat(window, F.slice(current, F.size(window) + 1, F.greatest(F.size(current) - F.size(window), F.lit(0))))).otherwise(window)


def swap(ids: Column, chain: Column, placebo: Column, most: int | None = None) -> Column:
    """Chain keys that are present give place to the placebo keys beside them, whose own places go."""
    active = F.filter(F.arrays_zip(chain.alias("c"), placebo.alias("p")), lambda z: F.array_contains(ids, z["c"]))
    old, new = F.transform(active, lambda z: z["c"]), F.transform(active, lambda z: z["p"])

    def swapped(told: Column) -> Column:
        kept = F.filter(ids, lambda x: F.array_contains(told["old"], x) | ~F.array_contains(told["new"], x))
        return F.transform(kept, lambda x: F.coalesce(F.try_element_at(told["new"], F.nullif(F.array_position(told["old"], x), F.lit(0)).cast("int")), x))

    out = with_value(F.struct(old.alias("old"), new.alias("new")), swapped)
    return out if most is None else F.slice(out, 1, most)


def pad(ids: Column, length: int, with_key: int = 0) -> Column:
    """The first `length` keys, filled up on the right."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(with_key).cast("bigint"), length)), 1, length)


def attention(ids: Column, length: int) -> Column:
    """1 for keys, 0 for padding."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(ids)).cast("int"))


def topk_jaccard(a: Column, b: Column, k: int) -> Column:
    """Common over all of the first k keys of either list; null for two empty ones."""
    a, b = F.slice(a, 1, k), F.slice(b, 1, k)
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
