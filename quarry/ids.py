"""Readable ids for documents that come without one."""

from __future__ import annotations

import datetime
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST = ["amber", "brisk", "cedar", "dusky", "early", "frosty", "golden", "hazel", "ivory", "jolly", "keen", "lunar", "mossy", "noble", "olive", "plain"]
SECOND = ["atlas", "brief", "chart", "draft", "essay", "folio", "guide", "index", "leaf", "map", "note", "page", "quire", "report", "scroll", "tome"]

_HALF = 24  # bits of each half of a number
_MASK = (1 << _HALF) - 1
_ROUNDS = 4
_TIMES, _AGAIN = 0x9E3779, 0xC2B2AF
NUMBERS = 1 << (2 * _HALF)


def readable_id(now: datetime.datetime | None = None) -> str:
    """Two words, date and minute, such as ``amber-note-240131-0915``.

    Ids of one minute may meet; for tables of documents use ``numbered_id``.
    """
    now = now or datetime.datetime.now()
    return f"{secrets.choice(FIRST)}-{secrets.choice(SECOND)}-{now:%y%m%d-%H%M}"


def _keys(key: int) -> list[int]:
    """A number for each round."""
    out, x = [], key & 0x7FFFFFFF
    for _ in range(_ROUNDS):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(x & _MASK)
    return out


def _turned(half: Column, key: Column) -> Column:
    """A round's function of one half; all products stay below 2**49."""
    a = half.bitwiseXOR(key) * F.lit(_TIMES)
    b = a.bitwiseXOR(F.shiftright(a, 13)).bitwiseAND(_MASK) * F.lit(_AGAIN)
    return b.bitwiseXOR(F.shiftright(b, 15)).bitwiseAND(_MASK)


def _rounds(left: Column, right: Column, keys: list[int], finish) -> Column:
    """The rounds as a fold over their numbers, so that each names its halves once; ``finish`` gets what comes out."""
    step = lambda acc, k: F.struct(acc["r"].alias("l"), acc["l"].bitwiseXOR(_turned(acc["r"], k)).alias("r"))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in keys]), start, step, lambda acc: finish(acc["l"], acc["r"]))


def numbered_id(number: Column, key: int = 1) -> Column:
    """The readable id of a row's number (0 to 2**48 - 1): two words and ten hexadecimal digits.

    A keyed one-to-one mapping, so distinct numbers have distinct ids, in every task and without asking any other; numbers of
    rows come from ``monotonically_increasing_id`` (of up to 32,768 partitions) or a counter. Ids of neighbours look unlike. Null stays null.
    """
    n = number.cast("long")
    word = lambda names, at: F.element_at(F.array(*map(F.lit, names)), at.cast("int") + 1)
    digits = lambda x, size: F.lpad(F.lower(F.hex(x)), size, "0")

    def named(left: Column, right: Column) -> Column:
        low = left.bitwiseAND((1 << 16) - 1)
        return F.concat_ws("-", word(FIRST, F.shiftright(left, 20)), word(SECOND, F.shiftright(left, 16).bitwiseAND(15)), digits(right, 6), digits(low, 4))

    made = _rounds(F.shiftright(n, _HALF), n.bitwiseAND(_MASK), _keys(key), named)
    return F.when(n.between(0, NUMBERS - 1), made).when(n.isNotNull(), F.raise_error(F.lit("a number beyond 48 bits has no id")))


def number_of(id_: Column, key: int = 1) -> Column:
    """The number whose ``numbered_id`` this is; null for other strings."""
    parts = F.split(id_, "-")
    place = lambda names, k: F.array_position(F.array(*map(F.lit, names)), F.get(parts, k)) - 1
    hexed = lambda k: F.conv(F.get(parts, k), 16, 10).cast("long")
    left = F.shiftleft(place(FIRST, 0), 20) + F.shiftleft(place(SECOND, 1), 16) + hexed(3)
    # the rounds undo themselves with the halves exchanged and the keys in reverse
    number = _rounds(hexed(2), left, _keys(key)[::-1], lambda right, left: F.shiftleft(left, _HALF) + right)
    good = id_.rlike("^[a-z]+-[a-z]+-[0-9a-f]{6}-[0-9a-f]{4}\\z") & (place(FIRST, 0) >= 0) & (place(SECOND, 1) >= 0)
    return F.when(good, number)


def numbered_sql(number: str, key: int = 1) -> str:
    """``numbered_id`` in DuckDB SQL."""
    left, right = f"(({number})::bigint >> {_HALF})", f"(({number})::bigint & {_MASK})"
    steps, at = [f"{left} as l0, {right} as r0"], 0
    for k in _keys(key):
        a = f"(xor(r{at}, {k}) * {_TIMES})"
        b = f"((xor({a}, {a} >> 13) & {_MASK}) * {_AGAIN})"
        steps.append(f"r{at} as l{at + 1}, xor(l{at}, xor({b}, {b} >> 15) & {_MASK}) as r{at + 1}")
        at += 1
    out = f"select {steps[0]}"
    for s in steps[1:]:
        out = f"select *, {s} from ({out})"
    words = lambda names: "[" + ", ".join(f"'{w}'" for w in names) + "]"
    digits = lambda x, size: f"lpad(lower(to_hex({x})), {size}, '0')"
    made = f"{words(FIRST)}[(l{at} >> 20) + 1] || '-' || {words(SECOND)}[((l{at} >> 16) & 15) + 1] || '-' || {digits(f'r{at}', 6)} || '-' || {digits(f'l{at} & 65535', 4)}"
    return f"(select {made} from ({out}))"
