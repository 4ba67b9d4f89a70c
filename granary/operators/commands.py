"""Stock commands as a dataflow: accept or reject each one, and what follows from it.

A command is accepted or rejected by the state its key has reached, so a key is replayed in order. The commands
are dealt to slices of even size (`ordered.cut`), the slices of all keys are folded side by side over sorted arrays, and
settle on the levels that they start from (`ordered.settle`): one path for every key, whatever its length.

Fixed values: the operations and the conditions under which they are accepted
    ADJUST   on_hand + q >= 0
    RESERVE  q > 0 and q <= on_hand - reserved
    RELEASE  q <= reserved
    SALE     q <= on_hand - reserved
    RECEIPT  always; in_transit is reduced by q when it holds at least q
Any command for a key without an item is rejected as not found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import stock
from granary.operators.ordered import FOUND, SLICE, cut, running_totals, settle
from granary.schemas import KEY

NOT_FOUND = "NOT_FOUND"
MISSING = "MISSING_VALUE"
NEGATIVE = "NEGATIVE_INVENTORY"
INSUFFICIENT = "INSUFFICIENT_INVENTORY"
OVER_RELEASE = "RELEASE_EXCEEDS_RESERVED"
NOT_POSITIVE = "QUANTITY_NOT_POSITIVE"
UNKNOWN_OP = "UNKNOWN_OPERATION"

JUDGED = (
    "id bigint, sku string, warehouse_id string, op string, quantity int, timestamp timestamp_ntz, "
    "rejection string, on_hand_after bigint, reserved_after bigint"
)
#: Outcomes appended one by one before they are put aside as a block: appending copies what is there.
_NEAR = 200


def _op() -> Column:
    return F.col("op")


def _q() -> Column:
    return F.col("quantity")


def on_hand_change(op: Column, q: Column) -> Column:
    """What an accepted command adds; one without quantity changes nothing."""
    change = F.when(op.isin("ADJUST", "RECEIPT"), q).when(op == "SALE", -q)
    return F.coalesce(change, F.lit(0)).cast("bigint")


def reserved_change(op: Column, q: Column) -> Column:
    change = F.when(op == "RESERVE", q).when(op == "RELEASE", -q)
    return F.coalesce(change, F.lit(0)).cast("bigint")


def rejection(op: Column, q: Column, on_hand: Column, reserved: Column) -> Column:
    """Why a command fails in the given state before it; NULL when it is accepted."""
    return (
        F.when(op.isNull() | q.isNull(), MISSING)
        .when((op == "ADJUST") & (on_hand + q < 0), NEGATIVE)
        .when((op == "RESERVE") & (q <= 0), NOT_POSITIVE)
        .when(op.isin("RESERVE", "SALE") & (q > on_hand - reserved), INSUFFICIENT)
        .when((op == "RELEASE") & (q > reserved), OVER_RELEASE)
        .when(~op.isin("ADJUST", "RESERVE", "RELEASE", "SALE", "RECEIPT"), UNKNOWN_OP)
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _levels_after(state: Column, row: Column, why: Column) -> list[Column]:
    op, q = row["op"], row["quantity"]
    applied = lambda change: F.when(why.isNull(), change).otherwise(F.lit(0).cast("bigint"))
    return [
        (state["on_hand"] + applied(on_hand_change(op, q))).alias("on_hand"),
        (state["reserved"] + applied(reserved_change(op, q))).alias("reserved"),
    ]


def _why(state: Column, row: Column) -> Column:
    return rejection(row["op"], row["quantity"], state["on_hand"], state["reserved"])


LEVELS = ["on_hand", "reserved"]


def _levels(rows: Column, start: Column) -> Column:
    """The levels after all commands of a slice."""
    return F.aggregate(rows, start, lambda s, x: _let(_why(s, x), lambda why: F.struct(*_levels_after(s, x, why))))


def _applied(rows: Column, start: Column) -> Column:
    """The levels after all commands of a slice, and how many of them were accepted."""
    begin = F.struct(*[start[n].alias(n) for n in LEVELS], F.lit(0).cast("bigint").alias("applied"))
    return F.aggregate(rows, begin, lambda s, x: _let(_why(s, x), lambda why: F.struct(
        *_levels_after(s, x, why), (s["applied"] + why.isNull().cast("bigint")).alias("applied"))))


def _in_transit(rows: Column, start: Column) -> Column:
    """What is left in transit after the receipts of a slice: one larger than what is left changes nothing."""
    def receive(s: Column, x: Column) -> Column:
        fits = (x["op"] == "RECEIPT") & (s["in_transit"] >= x["quantity"])
        return F.struct((s["in_transit"] - F.when(fits, x["quantity"]).otherwise(F.lit(0))).cast("bigint").alias("in_transit"))

    return F.aggregate(rows, start, receive)


_OUTCOME = "struct<rejection:string,on_hand_after:bigint,reserved_after:bigint>"


def _outcomes(rows: Column, start: Column) -> Column:
    """Rejection and levels of each command of a slice, in order."""
    begin = F.struct(
        *[start[n].alias(n) for n in LEVELS],
        F.array().cast(f"array<{_OUTCOME}>").alias("near"), F.array().cast(f"array<array<{_OUTCOME}>>").alias("done"),
    )

    def judged(s: Column, x: Column) -> Column:
        def noted(now: Column) -> Column:
            one = F.struct(now["why"].alias("rejection"), now["on_hand"].alias("on_hand_after"), now["reserved"].alias("reserved_after"))
            near, full = F.concat(s["near"], F.array(one.cast(_OUTCOME))), F.size(s["near"]) >= _NEAR - 1
            return F.struct(
                now["on_hand"].alias("on_hand"), now["reserved"].alias("reserved"),
                F.when(full, F.array().cast(f"array<{_OUTCOME}>")).otherwise(near).alias("near"),
                F.when(full, F.concat(s["done"], F.array(near))).otherwise(s["done"]).alias("done"),
            )

        after = _let(_why(s, x), lambda why: F.struct(*_levels_after(s, x, why), why.alias("why")))
        return _let(after, noted)

    return F.aggregate(rows, begin, judged, lambda s: F.flatten(F.concat(s["done"], F.array(s["near"]))))


def _slices(items: DataFrame, commands: DataFrame, slices: int | None) -> DataFrame:
    """A row per key and slice: its commands in order, the key's levels before all of them, and what the slice changes if
    nothing is rejected. `_found` tells whether there is such an item."""
    level = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    levels = items.select(
        *KEY, level("quantity_on_hand").alias("on_hand"), level("quantity_reserved").alias("reserved"),
        level("quantity_in_transit").alias("in_transit"), F.lit(True).alias(FOUND),
    )
    dealt = cut(commands.select("id", *KEY, "op", "quantity", "timestamp"), KEY, ["timestamp", "id"], slices=slices)
    received = F.when(_op() == "RECEIPT", _q())
    table = dealt.groupBy(*KEY, SLICE).agg(
        F.sort_array(F.collect_list(F.struct("timestamp", "id", "op", "quantity"))).alias("_rows"),
        F.struct(
            F.sum(on_hand_change(_op(), _q())).alias("on_hand"), F.sum(reserved_change(_op(), _q())).alias("reserved"),
            (-F.coalesce(F.sum(received), F.lit(0))).cast("bigint").alias("in_transit"),
        ).alias("_guess"),
    )
    return table.join(levels, KEY, "left").withColumn(FOUND, F.coalesce(FOUND, F.lit(False))).checkpoint()


def judge(items: DataFrame, commands: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Every command with its rejection (NULL when accepted) and the levels after it.

    Commands are ordered by (timestamp, id) within a key, those without a time first; ids must be unique. `slices` is as
    for `ordered.cut`.
    """
    table = _slices(items, commands, slices)
    starts = settle(table.filter(FOUND), KEY, LEVELS, _levels)
    unknown = F.transform("_rows", lambda _: F.struct(
        F.lit(NOT_FOUND).alias("rejection"), F.lit(None).cast("bigint").alias("on_hand_after"), F.lit(None).cast("bigint").alias("reserved_after"),
    ).cast(_OUTCOME))
    outcomes = F.when(F.col("_at").isNotNull(), _outcomes(F.col("_rows"), F.col("_at"))).otherwise(unknown)
    each = table.select(*KEY, SLICE, "_rows").join(starts, [*KEY, SLICE], "left").select(
        *KEY, F.explode(F.zip_with("_rows", outcomes, lambda row, out: F.struct(row.alias("row"), out.alias("outcome")))).alias("_one"))
    return each.select(
        "_one.row.id", *KEY, "_one.row.op", "_one.row.quantity", "_one.row.timestamp", "_one.outcome.*")


def accepted(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("rejection").isNull())


def rejected(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("rejection").isNotNull())


def ledger_from_commands(commands: DataFrame) -> DataFrame:
    """One signed ledger row per command."""
    # Operation, ledger type, sign
    kind = (
        F.when(_op() == "SALE", "SALE").when(_op() == "RESERVE", "RESERVATION")
        .when(_op() == "RELEASE", "RELEASE").when(_op() == "RECEIPT", "RESTOCK")
        .when(_op() == "ADJUST", "ADJUSTMENT")
    )
    return commands.select(
        "id", *KEY,
        F.when(_op().isin("SALE", "RESERVE"), -_q()).otherwise(_q()).alias("quantity_change"),
        kind.alias("transaction_type"),
        "timestamp",
    )


def events_from_commands(commands: DataFrame) -> DataFrame:
    """One event per command, for the inventory topic."""
    # Operation, event type
    kind = (
        F.when(_op().isin("ADJUST", "SALE"), "INVENTORY_UPDATED").when(_op() == "RESERVE", "RESERVED")
        .when(_op() == "RELEASE", "RELEASED").when(_op() == "RECEIPT", "RESTOCKED")
    )
    return commands.select(
        F.col("id").cast("string").alias("event_id"), *KEY,
        F.when(_op().isin("SALE", "RESERVE"), -_q()).otherwise(_q()).alias("quantity_change"),
        kind.alias("event_type"),
        "timestamp",
    )


def _final(table: DataFrame, state: list[str], fold: Callable, end: Callable) -> DataFrame:
    """(key, `_last`, `_ends`): what `end` gives for the last slice of each key, and for all of them."""
    starts = settle(table.filter(FOUND), KEY, state, fold)
    ended = table.join(starts, [*KEY, SLICE]).withColumn("_end", end(F.col("_rows"), F.col("_at")))
    return ended.groupBy(*KEY).agg(F.max_by("_end", SLICE).alias("_last"), F.collect_list("_end").alias("_ends"))


def levels_after(items: DataFrame, commands: DataFrame, *, slices: int | None = None) -> DataFrame:
    """(key, on_hand, reserved, in_transit, applied) of the items that commands name: their levels after all
    that are accepted, and how many those are."""
    table = _slices(items, commands, slices)
    done = _final(table, LEVELS, _levels, _applied).select(
        *KEY, "_last.on_hand", "_last.reserved",
        F.aggregate("_ends", F.lit(0).cast("bigint"), lambda n, e: n + e["applied"]).alias("applied"),
    )
    # a receipt for a known item is never rejected, so these need not wait for the judgement
    transit = _final(table, ["in_transit"], _in_transit, _in_transit).select(*KEY, "_last.in_transit")
    return done.join(transit, KEY)


def in_transit_after(items: DataFrame, receipts: DataFrame, *, slices: int | None = None) -> DataFrame:
    """What is still in transit per key after its receipts, taken in order, as `_transit`. A receipt larger than what is
    left changes nothing."""
    table = _slices(items, receipts, slices)
    return _final(table, ["in_transit"], _in_transit, _in_transit).select(*KEY, F.col("_last.in_transit").alias("_transit"))


def items_after(items: DataFrame, commands: DataFrame, *, slices: int | None = None) -> DataFrame:
    """The items once all commands that are accepted have been applied.

    Every touched item gets a status derived from its new levels, so DISCONTINUED is lost,
    and its version goes up by the number of accepted commands.
    """
    return with_levels(items, levels_after(items, commands, slices=slices))


def with_levels(items: DataFrame, after: DataFrame) -> DataFrame:
    """`items` with the levels of `after` (key, on_hand, reserved, in_transit, applied)."""
    own = after.select(*KEY, F.struct("on_hand", "reserved", "in_transit", "applied").alias("_after"))
    applied = F.coalesce("_after.applied", F.lit(0))
    merged = items.join(own, KEY, "left").withColumns({
        "quantity_on_hand": F.when(applied > 0, F.col("_after.on_hand")).otherwise(F.col("quantity_on_hand")).cast("int"),
        "quantity_reserved": F.when(applied > 0, F.col("_after.reserved")).otherwise(F.col("quantity_reserved")).cast("int"),
        "quantity_in_transit": F.coalesce("_after.in_transit", "quantity_in_transit").cast("int"),
    })
    return merged.withColumns({
        "inventory_status": F.when(applied > 0, stock.derived_status()).otherwise(F.col("inventory_status")),
        "version": (F.coalesce("version", F.lit(0)) if "version" in items.columns else F.lit(0)) + applied,
    }).drop("_after")


def replay_ledger(items: DataFrame, ledger: DataFrame, *, slices: int | None = None) -> DataFrame:
    """Stock level after every movement of a known item: its level and all changes so far."""
    start = items.select(*KEY, F.col("quantity_on_hand").cast("bigint").alias("stock_after"))
    moves = running_totals(
        ledger.select("id", *KEY, "quantity_change", "timestamp"),
        KEY,
        ["timestamp", "id"],
        {"stock_after": F.col("quantity_change").cast("bigint")},
        start=start,
        slices=slices,
    )
    return moves.filter(FOUND).select("id", *KEY, "timestamp", "quantity_change", "stock_after")
