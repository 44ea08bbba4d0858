"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Sources share the mix by weight; a target stops at ``cap`` times its source's size and the excess is
reshared by weight.  Each source's documents stand in a fixed pseudo-random order (md5 of doc_id) and
its words are laid end to end, again from the start for repeats; the mix takes words up to the target.
A source also has a weight schedule over training time, piecewise linear.  Its integral, scaled to the
target, is the source's cumulative demand; inverting it gives the training position at which a
document's words are due, and documents are range-sorted by position.

Cumulative sizes come in two levels: totals of (source, first digits of the md5) are added up over the
digits, then rows within one such cell.  The number of digits follows the number of rows (``CELL_ROWS`` a cell
and source if ids differ), so a source with a third of all rows is thousands of cells and no task ever holds a
source.  Rows that share an id and a size are one row with a count until their places are known: ids that a
third of all rows repeat, or lack, take as many rows as they have sizes.

Defined results
* null text: size 0.  Null source: a source of its own, last in order.
* null ``doc_id``: a document like others (its key is the empty text).
* repeated rows are separate documents; empty tables give empty results; further columns are ignored.
* a document that the mix takes more than once has a position for each time (``curriculum``); ``mix`` gives the
  first two, null where it is not taken so often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

WORDS = r"[^\x20\x09-\x0D]+"
CELL_ROWS, LOT = 2000, 50_000
#: weight schedules by a source's place, repeating: (time, weight) knots from time 0 to 1
FADE, STEADY, RISE = ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))


def integral(knots) -> list[float]:
    """The schedule's integral up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def position(share: Column, knots) -> Column:
    """The time at which ``share`` (0 to 1) of the schedule's integral has passed."""
    area = integral(knots)
    y = share * F.lit(area[-1])
    out = F.lit(1.0)
    for k in range(len(knots) - 2, -1, -1):
        (t0, w0), (t1, w1) = knots[k], knots[k + 1]
        rest = y - F.lit(area[k])
        slope = (w1 - w0) / (t1 - t0)
        if slope == 0:
            t = rest / F.lit(w0) if w0 else F.lit(0.0)
        else:  # w0 * t + slope / 2 * t * t = rest
            t = (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(w0)) / F.lit(slope)
        out = F.when(y < F.lit(area[k + 1]), F.lit(t0) + t).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``sizes`` has a row (key, source, source_size) for each source; adds ``place``, ``weight`` and ``target``.

    With sources by rising cap over weight, the level is (all - caps before) / (weights from here on) at the
    first source whose share at this level stays under its cap.  There are as many rows as sources.
    """
    every = Window.partitionBy()
    s = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    pick = F.lit(weights[-1])
    for k, w in enumerate(weights[:-1]):
        pick = F.when(F.pmod("place", F.lit(len(weights))) == k, F.lit(w)).otherwise(pick)
    s = s.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * cap)
    s = s.withColumn("want", F.sum("source_size").over(every).cast("double") * share)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("after", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.col("want") - F.col("before")) / F.col("after"))
    under = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("first", F.min(F.when(under, F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(every))
    level = F.col("first.level")
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return s.select("key", "source", "place", "weight", "source_size", target.alias("target"))


def _by_place(expr, schedules) -> Column:
    out = expr(schedules[-1])
    for k, s in enumerate(schedules[:-1]):
        out = F.when(F.pmod("place", F.lit(len(schedules))) == k, expr(s)).otherwise(out)
    return out


def _placed(docs: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """(doc_id, size, place, source_size, target, start) of each row: ``start`` counts the words of its source that go before."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("key", key)
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = stage(base.withColumn("h", h).groupBy("key", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "sizes")
    digits = 1
    rows = base.count()
    while 16**digits * CELL_ROWS < rows and digits < 12:
        digits += 1
    base = base.withColumn("cell", F.substring("h", 1, digits))
    cells = base.groupBy("key", "cell").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("cell_size"))
    sizes = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size"))
    goal = targets(sizes, weights, share, cap).select("key", "place", "source_size", "target")
    # cells are summed in two levels as well: by their first digits, then within these
    cells = cells.withColumn("top", F.substring("cell", 1, (digits + 1) // 2))
    tops = cells.groupBy("key", "top").agg(F.sum("cell_size").alias("top_size"))
    upto = F.sum("top_size").over(Window.partitionBy("key").orderBy("top").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.withColumn("top_before", F.coalesce(upto, F.lit(0))).select("key", "top", "top_before")
    before = F.sum("cell_size").over(Window.partitionBy("key", "top").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("before", F.coalesce(before, F.lit(0))).join(tops, ["key", "top"]).select("key", "cell", (F.col("before") + F.col("top_before")).alias("cell_before")).join(goal, "key")
    rows = base.drop("source").join(cells, ["key", "cell"])
    inside = F.sum(F.col("size") * F.col("n")).over(Window.partitionBy("key", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("first", F.col("cell_before") + F.coalesce(inside, F.lit(0)))
    # in two steps, so that no array follows the number of equal rows
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT).cast("long"))))
    rows = rows.withColumn("i", F.explode(F.sequence(F.col("lot") * LOT, F.least(F.col("n"), (F.col("lot") + 1) * LOT) - 1)))
    return rows.select("doc_id", "size", "place", "source_size", "target", (F.col("first") + F.col("i") * F.col("size")).alias("start"))


def _turn(k: int) -> tuple[Column, Column]:
    """Words that the mix takes of a document the ``k``-th time (from 0), and the share of the demand that goes before."""
    at = F.col("start") + F.col("source_size") * k
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - at)).cast("long"), F.try_divide(at.cast("double"), "target")


def mix(docs: DataFrame, weights=(5, 2, 1), schedules=(FADE, STEADY, RISE), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position, repeat_position) of each row, sorted by position.

    ``taken`` counts words, repeats too; ``position`` (0 to 1) is when the document's first words are due, ``repeat_position``
    when they are due again; null if none are taken.
    """
    rows = _placed(docs, weights, share, cap).withColumn("taken", sum((_turn(k)[0] for k in range(1, cap)), _turn(0)[0]))
    when = lambda k: F.when(_turn(k)[0] > 0, F.round(_by_place(lambda s: position(_turn(k)[1], s), schedules), 9)) if k < cap else F.lit(None).cast("double")
    rows = rows.withColumn("position", when(0)).withColumn("repeat_position", when(1))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "position", "repeat_position").orderBy("position", "doc_id")


def curriculum(docs: DataFrame, weights=(5, 2, 1), schedules=(FADE, STEADY, RISE), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(position, doc_id, turn, words): a row for each time the mix takes a document, range-sorted by training position."""
    rows = _placed(docs, weights, share, cap)
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), _turn(k)[0].alias("words"), _by_place(lambda s, k=k: position(_turn(k)[1], s), schedules).alias("position")) for k in range(cap)])
    return rows.select("doc_id", F.explode(turns).alias("x")).filter("x.words > 0").select(F.round("x.position", 9).alias("position"), "doc_id", "x.turn", "x.words").orderBy("position", "doc_id", "turn")
