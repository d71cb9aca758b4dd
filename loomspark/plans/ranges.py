"""Joins whose only tie is a range, by blocks: ``lo <= x AND x <= hi`` with x of one side and lo, hi of the other.

Spark compares all pairs of rows there.  Here each interval is cut into the fewest aligned blocks of 2^k
whole numbers (two of each k at most), each point names its block of every k in use, and equal blocks meet
in a plain equi-join.  The blocks of an interval don't overlap, so each pair is met once; the statement's whole
condition is checked on it.  Work grows with the rows, the logarithm of the intervals' lengths and the result.

Taken: inner joins without a pair of equal keys, bounds of whole numbers.  Others are left to Spark.
With analyze, this module touches Spark's private plan objects.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analyze import _name, _nodes, _plan, _refs, _seq

WHOLE = ("tinyint", "smallint", "int", "bigint")
#: lower <= upper in each of these, with the places of the lower and the upper one; ends are told apart by the condition.
ORDERED = {"LessThan": (0, 1), "LessThanOrEqual": (0, 1), "GreaterThan": (1, 0), "GreaterThanOrEqual": (1, 0)}
#: What gives the same rows each time, as the intervals are read twice.
REPEATABLE = ("Aggregate", "Filter", "Generate", "Join", "LocalRelation", "LogicalRDD", "LogicalRelation", "Project", "Union")


def by_blocks(df: DataFrame) -> DataFrame:
    """df with its range joins made by blocks; df itself if it has none."""
    if not any(_name(n) == "Join" for n in _nodes(_plan(df))):
        return df
    plan = _rebuilt(df.sparkSession, df._jdf.queryExecution().optimizedPlan())
    return df if plan is None else _frame(df.sparkSession, plan)


def _frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _column(spark: SparkSession, e) -> Column:
    from pyspark.sql.classic.column import Column as Classic

    return Classic(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))


def _rebuilt(spark: SparkSession, plan):
    """The plan with its range joins replaced; None if it has none."""
    old = _seq(plan.children())
    new = [_rebuilt(spark, c) for c in old]
    changed = any(c is not None for c in new)
    if changed:
        plan = plan.withNewChildren(spark._jvm.PythonUtils.toSeq([o if n is None else n for o, n in zip(old, new, strict=True)]))
    if _name(plan) == "Join" and (found := _range(plan)):
        return _replaced(spark, plan, *found)
    return plan if changed else None


def _conjuncts(e) -> list:
    return [x for c in _seq(e.children()) for x in _conjuncts(c)] if _name(e) == "And" else [e]


def _range(join):
    """(is the point's side the left one, x, lo, hi) of a range join."""
    if _name(join.joinType()) not in ("Inner", "Cross") or not join.condition().isDefined():
        return None
    left = {a.exprId().id() for a in _seq(join.left().output())}
    side = lambda e: {r.exprId().id() in left for r in _refs(e)}
    ordered = []
    for e in _conjuncts(join.condition().get()):
        args = _seq(e.children())
        if len(args) != 2 or [side(a) for a in args] not in ([{True}, {False}], [{False}, {True}]):
            continue
        if _name(e) in ("EqualTo", "EqualNullSafe"):
            return None
        if _name(e) in ORDERED and all(a.dataType().simpleString() in WHOLE and a.deterministic() for a in args):
            ordered.append([args[i] for i in ORDERED[_name(e)]])
    for lo, x in ordered:
        for y, hi in ordered:
            if x.semanticEquals(y) and side(lo) == side(hi):
                intervals = join.right() if side(x) == {True} else join.left()
                if intervals.deterministic() and all(_name(n) in REPEATABLE for n in _nodes(intervals)):
                    return side(x) == {True}, x, lo, hi
    return None


def _replaced(spark: SparkSession, join, point_left: bool, x, lo, hi):
    own = f"_{uuid.uuid4().hex}"  # names that no column of the statement has
    col = lambda e: _column(spark, e)
    points, intervals = (_frame(spark, p) for p in ((join.left(), join.right()) if point_left else (join.right(), join.left())))
    intervals = intervals.select("*", col(lo).cast("bigint").alias(f"{own}lo"), col(hi).cast("bigint").alias(f"{own}hi"))
    intervals = intervals.select("*", F.explode(_cover(f"{own}lo", f"{own}hi")).alias(f"{own}block"))
    sizes = intervals.select(F.col(f"{own}block.k").alias(f"{own}k")).distinct()  # 64 at most
    points = points.select("*", col(x).cast("bigint").alias(f"{own}x")).crossJoin(F.broadcast(sizes))
    met = (F.col(f"{own}k") == F.col(f"{own}block.k")) & (F.expr(f"shiftright({own}x, {own}k)") == F.col(f"{own}block.n"))
    both = intervals.join(points, met & col(join.condition().get()))  # of what is read twice, the left one keeps its attributes
    return both.select(*[col(a) for a in _seq(join.output())])._jdf.queryExecution().analyzed()


def _cover(lo: str, hi: str) -> Column:
    """The aligned blocks (k, n), whole numbers from n * 2^k on, that make up lo to hi; none if hi is less or either is null."""
    most = f"least(63, coalesce(length(bin(try_subtract({hi}, {lo}))), 63))"
    ends = f"""transform(sequence(0, {most}), k -> named_struct('k', k,
        'l', shiftright({lo}, k) + IF(shiftleft(shiftright({lo}, k), k) = {lo}, 0L, 1L),
        'r', shiftright({hi}, k) - IF(shiftleft(shiftright(~{hi}, k), k) = ~{hi}, 0L, 1L)))"""
    blocks = """array_compact(array(IF((e.l & 1L) = 1L, named_struct('k', e.k, 'n', e.l), NULL), IF((e.r & 1L) = 0L, named_struct('k', e.k, 'n', e.r), NULL)))"""
    return F.expr(f"flatten(transform(filter({ends}, e -> e.l <= e.r), e -> {blocks}))")
