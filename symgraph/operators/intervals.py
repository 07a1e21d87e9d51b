"""Interval and as-of joins within a key.

Both range-partition the rows of all keys by key and place, so a hot key is cut
into as many tasks as its rows need. Each task works through its own stretch in
order, and tells what later stretches must know of it in one row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut

#: Places of a block of :func:`next_at_most`.
BLOCK = 256
#: Tasks of a range partitioning are numbered below two to this power.
TASK_BITS = 20
#: Events that a task of :func:`enclosing` holds, about; larger inputs have more tasks.
TASK_EVENTS = 200_000


def _open(field: T.StructField, name: str | None = None) -> T.StructField:
    return T.StructField(name or field.name, field.dataType, True)


def _begins(keys: list[pa.Array], before: list[pa.Scalar] | None) -> np.ndarray:
    """For sorted rows, true where a key begins; ``before`` is the key of the row before the first."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    out[0] = before is None or any(k[0] != b and (k[0].is_valid or b.is_valid) for k, b in zip(keys, before, strict=True))
    for k in keys:
        a, b = k.slice(1), k.slice(0, n - 1)
        none = lambda x: x.is_null().to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (none(a) & none(b))
        out[1:] |= ~same
    return out


def covering_blocks(first: Column, end: Column) -> Column:
    """The tasks from ``first`` to before ``end`` as blocks (level, place) of 2^level tasks, at most two of a level."""

    def step(acc: Column, level: Column) -> Column:
        lo, hi, out = acc["lo"], acc["hi"], acc["out"]
        block = lambda place: F.array(F.struct(level.cast("int").alias("level"), place.cast("int").alias("place")))
        none = F.array().cast("array<struct<level:int,place:int>>")
        left = (lo < hi) & (lo % 2 == 1)
        next_lo = F.when(left, lo + 1).otherwise(lo)
        right = (next_lo < hi) & (hi % 2 == 1)
        next_hi = F.when(right, hi - 1).otherwise(hi)
        told = F.concat(out, F.when(left, block(lo)).otherwise(none), F.when(right, block(hi - 1)).otherwise(none))
        return F.struct(F.shiftright(next_lo, 1).alias("lo"), F.shiftright(next_hi, 1).alias("hi"), told.alias("out"))

    none = F.array().cast("array<struct<level:int,place:int>>")
    start = F.struct(first.cast("int").alias("lo"), end.cast("int").alias("hi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(TASK_BITS)), start, step, lambda acc: acc["out"])


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, value: str, out: str) -> DataFrame:
    """``points`` with the ``value`` of the innermost span around each one, null outside all.

    The innermost span is the one that starts last; of those that start at one
    place, the one of the greatest value that reaches the point. Spans without
    a start or an end, or that end before they start, hold nothing. Points
    without a key or place lie in no span.

    A span is two events, a place is one, and a task sweeps its events in order
    with a stack of open spans. A span that starts later and ends no earlier
    than another hides it for good, so every span is pushed and popped once,
    however many overlap. A span that began in an earlier task and ends in this
    one is open from the task's first event on. What is left are spans that
    reach over whole tasks: of those a task needs only the one that starts last.
    Each is noted for the few blocks of 1, 2, 4, ... tasks that it fills, so
    there are at most two notes for a task.
    """
    asked = points.where(F.col(at).isNotNull()).select(*keys, at).distinct()
    sane = spans.where(F.col(start) <= F.col(end)).groupBy(*keys, F.col(start).cast("long").alias("__start"), F.col(end).cast("long").alias("__end"))
    held = cut(sane.agg(F.max(value).alias("__value")).withColumn("__id", F.monotonically_increasing_id()), "spans")
    told = ["__start", "__end", "__value", "__id"]
    events = [held.select(*keys, F.col(c).alias("__at"), F.lit(k).alias("__kind"), *told) for c, k in (("__start", 0), ("__end", 2))]
    nothing = [F.lit(None).cast(held.schema[c].dataType).alias(c) for c in told]
    # At one place spans begin before points and end after them; those that begin there come by value.
    order = [*keys, "__at", "__kind", "__value", "__id"]
    asked = cut(asked, "points")
    n_events = 2 * held.count() + asked.count()
    events.append(asked.select(*keys, F.col(at).cast("long").alias("__at"), F.lit(1).alias("__kind"), *nothing))
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_events // TASK_EVENTS))
    laid = events[0].unionByName(events[1]).unionByName(events[2]).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    fields = [_open(held.schema[k]) for k in keys] + [T.StructField("__at", T.LongType()), T.StructField("__kind", T.IntegerType()), T.StructField("__task", T.IntegerType())]
    fields += [T.StructField("__id", T.LongType()), T.StructField("__start", T.LongType()), _open(held.schema["__value"])]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        # The whole stretch of one task; the number of tasks bounds it.
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda c: table.column(c).chunk(0)
        kinds, places = column("__kind").to_numpy(), column("__at").to_numpy()
        ids, ends = (pc.fill_null(column(c), -1).to_numpy() for c in ("__id", "__end"))
        foreign = (kinds == 2) & ~np.isin(ids, ids[kinds == 0])
        going = (kinds == 0) & ~np.isin(ids, ids[kinds == 2])
        answer = np.full(len(kinds), -1, np.int64)
        kind_list, place_list, end_list = kinds.tolist(), places.tolist(), ends.tolist()
        bounds = [*np.flatnonzero(_begins([column(k) for k in keys], None)).tolist(), len(kinds)]
        for low, high in itertools.pairwise(bounds):
            stack: list[int] = []
            earlier = np.flatnonzero(foreign[low:high]) + low
            if len(earlier):
                by_start = pc.sort_indices(table.select(["__start", "__value"]).take(pa.array(earlier)), sort_keys=[("__start", "ascending"), ("__value", "ascending")])
                earlier = earlier[by_start.to_numpy()]
            for k in earlier.tolist():
                while stack and end_list[stack[-1]] <= end_list[k]:
                    stack.pop()
                stack.append(k)
            for k in range(low, high):
                if kind_list[k] == 0:
                    while stack and end_list[stack[-1]] <= end_list[k]:
                        stack.pop()
                    stack.append(k)
                elif kind_list[k] == 1:
                    while stack and end_list[stack[-1]] < place_list[k]:
                        stack.pop()
                    answer[k] = stack[-1] if stack else -1
        told = np.flatnonzero((kinds == 1) | going | foreign)
        source = np.where(kinds[told] == 1, answer[told], told)
        source = pa.array(source, pa.int64(), mask=source < 0)
        rows = pa.array(told)
        arrays = [column(k).take(rows) for k in keys] + [column("__at").take(rows), column("__kind").take(rows), pa.array(np.full(len(told), _task(), np.int32))]
        arrays += [column("__id").take(rows), column("__start").take(source), column("__value").take(source)]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    swept = cut(laid.mapInArrow(sweep, T.StructType(fields)), "swept")
    innermost = F.when(F.col("__start").isNotNull(), F.struct("__start", "__value"))
    found = swept.where("__kind = 1").select(*keys, "__at", "__task", innermost.alias("__best"))
    if (swept.agg(F.max("__task")).first()[0] or 0) >= 2:
        begun = swept.where("__kind = 0").select("__id", F.col("__task").alias("a"), F.struct("__start", "__value").alias("__over"))
        ended = swept.where("__kind = 2").select("__id", F.col("__task").alias("b"))
        whole = begun.join(ended, "__id").where("b - a >= 2").select("__over", F.explode(covering_blocks(F.col("a") + 1, F.col("b"))).alias("p"))
        notes = whole.groupBy("p").agg(F.max("__over").alias("__over"))
        tasks = swept.select("__task").distinct().select("__task", F.explode(F.sequence(F.lit(0), F.lit(TASK_BITS))).alias("level"))
        tasks = tasks.select("__task", F.struct("level", F.expr("shiftright(__task, level)").alias("place")).alias("p"))
        over = tasks.join(notes, "p").groupBy("__task").agg(F.max("__over").alias("__over"))  # one row for a task
        found = found.join(F.broadcast(over), "__task", "left").withColumn("__best", F.greatest("__best", "__over"))
    place = F.col("__at").cast(points.schema[at].dataType)
    return points.join(found.select(*keys, place.alias(at), F.col("__best.__value").alias(out)), [*keys, at], "left")


def _task() -> int:
    return TaskContext.get().partitionId()


def nearest_before(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """``rows`` with the ``value`` of the last mark strictly before each one, null if there is none.

    Of marks at one place the one of the greatest value counts. Null keys are
    a key, and null places come before all others. Both sides together are
    range-partitioned by key, place and content, each task carries the last
    mark along its own stretch, and rows before the first mark of a stretch
    take the last mark of the stretches before it, if that is of their key.
    """
    mine = [c for c in rows.columns if c not in (*keys, at)]
    given = F.struct(F.lit(0).alias("__none"), *mine)
    kind = marks.schema[value].dataType
    left = rows.select(*keys, at, F.lit(0).alias("__side"), given.alias("__row"), F.lit(None).cast(kind).alias("__value"))
    right = marks.select(*keys, F.col(at).cast(left.schema[at].dataType).alias(at), F.lit(1).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    # At equal places rows come before marks, so a mark never binds to its own place; equal rows are told apart by where they stand in the input.
    both = left.unionByName(right).withColumns({"__hash": F.xxhash64("__row"), "__tie": F.monotonically_increasing_id()})
    order = [*keys, at, "__side", "__value", "__hash", "__tie"]
    laid = both.repartitionByRange(*order).sortWithinPartitions(*order).select(*keys, at, "__side", "__row", "__value")
    fields = [*[_open(laid.schema[c]) for c in (*keys, at, "__row", "__value")], *[T.StructField(c, t) for c, t in (("__task", T.IntegerType()), ("__open", T.BooleanType()), ("__mark", T.BooleanType()))]]
    names = [f.name for f in fields]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, last, last_key, first_key = None, None, None, True
        task, kinds = 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            task, columns, values = _task(), [batch.column(k) for k in keys], batch.column("__value")
            kinds = {c: batch.column(c).type for c in batch.schema.names}
            new = _begins(columns, before)
            first = before is None
            group = np.cumsum(new) - int(new[0])
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            side = batch.column("__side").to_numpy()
            mark = np.maximum.accumulate(np.where(side == 1, np.arange(n), -1))
            carried = (group == 0) & (not new[0]) & (last is not None)
            place = np.where(mark >= starts, mark + 1, np.where(carried, 0, -1))
            held = last if last is not None else pa.nulls(1, values.type)
            filled = pa.concat_arrays([held, values]).take(pa.array(place, pa.int64(), mask=place < 0))
            lead = (group == 0) & (first or (first_key and not new[0]))
            told = np.flatnonzero(side == 0)
            rows_ = pa.array(told)
            arrays = [c.take(rows_) for c in (*columns, batch.column(at), batch.column("__row"), filled)]
            arrays += [pa.array(np.full(len(told), task, np.int32)), pa.array((lead & (place < 0))[told]), pa.array(np.zeros(len(told), bool))]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            first_key = (first or first_key and not new[0]) and int(group[-1]) == 0
            if mark[-1] >= starts[-1]:
                last = values.slice(int(mark[-1]), 1)
            elif int(group[-1]) or new[0] and not first:
                last = None
            before = [c[n - 1] for c in columns]
            if mark[-1] >= 0:
                last_key = [c.slice(int(mark[-1]), 1) for c in columns] + [values.slice(int(mark[-1]), 1)]
        if before is not None:
            key = last_key or [pa.nulls(1, kinds[k]) for k in (*keys, "__value")]
            arrays = [*key[:-1], pa.nulls(1, kinds[at]), pa.nulls(1, kinds["__row"]), key[-1]]
            arrays += [pa.array([task], pa.int32()), pa.array([last_key is not None]), pa.array([True])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    filled = cut(laid.mapInArrow(carry, T.StructType(fields)), "as-of")
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # one row for a task
    handed = F.when(F.col("__open"), F.struct(*keys, "__value"))
    notes = filled.where("__mark").select("__task", F.last(handed, ignorenulls=True).over(before).alias("__in")).where("__in IS NOT NULL")
    both = filled.where("NOT __mark").join(F.broadcast(notes), "__task", "left")
    same = F.col("__open") & F.col("__in").isNotNull()
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col("__in")[k])
    found = F.when(same, F.col("__in")["__value"]).otherwise(F.col("__value"))
    return both.select(*keys, at, *[F.col("__row")[c].alias(c) for c in mine], found.alias(out))


def _first_later(asked: DataFrame, stops: DataFrame, keys: list[str], width: int, inclusive: bool) -> DataFrame:
    """(keys, __p, __l, __found): for each place and level, the first later place in ``stops`` (keys, __at, __level) of at most that level.

    Places are cut into blocks. A stop is sought in the place's own block, then
    in the first later block whose least level is low enough, which is the same
    question about blocks. So a place meets two blocks at each of a few depths.
    ``width`` is how far apart places can be.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    later = F.col("__at") >= F.col("__p") if inclusive else F.col("__at") > F.col("__p")
    known = [*keys, "__p", "__l"]
    if width <= BLOCK:
        return asked.join(stops, keys).where(later & (F.col("__level") <= F.col("__l"))).groupBy(*known).agg(F.min("__at").alias("__found"))
    laid, marks = asked.withColumn("__block", block("__p")), stops.withColumn("__block", block("__at"))
    near = laid.join(marks, [*keys, "__block"]).where(later & (F.col("__level") <= F.col("__l"))).groupBy(*known).agg(F.min("__at").alias("__found"))
    blocks = marks.groupBy(*keys, F.col("__block").alias("__at")).agg(F.min("__level").alias("__level"))
    wanted = laid.join(near.select(*known), known, "left_anti")
    next_block = _first_later(wanted.select(*keys, F.col("__block").alias("__p"), "__l").distinct(), blocks, keys, width // BLOCK + 1, False)
    sent = wanted.join(next_block.withColumnRenamed("__p", "__block"), [*keys, "__block", "__l"]).select(*known, F.col("__found").alias("__block"))
    far = sent.join(marks, [*keys, "__block"]).where(F.col("__level") <= F.col("__l")).groupBy(*known).agg(F.min("__at").alias("__found"))
    return near.unionByName(far)


def next_at_most(items: DataFrame, stops: DataFrame, keys: list[str], at: str, level: str, out: str, inclusive: bool = False) -> DataFrame:
    """``items`` with the first later place in ``stops`` whose level is at most their own, null if there is none. Places are whole numbers."""
    # Both are read at every depth of blocks.
    asked = cut(items.select(*keys, F.col(at).alias("__p"), F.col(level).alias("__l")).distinct(), "asked")
    marks = cut(stops.groupBy(*keys, F.col(at).alias("__at")).agg(F.min(level).alias("__level")), "marks")
    least, most = marks.agg(F.min("__at"), F.max("__at")).first()
    width = int(most - least) + 1 if least is not None else 0
    found = _first_later(asked, marks, keys, width, inclusive)
    found = found.withColumnRenamed("__p", at).withColumnRenamed("__l", level).withColumnRenamed("__found", out)
    return items.join(found, [*keys, at, level], "left")
