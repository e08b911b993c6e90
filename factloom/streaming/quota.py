"""Anchored-window quota over a stream, in arrival order of the micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from factloom.schema import QUOTA_LIMIT, QUOTA_WINDOW_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets that keys are dealt to by hash: Python is called once for each, not once for each key.
BUCKETS = 2048
#: Bits of a row's ``missing``.
NO_KEY, NO_TIE, NO_TIME = 1, 2, 4
#: Rows of a bucket held at a time, about, and rows from which a key is walked before all of them are there.
HELD_ROWS, BUSY_ROWS = 1 << 18, 10_000


def _pieces(rows: Iterator) -> Iterator:
    """A bucket's rows with ``key``, a number per key.  A key's rows are in one piece, unless they are so many that holding them isn't
    safe; then in several of at least ``BUSY_ROWS``."""
    import numpy as np
    import pandas as pd

    kept, n, most = [], 0, HELD_ROWS

    def together():
        piece = pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
        return piece.assign(key=pd.factorize(piece["k"], use_na_sentinel=False)[0] * 2 + (piece["missing"] & NO_KEY))

    for batch in rows:
        kept.append(batch)
        n += len(batch)
        if n >= most:
            piece = together()
            busy = np.bincount(piece["key"])[piece["key"]] >= BUSY_ROWS
            if busy.any():
                yield piece[busy]
            kept = [piece[~busy]]
            n = len(kept[0])
            most = max(HELD_ROWS, 2 * n)
    if n:
        yield together()


class _OpenWindows(StatefulProcessor):
    """The open windows of a bucket's keys: of each its start and the events counted in it.  One timer, at
    the first end among them, clears those that are over."""

    def __init__(self, limit: int, window: int, key_type: str):
        self.limit, self.window, self.key_type = limit, window, key_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", f"k {self.key_type}", "start bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: N802, N803
        held = {tuple(k): (int(v[0]), int(v[1])) for k, v in self.open.iterator()}
        before, counted = self._first_end(held), set()
        for piece in _pieces(rows):
            yield self._walk(piece, held, counted)
        for k in counted:
            self.open.updateValue(k, held[k])
        self._set_timer(before, self._first_end(held))

    def _walk(self, piece, held: dict, counted: set):
        """Flags of the rows, each key's in time order; brings ``held`` forward."""
        import numpy as np
        import pandas as pd

        piece = piece.assign(no_tie=piece["missing"] & NO_TIE).sort_values(["key", "t", "no_tie", "tie"])
        missing = piece["missing"].to_numpy()
        untimed = missing & NO_TIME != 0
        starts, numbers, last, name, start, n = [], [], None, None, None, 0

        def keep():
            if start is not None:
                held[name] = start, n
                counted.add(name)

        for number, k, t, lacks in zip(*(piece[c].tolist() for c in ("key", "k", "t", "missing"))):
            if number != last:
                keep()
                name, last = (None if lacks & NO_KEY or k != k else k,), number
                start, n = held.get(name, (None, 0))
            if lacks & NO_TIME:
                starts.append(0)
                numbers.append(0)
                continue
            if start is None or t - start >= self.window:
                start, n = t, 0
            n += 1
            starts.append(start)
            numbers.append(n)
        keep()
        numbers = np.array(numbers, "int64")

        def as_came(column, bit):
            gone = missing & bit != 0
            return pd.arrays.IntegerArray(piece[column].to_numpy("int64"), gone) if gone.any() else piece[column].array

        return pd.DataFrame({
            "k": as_came("k", NO_KEY), "tie": as_came("tie", NO_TIE),
            "window_start": pd.arrays.IntegerArray(np.array(starts, "int64"), untimed),
            "n_in_window": pd.arrays.IntegerArray(numbers, untimed.copy()),
            "allowed": pd.arrays.BooleanArray(numbers <= self.limit, untimed.copy())})

    def _end(self, start: int) -> int:
        """Milliseconds when the window that begins at ``start`` is over."""
        return -(-(start + self.window) // 1000)

    def _first_end(self, held: dict) -> int | None:
        return min((self._end(start) for start, _ in held.values()), default=None)

    def _set_timer(self, before: int | None, after: int | None) -> None:
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        held = {tuple(k): (int(v[0]), int(v[1])) for k, v in self.open.iterator()}
        over = [k for k, (start, _) in held.items() if self._end(start) <= timerValues.getCurrentWatermarkInMs()]
        for k in over:
            self.open.removeKey(k)
            del held[k]
        self._set_timer(None, self._first_end(held))  # the one that went off is deleted by Spark
        return iter([])

    def close(self) -> None:
        pass


# pandas would make doubles of whole numbers when one is missing: it gets a value, and a bit says so
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _filled(column: Column, type_: str) -> Column:
    return F.coalesce(column, F.lit(0).cast(type_)) if type_ in _WHOLE else column


def _missing(column: Column, type_: str, bit: int) -> Column:
    return F.when(column.isNull(), bit).otherwise(0) if type_ in _WHOLE else F.lit(0)


def keyed_state(spark: SparkSession) -> SparkSession:
    """``spark`` set to keep streaming state where timers and typed state are supported."""
    spark.conf.set(_PROVIDER, _ROCKS)
    return spark


def quota_stream(stream: DataFrame, key: str, micros: Column, tie: str,
                 limit: int = QUOTA_LIMIT,
                 window_seconds: float = QUOTA_WINDOW_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Flag events as they come.  The state per key is its window start and count; it is cleared once
    the watermark, ``delay`` behind the latest event, has passed the window's end.

    Keys are dealt to ``BUCKETS`` buckets by hash.  Python is called once for each bucket of a
    micro-batch, reads the bucket's open windows at once and writes those of the keys that came.  A
    bucket's rows are held as they come, a quarter of a million of them or so; only a key that has
    more than an Arrow batch then is walked in pieces.

    A key's rows are walked in time order, a piece at a time; across pieces and micro-batches arrival
    decides, and an event older than the open window counts in it.  One that comes when its key's
    state is gone starts a window; none is dropped, however late.  Events without a time are
    flagged NULL; a NULL key is a key like others.  A key's rows of a micro-batch are one task's:
    bound the trigger.  Sets the session as ``keyed_state`` does.
    """
    keyed_state(stream.sparkSession)
    window = int(round(window_seconds * 1_000_000))
    types = dict(stream.dtypes)
    out = (f"k {types[key]}, tie {types[tie]}, window_start bigint, n_in_window bigint, "
           "allowed boolean")
    # the watermark's own column isn't handed on: rows behind it would be dropped
    timed = stream.withColumn("_ts", F.timestamp_micros(micros)).withWatermark("_ts", delay)
    k, tied = F.col(key), F.col(tie)
    missing = _missing(k, types[key], NO_KEY) + _missing(tied, types[tie], NO_TIE) + _missing(micros, "bigint", NO_TIME)
    dealt = timed.select(
        F.pmod(F.xxhash64(k), F.lit(BUCKETS)).alias("bucket"), _filled(k, types[key]).alias("k"), _filled(tied, types[tie]).alias("tie"),
        _filled(micros, "bigint").alias("t"), missing.alias("missing"))
    flagged = dealt.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_OpenWindows(limit, window, types[key]), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return flagged.withColumnsRenamed({"k": key, "tie": tie})
