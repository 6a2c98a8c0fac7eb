"""Keyed state over streams: day changes of a key, amount changes of a record.

A row goes out when the watermark has passed it, so none that comes later can stand before it: the
results depend on event time alone, not on the order of arrival or on how rows fall into batches. A row
leaves in the batch that moves the watermark over it, which is when windows downstream
still take it.
"""

import datetime as dt
import pickle
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.columns import day
from millrace.sources.logs import LATENESS

# The processor travels to the workers with its code, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

def _rank(row, order):
    """The row's place in the order; a missing value comes first, as it does in the table form."""
    return tuple((row[c] is not None, row[c]) for c in order)


def _with_ranks(df: DataFrame, order) -> tuple[DataFrame, list[str]]:
    """The rows, and columns that rank them like ``order``: numbers for its times, which reach Python in different
    forms from rows and from state."""
    times = {c: f"_rank_{c}" for c in order if isinstance(df.schema[c].dataType, T.TimestampType)}
    return df.withColumns({name: F.unix_micros(c) for c, name in times.items()}), [times.get(c, c) for c in order]


# Fixed value: the groups that keys are dealt out to. The engine is called, and keeps one value, per group and not per key;
# a checkpoint holds on to the number.
BUCKETS = 512


def _bucket(key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS))


def _places(names, columns) -> list[int]:
    return [list(names).index(c) for c in columns]


def _key_of(shape: T.StructType, key):
    """A function that names a row's key; a key that cannot be looked up as it is goes by its bytes."""
    at = _places(shape.names, key)
    plain = not any(isinstance(shape[c].dataType, (T.ArrayType, T.BinaryType, T.StructType)) for c in key)

    def name(row):
        values = tuple(row[i] for i in at)
        return values if plain else pickle.dumps(values)

    return name


def _timer(us: int) -> int:
    """The timer, in milliseconds, that goes off in the first batch whose watermark has reached a time.

    From then on rows of that time count as late, so what is known of it is final; one batch later
    they would be late for windows downstream too.
    """
    return -(-us // 1000) - 1


BLOB = T.StructType([T.StructField("blob", T.BinaryType())])


class _Held(StatefulProcessor):
    """A processor that keeps what it holds for a key in one value: a call of the engine's state costs more than a small value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", BLOB)

    def _load(self):
        value = self.state.get()
        return pickle.loads(bytes(value[0])) if value else None

    def _store(self, held) -> None:
        self.state.update((pickle.dumps(held),))

    def close(self) -> None:
        pass


class DayChanges(_Held):
    """Emits a key's first row of each day by event time, with the day the key was seen before.

    The first row known of each day waits in state until the watermark has passed it. Then
    no earlier row can come, of this day or of the days before, so both the row and the
    day before it are final. Days leave in order, and a row of the last day out or before it is none.
    The keys of a bucket are held together, under one timer for the first of the rows that wait.
    """

    def __init__(self, shape: T.StructType, key, order, columns, keep_ms=None):
        self.key_of, self.order, self.columns = _key_of(shape, key), _places(shape.names, order), list(columns)
        self.day, self.us = _places(shape.names, ["day", "_us"])
        self.out = _places(shape.names, columns)
        self.keep_us = None if keep_ms is None else keep_ms * 1000

    def _forgotten(self, last, us: int) -> bool:
        """The key was forgotten before this time."""
        return self.keep_us is not None and us > last[1] + self.keep_us

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, keys = self._load() or (None, {})
        least = None
        for row in rows:
            name, day, us = self.key_of(row), row[self.day], row[self.us]
            last, waiting = keys.get(name) or (None, {})
            if last is not None and day <= last[0] and not self._forgotten(last, us):
                continue
            if day in waiting and _rank(waiting[day], self.order) <= _rank(row, self.order):
                continue
            waiting[day] = tuple(row)
            keys[name] = (last, waiting)
            least = us if least is None else min(least, us)
        if least is not None:
            if due is None or _timer(least) < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = _timer(least)
                self.handle.registerTimer(due)
            self._store((due, keys))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._load()
        if held is None:
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        named, kept, next_us = Row(*self.columns, "last_day"), {}, None
        for name, (last, waiting) in held[1].items():
            ready = sorted((r for r in waiting.values() if r[self.us] <= passed), key=lambda r: _rank(r, self.order))
            for row in ready:
                del waiting[row[self.day]]
                if last is not None and self._forgotten(last, row[self.us]):
                    last = None
                if last is None or row[self.day] > last[0]:
                    yield named(*[row[i] for i in self.out], last[0] if last is not None else None)
                    last = (row[self.day], row[self.us])
            if not waiting and last is not None and self._forgotten(last, passed):
                continue
            kept[name] = (last, waiting)
            times = [r[self.us] for r in waiting.values()]
            if not times and self.keep_us is not None:
                times = [last[1] + self.keep_us + 2000]
            if times:
                next_us = min(times) if next_us is None else min(next_us, *times)
        if not kept:
            self.state.clear()
            return
        due = None
        if next_us is not None:
            due = max(_timer(next_us), expiredTimerInfo.getExpiryTimeInMs() + 1)
            self.handle.registerTimer(due)
        self._store((due, kept))


def _first_per_chunk(keys, order):
    """The first row per key of each batch. Values stay Arrow's own, so large integers and nulls keep their worth."""
    def keep(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            rows = pa.Table.from_batches([chunk])
            rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in order], null_placement="at_start"))
            numbered = rows.select(keys).append_column("_at", pa.array(range(rows.num_rows), pa.int64()))
            first = numbered.group_by(keys, use_threads=False).aggregate([("_at", "min")])["_at_min"]
            yield from rows.take(first).to_batches()

    return keep


def stream_day_changes(rows: DataFrame, key, order=("et",), keep=(), period=None,
                       lateness: str = LATENESS, keep_ms: int | None = None) -> DataFrame:
    """The streaming twin of ``operators.flags.day_changes``; windows over its rows may follow in the same stream.

    ``rows`` is a stream with event time ``et`` and no watermark yet, ``order`` starts with ``et``.
    ``period`` replaces the calendar day, for example by a constant for first-ever events; it must
    not fall as time goes on. ``keep_ms`` forgets a key that long, in event time, after its last
    first row; its next event then counts as a first one. Without it every key is remembered. Keys are
    dealt out to ``BUCKETS`` groups, whose state a batch with rows of them reads and writes as one value. Each
    task first keeps only the first row per key and day of every Arrow batch, so a key with very many rows
    sends few of them to its state. Rows later than ``lateness`` are left out.
    """
    order, key = list(order), list(key)
    kept = [*key, "day", *order, *[c for c in keep if c not in order]]
    timed = rows.where(F.col("et").isNotNull()).withColumn("day", day("et") if period is None else period).select(*kept)
    firsts = timed.mapInArrow(_first_per_chunk([*key, "day"], order), timed.schema)
    marked, ranks = _with_ranks(firsts.withWatermark("et", lateness).withColumns(
        {"_us": F.unix_micros("et"), "_bucket": _bucket(key)}), order)
    shape = T.StructType(timed.schema.fields + [T.StructField("last_day", T.StringType())])
    return marked.groupBy("_bucket").transformWithState(
        DayChanges(marked.schema, key, ranks, kept, keep_ms), shape, "append", "eventTime", eventTimeColumnName="et")


def stream_first_seen(rows: DataFrame, key, order=("et",), keep=(), lateness: str = LATENESS,
                      keep_ms: int | None = None) -> DataFrame:
    """The first event ever of each key, or the first within ``keep_ms``, such as the life of a session."""
    firsts = stream_day_changes(rows, key, order, keep, F.lit("ever"), lateness, keep_ms)
    return firsts.drop("day", "last_day")


# The groups that the keys of one part are dealt out to, and the rows of a task that are sorted into packs at once.
SLOTS = 32
PACK_ROWS = 100_000
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
PACK = T.StructType([T.StructField("_slot", T.LongType()), T.StructField("_part", T.LongType()),
                     T.StructField("et", T.TimestampType()), T.StructField("_body", T.BinaryType())])


def _time(us: int) -> dt.datetime:
    return EPOCH + dt.timedelta(microseconds=us)


def _counted(kind) -> bool:
    """Decimals that go as a number of their smallest units; a difference of two still fits."""
    return pa.types.is_decimal128(kind) and kind.precision <= 17


def _values(column) -> list:
    """A column's values as Python's own, times as microseconds and shorter decimals as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if _counted(column.type):
        column = pa.Array.from_buffers(pa.decimal128(38, 0), len(column), column.buffers(), offset=column.offset).cast(pa.int64())
    return (column.cast(pa.int64()) if pa.types.is_timestamp(column.type) else column).to_pylist()


def _array(values, kind):
    """The Arrow column of what :func:`_values` gave."""
    if _counted(kind):
        units = pa.array(values, pa.int64())
        if any(v is not None and abs(v) >= 10**kind.precision for v in (pc.min(units).as_py(), pc.max(units).as_py())):
            raise pa.ArrowInvalid(f"an amount has more digits than {kind}")
        return pa.Array.from_buffers(kind, len(units), units.cast(pa.decimal128(19, 0)).buffers())
    return pa.array(values, pa.int64()).cast(kind) if pa.types.is_timestamp(kind) else pa.array(values, kind)


def _squeezed(rows, *more) -> bytes:
    """Rows by column, and what belongs to them, as one compressed value for shuffles and state."""
    body = pickle.dumps((list(zip(*rows)), *more), 5)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _spread(body) -> tuple:
    """The rows of :func:`_squeezed`, and what came with them."""
    body = bytes(body)
    size = int.from_bytes(body[:8], "little")
    columns, *more = pickle.loads(pa.decompress(body[8:], size, "zstd", asbytes=True))
    return list(zip(*columns)), *more


def _packed(by, names):
    """Rows of the same ``by`` columns, the last of which is their time, as one value of the columns ``names``."""
    def pack(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for chunk in chunks:
            held.append(chunk)
            count += chunk.num_rows
            if count >= PACK_ROWS:
                yield from flush(held)
                held, count = [], 0
        if count:
            yield from flush(held)

    def flush(held):
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in by])).combine_chunks()
        ids = list(zip(*[_values(table[c]) for c in by]))
        tuples = list(zip(*[_values(table[c]) for c in names]))
        cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
        starts = cuts[:-1]
        bodies = [_squeezed(tuples[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [*[table[c].take(pa.array(starts, pa.int64())).combine_chunks() for c in by], pa.array(bodies, pa.binary())],
            names=[*by, "_body"])

    return pack


def _together(due: str):
    """What the parts of a task hand over, put together by bucket and lane: many parts of few rows make few large values."""
    def put(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, kind = {}, 0, None
        for chunk in chunks:
            kind = chunk.schema
            for bucket, lane, at, body in zip(*[chunk.column(c).to_pylist() for c in ("_bucket", "_lane", due, "_body")]):
                rows, pairs = pickle.loads(body)
                known = held.setdefault((bucket, lane), [at, [], []])
                known[0] = max(known[0], at)
                known[2] += [tuple(None if i is None else i + len(known[1]) for i in pair) for pair in pairs]
                known[1] += rows
                count += len(rows)
            if count >= PACK_ROWS:
                yield flush(held, kind)
                held, count = {}, 0
        if held:
            yield flush(held, kind)

    def flush(held, kind):
        names = list(held)
        columns = {"_bucket": [b for b, _ in names], "_lane": [lane for _, lane in names], due: [held[n][0] for n in names],
                   "_body": [_squeezed(*held[n][1:]) for n in names]}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kind], schema=kind)

    return put


def _unpacked(names):
    """The rows of packs, given the Arrow types of their columns by the schema of an empty batch."""
    def unpack(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks:
            for body in chunk.column("_body").to_pylist():
                arrays = [_array(values, t) for (_, t), values in zip(names, pickle.loads(body))]
                yield pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in names])

    return unpack


class _Changes(_Held):
    """What both steps of the amount changes know of their rows, which are tuples in packs."""

    def __init__(self, shape, key, order, amounts, columns, attributes, idle_us, first, width):
        self.key_of, self.order, self.amounts = _key_of(shape, key), _places(shape.names, order), set(_places(shape.names, amounts))
        self.columns, self.attributes, self.idle_us = _places(shape.names, columns), attributes, idle_us
        self.first, self.width = first, width
        self.us, self.bucket = _places(shape.names, ["et", "_bucket"])
        # What a later revision asks the one before it for.
        self.asked = sorted({self.us, *self.amounts, *(self.columns if attributes == "previous" else ())})
        self.width_of_row = len(shape.names)

    def _changed(self, row, before) -> tuple:
        """The values that go out for a revision, given the one before it."""
        if before is not None and self.idle_us is not None and row[self.us] > before[self.us] + self.idle_us:
            before = None
        source = before if before is not None and self.attributes == "previous" else row
        out = [source[i] if i not in self.amounts else row[i] if before is None else (row[i] or 0) - (before[i] or 0)
               for i in self.columns]
        return (*out, before is None) if self.first else tuple(out)


class PartChanges(_Changes):
    """Amount changes inside one part of the time of the keys of a slot.

    Revisions wait until the watermark has passed them and go out in order, each with its change
    against the one before. The first of a key in the part goes out as it is, as an edge. When the
    watermark has passed the part's end, the last revision of each key follows as the other edge, and the state is freed.
    One timer stands for all that waits. Packs, each of one time, wait as they came.
    """

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, last, waiting = self._load() or (None, {}, [])
        waiting += [(row["_us"], bytes(row["_body"])) for row in rows]
        least = _timer(min(us for us, _ in waiting))
        if due is None or least < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(least)
            due = least
        self._store((due, last, waiting))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._load()
        if held is None:  # closed by another timer of this batch
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        _, last, waiting = held
        ready = [row for us, body in waiting if us <= passed for row in _spread(body)[0]]
        ready.sort(key=lambda r: _rank(r, self.order))
        later = [pack for pack in waiting if pack[0] > passed]
        end = (key[1] + 1) * self.width - 1
        inside, edges, opened = {}, {}, {}
        for row in ready:
            name = self.key_of(row)
            before = last.get(name)
            if before is None:
                opened[name] = [row, None]
                edges.setdefault(row[self.bucket], []).append(opened[name])
            else:
                inside.setdefault(row[self.bucket], []).append(self._changed(row, before))
            last[name] = row
        closed = not later and end <= passed
        if closed:
            for name, row in last.items():
                if name in opened:
                    opened[name][1] = row
                else:
                    edges.setdefault(row[self.bucket], []).append([None, row])
        at = max((row[self.us] for row in ready), default=end)
        out = Row("_bucket", "_lane", "_due", "_body")
        for bucket, rows in inside.items():
            yield out(bucket, key[1], _time(at), pickle.dumps((rows, []), 5))
        for bucket, entries in edges.items():
            rows, pairs = [], []
            for opening, closing in entries:
                pairs.append((None if opening is None else len(rows),
                              None if closing is None else len(rows) + (opening is not None and closing is not opening)))
                rows += [row for row in (opening, closing if closing is not opening else None) if row is not None]
            yield out(bucket, None, _time(at), pickle.dumps((rows, pairs), 5))
        if closed:
            self.state.clear()
        else:
            due = max(_timer(min((us for us, _ in later), default=end)), expiredTimerInfo.getExpiryTimeInMs() + 1)
            self.handle.registerTimer(due)
            self._store((due, last, later))


class PartsOfKey(_Changes):
    """Joins the parts of the keys of a bucket: an opening revision gets its change against the closing one of the part before.

    Rows inside parts pass; they come under groups of their own, spread by part. Of the last revision of a key only what the
    next one asks for is held, by column and compressed.
    """

    def _last(self) -> dict:
        value = self.state.get()
        if not value:
            return {}
        rows, names = _spread(value[0])
        return dict(zip(names, rows))

    def _hold(self, known: dict) -> None:
        self.state.update((_squeezed(known.values(), list(known)),))

    def _whole(self, held):
        """What is held of a revision, in the places of a row."""
        if held is None:
            return None
        row = [None] * self.width_of_row
        for i, value in zip(self.asked, held):
            row[i] = value
        return row

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        edges, out = [], Row("et", "_body")
        for row in rows:
            revisions, pairs = _spread(row["_body"])
            if not pairs:
                yield out(row["_due"], pickle.dumps(list(zip(*revisions)), 5))
            edges += [tuple(None if i is None else revisions[i] for i in pair) for pair in pairs]
        if not edges:
            return
        known = self._last()
        edges.sort(key=lambda e: _rank(e[0] or e[1], self.order))
        done, at = [], None
        for opening, closing in edges:
            name = self.key_of(opening or closing)
            if opening is not None:
                done.append(self._changed(opening, self._whole(known.get(name))))
                at = opening[self.us] if at is None else max(at, opening[self.us])
            if closing is not None:
                known[name] = tuple(closing[i] for i in self.asked)
        for i in range(0, len(done), PACK_ROWS):
            yield out(_time(at), pickle.dumps(list(zip(*done[i : i + PACK_ROWS])), 5))
        if self.idle_us is not None and known:
            self.handle.registerTimer(_timer(max(row[self.asked.index(self.us)] for row in known.values()) + self.idle_us) + 2)
        self._hold(self._alive(known, timerValues))

    def _alive(self, known, timerValues) -> dict:
        """Without the keys that were idle for longer than they are remembered."""
        if self.idle_us is None:
            return known
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        at = self.asked.index(self.us)
        return {name: row for name, row in known.items() if row[at] + self.idle_us >= passed}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self._alive(self._last(), timerValues)
        if known:
            self._hold(known)
        else:
            self.state.clear()
        return iter(())


def stream_deltas(rows: DataFrame, key, order, amounts, attributes: str = "current", idle_s: int | None = None,
                  first: str | None = None, lateness: str = LATENESS, part_s: int = 3600) -> DataFrame:
    """The streaming twin of ``operators.deltas.deltas``, with the keyed state of the engine.

    ``rows`` is a stream of flat columns with event time ``et`` and no watermark yet; ``order`` starts with a
    column that never falls as ``et`` rises. Changes come out when the watermark has passed them; a revision
    that is late beyond it is left out. With the attributes of the current revision windows may follow in the
    same stream. A change with those of the revision before carries that one's time, which the
    watermark has long passed: it goes to a topic, for a job with a longer lateness.

    A key's time is cut into parts of ``part_s`` seconds. Only the first and last revision of a key in a part meet
    those of other parts; so neither a hot key nor a backlog of it lies in one task. State is held by part and slot of
    keys, then by bucket of keys, and rows go through it in packs of one part, slot and time, by column and compressed: the calls
    of the engine grow with these and not with the rows. What parts hand on is put together by bucket first. With ``idle_s`` a key is forgotten after that much event time.
    """
    width = part_s * 1_000_000
    bucket = _bucket(key)
    timed = rows.where(F.col("et").isNotNull()).withColumns({
        "_bucket": bucket, "_slot": F.pmod(bucket, F.lit(SLOTS)), "_part": F.floor(F.unix_micros("et") / width)})
    idle_us = idle_s * 1_000_000 if idle_s is not None else None
    held = timed.drop("_slot", "_part").schema
    packs = timed.repartition("_slot", "_part").mapInArrow(_packed(["_slot", "_part", "et"], held.names), PACK)
    marked = packs.withColumn("_us", F.unix_micros("et")).withWatermark("et", lateness)
    handed = T.StructType([T.StructField("_bucket", T.LongType()), T.StructField("_lane", T.LongType()),
                           T.StructField("_due", T.TimestampType()), T.StructField("_body", T.BinaryType())])
    settings = (held, key, order, amounts, rows.columns, attributes, idle_us, first, width)
    parts = marked.groupBy("_slot", "_part").transformWithState(
        PartChanges(*settings), handed, "append", "eventTime", eventTimeColumnName="_due")
    done = T.StructType([T.StructField("et", T.TimestampType()), T.StructField("_body", T.BinaryType())])
    chained = {"eventTimeColumnName": "et"} if attributes == "current" else {}
    due = T.StructType([*handed.fields[:2], T.StructField("_due", T.TimestampType(), True, parts.schema["_due"].metadata), handed.fields[3]])
    parts = parts.mapInArrow(_together("_due"), due)
    joined = parts.groupBy("_bucket", "_lane").transformWithState(PartsOfKey(*settings), done, "append", "eventTime", **chained)
    fields = [T.StructField(f.name, f.dataType, True, joined.schema["et"].metadata if f.name == "et" else None)
              for f in rows.schema.fields]
    out = T.StructType(fields + ([T.StructField(first, T.BooleanType())] if first else []))
    arrow = to_arrow_schema(out)
    return joined.select("_body").mapInArrow(_unpacked([(f.name, f.type) for f in arrow]), out)


class FirstVisits(_Held):
    """Keeps the first record of each device of a bucket and tells, for every batch a device is in, what it is by then."""

    def __init__(self, order, shape: T.StructType):
        self.order, self.names = _places(shape.names, order), list(shape.names)

    def _taken(self, held: dict, rows) -> list:
        """The devices of the rows, whose first records are taken over; a device counts by its first column."""
        met = {}
        for row in rows:
            values = tuple(row[c] for c in self.names)
            known = held.get(values[0])
            if known is None or _rank(values, self.order) < _rank(known, self.order):
                held[values[0]] = values
                met[values[0]] = True
            else:
                met.setdefault(values[0], False)
        if any(met.values()):
            self._store(held)
        return list(met)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._taken(self._load() or {}, initialState["_firsts"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held, out = self._load() or {}, Row(*self.names)
        for mid in self._taken(held, rows):
            yield out(*held[mid])


def stream_first_visits(log: DataFrame, order=("ts",), seen: DataFrame | None = None) -> DataFrame:
    """The first record of each device of a batch among all so far: ``mid``, the ``order`` columns and ``is_new``.

    ``log`` is a stream of records, ``seen`` a table of first visits (see ``operators.logs.first_visits``) that the
    engine's state begins with. Of each Arrow batch only the first record per device reaches the
    state, so a device with very many records sends few. Devices are dealt out to ``BUCKETS`` groups.
    """
    order = [*order, "is_new"]
    rows = log.where(F.col("common.mid").isNotNull()).select(
        F.col("common.mid").alias("mid"), *order[:-1], F.col("common.is_new").alias("is_new"))
    firsts, ranks = _with_ranks(rows.mapInArrow(_first_per_chunk(["mid"], order), rows.schema), order)
    shape, bucket = firsts.schema, _bucket(["mid"]).alias("_bucket")
    begun = None
    if seen is not None:  # one row per bucket, as each is taken into the bucket's value
        known = _with_ranks(seen.select("mid", "first.*"), order)[0].where(F.col("mid").isNotNull())
        begun = known.groupBy(bucket).agg(F.collect_list(F.struct(*shape.names)).alias("_firsts")).groupBy("_bucket")
    return firsts.select(bucket, "*").groupBy("_bucket").transformWithState(
        FirstVisits(ranks, shape), shape, "append", "none", begun).select(*rows.columns)


def stream_distinct(rows: DataFrame, keys, spread_by, parts: int | None = None) -> DataFrame:
    """One row per key, kept in native state.

    Repeats are first dropped in ``parts`` parts of each key, cut by the columns ``spread_by``, so the
    rows of a hot key go to many tasks; by default there are as many as shuffle partitions. With a window among the keys the state is freed by the
    watermark.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*spread_by), F.lit(parts))
    inside = rows.withColumn("_part", part).dropDuplicates([*keys, "_part"])
    return inside.select(*keys).dropDuplicates(list(keys))
