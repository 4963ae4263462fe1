"""Binary payloads: protocol-buffer messages decoded a column at a time, over the bytes of a whole Arrow batch.

All rows of a batch are read side by side: in each step every row that is not at its end has one field read, its tag, its length or its
number taken from the batch's one buffer by array arithmetic. So the steps are as many as the longest message has fields, not rows.
Fields are numbered as they stand in `PAYLOADS`. Unknown fields are skipped; of a repeated single field the last counts; fields that
are not there are empty text, 0 or false. Messages that end within a field, have a number of more than ten bytes, a field of another
kind than declared, a group, or text that isn't UTF-8 can't be read. Null payloads are empty messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.schemas import PAYLOADS

VARINT, WIDE, BYTES, NARROW = 0, 1, 2, 5
PAIR = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def _varints(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers that begin at `at` and end before `end`, the places behind them, and whether they are whole."""
    value, place, todo, ok = np.zeros(len(at), np.uint64), at.copy(), np.ones(len(at), bool), np.zeros(len(at), bool)
    for k in range(10):
        todo &= place < end
        rows = np.flatnonzero(todo)
        if not len(rows):
            break
        b = data[place[rows]]
        value[rows] |= (b & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        place[rows] += 1
        last = b < 0x80
        ok[rows[last]] = True
        todo[rows[last]] = False
    return value, place, ok


def _slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The given pieces of the buffer as binary values."""
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _texts(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces as text, and whether each is UTF-8 (others are empty)."""
    raw = _slices(data, start, size)
    try:
        return raw.cast(pa.large_string()).cast(pa.string()), np.ones(len(raw), bool)
    except pa.ArrowInvalid:
        ok = np.array([_is_text(x) for x in raw.to_pylist()])
        return _texts(data, start, np.where(ok, size, 0))[0], ok


def _is_text(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


def columns_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, schema: T.StructType) -> tuple[list[pa.Array], np.ndarray]:
    """The fields of messages that lie at start to end of a buffer, and which messages could be read."""
    n, at, good = len(start), start.copy(), np.ones(len(start), bool)
    single = {k: (np.zeros(n, np.int64), np.zeros(n, np.int64)) for k, f in enumerate(schema.fields, 1) if isinstance(f.dataType, T.StringType)}
    numbers = {k: np.zeros(n, np.uint64) for k, f in enumerate(schema.fields, 1) if isinstance(f.dataType, T.LongType | T.BooleanType)}
    many: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {k: [] for k in range(1, len(schema) + 1) if k not in single and k not in numbers}
    rows = np.flatnonzero(at < end)
    while len(rows):
        tag, place, ok = _varints(data, at[rows], end[rows])
        field, kind = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(np.int64)
        ok &= field > 0
        value, after, whole = _varints(data, place, end[rows])
        length = np.minimum(value, np.uint64(1 << 62)).astype(np.int64)
        has = (kind == VARINT) | (kind == BYTES)
        after = np.select([kind == VARINT, kind == BYTES, kind == WIDE, kind == NARROW], [after, after + length, place + 8, place + 4], place)
        ok &= np.where(has, whole, (kind == WIDE) | (kind == NARROW)) & (after <= end[rows])
        known = (field >= 1) & (field <= len(schema))
        for k in np.unique(field[ok & known]).tolist():
            hit = ok & (field == k)
            ok &= ~hit | (kind == (VARINT if k in numbers else BYTES))
            hit &= ok
            if k in numbers:
                numbers[k][rows[hit]] = value[hit]
            elif k in single:
                single[k][0][rows[hit]], single[k][1][rows[hit]] = after[hit] - length[hit], length[hit]
            else:
                many[k].append((rows[hit], after[hit] - length[hit], length[hit]))
        good[rows[~ok]] = False
        at[rows] = np.where(ok, after, end[rows])
        rows = rows[at[rows] < end[rows]]
    out = []
    for k, f in enumerate(schema.fields, 1):
        if k in single:
            column, ok = _texts(data, *single[k])
            good &= ok
        elif k in numbers:
            column = pa.array(numbers[k] > 0) if isinstance(f.dataType, T.BooleanType) else pa.array(numbers[k].view(np.int64))
        else:
            column, ok = _repeated(data, many[k], n, isinstance(f.dataType, T.MapType))
            good &= ok
        out.append(column)
    return out, good


def _repeated(data: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, pairs: bool) -> tuple[pa.Array, np.ndarray]:
    """Lists of n rows of the texts, or maps of the pairs, that were met; of a key's values the last counts."""
    row, start, size = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(row, kind="stable")
    row, start, size = row[order], start[order], size[order]
    good = np.ones(n, bool)
    if not pairs:
        texts, ok = _texts(data, start, size)
        good[row[~ok]] = False
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), texts), good
    (keys, values), ok = columns_of(data, start, start + size, PAIR)
    good[row[~ok]] = False
    code = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(keys) else np.zeros(0, np.int64)
    last = {pair: i for i, pair in enumerate(zip(row.tolist(), code.tolist(), strict=True))}
    keep = np.array(sorted(last.values()), np.int64)
    offsets = np.searchsorted(row[keep] if len(keep) else keep, np.arange(n + 1)).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(offsets), keys.take(pa.array(keep)), values.take(pa.array(keep))), good


def decode(events: DataFrame, event_type: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Events of one type with the columns of their binary payload, and those whose payload can't be read; other columns of one name get the prefix payload_."""
    schema = PAYLOADS[event_type]
    fields = T.StructType([T.StructField(f"f{i}", f.dataType) for i, f in enumerate(schema.fields)])
    rest = [c for c in events.columns if c != payload]
    d = events.where(F.col("type") == event_type).select(F.struct(*rest).alias("row"), F.coalesce(F.col(payload), F.lit(b"")).alias("payload"))
    result = T.StructType([*d.schema.fields, T.StructField("ok", T.BooleanType()), *fields.fields])
    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("payload").cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
            columns, ok = columns_of(data, ends[:-1].copy(), ends[1:].copy(), schema)
            columns = [c.cast(k.type) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ok), *columns], [*b.schema.names, "ok", *fields.names])

    out = d.mapInArrow(run, result)
    clash = {c: f"payload_{c}" for c in schema.names if c in rest}
    names = [F.col(f"f{i}").alias(clash.get(c, c)) for i, c in enumerate(schema.names)]
    return out.where("ok").select("row.*", *names), out.where("not ok").select("row.*", F.col("payload").alias(payload))
