"""Binary payloads against an encoder written field by field."""

import random

import pytest
from pyspark.sql import types as T

from loomgraph.schemas import PAYLOADS
from loomgraph.sources import wire


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(k, value):
    if isinstance(value, bool | int):
        return varint(k << 3) + varint(int(value))
    raw = value if isinstance(value, bytes) else value.encode()
    return varint(k << 3 | 2) + varint(len(raw)) + raw


def encoded(schema, row):
    out = []
    for k, (f, v) in enumerate(zip(schema.fields, row, strict=True), 1):
        if isinstance(f.dataType, T.MapType):
            out += [field(k, field(1, a) + field(2, b)) for a, b in v.items()]
        elif isinstance(f.dataType, T.ArrayType):
            out += [field(k, x) for x in v]
        elif v not in ("", 0, False):
            out.append(field(k, v))
    return out


def value_of(rng, kind):
    text = lambda: "".join(rng.choice("abcé😀 /") for _ in range(rng.choice([0, 1, 5, 200])))
    if isinstance(kind, T.MapType):
        return {text() + str(i): text() for i in range(rng.randrange(4))}
    if isinstance(kind, T.ArrayType):
        return [text() for _ in range(rng.randrange(4))]
    return text() if isinstance(kind, T.StringType) else rng.random() < 0.5 if isinstance(kind, T.BooleanType) else rng.choice([0, 1, 127, 128, 300, 2**32, 2**63 - 1, -1])


@pytest.mark.parametrize("kind", sorted(PAYLOADS))
def test_every_message_comes_back(spark, kind):
    schema, rng = PAYLOADS[kind], random.Random(kind)
    rows, sent = {}, []
    for i in range(40):
        rows[i] = tuple(value_of(rng, f.dataType) for f in schema.fields)
        parts = encoded(schema, rows[i])
        extra = [field(99, "unknown"), field(77, 5), varint(50 << 3 | 5) + b"abcd", varint(51 << 3 | 1) + b"abcdefgh"]
        parts = [*extra[:2], *parts, *extra[2:]] if i % 3 == 0 else parts
        rng.shuffle(parts) if not any(isinstance(f.dataType, T.ArrayType) for f in schema.fields) else None
        sent.append((i, kind, b"".join(parts)))
    good, bad = wire.decode(spark.createDataFrame([*sent, (99, "other", b"\xff")], "n int, type string, payload binary"), kind)
    names = [f"payload_{c}" if c == "type" else c for c in schema.names]
    assert {r["n"]: tuple(r[c] for c in names) for r in good.collect()} == rows
    assert bad.count() == 0


def test_broken_messages_are_kept_apart(spark):
    whole = field(1, "path") + field(2, "app") + field(3, 7)
    broken = [whole[:-1], whole[:3], b"\x0a", b"\x80" * 11, b"\x0b", field(1, 5), field(3, "x"), field(1, b"\xff\xfe"), b"\x00\x01", b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\x7f"]
    rows = [(i, "file.opened", x) for i, x in enumerate([*broken, whole, b"", None, whole + field(1, "later")])]
    good, bad = wire.decode(spark.createDataFrame(rows, "n int, type string, payload binary"), "file.opened")
    k = len(broken)
    assert sorted(r["n"] for r in bad.collect()) == list(range(k))
    assert sorted((r["n"], r["path"], r["app_id"], r["flags"]) for r in good.collect()) == [(k, "path", "app", 7), (k + 1, "", "", 0), (k + 2, "", "", 0), (k + 3, "later", "app", 7)]
    twice = field(4, field(1, "k") + field(2, "a")) + field(4, field(1, "k") + field(2, "b")) + field(4, b"")
    good, bad = wire.decode(spark.createDataFrame([(1, "app.action", twice), (2, "app.action", field(4, b"\x0a\x09x"))], "n int, type string, payload binary"), "app.action")
    assert good.first()["metadata"] == {"k": "b", "": ""} and [r["n"] for r in bad.collect()] == [2]


def test_a_long_message_beside_short_ones(spark):
    long = b"".join(field(5, f"app{i}") for i in range(3000))
    good, bad = wire.decode(spark.createDataFrame([(0, "focus.activated", long), *[(i, "focus.activated", field(5, "x")) for i in range(1, 50)]], "n int, type string, payload binary"), "focus.activated")
    assert {r["n"]: len(r["suppress_notifications_from"]) for r in good.collect()} == {0: 3000} | dict.fromkeys(range(1, 50), 1)
    assert bad.count() == 0
