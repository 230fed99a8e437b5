"""Well-known binary against a reader of one geometry at a time."""

from __future__ import annotations

import math
import random
import struct

import pyarrow as pa

from floodlake.operators import wkb


def _write(shape, order="<", height=False, flag=False):
    """Bytes of ``(code, content)``."""
    code, content = shape
    raw = code + (1000 if height and not flag else 0) | (0x80000000 if height and flag else 0)
    out = struct.pack("B", order == "<") + struct.pack(order + "I", raw)
    point = lambda p: struct.pack(order + ("ddd" if height else "dd"), *p, *([9.0] if height else []))
    count = lambda x: struct.pack(order + "I", len(x))
    if code == 1:
        return out + point(content)
    if code == 2:
        return out + count(content) + b"".join(map(point, content))
    if code == 3:
        return out + count(content) + b"".join(count(r) + b"".join(map(point, r)) for r in content)
    return out + count(content) + b"".join(_write(s, order, height, flag) for s in content)


def _parts(shape):
    code, content = shape
    if code == 1:
        return [] if math.isnan(content[0]) else [("point", [[content]])]
    if code == 2:
        return [("line", [content])] if content else []
    if code == 3:
        rings = [r[:-1] if r[0] == r[-1] else r for r in content if r]
        rings = [r for r in rings if r]
        return [("polygon", rings)] if rings else []
    return [p for s in content for p in _parts(s)]


def _plain(parts):
    return None if parts is None else [(p["kind"], [[(q["x"], q["y"]) for q in r] for r in p["rings"]]) for p in parts]


def _made(rng, code):
    spot = lambda: (float(rng.randint(-9, 9)), rng.random())
    if code == 1:
        return 1, spot() if rng.random() < 0.9 else (math.nan, math.nan)
    if code == 2:
        return 2, [spot() for _ in range(rng.randint(0, 5))]
    if code == 3:
        return 3, [(lambda r: [*r, r[0]])([spot() for _ in range(rng.randint(3, 6))]) for _ in range(rng.randint(0, 3))]
    inner = {4: [1], 5: [2], 6: [3], 7: [1, 2, 3, 4, 5, 6, 7]}[code]
    return code, [_made(rng, rng.choice(inner)) for _ in range(rng.randint(0, 4))]


def test_seven_kinds_in_both_orders_with_and_without_heights():
    rng = random.Random(5)
    shapes = [_made(rng, rng.randint(1, 7)) for _ in range(3000)]
    blobs = [_write(s, rng.choice("<>"), rng.random() < 0.3, rng.random() < 0.5) for s in shapes]
    kind, parts = wkb.parse(pa.array(blobs, pa.binary()))
    names = {1: "point", 2: "line", 3: "polygon", 4: "point", 5: "line", 6: "polygon", 7: "collection"}
    for s, k, p in zip(shapes, kind.to_pylist(), parts.to_pylist(), strict=True):
        want = _parts(s)
        assert _plain(p) == (want or None) and k == (names[s[0]] if want else None)


def test_bytes_that_are_no_geometry():
    rng = random.Random(6)
    whole = [_write(_made(rng, c)) for c in (1, 2, 3, 4, 5, 6, 7) for _ in range(60)]
    cut = [b[: rng.randrange(len(b))] for b in whole]
    noise = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    huge = [b"\x01\x07\x00\x00\x00\xff\xff\xff\xff", b"\x01\x02\x00\x00\x00\xff\xff\xff\xff" + bytes(64), b"\x01\x03\x00\x00\x00\xff\xff\xff\x7f" + bytes(16), b"\x02\x01\x00\x00\x00" + bytes(16)]
    kind, parts = wkb.parse(pa.array([None, b"", *cut, *noise, *huge], pa.binary()))
    got = kind.to_pylist()
    assert got[:2] == [None, None] and not any(got[2 : 2 + len(cut)]) and not any(got[-4:])
    assert [k is None for k in got] == [p is None for p in parts.to_pylist()]
    assert len(wkb.parse(pa.array([], pa.binary()))[0]) == 0
    # A slice of a column starts at an offset, and what lies behind a whole geometry is ignored.
    point = _write((1, (3.0, 4.0)))
    kind, parts = wkb.parse(pa.array([b"zz", point + b"more", None, point], pa.binary()).slice(1))
    assert kind.to_pylist() == ["point", None, "point"] and _plain(parts.to_pylist()[0]) == [("point", [[(3.0, 4.0)]])]


def test_many_parts_and_points():
    spots = [(float(i), float(-i)) for i in range(50_000)]
    odd = (4, [(1, (float(i), 0.0)) for i in range(20)])
    mixed = struct.pack("<BII", 1, 4, 20) + b"".join(_write(s, "<>"[i % 2], height=i % 5 == 0) for i, s in enumerate(odd[1]))
    kind, parts = wkb.parse(pa.array([_write((4, [(1, p) for p in spots])), mixed, _write((2, spots))], pa.binary()))
    got = parts.to_pylist()
    assert _plain(got[0]) == [("point", [[p]]) for p in spots] and _plain(got[1]) == _parts(odd) and _plain(got[2]) == [("line", [spots])]


def test_decode_keeps_other_columns(spark):
    rows = [(1, "a", bytearray(_write((6, [(3, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]])])))), (2, "b", None), (1, "a", bytearray(b"\x01"))]
    frame = spark.createDataFrame(rows, "id int, `kind of` string, geom binary")
    got = sorted(wkb.decode(frame).collect(), key=lambda r: (r.id, r.kind is None))
    assert [(r.id, r["kind of"], r.kind) for r in got] == [(1, "a", "polygon"), (1, "a", None), (2, "b", None)]
    assert [len(x) for x in got[0].parts[0].rings] == [3] and wkb.decode(frame.limit(0)).count() == 0
