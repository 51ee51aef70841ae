"""Byte streams and nested records against whole-file scans."""

import json
import random

import pytest

from kinoframe.sources import bytestream as Y
from kinoframe.sources import frames as V
from kinoframe.sources import text as X


def whole_scan(data):
    starts, i = [], 0
    while i + 3 <= len(data):
        if data[i : i + 4] == b"\0\0\0\1":
            starts.append((i, 4))
            i += 4
        elif data[i : i + 3] == b"\0\0\1":
            starts.append((i, 3))
            i += 3
        else:
            i += 1
    ends = [s for s, _ in starts[1:]] + [len(data)]
    return [(s + n, e) for (s, n), e in zip(starts, ends, strict=False)]


def test_units_for_every_range_size(spark, tmp_path):
    rnd = random.Random(7)
    unit = lambda: rnd.choice([b"\0\0\1", b"\0\0\0\1", b"\0\0\0\0\0\1"]) + bytes([rnd.randrange(56), rnd.randrange(32) * 8 + rnd.randint(1, 7)]) + bytes(rnd.choice([0, 0, 1, 2, 9]) | 2 for _ in range(rnd.randrange(12)))
    streams = {"a": b"".join(unit() for _ in range(30)), "b": b"zz" + unit(), "c": b"no code at all", "d": b"", "e": unit() + b"\0\0"}
    for name, data in streams.items():
        (tmp_path / name).write_bytes(data)
    want = sorted((n, a, d[a + 1] >> 3, d[a], (d[a + 1] & 7) - 1, b - a - 2) for n, d in streams.items() for a, b in whole_scan(d))
    assert len(want) == 32
    for span in (1, 2, 3, 4, 5, 16, 1 << 20):
        got = Y.units(Y.byte_ranges(V.files(spark, str(tmp_path)), span)).collect()
        assert sorted((r["path"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in got) == want


@pytest.mark.parametrize(("data", "why"), [(b"\0\0\1\x05", "too short"), (b"\0\0\1\x85\x09xx", "reserved bits"), (b"\0\0\1\x38\x09", "layer id"), (b"\0\0\1\x05\x08", "temporal id")])
def test_bad_headers_raise(spark, tmp_path, data, why):
    (tmp_path / "x").write_bytes(data)
    with pytest.raises(Exception, match=why):
        Y.units(Y.byte_ranges(V.files(spark, str(tmp_path)))).collect()


def test_a_clip_of_a_short_file_raises(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abcdef")
    from pyspark.sql import functions as F

    places = V.raw_places(V.files(spark, str(tmp_path)), F.lit(2).cast("long"))
    assert [r["data"] for r in V.read_frames(V.clip(places, 3)).orderBy("frame").collect()] == [b"ab", b"cd", b"ef"]
    with pytest.raises(Exception, match="fewer than 4 frames"):
        V.read_frames(V.clip(places, 4)).collect()


def test_records_without_arrays_stay(spark, tmp_path):
    rows = [
        {"kind": "k", "source": "s", "frame_index": 1, "stages": [{"name": "a", "ns": 5, "count": 2, "more": 1}, {"name": "b"}], "counters": [{"name": "c", "value": 3}]},
        {"kind": "k", "source": "s", "stages": [], "counters": None},
        {"kind": "k", "source": "s", "frame_index": 2},
        {"kind": "other", "source": "s", "stages": [{"name": "a", "ns": 7}]},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    d = X.stats_rows(X.read_stats(spark, str(tmp_path), "k")).drop("source", "bitstream_bytes")
    key = lambda r: tuple(map(str, r))
    want = [(1, "stages", 0, "a", 5, 2), (1, "stages", 1, "b", 0, 0), (1, "counters", 0, "c", 3, None)]
    want += [(f, t, None, None, None, None) for f in (0, 2) for t in ("stages", "counters")]
    assert sorted(map(tuple, d.collect()), key=key) == sorted(want, key=key)
    totals = {r["stage"]: (r["nanos"], r["count"], r["frames"], r["share"]) for r in X.stage_totals(X.stats_rows(X.read_stats(spark, str(tmp_path), "k"))).collect()}
    assert totals == {"a": (5, 2, 1, 1.0), "b": (0, 0, 1, 0.0), "": (0, 0, 2, 0.0)}


def test_the_last_of_repeated_keys_counts(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("a=1 b=2 a=3 x =4 c= d=e=f",), ("",), ("a=1",)], "v string")
    got = [r[0] for r in d.select(X.key_values(F.col("v"))).collect()]
    assert got == [{"a": "3", "b": "2", "c": "", "d": "e=f"}, {}, {"a": "1"}]
