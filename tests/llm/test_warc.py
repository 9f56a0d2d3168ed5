from __future__ import annotations

import gzip
import hashlib
import random
from pathlib import Path

from siltstone.llm.warc import member, op3_warc, read_archives, read_records, record, with_payloads, write_archives
from siltstone.sources.tables import table


def plain(rows):
    first = {}
    for i, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first[data] = min(i, first.get(data, i))
    out = []
    for i, html in rows:
        data = (html or "").encode()
        of = first.get(data, i)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if of == i else "revisit", None if of == i else of))
    return sorted(out)


def test_query_against_plain(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in table(spark, sf_dir, "pages").collect()]
    got = sorted(map(tuple, op3_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))
    assert got == plain(rows)


def test_round_trip_of_payloads_and_standard_gzip(spark, tmp_path):
    long = "x" * 3_000_000
    rows = [(1, "http://a\r\nb", "é" * 60, 0), (2, None, None, 0), (3, "u", "é" * 60, 0), (4, "u", "short", 0), (5, "u", "short", 0), (6, "u", long, 0), (None, "u", "é" * 60, 0), (1, "again", "é" * 60, 0), (8, "u", "WARC/1.1\r\n\r\n\x1f\u008b\x08 inside" * 9, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")
    path = str(tmp_path / "w")
    write_archives(df, path)
    back = read_archives(spark, path)
    assert back.filter("kind = 'gap'").count() == 0
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, bytes(r.payload)) for r in with_payloads(back).collect()), key=str)
    want = sorted(((i or -1, "revisit" if h == "é" * 60 and i != 1 else "response", 1 if h == "é" * 60 and i != 1 else None, (h or "").encode()) for i, _, h, _ in rows), key=str)
    assert got == want
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path).glob("part-*"))
    assert text.count(b"WARC-Record-ID") == len(rows)
    write_archives(df.limit(0), path + "0")
    assert read_archives(spark, path + "0").count() == 0


def records(n):
    out = []
    for i in range(n):
        payload = random.Random(i).randbytes(300 + i)
        out.append(record(i, "u", payload, hashlib.sha256(payload).hexdigest(), len(payload), None))
    return out


def read(data):
    found = list(read_records(data))
    return [int(h.get("warc-record-id", "<urn:page:-1>")[10:-1]) for _, _, _, h, _, _ in found if h], [(a, a + n) if inside is None else (a, inside, n) for a, inside, n, h, _, _ in found if h is None]


def test_salvage_of_damaged_members_and_plain_records():
    for pack in (member, lambda x: x):
        parts = [pack(x) for x in records(8)]
        starts = [sum(map(len, parts[:i])) for i in range(9)]
        whole = b"".join(parts)
        assert read(whole) == (list(range(8)), [])
        for hurt in (0, 3, 7):
            data = bytearray(whole)
            for at in range(starts[hurt] + 250, starts[hurt] + 290):
                data[at] ^= 0x5A
            ids, gaps = read(bytes(data))
            assert ids == [i for i in range(8) if i != hurt]
            assert len(gaps) == 1 and gaps[0][0] == starts[hurt] and gaps[0][1] <= starts[hurt + 1]
        ids, gaps = read(whole[: starts[5] + 50])
        assert ids == list(range(5)) and gaps == [(starts[5], starts[5] + 50)]
        ids, gaps = read(b"junk WARC/ junk\x1f\x8b\x08" + whole)
        assert ids == list(range(8)) and gaps == [(0, 18)]
        removed = whole[: starts[2] + 420] + whole[starts[4] + 420 :]
        ids, gaps = read(removed)
        assert ids == [0, 1, 5, 6, 7] and len(gaps) == 1


def test_every_single_byte_flip_loses_one_record_at_most():
    parts = [member(x) for x in records(3)]
    whole = b"".join(parts)
    for at in range(0, len(whole), 37):
        data = bytearray(whole)
        data[at] ^= 0xFF
        assert len(read(bytes(data))[0]) >= 2


def test_records_inside_one_member_are_salvaged():
    parts = records(3)
    hurt = bytearray(parts[1])
    hurt[-50] ^= 0xFF
    at, n = len(parts[0]), len(parts[1])
    ids, gaps = read(gzip.compress(parts[0] + bytes(hurt) + parts[2]))
    assert ids == [0, 2] and gaps == [(0, at, n)]
    ids, gaps = read(gzip.compress(parts[0] + parts[1][:-200] + parts[2]))
    assert ids == [0, 2] and gaps == [(0, at, n - 200)]
    whole = gzip.compress(b"".join(parts))
    ids, gaps = read(whole[:-120])
    assert ids == [0, 1] and gaps == [(0, len(whole) - 120)]
    bad = bytearray(whole + member(records(5)[4]))
    bad[len(whole) - 6] ^= 0xFF  # the checksum of the first member only
    assert read(bytes(bad))[0] == [0, 1, 2, 4]
    bad[len(whole) // 2] ^= 0xFF
    ids, _ = read(bytes(bad))
    assert ids[0] == 0 and ids[-1] == 4


def test_a_plain_record_with_a_member_magic_in_its_damage():
    parts = records(4)
    hurt = parts[1][:300] + b"\x1f\x8b\x08" + parts[1][310:]
    assert read(parts[0] + hurt + parts[2] + parts[3]) == ([0, 2, 3], [(len(parts[0]), len(parts[0]) + len(hurt))])


def test_files_are_rolled_by_bytes(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, "u", rng.randbytes(rng.choice([100, 900, 1800, 7000, 30_000]))) for i in range(60)] + [(100 + i, "u", b"same" * 4000) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").coalesce(1)
    path = str(tmp_path / "rolled")
    write_archives(df, path, file_bytes=16_000, small=1000)
    back = read_archives(spark, path)
    per_file = {}
    for r in back.collect():
        per_file.setdefault(r.archive, []).append(len(r.payload or b""))
    assert sum(map(len, per_file.values())) == len(rows) and back.filter("kind = 'gap'").count() == 0
    assert all(sum(x) <= 16_000 or len(x) == 1 for x in per_file.values())
    assert {r.page_id: bytes(r.payload) for r in with_payloads(back).collect()} == {i: x for i, _, x in rows}


def test_addresses_of_any_length(spark, tmp_path):
    rows = [(1, "http://x/" + "a" * 2_000_000, "one"), (2, "u", "two"), (3, "é" * 700_000, "y" * 300_000)]
    path = str(tmp_path / "long")
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    back = read_archives(spark, path).collect()
    assert sorted((r.page_id, r.kind, r.uri, bytes(r.payload).decode()) for r in back) == [(i, "record", u, h) for i, u, h in rows]


def test_version_lines_without_an_end_of_headers():
    data = b"WARC/1.1\r\n" * 50_000
    assert [(a, n, why) for a, _, n, _, _, why in read_records(data)] == [(0, len(data), "headers do not end")]


def test_large_payloads_by_class_of_size(spark, tmp_path):
    rows = [(i, "u", chr(97 + i) * (200 * 2**i)) for i in range(10)] + [(20, "u", "j" * (200 * 2**9))]
    path = str(tmp_path / "classes")
    write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, file_bytes=8000, small=1000)
    assert sorted((r.page_id, r.record_type, len(r.payload or b"")) for r in read_archives(spark, path).collect()) == sorted((i, "revisit" if i == 20 else "response", 0 if i == 20 else len(h)) for i, _, h in rows)
