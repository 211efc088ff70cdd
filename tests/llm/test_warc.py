"""Archives: round trips, revisits and recovery from damage."""

import gzip
import random

import pytest

from sheetweave.llm import warc

SCHEMA = "page_id long, url string, html string, kind string, digest binary, n int"


def make_pages(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", b"d", 1) for r in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(3)
    rows = [(k, f"http://h/{k}?a b\n", chance.choice(["a", "<p>é中</p>", "", None, f"own {k}\r\n\r\nWARC/1.1\r\nx"]))
            for k in range(80)]
    return rows + [(90, None, "z" * 300_000), (-5, "u", "a"), (7, "u", rows[7][2]), (None, "u", "a"), (None, None, "q" * 9),
                   (91, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")]


def expected(rows, least=0):
    groups = {}
    for page_id, _, html in rows:
        if page_id is not None:
            key = html or ""
            groups[key] = min(groups.get(key, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data, first = (html or "").encode(), groups.get(html or "")
        response = first is None or page_id == first or len(data) < least
        out.append((page_id, len(data), warc.sha1(data), "response" if response else "revisit", None if response else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, rows, compress, least):
    path = f"{tmp_path}/w"
    warc.write_warc(make_pages(spark, rows), path, least, compress, file_bytes=4000)
    found = warc.read_warc(spark, path).collect()
    assert {r["kind"] for r in found} == {"record"}
    assert len({r["file"] for r in found}) > (5 if not compress else 2)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=repr)
    assert got == expected(rows, least)
    texts = {r["payload_digest"]: bytes(r["payload"]) for r in found if r["record_type"] == "response"}
    assert {t.decode() for t in texts.values()} == {h or "" for _, _, h in rows}
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    assert "http://h/3?a%20b%0A" in {r["url"] for r in found}


def test_members_are_plain_gzip():
    record = warc.page_record(4, "u", b"body", None)
    data = warc.member(record) + warc.member(warc.info_record())
    assert gzip.decompress(data) == record + warc.info_record()
    big = warc.page_record(4, "u", bytes(17 << 20), None)
    assert warc.member(big)[-1] == 0 and gzip.decompress(warc.member(big)) == big


@pytest.mark.parametrize("seal", [warc.member, bytes])
def test_salvage(seal):
    """Damage of any kind costs the records it hits and no other; gaps cover the bytes between."""
    chance = random.Random(8)
    whole = [seal(warc.page_record(k, "u", chance.randbytes(chance.randrange(5, 400)), None)) for k in range(12)]
    data = b"".join(whole)
    assert [r.headers["x-page-id"] for r in warc.salvage(data)] == [str(k) for k in range(12)]
    for _ in range(300):
        parts, hit = list(whole), set(chance.sample(range(12), chance.randrange(1, 4)))
        for k in hit:
            part = bytearray(parts[k])
            kind = chance.randrange(3)
            if kind == 0:  # a flipped bit
                part[chance.randrange(len(part))] ^= 1 << chance.randrange(8)
            elif kind == 1:  # bytes lost
                start = chance.randrange(len(part))
                del part[start:start + chance.randrange(1, 60)]
            else:  # strange bytes put in
                at = chance.randrange(1, len(part))
                part[at:at] = chance.choice([b"\x1f\x8b\x08junk", b"\nWARC/1.1\r\n", chance.randbytes(30)])
            parts[k] = bytes(part)
        damaged = b"".join(parts)
        found = list(warc.salvage(damaged))
        ids = {warc.number(r.headers.get("x-page-id")) for r in found if isinstance(r, warc.Record)}
        assert set(range(12)) - hit <= ids
        place = 0
        for piece in found:
            assert piece.offset == place
            place += piece.length
        assert place == len(damaged)


def test_damaged_files(spark, tmp_path, rows):
    path = tmp_path / "w"
    warc.write_warc(make_pages(spark, rows, 1), str(path))
    (file,) = path.glob("part-*")
    data = file.read_bytes()
    (path / ".crc").mkdir()
    for crc in path.glob(".*.crc"):
        crc.rename(path / ".crc" / crc.name)
    spots = [r for r in warc.salvage(data)]
    lost = spots[10]
    file.write_bytes(data[:lost.offset + 40] + b"?" + data[lost.offset + 41:] + b"tail")
    found = warc.read_warc(spark, str(path)).collect()
    gaps = [(r["offset"], r["length"]) for r in found if r["kind"] == "gap"]
    assert gaps == [(lost.offset, lost.length), (len(data), 4)]
    assert sum(r["kind"] == "record" for r in found) == len(rows) - 1
    assert all(r["reason"] for r in found if r["kind"] == "gap")


def test_foreign_headers():
    """Folded lines, other versions and missing digests are read; wrong ones are not."""
    data = b"WARC/1.0\r\nWARC-Type: resource\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (record,) = warc.salvage(data)
    assert record.headers["x-long"] == "a b" and record.payload() == b"abc"
    for broken in (data.replace(b"WARC/1.0", b"WARC/9.0"), data.replace(b": 3", b": 4"), data.replace(b": 3", b": x"),
                   data.replace(b"X-Long:", b"X-Long"), data[:-1], data[:30],
                   data.replace(b"X-Long: a", b"WARC-Block-Digest: sha1:AAAA")):
        assert [type(r) for r in warc.salvage(broken)] == [warc.Gap]
    assert list(warc.salvage(b"")) == []


def test_empty_table(spark, tmp_path):
    warc.write_warc(make_pages(spark, []), f"{tmp_path}/w")
    assert warc.read_warc(spark, f"{tmp_path}/w").count() == 0
