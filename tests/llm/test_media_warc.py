import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest

from voxelmill.llm import media, warc


def filtered_by_hand(image, kind):
    """Rows under one of the five filters, sample by sample."""
    out = []
    for y in range(image.shape[0]):
        row = [kind]
        for x in range(image.shape[1]):
            left = int(image[y, x - 1]) if x else 0
            up = int(image[y - 1, x]) if y else 0
            corner = int(image[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            near = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            guess = (0, left, up, (left + up) // 2, near)[kind]
            row.append((int(image[y, x]) - guess) % 256)
        out.append(row)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    image = np.random.default_rng(kind).integers(0, 256, (9, 13), dtype=np.uint8)
    assert np.array_equal(media.unfilter(filtered_by_hand(image, kind)), image)


def test_mixed_filters_are_undone():
    image = np.random.default_rng(1).integers(0, 256, (10, 7), dtype=np.uint8)
    lines = np.stack([filtered_by_hand(image, k)[y] for y, k in enumerate([0, 1, 2, 2, 3, 4, 4, 2, 1, 0])])
    assert np.array_equal(media.unfilter(lines), image)


@pytest.mark.parametrize("shape", [(1, 64), (3, 64), (50, 64), (5, 1)])
def test_round_trip(shape):
    image = np.random.default_rng(2).integers(0, 256, shape, dtype=np.uint8)
    data = media.write_png(image)
    assert np.array_equal(media.read_png(data), image)
    assert len(media.cosine_hash(image)) == 8


def test_damage_is_told():
    data = bytearray(media.write_png(np.zeros((2, 64), np.uint8)))
    for bad in (b"", bytes(data[:-3]), bytes(data[:40]) + b"x" + bytes(data[41:]), b"x" + bytes(data[1:]), bytes(data) + b"more"):
        with pytest.raises(media.BadImage):
            media.read_png(bad)


def test_media_columns(documents):
    rows = media.with_media_features(media.with_media(documents.withColumnRenamed("shard", "media"), "text")).collect()
    assert len(rows) == documents.count()
    by_text = {}
    for r in rows:
        text = bytes(r["text"]) if r["text"] is not None else b""
        assert bytes(r["payload"]) == media.payload_of(text) and r["image_error"] is None and len(r["payload"]) % 64 == 0
        assert by_text.setdefault(text, bytes(r["media"])) == bytes(r["media"])
    assert media.with_media(documents.limit(0), "text").count() == 0


def test_damaged_media_have_errors(spark):
    rows = media.with_media_features(spark.createDataFrame([(1, b"no"), (2, None)], "id int, media binary")).orderBy("id").collect()
    assert [r["image_error"] for r in rows] == ["no PNG signature", "no image"] and rows[0]["hash"] is None


PAGES = [(3, "u3", "same"), (1, "u1", "same"), (2, None, None), (4, "u4", ""), (5, "u 5\r\n", "other ü"), (None, "u", "same"), (5, "u 5\r\n", "other ü"), (6, "u6", "x" * 200_000), (1 << 60, "big", "same")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, shard string")


def test_archive_round_trip(pages, tmp_path):
    path = str(tmp_path / "w")
    manifest = warc.write_warc(pages, path, shard_records=3, roll_bytes=300)
    rows = warc.read_warc(manifest, path).collect()
    assert len(rows) == len(PAGES)
    first = {"same": 1, "": 2, "other ü": 5, "x" * 200_000: 6}
    for r in rows:
        assert r["error"] is None
        text = next((h or "" for i, _, h in PAGES if i == r["page_id"]))
        raw = text.encode()
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        revisit = r["page_id"] is not None and first[text] != r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[text]) if revisit else ("response", None))
        assert (r["payload"] is None) == revisit and (revisit or bytes(r["payload"]) == raw)
    files = manifest.collect()
    assert sum(f["records"] for f in files) == len(PAGES) and len(files) > 3
    for f in files:
        data = (tmp_path / "w" / f["file"]).read_bytes()
        assert hashlib.sha256(data).hexdigest() == f["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1")
    assert not list((tmp_path / "w" / "_temporary").iterdir())


def test_archives_do_not_depend_on_partitions(pages, tmp_path, spark):
    sums = []
    for n in (1, 5):
        path = str(tmp_path / f"w{n}")
        sums.append(sorted((f["file"], f["sha256"]) for f in warc.write_warc(pages.repartition(n), path, shard_records=2).collect()))
    assert sums[0] == sums[1]


def test_archives_do_not_depend_on_the_number_of_writers(pages, tmp_path):
    sums = []
    for n in (1, 2, 1000):
        files = warc.write_warc(pages, str(tmp_path / f"w{n}"), shard_records=2, most_writers=n).collect()
        sums.append(sorted((f["file"], f["records"], f["sha256"]) for f in files))
    assert len(sums[0]) > 2 and sums[0] == sums[1] == sums[2]


def test_an_id_with_other_payloads_has_records_of_its_own(spark, tmp_path):
    rows = [(1, "a", "u"), (1, "b", "u"), (1, "b", "u"), (2, "b", "u"), (3, None, None), (4, "", "u")]
    table = spark.createDataFrame(rows, "page_id long, html string, url string")
    manifest = warc.write_warc(table, str(tmp_path), shard_records=2)
    ids, refers = [], []
    for file in (r["file"] for r in manifest.collect()):
        for record in warc.members(open(tmp_path / file, "rb")):
            lines = dict(x.split(": ", 1) for x in record.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
            ids.append(lines["WARC-Record-ID"])
            refers += [lines[k] for k in lines if k == "WARC-Refers-To"]
    assert len(ids) == len(set(ids)) == 6 and len(refers) == 2 and set(refers) <= set(ids)
    back = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(manifest, str(tmp_path)).collect() if r["record_type"] == "revisit")
    assert back == [(2, "revisit", 1), (4, "revisit", 3)]


def test_least_revisit_bytes(pages, tmp_path):
    path = str(tmp_path / "w")
    rows = warc.read_warc(warc.write_warc(pages, path, least_revisit_bytes=5), path).collect()
    assert {r["page_id"] for r in rows if r["record_type"] == "revisit"} == set()


def test_damaged_records_are_told():
    data = gzip.decompress(warc.record_bytes(1, "u", b"payload", None))
    assert warc.parse_record(data)["error"] is None
    assert warc.parse_record(data.replace(b"payload\r\n", b"paYload\r\n"))["error"] == "block digest"


def test_no_pages(pages, tmp_path):
    path = str(tmp_path / "w")
    manifest = warc.write_warc(pages.limit(0), path)
    assert manifest.count() == 0 and warc.read_warc(manifest, path).count() == 0


def test_tail_checksum_matches_zlib():
    assert zlib.crc32(b"abc") == 0x352441C2
