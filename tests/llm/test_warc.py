import gzip
import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.errors import PythonException

from packetloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(pages, least=100):
    sort = lambda p: (p[0] is None, p[0] or 0, p[1] is None, p[1] or "")
    first, out = {}, []
    for page, url, html in sorted(pages, key=sort):
        data = (html or "").encode()
        row = [page, len(data), hashlib.sha256(data).hexdigest(), "response", None]
        if len(data) >= least:
            if data in first:
                row[3:] = ["revisit", first[data]]
            first.setdefault(data, page)
        out.append(tuple(row))
    return Counter(out)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    body = lambda n: "".join(rng.choice("aé中<>\r\n\x00 %") for _ in range(n))
    shared, short = body(300), body(30)
    out = [(k * 7 % 1009, f"http://h.example/{k}?q=ü x\r\nX: y" if k % 5 else None, body(rng.randrange(0, 400)))
           for k in range(400)]
    out += [(2000 + k, f"http://copy.example/{k}", shared) for k in range(200)]
    out += [(3000 + k, "u", short) for k in range(40)] + [(1500, "u", shared)] * 3 + [(1500, None, shared)]
    out += [(None, None, None), (None, "u", shared), (None, "u", body(200)), (4000, "u", ""), (4001, "u", None)]
    out += [(5000, "u", body(100)), (5000, "u", body(99)), (5001, "u", body(500_000)), (7, "again", out[1][2])]
    return out + out[:20] + [out[3]] * 50


def table(spark, pages, parts=3):
    return spark.createDataFrame(pages, SCHEMA).selectExpr(
        "*", "1 AS digest", "2 AS copy", "3 AS payload", "4 AS `range`").repartition(parts)


def files_of(folder):
    return {name: open(f"{folder}/{name}", "rb").read() for name in os.listdir(folder) if name.endswith(".gz")}


@pytest.mark.parametrize("roll,size", [(64 << 20, 32 << 20), (2000, 5000), (1, 100_000)])
def test_round_trip(spark, tmp_path, pages, roll, size):
    folder = f"file://{tmp_path}/out"
    found = warc.round_trip(table(spark, pages), folder, roll_bytes=roll, range_bytes=size, most_ranges=12)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [
        ("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"),
        ("refers_to", "bigint")]
    assert Counter(map(tuple, found.collect())) == plain(pages)
    assert not os.path.exists(f"{tmp_path}/out")


def test_same_files_however_the_pages_are_dealt(spark, tmp_path, pages):
    made = []
    for k, parts in enumerate((1, 6)):
        rows = list(pages)
        random.Random(k).shuffle(rows)
        manifest = warc.write_archives(table(spark, rows, parts), f"file://{tmp_path}/{k}", roll_bytes=3000, range_bytes=20_000)
        made.append(files_of(f"{tmp_path}/{k}"))
        told = {r.name: r for r in manifest.collect()}
        assert set(told) == set(made[-1])
        assert all(hashlib.sha256(data).hexdigest() == told[name].sha256 for name, data in made[-1].items())
        assert sorted(os.listdir(f"{tmp_path}/{k}")) == sorted([*told, "manifest"])
    assert made[0] == made[1] and len(made[0]) > 5
    assert all(len(gzip.decompress(data)) > 100 for data in made[0].values())


def test_records_are_sorted_and_point_to_the_response(spark, tmp_path, pages):
    folder = f"file://{tmp_path}/out"
    warc.write_archives(table(spark, pages), folder, range_bytes=30_000)
    read = warc.read_archives(spark, folder)
    rows = read.collect()
    responses = {r.record_id: r for r in rows if r.record_type == "response"}
    assert Counter(bytes(r.payload) for r in responses.values()) == Counter(
        {(h or "").encode(): 1 if len((h or "").encode()) >= 100 else n for h, n in Counter(
            x[2] or "" for x in pages).items()})
    by_file = {}
    for r in rows:
        by_file.setdefault(r.file, []).append((r.page_id is None, int(r.page_id or 0)))
    joined = [x for name in sorted(by_file) for x in by_file[name]]
    assert joined == sorted(joined)
    assert len({r.record_id for r in rows}) == len(rows) == len(pages)
    urls = {r.target_uri for r in rows}
    assert "about:blank" in urls and not any("\r" in u or " " in u for u in urls)


def test_only_what_the_manifest_names_is_read(spark, tmp_path, pages):
    folder = f"file://{tmp_path}/out"
    manifest = warc.write_archives(table(spark, pages), folder)
    (tmp_path / "out" / "pages-000099-00000.warc.gz").write_bytes(b"left over")
    assert warc.read_archives(spark, folder).count() == len(pages)
    with pytest.raises(FileExistsError):
        warc.write_archives(table(spark, pages), folder)
    name = manifest.first().name
    data = (tmp_path / "out" / name).read_bytes()
    (tmp_path / "out" / name).write_bytes(data[:len(data) // 2])
    with pytest.raises(PythonException):
        warc.read_archives(spark, folder).count()


def test_a_renamed_file_is_not_renamed_again(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(b"12345")
    row = {"name": "a.gz", "temporary": "a.gz.1.tmp", "records": 1, "bytes": 5, "sha256": ""}
    import pyarrow as pa
    rename = warc._renamer(f"file://{tmp_path}")
    assert len(list(rename(iter([pa.RecordBatch.from_pylist([row])])))) == 1
    with pytest.raises(OSError):
        list(rename(iter([pa.RecordBatch.from_pylist([row | {"name": "b.gz"}])])))


def test_empty_table_and_other_kinds_of_ids(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(empty, f"file://{tmp_path}/1").collect() == []
    named = spark.createDataFrame([("a/b %", "u", "x" * 200), ("b", "u", "x" * 200)], "page_id string, url string, html string")
    rows = warc.round_trip(named, f"file://{tmp_path}/2").collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in rows) == [("a/b %", "response", None), ("b", "revisit", "a/b %")]
