import gzip
import io
import itertools
import json
import zipfile

import pytest

from tests.llm.helpers import long_text, rows
from textmill.llm import warc
from textmill.llm.common import Workspace

PAGES = "page_id bigint, url string, html string"
HARD = [(1, "http://a.example/", "<p>one</p>"), (2, None, "<p>two</p>"), (3, "http://c.example/?q=ü%20x", None), (4, "http://d.example/", ""), (None, "http://e.example/", "no id"), (1, "http://a.example/", "<p>one</p>"), (5, "http://f.example/", long_text()), (6, "http://g.example/", "WARC/1.1\r\n\r\nPK\x03\x04 \x1f\x8b inside   é")]
BACK = sorted(((p, u, h or "") for p, u, h in HARD), key=str)


@pytest.mark.parametrize("options", [{}, {"force64": True}, {"indexed": False}, {"archive_mb": 0, "package_mb": 0}, {"archive_mb": 0, "force64": True, "indexed": False}])
def test_round_trip(spark, options):
    pages = spark.createDataFrame([(*r, "x", "y") for r in HARD], PAGES + ", path string, member string")
    packages = warc.write_packages(pages, Workspace(spark, "warc-test").path, **options)
    packages = spark.createDataFrame(packages.collect(), packages.schema)
    places = warc.locate(packages)
    got = warc.read_records(places)
    assert rows(got.select("page_id", "url", "html")) == BACK
    assert sum(r["records"] for r in packages.collect()) == len(HARD)
    assert {r["status"] for r in got.collect()} == {200}


def test_another_reader_agrees(spark):
    folder = Workspace(spark, "warc-test").path
    pages = spark.createDataFrame(HARD, PAGES).coalesce(1)
    (p,) = warc.write_packages(pages, folder, archive_mb=0).collect()
    with zipfile.ZipFile(p["path"].removeprefix("file://")) as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        names = [n for n in z.namelist() if n.startswith("archive/")]
        records = [gzip.decompress(z.read(n)) for n in names]
        assert len(records) == len(HARD) and sorted(map(str, (warc.parse(r)[:3] for r in records))) == sorted(map(str, BACK))


@pytest.mark.parametrize("force64", [False, True])
def test_directory_against_zipfile(force64):
    out = io.BytesIO()
    p = warc.Package(out, force64)
    for k in range(70_000 if not force64 else 300):  # beyond 65,535 members the end record doesn't fit either
        p.add(f"archive/é{k}", [b"x" * (k % 5)])
    p.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        want = [(i.filename, i.file_size, i.header_offset) for i in z.infolist()]
    assert [(m.name, m.size, m.header) for m in warc.directory(io.BytesIO(data), len(data))] == want


def test_packages_of_another_writer(spark, tmp_path):
    records = [warc.record(k, f"http://x/{k}", f"<p>{k}</p>") for k in range(20)]
    with zipfile.ZipFile(tmp_path / "other.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/data.warc.gz", b"".join(records))
        z.comment = b"PK\x05\x06 a comment that looks like an end record"
    packages = spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "path string")
    assert rows(warc.read_records(warc.locate(packages)).select("page_id", "html")) == sorted(((k, f"<p>{k}</p>") for k in range(20)), key=str)


@pytest.mark.parametrize("plain", [False, True])
def test_compressed_indexes_of_several_members_gaps_and_plain_archives(spark, tmp_path, plain):
    records = [warc.record(k, f"http://x/{k}", f"<p>{k}</p>" * (k + 1)) for k in range(30)]
    records = [gzip.decompress(r) for r in records] if plain else records
    ends = list(itertools.accumulate(len(r) for r in records))
    name = f"data.warc{'' if plain else '.gz'}"
    lines = [f"x,{k})/ 20240101000000 " + json.dumps({"filename": name, "offset": ends[k] - len(records[k]), "length": len(records[k])}) + "\n" for k in range(30) if k % 7 not in (0, 3, 4)]
    members = b"".join(gzip.compress("".join(lines[k : k + 4]).encode()) for k in range(0, len(lines), 4))
    with zipfile.ZipFile(tmp_path / "other.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr(f"archive/{name}", b"".join(records))
        z.writestr("indexes/index.cdx.gz", members)
        z.writestr("indexes/again.cdxj", "".join(lines[:5]))
        z.writestr(f"elsewhere/{name}", b"".join(records[:2]))
    places = warc.locate(spark.createDataFrame([(str(tmp_path / "other.wacz"),)], "path string"))
    assert places.where("indexed").count() == len(lines)
    want = [(k, f"<p>{k}</p>" * (k + 1)) for k in [*range(30), 0, 1]]
    assert rows(warc.read_records(places).select("page_id", "html")) == sorted(want, key=str)


def test_damage_is_an_error(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "packed.wacz", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 1000)
    (tmp_path / "none.wacz").write_bytes(b"not a package")
    for name, why in (("packed.wacz", "not stored"), ("none.wacz", "no end")):
        packages = spark.createDataFrame([(str(tmp_path / name),)], "path string")
        with pytest.raises(Exception, match=why):
            warc.locate(packages).collect()


def test_empty_table(spark):
    packages = warc.write_packages(spark.createDataFrame([], PAGES), Workspace(spark, "warc-test").path)
    packages = spark.createDataFrame(packages.collect(), packages.schema)
    assert warc.read_records(warc.locate(packages)).count() == 0
