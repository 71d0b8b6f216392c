"""Web archives in ZIP packages, read in place.

A package is a ZIP file whose members are stored, not deflated: ``archive/*.warc.gz`` with one gzip member to a record, and
``indexes/*.cdxj`` with a line to a record: its key, time, and as JSON the archive member's name, the record's place in it and its length. A package
is opened from its end: the end record, the ZIP64 end record where a number doesn't fit, and
the central directory give every member's place; the local header in front of a member gives where its bytes begin.
Records are then read by range, near ones in one read, and nothing is extracted. What no index covers, be it a whole archive or a gap in one, is walked record by record.
Archives and indexes are known by their names' ends, ``.warc.gz`` or ``.warc`` and ``.cdxj`` or ``.cdx`` (of any number of gzip members, with ``.gz``), wherever they lie.

Packages are read and written through ``pyarrow.fs``, so local and object stores do alike. Written files have names of their own for each attempt,
and only those of finished tasks are listed, so a lost executor leaves no half package in the list.

Defined results: a record without an HTTP header block keeps its payload; null url and null html are written as absent header and empty
payload, and come back as null and as ''. Bytes that aren't UTF-8 come back as U+FFFD. A member that is deflated, a damaged directory or a record that doesn't begin where its index says is an error
that names the package. An empty table makes one package without records. Rows that repeat are records each. Columns beyond id, url and html aren't archived.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import filesystem

#: Records nearer to each other than this are read at once, up to RANGE bytes.
GAP, RANGE = 1 << 16, 4 << 20
#: Bytes of records to a task that reads them.
TASK = 64 << 20


@dataclass
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def read_at(f, place: int, n: int) -> bytes:
    f.seek(place)
    out = f.read(n)
    if len(out) != n:
        raise ValueError(f"{n} bytes at {place}: only {len(out)} there")
    return out


def directory(f, size: int) -> list[Member]:
    """The members that the central directory lists."""
    tail = read_at(f, max(0, size - 65_557), min(size, 65_557))
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, length, start, _ = struct.unpack_from("<4s4H2LH", tail, at)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        where = size - len(tail) + at - 20
        mark, _, end64, _ = struct.unpack("<4sLQL", read_at(f, where, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        mark, _, _, _, _, _, _, count, length, start = struct.unpack("<4sQ2H2L4Q", read_at(f, end64, 56))
        if mark != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
    raw, out, p = read_at(f, start, length), [], 0
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        _, _, _, flags, method, _, _, crc, packed, n, name_n, extra_n, note_n, _, _, _, header = struct.unpack_from("<4s6H3L5H2L", raw, p)
        name = raw[p + 46 : p + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = raw[p + 46 + name_n : p + 46 + name_n + extra_n], 0
        while q + 4 <= len(extra):
            tag, own = struct.unpack_from("<2H", extra, q)
            if tag == 1:  # ZIP64: only the fields that didn't fit, in this order
                r = q + 4
                if n == 0xFFFFFFFF:
                    n, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", extra, r)[0], r + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, r)[0]
            q += 4 + own
        out.append(Member(name, method, crc, packed, n, header))
        p += 46 + name_n + extra_n + note_n
    return out


def data_place(f, m: Member) -> int:
    """Where a member's bytes begin."""
    head = read_at(f, m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {m.name}")
    name_n, extra_n = struct.unpack_from("<2H", head, 26)
    return m.header + 30 + name_n + extra_n


class Package:
    """Writes a ZIP package as a stream of stored members; ``force64`` writes ZIP64 records even where numbers fit."""

    def __init__(self, out, force64: bool = False):
        self.out, self.at, self.members, self.force64 = out, 0, [], force64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        crc = n = 0
        for x in parts:
            crc, n = zlib.crc32(x, crc), n + len(x)
        raw, big = name.encode(), self.force64 or n >= 0xFFFFFFFF
        m = Member(name, 0, crc, n, n, self.at)
        extra = struct.pack("<2H2Q", 1, 16, n, n) if big else b""
        self._write(struct.pack("<4s5H3L2H", b"PK\x03\x04", 45 if big else 20, 0x800, 0, 0, 0x21, crc, *([0xFFFFFFFF] * 2 if big else [n, n]), len(raw), len(extra)) + raw + extra)
        for x in parts:
            self._write(x)
        self.members.append(m)

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            big = [self.force64 or x >= 0xFFFFFFFF for x in (m.size, m.packed, m.header)]
            fields = [x for x, b in zip((m.size, m.packed, m.header), big) if b]
            extra = struct.pack(f"<2H{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
            small = [0xFFFFFFFF if b else x for x, b in zip((m.size, m.packed, m.header), big)]
            self._write(struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45 if fields else 20, 0x800, 0, 0, 0x21, m.crc, small[1], small[0], len(raw), len(extra), 0, 0, 0, 0, small[2]) + raw + extra)
        length, n = self.at - start, len(self.members)
        if self.force64 or n >= 0xFFFF or start >= 0xFFFFFFFF or length >= 0xFFFFFFFF:
            end64 = self.at
            self._write(struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start) + struct.pack("<4sLQL", b"PK\x06\x07", 0, end64, 1))
            n, length, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._write(struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, length, start, 0))


def record(page_id: int | None, url: str | None, html: str | None, level: int = 6) -> bytes:
    """A response record, as a gzip member."""
    body = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", *([] if url is None else [f"WARC-Target-URI: {url}"]), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[int | None, str | None, str, int]:
    """(page id, url, payload, HTTP status) of a record that is unpacked."""
    if not raw.startswith(b"WARC/"):
        raise ValueError("no WARC record here")
    cut = raw.index(b"\r\n\r\n")
    fields = dict(x.split(":", 1) for x in raw[:cut].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    block = raw[cut + 4 : cut + 4 + int(fields["content-length"])]
    status, body = 0, block
    if block.startswith(b"HTTP/"):
        top, _, body = block.partition(b"\r\n\r\n")
        status = int(top.split(b" ", 2)[1])
    own = fields.get("warc-record-id", "").strip("<>").rpartition(":")[2]
    return int(own) if own.lstrip("-").isdigit() else None, fields.get("warc-target-uri"), body.decode("utf-8", "replace"), status


def write_packages(pages: DataFrame, folder: str, archive_mb: int = 16, package_mb: int = 256, indexed: bool = True, force64: bool = False) -> DataFrame:
    """Packages of pages in a folder; a row (path, size, records) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = filesystem(folder)
        state: dict = {}

        def flush() -> None:
            name = f"data-{state['archives']:05d}.warc.gz"
            state["zip"].add(f"archive/{name}", state["parts"])
            state["archives"] += 1
            state["lines"] += [line | {"filename": name} for line in state["own"]]
            state.update(parts=[], own=[], n=0)

        def finish() -> pa.RecordBatch:
            if state["parts"]:
                flush()
            if indexed:
                lines = [f"{x.pop('key')} 20240101000000 {json.dumps(x)}\n" for x in state["lines"]]
                state["zip"].add("indexes/index.cdxj", ["".join(sorted(lines)).encode("utf-8", "surrogatepass")])
            state["zip"].close()
            state["out"].close()
            out = pa.RecordBatch.from_pylist([{"path": state["path"], "size": state["zip"].at, "records": state["records"]}], pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))
            state.clear()
            return out

        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if not state:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    state.update(path=f"{folder}/{path.rpartition('/')[2]}", out=fs.open_output_stream(path), archives=0, lines=[], own=[], parts=[], n=0, records=0)
                    state["zip"] = Package(state["out"], force64)
                data = record(page_id, url, html)
                state["own"].append({"key": url or "-", "url": url, "offset": state["n"], "length": len(data)})
                state["parts"].append(data)
                state["n"] += len(data)
                state["records"] += 1
                if state["n"] >= archive_mb << 20:
                    flush()
                if state["zip"].at >= package_mb << 20:
                    yield finish()
        if state:
            yield finish()

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "path string, size bigint, records bigint")


def locate(packages: DataFrame) -> DataFrame:
    """(path, member, place, length) of every record that an index names, and of what no index covers (``indexed`` is false), to be walked: gaps of archives, or whole ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("member", pa.string()), ("place", pa.int64()), ("length", pa.int64()), ("indexed", pa.bool_())])
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    try:
                        members = directory(f, f.size())
                        places, rows, named = {}, [], set()
                        archives = set()
                        for m in members:
                            archive, index = m.name.endswith((".warc.gz", ".warc")), m.name.removesuffix(".gz").endswith((".cdxj", ".cdx"))
                            if archive or index:
                                if m.method:
                                    raise ValueError(f"{m.name} is packed by method {m.method}, not stored")
                                places[m.name] = (data_place(f, m), m.size)
                            if archive:
                                archives.add(m.name)
                        for m in members:
                            if m.name in places and m.name not in archives:
                                raw = read_at(f, *places[m.name])
                                for line in (gunzip(raw) if m.name.endswith(".gz") else raw).decode("utf-8", "surrogatepass").split("\n"):
                                    if line[line.find("{") :].startswith("{"):
                                        x = json.loads(line[line.find(" {") + 1 :])
                                        own = next((n for n in (f"archive/{x['filename']}", x["filename"]) if n in archives), None)
                                        if own is None:
                                            raise ValueError(f"{m.name} names {x['filename']}, which isn't there")
                                        if int(x["offset"]) + int(x["length"]) > places[own][1]:
                                            raise ValueError(f"{m.name} names a record beyond the end of {own}")
                                        named.add((own, int(x["offset"]), int(x["length"])))
                        covered = dict.fromkeys(archives, 0)
                        for own, offset, length in sorted(named):
                            start = places[own][0]
                            if offset > covered[own]:
                                rows.append((path, own, start + covered[own], offset - covered[own], False))
                            covered[own] = max(covered[own], offset + length)
                            rows.append((path, own, start + offset, length, True))
                        rows += [(path, n, places[n][0] + c, places[n][1] - c, False) for n, c in sorted(covered.items()) if c < places[n][1]]
                    except (ValueError, KeyError, struct.error) as e:
                        raise ValueError(f"{path}: {e}") from e
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 10_000]), kind)], schema=kind)

    return packages.select("path").mapInArrow(run, "path string, member string, place bigint, length bigint, indexed boolean")


def gunzip(raw: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while raw:
        z = zlib.decompressobj(31)
        out.append(z.decompress(raw))
        if not z.eof:
            raise ValueError("a gzip member is cut off")
        raw = z.unused_data.lstrip(b"\0")
    return b"".join(out)


def _walk_plain(f, place: int, length: int) -> Iterator[bytes]:
    """The records of an archive that isn't compressed."""
    end, held = place + length, b""

    def more() -> bool:
        nonlocal held, place
        n = min(RANGE, end - place)
        held, place = held + (read_at(f, place, n) if n else b""), place + n
        return n > 0

    while True:
        held = held.lstrip(b"\r\n")
        while (cut := held.find(b"\r\n\r\n")) < 0 and more():
            held = held.lstrip(b"\r\n")
        if not held:
            return
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", held[: max(cut, 0)])
        if found is None:
            raise ValueError("a record without a length")
        size = cut + 4 + int(found[1])
        while len(held) < size:
            if not more():
                raise ValueError("an archive ends within a record")
        yield held[:size]
        held = held[size:]


def _walk(f, place: int, length: int) -> Iterator[bytes]:
    """The records from a place on, a window at a time."""
    end, held = place + length, b""
    while place < end or held:
        z, out, left = zlib.decompressobj(31), [], held
        while not z.eof:
            if not left:
                if place >= end:
                    if out or held:
                        raise ValueError("an archive ends within a record")
                    return
                left = read_at(f, place, min(RANGE, end - place))
                place += len(left)
            out.append(z.decompress(left))
            left = b""
        held = z.unused_data
        yield b"".join(out)


def read_records(places: DataFrame) -> DataFrame:
    """(page_id, url, html, status, path, member) of all records; ``places`` as from ``locate``, in ranges that lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("status", pa.int32()), ("path", pa.string()), ("member", pa.string())])
        for b in batches:
            rows = sorted(zip(*(c.to_pylist() for c in b.columns)))
            out, held, i = [], 0, 0
            files: dict = {}
            while i < len(rows):
                path, member, place, length, indexed = rows[i]
                if path not in files:
                    for x in files.values():
                        x.close()
                    fs, name = filesystem(path)
                    files = {path: fs.open_input_file(name)}
                f = files[path]
                try:
                    if not indexed:
                        raws, j = (_walk if member.endswith(".gz") else _walk_plain)(f, place, length), i + 1
                        raws = ((x, member) for x in raws)
                    else:
                        j, end = i + 1, place + length
                        while j < len(rows) and rows[j][0] == path and rows[j][4] and rows[j][2] <= end + GAP and rows[j][2] + rows[j][3] - place <= RANGE:
                            end = max(end, rows[j][2] + rows[j][3])
                            j += 1
                        window = read_at(f, place, end - place)
                        raws = ((x if (x := window[p - place : p - place + n])[:2] != b"\x1f\x8b" else zlib.decompress(x, 31), m) for _, m, p, n, _ in rows[i:j])
                    for raw, m in raws:
                        out.append((*parse(raw), path, m))
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)
                            out, held = [], 0
                except (ValueError, zlib.error) as e:
                    raise ValueError(f"{path}: {member} at {place}: {e}") from e
                i = j
            for x in files.values():
                x.close()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), kind)], schema=kind)

    # numbered partitions, as many as the records' bytes ask for, whatever the places themselves take
    n = max(places.sparkSession.sparkContext.defaultParallelism, -(-int(places.agg(F.sum("length")).first()[0] or 0) // TASK))
    spread = F.floor(F.col("place") / F.lit(RANGE))
    return places.select("path", "member", "place", "length", "indexed").repartition(n, "path", spread).sortWithinPartitions("path", "place").mapInArrow(run, "page_id bigint, url string, html string, status int, path string, member string")


def round_trip(pages: DataFrame, ws) -> DataFrame:
    """Pages, archived into packages in the shared folder and read from there."""
    packages = ws.stash(write_packages(pages, f"{ws.path}/packages"), "list")
    places = ws.stash(locate(packages.repartition(F.col("path"))), "places", compression="zstd")
    return read_records(places).select("page_id", "url", "html", "status")


SQL = "SELECT page_id, url, coalesce(html, '') AS html, 200::INTEGER AS status FROM pages"
