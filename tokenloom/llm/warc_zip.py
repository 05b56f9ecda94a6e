"""Web archives packaged in ZIP files: writer, directory reader and record reader.

An archive written here holds two stored members: ``archive/data.warc.gz``, whose records are gzip members of their
own, and ``indexes/index.cdxj`` with a sorted line per record (search key, timestamp, and a JSON object with the place).
Readers find the end-of-directory record (ZIP64 included), parse the central directory, take every index member it
lists (``.cdx``, ``.cdxj``, also gzipped) and the archive members (``.warc``, ``.warc.gz``) that its lines name, and
then fetch single records by their byte range; no archive member is extracted. Files are opened through
``pyarrow.fs``, so any store it knows will do. Ids cross into Python as text, so that nulls beside them cost no digit.

Every write attempt of a task takes a file name of its own and only finished tasks report theirs, so a lost executor
or a second attempt leaves no record twice. Archives are rolled at ``archive_bytes``.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import or_empty, stored

LEAST_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 128 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ARCHIVES, INDEXES = (".warc", ".warc.gz"), (".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def plan_records(pages: DataFrame, *, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Pages with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``least_bytes`` the largest page_id is a response and the others refer to it. A null
    html is an empty payload. Rows that repeat the largest page_id are all responses; a null page_id always refers.
    """
    sized = pages.select("page_id", "url", or_empty("html").alias("html")).select(
        "*",
        F.octet_length("html").cast("bigint").alias("payload_bytes"),
        F.sha1(F.col("html").cast("binary")).alias("payload_digest"),
    )
    keepers = (
        sized.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
        .where("n > 1 AND keeper IS NOT NULL")
        .drop("n")
    )
    refers = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return sized.join(keepers, "payload_digest", "left").select(
        *sized.columns,
        F.when(refers, "revisit").otherwise("response").alias("record_type"),
        F.when(refers, F.col("keeper")).alias("refers_to"),
    )


def record_bytes(row, date: str) -> bytes:
    """One WARC record, uncompressed. A revisit carries the HTTP head only, which states the payload's full length."""
    payload = row.html.encode("utf-8", "replace")
    revisit = row.record_type == "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", row.record_type),
        ("WARC-Record-ID", f"<{_ID}{'' if pd.isna(row.page_id) else int(row.page_id)}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{row.payload_digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if isinstance(row.url, str):
        fields.append(("WARC-Target-URI", urllib.parse.quote(row.url, safe=":/?#[]@!$&'()*+,;=%~")))
    if revisit:
        fields += [("WARC-Refers-To", f"<{_ID}{int(row.refers_to)}>"), ("WARC-Profile", _PROFILE)]
    named = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + named.encode() + b"\r\n" + block + b"\r\n\r\n"


def index_line(row, offset: int, length: int, date: str) -> str:
    """A line of the index: search key (host turned round, then the path), timestamp, JSON object."""
    url = row.url if isinstance(row.url, str) else ""
    scheme, _, rest = url.partition("://")
    host, slash, path = rest.partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")" + slash + path if scheme and host else url
    place = {
        "url": url, "digest": f"sha1:{row.payload_digest}", "offset": offset, "length": length, "filename": DATA.rpartition("/")[2]
    }
    return f"{urllib.parse.quote(key, safe='/:?&=,)') or '-'} {''.join(filter(str.isdigit, date))} {json.dumps(place)}"


def write_archives(
    records: DataFrame,
    folder: str,
    *,
    archive_bytes: int = ARCHIVE_BYTES,
    zip64: bool = True,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write planned records below ``folder``; returns the stored manifest (path, records). No rows, no archives."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in frame.itertuples(index=False))
        row = next(rows, None)
        while row is not None:
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            places = []
            with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                offset = 0
                with archive.open(zipfile.ZipInfo(DATA), "w", force_zip64=zip64) as data:
                    while row is not None and offset < archive_bytes:
                        packed = gzip.compress(record_bytes(row, date), 1, mtime=0)
                        data.write(packed)
                        places.append(index_line(row, offset, len(packed), date))
                        offset += len(packed)
                        row = next(rows, None)
                with archive.open(zipfile.ZipInfo(INDEX), "w", force_zip64=zip64) as index:
                    index.write("".join(f"{line}\n" for line in sorted(places)).encode())
            yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{name}"], "records": [len(places)]})

    records = records.withColumns({name: F.col(name).cast("string") for name in ("page_id", "refers_to")})
    return stored(records.mapInPandas(write, "path string, records bigint"), "warc-manifest")


def read_directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file by name: (method, stored size, full size, offset of the data)."""

    def at(place: int, count: int) -> bytes:
        file.seek(place)
        return file.read(count)

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    # The record is the one whose comment ends with the file; a comment may hold the signature itself.
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end + 3)
    if end < 0:
        raise ValueError("no end-of-directory record: not a ZIP file, or cut short")
    _, _, _, entries, length, start, _ = struct.unpack("<4H2LH", tail[end + 4 : end + 22])
    end_at = tail_at + end
    locator = at(end_at - 20, 20) if end_at >= 20 else b""
    if locator[:4] == b"PK\x06\x07" and (entries == 0xFFFF or 0xFFFFFFFF in (length, start)):
        (wide_at,) = struct.unpack("<Q", locator[8:16])
        wide = at(wide_at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 directory record")
        entries, length, start = struct.unpack("<3Q", wide[32:56])
    directory, members, place = at(start, length), {}, 0
    for _ in range(entries):
        if directory[place : place + 4] != b"PK\x01\x02":
            raise ValueError("a central directory entry is damaged")
        (method,) = struct.unpack_from("<H", directory, place + 10)
        packed, full, name_length, extra_length, note_length = struct.unpack_from("<2L3H", directory, place + 20)
        (local,) = struct.unpack_from("<L", directory, place + 42)
        name = directory[place + 46 : place + 46 + name_length].decode("utf-8", "replace")
        extra = directory[place + 46 + name_length : place + 46 + name_length + extra_length]
        while len(extra) >= 4:
            kind, count = struct.unpack_from("<2H", extra)
            if kind == 1:  # the wide values stand in for those fields that are full of ones, in this order
                wide = iter(struct.unpack_from(f"<{count // 8}Q", extra, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            extra = extra[4 + count :]
        head = at(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"member {name} has no local header")
        members[name] = (method, packed, full, local + 30 + sum(struct.unpack_from("<2H", head, 26)))
        place += 46 + name_length + extra_length + note_length
    return members


def _index_lines(file, name: str, member: tuple[int, int, int, int]) -> list[bytes]:
    """JSON objects of the lines of an index member; header lines have none."""
    method, packed, _, data_at = member
    file.seek(data_at)
    listed = file.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        listed = zlib.decompress(listed, -15)
    if name.endswith(".gz"):
        listed = gzip.decompress(listed)
    objects = (line[line.find(b"{") :] for line in listed.splitlines() if b"{" in line)
    return [line for line in objects if b'"offset"' in line]


def _place(path: str, line: dict, members: dict) -> tuple[str, int, int]:
    archives = [name for name in members if name.endswith(ARCHIVES)]
    wanted = line.get("filename")
    named = [name for name in archives if wanted is None or name == wanted or name.endswith(f"/{wanted}")]
    if len(named) != 1:
        raise ValueError(f"{path}: the index names {wanted}, the archive members are {', '.join(sorted(archives)) or 'none'}")
    if members[named[0]][0] != zipfile.ZIP_STORED:
        raise ValueError(f"{path}: {named[0]} is compressed as a member, its records have no byte ranges")
    return path, int(line["offset"]) + members[named[0]][3], int(line["length"])


def read_index(manifest: DataFrame) -> DataFrame:
    """Places (path, offset, length) of all records of the archives named in ``path``, in bytes from the file's start."""

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (path for frame in frames for path in frame.path):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                members = read_directory(file, file.size())
                lines = [line for index in members if index.endswith(INDEXES) for line in _index_lines(file, index, members[index])]
            found = pd.DataFrame([_place(path, json.loads(line), members) for line in lines], columns=["path", "offset", "length"])
            yield found

    return manifest.select("path").mapInPandas(places, "path string, offset bigint, length bigint")


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(line[16:]) for line in http.decode("latin-1").split("\r\n") if line.startswith("Content-Length: "))
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its record")

    def page(field: str) -> int | None:
        digits = fields.get(field, "").strip("<>").removeprefix(_ID)
        return int(digits) if digits else None

    return {
        "page_id": page("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": page("WARC-Refers-To"),
        "payload": None if revisit else payload,
    }


RECORD = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def read_records(places: DataFrame, *, payload: bool = True) -> DataFrame:
    """Fetch records by byte range and parse them; each response's payload is checked against its digest."""
    schema = f"{RECORD}, payload binary" if payload else RECORD
    names = [part.split()[0] for part in schema.split(", ")]

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, group in frame.sort_values(["path", "offset"]).groupby("path", sort=False):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    for at in range(0, len(group), 500):
                        rows = []
                        for offset, length in group[["offset", "length"]].iloc[at : at + 500].itertuples(index=False):
                            file.seek(offset)
                            raw = file.read(length)
                            row = parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                            rows.append(row | {name: None if row[name] is None else str(row[name]) for name in ids})
                        yield pd.DataFrame(rows)[names]

    ids = ("page_id", "refers_to")
    asked = ", ".join(f"{name} string" if name in ids else part for name, part in zip(names, schema.split(", "), strict=True))
    fetched = places.mapInPandas(fetch, asked)
    return fetched.withColumns({name: F.col(name).cast("bigint") for name in ids})
