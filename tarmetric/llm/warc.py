"""Web archives in ZIP packages: records written in place, read back by byte range without extraction.

A task writes its pages as one package: WARC records, each compressed by itself, in stored ZIP members of about
``MEMBER_BYTES``, and a stored index member with the place of every record. Of the records with equal payloads of at
least ``LEAST_BYTES`` bytes the one with the largest page_id holds the payload, the others refer to it.

The reader needs no extraction: it reads a package's tail, follows the end record, with ZIP64 its locator and
record, to the central directory, finds the stored members there and reads the index members. Their entries are
dealt by package and block of bytes, and each record is read by its own range. A package without an index has the
bounds of its records found by streaming through its members. Since members are stored, a record's
place in the package is its member's place plus its own.

Packages are written under a name of the attempt and moved when whole, so a lost task leaves nothing half
written; the list of packages is a written table. The folder is any store that pyarrow's file systems reach;
by default one under ``spark.checkpoint.dir``. The table of groups of equal payloads is sent to the
tasks where its counted rows are few, else joined by digest, where AQE splits a hot digest.

Cases: a null html is an empty payload; payloads below ``LEAST_BYTES`` are always kept; with equal largest page_ids
the largest url has the payload, and of rows equal in both one has it; null page_ids count as the
smallest; a null url has no target line, white space and controls in it are escaped; an empty table writes no
package; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarmetric.llm.common import few_rows, table
from tarmetric.session import materialize, scratch_path

LEAST_BYTES = 1000
MEMBER_BYTES, BLOCK_BYTES, READ_BYTES = 32 << 20, 8 << 20, 1 << 20
DATE = "2000-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_STATUS = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


# --- records ----------------------------------------------------------------------------------------------


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"


def base32_digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def warc_record(kind: str, own_id: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One record, compressed by itself. A revisit has the page's headers only."""
    block = _STATUS + str(size).encode() + b"\r\n\r\n" + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    lines += [f"WARC-Payload-Digest: {base32_digest(digest)}", "Content-Type: application/http;msgtype=response"]
    if refers_to:
        lines += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {SAME_PAYLOAD}"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a compressed record."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


# --- writing ----------------------------------------------------------------------------------------------


def record_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, digest, record_type, shared (whether its payload is referred to)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"))
    # without the payloads: equal rows first, then equal payloads
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", F.col("url").isNotNull().alias("placed"), "url")
    same = rows.where(F.col("payload_bytes") >= least).select("digest", rank.alias("rank")).groupBy("digest", "rank").agg(F.count("*").alias("n"))
    groups = same.groupBy("digest").agg(F.max(F.struct("rank", "n")).alias("top"), F.sum("n").alias("all")).where("all > 1")
    groups = materialize(groups.select("digest", F.col("top.rank").alias("first"), F.col("top.n").alias("firsts")), "payload-groups")
    met = rows.join(few_rows(groups), "digest", "left")
    own = F.col("first").isNull() | (rank == F.col("first"))
    out = ["page_id", "url", "payload", "payload_bytes", "digest"]
    shared = F.col("first").isNotNull()
    typed = met.where(F.coalesce("firsts", F.lit(1)) == 1).select(
        *out[:2], F.when(own, F.col("payload")).alias("payload"), *out[3:], F.when(own, "response").otherwise("revisit").alias("record_type"), shared.alias("shared")
    )
    if groups.where("firsts > 1").isEmpty():
        return typed
    # the largest row is there several times: one of them is the response
    several = met.where(F.col("firsts") > 1)
    others = several.where(rank != F.col("first")).select(*out[:2], F.lit(None).cast("string").alias("payload"), *out[3:], F.lit("revisit").alias("record_type"), shared.alias("shared"))
    single = several.where(rank == F.col("first")).groupBy(*out[:2], *out[3:], "firsts").agg(F.first("payload").alias("payload"))
    copies = single.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("firsts"))))
    copies = copies.select(*out[:2], F.when(F.col("copy") == 1, F.col("payload")).alias("payload"), *out[3:], F.when(F.col("copy") == 1, "response").otherwise("revisit").alias("record_type"), F.lit(True).alias("shared"))
    return typed.union(others).union(copies)


class _Sink(io.RawIOBase):
    """A forward-only file for the ZIP writer over a store's stream."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


class Package:
    """One ZIP package in the making: stored members of records, then the index."""

    def __init__(self, stream, name: str, member_bytes: int = MEMBER_BYTES):
        self.zip = zipfile.ZipFile(_Sink(stream), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.name, self.member_bytes, self.members, self.records = name, member_bytes, 0, 0
        self.held, self.size, self.index = [], 0, []

    def add(self, packed: bytes) -> None:
        self.index.append(f"{self.member} {self.size} {len(packed)}\n")
        self.held.append(packed)
        self.size += len(packed)
        self.records += 1
        if self.size >= self.member_bytes:
            self.flush()

    @property
    def member(self) -> str:
        return f"archive/data-{self.members:06d}.warc.gz"

    def _store(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data)

    def flush(self) -> None:
        if self.held:
            self._store(self.member, b"".join(self.held))
            self._store(f"indexes/index-{self.members:06d}.idx", "".join(self.index).encode())
            self.members, self.held, self.size, self.index = self.members + 1, [], 0, []

    def close(self) -> None:
        self.flush()
        self.zip.close()


def write_packages(typed: DataFrame, folder: str) -> DataFrame:
    """The written table of packages: path, records, bytes. ``typed`` as from ``record_types``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.FileSystem.from_uri(folder)
        package = stream = None
        for b in batches:
            for page_id, url, payload, size, digest, kind, shared, part in b.itertuples(index=False, name=None):
                if package is None:
                    name = f"part-{int(part):06d}.zip"
                    trial = f"{root}/.{name}.{uuid.uuid4().hex}"
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(trial)
                    package = Package(stream, name)
                # a payload that others refer to is named by its digest, all else by its place
                held = record_id(f"payload:{digest}")
                here = held if shared and kind == "response" else record_id(f"{name}:{package.records}")
                known = None if pd.isna(page_id) else int(page_id)
                package.add(warc_record(kind, here, known, url, digest, int(size), (payload or "").encode(), held if kind == "revisit" else None))
        if package:
            package.close()
            size = stream.tell()
            stream.close()
            store.move(trial, f"{root}/{name}")
            yield pd.DataFrame({"path": [name], "records": [package.records], "bytes": [size]})

    rows = typed.select("page_id", "url", "payload", "payload_bytes", "digest", "record_type", "shared", F.spark_partition_id().alias("part"))
    return materialize(rows.mapInPandas(write, "path string, records long, bytes long"), "packages")


# --- reading ----------------------------------------------------------------------------------------------


def directory(read, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, start of the data, bytes) of the members of a package; ``read(at, n)`` gives bytes of it."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end record of a ZIP package")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (found := read(locator, 20))[:4] == b"PK\x06\x07":
        record = read(struct.unpack_from("<Q", found, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator leads to no end record")
        entries, length, start = struct.unpack_from("<QQQ", record, 32)
    raw, at, members = read(start, length), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is cut short")
        method, packed, plain = *struct.unpack_from("<H", raw, at + 10), *struct.unpack_from("<II", raw, at + 20)
        names, extras, comment = struct.unpack_from("<HHH", raw, at + 28)
        header = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + names].decode("utf-8", "replace")
        wide = _wide_values(raw[at + 46 + names : at + 46 + names + extras])
        # the ZIP64 field has, in this order, only the values that are all ones in the entry
        plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
        packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
        header = wide.pop(0) if header == 0xFFFFFFFF else header
        local = read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no member at its place")
        members.append((name, method, header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed))
        at += 46 + names + extras + comment
    return members


def _wide_values(extra: bytes) -> list[int]:
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            return list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
        at += 4 + size
    return []


def record_bounds(read, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(place, bytes) of the compressed records in a stored member, found by streaming through it."""
    at, began, opened = start, start, zlib.decompressobj(31)
    while at < start + size:
        chunk = read(at, min(READ_BYTES, start + size - at))
        at += len(chunk)
        while chunk:
            opened.decompress(chunk)
            if not opened.eof:
                break
            chunk = opened.unused_data
            yield began, at - len(chunk) - began
            began, opened = at - len(chunk), zlib.decompressobj(31)
    if began < start + size:
        raise ValueError("the last record is cut short")


def package_places(read, size: int) -> Iterator[tuple[int, int]]:
    """(place, bytes) of every record of a package, from its index members or else from the records."""
    members = directory(read, size)
    held = {name: (start, n) for name, method, start, n in members if re.search(r"\.warc(\.gz)?$", name)}
    if packed := [name for name, method, _, _ in members if method and (name in held or name.endswith(".idx"))]:
        raise ValueError(f"members must be stored: {packed[0]}")
    indexed = set()
    for name, _, start, n in members:
        if name.endswith(".idx"):
            rest = b""
            for at in range(start, start + n, READ_BYTES):
                *lines, rest = (rest + read(at, min(READ_BYTES, start + n - at))).split(b"\n")
                for line in lines:
                    member, place, length = line.decode().rsplit(" ", 2)
                    indexed.add(member)
                    yield held[member][0] + int(place), int(length)
    for name, (start, n) in held.items():
        if name not in indexed:
            yield from record_bounds(read, start, n)


def record_places(packages: DataFrame, folder: str) -> DataFrame:
    """path, place, bytes of all records of the packages, dealt by package and block of bytes.

    The number of tasks follows from the bytes to be read, not from the short rows that say where.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.FileSystem.from_uri(folder)
        for b in batches:
            for path in b["path"]:
                with store.open_input_file(f"{root}/{path}") as f:
                    rows = []
                    for row in package_places(lambda at, n, f=f: f.read_at(n, at), f.size()):
                        rows.append((path, *row))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["path", "place", "bytes"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["path", "place", "bytes"])

    held = packages.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).head()
    tasks = max(1, -(-held["bytes"] // BLOCK_BYTES))
    found = packages.select("path").repartition(max(1, min(held["n"], tasks)), "path").mapInPandas(find, "path string, place long, bytes long")
    return found.repartition(tasks, "path", F.floor(F.col("place") / BLOCK_BYTES)).sortWithinPartitions("path", "place")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """record_id, record_type, page_id, url, refers_to (a record id), stated_digest, payload_bytes and payload_digest of the payload that is there.

    Each task reads the places it holds.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = stores.FileSystem.from_uri(folder)
        path, f = None, None
        for b in batches:
            rows = []
            for own, place, n in b[["path", "place", "bytes"]].itertuples(index=False, name=None):
                if own != path:
                    if f:
                        f.close()
                    path, f = own, store.open_input_file(f"{root}/{own}")
                fields, payload = parse_record(f.read_at(n, place))
                stated = fields["warc-payload-digest"].removeprefix("sha1:")
                rows.append((
                    fields["warc-record-id"], fields["warc-type"], int(fields["x-page-id"]) if "x-page-id" in fields else None, fields.get("warc-target-uri"),
                    fields.get("warc-refers-to"), base64.b32decode(stated).hex(), len(payload), hashlib.sha1(payload).hexdigest(),
                ))
            frame = pd.DataFrame(rows, columns=["record_id", "record_type", "page_id", "url", "refers_to", "stated_digest", "payload_bytes", "payload_digest"])
            yield frame.astype({"page_id": "Int64"})
        if f:
            f.close()

    return places.mapInPandas(read, "record_id string, record_type string, page_id long, url string, refers_to string, stated_digest string, payload_bytes long, payload_digest string")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response) with the payload of revisits looked up."""
    records = materialize(records, "archive-records")
    wrong = records.where((F.col("record_type") == "response") & (F.col("stated_digest") != F.col("payload_digest"))).head()
    if wrong:
        raise ValueError(f"{wrong['record_id']}: the payload does not have the stated digest")
    out = ["payload_bytes", "payload_digest"]
    kept = records.where("record_type = 'response'")
    held = kept.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), *out)
    seen = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated_digest")
    seen = seen.join(held, "refers_to", "left").select("page_id", *out, "record_type", F.col("_page").alias("refers_to"))
    return kept.select("page_id", *out, "record_type", F.lit(None).cast("long").alias("refers_to")).union(seen)


def archive_pages(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write ``pages`` as packages; the table of packages and their folder."""
    folder = folder or scratch_path(pages.sparkSession, "archives")
    if "://" not in folder:
        folder = ("file://" if folder.startswith("/") else "") + folder.replace("file:/", "file:///", 1)
    return write_packages(record_types(pages), folder), folder


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages, folder = archive_pages(table(spark, sf_dir, "pages"))
    return resolved(read_records(record_places(packages, folder), folder))


ORACLE = f"""
with page as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
first as (select html, max(page_id) as response from page where payload_bytes >= {LEAST_BYTES} group by html)
select page_id, payload_bytes, sha1(page.html) as payload_digest, case when response is null or page_id = response then 'response' else 'revisit' end as record_type,
  case when page_id <> response then response end as refers_to from page left join first on page.html = first.html"""
