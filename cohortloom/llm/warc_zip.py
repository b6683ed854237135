"""WARC records in ZIP archives, read back by range (op 6).

Each task packs its records into archives of bounded size in the shared folder: one stored member per
record and a last member ``index.cdxj``. Archives are found by their end record (and ZIP64 end
record), members by the central directory; reads fetch the directory, the index and one record at a
time, never the whole archive, and nothing is extracted to disk.

Records with equal payloads of at least ``least_bytes`` bytes: the one with the largest page_id is the
response, the others are revisits of it. Null html counts as empty. Null page_id sorts below all
others. Rows with one page_id are records of their own. An empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C

LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def pack_zip(members: list[tuple[str, bytes]], zip64: bool = False) -> tuple[bytes, list[int]]:
    """A ZIP archive of stored members, and where each local header starts. ``zip64`` forces the wide records."""
    out, central, starts, at = [], [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or n >= FULL32 or at >= FULL32
        size = FULL32 if wide else n
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        head = LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra
        far = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central.append(
            CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(far), 0, 0, 0, 0, FULL32 if wide else at) + raw + far
        )
        starts.append(at)
        out += [head, data]
        at += len(head) + n
    directory = b"".join(central)
    wide, n = zip64 or at >= FULL32 or len(members) >= FULL16, len(members)
    out.append(directory)
    if wide:
        out.append(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at))
        out.append(LOCATOR + struct.pack("<IQI", 0, at + len(directory), 1))
    out.append(END + struct.pack("<HHHHIIH", 0, 0, FULL16 if wide else n, FULL16 if wide else n, FULL32 if wide else len(directory), FULL32 if wide else at, 0))
    return b"".join(out), starts


class Archive:
    """Members of a ZIP archive behind ``read_at(offset, length)``."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65_557)
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no end of central directory")
        _, _, _, count, length, start, _ = struct.unpack("<HHHHIIH", tail[end + 4 : end + 22])
        if count == FULL16 or length == FULL32 or start == FULL32:
            place = tail_at + end - 20
            if place < 0 or (found := read_at(place, 20))[:4] != LOCATOR:
                raise ValueError("no ZIP64 locator")
            (far,) = struct.unpack("<Q", found[8:16])
            record = read_at(far, 56)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end record")
            count, length, start = struct.unpack("<QQQ", record[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        directory, at = read_at(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            method = struct.unpack("<H", directory[at + 10 : at + 12])[0]
            crc, packed, n, names, extras, notes = struct.unpack("<IIIHHH", directory[at + 16 : at + 34])
            local = struct.unpack("<I", directory[at + 42 : at + 46])[0]
            name = directory[at + 46 : at + 46 + names].decode()
            extra, k = directory[at + 46 + names : at + 46 + names + extras], 0
            while k + 4 <= len(extra):
                kind, m = struct.unpack("<HH", extra[k : k + 4])
                if kind == 1:
                    wide = [x[0] for x in struct.iter_unpack("<Q", extra[k + 4 : k + 4 + m // 8 * 8])]
                    if n == FULL32:
                        n = wide.pop(0)
                    if packed == FULL32:
                        packed = wide.pop(0)
                    if local == FULL32:
                        local = wide.pop(0)
                k += 4 + m
            if method == 0:  # only stored members can be read by range
                self.members[name] = (local, n, crc)
            at += 46 + names + extras + notes

    def read(self, name: str) -> bytes:
        local, n, crc = self.members[name]
        head = self.read_at(local, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"no local header for {name}")
        names, extras = struct.unpack("<HH", head[26:30])
        data = self.read_at(local + 30 + names + extras, n)
        if zlib.crc32(data) != crc:
            raise ValueError(f"damaged member {name}")
        return data


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers of its page but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page}:{digest}:{kind}")
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    head += [f"X-Page-ID: {'' if page is None else page}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"X-Refers-To-Page-ID: {'' if refers is None else refers}"]
    head += [f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response" and (len(payload) != said or "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]):
        raise ValueError("damaged payload")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "payload": payload if fields["WARC-Type"] == "response" else None,
        "payload_bytes": said, "payload_digest": fields["WARC-Payload-Digest"][5:], "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("X-Refers-To-Page-ID", "")),
    }


def write_archives(pages: DataFrame, least_bytes: int = 1000, most_bytes: int = 8 << 20, zip64: bool = False) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives; one row per archive: ``path, bytes, records``."""
    folder = f"{C.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size")
    )
    least = F.lit(-(1 << 63))
    # The response of a payload: the largest page_id. Repeated rows of that page_id are responses too.
    shared = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.max(F.coalesce("page_id", least)).alias("owner"), F.count("*").alias("n"))
    shared = C.stored(shared.filter("n > 1").drop("n"), "warc-shared")
    rows = rows.join(shared, "digest", "left")
    own = F.col("owner").isNull() | (F.col("size") < least_bytes) | (F.col("owner") == F.coalesce("page_id", least))
    rows = rows.select("page_id", "url", "html", "digest", F.when(own, "response").otherwise("revisit").alias("kind"), F.when(~own, F.col("owner")).alias("refers"))

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        task, number, members, index, size, done = TaskContext.get(), 0, [], [], 0, []

        def close():
            nonlocal number, members, index, size
            data, starts = pack_zip([*members, ("index.cdxj", "\n".join(index).encode())], zip64)
            path = f"{root}/part-{task.partitionId():06d}-{number:04d}.zip"
            trial = f"{path}.attempt-{task.taskAttemptId()}"
            with store.open_output_stream(trial) as f:
                f.write(data)
            store.move(trial, path)  # a second attempt puts equal bytes in the same place
            done.append((path, len(data), len(members)))
            number, members, index, size = number + 1, [], [], 0

        store.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                raw = record(r["kind"], r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers"])
                name = f"records/{len(members):08d}.warc"
                members.append((name, raw))
                index.append(json.dumps({"member": name, "type": r["kind"], "digest": r["digest"], "page_id": r["page_id"]}))
                size += len(raw)
                if size >= most_bytes:
                    close()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "bytes", "records"])
                done.clear()
        if members:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "bytes", "records"])

    found = C.stored(rows.mapInArrow(write, "path string, bytes long, records long"), "warc-archives")
    return found.withColumn("folder", F.lit(folder))


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record the indexes name: ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``."""

    def read(batches):
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            for r in batch.to_pylist():
                folder = r["folder"]
                store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                with store.open_input_file(r["path"]) as f:

                    def read_at(at, n, f=f):
                        f.seek(at)
                        return f.read(n)

                    zipped, out = Archive(read_at, r["bytes"]), []
                    for line in zipped.read("index.cdxj").decode().splitlines():
                        out.append(parse(zipped.read(json.loads(line)["member"])))
                        if len(out) == 256:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema)

    spread = max(1, archives.sparkSession.sparkContext.defaultParallelism * 4)
    return archives.repartition(spread, "path").mapInArrow(
        read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
