"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extracting members.

`write_archives` packs pages into ZIP files, each with a stored member of gzipped WARC records and a stored index of
where each record lies. `locate` reads a package's end record, its ZIP64 locator and directory if there is one, the
central directory, and the index members, and gives spans of neighbouring records. `read_records` fetches each span
with one range read and decodes its records.

Packages by other writers are read as well: any number of stored `archive/*.warc` and `*.warc.gz` members, indexes in
any order (`.cdxj` and `.cdx` lines with JSON, plain or gzipped) that name their archive by `filename`, and records of
any type. An archive that no index names is read from its start to its end. An archive that is not stored can't be
read by ranges and is an error, as is an index line for an archive that isn't there.

Equal payloads are written once: the smallest page id of a payload (of `least_bytes` or more) is the response, other
pages are revisits that carry the digest, the length and the response's id. Only digests and ids are grouped for
this, so a payload that a third of all pages share is one row, and the pages meet it in a join that AQE can split.

Files go to a folder that all executors share, under names of their own; a task that is run again writes anew, and
only files in the manifest, which is written once, are read. pyarrow opens file:, hdfs: and s3: addresses.

Null html is an empty payload; a null url an empty one; line breaks in urls are percent-encoded. Pages with a null id
are always responses, and so are repeated rows of the smallest id. Other columns are not read. An empty table gives
no files and an empty result. Records by other writers have a null page_id; a digest that they don't give is made, and
one by another algorithm is given as it is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, new_path

MANIFEST = "path string, records long, bytes long"
SPANS = "path string, start long, bytes long, offsets array<long>, lengths array<long>"
RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to string"
# Signatures of the ZIP format and the profile of a revisit.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, whose Content-Length is the payload's, and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {_SAME}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """(page_id, url, type, payload_bytes, digest, whether the payload has that digest, refers_to)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    fields = {name.strip().lower(): value.removeprefix(" ") for name, _, value in lines}
    kind, block = fields["warc-type"], rest[: int(fields["content-length"])]
    payload, size = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    size = size if kind == "revisit" else len(payload)
    said = fields.get("warc-payload-digest")
    plain = said is None or said.lower().startswith("sha1:")
    bare = said[5:] if said and plain else said
    own = digest(payload)
    same = None if kind == "revisit" or not plain or said is None else bare.upper() == own or bare.lower() == hashlib.sha1(payload).hexdigest()
    return (fields.get("x-page"), fields.get("warc-target-uri"), kind, size, own if said is None else bare, same, fields.get("x-refers-to-page"))


def _packer(folder: str, max_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = _filesystem(folder)
        scheme = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
        done, open_ = [], None

        def begin():
            fs.create_dir(at, recursive=True)
            path = f"{at}/part-{uuid.uuid4().hex}.wacz"
            package = zipfile.ZipFile(fs.open_output_stream(path), "w", zipfile.ZIP_STORED, allowZip64=True)
            return {"path": path, "zip": package, "data": package.open("archive/data.warc.gz", "w", force_zip64=True), "size": 0, "index": []}

        def end(o):
            o["data"].close()
            with o["zip"].open("indexes/index.cdxj", "w", force_zip64=True) as f:
                for line in o["index"]:
                    f.write(line)
            stream = o["zip"].fp
            o["zip"].close()
            stream.close()
            done.append((scheme + o["path"], len(o["index"]), o["size"]))

        for batch in batches:
            for page, url, html, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                open_ = open_ or begin()
                packed = gzip.compress(record(page, url, (html or "").encode("utf-8", "surrogatepass"), refers), 4, mtime=0)
                open_["data"].write(packed)
                open_["index"].append(f"{page} {json.dumps({'offset': open_['size'], 'length': len(packed), 'filename': 'data.warc.gz'})}\n".encode())
                open_["size"] += len(packed)
                if open_["size"] >= max_bytes:
                    end(open_)
                    open_ = None
        if open_:
            end(open_)
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return run


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that revisit a smaller page with an equal payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    small = pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n")).where(F.col("n") >= least_bytes)
    shared = small.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return small.join(shared, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, max_bytes: int = 512_000_000) -> DataFrame:
    """Pages (page_id, url, html) into ZIP packages of about max_bytes; the manifest of the files."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    again = keep(first_pages(read, least_bytes), "revisits").withColumnRenamed("page_id", "p")
    sha = F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    flagged = read.withColumn("own", sha).join(again, (F.col("page_id") == F.col("p")) & (F.col("own") == F.col("sha")), "left")
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]  # a long with nulls is a float in pandas
    return keep(flagged.select(ids[0], "url", "html", ids[1]).mapInPandas(_packer(folder, max_bytes), MANIFEST), "manifest")


def _number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "little")


def directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, start of the data, stored size) of each member, from the end of a random-access file."""
    tail_at = max(0, size - 66_000)
    tail = f.read_at(size - tail_at, tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = _number(tail, end + 10, 2), _number(tail, end + 12, 4), _number(tail, end + 16, 4)
    locator = tail[max(0, end - 20) : end]
    if locator[:4] == _LOCATOR:
        end64 = f.read_at(56, _number(locator, 8, 8))
        if end64[:4] != _END64:
            raise ValueError("the ZIP64 locator points nowhere")
        count, length, start = _number(end64, 32, 8), _number(end64, 40, 8), _number(end64, 48, 8)
    central, at, out = f.read_at(length, start), 0, []
    for _ in range(count):
        if central[at : at + 4] != _CENTRAL:
            raise ValueError("the central directory is damaged")
        method, packed, plain = _number(central, at + 10, 2), _number(central, at + 20, 4), _number(central, at + 24, 4)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", central, at + 28)
        where, name = _number(central, at + 42, 4), central[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, k = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: only the fields that are full above, in this order
                spot = k + 4
                for full in ("plain", "packed", "where"):
                    if {"plain": plain, "packed": packed, "where": where}[full] == 0xFFFFFFFF:
                        value, spot = _number(extra, spot, 8), spot + 8
                        plain, packed, where = (value if full == "plain" else plain), (value if full == "packed" else packed), (value if full == "where" else where)
            k += 4 + width
        local = f.read_at(30, where)
        if local[:4] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        out.append((name, method, where + 30 + _number(local, 26, 2) + _number(local, 28, 2), packed))
        at += 46 + n_name + n_extra + n_note
    return out


def entries(index: bytes) -> Iterator[tuple[str | None, int, int]]:
    """(archive's name, offset, length) of an index's lines; other lines (of headers) have no offset."""
    for line in (gzip.decompress(index) if index[:2] == b"\x1f\x8b" else index).splitlines():
        at = line.find(b"{")
        place = json.loads(line[at:]) if at >= 0 else {}
        if "offset" in place:
            yield place.get("filename"), int(place["offset"]), int(place["length"])


def spans_of(f, size: int, span_bytes: int, gap: int = 64_000, most: int = 1000) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """(start, bytes, offsets from the start, lengths) of neighbouring records; without offsets, a whole archive."""
    archives, indexes = {}, []
    for name, method, start, stored in directory(f, size):
        if name.startswith("archive/") and name.endswith((".warc", ".warc.gz")):
            if method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} is compressed as a member")
            archives[name] = (start, stored, [])
        elif name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            if method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} is compressed as a member")
            indexes.append((start, stored))
    for start, stored in indexes:
        for name, offset, length in entries(f.read_at(stored, start)):
            named = [a for a in archives if name is None or a == name or a == f"archive/{name}"]
            if len(named) != 1:
                raise ValueError(f"an index names the archive {name}")
            archives[named[0]][2].append((offset, length))
    for base, stored, places in archives.values():
        if not places:
            yield base, stored, [], []
        first, offsets, lengths = None, [], []
        for offset, length in sorted(set(places)):
            if first is not None and (offset + length - first > span_bytes or offset - first - offsets[-1] - lengths[-1] > gap or len(offsets) >= most):
                yield base + first, offsets[-1] + lengths[-1], offsets, lengths
                first, offsets, lengths = None, [], []
            first = offset if first is None else first
            offsets.append(offset - first)
            lengths.append(length)
        if offsets:
            yield base + first, offsets[-1] + lengths[-1], offsets, lengths


def _locator(span_bytes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as f:
                    rows = [(path, *span) for span in spans_of(f, f.size(), span_bytes)]
                yield pd.DataFrame(rows, columns=["path", "start", "bytes", "offsets", "lengths"])

    return run


def _sequence(f, start: int, size: int, step: int = 4_000_000) -> Iterator[bytes]:
    """The records of an archive without an index, read piece by piece."""
    held, at, end = b"", start, start + size

    def more() -> bytes:
        nonlocal at
        piece = f.read_at(min(step, end - at), at)
        at += len(piece)
        return piece

    while held or at < end:
        held = held or more()
        if held[:1] == b"\x1f":
            plain, parts = zlib.decompressobj(31), []
            while not plain.eof:
                parts.append(plain.decompress(held))
                held = plain.unused_data if plain.eof else more()
                if not plain.eof and not held:
                    raise ValueError("an archive ends inside a record")
            yield b"".join(parts)
            continue
        while (cut := held.find(b"\r\n\r\n")) < 0 and at < end:
            held += more()
        if cut < 0:
            if held.strip():
                raise ValueError("an archive ends inside a record")
            return
        fields = (x.partition(b":") for x in held[:cut].split(b"\r\n"))
        whole = cut + 8 + next(int(v) for k, _, v in fields if k.lower() == b"content-length")
        while len(held) < whole and at < end:
            held += more()
        yield held[:whole]
        held = held[whole:]


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"digest_ok": "boolean", "payload_bytes": "Int64"})

    for batch in batches:
        for path, start, size, offsets, lengths in zip(*(batch[c] for c in ("path", "start", "bytes", "offsets", "lengths"))):
            fs, at = _filesystem(path)
            rows, held = [], 0
            with fs.open_input_file(at) as f:
                if len(offsets):
                    data = f.read_at(size, start)
                    raws = (data[o : o + n] for o, n in zip(offsets, lengths))
                    raws = (gzip.decompress(r) if r[:2] == b"\x1f\x8b" else r for r in raws)
                else:
                    raws = _sequence(f, start, size)
                for raw in raws:
                    rows.append(parse_record(raw))
                    held += 1
                    if held >= 10_000:
                        yield table(rows)
                        rows, held = [], 0
            yield table(rows)


def locate(archives: DataFrame, span_bytes: int = 4_000_000) -> DataFrame:
    """Spans of neighbouring records of the packages in column `path`."""
    return archives.select("path").mapInPandas(_locator(span_bytes), SPANS)


def read_records(archives: DataFrame, span_bytes: int = 4_000_000, task_bytes: int = 16_000_000) -> DataFrame:
    """Every record of the packages. The spans are written and dealt out evenly, to a task for each task_bytes and to
    all cores at least, so that a large package is read by many."""
    spans = keep(locate(archives, span_bytes), "spans")
    n, size = spans.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(n, max(archives.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // task_bytes))))
    out = spans.repartition(tasks).mapInPandas(_fetch, RECORDS)
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
