"""WARC archives of pages with an externally merged index.

Each task writes one archive, a gzip member for each record, and one capture run: its index entries sorted by URL key and
timestamp, with a fence (key, timestamp and position) every FENCE_EVERY entries. Runs are merged FAN_IN at a time with loser trees until
FAN_IN or fewer are left, and these for good: a merge task takes a range of (key, timestamp), seeks to its start in every run by the
fences, and merges the runs' slices. So a task opens FAN_IN runs at most, and a URL however often captured spans
several ranges. The last ranges in order are the capture history of all URLs, each capture numbered within its URL. The records
are then read back where the merged index points, dealt by stretches of READ_BYTES of an archive.

Of equal payloads of at least `min_bytes` bytes, the record with the largest identifier is a response and the others
revisit it. Names of files hold the attempt that wrote them, and only those in the manifest that Spark committed count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from itertools import chain

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartosieve.llm.exact_dedup import exact_groups
from cartosieve.llm.shared import batches_of, shared_path, shuffle_partitions, staged

FENCE_EVERY = 256
SAMPLES_PER_RUN = 16
FAN_IN = 64
RANGE_ENTRIES = 500_000
READ_BYTES = 32 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RUN = "run string, n_records long, samples array<string>"
MANIFEST = f"part int, archive string, n_bytes long, {RUN}"


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so that the next winner takes log2(k) comparisons."""

    def __init__(self, sources: list[Iterator]):
        self.sources = [iter(s) for s in sources]
        self.k = len(sources)
        self.heads = [next(s, None) for s in self.sources]
        self.losers = [-1] * max(1, self.k)
        self.winner = -1
        for i in range(self.k):
            self._play(i, first=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int, first: bool = False) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other == -1 and first:
                self.losers[node] = i
                return
            if not self._before(i, other):
                self.losers[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.winner]) is not None:
            yield head
            self.heads[self.winner] = next(self.sources[self.winner], None)
            self._play(self.winner)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the rest: https://a.example.org/x?y -> org,example,a)/x?y. Null: empty."""
    m = re.match(r"(?s)[^:/?#]*://(?:www\d*\.)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    if not m:
        return " ".join((url or "").split())
    return "%20".join((",".join(reversed(m[1].lower().split("."))) + ")" + (m[2].lower() or "/")).split())


def _header(fields: list[tuple[str, str]], body: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, when: str, refers_to: int | None, is_revisit: bool, serial: str = "0") -> bytes:
    """One gzip member. `serial` makes the record's own id unique, as rows may share a page_id or have none."""
    fields = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}:{serial}>"), ("WARC-Date", when)]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    return _gzip(_header(fields, HTTP_HEAD if is_revisit else HTTP_HEAD + payload))


def read_record(raw: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one gzip member; a response's payload is checked against its digest."""
    text = zlib.decompress(raw, 31)
    head, body = text.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name]) if fields.get(name) else None
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    n = int(fields["X-Payload-Length"])
    if kind == "response":
        payload = body[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)[1]
        if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of page {number('X-Page')} is damaged")
    return {"page_id": number("X-Page"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page")}


def _fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives and capture runs; the manifest, already committed."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        fs, path = _fs(folder)
        out, entries, at = None, [], 0
        for batch in batches:
            for page_id, url, page, refers_to, is_revisit in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], batch["is_revisit"], strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/pages-{name}.warc.gz", compression=None)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                payload = page.encode("utf-8", "surrogatepass")
                when = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))
                raw = record(page_id, url, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode(), f"{when:%Y-%m-%dT%H:%M:%SZ}", refers_to, bool(is_revisit), f"{name}-{at}")
                out.write(raw)
                entries.append((url_key(url), f"{when:%Y%m%d%H%M%S}", f"pages-{name}.warc.gz", at, len(raw)))
                at += len(raw)
        if out is None:
            return
        out.close()
        entries.sort()
        run = _RunWriter(fs, path, f"run-{name}")
        for entry in entries:
            run.add(entry)
        yield pd.DataFrame({"part": [task.partitionId()], "archive": [f"pages-{name}.warc.gz"], "n_bytes": [at]} | run.close())

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    payload = F.col("html").cast("binary")
    rows = rows.withColumn("digest", F.unhex(F.sha1(payload)))
    groups = exact_groups(rows, "page_id", F.col("digest"), F.xxhash64("html"), F.octet_length("html"), keep="largest")
    revisits = groups.where("not kept").select(F.col("page_id").alias("of_id"), F.col("digest").alias("of_digest"), F.col("keep_id").alias("refers_to")).distinct()
    judged = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest")), "left")
    is_revisit: Column = F.col("of_digest").isNotNull() & (F.octet_length("html") >= min_bytes)
    typed = judged.select("page_id", "url", "html", F.when(is_revisit, F.col("refers_to")).alias("refers_to"), is_revisit.alias("is_revisit"))
    with batches_of(pages.sparkSession, 256):
        return staged(typed.mapInPandas(write, MANIFEST), "warc-manifest")


Place = tuple[str, str]  # URL key, timestamp


class _RunWriter:
    """Writes sorted entries with their fences, and keeps about SAMPLES_PER_RUN evenly spread places of them."""

    def __init__(self, fs, path: str, name: str):
        self.fs, self.path, self.name = fs, path, name
        self.out = fs.open_output_stream(f"{path}/{name}.cdx", compression=None)
        self.fences, self.samples, self.every, self.n, self.size = [], [], 1, 0, 0

    def add(self, entry: tuple) -> None:
        if self.n % FENCE_EVERY == 0:
            self.fences.append([entry[0], entry[1], self.size])
        if self.n % self.every == 0:
            self.samples.append(json.dumps(entry[:2]))
            if len(self.samples) > 2 * SAMPLES_PER_RUN:
                self.samples, self.every = self.samples[::2], 2 * self.every
        line = json.dumps(entry, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n"
        self.out.write(line)
        self.n, self.size = self.n + 1, self.size + len(line)

    def close(self) -> dict[str, list]:
        self.out.close()
        with self.fs.open_output_stream(f"{self.path}/{self.name}.fences", compression=None) as f:
            f.write(json.dumps({"end": self.size, "fences": self.fences}).encode("utf-8", "surrogatepass"))
        return {"run": [self.name], "n_records": [self.n], "samples": [self.samples]}


def _slice(fs, path: str, run: str, low: Place | None, high: Place | None) -> Iterator[tuple]:
    """A run's entries with low <= (key, timestamp) < high."""
    with fs.open_input_stream(f"{path}/{run}.fences", compression=None) as f:
        fences = json.loads(f.read().decode("utf-8", "surrogatepass"))
    places, starts = [(k, t) for k, t, _ in fences["fences"]], [s for _, _, s in fences["fences"]]
    start = 0 if low is None or not starts else starts[max(0, bisect_left(places, low) - 1)]
    if start >= fences["end"]:
        return
    with fs.open_input_file(f"{path}/{run}.cdx") as f:
        f.seek(start)
        rest = b""
        while chunk := f.read(1 << 16):
            *lines, rest = (rest + chunk).split(b"\n")
            for line in lines:
                entry = tuple(json.loads(line.decode("utf-8", "surrogatepass")))
                if high is not None and entry[:2] >= high:
                    return
                if low is None or entry[:2] >= low:
                    yield entry


def _overlapping(run: list[dict], low: Place | None, high: Place | None) -> list[str]:
    """The files of a run, itself in ranges, that may hold places from low to high."""
    return [part["run"] for part in run if (high is None or part["low"] is None or part["low"] < high) and (low is None or part["high"] is None or low < part["high"])]


def _ranges(runs: list[list[dict]], least: int) -> list[tuple[Place | None, Place | None]]:
    """Ranges of about RANGE_ENTRIES entries of the runs together, `least` of them if there are so many places to cut at."""
    samples = sorted(tuple(json.loads(s)) for run in runs for part in run for s in part["samples"])
    n = max(1, min(len(samples), max(least, sum(part["n_records"] for run in runs for part in run) // RANGE_ENTRIES)))
    cuts = sorted({samples[i * len(samples) // n] for i in range(1, n)})
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def _dealt(spark: SparkSession, groups: list[list[list[dict]]], least: int) -> tuple[DataFrame, list[tuple]]:
    """A row for each group of runs and range of it, each in a partition of its own."""
    rows = []
    for g, runs in enumerate(groups):
        for r, (low, high) in enumerate(_ranges(runs, least)):
            rows.append((g, r, json.dumps(low), json.dumps(high), [_overlapping(run, low, high) for run in runs]))
    frame = spark.createDataFrame(rows, "group int, range_no int, low string, high string, runs array<array<string>>")
    return frame.repartition(max(1, len(rows)), "group", "range_no"), rows


def _merge(fs, path: str, row) -> LoserTree:
    low, high = (None if (place := json.loads(x)) is None else tuple(place) for x in (row.low, row.high))
    return LoserTree([chain.from_iterable(_slice(fs, path, name, low, high) for name in names) for names in row.runs])


def merged_index(spark: SparkSession, folder: str, manifest: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(range_no, position, url_key, captured, capture_no, archive, offset, length): all captures in order of URL key and timestamp.

    What the driver holds is a row and some sampled keys for each file, never entries.
    """
    listed = sorted(manifest.collect(), key=lambda r: r["part"])  # a row for each archive
    runs = [[{"run": r["run"], "n_records": r["n_records"], "samples": r["samples"], "low": None, "high": None}] for r in listed]
    level = 0

    def merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _fs(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                out = _RunWriter(fs, path, f"merged-{level}-{row.group}-{row.range_no}-{TaskContext.get().taskAttemptId()}")
                for entry in _merge(fs, path, row):
                    out.add(entry)
                yield pd.DataFrame({"group": [row.group], "range_no": [row.range_no]} | out.close())

    while len(runs) > fan_in:
        level += 1
        groups = [runs[i : i + fan_in] for i in range(0, len(runs), fan_in)]
        dealt, rows = _dealt(spark, groups, 1)
        made = {(r["group"], r["range_no"]): r for r in staged(dealt.mapInPandas(merge_runs, f"group int, range_no int, {RUN}"), "warc-level").collect()}
        runs = [[] for _ in groups]
        for g, r, low, high, _ in rows:
            low, high = (None if (place := json.loads(x)) is None else tuple(place) for x in (low, high))
            runs[g].append({"run": made[g, r]["run"], "n_records": made[g, r]["n_records"], "samples": made[g, r]["samples"], "low": low, "high": high})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _fs(folder)
        columns = ["range_no", "position", "url_key", "captured", "nth", "archive", "offset", "length"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                before, nth, held = None, 0, []
                for position, (key, when, archive, offset, length) in enumerate(_merge(fs, path, row)):
                    nth = nth + 1 if key == before else 1
                    before = key
                    held.append((row.range_no, position, key, when, nth, archive, offset, length))
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    dealt, _ = _dealt(spark, [runs] if runs else [], shuffle_partitions(spark))
    index = staged(dealt.mapInPandas(merge, "range_no int, position long, url_key string, captured string, nth long, archive string, offset long, length long"), "warc-index")
    # a URL whose captures begin in earlier ranges goes on counting: only the first URL of a range can
    firsts = index.where("position = 0").select("url_key", F.col("range_no").alias("to"))
    parts = index.join(F.broadcast(firsts.select("url_key").distinct()), "url_key").groupBy("url_key", "range_no").agg(F.count(F.lit(1)).alias("n"))  # at most a row for each range
    earlier = firsts.join(parts, "url_key").where("range_no < to").groupBy("url_key", F.col("to").alias("range_no")).agg(F.sum("n").alias("earlier"))
    return index.join(F.broadcast(earlier), ["url_key", "range_no"], "left").select("range_no", "position", "url_key", "captured", (F.col("nth") + F.coalesce("earlier", F.lit(0))).alias("capture_no"), "archive", "offset", "length")


def read_archives(index: DataFrame, folder: str, n_bytes: int) -> DataFrame:
    """The records that the index points at: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, capture_no.

    n_bytes, the size of all archives, sets the number of tasks.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _fs(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for entry in batch.itertuples(index=False):
                if entry.archive != name:
                    name, source = entry.archive, fs.open_input_file(f"{path}/{entry.archive}")
                source.seek(entry.offset)
                rows.append(read_record(source.read(entry.length)) | {"url_key": entry.url_key, "captured": entry.captured, "capture_no": entry.capture_no})
            found = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_no"])
            yield found.astype({"page_id": "Int64", "refers_to": "Int64"})

    tasks = max(shuffle_partitions(index.sparkSession), n_bytes // READ_BYTES)
    stretch = F.floor(F.col("offset") / READ_BYTES)
    ordered = index.select("archive", "offset", "length", "url_key", "captured", "capture_no").repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "offset")
    return ordered.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured string, capture_no long")


def archive_pages(pages: DataFrame, min_bytes: int = 0, folder: str | None = None, fan_in: int = FAN_IN, **columns: str) -> DataFrame:
    """Writes the archives, merges their runs and reads the records back, a row for each page.

    Null html is an empty payload; a null url has no target and an empty key. Rows with a null page_id lose against others of their payload;
    where all have none, all are responses. Rows with equal page_id and payload are marked alike; each is a record with an id of its own.
    An empty table gives no rows; other columns are not looked at.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    manifest = write_archives(pages, folder, min_bytes, **columns)
    n_bytes = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    return read_archives(merged_index(spark, folder, manifest, fan_in), folder, n_bytes)
