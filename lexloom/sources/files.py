"""Binary documents: type sniffing, upload checks, and page extraction."""

from __future__ import annotations

import functools
import io
import itertools
import os
import pickle
import re
import select
import signal
import struct
import subprocess
import sys
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import fixed, text
from . import pdf

LANDED = "path string, length long"
PAGES = "path string, page_number int, text string, ocr_derived boolean, status string"
EXTRACT_TIMEOUT_S = 120
#: A file is dealt to one task for each so many bytes.
PART_BYTES = 16 << 20
#: A task gives its pages on once it holds so many characters of them; a batch of files may hold thousands.
HELD_CHARS = 4 << 20
#: Files that a trigger of a landing folder takes at most; each trigger starts its own processes and lists its own files, so many small ones cost more.
FILES_PER_TRIGGER = 50_000
#: Entries of a folder that a listing task gives on at a time.
LISTED_ROWS = 10_000
_DOCX = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: Gives the pages of a file; a page may be a function that gives its text, and one that fails is an empty page.
Parser = Callable[[bytes], list]


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content); Spark's scan skips files without bytes."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def sniff(content: Column, path: Column) -> Column:
    """pdf, docx, or null, by the first bytes (and the suffix for docx)."""
    start = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(start(5) == "255044462D", "pdf").when((start(4) == "504B0304") & F.lower(path).endswith(".docx"), "docx")


def validate_upload(files: DataFrame, cap: int = fixed.MAX_UPLOAD_BYTES) -> DataFrame:
    """Adds ``kind`` and ``verdict`` (ok, or the reason for which a file is refused)."""
    verdict = F.when(F.col("length") == 0, "empty").when(F.col("length") > cap, "too large").when(F.col("kind").isNull(), "unsupported").otherwise("ok")
    return files.withColumn("kind", sniff(F.col("content"), F.col("path"))).withColumn("verdict", verdict)


def docx_pages(content: bytes) -> list[str]:
    """One page: the paragraphs joined by line breaks."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["\n".join("".join(t.text or "" for t in p.iter(f"{_DOCX}t")) for p in root.iter(f"{_DOCX}p"))]


def plain_pdf_pages(content: bytes) -> list:
    """Literal strings of the content streams, plain or deflated, a page per stream: for files that have streams and no objects."""

    def shown(stream: bytes, packed: bool) -> str:
        body = zlib.decompress(stream.strip(b"\r\n")) if packed else stream
        return "\n".join(re.sub(rb"\\(.)", rb"\1", t).decode("latin-1") for t in re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", body))

    found = re.findall(rb"(/FlateDecode[^>]*>>\s*)?stream\r?\n(.*?)endstream", content, re.S)
    return [functools.partial(shown, stream, bool(packed)) for packed, stream in found]


def pdf_pages(content: bytes) -> list:
    """Pages of the page tree (``pdf.pages``); of a file without any, the literal strings of each stream."""
    return pdf.pages(content) or plain_pdf_pages(content)


PARSERS: dict[str, Parser] = {"pdf": pdf_pages, "docx": docx_pages}

#: Seconds an extraction process may take to load its parsers; a file's own limit begins after that.
START_TIMEOUT_S = 60.0

#: What an extraction process runs: a byte once its parsers are loaded, then length-prefixed pickles in and out, one for each file.
_CHILD = """
import pickle, struct, sys
def take(n):
    data = sys.stdin.buffer.read(n)
    if len(data) < n:
        sys.exit(0)
    return data
out, sys.stdout = sys.stdout.buffer, sys.stderr
sys.path[:0] = pickle.loads(take(*struct.unpack(">Q", take(8))))
parsers = pickle.loads(take(*struct.unpack(">Q", take(8))))
out.write(b"1")
out.flush()
while True:
    kind, content, part, parts = pickle.loads(take(*struct.unpack(">Q", take(8))))
    try:
        pages = []
        found = parsers[kind](content)
        first = len(found) * part // parts
        for page in found[first : len(found) * (part + 1) // parts]:
            try:
                pages.append(page() if callable(page) else page)
            except Exception:
                pages.append("")
        answer = "ok", pages, first
    except Exception as error:
        answer = f"failed: {type(error).__name__}", [], 0
    data = pickle.dumps(answer)
    out.write(struct.pack(">Q", len(data)) + data)
    out.flush()
"""


class _Extractor:
    """A process that parses files for a task; a late one is killed with all that it has started, and replaced."""

    def __init__(self, parsers: dict[str, Parser]):
        self.parsers, self.process = cloudpickle.dumps(parsers), None

    def _send(self, data: bytes) -> None:
        self.process.stdin.write(struct.pack(">Q", len(data)) + data)
        self.process.stdin.flush()

    def _take(self, n: int, deadline: float) -> bytes:
        data = b""
        while len(data) < n:
            ready, _, _ = select.select([self.process.stdout], [], [], max(0.0, deadline - time.monotonic()))
            if not ready:
                raise TimeoutError
            more = os.read(self.process.stdout.fileno(), min(n - len(data), 1 << 20))
            if not more:
                raise EOFError
            data += more
        return data

    def pages(self, kind: str, content: bytes, timeout_s: float, part: int = 0, parts: int = 1) -> tuple[str, list[str], int]:
        """(status, texts, pages before them) of one of ``parts`` equal ranges of the pages: ok, timeout, crashed (the process ended without an answer), or failed with the error's name."""
        try:
            if self.process is None:
                self.process = subprocess.Popen([sys.executable, "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, start_new_session=True)
                self._send(pickle.dumps(sys.path))
                self._send(self.parsers)
                self._take(1, time.monotonic() + START_TIMEOUT_S)
            self._send(pickle.dumps((kind, content, part, parts)))
            deadline = time.monotonic() + timeout_s
            return pickle.loads(self._take(*struct.unpack(">Q", self._take(8, deadline)), deadline))
        except TimeoutError:
            self.close()
            return "timeout", [], 0
        except (EOFError, OSError):
            self.close()
            return "crashed", [], 0

    def close(self) -> None:
        if self.process is not None:
            try:
                os.killpg(self.process.pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
            self.process.wait()
            self.process.stdin = self.process.stdout = None
            self.process = None


def clean_utf8(value: str) -> str:
    """Characters that UTF-8 cannot hold (lone surrogates) become question marks."""
    return value.encode("utf-8", "replace").decode()


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or a local path, and the path in it."""
    at = re.sub(r"^file:/+", "/", path)
    return (pa.fs.LocalFileSystem(), at) if at.startswith("/") else pa.fs.FileSystem.from_uri(path)


def _read(path: str) -> tuple[str | None, bytes]:
    """(kind, content) of a file, the kind by its first bytes as in ``sniff``."""
    system, at = file_system(path)
    with system.open_input_stream(at) as f:
        content = f.read()
    pdf, docx = content.startswith(b"%PDF-"), content.startswith(b"PK\x03\x04") and path.lower().endswith(".docx")
    return "pdf" if pdf else "docx" if docx else None, content


def page_ranges(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, part, parts) from (path, length): a large file is several ranges of pages, dealt to tasks of their own.

    The number of tasks is fixed by the cores: rows of paths are so small that Spark would otherwise put all of them, and so the parsing, in one task.
    """
    tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
    parts = F.greatest(F.lit(1), F.ceil(F.col("length") / part_bytes)).cast("int")
    return files.select("path", parts.alias("parts")).select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts").repartition(tasks, "path", "part")


def extract_pages(files: DataFrame, parsers: dict[str, Parser] | None = None, timeout_s: float = EXTRACT_TIMEOUT_S) -> DataFrame:
    """One row a page from (path, content, kind), or from ``page_ranges``, whose tasks open the files themselves.

    A file (or range) that fails, crashes, takes too long or is of no known kind gives one row with its status, with page number 1, or
    null for a range that is not the first. Parsers run in a process of their own, so a file that hangs in foreign code or
    ends the process costs only itself. A page that fails is empty.
    """
    parsers = parsers or PARSERS
    ranged = "part" in files.columns

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string())
        columns = zip(*rows) if rows else ([] for _ in kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["path", "page_number", "text", "ocr_derived", "status"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = _Extractor(parsers)
        try:
            for batch in batches:
                rows, held = [], 0
                for k in range(batch.num_rows):
                    path, second, third = (batch.column(c)[k].as_py() for c in range(3))
                    part, parts = (second, third) if ranged else (0, 1)
                    kind, content = _read(path) if ranged else (third, second or b"")
                    status, pages, before = ("unsupported", [], 0) if ranged and kind is None else extractor.pages(kind, content, timeout_s, part, parts)
                    rows += [(path, n, clean_utf8(t), False, status) for n, t in enumerate(pages, before + 1)] if status == "ok" else [(path, None if part else 1, "", False, status)]
                    held += sum(map(len, pages))
                    if held > HELD_CHARS:
                        yield packed(rows)
                        rows, held = [], 0
                yield packed(rows)
        finally:
            extractor.close()

    return files.select(*(("path", "part", "parts") if ranged else ("path", "content", "kind"))).mapInArrow(run, PAGES)


def _entries(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, is a folder) of what is in a folder and not hidden, by Spark's rules for names. A local folder is read entry by entry; other systems give one list a folder."""
    system, at = file_system(folder)
    hidden = lambda name: name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")
    if isinstance(system, pa.fs.LocalFileSystem):
        with os.scandir(at) as found:
            for entry in found:
                if not hidden(entry.name):
                    try:
                        deeper = entry.is_dir()
                        yield f"file:{at.rstrip('/')}/{entry.name}", 0 if deeper else entry.stat().st_size, deeper
                    except FileNotFoundError:  # gone since the folder was read
                        pass
    else:
        for info in system.get_file_info(pa.fs.FileSelector(at)):
            if not hidden(info.base_name):
                yield folder.removesuffix(at) + info.path, info.size or 0, info.type == pa.fs.FileType.Directory


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of all files below a folder, listed in tasks, one for each folder: the driver sees only how many folders a level has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                entries = _entries(at)
                while rows := list(itertools.islice(entries, LISTED_ROWS)):
                    columns = (pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_())))
                    yield pa.RecordBatch.from_arrays(list(columns), names=["path", "length", "deeper"])

    cores, level, found = spark.sparkContext.defaultParallelism, spark.createDataFrame([(folder.rstrip("/"),)], "path string"), []
    while True:
        found.append(storage.stored(level.mapInArrow(run, "path string, length long, deeper boolean"), "listed"))
        level = found[-1].filter("deeper").select("path").repartition(2 * cores, "path")
        if level.isEmpty():
            return functools.reduce(DataFrame.union, (f.filter("NOT deeper").select("path", "length") for f in found))


def find_landed(spark: SparkSession, folder: str, log: str, rows: int = FILES_PER_TRIGGER) -> int:
    """Adds the files of a folder that are not in its ``log`` to it, as Parquet files of about ``rows`` rows (path, length) each. Gives their number.

    One search of a log runs at a time. One that died has published some of its files whole; the next adds the others.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(log)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    known = spark.read.schema(LANDED).parquet(log).select("path")
    new = storage.stored(list_files(spark, folder).join(known, "path", "left_anti"), "landed")
    if n := new.count():
        new.repartition(-(-n // rows)).write.mode("append").parquet(log)
    return n


def landing_pages(spark: SparkSession, folder: str, parsers: dict[str, Parser] | None = None, part_bytes: int = PART_BYTES, files_per_trigger: int = FILES_PER_TRIGGER, log: str | None = None) -> DataFrame:
    """A stream of the pages of files that land in a folder, each file once.

    Only paths and sizes go through the source; contents are read by the tasks of their ranges. With a ``log`` (a folder of its own, kept as
    long as the checkpoint) files are found by ``find_landed``, here once and later whenever it is called, and the stream follows the log: the driver holds one entry for
    ``files_per_trigger`` files. Without it Spark's file source looks into the folder at each trigger; its driver lists and remembers every file, so that is for folders of some 100,000 files at most.
    """
    if log is None:
        schema = "path string, modificationTime timestamp, length long, content binary"
        source = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    else:
        find_landed(spark, folder, log, files_per_trigger)
        source = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", 1).parquet(log)
    return extract_pages(page_ranges(source.select("path", "length"), part_bytes), parsers)


def write_files(files: DataFrame, folder: str) -> int:
    """Write (name, content) rows as files of a folder, in tasks; a file appears whole, by a rename. Gives their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = file_system(folder)
        system.create_dir(at, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                hidden = f"{at}/.{name}-{os.getpid()}-{time.monotonic_ns()}"
                with system.open_output_stream(hidden) as f:
                    f.write(content)
                system.move(hidden, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def ocr_confidence(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, mean_conf) over recognised words (conf, text); null where none can be scored."""
    good = (F.col("conf") != -1) & (F.trim("text") != "")
    return words.groupBy(*keys).agg(F.avg(F.when(good, F.col("conf"))).alias("mean_conf"))


def with_ocr(pages: DataFrame, ocr: DataFrame, *keys: str) -> DataFrame:
    """Pages with under 50 characters take the recognised text (keys, ocr_text, mean_conf) if it is accepted; a page without text is an empty one."""
    df = pages.withColumn("text", F.coalesce("text", F.lit(""))).join(ocr, list(keys), "left")
    use = (F.length(text.strip(F.col("text"))) < fixed.MIN_PAGE_CHARS) & (text.page_verdict(F.col("ocr_text"), F.col("mean_conf")) == "ok")
    return df.select(*keys, F.when(use, text.strip(F.col("ocr_text"))).otherwise(F.col("text")).alias("text"), use.alias("ocr_derived"))


def html_text(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and comments go, block ends become line breaks, entities are resolved."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|header|footer|nav|ul|ol|table|title)\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != ""), "\n")
