"""Files of many formats to texts and chunks.

A parser turns a file's bytes into a text and into chunks. ``PARSERS`` holds one
for each format and takes more; a format without one is read as plain text. Files
come in as ``(path, content)``, as Spark's ``binaryFile`` reader gives them, and
each is parsed by itself in one Arrow pass. A file that can't be parsed yields a
row with its ``error`` and stops nothing.
"""

from __future__ import annotations

import csv
import io
import re
import shutil
import subprocess
import tempfile
import zipfile
from collections.abc import Callable
from typing import Protocol
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.units import Chunk, Chunker, fields, pack_rows, tokens, trim
from quarry.session import small_batches, stage
from quarry.sources import html as H
from quarry.sources.pdf import read_pages

Page = tuple[int, str]


class Parser(Protocol):
    extensions: tuple[str, ...]

    def text(self, data: bytes) -> str: ...

    def chunks(self, data: bytes) -> list[tuple[Chunk, int | None]]: ...


def _plain(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _one(text: str, kind: str) -> Chunk:
    return Chunk(text, tokens(text), kind)


def _unpaged(chunks: list[Chunk]) -> list[tuple[Chunk, None]]:
    return [(c, None) for c in chunks]


def _as(kind: str, chunks: list[Chunk]) -> list[Chunk]:
    return [Chunk(c.text, c.token_count, kind, c.start, c.end) for c in chunks]


def _packed(rows: list[str], budget: int, kind: str) -> list[Chunk]:
    return [Chunk(text, n, kind) for _, _, text, n in pack_rows((("", r) for r in rows), budget)]


class TextParser:
    extensions = (".txt", ".md")

    def text(self, data: bytes) -> str:
        return _plain(data)

    def chunks(self, data: bytes):
        return _unpaged(Chunker(256, 38).chunk(_plain(data)))


class CsvParser:
    """The first record names the columns; all records have as many fields."""

    extensions = (".csv",)
    budget = 200

    def records(self, data: bytes) -> list[list[str]]:
        rows = [r for r in csv.reader(io.StringIO(_plain(data), newline=""), strict=True) if r]
        for i, r in enumerate(rows):
            if len(r) != len(rows[0]):
                raise ValueError(f"record {i + 1} has {len(r)} fields, the header has {len(rows[0])}")
        return rows

    def rows(self, records: list[list[str]]) -> list[str]:
        return [f"Row {i}: " + " | ".join(f"{h}: {c}" for h, c in zip(records[0], r)) + "\n" for i, r in enumerate(records[1:], 1)]

    def text(self, data: bytes) -> str:
        records = self.records(data)
        return "CSV Headers: " + " | ".join(records[0]) + "\n\n" + "".join(self.rows(records)) if records else ""

    def chunks(self, data: bytes):
        records = self.records(data)
        if not records:
            return []
        head = _one("CSV Document Headers: " + " | ".join(records[0]), "csv_header")
        return _unpaged([head, *_packed(self.rows(records), self.budget, "csv_rows")])


class HtmlParser:
    extensions = (".html", ".htm")

    def text(self, data: bytes) -> str:
        return H.to_text(_plain(data))

    def chunks(self, data: bytes):
        root, chunker = H.parse(_plain(data)), Chunker(256, 38)
        name = H.title(root)
        out = [_one(f"Document Title: {name}", "html_title")] if name else []
        parts = H.sections(root)
        for s in parts:
            out += _as("html_section", chunker.chunk(s))
        if not parts:
            out += _as("html_content", chunker.chunk(H.single_spaced(root.readable())))
        return _unpaged(out)


def excel_column(index: int) -> str:
    out = ""
    while index >= 0:
        index, k = divmod(index, 26)
        out, index = chr(65 + k) + out, index - 1
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class XlsxParser:
    extensions = (".xlsx",)
    budget = 150

    def sheets(self, data: bytes) -> list[tuple[str, list[list[str]]]]:
        """(name, rows of cells) of each sheet; rows and cells that are left out in the file are empty."""
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            tree = lambda name: ElementTree.fromstring(z.read(name))
            names = set(z.namelist())
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
            targets = {r.get("Id"): r.get("Target", "") for r in tree("xl/_rels/workbook.xml.rels")}
            out = []
            for sheet in (s for s in tree("xl/workbook.xml").iter() if _local(s.tag) == "sheet"):
                at = next(targets[v] for k, v in sheet.attrib.items() if _local(k) == "id" and v in targets)
                at = at.lstrip("/") if at.startswith("/") else f"xl/{at}"
                rows: list[list[str]] = []
                for row in (r for r in tree(at).iter() if _local(r.tag) == "row"):
                    number = int(row.get("r") or len(rows) + 1)
                    rows += [[] for _ in range(number - 1 - len(rows))]
                    cells: list[str] = []
                    for c in row:
                        letters = re.match("[A-Z]+", c.get("r", ""))
                        place = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                        cells += [""] * (place - len(cells))
                        value = next((v.text or "" for v in c if _local(v.tag) == "v"), "")
                        if c.get("t") == "s":
                            value = shared[int(value)]
                        elif c.get("t") == "inlineStr":
                            value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                        elif c.get("t") == "b":
                            value = "TRUE" if value == "1" else "FALSE"
                        cells.append(value)
                    while cells and not cells[-1]:
                        cells.pop()
                    rows.append(cells)
                out.append((sheet.get("name", ""), rows))
            return out

    @staticmethod
    def row(number: int, cells: list[str], header: list[str] = []) -> str:
        named = lambda i: header[i] if i < len(header) and trim(header[i]) else excel_column(i)
        return f"Row {number}: " + " | ".join(f"{named(i)}: {c}" for i, c in enumerate(cells) if trim(c)) + "\n"

    def text(self, data: bytes) -> str:
        out = []
        for name, rows in self.sheets(data):
            out.append(f"Sheet: {name}\n" + "=" * (len(name.encode()) + 7) + "\n\n")
            out += [self.row(i, cells) for i, cells in enumerate(rows, 1) if cells]
            out.append("\n")
        return "".join(out)

    def chunks(self, data: bytes):
        out = []
        for name, rows in self.sheets(data):
            out.append(_one(f"Excel Sheet: {name}", "xlsx_sheet_header"))
            filled = [(i, cells) for i, cells in enumerate(rows, 1) if any(map(trim, cells))]
            if filled:
                header = filled[0][1]
                out.append(_one(f"Sheet {name} Headers: " + " | ".join(header), "xlsx_headers"))
                out += _packed([self.row(i, cells, header) for i, cells in filled[1:]], self.budget, "xlsx_data")
        return _unpaged(out)


class DocxParser:
    extensions = (".docx",)

    def text(self, data: bytes) -> str:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        marks = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
        return "\n".join("".join(marks[_local(e.tag)](e) for e in p.iter() if _local(e.tag) in marks) for p in root.iter() if _local(p.tag) == "p")

    @staticmethod
    def kind(text: str) -> str:
        low = text.lower()
        if sum(map(low.count, T.WORD_CODE_MARKS)) > 3:
            return "code"
        return "structured" if sum(map(text.count, T.WORD_STRUCTURE_MARKS)) > 3 else "prose"

    @staticmethod
    def is_header(line: str) -> bool:
        line, words = trim(line), fields(line)
        size = lambda s: len(s.encode())
        if size(line) < 3:
            return False
        numbered = 0 < len(words) <= 8 and "." in words[0] and size(words[0]) < 6
        return line.startswith("#") or numbered or len(words) == 1 and line.upper() == line and size(line) < 50

    def structured(self, text: str, most: int) -> list[Chunk]:
        """Lines in order: a header opens a chunk, and one over the limit closes with the line that took it there."""
        out: list[tuple[list[str], int]] = []
        ended = True
        for line in filter(None, map(trim, text.split("\n"))):
            n = tokens(line)
            if ended or self.is_header(line):
                out.append(([], 0))
            lines, held = out[-1]
            lines.append(line)
            out[-1] = lines, held + n
            ended = held + n > most
        return [Chunk("\n".join(lines), held, "structured") for lines, held in out]

    def chunks(self, data: bytes):
        chunker = Chunker(320, 48)
        text = "\n".join(filter(None, map(trim, self.text(data).split("\n"))))
        kind = self.kind(text)
        if not text:
            return []
        if kind == "code":
            found = [_one(text, kind)]  # cleaning leaves no blank lines, so the text is one paragraph
        else:
            found = self.structured(text, chunker.max_tokens) if kind == "structured" else chunker.chunk(text)
        return _unpaged(_as(f"docx_{kind}", found))


PAGE_WORDS = 1600
CONTEXT_BYTES = 200


def page_chunks(pages: list[Page]) -> list[tuple[Chunk, int]]:
    """Pages as chunks; large ones are split, and the first chunk of a page begins with the end of the page before."""
    chunker, out = Chunker(1800, 200), []
    for number, text in pages:
        if not trim(text):
            continue
        n = len(fields(text))
        if n <= PAGE_WORDS:
            out.append((Chunk(text, n, "pdf_page"), number))
        else:
            out += [(_one(f"Page {number}: {c.text}", "pdf_page_section"), number) for c in chunker.chunk(text)]
    done = out[:1]
    for (before, was), (chunk, number) in zip(out, out[1:]):
        if was != number:
            context = ". ".join(trim(before.text).split(". ")[-2:])
            raw = context.encode()
            if len(raw) > CONTEXT_BYTES:
                context = raw[:CONTEXT_BYTES].decode("utf-8", "ignore") + "..."
            if context:
                chunk = _one(f"(Previous context: {context}) {chunk.text}", chunk.kind)
        done.append((chunk, number))
    return done


def page_overview(chunks: DataFrame, most: int = 1000) -> DataFrame:
    """``(document_id, text)``: the beginning of each page's chunks, marked with the page's number."""
    mark = F.concat(F.lit("[Page "), F.coalesce(F.col("page_number"), F.lit(1)).cast("string"), F.lit("] "))
    parts = chunks.select("document_id", F.struct("chunk_index", F.concat(mark, T.cut_bytes(F.col("chunk_text"), most)).alias("t")).alias("p"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "\n\n")
    return parts.groupBy("document_id").agg(joined.alias("text"))


def pdftotext(data: bytes) -> list[Page]:
    """Pages by the command-line tool, where it is installed."""
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(data)
        f.flush()
        got = subprocess.run(["pdftotext", "-layout", f.name, "-"], capture_output=True, check=True, timeout=120)
    return [(i, p) for i, p in enumerate(_plain(got.stdout).split("\f"), 1) if p.strip()]


def pdf_pages(data: bytes) -> list[Page]:
    """Pages by the command-line tool where it is installed and reads the file, else by the reader built in."""
    if shutil.which("pdftotext"):
        try:
            return pdftotext(data)
        except subprocess.SubprocessError:
            pass  # the other reader's error, if it fails too, is the file's
    return read_pages(data)


class PdfParser:
    """Pages come from ``extract``."""

    extensions = (".pdf",)

    def __init__(self, extract: Callable[[bytes], list[Page]] = pdf_pages):
        self.extract = extract

    def text(self, data: bytes) -> str:
        return "\n\n".join(p for _, p in self.extract(data) if trim(p)).strip()

    def chunks(self, data: bytes):
        return page_chunks(self.extract(data))


class ImageParser:
    """Text comes from ``read``, a client of a vision model."""

    extensions = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif")

    def __init__(self, read: Callable[[bytes], str] | None = None, chunker: Chunker | None = None):
        self.read, self.chunker = read, chunker or Chunker(1800, 200)

    def text(self, data: bytes) -> str:
        if self.read is None:
            raise RuntimeError("no reader of images is set")
        text = self.read(data)
        if not trim(text):
            raise ValueError("no text in the image")
        return text

    def chunks(self, data: bytes):
        return _unpaged(_as("image_ocr", self.chunker.chunk(self.text(data))))


PARSERS: dict[str, Parser] = {"txt": TextParser(), "csv": CsvParser(), "html": HtmlParser(), "xlsx": XlsxParser(), "docx": DocxParser(), "pdf": PdfParser(), "image": ImageParser()}


def register(kind: str, parser: Parser) -> None:
    """Set the parser of a format."""
    PARSERS[kind] = parser


def supported_formats(parsers: dict[str, Parser] | None = None) -> dict[str, list[str]]:
    return {k: list(p.extensions) for k, p in (parsers or PARSERS).items()}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of every file under ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


_PARSED = "path string, doc_type string, text string, error string, chunks array<struct<chunk_index:int,chunk_text:string,start_pos:int,end_pos:int,token_count:int,page_number:int,chunk_type:string>>"
_CHUNK_ARROW = pa.list_(pa.struct([("chunk_index", pa.int32()), ("chunk_text", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32()), ("token_count", pa.int32()), ("page_number", pa.int32()), ("chunk_type", pa.string())]))


def parse_files(files: DataFrame, chunked: bool = True, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``(path, doc_type, text, error, chunks)`` of ``files(path, content)``.

    With chunks, the text is what the chunks hold, joined by blank lines.
    """
    known = dict(parsers or PARSERS)

    def parsed(batches):
        for b in batches:
            out = {"path": [], "doc_type": [], "text": [], "error": [], "chunks": []}
            for path, kind, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                parser, text, error, rows = known.get(kind, known["txt"]), None, None, []
                try:
                    if chunked:
                        for i, (c, page) in enumerate(parser.chunks(data or b"")):
                            rows.append({"chunk_index": i, "chunk_text": c.text, "start_pos": c.start, "end_pos": c.end_pos, "token_count": c.token_count, "page_number": page, "chunk_type": c.kind})
                        text = "\n\n".join(r["chunk_text"] for r in rows)
                    else:
                        text = parser.text(data or b"")
                except Exception as e:  # a broken file is a result of its own
                    error, rows = f"{type(e).__name__}: {e}", []
                for k, v in (("path", path), ("doc_type", kind), ("text", text), ("error", error), ("chunks", rows)):
                    out[k].append(v)
            kinds = dict.fromkeys(out, pa.string()) | {"chunks": _CHUNK_ARROW}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    small_batches(files.sparkSession, rows=64)
    slim = files.select("path", T.doc_type(F.col("path")).alias("doc_type"), "content")
    return slim.mapInArrow(parsed, _PARSED)


def render_rows(table: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``(row_number, row_text)`` of a table's rows as its CSV file would be rendered; numbers follow ``order``.

    Rows are numbered by ranges of ``order``, so no task holds the whole table.
    """
    from pyspark.sql import Window

    named = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    rows = table.select(F.col(order).alias("_o"), F.array_join(named, " | ").alias("_row")).repartitionByRange("_o").withColumn("_p", F.spark_partition_id())
    rows = stage(rows, "rows")  # ranges are drawn from samples, so they are settled before they are used twice
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_o", "_row"))).join(offsets, "_p")
    number = (F.col("_k") + F.col("_before")).cast("long")
    return numbered.select(number.alias("row_number"), F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), F.col("_row"), F.lit("\n")).alias("row_text"))


def fit_image(width, height, most: int = 1120):
    """``struct<width, height>`` of an image scaled into a square of side ``most``; smaller ones stay as they are."""
    fits = (width <= most) & (height <= most)
    scaled = lambda a, b: F.when(a >= b, F.lit(most)).otherwise(F.floor(F.lit(float(most)) * a / b).cast("int"))
    return F.struct(F.when(fits, width).otherwise(scaled(width, height)).cast("int").alias("width"), F.when(fits, height).otherwise(scaled(height, width)).cast("int").alias("height"))
