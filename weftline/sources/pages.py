"""Documents to pages and chunks.

A page decoder is a function of bytes that returns page texts, so that a PDF
library can be plugged in where there is one; text tables need none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import slices, workers_find_us

CHUNK_SIZE = 1200
_HYPHEN = re.compile(r"(\w+)-\n(\w+)")
_BLANKS = re.compile(r"[ \t]+")


def _cut(text: str, start: int, size: int) -> int:
    """Where a full buffer from `start` on ends: at its last blank line, else its last sentence end, else after `size`."""
    for mark in ("\n\n", ". "):
        at = text.rfind(mark, start, start + size)
        if at >= 0:
            return at if at > start else start + size  # a cut that takes nothing counts as none
    return start + size


def split_pages(pages: list[str | None], size: int = CHUNK_SIZE) -> Iterator[tuple[int, int, int, str]]:
    """(index, first page, last page, text) of the chunks of a document.

    The cleaned pages are one text with blank lines between them. While `size` characters
    or more are left, the text is cut; a chunk's last page is the one that filled its
    buffer, the document's last for the rest.
    """
    cleaned = [(n, _BLANKS.sub(" ", _HYPHEN.sub(r"\1\2", (page or "").strip()))) for n, page in enumerate(pages, 1)]
    numbers, texts = zip(*[x for x in cleaned if x[1]] or [(1, "")])
    whole = "\n\n".join(texts)
    ends = list(accumulate((len(t) for t in texts), lambda end, n: end + 2 + n))
    page_at = lambda offset: numbers[min(bisect_left(ends, offset), len(ends) - 1)]
    start, index, last = 0, 0, 0
    while start < len(whole):
        first, full = max(last, page_at(start + 1)), len(whole) - start >= size
        stop, last = (_cut(whole, start, size), page_at(start + size)) if full else (len(whole), len(pages))
        if chunk := whole[start:stop].strip():
            yield index, first, last, chunk
            index += 1
        start = len(whole) - len(whole[stop:].lstrip())


def chunk_documents(docs: DataFrame, *, text_col: str = "text", name_col: str | None = None, size: int = CHUNK_SIZE, separator: str = "\f") -> DataFrame:
    """Chunks of a text table: id, doc_hash, index, page_start, page_end, text, filename.

    The hash is the SHA-256 of the text's bytes; form feeds part pages. A narrow map.
    """
    workers_find_us(docs.sparkSession)
    name = F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")
    base = docs.select(F.sha2(F.col(text_col), 256).alias("doc_hash"), name.alias("filename"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in (piece for whole in batches for piece in slices(whole)):
            rows = []
            for h, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                for i, a, z, chunk in split_pages((text or "").split(separator), size):
                    rows.append((f"{h[:16]}_{i}" if h else None, h, i, a, z, chunk, n))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["id", "doc_hash", "index", "page_start", "page_end", "text", "filename"])

    return base.mapInArrow(run, "id string, doc_hash string, index int, page_start int, page_end int, text string, filename string")


def load_files(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]], *, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of binary files under `path`; `decode` gives the page texts of one file's bytes."""
    workers_find_us(spark)
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("doc_hash"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")

    def run(batches):
        for batch in batches:
            rows = []
            for h, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                pages = decode(raw)
                rows += [(f"{h[:16]}_{i}", h, i, a, z, chunk, n, len(pages)) for i, a, z, chunk in split_pages(pages, size)]
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["id", "doc_hash", "index", "page_start", "page_end", "text", "filename", "pages"])

    return files.mapInArrow(run, "id string, doc_hash string, index int, page_start int, page_end int, text string, filename string, pages int")


def document_rows(docs: DataFrame, *, text_col: str = "text", name_col: str = "doc_id") -> DataFrame:
    """One row per distinct content: file_hash, the smallest name, and how many copies there are."""
    return docs.groupBy(F.sha2(F.col(text_col), 256).alias("file_hash")).agg(F.min(F.col(name_col)).alias("filename"), F.count(F.lit(1)).alias("copies"))


def not_yet_known(docs: DataFrame, known: DataFrame, *, hash_col: str = "file_hash") -> DataFrame:
    """Rows whose content hash is not among the known documents."""
    return docs.join(known.select(hash_col).distinct(), hash_col, "left_anti")


def pdf_pages(raw: bytes) -> list[str]:
    """Page texts of a PDF by an installed library (pypdf or pdfplumber), else by the reader for text PDFs in pdf.py."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            import pdfplumber
        except ImportError:
            from weftline.sources.pdf import page_texts

            return page_texts(raw)
        with pdfplumber.open(io.BytesIO(raw)) as found:
            return [page.extract_text() or "" for page in found.pages]
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages]


def load_pdf(spark: SparkSession, path: str, *, size: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of the PDF files under `path`."""
    return load_files(spark, path, pdf_pages, size=size)
