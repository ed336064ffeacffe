"""Raw artifacts: a store that never overwrites by default, their registration, and boundaries to fetchers and recognizers."""

from __future__ import annotations

import os
import tempfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docustrata.functions.scores import layer_score
from docustrata.functions.text import mime_type


class RawStore:
    """Files below one root; a path that leads out of it is refused."""

    def __init__(self, root: str) -> None:
        self.root = os.path.realpath(root)

    def path(self, relative: str) -> str:
        full = os.path.realpath(os.path.join(self.root, relative))
        if os.path.commonpath([self.root, full]) != self.root or full == self.root:
            raise ValueError(f"{relative!r} leads out of the store")
        return full

    def save(self, relative: str, data: bytes | str, overwrite: bool = False) -> str:
        full = self.path(relative)
        if os.path.exists(full) and not overwrite:
            raise FileExistsError(relative)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        fd, temporary = tempfile.mkstemp(dir=os.path.dirname(full), prefix=".new-")
        with os.fdopen(fd, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
        os.replace(temporary, full)
        return full

    def read(self, relative: str) -> bytes:
        with open(self.path(relative), "rb") as f:
            return f.read()

    def exists(self, relative: str) -> bool:
        return os.path.exists(self.path(relative))

    def cleanup(self) -> int:
        """Remove what interrupted saves left; returns how many files."""
        left = [os.path.join(d, f) for d, _, fs in os.walk(self.root) for f in fs if f.startswith(".new-")]
        for f in left:
            os.remove(f)
        return len(left)


def registered(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Artifacts of a store with the columns of raw_artifacts; the first path element is the version, the extension the type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    relative = F.regexp_replace("path", f"^(?:[a-z]+:/*)?/*{os.path.realpath(root).strip('/')}/", "")
    rows = files.select(relative.alias("relative_path"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("checksum_sha256"))
    kind = F.coalesce(F.nullif(F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1)), F.lit("")), F.lit("unknown"))
    return rows.select(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("version_id"), kind.alias("artifact_type"), "relative_path", mime_type(F.col("relative_path")).alias("mime_type"), "file_size", "checksum_sha256")


def best_artifacts(artifacts: DataFrame) -> DataFrame:
    """The artifact to read of each version: recognized text first, then HTML, then the largest, then the least path."""
    rank = F.struct((F.col("artifact_type") == "ocr").alias("o"), F.contains("relative_path", F.lit("html")).alias("h"), F.col("file_size").alias("s"), F.xxhash64("relative_path").alias("x"))
    return artifacts.groupBy("version_id").agg(F.max_by(F.struct("artifact_type", "relative_path"), rank).alias("b")).select("version_id", "b.artifact_type", "b.relative_path")


def through(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through an outside program (fetcher, PDF reader, recognizer, model), a batch at a time; ``work`` is the boundary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield work(batch)

    return df.mapInPandas(run, schema)


class FetchError(Exception):
    """A page that couldn't be fetched, after all tries."""


def fetching(get: Callable[[str], tuple[int, bytes]], per_second: float = 2.0, tries: int = 3, clock=time.monotonic, sleep=time.sleep) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The work of a fetcher for ``through``: rows with a url -> url, status, body, error.

    ``get`` gives status and body, or raises OSError (tried again, ``tries`` times in all). Requests of one task keep ``per_second``; a status of 400
    or more is an error of its row, not of the query.
    """

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        out, last = [], None
        for url in batch["url"]:
            status, body, error = None, None, None
            for attempt in range(tries):
                if last is not None and (wait := last + 1 / per_second - clock()) > 0:
                    sleep(wait)
                last = clock()
                try:
                    status, body = get(url)
                    error = f"status {status}" if status >= 400 else None
                    break
                except OSError as e:
                    error = f"{type(e).__name__} after {attempt + 1} tries"
            out.append((url, status, None if error else body, error))
        return pd.DataFrame(out, columns=["url", "status", "body", "error"])

    return work


FETCHED = "url string, status int, body binary, error string"


def pdf_texts(files: DataFrame, pages_of: Callable[[bytes], list[str]], least: float = 0.5) -> DataFrame:
    """Texts of PDF files (path, content) by a reader of pages: path, combined_text, n_pages, text_layer_score, needs_ocr.

    Pages are squeezed line by line and parted by a blank line; a text layer below ``least`` asks for recognition. A file that the reader
    refuses has no pages.
    """

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                pages = pages_of(bytes(content)) if content is not None else []
            except Exception:  # noqa: BLE001 - whatever a reader makes of a broken file
                pages = []
            kept = ["\n".join(filter(None, (" ".join(x.split()) for x in p.splitlines()))) for p in pages]
            text = "\n\n".join(filter(None, kept))
            out.append((path, text, len(pages), len(text), sum(c.isalpha() for c in text)))
        return pd.DataFrame(out, columns=["path", "combined_text", "n_pages", "_chars", "_letters"])

    read = through(files.select("path", "content"), work, "path string, combined_text string, n_pages int, _chars bigint, _letters bigint")
    scored = read.withColumn("text_layer_score", layer_score(F.col("_chars"), F.col("_letters"), F.col("n_pages")))
    return scored.select("path", "combined_text", "n_pages", "text_layer_score", (F.col("text_layer_score") < least).alias("needs_ocr"))


def page_images(files: DataFrame, render: Callable[[bytes, int], list[bytes]], dpi: int = 200) -> DataFrame:
    """Images of the pages of PDF files (path, content) by a renderer: path, page_number from 1, image."""

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(path, i, image) for path, content in zip(batch["path"], batch["content"]) for i, image in enumerate(render(bytes(content), dpi), 1)], columns=["path", "page_number", "image"])

    return through(files.select("path", "content").where("content is not null"), work, "path string, page_number int, image binary")


def joined_pages(pages: DataFrame) -> DataFrame:
    """Page texts (version_id, page_number, text) as one text per version, parted by blank lines; blank pages are left out.

    A version has as many pages as its file; they are sorted where they are gathered.
    """
    lines = F.array_join(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), "\n")
    kept = pages.where("version_id is not null").select("version_id", "page_number", lines.alias("text")).where("text <> ''")
    return kept.groupBy("version_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), "\n\n").alias("combined_text"), F.count(F.lit(1)).alias("n_pages"))
