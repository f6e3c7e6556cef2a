"""Getting résumé and job text into tables: file gates, page and part
assembly, input gates and failure capture.

Decoding PDF/DOCX bytes is a per-file parser and is not rebuilt; the
assemblies start from the page texts / document parts such a parser emits.
Bad rows are kept with an ``error`` message instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import char_count, clean_text, col, strip, word_count


def read_files(spark: SparkSession, path: str, recursive: bool = True,
               inventory: DataFrame | None = None) -> DataFrame:
    """``binaryFile`` source: ``path, modificationTime, length, content``.

    At scale pass ``inventory(path, length)``, the store's own listing: its
    zero-byte files are added as they stand, and no path list passes through
    the driver. Without one (small folders):

    No ``pathGlobFilter``: it is case-sensitive and would silently drop the
    files the extension gate must report. The file scan skips zero-byte
    files, so files that the file index listed but the scan did not return
    are added back with empty content -- the empty-file gate needs them.
    (The listing is the file index Spark already keeps on the driver.)
    """
    scan = (spark.read.format("binaryFile")
            .option("recursiveFileLookup", str(recursive).lower())
            .load(path))
    norm = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    if inventory is not None:
        none = inventory.where("length = 0").select(
            norm(F.col("path")).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"),
            F.lit(0).cast("long").alias("length"), F.lit(b"").cast("binary").alias("content"))
        return scan.select(norm(F.col("path")).alias("path"), "modificationTime", "length", "content").unionByName(none)
    listed = spark.createDataFrame([(p,) for p in scan.inputFiles()], "listed string")
    listed = listed.select(norm(F.col("listed")).alias("path"))
    empty = (listed.join(scan.select(norm(F.col("path")).alias("path")), "path", "left_anti")
             .select("path", F.lit(None).cast("timestamp").alias("modificationTime"),
                     F.lit(0).cast("long").alias("length"), F.lit(b"").cast("binary").alias("content")))
    return scan.select(norm(F.col("path")).alias("path"), "modificationTime", "length",
                       "content").unionByName(empty)


def list_files(prefixes: DataFrame, prefix_col: str = "prefix") -> DataFrame:
    """``(path, length, modificationTime)`` of every file under the given prefixes (URIs of a store
    that pyarrow reads): an inventory for :func:`read_files`. Each prefix is listed by a task, so no
    list passes through the driver; zero-byte files are listed like all others. A prefix that
    does not exist has no files; files under two of the prefixes are listed once."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                if uri is None:
                    continue
                store, at = fs.FileSystem.from_uri(uri)
                scheme = uri.split("://")[0] + "://" if "://" in uri else "file://" if uri.startswith("/") else uri.split(":")[0] + "://"
                own = [f for f in store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File]
                for k in range(0, len(own), 10_000):
                    part = own[k: k + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([scheme + f.path for f in part]), pa.array([f.size for f in part], pa.int64()),
                         pa.array([f.mtime for f in part], pa.timestamp("us", tz="UTC"))], ["path", "length", "modificationTime"])

    listed = prefixes.select(F.col(prefix_col).alias("prefix")).distinct().mapInArrow(
        run, "path string, length long, modificationTime timestamp")
    return listed.dropDuplicates(["path"])


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def extension(name: Column | str) -> Column:
    """``Path(name).suffix.lower()``: last dot not at position 0, no trailing dot."""
    return F.lower(F.regexp_extract(col(name), r"[^/](\.[^./]+)$", 1))


def file_gate(ext: Column, size: Column) -> Column:
    """Error for an upload, checked in order: unsupported type, empty file."""
    return (F.when(~ext.isin(*fixed.SUPPORTED_EXTENSIONS), F.lit(fixed.ERR_UNSUPPORTED))
             .when(size == 0, F.lit(fixed.ERR_EMPTY_FILE)))


def gate_files(files: DataFrame, path_col: str = "path", length_col: str = "length") -> DataFrame:
    """Add ``filename, extension, error`` to a ``binaryFile``-shaped table."""
    name = file_name(path_col)
    ext = extension(name)
    return (files.withColumn("filename", name).withColumn("extension", ext)
                 .withColumn("error", file_gate(F.col("extension"), F.col(length_col))))


def no_text_error(ext: Column, text: Column) -> Column:
    return F.when(text == F.lit(""), F.when(ext == ".pdf", F.lit(fixed.ERR_NO_TEXT_PDF))
                                     .otherwise(F.lit(fixed.ERR_NO_TEXT_DOCX)))


def assemble_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                   text_col: str = "text") -> DataFrame:
    """PDF-style assembly: blank pages dropped, the rest joined with LF in page
    order, then cleaned. ``(doc_id, text)``; documents without text get ''.

    One shuffle by document; each group holds one document's pages.
    """
    keep = F.when(strip(text_col) != F.lit(""), F.struct(F.col(page_col).alias("p"),
                                                         F.col(text_col).alias("t")))
    agg = pages.groupBy(doc_col).agg(F.array_sort(F.collect_list(keep)).alias("pages"))
    return agg.select(doc_col, clean_text(F.array_join(F.transform("pages", lambda s: s["t"]), "\n"))
                      .alias("text"))


def assemble_parts(parts: DataFrame) -> DataFrame:
    """DOCX-style assembly from ``parts(doc_id, kind, section_no, table_no,
    row_no, cell_no, ord, text)``: non-blank paragraphs, then table rows
    (non-blank stripped cells joined by " | ", empty rows dropped), then per
    section its header then footer paragraphs; joined with LF and cleaned.
    ``(doc_id, text)``; documents without text get ''. A group holds one
    document's parts.
    """
    p = parts
    rows = (p.filter(F.col("kind") == "cell")
             .groupBy("doc_id", "table_no", "row_no")
             .agg(F.array_sort(F.collect_list(F.when(strip("text") != F.lit(""), F.struct(
                 F.col("cell_no").alias("c"), strip("text").alias("t"))))).alias("cells"))
             .select("doc_id", F.lit(1).alias("rank"), F.col("table_no").alias("k1"),
                     F.col("row_no").alias("k2"), F.lit(0).alias("k3"),
                     F.array_join(F.transform("cells", lambda s: s["t"]), " | ").alias("text")))
    rank = F.when(F.col("kind") == "paragraph", 0).otherwise(2)
    hf = F.when(F.col("kind") == "footer", 1).otherwise(0)
    other = (p.filter(F.col("kind") != "cell")
              .select("doc_id", rank.alias("rank"),
                      F.when(F.col("kind") == "paragraph", 0).otherwise(F.col("section_no")).alias("k1"),
                      hf.alias("k2"), F.col("ord").alias("k3"), "text"))
    # blank parts are dropped inside the group, so a document of blank parts stays with ''
    keep = F.when(strip("text") != F.lit(""), F.struct("rank", "k1", "k2", "k3", F.col("text").alias("t")))
    agg = rows.unionByName(other).groupBy("doc_id").agg(F.array_sort(F.collect_list(keep)).alias("parts"))
    return agg.select("doc_id", clean_text(F.array_join(F.transform("parts", lambda s: s["t"]), "\n"))
                      .alias("text"))


def resume_record(df: DataFrame, text_col: str = "text", ext_col: str = "extension") -> DataFrame:
    """Extraction result: ``characters`` and ``words`` of the cleaned text, and
    the no-text error keyed by extension."""
    return (df.withColumn("characters", char_count(text_col))
              .withColumn("words", F.when(F.col(text_col).isNotNull(), word_count(text_col)))
              .withColumn("error", F.coalesce(
                  F.col("error") if "error" in df.columns else F.lit(None).cast("string"),
                  no_text_error(F.col(ext_col), F.col(text_col)))))


def input_gate(resume_text: Column, job_text: Column) -> Column:
    """Missing résumé first, then a blank job description."""
    return (F.when(resume_text.isNull(), F.lit(fixed.ERR_NO_RESUME))
             .when(F.coalesce(strip(job_text), F.lit("")) == F.lit(""), F.lit(fixed.ERR_NO_JOB)))


def input_gate_flags(has_resume: Column, job_blank: Column) -> Column:
    """``input_gate`` from per-document flags (no text needs to travel)."""
    return (F.when(~has_resume, F.lit(fixed.ERR_NO_RESUME))
             .when(job_blank, F.lit(fixed.ERR_NO_JOB)))


def failure_message(error: Column) -> Column:
    """A failed extraction/analysis shown as "Resume analysis failed: ..."."""
    return F.when(error.isNotNull(), F.concat(F.lit(fixed.ERR_ANALYSIS_PREFIX), error))
