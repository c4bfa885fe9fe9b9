"""Files as rows (S1-S7, S16-S18, S20, S21). Spark's own reader lists and reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json_ops, paths
from tessera.sources import parsers

#: First bytes of image files in hex.
MAGIC = ("FFD8FF", "89504E47", "47494638", "424D", "52494646")


#: Spark's setting of how many tasks list the folders of one level at most (unset: one for each folder, up to 10,000).
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Path, relative_path, content, size, modified of all files below a folder; parts that
    start with a dot are skipped. Reading fails where the root is missing.

    Folders are listed here, in as many tasks as there are cores: a task for each costs far more than its listing."""
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    finally:
        spark.conf.set(LISTING_TASKS, before)
    top = root if "://" in root or root.startswith("file:") else f"file:{root}"
    rel = F.regexp_replace(paths.relative(F.regexp_replace("path", "^file:/+", "file:/"), top.replace("file://", "file:")), "^/", "")
    return held.select("path", rel.alias("relative_path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter(~paths.is_hidden(F.col("relative_path")))


def fingerprint(files: DataFrame, *more: Column) -> DataFrame:
    """Digest, size and time of each file, and ``more`` that is told from the same reading of it."""
    return files.select("relative_path", F.sha2("content", 256).alias("content_hash"), "size", F.unix_timestamp("modified").alias("mtime"), *more)


def ledger_changes(ledger: DataFrame, listing: DataFrame, by: list[str]) -> DataFrame:
    """relative_path and change (Added, Changed, Removed) of a listing against the ledger of the scan before; a file has
    changed where one of the columns ``by`` (size, mtime, digest) differs. The listing is the next ledger, so each change is found once."""
    new = listing.select("relative_path", F.struct(*by).alias("__new"))
    old = ledger.select("relative_path", F.struct(*by).alias("__old"))
    change = F.when(F.col("__old").isNull(), "Added").when(F.col("__new").isNull(), "Removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "Changed")
    return old.join(new, "relative_path", "full_outer").select("relative_path", change.alias("change")).filter("change IS NOT NULL")


def initial_events(files: DataFrame, workspace_id: int) -> tuple[DataFrame, DataFrame]:
    """An event and a job for each file."""
    body = json_ops.payload(workspace_id=F.lit(workspace_id), relative_path=F.col("relative_path"))
    events = files.select(F.lit("FileAdded").alias("event_type"), body.alias("payload"))
    jobs = files.select(F.lit("index_document").alias("job_type"), body.alias("payload"), F.lit("queued").alias("status"), F.lit(0).alias("priority"), F.lit(0).alias("retry_count"), F.lit(3).alias("max_retries"))
    return events, jobs


def is_image(content: Column) -> Column:
    """Whether the first bytes are those of an image file."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(False)
    for m in MAGIC:
        out = out | head.startswith(m)
    return out


def requires_ocr(block_type: Column, text: Column) -> Column:
    """An image block without text."""
    return (block_type == "Image") & (F.length(F.trim(text)) == 0)


def parsed(files: DataFrame, pdf=None, ocr=None) -> DataFrame:
    """Blocks of each file by its type, and an error where none fits.

    ``pdf`` and ``ocr`` are pandas UDFs (content to page texts; content to text) of the caller."""
    kind = paths.file_type(F.col("relative_path"))
    # Python functions run for every row: they get nulls but for their own type.
    text = F.when(kind.isin("md", "txt", "html"), F.make_valid_utf8(F.col("content").cast("string")))
    document = F.when(kind == "docx", F.col("content"))
    none = F.array().cast(parsers.BLOCKS)
    image = F.array(F.struct(F.lit("Image").alias("block_type"), F.lit("1").alias("page_or_location"), (ocr(F.when(kind == "image", F.col("content"))) if ocr else F.lit("")).alias("text_content")))
    blocks = F.when(F.col("file_type") == "md", parsers.markdown_blocks(text)).when(F.col("file_type") == "txt", parsers.text_blocks(text)).when(F.col("file_type") == "html", parsers.html_blocks(text)).when(F.col("file_type") == "docx", parsers.docx_blocks(document)).when(F.col("file_type") == "image", image)
    if pdf is not None:
        blocks = blocks.when(F.col("file_type") == "pdf", parsers.pdf_page_blocks(pdf(F.when(kind == "pdf", F.col("content")))))
    out = files.withColumn("file_type", kind).withColumn("blocks", blocks)
    error = F.when(F.col("file_type").isNull(), "no extension").when(F.col("blocks").isNull(), "no parser")
    return out.withColumns({"error": error, "blocks": F.coalesce("blocks", none)})


def viewed(files: DataFrame) -> DataFrame:
    """Text of Markdown files, base64 of others in one line, with the media type."""
    kind = paths.file_type(F.col("relative_path"))
    return files.select("relative_path", paths.mime(F.col("relative_path")).alias("mime"), F.when(kind == "md", F.make_valid_utf8(F.col("content").cast("string"))).otherwise(F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))).alias("content"))


def write_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each workspace."""
    vectors.write.mode(mode).partitionBy("workspace_id").parquet(path)


def read_vectors(spark: SparkSession, path: str, workspace_id: int | None = None) -> DataFrame:
    """Vectors; those of one workspace are read from its folder alone."""
    held = spark.read.parquet(path)
    return held if workspace_id is None else held.filter(F.col("workspace_id") == workspace_id)
