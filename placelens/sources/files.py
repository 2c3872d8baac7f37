"""Tab-separated text, XML dumps, stage tables, file inventories and checksums."""

import hashlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKINS_RAW = "user_id string, venue_id string, utc_time string, timezone_offset_mins string"
CITIES_RAW = ("name string, center_lat string, center_long string, country_code string, country_name string, "
              "city_type string")
VENUES_RAW = "venue_id string, lat string, long string, category string, country_code string"
CHUNK = 1 << 20             # bytes of a file that a task holds at once
TASK_BYTES = 128 << 20      # of the files of one task, about
DUMP_PAGE = "title STRING, revision STRUCT<timestamp: STRING, text: STRUCT<_VALUE: STRING>>"


def split_tsv(lines, schema, column="value"):
    """Split lines on tabs. No quoting; short lines give NULLs, blank lines an empty first field."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parts = F.split(F.col(column), "\t")
    return lines.select(*[F.get(parts, F.lit(i)).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def read_tsv(spark, path, schema):
    return split_tsv(spark.read.text(path), schema)


def read_pages_xml(spark, path):
    """(title, timestamp, text) per <page>; reads .bz2 directly. Missing fields are NULL, as are all of a malformed page.

    The end tag of a page is the line separator, so one large file, also a bz2 file, is read in many splits.
    """
    pieces = spark.read.option("lineSep", "</page>").text(path)
    begin = F.regexp_extract("value", r"(?s)(<page[\s>].*)", 1)
    pages = pieces.select(begin.alias("page")).where("page != ''")
    pages = pages.select(F.from_xml(F.concat("page", F.lit("</page>")), DUMP_PAGE, {"rowTag": "page"}).alias("p"))
    return pages.select("p.title", F.col("p.revision.timestamp").alias("timestamp"), F.col("p.revision.text._VALUE").alias("text"))


def write_pages_xml(pages, path):
    """Write (title, timestamp, text) rows in the layout that read_pages_xml reads."""
    text = F.struct(F.col("text").alias("_VALUE"), F.octet_length("text").alias("_bytes"))
    (pages.select("title", F.struct("timestamp", text.alias("text")).alias("revision"))
     .write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki")
     .option("compression", "bzip2").save(path))


def write_stage(df, path, form="parquet", partition_by=()):
    """Write a stage table once; an existing one is kept."""
    writer = df.write.mode("ignore").format(form)
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_stage(spark, path, schema, form="parquet"):
    reader = spark.read.schema(schema).format(form)
    return (reader.option("header", True) if form == "csv" else reader).load(path)


def list_files(spark, folder):
    """(path, length) of the files in a folder, empty ones too, without reading them; names with a leading _ or . are left out."""
    def found(batches):
        for _ in batches:
            fs, at = _open(folder)
            here = [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and f.base_name[0] not in "_."]
            for k in range(0, len(here), 10_000):
                some = here[k:k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{f.base_name}" for f in some], pa.string()),
                                                  pa.array([f.size for f in some], pa.int64())], names=["path", "length"])

    return spark.range(1, numPartitions=1).mapInArrow(found, "path string, length long")


def _open(path):
    """(file system, path in it) of a plain path or a URI, whose characters are not escaped."""
    scheme, _, rest = path.partition(":/") if ":/" in path else ("file", "", path)
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(f"{scheme}:/{quote(rest)}")


def write_files(contents, folder, name="file_name", content="content"):
    """Write every row's content (string or binary) as a file of its own into a shared folder: rows (path, length).

    A file appears under its name when it is whole, so a repeated task does no harm.
    """
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)

    def write(batches):
        fs, at = _open(folder)
        for batch in batches:
            paths, sizes = [], []
            for file_name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_output_stream(f"{at}/_{file_name}.part", compression=None) as out:
                    out.write(data)
                fs.move(f"{at}/_{file_name}.part", f"{at}/{file_name}")
                paths.append(f"{folder.rstrip('/')}/{file_name}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return contents.select(name, F.col(content).cast("binary")).mapInArrow(write, "path string, length long")


def file_digests(files, algorithm="md5"):
    """(file_name, actual) of files (path, length), of any size: read as streams, of which a task holds CHUNK bytes.

    Files are dealt by size, so that a task reads about TASK_BYTES or one file.
    """
    spark = files.sparkSession
    total, count = files.agg(F.sum("length"), F.count("*")).first()
    tasks = max(min(count, max(-(-(total or 0) // TASK_BYTES), spark.sparkContext.defaultParallelism)), 1)

    def digest(batches):
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                fs, at = _open(path)
                h = hashlib.new(algorithm)
                with fs.open_input_stream(at, compression=None) as source:
                    while chunk := source.read(CHUNK):
                        h.update(chunk)
                found.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["path", "actual"])

    dealt = files.select("path").repartition(tasks, "path")
    return dealt.mapInArrow(digest, "path string, actual string").select(F.substring_index("path", "/", -1).alias("file_name"), "actual")


def dump_inventory(files):
    """Per dump file: size in MB and the number of page ids its name spans (`...p<first>p<last>.bz2`)."""
    name = F.substring_index("path", "/", -1)
    first, last = (F.regexp_extract(name, r"p(\d+)p(\d+)\.[^.]*$", i).try_cast("bigint") for i in (1, 2))
    return files.select(name.alias("file_name"), (F.col("length") / 1e6).alias("size_mb"),
                        (last - first).alias("article_span"))


def inventory_totals(inventory):
    return inventory.agg(F.count("*").alias("files"), (F.sum("size_mb") / 1e3).alias("size_gb"),
                         F.sum("article_span").alias("articles"))


def parse_manifest(lines, column="value"):
    """`md5  name` lines of the article dumps (no multistream or meta files)."""
    parts = F.split(F.col(column), "  ")
    out = lines.select(F.get(parts, F.lit(0)).alias("expected"), F.get(parts, F.lit(1)).alias("file_name"))
    name = F.col("file_name")
    return out.filter(name.contains(".xml-p") & ~name.contains("multistream") & ~name.contains("meta"))


def compare_checksums(files, manifest):
    """Status per file: ok, bad, missing (only listed) or unlisted. `files` has file_name, actual."""
    status = (F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unlisted")
              .when(F.col("actual") == F.col("expected"), "ok").otherwise("bad"))
    return files.join(manifest, "file_name", "full_outer").select("file_name", status.alias("status"))


def verify_checksums(spark, path, manifest_path):
    """Status of every file below `path` against a manifest of `md5  name` lines."""
    return compare_checksums(file_digests(list_files(spark, path)), parse_manifest(spark.read.text(manifest_path)))
