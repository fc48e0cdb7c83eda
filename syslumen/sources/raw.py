"""Raw log text: reading, decoding, cleaning, parsing into log records."""

from __future__ import annotations

import codecs
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from syslumen.functions import scalar as S
from syslumen.functions.parameters import parameters
from syslumen.session import micros

LONGEST_LINE = 1 << 20
#: Bytes of a file that tell its encoding.
PROBE = 1 << 16
LINES_PER_SECOND = 25_000

# Headers of a device's line, comment lines, modules that security devices log under.
HEADER = r"%%(\d{2})?([A-Za-z0-9_\-]+)/([0-8])/([A-Za-z0-9_\-]+(?:\s+[A-Za-z0-9_\-]+)*)(?:\(([A-Za-z])\))?(?:\[(\d+)\])?(?:\[([^\]]+)\])?:\s*(.*)$"
SUPPORTED = r"%%\d{0,2}[A-Za-z0-9_\-]+/[0-8]/[A-Za-z0-9_\-]+"
SECURITY = r"%%\d{0,2}(SEC|UTM|IPS|AV|FW|SSLVPN|ATTACK|POLICY)/[0-8]/[A-Za-z0-9_\-]+"
FILE_HEADER = r"(?i)^#\s*(?:This\s+)?logfile\s+is\s+generated\s+at\s+slot\s+(\S+)(?:\s*\(([^)]+)\))?"
FILE_DIGEST = r"(?i)^#\s*Digest(?:\(([^)]+)\))?:\s*([a-fA-F0-9]+|\S+)"
FILE_CLOSED = r"(?i)^#\s*(?:This\s+)?logfile\s+is\s+closed\s+at\s*(.*)"
FILE_VERSION = r"(?i)^#\s*(?:Software\s+)?Version:\s*(.*)"


def read_lines(spark: SparkSession, paths: list[str], extensions: str = "*", recursive: bool = True) -> DataFrame:
    """``source_file, seq, line`` of all files below the paths; text that isn't UTF-8 is read as GB18030.

    Files are read in splits, so that a large one is dealt to many tasks (not if it's compressed). Lines are numbered in
    their split, after those of the file's splits before it. A file is GB18030 if a line that begins in its first ``PROBE`` bytes isn't
    UTF-8; in others, bytes that aren't UTF-8 are replaced.
    """
    text = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", extensions).option("lineSep", "\n").text(paths)
    about = [F.col("_metadata.file_path").alias("__path"), F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B")).alias("source_file"), F.col("_metadata.file_block_start").alias("__split")]
    lines = text.select("value", *about, F.monotonically_increasing_id().alias("__order"))
    order = Window.partitionBy("__path", "__split").orderBy("__order")
    length = F.octet_length("value") + 1
    begins = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - length
    placed = lines.withColumns({"__nth": F.row_number().over(order) - 1, "__begins": begins})
    foreign = (F.col("__split") == 0) & (F.col("__begins") < PROBE) & ~F.is_valid_utf8("value")
    splits = placed.groupBy("__path", "__split").agg(F.count("*").alias("n"), F.bool_or(foreign).alias("foreign"))
    file = Window.partitionBy("__path")
    before = F.sum("n").over(file.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("__path", "__split", F.coalesce(before, F.lit(0)).alias("__before"), F.bool_or("foreign").over(file).alias("__foreign"))
    own = placed.join(splits, ["__path", "__split"]).withColumn("seq", F.col("__before") + F.col("__nth"))
    # only lines of such files are handed to Python
    line = F.when(F.col("__foreign"), _gb18030(F.when(F.col("__foreign"), F.col("value").cast("binary")))).otherwise(F.make_valid_utf8("value"))
    line = F.when((F.col("seq") == 0) & line.startswith("\ufeff"), F.substring(line, 2, LONGEST_LINE * 2)).otherwise(line)
    return own.select("source_file", "seq", F.rtrim(line, F.lit("\r")).alias("line"))


@F.pandas_udf(StringType())
def _gb18030(lines: pd.Series) -> pd.Series:
    return lines.map(lambda raw: bytes(raw).removeprefix(codecs.BOM_UTF8).decode("gb18030", "replace"), na_action="ignore")


def from_text(spark: SparkSession, name: str, text: str) -> DataFrame:
    return spark.createDataFrame([(name, text)], "source_file string, t string").select("source_file", F.posexplode(F.split("t", r"\r?\n")).alias("seq", "line")).withColumn("seq", F.col("seq").cast("bigint"))


def clean_lines(lines: DataFrame, mask: bool = True) -> DataFrame:
    """Without garbage lines and without files that have a line over ``LONGEST_LINE`` bytes; the rest sanitised."""
    long = lines.where(F.octet_length("line") > LONGEST_LINE).select("source_file").distinct()
    kept = lines.where(~S.is_garbage(F.col("line")))
    # one name for each MiB of input at most; a shuffle would put all lines of a file into one task
    return kept.join(F.broadcast(long), "source_file", "left_anti").withColumn("line", S.sanitize(F.col("line"), mask))


def _comment(line: Column) -> dict[str, Column]:
    part = lambda p, g: F.regexp_extract(line, p, g)
    header, digest, closed, version = (line.rlike(p) for p in (FILE_HEADER, FILE_DIGEST, FILE_CLOSED, FILE_VERSION))
    pair = lambda k, v: F.create_map(F.lit(k), v)
    model = F.split(F.trim(part(FILE_HEADER, 2)), r"\s+")
    known = lambda m: F.map_filter(m, lambda k, v: v != "")
    about = F.when(header, known(F.create_map(F.lit("Slot"), part(FILE_HEADER, 1), F.lit("DeviceModel"), F.coalesce(F.get(model, F.lit(0)), F.lit("")), F.lit("Version"), F.coalesce(F.get(model, F.lit(1)), F.lit("")), F.lit("FileType"), F.lit("日志文件头"))))
    about = about.when(digest, known(F.create_map(F.lit("DigestSeq"), part(FILE_DIGEST, 1), F.lit("Digest"), part(FILE_DIGEST, 2), F.lit("FileType"), F.lit("防篡改校验码"))))
    about = about.when(closed, F.create_map(F.lit("CloseInfo"), F.trim(part(FILE_CLOSED, 1)), F.lit("FileType"), F.lit("日志文件尾/归档")))
    about = about.when(version, pair("Version", F.trim(part(FILE_VERSION, 1)))).otherwise(known(pair("Comment", F.trim(F.substring(line, 2, 1 << 20)))))
    return {
        "brief": F.when(header, "LOGFILE_HEADER").when(digest, "LOGFILE_DIGEST").when(closed, "LOGFILE_CLOSED").when(version, "SOFTWARE_VERSION").otherwise("COMMENT_LINE"),
        "slot_info": F.when(header, part(FILE_HEADER, 1)).when(digest & (part(FILE_DIGEST, 1) != ""), F.concat(F.lit("Seq: "), part(FILE_DIGEST, 1))).otherwise(""),
        "parameters": about,
        "time": F.when(closed, part(FILE_CLOSED, 1)),
    }


#: Further parsers: name, test and columns by name; the first whose test holds is taken before the built-in ones.
PARSERS: list[tuple[str, Callable[[Column], Column], Callable[[Column], dict[str, Column]]]] = []


def register_parser(name: str, test: Callable[[Column], Column], columns: Callable[[Column], dict[str, Column]]) -> None:
    PARSERS.append((name, test, columns))


def parse(lines: DataFrame, zone_minutes: int = 0, as_of: str | None = None, with_parameters: bool = True) -> DataFrame:
    """Log records of sanitised lines; ``timestamp`` is UTC without zone, NULL where there's none.

    Comment lines begin with #. Of others, what stands before the header is a time and, last, the host. Lines without a
    header are UNKNOWN/UNPARSED at severity 8.
    """
    line = F.trim("line")
    at = lambda g: F.regexp_extract("line", HEADER, g)
    comment, parsed = line.startswith("#"), F.col("line").rlike(SUPPORTED) & (at(2) != "")
    before = F.trim(F.regexp_replace(F.regexp_extract("line", r"^(.*?)%%\d{0,2}[A-Za-z0-9_\-]+/[0-8]/", 1), r"^<\d+>\s*", ""))
    host = F.when(before.rlike(r"\s\S+$"), F.regexp_extract(before, r"(\S+)$", 1)).otherwise(F.when(before.rlike(r"^\S+$") & ~before.rlike(r"^\d{4}-"), before).otherwise(""))
    stamp = F.when(host != "", F.trim(F.substr(before, F.lit(1), F.length(before) - F.length(host)))).otherwise(before)
    c = _comment(line)
    severity = F.when(comment, 6).when(parsed, at(3).try_cast("int")).otherwise(8)
    made = lines.select(
        "source_file", "seq",
        F.when(comment, c["time"]).when(parsed, stamp).alias("__time"),
        F.when(comment | ~parsed, "").otherwise(host).alias("hostname"),
        F.when(comment, "COMMENT").when(parsed, F.upper(at(2))).otherwise("UNKNOWN").alias("module"),
        severity.cast("int").alias("severity"),
        F.when(comment, c["brief"]).when(parsed, F.regexp_replace(at(4), r"\s+", " ")).otherwise("UNPARSED").alias("brief"),
        F.when(comment, c["slot_info"]).when(parsed, at(7)).otherwise("").alias("slot_info"),
        F.when(parsed & F.col("line").rlike(SECURITY), "Huawei-USG-Firewall").otherwise("Huawei-VRP").alias("device_type"),
        F.when(parsed, F.coalesce(F.nullif(F.lower(at(5)), F.lit("")), F.when(F.col("line").rlike(SECURITY), "s").otherwise("l"))).otherwise("").alias("log_type"),
        F.when(parsed, at(6).try_cast("bigint")).alias("sequence"),
        F.col("line").alias("raw_log"),
        F.when(parsed & ~comment, F.trim(at(8))).otherwise(line).alias("message_body"),
        F.when(comment, c["parameters"]).alias("__about"),
    )
    # other lines don't go to Python
    own = parameters(F.when(F.col("__about").isNull() & (F.col("brief") != "UNPARSED"), F.col("message_body"))) if with_parameters else F.lit(None).cast("map<string,string>")
    for _, test, columns in PARSERS:
        made = made.withColumns({k: F.when(test(F.col("raw_log")), v).otherwise(F.col(k)) for k, v in columns(F.col("raw_log")).items()})
    made = made.withColumn("timestamp", S.parse_time(F.col("__time"), zone_minutes, as_of)).withColumn("parameters", F.coalesce("__about", own, F.create_map().cast("map<string,string>")))
    return made.withColumn("parameters_json", F.when(F.size("parameters") == 0, "{}").otherwise(S.sorted_json(F.col("parameters")))).drop("__time", "__about")


def sniff_host(records: DataFrame, first: int = 100) -> DataFrame:
    """``source_file, hostname``: the first host among each file's first lines."""
    own = records.where((F.col("seq") < first) & (F.col("hostname") != ""))
    return own.groupBy("source_file").agg(F.min_by("hostname", "seq").alias("hostname"))


def preview(records: DataFrame) -> DataFrame:
    """Of every file: lines, hosts, time span, and the time that importing it takes."""
    us = micros("timestamp")
    eta = F.least(F.greatest(F.ceil(F.count("*") / LINES_PER_SECOND).cast("bigint"), F.lit(1).cast("bigint")), F.lit(600).cast("bigint"))
    return records.groupBy("source_file").agg(F.count("*").alias("lines"), F.countDistinct("hostname").alias("hosts"), F.min(us).alias("first_us"), F.max(us).alias("last_us"), eta.alias("eta_s"))


def numbered(records: DataFrame) -> DataFrame:
    """``id`` in the order of files and lines: a file's rows follow those of the files before it, without a sort of all rows."""
    sizes = records.groupBy("source_file").agg((F.max("seq") + 1).alias("n"))
    # one row a file
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("source_file", F.coalesce(before, F.lit(0)).alias("__before"))
    return records.join(offsets, "source_file").withColumn("id", F.col("__before") + F.col("seq") + 1).drop("__before")


from syslumen.session import by_value  # noqa: E402

by_value(__name__)
