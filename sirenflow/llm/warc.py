"""WARC archives: written and read by Spark's text files, verified by the chain of record boundaries.

Writing: a record's bytes are a text row and the record separator CRLF CRLF is the line separator, so Spark's
own writer makes valid archives on any file system it knows. Reading: the magic is the line separator, so
splits of one archive are read by many tasks; each piece after a magic is only a *candidate* record. Tasks emit
each candidate's length and declared length; per archive, pieces add up to byte offsets, each candidate points at
the offset that its declared length leads to, and pointer jumping from the start of the file keeps the
reachable ones. A magic inside a payload is reached by no chain and counts as payload. What takes an archive
as a whole is numbers only: four a candidate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sirenflow.llm.common import cut, saved, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Records in an archive: bounds what the boundary chain of one file takes.
RECORDS_PER_FILE = 20_000
#: Payloads of at least this many bytes are written once; later copies are revisits.
MIN_REVISIT_BYTES = 0

_BASE16_DIGITS, _BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits at a time are four base-32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _BASE16_DIGITS, _BASE32_DIGITS)


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(id, url, html, digest, size, kind, refers_to): which page is a response and which revisits it.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the largest id are responses (repeated
    rows of that id too) and the others revisit it; null ids rank lowest. Smaller payloads are all responses.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    groups = saved(p.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("top")).where("n > 1").select("digest", "top"))
    p = p.join(groups, "digest", "left")
    again = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    return p.select("id", "url", "html", "digest", "size", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("top")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``plan_records`` rows as WARC/1.1 archives. Revisits carry no payload. CR and LF in URLs are percent-encoded.

    ``date``: the WARC-Date of all records, since pages have none. Repeated rows have equal record ids.
    """
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda k, v: F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit(""))
    body = F.when(F.col("kind") == "response", F.col("html")).otherwise("")
    head = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("kind")), line("WARC-Record-ID", name(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("kind") == "revisit", F.concat(line("WARC-Refers-To", name(F.col("refers_to"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    rows = records.select(F.concat(head, F.lit("\r\n"), body).alias("value"))
    rows.write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _field(name: str) -> Column:
    got = F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), rf"\r\n(?i:{name}):[ \t]*([^\r\n]*)", 1)
    return F.when(got != "", got)


def chain(own: np.ndarray, declared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offset, reached) of the candidates of one archive, in file order.

    ``own``: bytes of each candidate with its magic; ``declared``: bytes its header claims, -1 if it has none.
    Reached sets double: what 2^k jumps lead to from a reached record is reached.
    """
    n = len(own)
    offset = np.concatenate(([0], np.cumsum(own)[:-1])).astype(np.int64)
    at = np.searchsorted(offset, offset + declared)
    at = np.where((declared > 0) & (at < n), at, n)
    lands = np.concatenate((offset, [-1]))[at] == offset + declared
    jump = np.append(np.where(lands, at, n), n)  # n: leaves the file
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0
    for _ in range(max(1, n).bit_length() + 1):
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    return offset, reached[:n]


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """(file, offset, owner, reached) of the candidates of an archive; owner: the offset of the record that holds it."""
    pdf = pdf.sort_values("offset", kind="stable")
    offset, reached = chain(pdf["own"].to_numpy(np.int64), pdf["declared"].to_numpy(np.int64))
    return pd.DataFrame({"file": pdf["file"], "offset": offset, "owner": np.maximum.accumulate(np.where(reached, offset, -1)), "reached": reached})


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, own, declared, head, body): every piece of every archive that follows a magic, in order of (block, seq)."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    cutoff = F.instr("value", END)
    raw = raw.withColumn("head", F.when(cutoff > 0, F.substring_index("value", END, 1)))
    size = F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), r"\r\n(?i:Content-Length):[ \t]*([0-9]+)", 1).try_cast("long")
    raw = raw.withColumn("size", size)
    head_bytes = F.octet_length("head") + len(END)
    data = F.col("value").cast("binary")
    return raw.select(
        "file", "block", "seq", "head", (F.octet_length("value") + len(MAGIC)).alias("own"),
        F.coalesce(len(MAGIC) + head_bytes + F.col("size") + len(END), F.lit(-1)).cast("long").alias("declared"),
        F.substring(data, head_bytes + 1, F.col("size").cast("int")).alias("body"), data.alias("data"),
    )


def placed(pieces: DataFrame) -> DataFrame:
    """``pieces`` of one scan with their byte offset in the archive, in place of (block, seq).

    What stands before the first magic is no candidate; an archive has nothing there, or it gives no rows. Offsets
    do not depend on how a scan is cut into tasks, so results of two scans meet on them.
    """
    order = Window.partitionBy("file").orderBy("block", "seq")
    p = pieces.withColumns({"head_own": F.first("own").over(order), "before": F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    return p.where(F.col("before").isNotNull() & (F.col("head_own") == len(MAGIC))).withColumn("offset", F.col("before") - len(MAGIC)).drop("block", "seq", "head_own", "before")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record: file, offset, record_id, type, uri, payload_digest, payload_length, refers_to, intact.

    ``intact``: a response's payload has the digest its header states, also where the payload holds record magics
    (its pieces are put together again); null for revisits. Archives without a record give no row.
    """
    found = candidates(spark, path)
    whole = F.col("own") >= F.col("declared")
    slim = found.select("file", "block", "seq", "own", "declared", "head", F.when(whole, base32_sha1(F.col("body"))).alias("sha"), whole.alias("whole"))
    slim = cut(placed(slim))
    seen = cut(slim.select("file", "offset", "own", "declared").groupBy("file").applyInPandas(_verify, "file string, offset long, owner long, reached boolean"))
    records = slim.join(seen.where("reached").select("file", "offset"), ["file", "offset"])
    parts = saved(records.where("not whole").select("file", F.col("offset").alias("owner")).join(seen.select("file", "owner", "offset"), ["file", "owner"]))
    torn = saved(parts.select("file").distinct())
    again = placed(found.join(torn, "file", "left_semi").select("file", "block", "seq", "own", "data")).select("file", "offset", "data")
    glued = parts.join(again, ["file", "offset"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["data"].cast("string")), MAGIC)
    glued = glued.select("file", F.col("owner").alias("offset"), joined.alias("text"))
    glued = glued.select("file", "offset", base32_sha1(F.expr(f"substring(cast(text as binary), cast({len(END) + 1} + octet_length(substring_index(text, '\r\n\r\n', 1)) as int), octet_length(text) - octet_length(substring_index(text, '\r\n\r\n', 1)) - {2 * len(END)})")).alias("glued_sha"))
    records = records.join(glued, ["file", "offset"], "left")
    digest = F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "")
    kind = _field("WARC-Type")
    return records.select(
        "file", "offset", _field("WARC-Record-ID").alias("record_id"), kind.alias("type"), _field("WARC-Target-URI").alias("uri"), digest.alias("payload_digest"),
        _field("X-Payload-Length").cast("long").alias("payload_length"), _field("WARC-Refers-To").alias("refers_to"),
        F.when(kind == "response", F.coalesce("glued_sha", "sha").eqNullSafe(digest)).alias("intact"),
    )


def warc_round_trip(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write ``pages`` as archives under ``path`` (default: a new folder in the shared one), read them back; one row per record.

    page_id, payload_bytes, payload_digest, record_type, refers_to, intact. Null html is an empty payload, null
    ids stay null, repeated rows give repeated records; extra columns are not read.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    records = plan_records(pages, **how)
    if pages.isEmpty():
        return records.select(F.col("id").cast("long").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast("long"), F.lit(True).alias("intact"))
    write_warc(records, path)
    number = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?[0-9]+)>", 1).try_cast("long")
    got = read_warc(spark, path)
    return got.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "intact")
