"""WARC archives: writing records, and reading them back by boundary-chain verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwright.llm.shared import shared_folder, table, written

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
#: A record starts at the start of a file or behind this gap and magic; payloads may hold it too.
BOUNDARY = GAP + MAGIC
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 100
RECORDS_PER_FILE = 1000
#: Copies of a shared response row that its revisits meet, so that none is a hot key.
SALTS = 16


def with_types(pages: DataFrame) -> DataFrame:
    """Add payload (binary), payload_digest, payload_bytes, record_type, refers_to.

    Of equal payloads of ``REVISIT_BYTES`` or more the one with the smallest page_id is the response. Rows that repeat this page_id are
    responses too; a null page_id revisits any other. Null html is an empty payload.
    """
    p = pages.withColumn("payload", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    shared = (p.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
              .select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    p = p.join(shared, ["payload_digest", "salt"], "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first_id")))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, compression: str = "gzip") -> None:
    """Archives of at most ``records_per_file`` records, compressed as a whole or not (``none``: then tasks read ranges of a file). One record per row of ``pages`` (page_id, url, html). Line breaks of a url are percent-encoded; a null url or page_id
    leaves its header out. Revisits carry no payload, but its digest and length. No rows give files without records."""
    p = with_types(pages.select("page_id", "url", "html"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    kept = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    head = F.concat_ws(
        "\r\n", F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest"), F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.concat(F.lit("Content-Length: "), F.octet_length(kept).cast("string")))
    record = F.concat(F.lit(MAGIC), head, F.lit(GAP), kept.cast("string"))
    p.select(record.alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """What the reader cuts at every magic, behind a gap or not: file, file_bytes (null where compressed), block, seq, body (bytes behind the magic), bytes.

    The reader loses a separator that begins like its own inside, as ``BOUNDARY`` does behind a CRLF at the edge of its buffer; no part
    of ``MAGIC`` begins like the whole. Tasks split a file into ranges; a piece belongs to the range that it starts in, so pieces are
    ordered by (block, seq). The first piece of a file lies before its first magic and is empty.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    packed = F.col("_metadata.file_name").rlike(r"\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate)$")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.when(~packed, F.col("_metadata.file_size")).alias("file_bytes"),
                      F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("body"))


RECORD = ("record_type", "page_id", "refers_to", "url", "stated_digest", "stated_bytes", "payload_digest", "payload_bytes")


def fields(body: Column) -> list[Column]:
    """Header fields of a record that ``body`` starts with."""
    head = F.substring_index(body.cast("string"), GAP, 1)
    ident = lambda name: F.regexp_extract(header(head, name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return [F.octet_length(head).alias("head_bytes"), header(head, "Content-Length").try_cast("long").alias("length"), header(head, "WARC-Type").alias("record_type"),
            ident("WARC-Record-ID").alias("page_id"), ident("WARC-Refers-To").alias("refers_to"), header(head, "WARC-Target-URI").alias("url"),
            F.regexp_extract(header(head, "WARC-Payload-Digest"), r"sha256:([0-9a-f]+)", 1).alias("stated_digest"), header(head, "X-Payload-Length").try_cast("long").alias("stated_bytes")]


def offsets(pieces: DataFrame) -> DataFrame:
    """Candidate offsets (behind the magic; 0 is what lies before the first), the successor that each candidate's Content-Length claims,
    whether a gap lies before the magic, and the record it would be if it held no other candidate: small rows without payloads."""
    slim = pieces.select("file", "file_bytes", "block", "seq", F.octet_length("body").cast("long").alias("bytes"), (F.expr(f"right(body, {len(GAP)})") == F.lit(GAP).cast("binary")).alias("closed"), *fields(F.col("body")), "body")
    payload = F.expr("substring(body, head_bytes + 5, int(length))")
    slim = slim.withColumns({"payload_digest": F.sha2(payload, 256), "payload_bytes": F.octet_length(payload).cast("long")}).drop("body")
    blocks = slim.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("block_bytes"), F.max_by("closed", "seq").alias("block_closed"))
    by_block = Window.partitionBy("file").orderBy("block")
    ahead = by_block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("block_bytes").over(ahead), F.lit(0)).alias("base"), F.lag("block_closed").over(by_block).alias("closed_before"))
    by_seq = Window.partitionBy("file", "block").orderBy("seq")
    inside = by_seq.rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("before", F.lag("closed").over(by_seq))
    slim = slim.withColumn("inner", F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(inside), F.lit(0))).join(blocks, ["file", "block"])
    off = F.col("base") + F.col("inner")
    return slim.select("file", "file_bytes", "block", "seq", off.alias("off"), "bytes", F.coalesce("before", "closed_before", F.lit(False)).alias("gap"),
                       (off + F.col("head_bytes") + len(GAP) + F.col("length") + len(BOUNDARY)).alias("next"), *RECORD)


def reachable(spark: SparkSession, cand: DataFrame) -> DataFrame:
    """Pointer jumping: (file, off) of candidates on the chain from the magic that a file starts with. Round k knows the first 2^k records of
    every file and pointers over 2^k records; it ends when the known records stop growing."""
    start = f"off = {len(MAGIC)}"
    jump = cand.where(f"gap OR {start}").select("file", "off", F.col("next"))
    known = cand.where(start).select("file", "off")
    step = written(jump, "warc-jump")
    n, last = written(known, "warc-known"), -1
    while (size := n.count()) != last:
        last = size
        ahead = n.join(step, ["file", "off"]).select("file", F.col("next").alias("off")).join(step.select("file", "off"), ["file", "off"], "left_semi")
        n = written(n.union(ahead).distinct(), "warc-known")
        far = step.select("file", F.col("off").alias("next"), F.col("next").alias("far"))
        step = written(step.join(far, ["file", "next"], "left").select("file", "off", F.col("far").alias("next")), "warc-jump")
    return n


def unfinished(cand: DataFrame, real: DataFrame) -> DataFrame:
    """(file, read_bytes, ends_at, file_bytes) of files whose chain does not end exactly at their end, where ``ends_at`` is the end that the last record
    of the chain claims, or whose pieces are not all of their bytes. The gap behind the last record of a file may be missing."""
    size = cand.groupBy("file").agg((F.sum(F.col("bytes") + len(MAGIC)) - len(MAGIC)).alias("read_bytes"), F.max("file_bytes").alias("file_bytes"))
    end = cand.join(real, ["file", "off"], "left_semi").groupBy("file").agg((F.max_by(F.struct("next"), "off")["next"] - len(MAGIC)).alias("ends_at"))
    ok = F.col("ends_at").isin(F.col("read_bytes"), F.col("read_bytes") + len(GAP)) & F.coalesce(F.col("file_bytes") == F.col("read_bytes"), F.lit(True))
    return size.join(end, "file", "left").where(~F.coalesce(ok, F.lit(False))).select("file", "read_bytes", "ends_at", "file_bytes")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below ``path``: record_type, page_id, refers_to, url, stated and measured digest and length, and
    with ``payloads`` the payload.

    Pieces that the chain does not reach are magic inside a payload; they are put back into the record before them. A file whose
    chain does not end exactly at its end (a header that cannot be read, a wrong length) raises. Nothing in a payload can add a record. Only
    records of several pieces, and payloads that are asked for, are shuffled; all else is measured where it is read.
    """
    pieces = written(candidates(spark, path), "warc-pieces")
    cand = written(offsets(pieces), "warc-candidates")
    known = reachable(spark, cand)
    if bad := unfinished(cand, known).orderBy("file").limit(5).collect():
        raise ValueError(f"archives not read to their end: {'; '.join(map(str, bad))}")
    real = known.withColumn("real", F.lit(True))
    upto = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = (cand.join(real, ["file", "off"], "left").withColumn("owner", F.last(F.when(F.col("real"), F.col("off")), ignorenulls=True).over(upto))
             .withColumn("parts", F.count("*").over(Window.partitionBy("file", "owner"))).where("owner IS NOT NULL"))
    owner = written(owner, "warc-owners")
    wanted = owner.select("file", "block", "seq", "off", "owner", "parts")
    wanted = wanted if payloads else written(wanted.where("parts > 1"), "warc-split")
    full = pieces.join(wanted, ["file", "block", "seq"])
    many = (full.where("parts > 1").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "body"))).alias("p"))
            .select(F.aggregate(F.expr("slice(p, 2, size(p))"), F.col("p")[0]["body"], lambda a, x: F.concat(a, F.lit(MAGIC).cast("binary"), x["body"])).alias("body")))
    whole = full.where("parts = 1").select("body").union(many) if payloads else many
    out = whole.select(*fields(F.col("body")), "body").withColumn("payload", F.expr("substring(body, head_bytes + 5, int(length))"))
    out = out.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    if payloads:
        return out.select(*RECORD, "payload")
    return owner.where("parts = 1").select(*RECORD).union(out.select(*RECORD))


def digests(records: DataFrame) -> DataFrame:
    """Length and digest of each record's full payload: of the payload read for responses; for revisits that of the response
    referred to, which must be the one stated (else null). Responses that many records refer to are copied to SALTS rows."""
    r = records.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "stated_digest")
    r = written(r, "warc-records")
    again = r.where("record_type = 'revisit'").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    wanted = again.select(F.col("refers_to").alias("wanted_id")).distinct()
    kept = (r.where("record_type = 'response'").join(wanted, F.col("page_id") == F.col("wanted_id"), "left_semi").dropDuplicates(["page_id", "payload_digest"])
            .select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("stated_digest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    again = (again.join(kept, ["refers_to", "stated_digest", "salt"], "left")
             .select("page_id", F.col("b").alias("payload_bytes"), F.when(F.col("b").isNotNull(), F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to"))
    return r.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)


def op2(spark, sf_dir: str) -> DataFrame:
    """Write all pages as archives in the shared folder and read them back."""
    path = shared_folder(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return digests(read_archives(spark, path, payloads=False))


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f
"""
