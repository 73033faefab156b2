"""Secret scans over an incremental ledger of blobs; native DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.shared import table, written

#: kind -> (version, pattern, group whose length counts, least length). The first three are the base kinds, in their order.
RULES = {
    "assign": (1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (1, r"[0-9a-f]{32,}", 0, 32),  # whole runs: the same finds as [0-9a-f]+ of which short ones are dropped
    "jwt": (1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    "github": (1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    "pem": (1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
}
BASE = ("assign", "access", "hex")
#: A whole private key: from BEGIN through the END line of the same name, or where that is missing through all lines of base64 (and headers)
#: and runs of 16 base64 characters that follow. Line ends may be escaped. Possessive, so a long text costs one pass and no stack.
KEY_BLOCK = (r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY((?: BLOCK)?)-----(?:(?:[^-]++|-(?!----))*+-----END \1PRIVATE KEY\2-----"
             r"|(?:(?:\s|\\[nr])*+(?:[A-Za-z0-9+/=]{16,}+|(?<=[\r\n]|\\[nr])[A-Za-z0-9+/=]++(?=[\x20\t]*(?:[\r\n]|\\[nr]|\z))|(?<=[\r\n]|\\[nr])[A-Za-z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+))*+)")
#: What redaction needs. RULES, whose patterns are those of the query's SQL, ends a key at its first line.
REDACTED = {**RULES, "pem": (2, KEY_BLOCK, 0, 1)}
SALTS = 16


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with ``least`` characters in ``group``: array of (start, stop) in code points."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m))
    sizes = found if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,stop:int>>)").alias("out"))

    def add(acc, m):
        at = acc["at"] + m["pieces"]
        stop = at + m["found"]
        return F.struct(stop.alias("at"), F.when(m["sizes"] >= least, F.concat(acc["out"], F.array(F.struct(at.alias("start"), stop.alias("stop"))))).otherwise(acc["out"]).alias("out"))

    zipped = F.filter(F.arrays_zip(pieces.alias("pieces"), found.alias("found"), sizes.alias("sizes")), lambda z: z["found"].isNotNull())
    return F.aggregate(zipped, start, add, lambda acc: acc["out"])


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, start, stop) for pairs of blob and rule version that ``ledger`` lacks.

    ``history`` has (blob, text), a row per version of a path; a blob that many paths hold is scanned once: one row of it is kept. A
    pair that was scanned without a find leaves a row with null start, so it is not scanned again.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v[0]).alias("version")) for k, v in rules.items()])
    blobs = history.dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("unseen", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("unseen", F.when(F.col("seen").isNull(), wanted).otherwise(F.array_except(wanted, "seen"))).where(F.size("unseen") > 0)
    none = F.expr("CAST(array() AS array<struct<start:int,stop:int>>)")
    per_rule = [
        F.struct(F.lit(k).alias("kind"), F.lit(v[0]).alias("version"), F.when(F.array_contains(F.transform("unseen", lambda u: u["kind"]), k), F.when(F.col("text").rlike(v[1]), spans(F.col("text"), *v[1:])).otherwise(none)).otherwise(none).alias("spans"),
                 F.array_contains(F.transform("unseen", lambda u: u["kind"]), k).alias("scanned"))
        for k, v in rules.items()
    ]
    out = blobs.select("blob", F.explode(F.array(*per_rule)).alias("r")).where("r.scanned")
    return out.select("blob", "r.kind", "r.version", F.explode_outer("r.spans").alias("s")).select("blob", "kind", "version", "s.start", "s.stop")


def find(docs: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES, name: str = "found") -> tuple[DataFrame, DataFrame]:
    """(``docs`` with a column ``name``: array of (start, rank, kind, stop) in order, and the ledger with this scan added).

    A text's blob is its sha-256; null text is the empty blob. Repeated rows and shared texts get the same finds. Finds of a
    blob are spread over SALTS rows, so that a blob that a third of all paths hold is no hot key. Extra columns are kept, one
    called ``name`` is replaced; no rows give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), F.sha2(text, 256).alias("blob"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    new = written(scan(docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")), ledger, rules), "secret-ledger")
    whole = new if ledger is None else ledger.unionByName(new)
    rank = F.array_position(F.array(*[F.lit(k) for k in rules]), F.col("kind")).cast("int")
    hits = (whole.where(F.col("start").isNotNull() & (rank > 0)).withColumn("rank", rank)
            .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "stop"))).alias("found"))
            .select("blob", "found", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    none = F.expr("CAST(array() AS array<struct<start:int,rank:int,kind:string,stop:int>>)")
    out = d.join(hits, ["blob", "salt"], "left")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != name.lower()], F.coalesce("found", none).alias(name)), whole


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every found span replaced by ``[secret]``; spans that touch or overlap become one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, f):
        new = F.when(f["start"] > acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, f["start"] - acc["at"]), F.lit("[secret]")))
        first = F.when((f["start"] == 0) & (acc["at"] == 0), F.lit("[secret]"))
        return F.struct(F.greatest(acc["at"], f["stop"]).alias("at"), F.coalesce(new, first, acc["out"]).alias("out"))

    return F.aggregate(found, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, 2 ** 31 - 1)))


def op8(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents, each a version of a path; the ledger starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = find(docs)
    count = lambda k: F.size(F.filter("found", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda f: f["kind"].isin(*BASE))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    """Offsets from the lengths of the matches and of what lies between them."""
    parts = []
    for rank, (kind, (_, pattern, group, least)) in enumerate(RULES.items(), 1):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(m) + 1)) AS i, m, g, p, {least} AS least FROM (SELECT doc_id, "
            f"regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d)")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT doc_id, kind, rank, length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i-1], '')) AS start, length(m[i]) AS n
      FROM f WHERE length(g[i]) >= least),
x AS (SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || start + n AS v FROM s),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             coalesce(string_agg(v, ',' ORDER BY start, rank) FILTER (rank <= 3), '') AS base, string_agg(v, ',' ORDER BY start, rank) AS spans FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)
"""


OP8_SQL = _sql()
