"""Quality rules: a decision list learned from labelled statistics by sequential covering, applied as Spark conditions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwright.llm.shared import table
from shelfwright.llm.textarrays import is_space, prefix_hash, range_hash, row_of, runs, slices, windows

SYMBOLS = b"#*$%&|<>"
BASE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a learned condition may test: shares and means of a text.
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "words_per_line")
#: Labelled rows that the rules are learned from, at most: those with the smallest hashes.
MAX_LABELLED = 20_000
#: A rule must be right about so many of the rows that it rejects, on rows it was not grown on.
LEAST_PRECISION = 0.9
SEED = 11


def _counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, key) pairs in order: true where the pair occurs twice or more; true where it occurred before."""
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    before = np.concatenate([[False], same])
    any_of = before | np.concatenate([same, [False]])
    twice, earlier = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order], earlier[order] = any_of, before  # lexsort is stable: the first of equals keeps its place
    return twice, earlier


def text_stats(flat: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    space = is_space(flat)
    start, stop = runs(~space, off)
    row = row_of(off, start)
    prefix = prefix_hash(flat)
    word = range_hash(prefix, start, stop)
    covered = np.zeros(len(word) + 1, np.int64)
    if len(word) > 2:
        tri = windows(word, 3)
        ok = row[2:] == row[:-2]
        at = np.flatnonzero(ok)
        twice, _ = _repeats(tri[at], row[at])
        hit = at[twice]
        np.add.at(covered, hit, 1)
        np.add.at(covered, np.minimum(hit + 3, len(word)), -1)
    in_repeat = np.cumsum(covered)[:len(word)] > 0
    line_start, line_stop = runs(flat != 10, off)
    line_row = row_of(off, line_start)
    words_before = np.concatenate([[0], np.cumsum(~space)])
    real = words_before[line_stop] > words_before[line_start]
    line_start, line_stop, line_row = line_start[real], line_stop[real], line_row[real]
    _, earlier = _repeats(range_hash(prefix, line_start, line_stop), line_row)
    per_row = lambda r, w=None: np.bincount(r, weights=w, minlength=n).astype(np.int64)
    points = (flat & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return {
        "n_words": per_row(row), "word_chars": _counts(points & ~space, off), "n_symbols": _counts(symbol[flat], off),
        "n_dup_lines": per_row(line_row, earlier), "n_repeat_words": per_row(row, in_repeat), "n_lines": per_row(line_row),
        "n_upper": _counts((flat >= 65) & (flat <= 90), off), "n_digits": _counts((flat >= 48) & (flat <= 57), off),
        "n_marks": _counts((flat == 33) | (flat == 63), off),
    }


def stats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, counts of each whole text); null and empty texts count zero everywhere. One pass, bounded memory; a very long
    text is held alone."""
    names = (*BASE_STATS, "n_lines", "n_upper", "n_digits", "n_marks")

    def job(batches):
        for batch in batches:
            for rows, flat, off in slices(batch, "text"):
                s = text_stats(flat, off)
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(s[c]) for c in names]], names=["key", *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), "text").mapInArrow(job, f"key {kind}, " + ", ".join(f"{c} long" for c in names)).withColumnRenamed("key", key)


def features() -> dict[str, Column]:
    c = F.col
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    chars = c("word_chars")
    return {
        "n_words": c("n_words").cast("double"), "mean_word": share(chars, c("n_words")), "symbol_share": share(c("n_symbols"), chars), "dup_line_share": share(c("n_dup_lines"), c("n_lines")),
        "repeat_share": share(c("n_repeat_words"), c("n_words")), "upper_share": share(c("n_upper"), chars), "digit_share": share(c("n_digits"), chars),
        "mark_share": share(c("n_marks"), chars), "words_per_line": share(c("n_words"), c("n_lines")),
    }


def _covers(rule, x) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, t in rule:
        hit &= (x[:, f] > t) if above else (x[:, f] <= t)
    return hit


def _grow(x, bad, most: int = 3):
    """Add the condition with the best gain in precision, weighed by the bad rows still covered, until none is wrong."""
    rule, live = [], np.ones(len(x), bool)
    while len(rule) < most and (live & ~bad).any():
        p0 = (live & bad).sum() / max(1, live.sum())
        best = (0.0, None)
        for f in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[live, f], np.linspace(0.005, 0.995, 199)))
            v = np.sort(x[live & bad, f]), np.sort(x[live, f])
            for above in (True, False):
                p, n = ((len(a) - np.searchsorted(a, cuts, "right")) if above else np.searchsorted(a, cuts, "right") for a in v)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(n, 1)) - np.log2(p0)), 0) if p0 else np.zeros(len(cuts))
                k = int(np.argmax(gain)) if len(gain) else 0
                if len(gain) and gain[k] > best[0] + 1e-9:
                    # The threshold lies halfway to the next bad row, not at the edge of the good ones.
                    i = int(np.searchsorted(v[0], cuts[k], "right"))
                    edge = (cuts[k] + v[0][i]) / 2 if above else cuts[k]
                    best = (float(gain[k]), (f, above, float(edge)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= _covers(rule[-1:], x)
    return rule


def _prune(rule, x, bad):
    """Drop last conditions while (right - wrong) / covered on the pruning rows does not fall."""
    worth = lambda r: (2 * (c := _covers(r, x)).astype(int) @ bad - c.sum()) / max(1, c.sum())
    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, least_precision: float = LEAST_PRECISION, least_rows: int = 8) -> list[list[tuple[int, bool, float]]]:
    """Ordered rules for rejection. Every third row prunes and judges, the others grow; covered rows then leave."""
    part = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while (left & bad & ~part).sum() >= least_rows:
        g, p = left & ~part, left & part
        rule = _grow(x[g], bad[g])
        if not rule:
            break
        rule = _prune(rule, x[p], bad[p])
        hit = _covers(rule, x[p])
        if hit.sum() < max(2, least_rows // 4) or (hit & bad[p]).sum() < least_precision * hit.sum():
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[list[tuple[int, bool, float]]]:
    """Learn from at most ``most`` labelled rows (a bounded sample, by hash of the id); the statistics are computed by Spark.
    Labels that are null, and ids without a document, are left out. Without labels no rule is learned."""
    lab = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lab = lab.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)
    known = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
    s = stats(known).where(~base_failed()).select("doc_id", *[v.alias(f"f_{k}") for k, v in features().items()]).join(F.broadcast(lab), "doc_id")
    rows = s.orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").limit(most).toPandas()
    if not len(rows):
        return []
    return learn(rows[[f"f_{k}" for k in FEATURES]].to_numpy(float), rows["quality"].to_numpy() == 0)


def verdict(rules) -> Column:
    """The decision list as one conditional expression: the number of the first rule that rejects, or null."""
    cols, out = features(), F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        hit = F.lit(True)
        for f, above, t in rule:
            hit = hit & ((cols[FEATURES[f]] > t) if above else (cols[FEATURES[f]] <= t))
        out = F.when(hit, F.lit(k)).otherwise(out)
    return out


def judge(docs: DataFrame, rules, key: str = "doc_id") -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` and ``kept`` of every row. Base failures go whatever the rules say."""
    s = stats(docs, key).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents, judged by rules learned from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *BASE_STATS, "base_failed", "kept", "rule")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules reject; rules are learned from the labelled documents of the whole table."""
    rules = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = (*BASE_STATS, "n_lines", "n_upper", "n_digits", "n_marks")
    schema = T.StructType([T.StructField("row", docs.schema), *[T.StructField(c, T.LongType()) for c in counts]])

    def job(batches):
        for batch in batches:
            for rows, flat, off in slices(batch, "text"):
                s = text_stats(flat, off)
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(s[c]) for c in counts]], names=["row", *counts])

    out = docs.select(F.struct("*").alias("row"), "text").mapInArrow(job, schema)
    return out.where(~base_failed() & verdict(rules).isNull()).select(*[F.col("row")[c].alias(c) for c in docs.columns])
