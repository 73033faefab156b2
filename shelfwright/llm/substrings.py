"""Exact removal of repeated substrings by a distributed merge sort of suffixes that never compares a known prefix again."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.shared import table, written
from shelfwright.llm.textarrays import prefix_hash, range_hash, slices

LENGTH = 200
#: Every repeated string of LENGTH bytes holds, at the same place in all its copies, one anchor of this length.
ANCHOR = 50
SLACK = LENGTH - ANCHOR
#: Suffixes that one task merges, about, and of one anchor, at most; and bytes of suffixes in a run that a task sorts.
MERGE_ROWS = 50_000
RUN_BYTES = 48 << 20


def anchors(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (place, hash): of the ANCHOR-byte strings inside any LENGTH bytes the one with the least hash, the leftmost of equals."""
    n = len(flat)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - ANCHOR + 1)
    h = range_hash(prefix_hash(flat), at, at + ANCHOR)
    # Least hash of each run of SLACK + 1 places, by doubling; a place stands for (hash, place).
    low, width = np.arange(len(h)), 1
    while width < SLACK + 1:
        step = min(width, SLACK + 1 - width)
        a, b = low[:len(low) - step], low[step:]
        low = np.where(h[b] < h[a], b, a)
        width += step
    ends = np.repeat(off[1:], np.diff(off))[:len(low)]
    picked = np.unique(low[at[:len(low)] + LENGTH <= ends])
    return picked, h[picked]


def rows_of(docs: DataFrame) -> DataFrame:
    """A row per document: rid, doc_id, text_key, bytes, and its anchors (places, hashes)."""
    def job(batches):
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows, flat, off in slices(batch, "text"):
                at, h = anchors(flat, off)
                cut = np.searchsorted(at, off)
                at = at - np.repeat(off[:-1], np.diff(cut))
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(v)) for v in (at.astype(np.int32), h.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(rows))), rows.column(0), rows.column(1), pa.array(np.diff(off)), *lists],
                                                 names=["rid", "doc_id", "text_key", "n_bytes", "places", "hashes"])
                rid += len(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_key"), "text")
    return d.mapInArrow(job, f"rid long, doc_id {kind}, text_key string, n_bytes long, places array<int>, hashes array<long>")


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that agree on the first ``known`` bytes."""
    n = min(len(a), len(b))
    d = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not d else n - (d.bit_length() + 7) // 8


def front_coded(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Sorted strings as common prefix lengths with the string before, lengths of the rest, and the rests."""
    shared = np.zeros(len(keys), np.uint8)
    rest, last = [], b""
    for i, k in enumerate(keys):
        shared[i] = n = common(last, k, 0)
        rest.append(k[n:])
        last = k
    return shared, np.fromiter(map(len, rest), np.uint8, len(rest)), b"".join(rest)


def unfolded(shared, lengths, rest: bytes):
    """The strings of a front-coded run with their common prefix lengths, one after another."""
    last, at = b"", 0
    for n, m in zip(shared, lengths, strict=True):
        last = last[:n] + rest[at:at + m]
        at += m
        yield last, n


class LoserTree:
    """Merge of sorted runs of (string, prefix shared with the string before).

    Every waiting string knows how much of the last winner it starts with. Of two, the one that shares more is smaller
    and no byte is looked at; only where both share as much are bytes compared, from there on.
    """

    def __init__(self, runs: list):
        self.runs, self.size = runs, 1 << max(0, (len(runs) - 1).bit_length())
        self.key: list = [None] * self.size
        self.shared = [0] * self.size
        for i in range(len(runs)):
            self._pull(i)
            self.shared[i] = 0
        self.loser = [0] * self.size
        self.top = self._build(1)

    def _pull(self, i: int) -> None:
        self.key[i], self.shared[i] = next(self.runs[i], (None, 0))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, lose = self._match(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node] = lose
        return win

    def _match(self, i: int, j: int) -> tuple[int, int]:
        a, b, key = self.shared[i], self.shared[j], self.key
        if key[i] is None or key[j] is None:
            return (j, i) if key[i] is None else (i, j)
        if a != b:
            return (i, j) if a > b else (j, i)
        x, y = key[i], key[j]
        n = common(x, y, a)
        # The loser now waits behind this winner: what it shares with it is what it will be matched by.
        if x[n:n + 1] < y[n:n + 1] or (x[n:n + 1] == y[n:n + 1] and i < j):
            self.shared[j] = n
            return i, j
        self.shared[i] = n
        return j, i

    def __iter__(self):
        """(run, string, prefix shared with the string before), in order."""
        win, loser, shared = self.top, self.loser, self.shared
        while self.key[win] is not None:
            yield win, self.key[win], shared[win]
            self._pull(win)
            node = (win + self.size) >> 1
            while node:
                win, loser[node] = self._match(win, loser[node])
                node >>= 1


def _blocks(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Number of the block of each row: neighbours in ``order`` that share ``least`` or more are in one."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < least)
    return out


def repeated_reach(shared: np.ndarray, lengths: np.ndarray, lefts: list[bytes], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For suffixes in order (``shared`` with the one before; ``lefts``: the bytes before each, last first): rows, and the least and most
    bytes that a repeated string of LENGTH bytes around the suffix's start reaches to the left."""
    n = len(lefts)
    width = np.fromiter(map(len, lefts), np.int64, n)
    left = np.frombuffer(b"".join(x.ljust(SLACK, b"\0") for x in lefts), np.uint8).reshape(n, SLACK)
    group = np.cumsum(shared < ANCHOR)
    alone = np.bincount(group)[group] < 2
    live = np.flatnonzero(~alone)
    low, high = np.full(n, 255, np.int64), np.full(n, -1, np.int64)
    if not len(live):
        return live, low[live], high[live]
    text = left[live].view(f"S{SLACK}").ravel()
    by_left = live[np.lexsort((text, group[live]))]
    differ = left[by_left][1:] != left[by_left][:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), SLACK)
    same[group[by_left][1:] != group[by_left][:-1]] = -1
    left_shared = np.concatenate([[-1], same])
    right = np.arange(n)
    for x in range(SLACK + 1):
        ok = live[(width[live] >= x) & (lengths[live] >= LENGTH - x)]
        if len(ok) < 2:
            continue
        r = _blocks(right, shared, LENGTH - x)[ok]
        blocks = np.zeros(n, np.int64)
        blocks[by_left] = np.cumsum(left_shared < x)
        key = r * (n + 1) + blocks[ok]
        order = np.argsort(key, kind="stable")
        k = key[order]
        eq = k[1:] == k[:-1]
        twice = ok[order[np.concatenate([[False], eq]) | np.concatenate([eq, [False]])]]
        low[twice] = np.minimum(low[twice], x)
        high[twice] = np.maximum(high[twice], x)
    hit = np.flatnonzero(high >= 0)
    return hit, low[hit], high[hit]


def runs_of(texts: DataFrame, parts: int) -> DataFrame:
    """(part, run): sorted runs of suffixes from anchors that occur more than once, front-coded and compressed. ``texts`` has rid, text
    and its anchors (places, hashes); equal anchors go to the same part."""
    def job(batches):
        rows: list[tuple[int, bytes, bytes, int, int]] = []
        size = 0

        def flush():
            rows.sort()
            i = 0
            while i < len(rows):
                j = i
                while j < len(rows) and rows[j][0] == rows[i][0]:
                    j += 1
                block = rows[i:j]
                shared, lengths, rest = front_coded([r[1] for r in block])
                lefts = [r[2] for r in block]
                raw = [np.array([len(block), len(rest)], np.int64).tobytes(), shared.tobytes(), lengths.tobytes(), np.fromiter(map(len, lefts), np.uint8, len(lefts)).tobytes(),
                       np.array([r[3] for r in block], np.int64).tobytes(), np.array([r[4] for r in block], np.int32).tobytes(), rest, b"".join(lefts)]
                data = b"".join(raw)
                yield block[0][0], np.array([len(data)], np.int64).tobytes() + pa.compress(data, "zstd", asbytes=True)
                i = j
            rows.clear()

        def batch_of(made):
            made = list(made)
            return pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["part", "run"])

        for batch in batches:
            for b, flat, off in slices(batch, "text"):
                data = flat.tobytes()
                for k in range(len(b)):
                    rid, begin, end = b.column("rid")[k].as_py(), int(off[k]), int(off[k + 1])
                    for place, h in zip(b.column("places")[k].as_py(), b.column("hashes")[k].as_py(), strict=True):
                        a = begin + place
                        rows.append((h % parts, data[a:min(end, a + LENGTH)], data[max(begin, a - SLACK):a][::-1], rid, place))
                        size += LENGTH + SLACK
                if size > RUN_BYTES:
                    yield batch_of(flush())
                    size = 0
        if rows:
            yield batch_of(flush())

    return texts.mapInArrow(job, "part long, run binary")


def _unpacked(run: bytes):
    data = pa.decompress(run[8:], int(np.frombuffer(run, np.int64, 1)[0]), "zstd", asbytes=True)
    n, m = (int(v) for v in np.frombuffer(data, np.int64, 2))
    at, out = 16, []
    for kind, count in ((np.uint8, n), (np.uint8, n), (np.uint8, n), (np.int64, n), (np.int32, n)):
        out.append(np.frombuffer(data, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return *out, data[at:at + m], data[at + m:]


def merge(table_: pa.Table) -> pa.Table:
    """All runs of one part: (rid, start, stop) of byte ranges that repeated strings cover."""
    packs = [_unpacked(r.as_py()) for r in table_.column("run")]
    lefts = []
    for p in packs:
        cut = np.concatenate([[0], np.cumsum(p[2], dtype=np.int64)]).tolist()
        lefts.append([p[6][i:j] for i, j in zip(cut, cut[1:], strict=False)])
    tree = LoserTree([unfolded(p[0].tolist(), p[1].tolist(), p[5]) for p in packs])
    used = [0] * len(packs)
    shared, lengths, left, rid, place = [], [], [], [], []
    for run, key, n in tree:
        i = used[run]
        used[run] += 1
        shared.append(n)
        lengths.append(len(key))
        left.append(lefts[run][i])
        rid.append(int(packs[run][3][i]))
        place.append(int(packs[run][4][i]))
    rid, place = np.array(rid, np.int64), np.array(place, np.int64)
    hit, low, high = repeated_reach(np.array(shared, np.int64), np.array(lengths, np.int64), left, rid, place)
    return pa.table({"rid": rid[hit], "start": place[hit] - high, "stop": place[hit] - low + LENGTH})


def wide_reach(texts: DataFrame) -> DataFrame:
    """(rid, start, stop) as ``merge`` gives them, of anchors that too many suffixes start with for one task. ``texts`` has rid, text and the
    places of such anchors (wide).

    Suffixes with the same bytes on both sides are one context with a count. The strings of LENGTH bytes around a context's anchor are
    counted by (bytes before the anchor, digest of the string), so neither an anchor nor a string is a task's own.
    """
    def job(batches):
        out: list[tuple[int, int, bytes, bytes, int]] = []
        names = ["rid", "place", "context", "around", "n_left"]

        def batch_of():
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32())
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for b, flat, off in slices(batch, "text"):
                data = flat.tobytes()
                for k in range(len(b)):
                    rid, begin, end = b.column("rid")[k].as_py(), int(off[k]), int(off[k + 1])
                    for place in np.asarray(b.column("wide")[k].values).tolist():
                        a = begin + place
                        n = min(place, SLACK)
                        around = data[a - n:min(end, a + LENGTH)]
                        out.append((rid, place, hashlib.blake2b(bytes([n]) + around, digest_size=16).digest(), around, n))
                        if len(out) >= 10_000:
                            yield batch_of()
        if out:
            yield batch_of()

    rows = written(texts.select("rid", "text", "wide").mapInArrow(job, "rid long, place long, context binary, around binary, n_left int"), "sub-wide")
    contexts = written(rows.groupBy("context", "around", "n_left").agg(F.count("*").alias("n")), "sub-contexts")
    least = F.greatest(F.lit(0), LENGTH - (F.octet_length("around") - F.col("n_left")))
    windows = (contexts.select("context", "around", "n_left", "n", F.explode(F.when(least <= F.col("n_left"), F.sequence(least, F.col("n_left")))).alias("x"))
               .select("context", "n", "x", F.unhex(F.md5(F.expr(f"substring(around, n_left - x + 1, {LENGTH})"))).alias("string")))
    repeated = windows.groupBy("x", "string").agg(F.sum("n").alias("n")).where("n > 1").select("x", "string")
    reach = windows.select("context", "x", "string").join(repeated, ["x", "string"], "left_semi").groupBy("context").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    return rows.select("rid", "place", "context").join(reach, "context").select("rid", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + LENGTH).alias("stop"))


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): a row per document with rid, doc_id, text_key, n_bytes and ``copies`` of its text; and (rid, text, spans) of the
    texts, one of each, with ``spans`` of bytes to remove (start, stop), in order and apart.

    1. Each text is cut at anchors; only texts of one row of each group of copies are looked at further. 2. Anchors whose hash occurs
    more than once are suffix starts. 3. Tasks sort suffixes into front-coded runs; parts merge their runs with a loser tree.
    4. Neighbours in suffix order, split by the bytes to the left, are the strings of LENGTH bytes that occur twice. Anchors of more than
    MERGE_ROWS suffixes are left out of 3 and 4, see ``wide_reach``.
    """
    rows = written(rows_of(docs), "sub-rows")
    groups = rows.groupBy("text_key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
    first = written(groups, "sub-texts")
    at = (rows.join(first.select("rid"), "rid", "left_semi").select("rid", F.explode(F.arrays_zip("places", "hashes")).alias("a"))
          .select("rid", F.col("a.places").alias("place"), F.col("a.hashes").alias("hash")))
    twice = at.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", (F.col("n") > MERGE_ROWS).alias("wide"))
    kept = at.join(twice, "hash").groupBy("rid").agg(F.collect_list(F.struct("place", "hash", "wide")).alias("a"))
    few, many = F.filter("a", lambda x: ~x["wide"]), F.filter("a", lambda x: x["wide"])
    kept = written(kept.select("rid", F.transform(few, lambda x: x["place"]).alias("places"), F.transform(few, lambda x: x["hash"]).alias("hashes"), F.transform(many, lambda x: x["place"]).alias("wide")), "sub-anchors")
    wanted = rows.select("rid", F.col("doc_id").alias("want_id"), F.col("text_key").alias("want_key")).join(kept, "rid")
    d = docs.select("doc_id", "text").withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = d.join(wanted, F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("text_key") == F.col("want_key"))).select("rid", "text", "places", "hashes", "wide")
    texts = written(texts, "sub-wanted")
    total, wide = kept.agg(*[F.coalesce(F.sum(F.size(x)), F.lit(0)) for x in ("places", "wide")]).first()
    found = runs_of(texts.drop("wide"), max(1, total // MERGE_ROWS)).groupBy("part").applyInArrow(merge, "rid long, start long, stop long")
    if wide:
        found = found.unionByName(wide_reach(texts.where(F.size("wide") > 0)))
    one = F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint>>)")

    def add(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["stop"], grown).otherwise(F.concat(acc, F.array(s)))

    ranges = found.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"))
    ranges = written(ranges.select("rid", F.aggregate("s", one, add).alias("spans")), "sub-spans")
    cut = texts.select("rid", "text").dropDuplicates(["rid"]).join(ranges, "rid")
    return rows.drop("places", "hashes").join(first.select("text_key", "copies"), "text_key"), cut


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A text that occurs twice is removed whole if it has LENGTH bytes. Null and empty texts have no bytes. Repeated rows are
    copies of each other. Extra columns are ignored; no rows give no rows.
    """
    rows, cut = spans(docs)

    def job(batches):
        for batch in batches:
            digests, gone = [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, at, h = text.encode(), 0, hashlib.sha256()
                for s in ranges:
                    h.update(data[at:s["start"]])
                    at = s["stop"]
                h.update(data[at:])
                digests.append(h.hexdigest())
                gone.append(sum(s["stop"] - s["start"] for s in ranges))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(gone, pa.int64()), pa.array([len(s) for s in batch.column("spans").to_pylist()], pa.int64()), pa.array(digests, pa.string())],
                                             names=["rid", "gone", "n", "digest"])

    cut = cut.select("rid", "text", "spans").mapInArrow(job, "rid long, gone long, n long, digest string")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return rows.join(cut, "rid", "left").select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", zero)).alias("n_removed"), F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n", zero)).alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("digest", "text_key")).alias("kept_sha256"))


def op7(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 200 bytes."""
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
