"""Byte-level BPE encoding and decoding: merges are folded by higher-order functions over the distinct words of a corpus."""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwright.llm.shared import let, short_plans, table, written

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
#: Parts of the rank map; a look-up reads one part of a few entries. A pair of ids is one number.
PARTS, WIDTH = 130003, 1 << 20
#: Words of a chunk of documents with one dictionary; a longer document is a chunk of its own.
CHUNK_WORDS = 5_000_000
SLICE_WORDS = 500_000
NEVER = 2 ** 31 - 1
#: Frequent words that every task knows, taken from so many words of about so many documents; all others meet their ids by a join.
HEAD, HEAD_DOCS, HEAD_DOC_WORDS = 262_144, 16_384, 2_000
#: Words of more bytes are folded in blocks of so many pieces.
LONG, BLOCK = 64, 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each token under both ids of every pair of tokens that it can be joined from."""
    return {ranks[t[:i]] * WIDTH + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: parts of (pairs, ranks), a pair being in the part of its remainder; and the ids of single bytes."""
    keys: list[list[int]] = [[] for _ in range(PARTS)]
    values: list[list[int]] = [[] for _ in range(PARTS)]
    for key, rank in pair_ranks(ranks).items():
        keys[key % PARTS].append(key)
        values[key % PARTS].append(rank)
    single = [ranks.get(bytes([b]), -1) for b in range(256)]
    return F.from_json(F.lit(json.dumps({"keys": keys, "values": values, "bytes": single})), "keys array<array<bigint>>, values array<array<int>>, bytes array<int>")


def fold(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word in Python; only for the tokens of a vocabulary, see ``unreached``."""
    p = [data[i:i + 1] for i in range(len(data))]
    while len(p) > 1:
        least, i = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(p, p[1:], strict=False)))
        if least == NEVER:
            break
        p[i:i + 2] = [p[i] + p[i + 1]]
    return [ranks[x] for x in p]


def unreached(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Tokens that merges do not lead to; a whole word that is a token has its id all the same."""
    return {t: r for t, r in ranks.items() if fold(t, ranks) != [r]}


def merged(word: Column, ranks: Column, direct: dict[bytes, int] | None = None) -> Column:
    """Ids of one word: start from its bytes, and join the leftmost pair of least rank until no pair has a rank.

    The state is the ids and the rank of each pair of neighbours, with -1 on both ends, so a step looks up two pairs only.
    ``direct``: whole words with an id of their own.
    """
    def with_map(m: Column) -> Column:
        def rank(a: Column, b: Column) -> Column:
            key = a.cast("long") * WIDTH + b
            return let((key % PARTS).cast("int"), lambda h: F.coalesce(F.get(F.get(m["values"], h), F.array_position(F.get(m["keys"], h), key).cast("int") - 1), F.lit(NEVER)))

        def state(ids: Column, pairs: Column) -> Column:
            return let(pairs, lambda r: F.struct(ids.alias("p"), r.alias("r"), F.array_min(r).alias("least")))

        def step(s: Column, _: Column) -> Column:
            p, r, least = s["p"], s["r"], s["least"]

            def join(at: Column) -> Column:
                return state(F.concat(F.slice(p, F.lit(1), at - 1), F.array(least), F.slice(p, at + 2, F.size(p))),
                             F.concat(F.slice(r, F.lit(1), at - 2), F.array(rank(F.get(p, at - 2), least), rank(least, F.get(p, at + 1))), F.slice(r, at + 2, F.size(p))))

            return F.when(least == NEVER, s).otherwise(let(F.array_position(r, least).cast("int"), join))

        def run(p: Column) -> Column:
            start = state(p, F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(F.get(p, i), F.get(p, i + 1))))
            return F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, step, lambda s: F.slice(s["p"], F.lit(2), F.size(s["p"]) - 2))

        def in_blocks(p: Column) -> Column:
            """The same fold over blocks of pieces with the least rank of each: a step rewrites four blocks, not the word."""
            every = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.when(i + 1 < F.size(p), rank(F.get(p, i), F.get(p, i + 1))).otherwise(NEVER))

            def cut(a: Column, r: Column) -> Column:
                return F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.struct(F.slice(a, b * BLOCK + 1, F.lit(BLOCK)).alias("p"), F.slice(r, b * BLOCK + 1, F.lit(BLOCK)).alias("r")))

            def least_of(blocks: Column) -> Column:
                return F.transform(blocks, lambda b: F.array_min(b["r"]))

            def whole(blocks: Column) -> Column:
                return let(blocks, lambda b: F.struct(b.alias("b"), least_of(b).alias("m")))

            def long_step(s: Column, _: Column) -> Column:
                def join(n: Column) -> Column:
                    low, p, r, least = n["low"], n["p"], n["r"], n["least"]

                    def at_place(at: Column) -> Column:
                        a = F.concat(F.slice(p, F.lit(1), at - 1), F.array(least), F.slice(p, at + 2, F.size(p)))
                        q = F.concat(F.slice(r, F.lit(1), at - 2), F.array(rank(F.get(p, at - 2), least), rank(least, F.get(p, at + 1))), F.slice(r, at + 2, F.size(r)))
                        around = lambda every, new: F.concat(F.slice(every, F.lit(1), low - 1), new, F.slice(every, low + 4, F.size(every)))
                        return let(F.struct(a.alias("p"), q.alias("r")), lambda w: let(cut(w["p"], w["r"]), lambda new: F.struct(around(s["b"], new).alias("b"), around(s["m"], least_of(new)).alias("m"))))

                    return let(F.array_position(r, least).cast("int"), at_place)

                def near(least: Column) -> Column:
                    low = F.greatest(F.array_position(s["m"], least).cast("int") - 1, F.lit(1))
                    four = let(low, lambda i: F.struct(i.alias("low"), F.slice(s["b"], i, F.lit(4)).alias("b")))
                    return let(four, lambda w: let(F.struct(w["low"].alias("low"), F.flatten(F.transform(w["b"], lambda b: b["p"])).alias("p"), F.flatten(F.transform(w["b"], lambda b: b["r"])).alias("r"), least.alias("least")), join))

                return let(F.array_min(s["m"]), lambda least: F.when(least == NEVER, s).otherwise(near(least)))

            ids = lambda s: let(F.flatten(F.transform(s["b"], lambda b: b["p"])), lambda q: F.slice(q, F.lit(2), F.size(q) - 2))
            return let(every, lambda r: F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), whole(cut(p, r)), long_step, ids))

        end = F.array(F.lit(-1))
        ids = F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(m["bytes"], F.ascii(c)))
        return F.when(F.octet_length(word) == 1, ids).otherwise(let(F.concat(end, ids, end), lambda p: F.when(F.size(p) > LONG, in_blocks(p)).otherwise(run(p))))

    out = let(ranks, with_map)
    if direct:
        known = F.from_json(F.lit(json.dumps({t.hex().upper(): r for t, r in direct.items()})), "map<string,int>")
        out = F.coalesce(F.when(F.try_element_at(known, F.hex(word.cast("binary"))).isNotNull(), F.array(F.try_element_at(known, F.hex(word.cast("binary"))))), out)
    return out


def words_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def packed(*arrays: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: small numbers are frequent, so the higher planes nearly vanish."""
    planes = np.concatenate([a.astype("<i4") for a in arrays]).view(np.uint8).reshape(-1, 4).T
    return pa.Codec("zstd", compression_level=6).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * count, "zstd", asbytes=True), np.uint8).reshape(4, count)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def frequent(docs: DataFrame, pattern: str, fold) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Up to HEAD frequent words of a bounded sample, where the ids of each end, and their ids. Which words these are does not change any result."""
    few = docs.select("text").sample(min(1.0, HEAD_DOCS / max(1, docs.count())), 7).select(F.explode(F.slice(words_of(F.col("text"), pattern), 1, HEAD_DOC_WORDS)).alias("word"))
    top = written(few.groupBy("word").count().orderBy(F.desc("count"), "word").limit(HEAD), "bpe-frequent")
    with short_plans(docs.sparkSession):
        got = written(top.repartition("word").select("word", "count", fold(F.col("word")).alias("ids")), "bpe-frequent-ids").toArrow().sort_by([("count", "descending"), ("word", "ascending")])
    ids = got.column("ids").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    return got.column("word").combine_chunks().cast(pa.string()), np.cumsum(np.diff(np.asarray(ids.offsets))), np.asarray(ids.flatten(), dtype=np.int32)


def chunks(docs: DataFrame, pattern: str, head: pa.Array) -> DataFrame:
    """One row per chunk of documents: its words that are not in ``head``, doc_ids, words of each document, and codes (places in
    head and words, compressed). Chunks are cut inside tasks; nothing is shuffled."""
    def job(batches):
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            words = batch.column("words")
            off = np.asarray(words.offsets)
            i = 0
            while i < len(words):
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK_WORDS, "right")) - 1)
                coded = words.values.slice(off[i], off[j] - off[i]).dictionary_encode()
                known = pc.index_in(coded.dictionary, head)
                rare = np.asarray(known.is_null())
                place = np.where(rare, len(head) + np.cumsum(rare) - 1, np.asarray(known.fill_null(0))).astype(np.int32)
                codes = place[np.asarray(coded.indices)] if len(place) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([coded.dictionary.filter(pa.array(rare))], pa.list_(pa.string())), pa.array([batch.column("doc_id").slice(i, j - i)], pa.list_(batch.schema.field("doc_id").type)),
                     pa.array([np.diff(off[i:j + 1])], pa.list_(pa.int32())), pa.array([packed(codes)])],
                    names=["chunk", "words", "doc_ids", "sizes", "codes"])
                chunk, i = chunk + 1, j
            pa.default_memory_pool().release_unused()  # workers live on for later stages

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", words_of(F.col("text"), pattern).alias("words"))
    return d.mapInArrow(job, f"chunk long, words array<string>, doc_ids array<{kind}>, sizes array<int>, codes binary")


def _runs(batches):
    """Equal words of a sorted partition as one row with the chunks and places that hold them; a batch bounds a run."""
    for batch in batches:
        word = batch.column("word")
        if not len(word):
            continue
        new = np.concatenate([[True], np.asarray(pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)))])
        starts = np.flatnonzero(new)
        off = pa.array(np.append(starts, len(word)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([word.take(pa.array(starts)), pa.ListArray.from_arrays(off, batch.column("chunk")), pa.ListArray.from_arrays(off, batch.column("place"))], names=["word", "chunks", "places"])


def _by_chunk(batches):
    """Ids of words, packed for each chunk that holds them: places, numbers of ids, ids."""
    for batch in batches:
        ids, where = batch.column("ids"), batch.column("chunks")
        many = np.diff(np.asarray(where.offsets))
        off, flat = np.asarray(ids.offsets).astype(np.int64), np.asarray(ids.values)
        row = np.repeat(np.arange(len(ids)), many)
        chunk, place = np.asarray(where.flatten()), np.asarray(batch.column("places").flatten())
        order = np.argsort(chunk, kind="stable")
        cut = np.flatnonzero(np.diff(chunk[order])) + 1
        out: dict = {"of_chunk": [], "n_words": [], "n_ids": [], "data": []}
        for part in np.split(order, cut):
            if len(part):
                r = row[part]
                length = off[r + 1] - off[r]
                got = flat[np.repeat(off[r] - np.cumsum(length) + length, length) + np.arange(length.sum())]
                for k, v in zip(out, (int(chunk[part[0]]), len(part), len(got), packed(place[part], length, got)), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("of_chunk", pa.int64()), ("n_words", pa.int32()), ("n_ids", pa.int32()), ("data", pa.binary())]))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text.

    Each match of ``pattern`` is merged separately and strings of special tokens are ordinary text. Distinct words are
    merged once: frequent ones before all else, for every task to know (at most HEAD); the others are shuffled by word with the chunks of documents
    that hold them, merged, and sent back packed by chunk. A chunk has a word once, so a frequent word is no hot
    key. Null and empty texts have no tokens. A text may be one long word. Repeated rows and ids are rows of their own; extra columns
    are ignored; no rows give no rows.
    """
    ranks = read_ranks(path or public_tokenizers.path(RANK_FILE))
    literal, direct = rank_literal(ranks), unreached(ranks)
    fold = lambda word: merged(word, literal, direct)
    head, head_ends, head_ids = frequent(docs, pattern, fold)
    parts = written(chunks(docs, pattern, head), "bpe-chunks", codec="zstd")
    entries = parts.select("chunk", F.posexplode("words").alias("place", "word")).repartition("word").sortWithinPartitions("word")
    rare = entries.mapInArrow(_runs, "word string, chunks array<long>, places array<int>").select(fold(F.col("word")).alias("ids"), "chunks", "places")
    with short_plans(docs.sparkSession):
        found = written(rare.mapInArrow(_by_chunk, "of_chunk long, n_words int, n_ids int, data binary"), "bpe-ids", codec="zstd")
    kind = docs.schema["doc_id"].dataType.simpleString()
    del ranks, literal, direct, fold

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        begins, lengths, flat, total = [head_ends - np.diff(head_ends, prepend=0)], [np.diff(head_ends, prepend=0)], [head_ids], len(head_ids)
        place, begin, length = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, m, data in zip(*(right.column(c).to_pylist() for c in ("n_words", "n_ids", "data")), strict=True):
            values = unpacked(data, 2 * n + m)
            size = values[n:2 * n].astype(np.int64)
            place.append(values[:n])
            length.append(size)
            begin.append(total + np.cumsum(size) - size)
            flat.append(values[2 * n:])
            total += m
        order = np.argsort(np.concatenate(place))
        begins, lengths = np.concatenate([*begins, np.concatenate(begin)[order]]), np.concatenate([*lengths, np.concatenate(length)[order]])
        ids = np.concatenate(flat)
        docs_, lists = [], []
        for row in range(left.num_rows):
            ends = np.concatenate([[0], np.cumsum(np.asarray(left.column("sizes")[row].values), dtype=np.int64)])
            codes = unpacked(left.column("codes")[row].as_py(), int(ends[-1]))
            docs_.append(left.column("doc_ids")[row].values)
            i = 0
            while i < len(ends) - 1:  # documents of some hundred thousand words at a time
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE_WORDS, "right")) - 1)
                own = codes[ends[i]:ends[j]]
                n = lengths[own]
                to = np.concatenate([[0], np.cumsum(n)])
                got = ids[np.repeat(begins[own] - to[:-1], n) + np.arange(to[-1])]
                lists.append(pa.ListArray.from_arrays(pa.array(to[ends[i:j + 1] - ends[i]].astype(np.int32)), pa.array(got.astype(np.int32))))
                i = j
        del place, begin, length, order, begins, lengths, flat, ids
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": pa.chunked_array(docs_, left.schema.field("doc_ids").type.value_type).combine_chunks(), "ids": pa.chunked_array(lists, pa.list_(pa.int32())).combine_chunks()})

    return parts.drop("words").groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(assemble, f"doc_id {kind}, ids array<int>")


def decode(ids: Column, path: str | None = None) -> Column:
    """Bytes of a list of ids: the tokens' binary pieces, one after the other (as hexadecimal digits, so that joining is linear). Null ids give null."""
    ranks = read_ranks(path or public_tokenizers.path(RANK_FILE))
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    every = F.split(F.lit(",".join(pieces)), ",")
    return let(every, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))


def digests(out: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(decode(F.col("ids")), 256).alias("decoded_sha256"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    return digests(encode(table(spark, sf_dir, "documents")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of every row that is left; the text is decoded from the ids.

    Null and empty texts have no ids and an empty text; repeated rows stay; extra columns are ignored; no rows give no rows.
    """
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", decode(F.col("ids")).cast("string").alias("text"))
