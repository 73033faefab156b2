"""The manifest, its log and its proofs against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from shelfwright.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """Levels of a tree, and for each leaf its (left, right) siblings level by level."""
    levels, paths, at = [leaves], [[] for _ in leaves], list(range(len(leaves)))
    while len(levels[-1]) > 1:
        now, up = levels[-1], []
        for a in range(0, len(now), 16):
            up.append(H(*now[a:a + 16]))
        for d, i in enumerate(at):
            a = i // 16 * 16
            paths[d].append((now[a:i], now[i + 1:a + 16]))
        at = [i // 16 for i in at]
        levels.append(up)
    return levels, paths


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (own, *tree([leaf_of(r) for r in own]))
    top, top_paths = tree([trees[s][1][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        own, levels, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            whole = path + top_paths[k]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = leaf_of((*r[:4], lowered(r[4]))) if changed else leaf_of(r)
            for a, b in whole:
                fold = H(*a, fold, *b)
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0], H(*[x for a, b in whole for x in a + b]), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of():
    rows = [(i, "hot", "en", i % 7, f"Text {i % 50}" if i % 3 else f"text {i}") for i in range(4200)]
    rows += [(i, f"s{i % 23}", None, None, None if i % 11 == 0 else "" if i % 13 == 0 else f"Some É Ünit {i}") for i in range(5000, 5300)]
    rows += [(9000, None, "de", 1, "No source"), (None, "hot", "en", 1, "no id"), (None, "hot", "en", 1, "no id"), (9001, "", "", 0, "A" * 300_000), (9002, "é", "x", 2, "LONE"), (7, "hot", "en", 7, "same id"), (7, "hot", "en", 7, "same id")]
    return rows


@pytest.mark.parametrize("parts", [1, 9])
def test_verify(spark, parts):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1, "n", 3) for r in rows], SCHEMA + ", i int, hash string, tree int").repartition(parts)
    got = sorted(map(tuple, merkle.verify(docs).collect()), key=repr)
    want = plain(rows)
    assert got == want
    tampered = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and lowered(r[4]) != r[4]}
    assert {r[0] for r in got if not r[6]} == tampered and tampered


def test_log_is_in_completion_order(spark):
    """Positions are a permutation, children stand before their parent, and siblings are found at the stated positions."""
    n = 4133
    nodes = spark.range(n).select(F.lit("t").alias("tree"), F.col("id").alias("i"), F.lit(n).cast("long").alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    log = [r for part in merkle.append_log(nodes) for r in part.collect()]
    levels, paths = tree([H(str(i)) for i in range(n)])
    assert sorted(r.pos for r in log) == list(range(sum(map(len, levels))))
    at = {(r.level, r.j): r for r in log}
    assert all(at[k, j].hash == h for k, level in enumerate(levels) for j, h in enumerate(level))
    assert all(r.pos < at[r.level + 1, r.j >> 4].pos for r in log if not r.root) and [r.root for r in sorted(log, key=lambda r: r.pos)][-1]
    order = sorted(log, key=lambda r: (min((r.j + 1) << 4 * r.level, n), r.level))
    assert [r.pos for r in order] == list(range(len(order)))
    by_pos = {r.pos: r.hash for r in log}
    for i in (0, 15, 16, 4095, 4096, 4132, 2000):
        assert [[by_pos[p] for p in level] for level in merkle.sibling_places(i, n)] == [a + b for a, b in paths[i]]


def test_blocks_of_more_levels(spark, monkeypatch):
    """Blocks of one level each: proofs pass through many rounds."""
    monkeypatch.setattr(merkle, "DEEP", 1)
    monkeypatch.setattr(merkle, "BLOCK", merkle.BITS)
    rows = [r for r in rows_of() if r[1] != "hot" or (r[0] or 0) < 700]
    assert sorted(map(tuple, merkle.verify(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == plain(rows)


def test_few_rows(spark):
    one = [(5, "a", "b", 1, "Only")]
    assert [tuple(r) for r in merkle.verify(spark.createDataFrame(one, SCHEMA)).collect()] == plain(one)
    assert merkle.verify(spark.createDataFrame([], SCHEMA)).count() == 0
