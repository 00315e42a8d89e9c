import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from inkgauge.llm import op12_merkle as o

from .helpers import odd_documents, sentence

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, arity):
    """Root, and (left, right) siblings of every leaf level by level."""
    steps, at, row = [[] for _ in digests], list(range(len(digests))), digests
    while len(row) > 1:
        for i, p in enumerate(at):
            first = p - p % arity
            steps[i].append(("".join(row[first:p]), "".join(row[p + 1 : first + arity])))
        at = [p // arity for p in at]
        row = [sha("".join(row[i : i + arity])) for i in range(0, len(row), arity)]
    return row[0], steps


def plain(rows, arity):
    """Every row (doc_id, source, lang, n_chars, text) with leaf, subroot, root and path."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(tree([x[1] for x in groups[g]], arity))
    root, above = tree([t[0] for t in trees], arity)
    out = []
    for g, (subroot, steps), more in zip(names, trees, above):
        out += [(x[0], x[1], subroot, root, [*path, *more], x[2]) for x, path in zip(groups[g], steps)]
    return out


def documents(seed, n=60):
    rng = random.Random(seed)
    rows = [(rng.randrange(50) if i % 9 else i, rng.choice(["a", "a", "a", "é", "Z", None, f"s{i}"]), rng.choice(["en", None]), rng.choice([7, None]), sentence(rng, 5) + "\n") for i in range(n)]
    return rows + [(1, "a", None, None, None), (1, "a", None, None, None), (1, "", "", 0, ""), (None, "a", "en", 1, "漢\n字"), (None, None, None, None, None), (-5, "a", "de", 1, "x\n" * 20_000)]


def frame(spark, rows):
    data = [(*r, 1.0, "x", 3, 9, "y", 2) for r in rows]
    return spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string, id double, group string, tree int, n int, digest string, place int")


@pytest.mark.parametrize("seed,arity", [(1, 3), (2, 2), (3, 4)])
def test_equal_to_plain_trees(spark, monkeypatch, seed, arity):
    monkeypatch.setattr(o.base, "LEAST_PARTS", 5)
    rows = documents(seed)
    df = frame(spark, rows)
    got = o.manifest(df, arity=arity, claimed={"text": F.replace("text", F.lit("\n"), F.lit(""))})
    got = got.select("*", o.folded(F.col("claimed_leaf"), F.col("path")).alias("folded"), o.proof(F.col("path")).alias("proof")).collect()
    found = sorted((str(r.id), r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in got)
    assert found == sorted((str(i), *rest) for i, *rest, _ in plain(rows, arity))
    for r in got:
        assert r.proof == "".join(s.left + s.right for s in r.path)
        d = r.claimed_leaf
        for s in r.path:
            d = sha(s.left + d + s.right)
        assert r.folded == d and (d == r.root) == (r.claimed_leaf == r.leaf)
    assert sorted(r.claimed_leaf for r in got) == sorted(leaf((*r[:4], r[4] and r[4].replace("\n", ""))) for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_trees_of_every_size(spark, n):
    rows = [(i, "s", "en", 1, str(i)) for i in range(n)]
    got = sorted((r.id, r.leaf, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in o.manifest(frame(spark, rows)).collect())
    assert got == sorted(tuple(r[:5]) for r in plain(rows, 3))


def test_empty_table(spark):
    df = odd_documents(spark, [(1, "a")]).where(F.lit(False))
    assert o.manifest(df).count() == 0


def test_a_third_of_equal_rows_is_dealt_to_many_ranges(spark):
    rows = spark.range(3000).select(F.lit(None).cast("string").alias("group"), F.lit(1).alias("id"), F.lit("x").alias("digest"), F.rand(1).alias("deal"))
    out = o.placed(rows, "group", ["id", "digest", "deal"], 100).collect()
    assert sorted(r.idx for r in out) == list(range(3000)) and {r.tree for r in out} == {0} and {r.n for r in out} == {3000}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    want = {i: (a, s, r, p, row) for i, a, s, r, p, row in plain(docs, 3)}
    for r in o.op12_merkle_manifest(spark, sf).collect():
        a, s, root, path, row = want.pop(r.doc_id)
        assert (r.leaf, r.subroot, r.root) == (a, s, root) and r.proof_sha256 == sha("".join(x + y for x, y in path))
        touched = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (row[4] or "")
        assert r.verified == (not touched) == (r.folded_root == root)
    assert not want
