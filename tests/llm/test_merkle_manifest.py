import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import merkle_manifest, queries
from tests.llm import odd


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(leaves):
    """(root, [(left, right) of every level] of every leaf), by hand."""
    proofs, paths = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for proof, at in zip(proofs, paths, strict=True):
            run = at // 3 * 3
            proof.append(("".join(leaves[run:at]), "".join(leaves[at + 1 : run + 3])))
        leaves, paths = [digest(leaves[i : i + 3]) for i in range(0, len(leaves), 3)], [p // 3 for p in paths]
    return (leaves[0] if leaves else None), proofs


def by_hand(rows):
    """Sorted (doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0], leaf_of(*r)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        held = sorted(sources[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[name] = held, *tree([leaf for _, leaf in held])
    root, above = tree([built[name][1] for name in names])
    return sorted(
        ((ident, leaf, built[name][1], root, digest(a + b for a, b in [*proof, *up])) for name, up in zip(names, above, strict=True) for (ident, leaf), proof in zip(built[name][0], built[name][2], strict=True)),
        key=repr,
    )


def made(docs, height):
    told = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    found = merkle_manifest.manifest(docs, merkle_manifest.leaf_digest(*told), F.col("doc_id"), height=height)
    sides = F.col("lefts"), F.col("rights")
    return found.select("carried_0", "leaf", "subroot", "root", merkle_manifest.proof_digest(*sides).alias("proof"), merkle_manifest.folded(F.col("leaf"), *sides).alias("folded")).collect()


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 2, 7])
def test_trees_of_many_blocks_equal_trees_by_hand(spark, height):
    # Sizes about the powers of the fanout, where last groups are short or stand alone.
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "g": 28, "é": 55, None: 83, "": 7}
    rows = [(i * 7 % 1000, name, "en", i, f"text {name} {i}") for name, n in sizes.items() for i in range(n)]
    found = made(spark.createDataFrame(rows, SCHEMA).repartition(5), height)
    assert sorted((tuple(r)[:5] for r in found), key=repr) == by_hand(rows)
    assert all(r["folded"] == r["root"] for r in found)


def test_nulls_repeated_rows_and_odd_texts(spark):
    docs = odd.documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r)[:5] for r in made(docs, 1)), key=repr) == by_hand(rows)


def test_empty_table(spark):
    assert made(odd.empty(spark), 7) == []


def test_one_row_is_its_own_root(spark):
    rows = [(5, "a", "en", 1, "x")]
    assert [tuple(r)[1:4] for r in made(spark.createDataFrame(rows, SCHEMA), 7)] == [(leaf_of(*rows[0]),) * 3]


def test_query_tells_harmed_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    harmed = {d["doc_id"] for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and "\n" in d["text"]}
    found = {r["doc_id"]: r["verified"] for r in queries.op11_merkle_manifest(spark, sf_dir).collect()}
    assert harmed and {d for d, ok in found.items() if not ok} == harmed and len(found) == len(docs)
