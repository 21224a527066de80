import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import id_shards, queries
from pagemill.llm.common import shared_folder
from pagemill.llm.queries import BYTES, vocabulary
from tests.llm import odd


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(BYTES))


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def written(spark, docs, **options):
    return id_shards.write(docs, vocabulary(BYTES), shared_folder(spark, "ids"), **options)


def test_encoder_equals_the_library_on_odd_texts(library):
    rng = np.random.default_rng(3)
    pieces = ["a", " ", " ", "\n", "\t", "\x0b", "\u00a0", "\u2003", "it's", "'", "12", ",", "<|endoftext|>", "<|endof", "É", "漢", "\U0001f600", "\x00", "\x1c", "word", "-", "."]
    texts = ["", " ", "a", " a", "a ", "  a", "a  b", "it's  two   spaces\n\n end ", "x<|endoftext|><|endoftext|> y", "<|endoftext|> y <|endoftext|>", "we'll've", "a" * 3000, " ".join(f"w{i}" for i in range(500))]
    texts += ["".join(rng.choice(pieces, rng.integers(1, 25))) for _ in range(3000)]
    coder = id_shards.IdEncoder(vocabulary(BYTES))
    for _ in range(2):  # the second time from what is kept
        assert [np.frombuffer(raw, "<u2").tolist() for raw in coder.encode(texts)] == [ids_of(library, t) for t in texts]
    assert coder.encode([]) == []


def test_function_is_minimal_and_perfect():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 1000, 5000):
        ids = rng.choice(2**40, n, replace=False).astype(np.int64)
        nulls, nth = np.zeros(n, bool), np.zeros(n, np.int64)
        if n > 3:
            ids[: n // 2], nth[: n // 2] = 7, np.arange(n // 2)  # one id, many rows
            nulls[n // 2 : n // 2 + 2], nth[n // 2 : n // 2 + 2] = True, [0, 1]
        levels = id_shards.perfect_levels(ids, nulls, nth)
        assert sorted(id_shards.slots(levels, ids, nulls, nth).tolist()) == list(range(n))
        again = id_shards._unpacked_levels(*id_shards._packed_levels(levels))
        assert all((a == b).all() for a, b in zip(levels, again, strict=True))


def test_files_hold_all_ids_in_order_of_keys(spark, library):
    rows = [(i * 37 % 500 - 100, f"text {i} " * (i % 9)) for i in range(500)] + [(None, "none"), (None, None), *[(50, f"copy {i}") for i in range(300)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    files = written(spark, docs, shard_docs=40, bucket=64, segment_ids=60)
    segments = sorted(files.table("shards").collect(), key=lambda r: (r["shard"], r["segment"]))
    assert len({r["shard"] for r in segments}) > 10 and len(segments) > 40
    keys = [k for r in segments for k in r["doc_ids"]]
    assert keys == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    flat = np.concatenate([np.frombuffer(r["payload"], "<u2") for r in segments]).tolist()
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append(ids_of(library, t))
    at = 0
    places = {}
    for r in segments:
        for k, n, offset in zip(r["doc_ids"], r["counts"], r["offsets"], strict=True):
            places.setdefault(k, []).append((at, n, r["shard"], r["segment"], offset))
            texts[k].remove(flat[at : at + n])
            at += n
    assert at == len(flat) and not any(texts.values())
    # Every key leads to its place by the index, in order of nth, and no other key leads anywhere.
    found = id_shards.lookup(files, id_shards.key_list(docs)).collect()
    told = {}
    for r in sorted(found, key=lambda r: r["nth"]):
        told.setdefault(r["doc_id"], []).append((r["start"], r["count"], r["shard"], r["segment"], r["offset"]))
    assert told == places
    strangers = spark.createDataFrame([(10**6 + i, 0) for i in range(2000)] + [(50, 301), (None, 2), (51, -1)], "doc_id long, nth long")
    assert id_shards.lookup(files, strangers).count() == 0
    asked = spark.createDataFrame([(50, 299), (None, 1), (50, 299), (-100, 0)], "doc_id long, nth long")
    got = id_shards.fetch(files, asked).collect()
    assert {(r["doc_id"], r["nth"]): r["ids"] for r in got} == {(k, n): flat[places[k][n][0] : sum(places[k][n][:2])] for k, n in ((50, 299), (None, 1), (-100, 0))} and len(got) == 3


def test_odd_documents_and_empty_tables(spark, library):
    docs = odd.documents(spark)
    files = written(spark, docs)
    crc = sorted(zlib.crc32(np.array(ids_of(library, r["text"]), "<u4").tobytes()) for r in docs.select("text").collect())
    assert sorted(r["ids_crc32"] for r in id_shards.digests(files).collect()) == crc
    assert id_shards.lookup(files, id_shards.key_list(docs)).count() == docs.count()
    none = written(spark, odd.empty(spark))
    assert id_shards.lookup(none, docs.select("doc_id", F.lit(0).alias("nth"))).count() == id_shards.digests(none).count() == 0


def test_query_equals_brute_force(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    told, start = [], 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = np.array(ids_of(library, r["text"]), "<u4")
        told.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op13_id_shards(spark, sf_dir).collect()) == told
