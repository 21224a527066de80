"""Quality rules, token ids, token counts, licences and toxicity, against brute force and on odd input."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import licence_digests, piece_bpe, quality_rules, token_counts, toxicity
from tests.llm import odd

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES, BYTES = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_50k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- quality rules


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [ln for ln in (text or "").split("\n") if WORD.search(ln)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_measures(spark, sf_dir):
    looped = spark.createDataFrame([(-1, "a b c d e f g h i " * 5), (-2, " ".join("abcdefgh") + " " + " ".join("abcdefgh")), (-3, "x " * 9)], "doc_id long, text string")
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(looped).unionByName(odd.documents(spark).select("doc_id", "text"))
    for row in quality_rules.score(docs, F.col("text")).collect():
        want = plain_measures(row["carried_0"])
        assert {k: row[k] for k in want} == want
        assert row["base_failed"] == (want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"])
        assert not (row["base_failed"] and row["kept"])


def test_quality_keeps_clean_labelled_documents(spark, sf_dir):
    scored = quality_rules.score(documents(spark, sf_dir), F.col("doc_id")).withColumnRenamed("carried_0", "doc_id")
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.7 * sum(r["quality"] == 0 for r in rows)


def test_accepted_keeps_columns(spark):
    docs = odd.documents(spark)
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "2", "None", "9"])
    assert quality_rules.accepted(odd.empty(spark)).collect() == []


# --- SentencePiece


def test_ids_and_decoding_are_the_librarys(spark, sf_dir):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(odd.documents(spark).select("doc_id", "text"))
    out = piece_bpe.encoded_documents(docs, PIECES)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    texts = Counter(tuple(library.encode(r["text"] or "")) for r in docs.collect())
    rows = out.collect()
    assert Counter(tuple(r["ids"]) for r in rows) == texts and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    plain = docs.select(piece_bpe.encoded(docs, PIECES).alias("ids")).select("ids", piece_bpe.decoded(F.col("ids"), PIECES).alias("text")).collect()
    assert all(r["text"] == library.decode(list(r["ids"])) for r in plain)


def test_merges_that_bring_up_better_pairs_and_overlap(spark):
    import random

    import sentencepiece

    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.encoder(PIECES)
    rnd = random.Random(5)
    texts = ["a" * n for n in range(40)] + ["".join(rnd.choice("aehtrsin\n▁ é漢") for _ in range(rnd.randint(0, 300))) for _ in range(400)] + [" " * n + "x" for n in range(40)]
    ids, lengths = encoder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == library.encode(texts, num_threads=1)
    anything = [[rnd.randrange(400) for _ in range(rnd.randint(0, 30))] for _ in range(400)]
    flat = np.array([i for x in anything for i in x], np.int64)
    assert encoder.decode(flat, np.array([len(x) for x in anything])) == [library.decode(x) for x in anything]


def with_nul(rnd, n):
    """Texts whose words differ by NUL alone, side by side in one batch."""
    return ["> >\x00", "\x00 ", "x", "x\x00 end", "x\x00", "x", "\x00" * 500] + ["".join(rnd.choice("a\x00b >é") for _ in range(rnd.randint(0, 30))) for _ in range(1500)]


def test_ids_of_texts_with_nul_beside_each_other():
    import random

    import sentencepiece

    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_bpe.encoder(PIECES)
    texts = with_nul(random.Random(9), 1500)
    ids, lengths = encoder.encode(texts)
    want = library.encode(texts, num_threads=1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == want
    assert encoder.decode(ids, lengths) == [library.decode(x) for x in want]


def test_encoding_of_empty_tables(spark):
    assert piece_bpe.encoded_documents(odd.empty(spark), PIECES).collect() == []
    assert piece_bpe.round_trip(odd.empty(spark), PIECES, F.col("doc_id")).collect() == []


# --- token counts


def test_counts_are_the_librarys(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(odd.documents(spark).select("doc_id", "text"))
    for row in token_counts.token_counts(docs, BYTES, F.col("text"), limit=1024).collect():
        text = row["carried_0"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row["n_tokens"], row["n_bytes"], row["over_limit"]) == (n, len(text.encode()), n > 1024)
    assert token_counts.token_counts(odd.empty(spark), BYTES, limit=1).collect() == []


def test_counts_of_contractions_spaces_specials_and_long_runs():
    import random

    from tokenizers import Tokenizer

    library, counter = Tokenizer.from_file(BYTES), token_counts.transducer(BYTES)
    rnd = random.Random(7)
    letters = list("abe th'srvlmd\n\t漢éß ,.0123!'  ²Ⅳ")
    texts = ["'s's'll'lla 'll x'ret 're''ve !'s ' s", "a'", "a'l", "  'l", "\n\n  x", "a<|endoftext|>b  <|endoftext|>", "aaaa" * 300, "x" * 5000, "ՙ꟎ a"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 200))) for _ in range(800)]
    assert counter.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_texts_with_nul_and_of_composed_chunks():
    import random

    from tokenizers import Tokenizer

    library, counter = Tokenizer.from_file(BYTES), token_counts.transducer(BYTES)
    rnd = random.Random(11)
    texts = with_nul(rnd, 1500) + ["a" * 9000, "ab" * 3000, "abc" * 1999, "漢字仮名" * 700, "-" * 5000, "".join(rnd.choice("ab") for _ in range(20_000)), "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(3000))]
    texts += ["".join(rnd.choice(["the", "ing", "tion", "er", "x", "q", "zz"]) for _ in range(rnd.randint(50, 900))) for _ in range(100)]
    assert counter.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_a_table_that_starts_anew_counts_alike(monkeypatch):
    texts = [f"some{i} wordz{i * 7} and{i % 5}" for i in range(300)]
    fresh = token_counts.CountTransducer(BYTES)
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    small = token_counts.CountTransducer(BYTES)
    assert [small.count([t])[0] for t in texts] == fresh.count(texts).tolist() and len(small.states) < 600


# --- licences


def test_licences(spark):
    mit = licence_digests.LICENCES["MIT"][0]
    texts = [
        mit, "Copyright (c) 2020 Some Body\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence"), mit + " extra", "", None, "prose\nAll rights reserved.\nLicensed under the Apache Licence, version 2.0.", "© 1999 X\nALL RIGHTS RESERVED",
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, digest string, licence_id int")
    got = {r["carried_0"]: (r["licence_id"], list(r["notices"])) for r in licence_digests.scan(docs, F.col("doc_id")).collect()}
    assert got == {0: ("MIT", ["MIT"]), 1: ("MIT", ["MIT"]), 2: (None, []), 3: (None, []), 4: (None, []), 5: (None, ["Apache-2.0", "all-rights-reserved"]), 6: ("all-rights-reserved", ["all-rights-reserved"])}
    assert licence_digests.scan(odd.empty(spark), F.col("doc_id")).collect() == [] and licence_digests.scan(odd.documents(spark)).count() == 12


def test_licences_on_one_long_line_beside_other_lines(spark):
    named = {n: licence_digests.LICENCES[n][0] for n in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib")}
    assert all(len(t) > 400 for t in named.values())
    texts = [(n, f"A tool for harbours.\n{t}\nAll rights reserved.") for n, t in named.items()]
    docs = spark.createDataFrame([*texts, ("two", "\n".join([named["MIT"], named["Zlib"]])), ("none", named["MIT"] + " more\nprose")], "doc_id string, text string")
    got = {r["carried_0"]: (r["licence_id"], list(r["notices"])) for r in licence_digests.scan(docs, F.col("doc_id")).collect()}
    assert got == {n: (None, sorted([n, "all-rights-reserved"])) for n in named} | {"two": (None, ["MIT", "Zlib"]), "none": (None, [])}


def test_terms_behind_a_copyright_statement_stay(spark):
    mit, bsd = (licence_digests.LICENCES[n][0] for n in ("MIT", "BSD-2-Clause"))
    texts = {
        "notice": "Copyright (c) 2020 Foo, Inc. Licensed under the MIT License.", "one line": f"Copyright (c) 2020 J. Foo <j@foo.org> {mit}", "beside": f"A tool.\nCopyright 2019-2021 by Foo. {mit}\nMore.",
        "bsd": f"Copyright (c) 1999, Foo. All rights reserved.\n{bsd}", "nothing": "Copyright (c) 2020 Foo Bar.", "commons": "prose\nLicensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["carried_0"]: (r["licence_id"], list(r["notices"])) for r in licence_digests.scan(docs, F.col("doc_id")).collect()}
    assert got == {
        "notice": ("MIT", ["MIT"]), "one line": ("MIT", ["MIT"]), "beside": (None, ["MIT"]), "bsd": ("BSD-2-Clause", ["BSD-2-Clause", "all-rights-reserved"]), "nothing": (None, []), "commons": (None, ["CC-BY-NC-4.0"]), "gpl": ("GPL-3.0", ["GPL-3.0"]),
    }


def test_text_behind_a_copyright_statement_is_digested(spark):
    pairs = [("Copyright 2020 Foo. The quick brown fox jumps.", "The quick brown fox jumps."), ("Copyright (c) 2019 Foo Co. and J. Bar. It goes on", "it goes on"), ("Copyright 2020 Foo, Inc.", ""), ("© 2001-2004 by example.org", "")]
    told = spark.createDataFrame(pairs, "a string, b string").select(licence_digests.digest(F.col("a")).alias("a"), licence_digests.digest(F.col("b")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in told)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no published texts on this machine")
def test_digests_of_published_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = []
    for name, file in files.items():
        with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
            text = f.read()
        rows += [(name, text), (name, "Copyright (C) 2021 Foo Bar\n\n" + text.upper().replace("\n", "\r\n"))]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r["carried_0"], r["licence_id"]) for r in licence_digests.scan(docs, F.col("doc_id")).collect()} == {(n, n) for n in files}


# --- toxicity


def test_toxicity_holds_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(docs, model, F.col("doc_id"), toxicity.fold(F.col("doc_id"))).toDF("doc_id", "fold", "score").join(labels, "doc_id").collect()
    assert all((r["fold"] == 0) == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"] >= 0.5, r["toxic"] == 1) for r in rows if r["fold"] == 0]
    found = sum(p and t for p, t in held)
    assert found > 0.9 * sum(t for _, t in held) and sum(p and not t for p, t in held) <= 0.005 * len(held)


def test_toxicity_of_odd_input(spark):
    docs = odd.documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (9, 0), (5, 0), (3, 1), (77, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scores = toxicity.scored(docs, model, F.col("text")).collect()
    assert len(scores) == 12 and all(0 <= r["score"] <= 1 for r in scores) and len({r["score"] for r in scores if not r["carried_0"]}) == 1
    assert toxicity.civil(docs, labels).columns == docs.columns
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.civil(odd.empty(spark), labels).collect() == []


def plain_label_model(votes, rates, share, anchor, rounds):
    """The label model row by row and voter by voter."""
    n, voters = len(votes), range(len(votes[0]))
    first, first_share, worth, posterior = [list(r) for r in rates], share, [1.0] * len(votes[0]), None
    rates = [list(r) for r in first]
    for _ in range(rounds):
        fresh = []
        for v in votes:
            logit = np.log(share / (1 - share)) + sum(worth[j] * np.log(rates[1][j] / rates[0][j]) for j in voters if v[j])
            fresh.append(1 / (1 + np.exp(-min(30, max(-30, logit)))))
        moved = 1 if posterior is None else max(abs(a - b) for a, b in zip(fresh, posterior, strict=True))
        posterior = fresh
        if moved < 1e-4:
            break
        for c in (0, 1):
            weight = [p if c else 1 - p for p in posterior]
            rates[c] = [min(1 - 1e-4, max(1e-4, (sum(w * v[j] for w, v in zip(weight, votes, strict=True)) + anchor * n * first[c][j]) / (sum(weight) + anchor * n))) for j in voters]
        share = (sum(posterior) + anchor * n * first_share) / (n + anchor * n)
        left = [[v[j] - (1 - p) * rates[0][j] - p * rates[1][j] for j in voters] for v, p in zip(votes, posterior, strict=True)]
        spread = [np.sqrt(sum(r[j] ** 2 for r in left) / n) + 1e-9 for j in voters]
        worth = [1 / (1 + sum(max(0, sum(r[i] * r[j] for r in left) / n / spread[i] / spread[j]) ** 2 for i in voters if i != j)) for j in voters]
    return posterior, rates


def made_votes(n):
    rnd = np.random.default_rng(0)
    truth = rnd.random(n) < 0.3
    noisy = lambda hit, false: np.where(truth, rnd.random(n) < hit, rnd.random(n) < false)
    copied = noisy(0.6, 0.2)
    return truth, np.stack([copied, copied, copied, noisy(0.8, 0.02), noisy(0.7, 0.05), ~noisy(0.9, 0.1)], axis=1).astype(float)


def test_label_model_is_expectation_maximisation():
    truth, votes = made_votes(150)
    rates = toxicity.calibrated(votes, truth.astype(float))
    posterior, found, _ = toxicity.label_model(votes, rates, 0.3, anchor=0.5, rounds=6)
    plain, plain_rates = plain_label_model(votes.tolist(), rates.tolist(), 0.3, 0.5, 6)
    assert np.allclose(posterior, plain) and np.allclose(found, plain_rates)


def test_label_model_discounts_voters_that_agree_and_outdoes_wrong_labels():
    truth, votes = made_votes(2000)
    told = np.where(np.random.default_rng(1).random(2000) < 0.1, ~truth, truth)
    posterior, rates, correlations = toxicity.label_model(votes, toxicity.calibrated(votes, told.astype(float)), told.mean())
    assert ((posterior > 0.5) == truth).mean() > 0.93 > (told == truth).mean() and correlations[0, 1] > 0.9 and abs(rates[1, 3] - 0.8) < 0.2


def test_posterior_labels_come_from_votes(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = toxicity.training_rows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), sample=1500).checkpoint()
    vocabulary, toxic, other = toxicity._mined(rows)
    owner, hit, marked = toxicity._matrix(rows, vocabulary)
    assert toxic + other == len(marked) == 1500
    model, posterior = toxicity._learned(owner, hit, marked, vocabulary)
    assert 0 < ((posterior > 0.5) != (marked > 0.5)).sum() < 0.05 * len(marked) and model.weights


def test_scores_are_weights_of_features():
    model = toxicity.ToxicityModel(-1.0, {"scum": 2.0, "sc*": 9.0, "scu*": 1.0, "idio%": 0.5, "achlich%": 1.5})
    for text in (None, "", "scum", "Scum! scums", "achlicher " + "x " * 80, "achlicher achlichen " + "x " * 80, "idiot " * 3 + odd.LONG, "\x00 scum\x00"):
        logit = -1.0 + sum(w for f, w in model.weights.items() if f in toxicity.features(text))
        assert abs(model.score(text) - 1 / (1 + np.exp(-logit))) < 1e-12
