"""The corpus pipeline: each stage against plain Python, the whole on given, odd and empty tables."""

from collections import Counter

import pytest

import corpus_pipeline
from pagemill.llm import quality_rules, source_mix, toxicity
from tests.llm import odd
from tests.llm.test_search_and_duplicates import plain_kept
from tests.llm.test_text_operators import PIECES, plain_measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plainly_kept(text):
    """The quality rules on one text."""
    m = plain_measures(text)
    words, lines = (text or "").split(), [ln for ln in (text or "").split("\n") if ln.strip()]
    m |= {"n_lines": len(lines), "n_stop_words": sum(w.rstrip(".,;:").lower() in quality_rules.STOP_WORDS for w in words), "n_bullet_lines": sum(ln.lstrip(" \t")[:1] in tuple("-*•·") for ln in lines)}
    if m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]:
        return False
    return all(r.low <= (m[r.numerator] / m[r.denominator] if m[r.denominator] else 0.0) <= r.high for r in quality_rules.RULES)


def test_every_stage_against_plain_python(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality rules", "toxicity", "near duplicates", "source mix", "token ids")
    quality, civil, near, mix, tokens = stages

    good = quality(spark, docs, sf_dir).cache()
    assert good.columns == COLUMNS and Counter(r["doc_id"] for r in good.collect()) == Counter(r["doc_id"] for r in docs.collect() if plainly_kept(r["text"]))

    clean = civil(spark, good, sf_dir).cache()
    model = toxicity.fit(good, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert clean.columns == COLUMNS and Counter(r["doc_id"] for r in clean.collect()) == Counter(r["doc_id"] for r in good.collect() if model.score(r["text"]) < 0.5)

    own = near(spark, clean, sf_dir).cache()
    assert own.columns == COLUMNS and sorted(r["doc_id"] for r in own.collect()) == plain_kept([(r["doc_id"], r["text"]) for r in clean.collect()])

    mixed = mix(spark, own, sf_dir).cache()
    sizes = {r["doc_id"]: (r["source"], len((r["text"] or "").split())) for r in own.collect()}
    weight = {s: source_mix.WEIGHTS[i % 3] for i, s in enumerate(sorted({s for s, _ in sizes.values()}))}
    total = {s: sum(n for t, n in sizes.values() if t == s) for s in weight}
    target, free, left = {}, set(weight), float(sum(total.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        left -= sum(3 * total[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += sizes[r["doc_id"]][1]
    largest = {s: max(n for t, n in sizes.values() if t == s) for s in weight}
    assert mixed.columns == COLUMNS and all(abs(taken[s] - target[s]) <= 3 * largest[s] for s in weight)
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert all(list(r["ids"]) == library.encode(texts[r["doc_id"]]) for r in tokens(spark, mixed, sf_dir).collect())


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_runs_on_odd_and_empty_tables(spark, tmp_path, kind):
    docs = odd.documents(spark) if kind == "odd" else odd.empty(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 1), (5, 0, None)] if kind == "odd" else [], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert set(out.columns) == set(docs.columns) - {"text"} | {"ids", "n_tokens", "round_trip"}
    assert (not rows) if kind == "empty" else all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_run_is_its_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
    want = Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want
