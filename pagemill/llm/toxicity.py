"""Toxicity scores from weak supervision.

Voters are cheap rules that know no row's label. Lexicon voters fire on a word: a public list of insults in four
languages, and words of the corpus. Pattern voters fire where words of one beginning make up a given share of a text, so
inflected forms count together and long texts behave like short ones. Labels only calibrate: they choose, out of all
words and beginnings, the voters worth hearing, and give each its first rates. A generative model of the votes then
estimates every voter's rates in both classes and the voters' correlations given the class, by expectation maximisation
over rows whose labels it does not see; voters that move together are discounted. Its posterior labels train a linear
classifier on the mined features, and that classifier alone scores texts: labels, languages, sources and ids are no
inputs of a score.

Fitting sees at most `SAMPLE` labelled rows, taken in the order of a hash of id and text; the tables gathered on the driver
are bounded by that number and by `FEATURES`. Scoring runs over every whole text with the fitted weights.

Defined results: null and empty texts get the score of a text without any feature; labels that are null, or whose row has no text, are not
used, and of repeated labels of an id the largest counts; rows that agree in id and text count once in fitting; without any
toxic training row the score is 0 for all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagemill.llm.common import packed
from pagemill.session import ensure_checkpoint_dir

#: Most labelled rows that fitting looks at.
SAMPLE = 20_000
#: Most features of the linear classifier, and most voters of either kind.
FEATURES = 4096
VOTERS = 64
#: Voters of either kind that a toxic row is to be heard by, if so many reach it.
HEARD = 4
FOLDS = 5
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A pattern fires where at least one word in so many begins alike.
ONE_IN = 75
EDGES = "\"'`.,;:!?()[]{}<>*_-–—…«»“”‘’¿¡|#&$%"
SHARE = 0.004
ODDS = 4.0
#: Least log odds times the root of the hits, for a feature to be more than chance among so many.
STRENGTH = 5.0
#: How much a voter's calibrated rates count for beside the rows of the sample, as a share of these.
ANCHOR = 1.0
#: Least odds of a voter in the calibration.
VOTER_ODDS = 64.0
# Common insults of English, German, French and Spanish, for voters that need no label to be found.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid loser losers trash scum clown pathetic disgusting worthless dumb fool retard filth vermin garbage bastard bitch whore slut asshole fuck fucking shit crap bullshit "
    "dummkopf trottel depp arschloch scheiße abschaum drecksau hurensohn schlampe wichser "
    "imbécile crétin connard salope ordure débile abruti pute merde enculé "
    "idiota imbécil estúpido basura mierda cabrón puta gilipollas pendejo escoria"
).split()


def features(text: str | None) -> set[str]:
    """What voters and weights refer to, from a whole text in lower case without punctuation at word edges.

    A word stands for itself. `xyz*` says that some word goes on after the beginning xyz, `xyz%` that one word in `ONE_IN`
    or more does: inflected forms share a stem that may also begin innocent words.
    """
    words, total = _words(text)
    begun: Counter[str] = Counter()
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) <= k:
                break
            begun[w[:k]] += n
    out = set(words)
    out.update(b + "*" for b in begun)
    out.update(b + "%" for b, n in begun.items() if n * ONE_IN >= total)
    out.discard("")
    return out


def _words(text: str | None) -> tuple[dict[str, int], int]:
    """(the different words with their numbers, the number of all words)."""
    found = Counter((text or "").lower().split())
    words: dict[str, int] = {}
    for raw, n in found.items():
        w = raw.strip(EDGES)
        words[w] = words.get(w, 0) + n
    return words, found.total()


@dataclass
class ToxicityModel:
    """Weights by feature; words and beginnings share one table."""

    bias: float = -np.inf
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.begun = {f[:-1] for f in self.weights if f[-1] in "*%"}
        self.sizes = tuple(k for k in BEGINNINGS if any(len(b) == k for b in self.begun))

    def score(self, text: str | None) -> float:
        """The weights of `features` summed without building them all."""
        logit, weights, begun = self.bias, self.weights, self.begun
        if weights:
            words, total = _words(text)
            times: dict[str, int] = {}
            seen = [w for w in words if w in weights]
            for w, n in words.items():
                for k in self.sizes:
                    if len(w) <= k:
                        break
                    if (b := w[:k]) in begun:
                        times[b] = times.get(b, 0) + n
            seen += [b + "*" for b in times]
            seen += [b + "%" for b, n in times.items() if n * ONE_IN >= total]
            logit += sum(weights.get(f, 0.0) for f in sorted(seen))
        return float(1 / (1 + np.exp(-logit))) if logit > -700 else 0.0


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def _mined(sample: DataFrame) -> tuple[list[str], int, int]:
    """Features that mark toxic rows of the sample, best first, with the numbers of toxic and other rows.

    Candidates are counted among the toxic rows first; the rest of the sample is then counted for those only.
    """
    sizes = {bool(r[0]): r[1] for r in sample.groupBy(F.col("toxic") > 0).count().collect()}
    toxic, other = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic:
        return [], 0, other
    least = max(2, int(np.ceil(SHARE * toxic)))

    def count(rows: DataFrame, among: set[str] | None) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found: Counter[str] = Counter()
            for frame in frames:
                for text in frame["text"]:
                    found.update(features(text) if among is None else features(text) & among)
            yield pd.DataFrame({"feature": pd.Series(list(found), dtype=object), "n": np.fromiter(found.values(), np.int64, len(found))})

        return rows.select("text").mapInPandas(run, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))

    hits = {r["feature"]: r["n"] for r in count(sample.where("toxic > 0"), None).where(F.col("n") >= least).toLocalIterator()}
    misses = {r["feature"]: r["n"] for r in count(sample.where("toxic <= 0"), set(hits)).toLocalIterator()}

    def odds(f: str) -> float:
        return ((hits[f] + 0.5) / (toxic + 1)) / ((misses.get(f, 0) + 0.5) / (other + 1))

    marked = [f for f in hits if odds(f) >= ODDS and np.log(odds(f)) * np.sqrt(hits[f]) >= STRENGTH]
    # Insults are heard wherever a toxic row holds them; of the rest the strongest.
    marked.sort(key=lambda f: (-np.log(odds(f)) * np.sqrt(hits[f]), len(f), f))
    given = [f for f in hits if f in set(INSULTS) and odds(f) > 1]
    return list(dict.fromkeys(marked[: FEATURES - len(given)] + given)), toxic, other


def _matrix(sample: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature) of the sample's hits, and each row's label."""
    place = {f: i for i, f in enumerate(vocabulary)}
    names = set(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"] > 0, "hits": [sorted(place[f] for f in features(t) & names) for t in frame["text"]]})

    rows = sample.select("toxic", "text").mapInPandas(run, "toxic boolean, hits array<int>").collect()
    label = np.array([r["toxic"] for r in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(r["hits"]) for r in rows])
    hit = np.array([h for r in rows for h in r["hits"]], np.int64)
    return owner, hit, label


def calibrated(votes: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Each voter's rates (class, voter) among labelled rows, with one row of either class added."""
    sides = np.stack([1 - marked, marked])
    base = votes.mean(axis=0)
    return (sides @ votes + base) / (sides.sum(axis=1, keepdims=True) + 1)


def label_model(votes: np.ndarray, rates: np.ndarray, share: float, anchor: float = ANCHOR, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rates by class, correlations) of a binary vote matrix, by expectation maximisation from calibrated rates.

    Labels are no part of it. A voter that does not fire abstains and says nothing; that none fires is a voter of its own. Votes are
    independent given the class up to the correlations of their residuals; a voter's log-likelihood ratio is divided by
    one plus the sum of the squares of its positive correlations, so that voters who say the same thing count about once. The calibrated
    rates and share stay as a prior of `anchor` times the rows, so that a class keeps its meaning.
    """
    anchor *= len(votes)
    rates, share = first, first_share = np.clip(rates, 1e-4, 1 - 1e-4), float(np.clip(share, 1e-3, 1 - 1e-3))
    worth, posterior, correlations = np.ones(votes.shape[1]), None, np.zeros((votes.shape[1],) * 2)
    for _ in range(rounds):
        logit = np.log(share / (1 - share)) + votes @ (np.log(rates[1] / rates[0]) * worth)
        fresh = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved = np.inf if posterior is None else np.abs(fresh - posterior).max()
        posterior = fresh
        if moved < 1e-4:
            break
        sides = np.stack([1 - posterior, posterior])
        rates = np.clip((sides @ votes + anchor * first) / (sides.sum(axis=1, keepdims=True) + anchor), 1e-4, 1 - 1e-4)
        share = (posterior.sum() + anchor * first_share) / (len(votes) + anchor)
        residual = votes - sides.T @ rates
        spread = np.sqrt((residual**2).mean(axis=0)) + 1e-9
        correlations = residual.T @ residual / len(votes) / spread[:, None] / spread[None, :]
        np.fill_diagonal(correlations, 0)
        worth = 1 / (1 + (np.clip(correlations, 0, None) ** 2).sum(axis=0))
    return posterior, rates, correlations


def _linear(owner: np.ndarray, hit: np.ndarray, target: np.ndarray, size: int, rounds: int = 800, decay: float = 0.1) -> tuple[float, np.ndarray]:
    """Logistic regression of soft targets on binary features, by accelerated full gradient steps."""
    n = len(target)
    counts = np.bincount(hit, minlength=size)
    step = 1.0 / ((counts + decay) / n) / max(1, np.bincount(owner, minlength=n).max() + 1)
    weight, bias, ahead, ahead_bias = np.zeros(size), 0.0, np.zeros(size), 0.0
    for t in range(rounds):
        total = ahead_bias + np.bincount(owner, weights=ahead[hit], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(total, -30, 30))) - target
        new = ahead - step * (np.bincount(hit, weights=error[owner], minlength=size) / n + decay * ahead / n)
        new_bias = ahead_bias - error.mean()
        pull = t / (t + 3)
        ahead, ahead_bias = new + pull * (new - weight), new_bias + pull * (new_bias - bias)
        weight, bias = new, new_bias
    return bias, weight


def _voters(owner: np.ndarray, hit: np.ndarray, marked: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """The vote matrix: insults, and words and patterns that each reach the most toxic rows not yet reached `HEARD` times; the
    last voter fires where none of them does."""
    toxic = marked[owner] > 0.5
    hits, misses = (np.bincount(hit[which], minlength=len(vocabulary)) + 0.5 for which in (toxic, ~toxic))
    sure = hits / misses * (len(marked) - marked.sum() + 1) / (marked.sum() + 1) >= VOTER_ODDS
    kind = np.array([(2 if f[-1] in "*%" else 0) if s else -1 for f, s in zip(vocabulary, sure, strict=True)])
    rows = [[] for _ in vocabulary]
    for r, f in zip(owner[toxic].tolist(), hit[toxic].tolist(), strict=True):
        rows[f].append(r)
    chosen = [i for i, f in enumerate(vocabulary) if f in set(INSULTS)]
    # Of features that reach the same toxic rows the first is enough.
    first = {tuple(rows[i]): i for i in [*range(len(vocabulary))[::-1], *chosen]}
    kind[[i for i in range(len(vocabulary)) if first[tuple(rows[i])] != i]] = -1
    for which in (0, 2):
        heard, left = np.zeros(len(marked), np.int64), np.flatnonzero(kind == which).tolist()
        for _ in range(VOTERS):
            news = [(int((heard[rows[i]] < HEARD).sum()), -i) for i in left]
            if not news or max(news)[0] == 0:
                break
            best = -max(news)[1]
            chosen.append(best)
            left.remove(best)
            heard[rows[best]] += 1
    names = list(dict.fromkeys(chosen))
    column = np.full(max(1, len(vocabulary)), -1)
    column[names] = np.arange(len(names))
    votes = np.zeros((len(marked), len(names) + 1))
    held = column[hit] >= 0
    votes[owner[held], column[hit[held]]] = 1
    votes[:, -1] = ~votes[:, :-1].any(axis=1)
    return votes


def _learned(owner: np.ndarray, hit: np.ndarray, marked: np.ndarray, vocabulary: list[str]) -> tuple[ToxicityModel, np.ndarray]:
    """The classifier trained on the label model's posterior labels, and those labels."""
    votes = _voters(owner, hit, marked, vocabulary)
    posterior, _, _ = label_model(votes, calibrated(votes, marked), marked.mean())
    return _classifier(owner, hit, posterior, vocabulary), posterior


def _classifier(owner: np.ndarray, hit: np.ndarray, target: np.ndarray, vocabulary: list[str]) -> ToxicityModel:
    bias, weight = _linear(owner, hit, target, max(1, len(vocabulary)))
    return ToxicityModel(float(bias), {f: float(w) for f, w in zip(vocabulary, weight, strict=False) if abs(w) > 1e-6})


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(toxic, text): at most `sample` labelled rows outside fold 0, however often ids and texts repeat."""
    told = labels.where((fold(F.col(key)) != 0) & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("toxic"))
    digest = F.xxhash64(F.col(text))
    held = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), digest.alias("digest"), F.col(text).alias("text"))
    taken = held.select("id", "digest").join(told, "id").distinct().orderBy(F.xxhash64("id", "digest"), "id", "digest").limit(sample)
    # The sample is bounded, and so is what it is broadcast as.
    return held.join(F.broadcast(taken), ["id", "digest"]).groupBy("id", "digest").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """The model learned from labelled rows outside fold 0; at most `sample` of them."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = training_rows(docs, labels, key, text, label, sample).checkpoint()
    vocabulary, toxic, other = _mined(rows)
    if not toxic:
        return ToxicityModel()
    owner, hit, marked = _matrix(rows, vocabulary)
    return _learned(owner, hit, marked, vocabulary)[0]


def scored(docs: DataFrame, model: ToxicityModel, *carried: Column, text: str = "text") -> DataFrame:
    """`carried` columns and the score of every text."""
    named = docs.select(*[c.alias(f"carried_{i}") for i, c in enumerate(carried)], F.col(text).alias("text"))
    schema = StructType([*[f for f in named.schema.fields if f.name != "text"], StructField("score", DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.drop(columns="text")
            out["score"] = [held.value.score(t) for t in frame["text"]]
            yield out

    return named.mapInPandas(run, schema)


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """The score as a column expression, for filters that keep all columns of a row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], index=texts.index)

    return score(docs[text])


def civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, with all their columns."""
    model = fit(docs, labels, key=key, text=text)
    told = docs.select(packed(docs), with_score(docs, model, text).alias("score"))
    return told.where(F.col("score") < threshold).select("row.*")
