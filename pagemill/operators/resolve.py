"""Which files, works and bibliography entries are the same: exact duplicates, strong keys, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.fuzzy import TITLE_RATIO, part_pairs, text_pairs, title_pairs, titles_match
from pagemill.functions.text import normalized, strip
from pagemill.functions.titles import confident
from pagemill.session import stored_table

ACCEPTED, CONTAINED, CONTAINED_SHARE, CONTAINED_CHARS, LEAST_CHARS = 0.85, 0.99, 0.7, 20, 6
# Headings that are no title of a work.
GENERIC = (
    "preface", "introduction", "contents", "table of contents", "index", "foreword", "acknowledgements", "acknowledgments", "bibliography", "references", "notes", "appendix", "glossary",
    "prologue", "epilogue", "afterword", "conclusion", "abstract", "summary", "abbreviations", "list of illustrations", "list of figures",
)
# How titles begin that many works share.
GENERIC_START = r"(?i)^(singapore|directions|sea|east|map\s*[0-9]*|preface|appendix|contents|introduction|memoir)\b"
# Phrases of cataloguing notes.
BOILERPLATE = r"(?i)(catalogu(?:e|ing).{0,40}record|record for this book|available from the (?:british library|library of congress)|library of congress catalog(?:u|ing|ed)?)"
COPY_SUFFIX = r"( \([0-9]+\)| copy( [0-9]+)?)$"


def exact_duplicates(files: DataFrame, name: str = "name", digest: str = "sha256") -> DataFrame:
    """(digest, canonical, dropped, n): of files with equal bytes the one without a copy suffix, then the shorter, then the first by name."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    order = F.struct(stem.rlike(COPY_SUFFIX), F.length(stem), F.col(name))
    found = files.groupBy(digest).agg(F.min_by(F.col(name), order).alias("canonical"), F.sort_array(F.collect_list(name)).alias("names"), F.count(F.lit(1)).alias("n"))
    return found.select(digest, "canonical", F.array_remove("names", F.col("canonical")).alias("dropped"), "n")


def folded_title(title: Column) -> Column:
    """Lower case, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def main_title(title: Column) -> Column:
    """The part before a colon or dash."""
    return strip(F.get(F.split(title, r"\s*[:—–]\s*", 2), F.lit(0)))


def no_title(title: Column) -> Column:
    return folded_title(title).isin("", *GENERIC) | title.rlike(BOILERPLATE)


def citable(kind: Column, title: Column, container: Column) -> Column:
    """Books, chapters, and serials under their own name."""
    serial = kind.isin("JOUR", "SER") & (F.coalesce(container, F.lit("")) != "") & (folded_title(title) == folded_title(container))
    return kind.isin("BOOK", "CHAP", "EDBOOK") | serial


def bare_isbn(isbn: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(isbn, F.lit("")), "[^0-9Xx]", ""))


def _alike(q: str, t: str) -> float:
    """Containment of titles near in length or long enough, else the matcher's ratio; nothing below the accepted score."""
    import difflib

    short, long = min(len(q), len(t)), max(len(q), len(t))
    if len(t) < LEAST_CHARS:
        return 0.0
    if (q in t or t in q) and (short >= CONTAINED_SHARE * long or short >= CONTAINED_CHARS):
        return CONTAINED
    score = difflib.SequenceMatcher(None, q, t).ratio()
    return score if score >= ACCEPTED else 0.0


def _holding(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of titles that `_alike` accepts for one standing in the other."""
    return text_pairs(left, right, CONTAINED_CHARS).unionByName(part_pairs(left, right, LEAST_CHARS, CONTAINED_CHARS - 1, CONTAINED_SHARE))


def match_bibliography(works: DataFrame, entries: DataFrame) -> DataFrame:
    """(work, position, score, how, tie): the entry of a bibliography that each work (work, isbn, titles) is.

    An equal ISBN decides; else the best title at 0.85 or more, the first in file order on ties. Main titles are compared with main
    titles and whole ones with whole ones.
    """
    usable = entries.where(citable(F.col("type"), F.col("title"), F.col("container"))).select("position", bare_isbn(F.col("isbn")).alias("isbn"), folded_title(main_title(F.col("title"))).alias("main"), folded_title(F.col("title")).alias("full"))
    usable = stored_table(usable, "entries")
    keyed = works.select("work", bare_isbn(F.col("isbn")).alias("isbn"), "titles")
    by_isbn = keyed.where("isbn <> ''").join(usable.where("isbn <> ''"), "isbn").groupBy("work").agg(F.min("position").alias("position"))
    exact = by_isbn.select("work", "position", F.lit(1.0).alias("score"), F.lit("isbn").alias("how"), F.lit(False).alias("tie"))
    asked = keyed.join(by_isbn, "work", "left_anti").select("work", F.explode("titles").alias("title")).where("title <> '' and not startswith(title, 'Untitled (')")
    guesses = asked.select("work", folded_title(main_title(F.col("title"))).alias("main"), folded_title(F.col("title")).alias("full")).where((F.length("main") >= LEAST_CHARS) & ~F.col("main").isin(*GENERIC)).distinct()
    forms = lambda rows: F.explode(F.array(*[F.struct(F.lit(f).alias("form"), F.col(f).alias("title")) for f in ("main", "full")]))
    wanted, listed = (rows.select(key, forms(rows).alias("f")).select(key, "f.form", "f.title") for rows, key in ((guesses, "work"), (usable, "position")))
    # A title that all of a work's forms or many entries share is compared once.
    alike = title_pairs(wanted, listed, ACCEPTED, _alike, _holding).checkpoint()
    entry = listed.groupBy("form", F.col("title").alias("b")).agg(F.min("position").alias("first"), F.max("position").alias("last"))
    low = lambda rows: rows.agg(F.min(F.struct((-F.col("score")).alias("less"), "first")).alias("low"), F.max(F.struct("score", "last")).alias("high")).withColumns({"score": F.col("high.score"), "first": F.col("low.first"), "last": F.col("high.last")}).drop("low", "high")
    best = low(alike.join(entry, "b").groupBy("form", "a"))
    found = low(wanted.distinct().join(best.withColumnRenamed("a", "title"), ["form", "title"]).groupBy("work"))
    titled = found.select("work", F.col("first").alias("position"), "score", F.lit("title").alias("how"), (F.col("first") != F.col("last")).alias("tie"))
    return exact.unionByName(titled)


def strong_key_hosts(works: DataFrame) -> DataFrame:
    """Adds host: the first work (by position) with the same ISBN, or failing one the same call number; the work itself if it has neither."""
    key = F.coalesce(F.nullif(bare_isbn(F.col("isbn")), F.lit("")), F.nullif(F.col("call"), F.lit("")))
    first = works.select(key.alias("key"), "work", "position").where("key is not null").groupBy("key").agg(F.min_by("work", "position").alias("host"))
    return works.withColumn("key", key).join(first, "key", "left").withColumn("host", F.coalesce("host", "work")).drop("key")


def title_candidates(works: DataFrame) -> DataFrame:
    """Pairs of works (work, position, title, isbn, call, and has_body if known) whose titles agree though no key joins them: a, b, score,
    for people to decide. Only works with text count, and only titles that may name a work.

    Works of one title and one key, or of one title and none, are paired with the first of them; across titles and keys the first ones
    stand for the others. Works with different keys are never paired, so the pairs of a title grow with its works, not with their square.
    """
    key = F.coalesce(F.nullif(bare_isbn(F.col("isbn")), F.lit("")), F.nullif(F.col("call"), F.lit("")))
    told = works.where(confident(F.col("title")) & (F.col("has_body") if "has_body" in works.columns else F.lit(True)))
    told = told.select(F.struct("position", "work", "title", key.alias("key"), normalized(F.col("title")).alias("plain")).alias("x")).where("x.plain <> ''")
    first = told.groupBy(F.col("x.plain").alias("plain"), F.col("x.key").alias("key")).agg(F.min("x").alias("first"))
    same = told.join(first.select(F.col("plain").alias("p"), F.col("key").alias("k"), "first"), F.col("x.plain").eqNullSafe(F.col("p")) & F.col("x.key").eqNullSafe(F.col("k")))
    equal = same.where("x.work <> first.work").select(F.col("first").alias("a"), F.col("x").alias("b"))
    bare, keyed = first.where("key is null"), first.where("key is not null")
    one_title = bare.select("plain", F.col("first").alias("a")).join(keyed.select("plain", F.col("first").alias("b")), "plain").select("a", "b")
    titles = first.select(F.col("plain").alias("title"))
    near = title_pairs(titles, titles, TITLE_RATIO, titles_match).select(F.col("a").alias("plain"), F.col("b").alias("other")).where("plain <> other")
    left = near.join(first.select("plain", F.col("first").alias("a")), "plain").select("other", "a", F.col("a.key").alias("a_key"))
    right = first.select(F.col("plain").alias("other"), F.col("first").alias("b"), F.col("key").alias("b_key"))
    # Of works of two titles all pairs but those with different keys: one has none, or both have the same.
    met = [left.join(right.where("b_key is null"), "other"), left.where("a_key is null").join(right.where("b_key is not null"), "other"), left.withColumnRenamed("a_key", "key").join(right.withColumnRenamed("b_key", "key"), ["other", "key"])]
    # The matcher is not symmetric: the earlier work's title comes first.
    alike = [m.select("a", "b").where("struct(a.position, a.work) < struct(b.position, b.work)") for m in met]
    both = equal
    for more in (one_title, *alike):
        both = both.unionByName(more)
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    same = F.col("a.plain") == F.col("b.plain")
    one_key = F.col("a.key").isNotNull() | F.col("b.key").isNotNull()
    generic = F.col("a.title").rlike(GENERIC_START) | F.col("b.title").rlike(GENERIC_START)
    score = same.cast("int") * 3 + (one_key & same).cast("int") * 2 + (F.length("a.plain") >= 20).cast("int") - 3 * generic.cast("int")
    out = both.select(F.col("a.work").alias("a"), F.col("b.work").alias("b"), score.alias("score"))
    return out.where("score > 0").orderBy(F.desc("score"), "a", "b")


def manual_merges(members: DataFrame, hints: DataFrame) -> DataFrame:
    """(image, work) after hints (position, kind, host, stems): groups join the work of their first present stem, in order, and
    then shots move to the work of their host. Hints are a hand-written file, so they are applied one after another."""
    told = members.select("image", "work", F.regexp_replace("image", r"\.[^.]*$", "").alias("stem"))
    for hint in sorted(hints.where("kind <> 'split'").collect(), key=lambda h: (h["kind"] == "move", h["position"])):
        stems = hint["stems"] if hint["kind"] == "group" else [hint["host"]]
        found = {r["stem"]: r["work"] for r in told.where(F.col("stem").isin(*stems)).select("stem", "work").collect()}
        present = [found[s] for s in stems if s in found]
        if not present:
            continue
        if hint["kind"] == "group":
            told = told.withColumn("work", F.when(F.col("work").isin(*present), F.lit(present[0])).otherwise(F.col("work")))
        else:
            told = told.withColumn("work", F.when(F.col("stem").isin(*hint["stems"]), F.lit(present[0])).otherwise(F.col("work")))
    return told.select("image", "work")
