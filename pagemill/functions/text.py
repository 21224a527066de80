"""Column expressions over page text. Everything here stays inside Spark's own functions.

Regular expressions follow Unicode where the surveyed tool's do: letters are \\p{L}, white space is the Unicode class.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
PARAGRAPH = rf"\n{SPACES}*\n"
FOLIO = r"^(?i)(page\s+)?[0-9]{1,4}$"
# Words of a query that carry no content.
QUERY_STOPWORDS = [
    "the", "a", "an", "of", "to", "in", "on", "at", "by", "for", "and", "or", "is", "are", "was", "were", "be", "been", "with", "as", "that", "this", "it", "its", "from", "into", "where", "what", "who", "whom",
    "does", "do", "did", "how", "why", "when", "which", "about", "not", "but", "they", "them", "their", "there", "here", "you", "we", "his", "her", "say", "said", "says",
]
# What marks an imprint page.
IMPRINT = r"(?i)\b(isbn|first published|all rights reserved|catalogu(?:e|ing)[- ]in[- ]publication|library of congress|printed in|no part of this (?:book|publication))\b|©"
# How imprints tell ISBN, year and publisher, and slips call numbers.
ISBN = r"(?i)\bISBN[:\s]*((?:97[89][\s-]?)?[0-9][0-9\s-]{7,14}[0-9Xx])"
YEAR = r"(?i)(?:©|\(c\)|copyright|first published)[^\n]*?\b((?:19|20)[0-9]{2})\b"
PUBLISHER = r"(?i)published[^\n]*?\bby\b[:\s]*\n?\s*([^\n]+)"
CALL = r"\b([A-Z]{1,3}[0-9]{3}[.0-9]*\s*/\s*[0-9]{1,3})\b"
COVER_CHARS, COVER_CEILING, COVER_SCORE, FOLIO_LEAST, IMPRINT_CHARS = 280, 700, 0.30, 4, 1500


def let(value: Column, body) -> Column:
    """`body` of `value`, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACES}+|{SPACES}+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end starts no further line."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), rf"({LINE_END})\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def squashed(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def letters(text: Column) -> Column:
    """Number of letters: a proxy for a read that went well."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}", "")).cast("long")


def markdown_to_text(markdown: Column) -> Column:
    """Plain paragraphs: markers dropped, wrapped lines joined, paragraphs a blank line apart, one final line end."""

    def line(x: Column) -> Column:
        x = strip(x)
        for pattern, put in ((r"^#{1,6}\s*", ""), (r"^>\s?", ""), (r"^[-*+]\s+", ""), (r"\*\*(.+?)\*\*", "$1"), (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1"), (r"`(.+?)`", "$1")):
            x = F.regexp_replace(x, pattern, put)
        return x

    blocks = F.transform(F.split(strip(F.coalesce(markdown, F.lit(""))), PARAGRAPH), lambda b: F.array_join(F.filter(F.transform(lines(b), line), lambda x: x != ""), " "))
    return F.concat(F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n"), F.lit("\n"))


def normalized(markdown: Column) -> Column:
    return strip(F.regexp_replace(F.lower(markdown_to_text(markdown)), rf"{SPACES}+", " "))


def _bare(line: Column) -> Column:
    """A line without the marks that may lead it."""
    return strip(F.regexp_replace(strip(line), r"^[#>* ]+", ""))


def running_header(markdown: Column) -> Column:
    """The first line that says something: not blank and not a bare page number."""
    told = F.filter(F.transform(lines(markdown), _bare), lambda s: (s != "") & ~s.rlike(FOLIO))
    return F.coalesce(F.get(told, F.lit(0)), F.lit(""))


def page_numbers(markdown: Column) -> Column:
    """Numbers of the page headings; failing those, the first line that is a number of up to four digits."""
    headed = F.transform(F.regexp_extract_all(markdown, F.lit(r"###\s*Page\s+([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
    bare = F.slice(F.filter(F.transform(lines(markdown), strip), lambda s: s.rlike("^[0-9]{1,4}$")), 1, 1)
    return F.when(F.size(headed) > 0, headed).otherwise(F.transform(bare, lambda n: n.cast("int")))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"{SPACES}+"), "")


def full_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def _repetition(text: Column, body) -> Column:
    """`body` of a text's full lines and runs of three tokens, each worked out once: runs stand as hashes of their tokens."""
    def runs(t: Column) -> Column:
        at = F.transform(F.sequence(F.lit(0), F.size(t) - 3), lambda i: F.xxhash64(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)))
        return F.when(F.size(t) >= 3, at).otherwise(F.array().cast("array<long>"))

    return let(full_lines(text), lambda ls: let(let(tokens(text), runs), lambda rs: body(ls, rs)))


def _varied(text: Column) -> Column:
    """Counts of a text: full lines, different ones, runs of three tokens and different ones."""
    return _repetition(text, lambda ls, rs: F.struct(F.size(ls).alias("lines"), F.size(F.array_distinct(ls)).alias("own_lines"), F.size(rs).alias("runs"), F.size(F.array_distinct(rs)).alias("own_runs")))


def _quality(text: Column, v: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{Nl}\p{No}]{2,})"), F.lit(1))

    def score(w: Column) -> Column:
        voiced = F.size(F.filter(w, lambda x: F.lower(x).rlike(r"[aeiouyà-öø-ÿ]"))) / F.size(w)
        line_share = F.when(v["lines"] > 0, v["own_lines"] / v["lines"]).otherwise(F.lit(1.0))
        phrase_share = F.when(v["runs"] >= 28, v["own_runs"] / v["runs"]).otherwise(F.lit(1.0))
        return F.when(F.size(w) < 5, F.lit(1.0)).otherwise(F.bround(voiced * F.least(line_share, phrase_share), 3))

    return let(words, score)


def _runaway(v: Column) -> Column:
    phrase_share = F.when(v["runs"] >= 30, v["own_runs"] / v["runs"]).otherwise(F.lit(1.0))
    return F.coalesce((v["lines"] >= 10) & (F.least(v["own_lines"] / F.greatest(v["lines"], F.lit(1)), phrase_share) < 0.1), F.lit(False))


def text_quality(text: Column) -> Column:
    """Share of words with a vowel, times the smaller of line and phrase variety; 1 for under five words."""
    return let(_varied(text), lambda v: _quality(text, v))


def is_runaway(text: Column) -> Column:
    """At least ten lines of which, or of whose phrases, under a tenth differ."""
    return let(_varied(text), _runaway)


def read_quality(text: Column) -> Column:
    """Both as one struct (quality, runaway), from one pass over the text."""
    return let(_varied(text), lambda v: F.struct(_quality(text, v).alias("quality"), _runaway(v).alias("runaway")))


def is_echo(text: Column, marks: list[str]) -> Column:
    """Whether the text holds one of the long lines of an instruction."""
    found = F.lit(False)
    for mark in marks:
        found = found | F.coalesce(text, F.lit("")).contains(mark)
    return found


def shot_type(text: Column, colourfulness: Column | None = None) -> Column:
    """IMPRINT, COVER, SPREAD or PAGE, by the first rule that holds."""
    whole = strip(F.coalesce(text, F.lit("")))
    n = F.length(squashed(text))
    folios = F.transform(F.regexp_extract_all(whole, F.lit(r"###\s*Page\s+([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    numbered = F.exists(folios, lambda x: x >= FOLIO_LEAST)
    parts = F.split(whole, r"###\s*Page\s+[0-9]+")
    imprint_part = F.exists(parts, lambda p: p.rlike(IMPRINT) & (F.length(squashed(p)) < IMPRINT_CHARS))
    out = F.when(whole.rlike(IMPRINT), "IMPRINT").when((n < COVER_CHARS) & ~numbered, "COVER")
    if colourfulness is not None:
        bright = colourfulness * (1 - n / COVER_CEILING) >= COVER_SCORE
        out = out.when((n < COVER_CEILING) & ~numbered & F.coalesce(bright, F.lit(False)), "COVER")
    return out.when(F.size(parts) >= 3, F.when(imprint_part, "IMPRINT").otherwise("SPREAD")).otherwise("PAGE")


def _first(text: Column, pattern: str) -> Column:
    """The first group of the first match, null for none."""
    return F.get(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), F.lit(0))


def isbn(text: Column) -> Column:
    return strip(F.regexp_replace(_first(text, ISBN), r"\s+", " "))


def year(text: Column) -> Column:
    return _first(text, YEAR)


def publisher(text: Column) -> Column:
    return strip(_first(text, PUBLISHER))


def call_number(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(_first(text, CALL), r"\s+", ""), F.lit(""))


def metadata_block(text: Column, title: Column) -> Column:
    """Fields of a cover or imprint, one a line, in fixed order; `title` is null where the shot has none."""
    fields = (("title", title), ("publisher", publisher(text)), ("year", year(text)), ("isbn", isbn(text)))
    return F.concat_ws("\n", *[F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), value)) for name, value in fields])


def slug(text: Column, most: int = 40) -> Column:
    """Lower-case words joined by hyphens, for file names."""
    kept = F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}_\s-]", "")
    out = F.regexp_replace(F.substring(F.regexp_replace(kept, r"[\s_-]+", "-"), 1, most), r"^-+|-+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", "book").otherwise(out)


def yaml_value(text: Column) -> Column:
    """Quoted where YAML would read something else."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(text.rlike(r"""[:#\[\]{}&*!|>%@"']"""), quoted).otherwise(text)


def query_terms(text: Column) -> Column:
    """Content tokens of a query in order, repeats kept: ASCII words of three letters or digits and more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(QUERY_STOPWORDS))


def shingles(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


#: Accented Latin letters, and the base letters that stand for them in the index.
_FOLDED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xDF, 0x180) if unicodedata.normalize("NFD", chr(c))[0].isascii()}
_ACCENTED, _PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())


def index_terms(text: Column) -> Column:
    """Tokens of indexed text: lower case, accents folded, runs of letters and digits."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def embed_text(title: Column, author: Column, page: Column, text: Column) -> Column:
    """The text led by what a query may name: author, title and page."""
    head = F.concat_ws(" — ", F.when(author != "", author), F.when(title != "", title))
    place = F.when(F.coalesce(page, F.lit("")) != "", F.concat(F.lit("(p."), page, F.lit(")")))
    whole = F.concat_ws(" ", F.when(head != "", head), place)
    return F.when(whole != "", F.concat(whole, F.lit(": "), text)).otherwise(text)


def citation(author: Column, title: Column, book_file: Column, year: Column, image: Column, page: Column) -> Column:
    """Author, Title (year) · image p.N, without what is missing."""
    named = F.coalesce(F.nullif(title, F.lit("")), book_file)
    dated = F.when(F.coalesce(year, F.lit("")) != "", F.concat(named, F.lit(" ("), year, F.lit(")"))).otherwise(named)
    place = F.concat(F.coalesce(image, F.lit("")), F.when(F.coalesce(page, F.lit("-")).isin("", "-"), "").otherwise(F.concat(F.lit(" p."), page)))
    return F.concat(F.concat_ws(", ", F.nullif(author, F.lit("")), dated), F.when(place != "", F.concat(F.lit(" · "), place)).otherwise(""))


def duration(seconds: Column) -> Column:
    """N min, or H h MM min from an hour on."""
    minutes = F.bround(seconds / 60).cast("int")
    hours = F.format_string("%d h %02d min", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))
    return F.when(minutes < 60, F.format_string("%d min", minutes)).otherwise(hours)


def heading_anchor(heading: Column) -> Column:
    """The link target of a Markdown heading: lower case, no punctuation, hyphens for spaces."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(heading)), r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "-")


def distance(metres: Column) -> Column:
    """Metres, or kilometres with one decimal from 1000 metres on."""
    return F.when(metres >= 1000, F.format_string("%.1f km", metres / 1000)).otherwise(F.format_string("%.0f m", metres))
