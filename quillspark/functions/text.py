"""Scalar text functions as Column expressions; all run in the JVM.

White space is Unicode white space and lengths count code points. Null gives null unless
a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Token classes and sentence ends that results depend on.
TOKEN = r"[一-鿿]+|[A-Za-z0-9._%+-]+"
COUNTED = r"[一-鿿]|[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)?|[^\s]"
SENTENCE_END = "。！？!?；;"
EDGE = r"(?U)^\s+|\s+$"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), EDGE, "")


def clean_text(text: Column | str) -> Column:
    """Ideographic blanks and runs of blanks become one, three newlines and more two; blanks between ideographs go."""
    t = F.regexp_replace(F.translate(_col(text), "　", " "), r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r"(?<=[一-鿿]) (?=[一-鿿])", ""))


def edge_key(text: Column | str) -> Column:
    """What repeated headers and footers have in common: cleaned text with numbers masked."""
    return F.regexp_replace(clean_text(text), r"\d+", "#")


def compact(text: Column | str) -> Column:
    """White space as single blanks, none at the ends."""
    return strip(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def normalize_query(text: Column | str) -> Column:
    """Question marks, commas and colons of either width become blanks."""
    return compact(F.translate(F.coalesce(_col(text), F.lit("")), "？?，,：:", "      "))


def tokens(text: Column | str, segment=None) -> Column:
    """Lower-cased search tokens in order. ``segment``: splits runs of ideographs, array of tokens to array; whole runs without it."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    return segment(found) if segment else found


def bigrams(found: Column) -> Column:
    """A segmenter that needs no dictionary: runs of ideographs as overlapping pairs."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike("^[一-鿿]"), pairs(t)).otherwise(F.array(t))))


def token_count(text: Column | str) -> Column:
    """Model-free token count: ideographs, words with at most one dot, other signs."""
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(COUNTED)).cast("long")


def split_sentences(text: Column | str) -> Column:
    """Sentences with their ends, less those that are blank."""
    return F.filter(F.split(_col(text), f"(?<=[{SENTENCE_END}])"), lambda s: clean_text(s) != "")


def strip_tags(html: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(_col(html), F.lit("")), r"<[^>]+>", "")


def first_nonempty_line(text: Column | str) -> Column:
    lines = F.filter(F.transform(F.split(_col(text), "\n"), strip), lambda s: s != "")
    return F.coalesce(F.get(lines, 0), F.lit(""))


def first_sentence(text: Column | str, limit: int = 120) -> Column:
    """Up to the first of 。！？；; of the compacted text, else its first characters."""
    t = compact(text)
    head = strip(F.get(F.split(t, "(?<=[。！？；;])", 2), 0))
    return F.when(head != "", head).otherwise(F.substring(t, 1, limit))


def title_from_id(doc_id: Column | str) -> Column:
    """A document id as a title: without leading number and date, underscores as blanks."""
    return strip(F.translate(F.regexp_replace(_col(doc_id), r"^\d+_\d{4}-\d{2}-\d{2}_", ""), "_", " "))


def slug(text: Column | str, limit: int = 80) -> Column:
    """A file name made of a text."""
    t = F.regexp_replace(strip(text), r"(?U)[^\w\-]+", "_")
    t = F.substring(F.regexp_replace(t, "^_+|_+$", ""), 1, limit)
    return F.when(t == "", "query").otherwise(t)


def chunk_id(doc_id: Column | str, kind: str, index: Column) -> Column:
    """doc__kind_0001; long ids are cut for display, so key on (doc_id, kind, index)."""
    base = F.regexp_replace(F.regexp_replace(_col(doc_id), r"(?U)[^\w]+", "_"), "^_+|_+$", "")
    return F.concat(F.substring(base, 1, 48), F.lit(f"__{kind}_"), F.lpad(index.cast("string"), 4, "0"))


# The titles' patterns, in the order in which they are tried, with the levels that they give.
NUMERAL_TITLE, BRACKET_TITLE, NUMBER_TITLE = r"^[一二三四五六七八九十]+[、.]", r"^[（(][一二三四五六七八九十\d]+[）)]", r"^\d+(?:\.\d+)*[、. ]"
TITLE_LEVELS = ((NUMERAL_TITLE, 1), (BRACKET_TITLE, 2), (r"^\d+[、.]", 3))
BARE_NUMBER_TITLE, BARE_NUMBER_LEVEL = r"^\d+(?:[、\s]|$)", 3
SHORT_TITLE, SHORT_LEVEL, LONG_LEVEL = 18, 2, 1
CAPTION_TITLE, CAPTION_CHARS, TITLE_CHARS, CONTENTS_TITLE = "^(资料来源|图|表)", 12, 20, "目录"


def is_structural_title(text: Column | str) -> Column:
    """Short, numbered or table-of-contents titles; sentences and captions are none."""
    t = clean_text(text)
    numbered = t.rlike(NUMERAL_TITLE) | t.rlike(BRACKET_TITLE) | t.rlike(NUMBER_TITLE)
    caption = t.rlike(CAPTION_TITLE) & (F.length(t) > CAPTION_CHARS)
    return (t != "") & (t.contains(CONTENTS_TITLE) | (~t.rlike(f"[{SENTENCE_END}]") & ~caption & (numbered | (F.length(t) <= TITLE_CHARS))))


def title_level(text: Column | str) -> Column:
    """0 no title, else by the first pattern that fits; a number and a point is level 3, however many numbers follow; other short titles 2, long ones 1."""
    t = clean_text(text)
    level = None
    for pattern, n in TITLE_LEVELS:
        level = F.when(t.rlike(pattern), n) if level is None else level.when(t.rlike(pattern), n)
    level = level.when(t.rlike(BARE_NUMBER_TITLE), BARE_NUMBER_LEVEL).when(F.length(t) <= SHORT_TITLE, SHORT_LEVEL).otherwise(LONG_LEVEL)
    return F.when(is_structural_title(t), level).otherwise(0)
