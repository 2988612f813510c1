"""Scalar text functions as native columns.

White space means what Python's str.split means: Unicode white space and the four ASCII separators.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dialect of white space, line ends, mathematical symbols, headings, labels.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS = r"(?U:[\s\x1c-\x1f])"
_NUMBER = r"\p{Nd}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
MATH = "[∀-⋿℀-⅏⟀-⟯⦀-⧿⨀-⫿]"
LATEX = r"\\\[[\s\S]*?\\\]"
HEADING = rf"^(?:{_NUMBER}+[{_NUMBER}\.]*{WS}+)?[A-Z][^\n]{{0,80}}$"
LABEL = rf"^[A-Za-z](?:[A-Za-z\-]|{WS}){{0,40}}:{WS}+"
NUMBERED = rf"(?U)\b(?-U){_NUMBER}+(?:\.{_NUMBER}+)+{WS}+[^\n]{{1,80}}?(?=\n|{WS}{{2,}}|{WS}*[:\-]{WS}|\.(?:{WS}|$)|$)"
NOISE_CHARS = 35
STRONG, PARTIAL = 0.25, 0.08


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_text(x: Column | str, kind: str = "string") -> Column:
    """Null as '', lists joined by a space without nulls, anything else as its string."""
    x = as_column(x)
    if kind.startswith("array"):
        return F.coalesce(F.array_join(x.cast("array<string>"), " "), F.lit(""))
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column | str) -> Column:
    return F.btrim(as_column(x), F.lit(SPACES))


def normalize_ws(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(x), F.lit("")), f"{WS}+", " "))


def normalize_url(x: Column | str) -> Column:
    u = strip(F.coalesce(as_column(x), F.lit("")))
    return F.when((u == "") | u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit("https://"), u))


def split_sentences(x: Column | str) -> Column:
    """Sentences end at . ! ? before white space."""
    return F.filter(F.split(normalize_ws(x), r"(?<=[.!?]) "), lambda s: s != "")


def words(x: Column | str) -> Column:
    """Words between white space."""
    return F.filter(F.split(normalize_ws(x), " "), lambda w: w != "")


def lines(x: Column | str) -> Column:
    """Lines without their ends, as splitlines gives them."""
    return F.split(as_column(x), LINE_END)


def match_label(score: Column | str) -> Column:
    """Struct of label and css_class of a score."""
    s = as_column(score)
    pick = lambda a, b, c: F.when(s >= STRONG, a).when(s >= PARTIAL, b).otherwise(c)
    return F.struct(pick("strong match", "partial match", "weak match").alias("label"), pick("match-high", "match-medium", "match-low").alias("css_class"))


def is_math_heavy(x: Column | str) -> Column:
    return as_column(x).rlike(MATH)


def is_noise_sentence(x: Column | str) -> Column:
    """Empty, under 35 characters, a display formula as a whole, or with mathematical symbols."""
    return let(normalize_ws(x), lambda n: (F.length(n) < NOISE_CHARS) | n.rlike(r"^\\\[[\s\S]*\\\]$") | is_math_heavy(n))


def strip_leading_latex(x: Column | str) -> Column:
    """Without one display formula at the start."""
    return strip(F.regexp_replace(F.coalesce(as_column(x), F.lit("")), rf"^{WS}*{LATEX}", ""))


def remove_latex(x: Column | str) -> Column:
    """Without display formulas, white space normalised."""
    return normalize_ws(F.regexp_replace(F.coalesce(as_column(x), F.lit("")), LATEX, ""))


def truncate_words(x: Column | str, most: int) -> Column:
    """Up to `most` characters; a longer text ends at its last space and with an ellipsis."""
    x = as_column(x)
    return F.when(F.length(x) > most, F.concat(F.regexp_replace(F.substring(x, 1, most), " [^ ]*$", ""), F.lit("…"))).otherwise(x)


def clean_raw_passage(x: Column | str, max_chars: int = 500) -> Column:
    """A passage for display: no formulas, labels and numbered headings; paragraphs parted by an empty line."""
    paras = F.transform(F.split(F.regexp_replace(F.coalesce(as_column(x), F.lit("")), LATEX, ""), "\n"), strip)
    paras = F.filter(paras, lambda p: (p != "") & ~is_math_heavy(p))
    paras = F.transform(paras, lambda p: normalize_ws(F.regexp_replace(F.regexp_replace(p, LABEL, ""), NUMBERED, "")))
    joined = F.array_join(F.filter(paras, lambda p: p != ""), "\n\n")
    return truncate_words(joined, max_chars) if max_chars else joined


def is_heading(line: Column | str) -> Column:
    """Starts with a capital (after an optional number), under 80 characters, no full stop at the end."""
    line = as_column(line)
    return line.rlike(HEADING) & ~line.endswith(".") & (F.length(line) < 80)


def looks_scanned(x: Column | str, least: int = 40) -> Column:
    return F.length(strip(F.coalesce(as_column(x), F.lit("")))) < least


def html_escape(x: Column | str) -> Column:
    out = as_column(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def short_label(x: Column | str, most: int = 28) -> Column:
    x = as_column(x)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…"))).otherwise(x)


def word_prefixes(x: Column | str) -> Column:
    """The text as it is typed: an array of its growing word prefixes."""
    return let(words(x), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, 1, i), " "))).otherwise(F.array().cast("array<string>")))


def embed_text(section: Column | str, chunk: Column | str) -> Column:
    section, chunk = as_column(section), as_column(chunk)
    return F.when(section != "", F.concat(section, F.lit(". "), chunk)).otherwise(chunk)


def attribution(section: Column | str, page: Column | str) -> Column:
    """`§ section  ·  p. page` with the parts there are."""
    section, page = as_column(section), as_column(page)
    return F.concat_ws("  ·  ", F.when(section != "", F.concat(F.lit("§ "), section)), F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string"))))


def text_hash(x: Column | str) -> Column:
    return F.md5(as_column(x).cast("binary"))


def cache_key(source_name: Column | str, text: Column | str) -> Column:
    """The stored index's key: md5 of the name and the text's md5."""
    return F.md5(F.concat_ws(":", as_column(source_name), text_hash(text)).cast("binary"))


#: Fixed value: the reply where the document has no answer.
CANNOT = "I cannot determine this from the document."


def format_extractive(sentences: Column | str, attr: Column | str) -> Column:
    """The sentences without formulas, or a fixed reply, and the evidence's place."""
    core = remove_latex(F.array_join(as_column(sentences), " "))
    core = F.when(core == "", F.lit(CANNOT)).otherwise(core)
    return F.when(as_column(attr) != "", F.concat(core, F.lit("\n\nEvidence: ("), as_column(attr), F.lit(")"))).otherwise(core)
