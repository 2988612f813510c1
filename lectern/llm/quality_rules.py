"""Line-first quality rules.

Every line of a document is judged on its own; lines that fail a rule are removed, and a document
that loses too much of its text is rejected.  A line fails

* `punctuation`: it has at least `long_line` words and no sentence mark anywhere, or at least
  `shouted` of its words end in a run of marks no sentence uses (``***``, ``%%%``, ``!!`` ...);
* `navigation`: at least `separated` of its tokens are menu separators, three or more of them;
* `boilerplate`: at most `short_line` words around a stock phrase (of English, German, French or
  Spanish, in any case; longer lines may quote one), or the line repeats an earlier line of the document.

Words are the contract's everywhere: only ASCII white space ends them, so a no-break space, a line
separator or the control characters U+001C to U+001F are parts of words.

A document is rejected by the base rules (too few words, or over half of its words in repeated
three-word windows) or if over `max_lost` of its word characters stand in removed lines.

Null and empty texts have no words: they fail the base rules.  Repeated rows are judged each for
itself.  An empty table gives an empty result.  Other columns of the input don't matter.  Long texts
are read whole, block by block: windows are counted on numbers of words, so that memory stays at some
fifteen times the longest text's bytes.  There are no ties: every document is judged by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lectern.llm import kernels as K

#: Fixed values of the contract: white space that ends words, symbols, and the base limits.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SEPARATORS = {"|", "||", ">", ">>", "»", "›", "«", "•", "·", "/", "-", "–", "—", "*"}
PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies", "enable javascript",
    "click here", "subscribe to our newsletter", "sign up for", "log in to", "skip to content", "back to top", "share on facebook", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookies akzeptieren", "newsletter abonnieren", "hier klicken", "zum inhalt springen", "zum seitenanfang",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "accepter les cookies", "cliquez ici", "aller au contenu", "retour en haut",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos y condiciones", "aceptar cookies", "haga clic aquí", "ir al contenido", "volver arriba",
)
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]")
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f]")
#: Texts of more characters are counted on numbers of words, a block of so many characters at a time.
LONG = 1 << 20
_MARKED = re.compile(r"(?:[#*$%&|<>]+|!{2,}|\?{2,})$")
_SENTENCE_MARK = re.compile(r"[.!?…。！？]")


@dataclass(frozen=True)
class LineRules:
    long_line: int = 8
    short_line: int = 20
    shouted: float = 0.3
    separated: float = 0.2
    max_lost: float = 0.5


def words_of(line: str) -> list[str]:
    """The contract's words; where no other white space can stand, str.split finds the same ones faster."""
    return line.split() if line.isascii() and not _OTHER_SPACE.search(line) else _WORDS.findall(line)


def lowered(line: str) -> str:
    """In lower case, character by character (str.lower makes two characters of a capital i with a dot)."""
    return (line.replace("\u0130", "i") if "\u0130" in line else line).lower()


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that stand twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = [w in often for w in windows]
    return sum(map(any, zip([*hit, False, False], [False, *hit, False], [False, False, *hit], strict=True)))


def long_counts(text: str, block: int = LONG) -> tuple[int, int]:
    """Words, and those in repeated windows, of a long text: its words become numbers block by block."""
    numbers: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + block)
        end = cut.end() if cut else len(text)
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in text[at:end].encode("utf-8", "surrogatepass").split()], dtype=np.int64))
        at = end
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(ids) < 3:
        return len(ids), 0
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, same, n = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    hit = np.concatenate((n[same] > 1, [False, False]))
    return len(ids), int((hit | np.roll(hit, 1) | np.roll(hit, 2)).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """The counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the contract."""
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    if len(text) > LONG:
        n, repeated = long_counts(text)
    else:
        words = text.encode("utf-8", "surrogatepass").split()
        n, repeated = len(words), repeated_words(words)
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def line_fails(line: str, words: list[str], rules: LineRules) -> bool:
    """Whether a line with words breaks a rule that looks at this line alone."""
    n = len(words)
    if n >= rules.long_line and not _SENTENCE_MARK.search(line):
        return True
    if any(map(line.count, "#*$%&|<>!?")):
        if sum(1 for w in words if _MARKED.search(w)) >= max(2, rules.shouted * n):
            return True
        menu = sum(1 for w in words if w in SEPARATORS)
        if menu >= max(3, rules.separated * n):
            return True
    elif sum(1 for w in words if w in SEPARATORS) >= max(3, rules.separated * n):
        return True
    if n <= rules.short_line:
        low = lowered(line)
        return any(p in low for p in PHRASES)
    return False


def clean(text: str, rules: LineRules) -> tuple[str, float]:
    """The text without failing lines, and the share of word characters that went with them."""
    kept, seen, total, lost = [], set(), 0, 0
    for line in text.split("\n"):
        words = words_of(line)
        size = sum(map(len, words))
        total += size
        if words and (line in seen or line_fails(line, words, rules)):
            lost += size
        else:
            kept.append(line)
        if words:
            seen.add(line)
    return "\n".join(kept), lost / total if total else 0.0


def judge(text: str | None, rules: LineRules, want_text: bool = False) -> dict:
    """All counts and verdicts of one document."""
    text = text or ""
    n_words, chars, symbols, dup, repeat = base_counts(text)
    failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "lost": 0.0, "kept": False}
    if not failed or want_text:
        cleaned, out["lost"] = clean(text, rules)
        out["kept"] = not failed and out["lost"] <= rules.max_lost
        if want_text:
            out["clean_text"] = cleaned
    return out


_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("lost", pa.float64()), ("kept", pa.bool_())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lost double, kept boolean"


def quality_rules(docs: DataFrame, rules: LineRules | None = None, want_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the columns to carry, the base counts, base_failed, the share of text lost, kept, and clean_text if wanted."""
    rules = rules or LineRules()
    fields = [*_FIELDS, *([("clean_text", pa.string())] if want_text else [])]

    own = ["doc_id", *(carry or [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [judge(t.as_py(), rules, want_text) for t in part.column("text")]
                columns = [*(part.column(c) for c in own), *(pa.array([f[name] for f in found], kind) for name, kind in fields)]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *(name for name, _ in fields)])
        K.trim()

    added = T.StructType.fromDDL(_DDL + ", clean_text string" * want_text)
    return docs.select(*own, "text").mapInArrow(work, T.StructType([*(docs.schema[c] for c in own), *added.fields]))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and verdicts for every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lost")


OP4_SQL = r"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM doc),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM doc),
judged AS (
  SELECT doc_id, line, i, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM lines),
counted AS (
  SELECT doc_id, line, again, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS size,
         len(list_filter(w, lambda x: regexp_matches(x, '([#*$%&|<>]+|!{2,}|\?{2,})$'))) AS marked,
         len(list_filter(w, lambda x: list_contains(['|','||','>','>>','»','›','«','•','·','/','-','–','—','*'], x))) AS menu
  FROM judged WHERE len(w) > 0),
failing AS (
  SELECT *, again OR (n >= 8 AND NOT regexp_matches(line, '[.!?…。！？]')) OR marked >= greatest(2, 0.3 * n) OR menu >= greatest(3, 0.2 * n)
    OR (n <= 20 AND regexp_matches(lower(line), 'PHRASES')) AS fails
  FROM counted),
lost AS (
  SELECT doc_id, coalesce(sum(size) FILTER (WHERE fails), 0) / sum(size) AS lost, count(*) FILTER (WHERE again) AS n_dup_lines FROM failing GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 AS often FROM (
    SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM words WHERE len(w) >= 3)),
repeats AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE often) GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.lost, 0) AS lost
  FROM words LEFT JOIN lost l USING (doc_id) LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 AS kept
FROM base
""".replace("PHRASES", "|".join(p.replace("'", "''") for p in PHRASES))
