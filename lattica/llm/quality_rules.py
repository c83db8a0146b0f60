"""Quality rules (operator 7): clean line by line, then reject documents that lose too much text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import hashed_words, rows_of, slices, tidy, windows

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# Phrases of boilerplate lines, in lower case, by language.
BOILERPLATE = {
    "": ["©", "lorem ipsum"],
    "en": ["all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "subscribe to our newsletter", "sign up for our newsletter", "enable javascript", "click here to", "skip to content"],
    "de": ["alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "newsletter abonnieren", "zum inhalt springen", "cookie-richtlinie"],
    "fr": ["tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "aller au contenu", "abonnez-vous à notre newsletter"],
    "es": ["todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "saltar al contenido", "suscríbete a nuestro boletín"],
}
PHRASES = [p for some in BOILERPLATE.values() for p in some]
#: Words up to which a line with an address of a page is a link alone, and how such addresses begin.
LINK_WORDS, LINK = 8, re.compile(r"(?:^|[\x20\x09-\x0D])(?:https?://|www\.)")
#: Separators between the entries of a navigation line.
SEPARATORS = "|»›•·"
#: Shares above which a line goes: separators to words, symbols or exclamation marks to words.
NAVIGATION, NOISE = 0.25, 0.5
#: A document that loses more of its words than this is rejected.
LOST = 0.5
MIN_WORDS, MAX_REPEATED = 10, 0.2
TEXT_BYTES = 2 << 20

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, clean_text string"


def line_fault(line: str, words: list) -> str | None:
    """The rule that a line breaks: navigation, boilerplate, link, punctuation or case; None for a good line.

    navigation: at least three separators, and one for every four words. boilerplate: a phrase of the lists.
    link: a word that begins like the address of a page, in a line of at most LINK_WORDS words.
    punctuation: at least three symbols or doubled exclamation marks, and one for every two words.
    case: at least ten ASCII capitals, and more of them than small ASCII letters.
    """
    n = len(words)
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 3 and separators > NAVIGATION * n:
        return "navigation"
    if any(map(line.lower().__contains__, PHRASES)):
        return "boilerplate"
    if n <= LINK_WORDS and LINK.search(line):
        return "link"
    marks = sum(map(line.count, SYMBOLS)) + line.count("!!")
    if marks >= 3 and marks > NOISE * n:
        return "punctuation"
    if line.isascii():
        capitals, small = sum(map(str.isupper, line)), sum(map(str.islower, line))
    else:
        capitals, small = sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
    return "case" if capitals >= 10 and capitals > small else None


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words that lie in a window of width words found twice or more."""
    if len(hashes) < width:
        return 0
    _, inverse, counts = np.unique(windows(hashes, width), return_inverse=True, return_counts=True)
    edge = np.zeros(len(hashes) + 1, np.int32)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge[starts] += 1
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None, hashes: np.ndarray) -> tuple:
    """The row of a text, given the hashes of its words."""
    text, n = text or "", len(hashes)
    seen, dup_lines, lost, clean = set(), 0, 0, []
    for line in text.split("\n"):
        own = line.encode().split()
        if not own:
            continue
        dup_lines += line in seen
        seen.add(line)
        if line_fault(line, own):
            lost += len(own)
        else:
            clean.append(line)
    repeated = repeated_words(hashes)
    failed = n < MIN_WORDS or repeated > MAX_REPEATED * n
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup_lines, repeated, failed, not failed and lost <= LOST * n, lost, "\n".join(clean)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdict and the lines left (``clean_text``) for each row of docs; null texts have no words and are rejected.

    Each row is judged by itself: repeated rows and null ids give rows like any other.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=TEXT_BYTES):
            hashes, counts = hashed_words(part.column("text").to_pylist(), bytes(range(256)))
            own = np.split(hashes, np.cumsum(counts)[:-1])
            found = [measure(t, h) for t, h in zip(part.column("text").cast(pa.string()).to_pylist(), own, strict=True)]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([x[i] for x in found], t) for i, t in enumerate(kinds))], names)

    return rows_of(docs, id_col, text_col).mapInArrow(tidy(run), SCHEMA)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("clean_text", "n_lost_words")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w,
         generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (
  SELECT doc_id, i, w || chr(10) || lead(w, 1) OVER o || chr(10) || lead(w, 2) OVER o || chr(10) || lead(w, 3) OVER o
         || chr(10) || lead(w, 4) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 THEN 1 ELSE 0 END AS dup FROM g),
c AS (SELECT doc_id, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM r),
n AS (SELECT doc_id, count(*) AS n_words, sum(hit) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ln FROM d),
f AS (
  SELECT doc_id, line, ln, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         length(line) - length(translate(line, '|»›•·', '')) AS sep,
         length(line) - length(translate(line, '#*$%&|<>', ''))
           + (length(line) - length(replace(line, '!!', ''))) // 2 AS marks,
         length(regexp_replace(line, '[^A-Z]', '', 'g')) AS cap, length(regexp_replace(line, '[^a-z]', '', 'g')) AS low
  FROM l),
b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY ln) > 1 AS again,
    (sep >= 3 AND sep > 0.25 * n)
    OR regexp_matches(lower(line), '""" + "|".join(PHRASES).replace("'", "''") + r"""')
    OR (n <= 8 AND regexp_matches(line, '(^|[\x20\x09-\x0D])(https?://|www\.)'))
    OR (marks >= 3 AND marks > 0.5 * n) OR (cap >= 10 AND cap > low) AS bad
  FROM f WHERE n > 0),
a AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (bad), 0) AS lost FROM b GROUP BY doc_id),
x AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN a ON d.doc_id = a.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost <= n_words AS kept
FROM x
"""
