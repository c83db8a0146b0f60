"""An extractor without a model: a small rule grammar in SQL functions, whose answers have the form that models give."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word, a phrase of up to three of them, and a phrase of capitalised ones. A word of a phrase is never tried shorter
#: than it is: what follows is a blank or nothing.
WORD = "[A-Za-zÀ-ÿ'-]+"
PHRASE = f"{WORD}+(?: {WORD}+){{0,2}}"
CAPITALS = f"[A-Z]{WORD}(?: [A-Z]{WORD}){{0,2}}"


def sentences(text: Column) -> Column:
    """The parts of a text between full stops, question and exclamation marks and line ends, trimmed; blank ones go."""
    return F.filter(F.transform(F.split(text, r"[.!?\r\n]+"), lambda s: F.btrim(s)), lambda s: s != "")


def answer(content: Column, verbs: list[str]) -> Column:
    """The entities and relations of a chunk as JSON, in the order of its sentences; null for null.

    A sentence of three cells, ``A | b | C``, is a delimited fact. Any other gives a relation for each place where up to
    three words, one of the verbs and up to three words follow each other, read from the left, none twice. Phrases of up
    to three capitalised words are entities. Types are left to the later steps.
    """
    cells = lambda s: F.transform(F.split(s, r"\|"), lambda c: F.btrim(c))
    fact = lambda a, r, b: F.struct(a.alias("source"), F.lit("").alias("source_type"), r.alias("relation"), b.alias("target"), F.lit("").alias("target_type"))
    is_fact = lambda s: s.contains("|") & (F.size(cells(s)) == 3)
    told = F.transform(F.filter(sentences(content), is_fact), lambda s: fact(F.get(cells(s), F.lit(0)), F.get(cells(s), F.lit(1)), F.get(cells(s), F.lit(2))))
    found = told
    if verbs:
        # from inside a word nothing is found that is not found from its beginning; the parts of a place come from its own text
        rule = f"({PHRASE}) ({'|'.join(map(re.escape, verbs))}) ({PHRASE})"
        has_verb = lambda s: reduce(or_, [s.contains(f" {v} ") for v in verbs])
        plain = F.filter(sentences(content), lambda s: has_verb(s) & ~is_fact(s))
        part = lambda m, n: F.regexp_extract(m, f"^{rule}", n)
        rows = lambda s: F.transform(F.regexp_extract_all(s, F.lit(f"(?<![A-Za-zÀ-ÿ'-]){rule}"), F.lit(0)), lambda m: fact(part(m, 1), part(m, 2), part(m, 3)))
        found = F.concat(told, F.flatten(F.transform(plain, rows)))
    names = F.flatten(F.transform(sentences(content), lambda s: F.regexp_extract_all(s, F.lit(f"({CAPITALS})"), F.lit(1))))
    entities = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("name"), F.lit("").alias("type")))
    return F.when(content.isNotNull(), F.to_json(F.struct(entities.alias("entities"), found.alias("relations"))))
