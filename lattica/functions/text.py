"""Column functions of text preparation. All are built-in expressions; a null input gives a null output unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as browsers trim it.
SPACE = r"[\s\x0B\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# The document classes.
CLASSES = ["medical_research", "legal", "technical", "family_genealogy", "financial_business", "academic_scientific", "news_journalism", "resume_cv", "historical_literary", "general"]
CHUNK, OVERLAP, TEXT_CAP = 1500, 200, 20_000
EXTRACTION = "entities array<struct<name:string,type:string>>, relations array<struct<source:string,source_type:string,relation:string,target:string,target_type:string>>"


def trim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalise_entity_name(name: Column) -> Column:
    """Trimmed, white space collapsed, curly quotes and long dashes in ASCII, zero-width characters dropped; case stays."""
    out = F.regexp_replace(trim(name), f"{SPACE}+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"[\u2018\u2019]", "'"), r"[\u201C\u201D]", '"')
    return F.regexp_replace(F.regexp_replace(out, r"[\u2013\u2014]", "-"), r"[\u200B-\u200D\uFEFF]", "")


def cap_text(text: Column, most: int = TEXT_CAP) -> Column:
    """A struct: the first characters of text, and whether there were more."""
    return F.struct(F.substring(text, 1, most).alias("text"), (F.char_length(text) > most).alias("truncated"))


def chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Windows of size characters that start every size - overlap, until the end is reached; the whole text if it fits."""
    step, n = size - overlap, F.char_length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def too_sparse(text: Column, least: int = 100) -> Column:
    """Whether a trimmed text is shorter than least: a scan without a text layer. Null counts as empty."""
    return F.char_length(F.coalesce(trim(text), F.lit(""))) < least


def split_values(value: Column, separators: str = "[;|]") -> Column:
    """The trimmed parts of a cell, without blank ones."""
    return F.filter(F.transform(F.split(value, separators), trim), lambda v: v != "")


def parse_extraction(raw: Column) -> Column:
    """A struct of entities and relations from a model's answer: fences stripped, the widest {...} parsed; empty arrays on failure."""
    bare = F.regexp_replace(raw, r"(?i)```(?:json)?", "")
    parsed = F.from_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0), EXTRACTION)
    empty = F.from_json(F.lit('{"entities": [], "relations": []}'), EXTRACTION)
    return F.struct(F.coalesce(parsed["entities"], empty["entities"]).alias("entities"), F.coalesce(parsed["relations"], empty["relations"]).alias("relations"))


def _named(name: Column) -> Column:
    return (F.char_length(name) >= 2) & ~name.rlike(r"^\d+$")


def _typed(kind: Column) -> Column:
    return F.coalesce(F.nullif(trim(kind), F.lit("")), F.lit("Entity"))


def clean_entities(entities: Column) -> Column:
    """Normalised names of two characters or more that are not all digits; a blank type is 'Entity'."""
    named = F.transform(entities, lambda e: F.struct(normalise_entity_name(e["name"]).alias("name"), _typed(e["type"]).alias("type")))
    return F.filter(named, lambda e: _named(e["name"]))


def relation_name(name: Column) -> Column:
    return F.upper(F.regexp_replace(normalise_entity_name(name), f"{SPACE}+", "_"))


def clean_relations(relations: Column) -> Column:
    """Normalised parts and upper-case relations; without short parts, numbers and self-loops. Types stay as they are."""
    named = F.transform(relations, lambda r: F.struct(normalise_entity_name(r["source"]).alias("source"), r["source_type"].alias("source_type"), relation_name(r["relation"]).alias("relation"), normalise_entity_name(r["target"]).alias("target"), r["target_type"].alias("target_type")))
    return F.filter(named, lambda r: _named(r["source"]) & _named(r["target"]) & (F.char_length(r["relation"]) >= 2) & (r["source"] != r["target"]))


def validate_class(label: Column) -> Column:
    """A known class in lower case, with underscores; 'general' for any other label and null."""
    bare = F.regexp_replace(F.lower(trim(label)), r"\W", "_")
    return F.when(bare.isin(CLASSES), bare).otherwise("general")


def parse_entity_list(raw: Column, question: Column) -> Column:
    """The names in the widest [...] of a model's answer; the question itself if there are none."""
    names = F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), "array<string>")
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, names).otherwise(F.array(question))


def extract_suggestions(text: Column) -> Column:
    """The JSON array in the first <suggestions> block; null if there is none or it is malformed."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)<suggestions>(.*?)</suggestions>", 1), F.lit("")), "array<string>")


def clean_answer(text: Column) -> Column:
    """The answer without its first <suggestions> block, trimmed."""
    return trim(F.regexp_replace(text, r"(?s)^(.*?)<suggestions>.*?</suggestions>", "$1"))


def source_label(files: Column) -> Column:
    """'[Source: f] ' of the first known file; '' without one."""
    known = F.filter(files, lambda f: ~f.isin("", "Unknown", "Unknown Source"))
    return F.coalesce(F.concat(F.lit("[Source: "), F.get(known, F.lit(0)), F.lit("] ")), F.lit(""))


def render_fact(source: Column, relation: Column, target: Column, files: Column) -> Column:
    return F.concat(source_label(files), source, F.lit(" --["), relation, F.lit("]--> "), target)


def truncate_fields(title: Column, message: Column, sample: Column) -> Column:
    """The lengths that fields are stored with: title 80, message 400, class sample 500."""
    return F.struct(F.substring(title, 1, 80).alias("title"), F.substring(message, 1, 400).alias("message"), F.substring(sample, 1, 500).alias("sample"))


def starter_questions(first: Column, second: Column, third: Column) -> Column:
    """Up to four questions about the best connected entities; none without a first one."""
    asked = F.array(
        F.concat(F.lit("Tell me about "), first),
        F.concat(F.lit("What is the relationship between "), first, F.lit(" and "), second, F.lit("?")),
        F.concat(F.lit("What role does "), third, F.lit(" play in this knowledge base?")),
        F.when(first.isNotNull(), "What are the most important concepts here?"),
    )
    return F.slice(F.filter(asked, F.isnotnull), 1, 4)
