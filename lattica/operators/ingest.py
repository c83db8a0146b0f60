"""From documents and tables to resolved triples (user_id, doc_id, seq, source, source_type, relation, target, target_type).

Arrival order is explicit: every first-seen rule reads seq, never the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import SPACE, chunks, clean_entities, clean_relations, parse_extraction, split_values, trim

# The headers of a name column, and the keywords of relation columns with their relation and the types of
# its ends, in the order in which they are tried.
NAME_SYNONYMS = ["name", "fullname", "full_name", "person", "entity", "title", "label", "person_name"]
RELATION_COLUMNS = [
    ("father", "child of", "Person", "Person"),
    ("mother", "child of", "Person", "Person"),
    ("parent", "child of", "Person", "Person"),
    ("spouse", "married to", "Person", "Person"),
    ("husband", "married to", "Person", "Person"),
    ("wife", "married to", "Person", "Person"),
    ("partner", "partner of", "Person", "Person"),
    ("child", "parent of", "Person", "Person"),
    ("children", "parent of", "Person", "Person"),
    ("son", "parent of", "Person", "Person"),
    ("daughter", "parent of", "Person", "Person"),
    ("sibling", "sibling of", "Person", "Person"),
    ("brother", "sibling of", "Person", "Person"),
    ("sister", "sibling of", "Person", "Person"),
    ("manager", "reports to", "Person", "Person"),
    ("reports_to", "reports to", "Person", "Person"),
    ("supervisor", "supervised by", "Person", "Person"),
    ("employer", "works at", "Person", "Organization"),
    ("company", "works at", "Person", "Organization"),
    ("organization", "member of", "Person", "Organization"),
    ("owns", "owns", "Person", "Entity"),
    ("owned_by", "owned by", "Entity", "Person"),
    ("founded_by", "founded by", "Organization", "Person"),
    ("located_in", "located in", "Entity", "Location"),
    ("location", "located in", "Entity", "Location"),
    ("city", "born in", "Person", "Location"),
    ("country", "from", "Person", "Location"),
]
REGISTRY = 200


def _bare(header: str) -> str:
    return "".join(c for c in header.lower() if c in "abcdefghijklmnopqrstuvwxyz_")


def relation_of(header: str) -> tuple[str, str, str] | None:
    """Relation and end types of a column: of the first keyword that its bare header contains."""
    return next((x[1:] for x in RELATION_COLUMNS if x[0] in _bare(header)), None)


def table_to_triples(df: DataFrame, columns: list[str], keep: list[str], separators: str = "[;|]", order: Column | None = None) -> DataFrame:
    """Triples of an entity table: its name column with every relation column, whose cells may hold several names.

    The name column is the first whose bare header is a synonym, else the first. Rows are ordered by ``order`` (a
    unique number), columns by their place. Blank names and cells, and values equal to the name, give nothing.
    """
    name = next((c for c in columns if _bare(c) in NAME_SYNONYMS), columns[0])
    mapped = [(i, c, r) for i, c in enumerate(columns) if c != name and (r := relation_of(c))]
    if not mapped:
        mapped = [(0, name, ("", "", ""))]  # no relation column: no rows below
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("value"), *(F.lit(v).alias(k) for k, v in zip(("relation", "source_type", "target_type"), r, strict=True))) for i, c, r in mapped])
    rows = df.withColumn("_row", order if order is not None else F.monotonically_increasing_id()).select(*keep, "_row", trim(F.col(f"`{name}`").cast("string")).alias("source"), F.explode(cells).alias("cell")).where("source != '' AND cell.relation != ''")
    rows = rows.select(*keep, "_row", "source", "cell.*").select(*keep, "_row", "column", "source", "source_type", "relation", F.posexplode(split_values(F.col("value"), separators)).alias("part", "target"), "target_type")
    return rows.where("target != source").select(*keep, F.struct("_row", "column", "part").alias("seq"), "source", "source_type", "relation", "target", "target_type")


def edge_list_to_triples(df: DataFrame, keep: list[str]) -> DataFrame:
    """Triples of an edge list with columns Person A, Relationship, Person B; places are Locations."""
    target_type = F.when(F.col("Relationship") == "LIVES_IN", "Location").otherwise("Person")
    return df.select(*keep, F.col("Person A").alias("source"), F.lit("Person").alias("source_type"), F.col("Relationship").alias("relation"), F.col("Person B").alias("target"), target_type.alias("target_type"))


def chunk_documents(df: DataFrame, size: int = 1500, overlap: int = 200, text_col: str = "text") -> DataFrame:
    """doc_id, chunk_idx and content of overlapping windows."""
    return df.select("doc_id", F.posexplode(chunks(F.col(text_col), size, overlap)).alias("chunk_idx", "content"))


def extracted(answers: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cleaned entities and relations of raw answers, with keep and pos, the place in the answer."""
    parsed = answers.withColumn("x", parse_extraction(F.col("raw")))
    entities = parsed.select(*keep, F.posexplode(clean_entities(F.col("x.entities"))).alias("pos", "e")).select(*keep, "pos", "e.*")
    relations = parsed.select(*keep, F.posexplode(clean_relations(F.col("x.relations"))).alias("pos", "r")).select(*keep, "pos", "r.*")
    return entities, relations


def entity_registry(entities: DataFrame, most: int = REGISTRY) -> DataFrame:
    """First-seen entities of each document (doc_id, chunk_idx, pos, name, type), numbered, with those that the next chunk sees: ``rank`` is their number, from the latest one down if at most ``most``."""
    low = F.lower("name")
    first = entities.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", low).orderBy("chunk_idx", "pos"))).where("nth = 1").drop("nth")
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_idx", "pos")))
    return numbered.withColumn("seen", F.max("number").over(Window.partitionBy("doc_id")) - F.col("number") < most)


def resolve_types(triples: DataFrame, entities: DataFrame, most: int = REGISTRY) -> DataFrame:
    """Missing end types: from entities of the same chunk, the last of a name winning, else from the last ``most`` registry names of earlier chunks, else 'Entity'."""
    known = entities.withColumn("low", F.lower("name")).groupBy("doc_id", "chunk_idx", "low").agg(F.max_by("type", "pos").alias("own"))
    registry = entity_registry(entities, most).select("doc_id", F.lower("name").alias("low"), "type", "number", F.col("chunk_idx").alias("from_chunk"))
    counts = registry.groupBy("doc_id", "from_chunk").agg(F.count("*").alias("new"))
    # registry names that exist before a chunk starts
    at = triples.select("doc_id", "chunk_idx").distinct().join(counts, "doc_id", "left").groupBy("doc_id", "chunk_idx").agg(F.coalesce(F.sum(F.when(F.col("from_chunk") < F.col("chunk_idx"), F.col("new"))), F.lit(0)).alias("size"))
    out = triples.join(at, ["doc_id", "chunk_idx"])
    for end in ("source", "target"):
        out = out.withColumn("low", F.lower(end)).join(known, ["doc_id", "chunk_idx", "low"], "left")
        out = out.join(registry.withColumnRenamed("type", "earlier"), ["doc_id", "low"], "left")
        seen = (F.col("from_chunk") < F.col("chunk_idx")) & (F.col("number") > F.col("size") - most)
        given = F.nullif(trim(F.col(f"{end}_type")), F.lit(""))
        out = out.withColumn(f"{end}_type", F.coalesce(given, F.col("own"), F.when(seen, F.col("earlier")), F.lit("Entity"))).drop("low", "own", "earlier", "number", "from_chunk")
    return out.drop("size")


def _names(triples: DataFrame) -> DataFrame:
    """(doc_id, name, at): the first place of each endpoint, source before target."""
    ends = triples.select("doc_id", F.explode(F.array(F.struct(F.col("source").alias("name"), F.struct("seq", F.lit(0)).alias("at")), F.struct(F.col("target").alias("name"), F.struct("seq", F.lit(1)).alias("at")))).alias("e"))
    return ends.select("doc_id", "e.*").groupBy("doc_id", "name").agg(F.min("at").alias("at"))


def alias_candidates(triples: DataFrame) -> DataFrame:
    """(doc_id, name, full): for each name, the longest other name of its document that has all its words, the first seen of equals.

    An inverted index of words: names meet on their words, and a pair counts if all words of the shorter one meet. A
    word that many names of one document share makes many pairs there; it is joined on the rarest word of the short name.
    """
    names = _names(triples).withColumn("words", F.split(F.lower(trim(F.regexp_replace("name", f"{SPACE}+", " "))), " "))
    posted = names.select("doc_id", F.explode(F.array_distinct("words")).alias("word"), F.col("name").alias("full"), F.col("words").alias("full_words"), F.col("at").alias("full_at"))
    frequent = posted.groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    short = names.select("doc_id", "name", "words", F.explode(F.array_distinct("words")).alias("word")).join(frequent, ["doc_id", "word"]).groupBy("doc_id", "name", "words").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    pairs = short.join(posted, ["doc_id", "word"]).where((F.size("full_words") > F.size("words")) & (F.size(F.array_except("words", "full_words")) == 0))
    return pairs.groupBy("doc_id", "name").agg(F.min_by("full", F.struct(-F.size("full_words"), "full_at")).alias("full"))


def _renamed(triples: DataFrame, mapping: DataFrame, key: Column | None = None) -> DataFrame:
    """Both endpoints replaced by ``full`` of mapping (doc_id, name, full)."""
    out = triples
    for end in ("source", "target"):
        out = out.withColumn("_k", F.lower(end) if key is not None else F.col(end)).join(mapping.select("doc_id", F.col("name").alias("_k"), "full"), ["doc_id", "_k"], "left").withColumn(end, F.coalesce("full", end)).drop("_k", "full")
    return out


def dedup_triples(triples: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Without self-loops and later repeats of (source, relation, target); with ``changed`` (doc_id), only in those documents."""
    nth = F.row_number().over(Window.partitionBy("doc_id", "source", "relation", "target").orderBy("seq"))
    bad = (F.col("source") == F.col("target")) | (F.col("nth") > 1)
    out = triples.withColumn("nth", nth)
    if changed is None:
        return out.where(~bad).drop("nth")
    marked = out.join(changed.select("doc_id").distinct().withColumn("changed", F.lit(True)), "doc_id", "left")
    return marked.where(F.col("changed").isNull() | ~bad).drop("nth", "changed")


def alias_resolution(triples: DataFrame, always: bool = False) -> DataFrame:
    """Aliases replaced by their full names; repeats dropped in documents that had an alias, or always."""
    mapping = alias_candidates(triples)
    return dedup_triples(_renamed(triples, mapping), None if always else mapping)


def case_fold(triples: DataFrame) -> DataFrame:
    """Every name in its first-seen case, self-loops dropped."""
    first = _names(triples).groupBy("doc_id", F.lower("name").alias("low")).agg(F.min_by("name", "at").alias("full"))
    return _renamed(triples, first.withColumnRenamed("low", "name"), key=F.lit(True)).where("source != target")


def resolve_triples(triples: DataFrame) -> DataFrame:
    return case_fold(alias_resolution(triples))


def lookup_template(documents: DataFrame, templates: DataFrame) -> DataFrame:
    """Documents (with doc_class) with the columns of their class's template (class, ...), or of the general one; null without either.

    Documents whose class has no template, or is null, look for the general one: two joins, whatever the number of
    templates. Of templates that repeat a class, each gives a row.
    """
    rest = [c for c in templates.columns if c != "class"]
    known = templates.select(F.col("class").alias("key")).distinct().withColumn("known", F.lit(True))
    keyed = documents.withColumn("key", F.col("doc_class")).join(known, "key", "left").withColumn("key", F.when(F.col("known"), F.col("key")).otherwise("general"))
    return keyed.join(templates.select(F.col("class").alias("key"), F.struct(*rest).alias("template")), "key", "left").select(*documents.columns, "template.*")


def pipeline_status(documents: DataFrame, triples: DataFrame) -> DataFrame:
    """Completed with counts for documents with triples, Failed for the others."""
    ends = triples.select("doc_id", F.explode(F.array("source", "target")).alias("name")).groupBy("doc_id").agg(F.count_distinct("name").alias("entity_count"))
    counts = triples.groupBy("doc_id").agg(F.count("*").alias("relation_count")).join(ends, "doc_id")
    out = documents.join(counts, "doc_id", "left")
    return out.select(*documents.columns, F.when(F.col("relation_count") > 0, "Completed").otherwise("Failed").alias("status"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("relation_count", F.lit(0)).alias("relation_count"))
