"""Building, maintaining and describing graphs: entities (user_id, name, type) and relations (user_id, source, target, type, weight, source_files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import trim
from lattica.operators.ranks import numbered
from lattica.operators.search import containing

EDGE = ["user_id", "source", "target", "type"]


def best(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key in a total order, numbered."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def normalise_legacy(relations: DataFrame) -> DataFrame:
    """source_files from the old scalar source_file where the list is missing."""
    old = F.when(F.col("source_file").isNotNull(), F.array("source_file"))
    return relations.withColumn("source_files", F.coalesce("source_files", old, F.array().cast("array<string>"))).drop("source_file")


def upsert_entities(triples: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One entity for each name: the first type in arrival order that is not 'Entity', source before target.

    An existing entity keeps its type, null too, unless that is 'Entity'.
    """
    ends = triples.select("user_id", F.explode(F.array(F.struct(F.col("source").alias("name"), F.col("source_type").alias("type"), F.struct("seq", F.lit(0).alias("side")).alias("at")), F.struct(F.col("target").alias("name"), F.col("target_type").alias("type"), F.struct("seq", F.lit(1).alias("side")).alias("at")))).alias("e")).select("user_id", "e.*")
    kind = F.coalesce(F.min_by("type", F.when(F.col("type") != "Entity", F.col("at"))), F.lit("Entity"))
    new = ends.groupBy("user_id", "name").agg(kind.alias("type"))
    if existing is None:
        return new
    old = existing.select("user_id", "name", F.col("type").alias("was"), F.lit(True).alias("known"))
    return old.join(new, ["user_id", "name"], "full").select("user_id", "name", F.when(F.col("known") & (F.col("was").isNull() | (F.col("was") != "Entity")), F.col("was")).otherwise(F.coalesce("type", "was")).alias("type"))


def upsert_relations(triples: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One relation for each (source, target, type): weights add up, files are collected in order of name."""
    rows = triples.select("user_id", "source", "target", F.col("relation").alias("type"), F.lit(1).cast("long").alias("weight"), F.array("source_file").alias("source_files"))
    if existing is not None:
        rows = rows.unionByName(existing.select(*EDGE, "weight", "source_files"))
    # files are few; combining them before the shuffle keeps a hub's row small
    return rows.select(*EDGE, "weight", F.explode_outer("source_files").alias("file")).groupBy(*EDGE).agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("file")).alias("source_files")) if existing is None else rows.groupBy(*EDGE).agg(F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_files")))).alias("source_files"))


def both_ways(relations: DataFrame) -> DataFrame:
    """Every relation seen from each of its ends: node, other, is_forward, and the rest."""
    rest = [c for c in relations.columns if c not in ("source", "target")]
    return relations.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other"), F.lit(True).alias("is_forward")), F.struct(F.col("target").alias("node"), F.col("source").alias("other"), F.lit(False).alias("is_forward")))).alias("e"), *rest).select("e.*", *rest)


def degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations of each entity in either direction; 0 for an isolated one."""
    counted = both_ways(relations.select("user_id", "source", "target")).groupBy("user_id", F.col("node").alias("name")).agg(F.count("*").alias("degree"))
    return entities.join(counted, ["user_id", "name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def graph_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    nodes = entities.groupBy("user_id").agg(F.count("*").alias("nodes"))
    links = relations.groupBy("user_id").agg(F.count("*").alias("links"))
    return nodes.join(links, "user_id", "full").select("user_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("links", F.lit(0)).alias("links"))


def type_distribution(entities: DataFrame) -> DataFrame:
    """Entities of each type; null counts as 'Entity'."""
    return entities.groupBy("user_id", F.coalesce("type", F.lit("Entity")).alias("type")).agg(F.count("*").alias("n"))


def top_relation_types(relations: DataFrame, k: int = 6) -> DataFrame:
    counted = relations.groupBy("user_id", "type").agg(F.count("*").alias("n"))
    return best(counted, ["user_id"], [F.desc("n"), F.asc("type")], k)


def document_contributions(relations: DataFrame) -> DataFrame:
    """Relations that each file supports; 'Unknown' without a file."""
    return relations.select("user_id", F.explode_outer("source_files").alias("file")).groupBy("user_id", F.coalesce("file", F.lit("Unknown")).alias("file")).agg(F.count("*").alias("n"))


def document_metrics(triples: DataFrame) -> DataFrame:
    """Distinct endpoints and triples of each file."""
    ends = triples.select("user_id", "source_file", F.explode(F.array("source", "target")).alias("name"))
    names = ends.groupBy("user_id", "source_file").agg(F.count_distinct("name").alias("entity_count"))
    return names.join(triples.groupBy("user_id", "source_file").agg(F.count("*").alias("relation_count")), ["user_id", "source_file"])


def document_summary(relations: DataFrame, facts: int = 80, context: int = 50, top: int = 5) -> DataFrame:
    """For each file: entities and relations of its first ``facts`` relations, the first ``context`` facts, and its best connected entities."""
    edges = relations.select("user_id", F.explode("source_files").alias("file"), "source", "target", "type")
    first = best(edges, ["user_id", "file"], [F.asc("source"), F.asc("target"), F.asc("type")], facts)
    ends = first.select("user_id", "file", F.explode(F.array("source", "target")).alias("name"))
    line = F.concat("source", F.lit(" --["), "type", F.lit("]--> "), "target")
    lines = F.array_sort(F.collect_list(F.when(F.col("rank") <= context, F.struct("rank", line.alias("line")))))
    told = first.groupBy("user_id", "file").agg(F.count("*").alias("relation_count"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))
    names = ends.groupBy("user_id", "file").agg(F.count_distinct("name").alias("entity_count"))
    every = edges.select("user_id", "file", F.explode(F.array("source", "target")).alias("name")).groupBy("user_id", "file", "name").agg(F.count("*").alias("n"))
    leaders = best(every, ["user_id", "file"], [F.desc("n"), F.asc("name")], top).groupBy("user_id", "file").agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("x"))
    return told.join(names, ["user_id", "file"]).join(leaders.select("user_id", "file", F.array_join(F.transform("x", lambda x: x["name"]), "|").alias("top_entities")), ["user_id", "file"])


def node_sources(relations: DataFrame) -> DataFrame:
    """The known files behind each node's relations, in order of name."""
    seen = both_ways(relations.select("user_id", "source", "target", "source_files")).select("user_id", F.col("node").alias("name"), F.explode("source_files").alias("file")).where("file != 'Unknown'")
    return seen.groupBy("user_id", "name").agg(F.array_sort(F.collect_set("file")).alias("files"))


def canonical_by_case(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """For each name, the one of its case variants with the highest degree, the first by name of equals."""
    order = Window.partitionBy("user_id", F.lower("name")).orderBy(F.desc("degree"), F.asc("name"))
    return degree(entities, relations).withColumn("canonical", F.first("name").over(order))


def dedup_entities(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mapping, entities and relations after case variants have become one: edges rewired, loops gone, weights added up."""
    mapping = canonical_by_case(entities, relations)
    to = mapping.where("canonical != name").select("user_id", "name", "canonical")
    moved = relations
    for end in ("source", "target"):
        moved = moved.join(to.select("user_id", F.col("name").alias(end), F.col("canonical").alias("to")), ["user_id", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
    moved = moved.where("source != target").groupBy(*EDGE).agg(F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_files")))).alias("source_files"))
    kept = mapping.where("canonical = name").select(*entities.columns)
    return to, kept, moved


def dedup_summary(mapping: DataFrame) -> DataFrame:
    """Groups merged and entities deleted for each tenant."""
    return mapping.groupBy("user_id").agg(F.count_distinct("canonical").alias("groups"), F.count("*").alias("deleted"))


def delete_documents(entities: DataFrame, relations: DataFrame, files: DataFrame, shrink: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entities and relations without those of some (user_id, file), and without entities left alone.

    A relation that other files support goes as well, unless shrink: then it only loses the file.
    """
    gone = relations.select(*EDGE, F.explode("source_files").alias("file")).join(files, ["user_id", "file"]).groupBy(*EDGE).agg(F.collect_set("file").alias("gone"))
    if shrink:
        left = relations.join(gone, EDGE, "left").withColumn("source_files", F.array_except("source_files", F.coalesce("gone", F.array().cast("array<string>")))).where("gone IS NULL OR size(source_files) > 0").drop("gone")
    else:
        left = relations.join(gone, EDGE, "left_anti")
    return entities.join(orphans(entities, left), ["user_id", "name"], "left_anti"), left


def orphans(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities without any relation."""
    ends = relations.select("user_id", F.explode(F.array("source", "target")).alias("name"))
    return entities.join(ends, ["user_id", "name"], "left_anti")


def expand_node(requests: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 50) -> DataFrame:
    """Up to k relations of each requested (req_id, user_id, name), with the other end, its type and both degrees."""
    known = degree(entities, relations)
    near = requests.join(both_ways(relations), (requests["user_id"] == relations["user_id"]) & (F.col("name") == F.col("node"))).drop(relations["user_id"])
    order = [F.desc("weight"), F.asc("other"), F.asc("type"), F.desc("is_forward")]
    near = best(near.select("req_id", "user_id", "node", "other", "is_forward", "type", "weight"), ["req_id"], order, k)
    for end, label in (("node", "degree"), ("other", "other_degree")):
        near = near.join(known.select("user_id", F.col("name").alias(end), F.col("degree").alias(label), *([F.col("type").alias("other_type")] if end == "other" else [])), ["user_id", end], "left")
    source, target = F.when(F.col("is_forward"), F.col("node")).otherwise(F.col("other")), F.when(F.col("is_forward"), F.col("other")).otherwise(F.col("node"))
    return near.select("req_id", source.alias("source"), target.alias("target"), F.col("type").alias("label"), "weight", "degree", F.col("other").alias("id"), F.coalesce("other_type", F.lit("Entity")).alias("id_type"), "other_degree")


def node_detail(requests: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Head, relations and files of requested (req_id, user_id, name), names matched in any case; a head without a node means not found."""
    known = degree(entities, relations).withColumn("low", F.lower("name"))
    asked = requests.select("req_id", "user_id", F.lower("name").alias("low"))
    head = asked.join(known, ["user_id", "low"], "left").select("req_id", "user_id", "name", F.when(F.col("name").isNotNull(), F.coalesce("type", F.lit("Entity"))).alias("type"), F.coalesce("degree", F.lit(0)).alias("degree"))
    types = entities.select("user_id", F.col("name").alias("other"), F.col("type").alias("other_type"))
    rels = head.where("name IS NOT NULL").select("req_id", "user_id", F.col("name").alias("node")).join(both_ways(relations).withColumnRenamed("type", "rel_type"), ["user_id", "node"]).join(types, ["user_id", "other"], "left")
    rels = rels.select("req_id", "node", "rel_type", "other", F.coalesce("other_type", F.lit("Entity")).alias("other_type"), "source_files", "weight", F.col("is_forward").alias("is_outgoing"))
    files = rels.select("req_id", F.explode("source_files").alias("file")).where("file != 'Unknown'").distinct()
    return head.drop("user_id"), rels, files


def graph_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Long form (user_id, metric, key, value, rank): counts, types, top entities, relation types and documents.

    Lists with a limit are cut before the shuffle; a tenant's whole lists of types and documents are numbered by ranges.
    """
    long = lambda df, metric, key, value, rank: df.select("user_id", F.lit(metric).alias("metric"), key.alias("key"), value.cast("long").alias("value"), rank.cast("long").alias("rank"))
    none, one = F.lit(None).cast("string"), F.lit(1)
    counts = graph_counts(entities, relations)
    ranked = lambda df, key: numbered(df, ["user_id"], [F.desc("n"), F.asc(key)])
    return (
        long(counts, "node_count", none, F.col("nodes"), one)
        .unionByName(long(counts, "link_count", none, F.col("links"), one))
        .unionByName(long(ranked(type_distribution(entities), "type"), "type", F.col("type"), F.col("n"), F.col("rank")))
        .unionByName(long(top_entities(entities, relations), "top_entity", F.col("name"), F.col("degree"), F.col("rank")))
        .unionByName(long(top_relation_types(relations), "relation_type", F.col("type"), F.col("n"), F.col("rank")))
        .unionByName(long(ranked(document_contributions(relations), "file"), "doc", F.col("file"), F.col("n"), F.col("rank")))
    )


def top_entities(entities: DataFrame, relations: DataFrame, k: int = 8) -> DataFrame:
    return best(degree(entities, relations), ["user_id"], [F.desc("degree"), F.asc("name")], k)


def search_entities(requests: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 20) -> DataFrame:
    """Up to k entities whose name contains the trimmed query of (req_id, user_id, q), in any case, by degree; a blank query finds nothing.

    Candidates come from an index of letter triples (see ``containing``).
    """
    asked = requests.select("req_id", "user_id", F.lower(trim(F.col("q"))).alias("q"))
    found = containing(asked, entities.select("user_id", "name", "type", F.lower("name").alias("low")), "q", "low").select("req_id", "user_id", "name", "type")
    near = found.select("user_id", "name").distinct().join(both_ways(relations.select("user_id", "source", "target")).withColumnRenamed("node", "name"), ["user_id", "name"]).groupBy("user_id", "name").agg(F.count("*").alias("degree"))
    counted = found.join(near, ["user_id", "name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return best(counted, ["req_id"], [F.desc("degree"), F.asc("name")], k)


def doc_filter(relations: DataFrame, docs: Column) -> DataFrame:
    """Relations with a file that equals or contains one of docs (an array column or literal); all of them if docs is null or empty."""
    kept = F.exists("source_files", lambda f: F.exists(docs, lambda d: f.contains(d)))
    return relations.where(F.coalesce(F.size(docs) <= 0, F.lit(True)) | docs.isNull() | kept)


def skip_blank_nodes(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a name that is not null or blank, and the links of which neither end is."""
    named = lambda c: F.coalesce(trim(F.col(c)), F.lit("")) != ""
    return nodes.where(named("name")), links.where(named("source") & named("target"))


def full_graph(relations: DataFrame, k: int = 500) -> DataFrame:
    """Up to k relations of each tenant in order of their names, without blank ends, and whether there may be more."""
    first = best(skip_blank_nodes(relations.select(F.col("source").alias("name")), relations)[1], ["user_id"], [F.asc("source"), F.asc("target"), F.asc("type")], k)
    return first.withColumn("truncated", F.count("*").over(Window.partitionBy("user_id")) >= k)


def hide_types(entities: DataFrame, relations: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities of other types (null is 'Entity') and the relations between them."""
    seen = entities.where(~F.coalesce("type", F.lit("Entity")).isin(hidden))
    links = relations
    for end in ("source", "target"):
        links = links.join(seen.select("user_id", F.col("name").alias(end)), ["user_id", end], "left_semi")
    return seen, links


def merge_graphs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The union by key; where both have a row, the old one stays."""
    both = old.withColumn("newer", F.lit(0)).unionByName(new.withColumn("newer", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("newer", *rest)).alias("row")).select(*keys, "row.*") if rest else both.select(*keys).distinct()


def new_nodes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old, keys, "left_anti")


def distinct_names(triples: DataFrame) -> DataFrame:
    return triples.select("user_id", F.explode(F.array("source", "target")).alias("name")).distinct()


def highlight_match(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(req_id, name) of nodes whose lower-cased name contains a term of (req_id, user_id, term)."""
    asked = terms.select("req_id", "user_id", F.lower("term").alias("term"))
    return containing(asked, nodes.select("user_id", "name", F.lower("name").alias("low")), "term", "low").select("req_id", "name").distinct()


def apply_types(entities: DataFrame, proposals: DataFrame, allowed: list[str]) -> DataFrame:
    """Entities with the proposed type where it is allowed and not 'Entity'; unknown names are ignored."""
    told = proposals.where(F.col("proposed").isin([t for t in allowed if t != "Entity"])).groupBy("user_id", "name").agg(F.min("proposed").alias("proposed"))
    return entities.join(told, ["user_id", "name"], "left").select(*[F.coalesce("proposed", "type").alias("type") if c == "type" else F.col(c) for c in entities.columns], F.col("proposed").isNotNull().alias("updated"))


def untyped_entities(entities: DataFrame, k: int = 100) -> DataFrame:
    return best(entities.where("type IS NULL OR type = 'Entity'"), ["user_id"], [F.asc("name")], k)


def needs_embedding(names: DataFrame, entities: DataFrame) -> DataFrame:
    """Names whose entity has no embedding yet."""
    return names.distinct().join(entities.where("embedding IS NOT NULL"), ["user_id", "name"], "left_anti")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
