"""Queries that write the given tables with the sinks, or feed them to hooks and streams, and read the result back."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import functions as F

from lattica.functions import hooks
from lattica.functions.baseline import answer
from lattica.functions.text import parse_extraction
from lattica.operators import graph as g
from lattica.plans.base import GRAPH, graph, stored_graph, table, triples
from lattica.sources import files as sf
from lattica.plans.graph_queries import STATISTICS
from lattica.plans.table_queries import ADMITTED
from lattica.plans.text_queries import RESOLVED_ROWS, RESOLVING
from lattica.sources.shared import new_path, stored
from lattica.sources.store import GraphStore
from lattica.streaming import jobs
from lattica.streaming.documents import Ingestion, document_triples, ingest_documents
from lattica.streaming.limiter import rate_limiter
from lattica.streaming.statistics import live_statistics, statistics


def landing(s, d):
    """Ids of documents as .txt and .csv files, and as .json files, which are rejected: bytes of each kind."""
    ids, path = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id")), new_path(s, "landing")
    ids.write.text(f"{path}/a")
    ids.write.csv(f"{path}/b")
    ids.write.json(f"{path}/c")
    good, bad = sf.read_landing(s, f"{path}/*")
    return good.groupBy("ext").agg(F.sum(F.length("content")).alias("bytes")).unionByName(bad.groupBy("ext").agg(F.lit(None).cast("long").alias("bytes")))


def text_files(s, d):
    """Each benchmark item as a text file of its own."""
    path = new_path(s, "texts")
    table(s, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    return sf.read_text_documents(s, path).select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.md5("text").alias("text_md5"))


def table_files(s, d):
    """Customers as CSV files of an entity table."""
    path = new_path(s, "tables")
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c.select(F.col("c_name").alias("Full Name"), F.col("n_name").alias("Country"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Firm "), F.col("c_custkey") % 9)).alias("Employer")).write.csv(path, header=True)
    return sf.csv_to_triples(s, path).drop("seq")


def edge_files(s, d):
    """Customers as CSV files of an edge list."""
    path = new_path(s, "edges")
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c.select(F.col("c_name").alias("Person A"), F.lit("LIVES_IN").alias("Relationship"), F.col("n_name").alias("Person B"), F.lit("x").alias("City"), F.col("n_name").alias("Country")).write.csv(path, header=True)
    return sf.read_edge_list(s, path)


def exported(s, d):
    """The graph as JSON lines."""
    e, r = stored_graph(s, d)
    path = new_path(s, "export")
    sf.export_graph(e, r, path)
    links = s.read.schema(r.schema).json(f"{path}/links").select("user_id", F.col("source").alias("name"), "type", "weight")
    return links.unionByName(s.read.schema(e.schema).json(f"{path}/nodes").select("user_id", "name", "type", F.lit(None).cast("long").alias("weight")))


def rewritten(s, d):
    """The graph written by tenant, then the organizations of one tenant written over its rows."""
    e, r = graph(s, d)
    path = new_path(s, "graph")
    sf.write_graph(e, r, path)
    _, links = sf.read_graph(s, path)
    sf.write_graph(e.where("user_id = 'ASIA' AND type = 'Organization'"), links.where("user_id = 'ASIA' AND type = 'SUPPLIES'"), path)
    entities, relations = sf.read_graph(s, path)
    count = lambda df, kind: df.groupBy("user_id", F.lit(kind).alias("kind")).agg(F.count("*").alias("n"))
    return count(entities, "entities").unionByName(count(relations, "relations"))


def unblanked(s, d):
    """The graph with the names of some suppliers blank."""
    e, r = stored_graph(s, d)
    blank = lambda c: F.when(F.col(c).rlike("(?i)^supplier.*7$"), F.lit(" \t")).otherwise(F.col(c)).alias(c)
    nodes, links = g.skip_blank_nodes(e.select("user_id", blank("name"), "type"), r.select("user_id", blank("source"), blank("target"), "type"))
    count = lambda df, kind: df.groupBy("user_id", F.lit(kind).alias("kind"), "type").agg(F.count("*").alias("n"))
    return count(nodes, "entities").unionByName(count(links, "relations"))


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: length and first letter of each text."""
    return [[float(len(t)), float(ord(t[0]))] for t in texts]


def embedded(s, d):
    return hooks.embed_in_batches(graph(s, d)[0], _letters).select("user_id", "name", F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))


def _kind(text: str) -> str:
    """A stand-in for a model: an odd length is a class, others an answer that is none."""
    if not text:
        raise ValueError("nothing to classify")
    return "legal" if len(text) % 2 else "whatever"


def classified(s, d):
    return hooks.classify(table(s, d, "documents").select("doc_id", "text"), _kind).select("doc_id", "doc_class")


def _answer(text: str) -> str:
    """A stand-in for a model: the first and last word of a chunk as an answer."""
    words = text.split(" ")
    if len(words) % 7 == 0:
        raise ValueError("no answer")
    return json.dumps({"entities": [], "relations": [{"source": f"a{len(words)}", "source_type": "Person", "relation": "NEXT_TO", "target": "b", "target_type": "Person"}]})


def extracted(s, d):
    chunks = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.lit(0).alias("chunk_idx"), F.col("text").alias("content"))
    found = hooks.extract(chunks, _answer).withColumn("x", parse_extraction(F.col("raw")))
    return found.select("doc_id", F.get(F.col("x.relations"), F.lit(0))["source"].alias("source"))


def _told(text: str, template: dict, registry: list[dict]) -> str:
    """A stand-in for a model: one entity of a chunk, and how many it has been told of."""
    return json.dumps({"entities": [{"name": f"name {text[:3]}", "type": template["kind"]}], "relations": [{"source": f"told {len(registry)}", "source_type": "", "relation": "IS", "target": template["kind"], "target_type": ""}]})


def extracted_in_order(s, d):
    """The turns of conversations as the chunks of documents."""
    chunks = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_idx"), F.col("text").alias("content"), F.lit("Person").alias("kind"))
    found = hooks.extract_in_order(chunks, _told, ["kind"], most=3).withColumn("x", parse_extraction(F.col("raw")))
    return found.select("doc_id", "chunk_idx", F.get(F.col("x.relations"), F.lit(0))["source"].alias("told"))


def proposed(s, d):
    names = table(s, d, "part").select("p_name").distinct().select(F.col("p_name").alias("name"))
    return hooks.propose_types(names, lambda some: {n: "Event" if len(n) % 3 else "Concept" for n in some if " " in n})


def matched_upsert(s, d):
    """The graph in a store of buckets, then the places of customers and nations again, in lower case and with a new relation."""
    rows = triples(s, d)
    more = rows.where("source_file IN ('customer', 'nation')").withColumns({"source_file": F.lit("again"), "seq": F.col("seq") + (1 << 50), "source": F.lower("source"), "target": F.lower("target"), "relation": F.when(F.col("relation") == "PART_OF", "BELONGS_TO").otherwise(F.col("relation"))})
    store = GraphStore(s, new_path(s, "store")).upsert(rows).upsert(more, match="case_insensitive")
    return store.relations.select("user_id", "source", "target", "type", "weight", F.array_join("source_files", ",").alias("source_files"))


def _stream(s, df, name):
    """df, written in several files, as a stream of a file or two for each batch."""
    path = new_path(s, name)
    df.repartition(4).write.parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def ingested(s, d):
    """The triples as a stream of events, folded to the relations of the graph."""
    events = triples(s, d).withColumns({"event_id": F.concat_ws("-", F.monotonically_increasing_id().cast("string"), "source_file"), "ts": F.timestamp_seconds(F.lit(86_400))})
    out = new_path(s, "ingested")
    jobs.ingest_stream(_stream(s, events, "triples"), out, new_path(s, "progress")).trigger(availableNow=True).start().awaitTermination()
    e, r = jobs.streamed_graph(s, out)
    return r.select("user_id", F.col("source").alias("name"), "type", "weight").unionByName(e.select("user_id", "name", "type", F.lit(None).cast("long").alias("weight")))


def fed(s, d):
    """Events as changes of the status of documents."""
    changes = table(s, d, "events").select(F.col("user_id").cast("string").alias("user_id"), (F.col("event_id") % 500).cast("string").alias("document_id"), F.col("event_id").alias("version"), F.lit("UPDATE").alias("kind"), F.col("event_type").alias("status"))
    out = new_path(s, "feed")
    jobs.document_status_feed(_stream(s, changes, "changes"), out, new_path(s, "progress")).trigger(availableNow=True).start().awaitTermination()
    return jobs.document_status(s, out)


def _in_turn(s, df, n, start):
    """df in n slices by ``slice``: each is written for a stream to read, which then runs, from its checkpoint, until it has read all."""
    path, progress = new_path(s, "slices"), new_path(s, "progress")
    for i in range(n):
        df.where(F.col("slice") == i).drop("slice").repartition(2).write.mode("append").parquet(path)
        start(s.readStream.schema(df.drop("slice").schema).parquet(path), progress, i)


def limited(s, d):
    """Events in four batches by time, then a heartbeat a month later, by which all are decided."""
    e = table(s, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    width = (F.lit(last).cast("long") - F.lit(first).cast("long")) / 4 + 1
    slices = e.withColumn("slice", F.floor((F.col("ts").cast("long") - F.lit(first).cast("long")) / width).cast("int"))
    beat = s.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("event_id"), (F.lit(last) + F.expr("interval 30 days")).alias("ts"), F.lit(4).alias("slice"))
    out = new_path(s, "admitted")

    def start(stream, progress, _):
        rate_limiter(stream, 2, 6 * 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()

    _in_turn(s, slices.unionByName(beat), 5, start)
    return s.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("admitted").alias("admitted"))


def live(s, d):
    """The statistics after each of three batches of triples, with the batch in the tenant's name."""
    rows = triples(s, d).withColumn("slice", (F.col("seq") % 3).cast("int"))
    out, seen = new_path(s, "statistics"), []

    def start(stream, progress, i):
        live_statistics(stream, out, progress).trigger(availableNow=True).start().awaitTermination()
        now = statistics(s, out).withColumn("user_id", F.concat("user_id", F.lit(f"/{i}")))
        seen.append(stored(now, "statistics-now"))

    _in_turn(s, rows, 3, start)
    return reduce(lambda a, b: a.unionByName(b), seen)


VERBS = ["is", "was", "with", "von"]


def _told_by_rules(chunks):
    return chunks.withColumn("raw", answer(F.col("content"), VERBS))


def by_rules(s, d):
    """Documents from text to resolved triples by the rules of the baseline extractor: no Python."""
    found = document_triples(table(s, d, "documents").select("doc_id", "text"), _told_by_rules)
    return found.groupBy("doc_id", "source", "relation", "target").agg(F.count("*").alias("n"))


def ingested_documents(s, d):
    """Documents of each source as uploads of a user, in three batches; all events of a batch come again in the next one, stamped two hours later."""
    docs = table(s, d, "documents")
    events = docs.select(F.concat(F.lit("doc-process-"), "doc_id").alias("event_id"), F.col("source").alias("user_id"), "doc_id", F.concat(F.lit("doc_"), "doc_id").alias("source_file"), F.timestamp_seconds(F.col("doc_id") + 86_400).alias("ts"), (F.col("doc_id") % 3).cast("int").alias("slice"))
    late = events.withColumns({"slice": F.col("slice") + 1, "ts": F.col("ts") + F.expr("interval 2 hours")}).where("slice < 3")
    out = new_path(s, "ingested")

    def start(stream, progress, _):
        ingest_documents(stream, docs, out, progress, _told_by_rules).trigger(availableNow=True).start().awaitTermination()

    _in_turn(s, events.unionByName(late), 3, start)
    _, relations = Ingestion(s, out).graph()
    return relations.select("user_id", "source", "target", "type", "weight", F.size("source_files").cast("long").alias("n_files"))


RULES = r"""
ch AS (
  SELECT doc_id, i AS chunk_idx, substr(t, CAST(i * 1300 + 1 AS BIGINT), 1500) AS content
  FROM (SELECT doc_id, t, unnest(generate_series(0, CASE WHEN length(t) <= 1500 THEN 0 ELSE CAST(ceil((length(t) - 1500) / 1300.0) AS BIGINT) END)) AS i
        FROM (SELECT doc_id, substr(text, 1, 20000) AS t FROM documents WHERE text IS NOT NULL))),
se AS (SELECT doc_id, chunk_idx, s, i, list_transform(string_split(s, '|'), lambda c: trim(c, ' ')) AS cells
  FROM (SELECT doc_id, chunk_idx, unnest(l) AS s, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, chunk_idx, list_filter(list_transform(regexp_split_to_array(content, '[.!?
]+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM ch))),
ru AS (SELECT *, regexp_extract_all(s, pat, 1) AS a, regexp_extract_all(s, pat, 2) AS r, regexp_extract_all(s, pat, 3) AS b
  FROM (SELECT *, '(' || p || ') (is|was|with|von) (' || p || ')' AS pat FROM (SELECT *, '[A-Za-zÀ-ÿ''-]+(?: [A-Za-zÀ-ÿ''-]+){0,2}' AS p FROM se WHERE len(cells) <> 3))),
fa AS (
  SELECT doc_id, chunk_idx, 0 AS kind, i, 0 AS j, cells[1] AS source, cells[2] AS relation, cells[3] AS target FROM se WHERE len(cells) = 3
  UNION ALL SELECT doc_id, chunk_idx, 1, i, unnest(generate_series(1, len(a))), unnest(a), unnest(r), unnest(b) FROM ru),
cl AS (
  SELECT doc_id, chunk_idx, kind, i, j, regexp_replace(regexp_replace(source, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS source,
         replace(upper(regexp_replace(regexp_replace(relation, '^\s+|\s+$', '', 'g'), '\s+', '_', 'g')), 'ẞ', 'SS') AS relation,
         regexp_replace(regexp_replace(target, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS target FROM fa),
n AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, kind, i, j) AS seq, source, relation, target FROM cl
  WHERE length(source) >= 2 AND length(target) >= 2 AND length(relation) >= 2 AND source <> target
    AND NOT regexp_full_match(source, '[0-9]+') AND NOT regexp_full_match(target, '[0-9]+'))"""


G = f"WITH {GRAPH} "
BLANK = "regexp_matches(lower({}), '^supplier.*7$')"
BOTH = "SELECT user_id, source AS name, type, weight FROM r UNION ALL SELECT user_id, name, type, NULL FROM e"
QUERIES = {
    "s1_read_landing": (landing, "SELECT 'txt' AS ext, CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS bytes FROM documents UNION ALL SELECT 'csv', CAST(sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) FROM documents UNION ALL SELECT 'json', NULL"),
    "s4_read_text_documents": (text_files, "SELECT item_id, md5(text || chr(10)) AS text_md5 FROM benchmark"),
    "s2_csv_files": (
        table_files,
        "WITH c AS (SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT c_name AS source, 'Person' AS source_type, 'from' AS relation, n_name AS target, 'Location' AS target_type FROM c UNION ALL SELECT c_name, 'Person', 'works at', 'Firm ' || CAST(c_custkey % 9 AS VARCHAR), 'Organization' FROM c WHERE c_custkey % 2 = 0",
    ),
    "s8_edge_list_files": (edge_files, "SELECT c_name AS source, 'Person' AS source_type, 'LIVES_IN' AS relation, n_name AS target, 'Location' AS target_type FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "s5_export_graph": (exported, G + BOTH),
    "s6_write_graph": (rewritten, G + "SELECT user_id, 'entities' AS kind, count(*) AS n FROM e WHERE user_id <> 'ASIA' OR type = 'Organization' GROUP BY user_id UNION ALL SELECT user_id, 'relations', count(*) FROM r WHERE user_id <> 'ASIA' OR type = 'SUPPLIES' GROUP BY user_id"),
    "g1_upsert_case_insensitive": (
        matched_upsert,
        G
        + """, a AS (SELECT user_id, lower(source) AS source, CASE relation WHEN 'PART_OF' THEN 'BELONGS_TO' ELSE relation END AS type, lower(target) AS target FROM t WHERE source_file IN ('customer', 'nation')),
k AS (SELECT user_id, lower(name) AS low, min(name) AS least, bool_or(name = lower(name)) AS exact FROM e GROUP BY user_id, lower(name)),
b AS (SELECT a.user_id, CASE WHEN x.exact THEN x.low ELSE x.least END AS source, CASE WHEN y.exact THEN y.low ELSE y.least END AS target, type FROM a JOIN k x ON a.user_id = x.user_id AND a.source = x.low JOIN k y ON a.user_id = y.user_id AND a.target = y.low),
z AS (SELECT user_id, source, target, type, weight, source_files FROM r UNION ALL SELECT user_id, source, target, type, 1, ['again'] FROM b)
SELECT user_id, source, target, type, CAST(sum(weight) AS BIGINT) AS weight, list_aggregate(list_sort(list_distinct(flatten(list(source_files)))), 'string_agg', ',') AS source_files FROM z GROUP BY user_id, source, target, type""",
    ),
    "p7_skip_blank_nodes": (unblanked, G + f"SELECT user_id, 'entities' AS kind, type, count(*) AS n FROM e WHERE NOT {BLANK.format('name')} GROUP BY user_id, type UNION ALL SELECT user_id, 'relations', type, count(*) FROM r WHERE NOT {BLANK.format('source')} AND NOT {BLANK.format('target')} GROUP BY user_id, type"),
    "v8_h3_embed_in_batches": (embedded, G + "SELECT user_id, name, CAST(length(name) AS DOUBLE) AS x, CAST(unicode(name) AS DOUBLE) AS y FROM e"),
    "h1_classifier": (classified, "SELECT doc_id, CASE WHEN least(length(coalesce(text, '')), 500) % 2 = 1 THEN 'legal' ELSE 'general' END AS doc_class FROM documents"),
    "h2_extractor": (extracted, "SELECT doc_id, CASE WHEN n % 7 <> 0 THEN 'a' || CAST(n AS VARCHAR) END AS source FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents WHERE text IS NOT NULL)"),
    "h2_extractor_in_order": (
        extracted_in_order,
        r"""WITH c AS (SELECT conv_id, turn, lower(regexp_replace(trim('name ' || substr(text, 1, 3), ' ' || chr(9) || chr(10)), '\s+', ' ', 'g')) AS name FROM conversations),
f AS (SELECT conv_id, name, min(turn) AS turn FROM c GROUP BY conv_id, name)
SELECT c.conv_id AS doc_id, c.turn AS chunk_idx, 'told ' || CAST(least(3, count(f.name)) AS VARCHAR) AS told
FROM c LEFT JOIN f ON c.conv_id = f.conv_id AND f.turn < c.turn GROUP BY c.conv_id, c.turn""",
    ),
    "h4_type_classifier": (proposed, "SELECT DISTINCT p_name AS name, CASE WHEN NOT contains(p_name, ' ') THEN NULL WHEN length(p_name) % 3 <> 0 THEN 'Event' ELSE 'Concept' END AS proposed FROM part"),
    "st1_ingest_stream": (ingested, G + BOTH),
    "st2_document_status_feed": (fed, "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 500 AS VARCHAR) AS document_id, arg_max(event_type, event_id) AS status, max(event_id) AS version FROM events GROUP BY user_id, event_id % 500"),
    "st1_ingest_documents": (
        ingested_documents,
        f"WITH {RULES}{RESOLVING}, zz AS ({RESOLVED_ROWS}) SELECT d.source AS user_id, zz.source, zz.target, relation AS type, count(*) AS weight, count(DISTINCT zz.doc_id) AS n_files FROM zz JOIN documents d ON zz.doc_id = d.doc_id GROUP BY d.source, zz.source, zz.target, relation",
    ),
    "baseline_extractor": (by_rules, f"WITH {RULES}{RESOLVING} SELECT doc_id, source, relation, target, count(*) AS n FROM ({RESOLVED_ROWS}) GROUP BY doc_id, source, relation, target"),
    "st4_rate_limiter": (limited, ADMITTED),
    "st5_live_stats": (live, "WITH " + GRAPH.replace("t AS (", "t0 AS (", 1).replace(",\nends AS (", ",\nt AS (SELECT user_id || '/' || CAST(i AS VARCHAR) AS user_id, * EXCLUDE (user_id, i) FROM t0 JOIN range(3) x(i) ON seq % 3 <= i),\nends AS (", 1) + STATISTICS),
}
