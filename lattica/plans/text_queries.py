"""Queries of text preparation and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import ingest as ig
from lattica.plans.base import TRIPLES, table, triples
from lattica.sources.files import json_to_triples


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text")


def normalise(s, d):
    """Texts behind curly quotes, long dashes and characters of no width."""
    odd = F.lit("\u2018a\u2019 \u201cb\u201d \u2013\u2014 c\u200bd\u200ce\u200d ")
    return _docs(s, d).select("doc_id", F.md5(tx.normalise_entity_name(F.concat(odd, F.col("text")))).alias("name_md5"))


def cap(s, d):
    return _docs(s, d).select("doc_id", tx.cap_text(F.col("text")).alias("c")).select("doc_id", F.char_length("c.text").cast("long").alias("n"), "c.truncated")


def chunk(s, d):
    return ig.chunk_documents(_docs(s, d)).select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.md5("content").alias("content_md5"))


def sparse(s, d):
    return _docs(s, d).select("doc_id", tx.too_sparse(F.col("text")).alias("sparse"))


def _members(s, d):
    """An entity table with multi-valued relation columns."""
    return table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_name").alias("Full Name"), F.concat(F.lit(" "), "n_name", F.lit("; ;"), "s_name").alias("Country"), F.concat("n_name", F.lit("|GROUP "), F.col("s_suppkey") % 7).alias("Parent Company"), F.lit("x").alias("Rank"))


def csv_triples(s, d):
    df = _members(s, d)
    return ig.table_to_triples(df, ["Full Name", "Country", "Parent Company", "Rank"], ["s_suppkey"], order=F.col("s_suppkey")).drop("seq")


CSV_SQL = """
WITH m AS (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, s_name AS source, 'Person' AS source_type, 'from' AS relation, n_name AS target, 'Location' AS target_type FROM m
UNION ALL SELECT s_suppkey, s_name, 'Person', 'child of', n_name, 'Person' FROM m
UNION ALL SELECT s_suppkey, s_name, 'Person', 'child of', 'GROUP ' || CAST(s_suppkey % 7 AS VARCHAR), 'Person' FROM m
"""


def json_triples(s, d):
    rows = _members(s, d).select("s_suppkey", F.to_json(F.struct(F.array(F.struct(F.col("Full Name").alias("name"), F.array("Country", F.lit("A, B")).alias("country"), F.lit("C, D").alias("city"))).alias("items"))).alias("raw"))
    return json_to_triples(rows, ["name", "country", "city"]).groupBy("relation", "target").agg(F.count("*").alias("n"))


JSON_SQL = """
WITH m AS (SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
x AS (
  SELECT 'from' AS relation, n_name AS target FROM m
  UNION ALL SELECT 'from', v FROM m, (VALUES ('A'), ('B')) AS w(v)
  UNION ALL SELECT 'born in', v FROM m, (VALUES ('C'), ('D')) AS w(v))
SELECT relation, target, count(*) AS n FROM x GROUP BY relation, target
"""


def _answers(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    body = F.concat(F.lit('```json\n{"entities": [{"name": " '), "c_name", F.lit('", "type": "Person"}, {"name": "42", "type": "Number"}, {"name": "'), "n_name", F.lit('", "type": " "}], "relations": [{"source": "'), "c_name", F.lit('", "relation": "lives  in", "target": "'), "n_name", F.lit('"}, {"source": "'), "n_name", F.lit('", "relation": "is", "target": "'), "n_name", F.lit('"}]}\n``` done'))
    return c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).cast("long").alias("chunk_idx"), F.when(F.col("c_custkey") % 5 == 0, F.substring(body, 1, 60)).otherwise(body).alias("raw"))


def extraction_entities(s, d):
    return ig.extracted(_answers(s, d), ["doc_id"])[0].select("doc_id", "name", "type")


def extraction_relations(s, d):
    keys = ["doc_id", "chunk_idx"]
    entities, relations = ig.extracted(_answers(s, d), keys)
    return ig.resolve_types(relations, entities).select("doc_id", "source", "source_type", "relation", "target", "target_type")


def classes(s, d):
    label = F.concat(F.lit(" "), F.when(F.col("toxic") == 1, "News Journalism").when(F.col("quality") == 1, "LEGAL").otherwise("other"))
    return table(s, d, "labels").select("doc_id", tx.validate_class(label).alias("doc_class"))


def _talk(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 1, F.concat(F.lit(' <suggestions>["a", "b'), "turn", F.lit('"]</suggestions> end <suggestions>x</suggestions>'))).otherwise("")).alias("text"))


def suggestions(s, d):
    return _talk(s, d).select("conv_id", "turn", F.array_join(tx.extract_suggestions(F.col("text")), ",").alias("suggestions"), F.md5(tx.clean_answer(F.col("text"))).alias("answer_md5"))


def entity_list(s, d):
    raw = F.when(F.col("item_id") % 3 == 0, "no list").otherwise(F.concat(F.lit('Names: ["n'), "item_id", F.lit('", "m"]')))
    return table(s, d, "benchmark").select("item_id", F.array_join(tx.parse_entity_list(raw, F.col("text")), "|").alias("names"))


def truncated(s, d):
    f = tx.truncate_fields(F.col("text"), F.col("text"), F.col("text"))
    return _docs(s, d).select("doc_id", f.alias("f")).select("doc_id", F.md5("f.title").alias("title"), F.md5("f.message").alias("message"), F.md5("f.sample").alias("sample"))


def aliases(s, d):
    """Parts named by two words, by the second word and by three words, in documents of one supplier each."""
    rows = _named(s, d)
    return ig.alias_candidates(rows)


def _named(s, d):
    part = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") % 100).alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", "p_name")
    seq = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("seq")
    word = F.element_at(F.split("p_name", " "), -1)
    name = F.when(F.col("l_orderkey") % 3 == 0, word).when(F.col("l_orderkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("fine "), "p_name"))
    return part.select("doc_id", seq, "l_linenumber", name.alias("source"), F.lit("SOLD_IN").alias("relation"), F.concat(F.lit("Order "), F.col("l_orderkey") % 11).alias("target"))


def alias_resolved(s, d):
    return ig.alias_resolution(_named(s, d)).groupBy("doc_id", "source", "relation", "target").agg(F.count("*").alias("n"))


MET = """,
m AS (
  SELECT doc_id, name, min(ord) AS ord, string_split(lower(name), ' ') AS w
  FROM (SELECT doc_id, source AS name, seq * 2 AS ord FROM n UNION ALL SELECT doc_id, target, seq * 2 + 1 FROM n) GROUP BY doc_id, name),
a AS (
  SELECT x.doc_id, x.name, arg_min(y.name, ROW(-len(y.w), y.ord)) AS full_name
  FROM m x JOIN m y ON x.doc_id = y.doc_id AND len(y.w) > len(x.w) AND list_has_all(y.w, x.w) GROUP BY x.doc_id, x.name)"""

ALIAS = (
    """
n AS (
  SELECT l_suppkey % 100 AS doc_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq, 'SOLD_IN' AS relation,
         CASE l_orderkey % 3 WHEN 0 THEN list_extract(string_split(p_name, ' '), -1) WHEN 1 THEN p_name ELSE 'fine ' || p_name END AS source,
         'Order ' || CAST(l_orderkey % 11 AS VARCHAR) AS target
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
    + MET
)

ALIAS_RESOLVED = f"""
WITH {ALIAS},
z AS (
  SELECT n.doc_id, n.seq, coalesce(p.full_name, source) AS source, relation, coalesce(q.full_name, target) AS target,
         n.doc_id IN (SELECT doc_id FROM a) AS changed
  FROM n LEFT JOIN a p ON n.doc_id = p.doc_id AND n.source = p.name LEFT JOIN a q ON n.doc_id = q.doc_id AND n.target = q.name),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, relation, target ORDER BY seq) AS nth FROM z)
SELECT doc_id, source, relation, target, count(*) AS n FROM k
WHERE NOT changed OR (source <> target AND nth = 1) GROUP BY doc_id, source, relation, target
"""


def resolved(s, d):
    """Aliases and case: the places are in capitals on second lines (the line is not read from seq: part keys may have over six digits)."""
    rows = _named(s, d).withColumn("target", F.when(F.col("l_linenumber") == 2, F.upper("target")).otherwise(F.col("target")))
    return ig.resolve_triples(rows).groupBy("doc_id", "source", "relation", "target").agg(F.count("*").alias("n"))


#: From triples n (doc_id, seq, source, relation, target) on: aliases and case resolved.
STEPS = """,
z AS (
  SELECT n.doc_id, n.seq, coalesce(p.full_name, source) AS source, relation, coalesce(q.full_name, target) AS target,
         n.doc_id IN (SELECT doc_id FROM a) AS changed
  FROM n LEFT JOIN a p ON n.doc_id = p.doc_id AND n.source = p.name LEFT JOIN a q ON n.doc_id = q.doc_id AND n.target = q.name),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, relation, target ORDER BY seq) AS nth FROM z),
r1 AS (SELECT * FROM k WHERE NOT changed OR (source <> target AND nth = 1)),
x AS (SELECT doc_id, source AS name, seq * 2 AS ord FROM r1 UNION ALL SELECT doc_id, target, seq * 2 + 1 FROM r1),
f AS (SELECT doc_id, lower(name) AS low, arg_min(name, ord) AS name FROM x GROUP BY doc_id, lower(name))"""
RESOLVING = MET + STEPS
RESOLVED_ROWS = """SELECT r1.doc_id, u.name AS source, relation, v.name AS target
FROM r1 JOIN f u ON r1.doc_id = u.doc_id AND lower(source) = u.low JOIN f v ON r1.doc_id = v.doc_id AND lower(target) = v.low
WHERE u.name <> v.name"""
RESOLVED = f"""
WITH {ALIAS.replace("'Order ' ||", "CASE WHEN l_linenumber = 2 THEN 'ORDER ' ELSE 'Order ' END ||")}{STEPS}
SELECT doc_id, source, relation, target, count(*) AS n FROM ({RESOLVED_ROWS}) GROUP BY doc_id, source, relation, target
"""


def folded(s, d):
    rows = triples(s, d).withColumn("doc_id", F.col("user_id"))
    return ig.case_fold(rows).groupBy("doc_id", "source", "relation", "target").agg(F.count("*").alias("n"))


FOLDED = f"""
WITH {TRIPLES},
x AS (SELECT user_id, source AS name, seq * 2 AS ord FROM t UNION ALL SELECT user_id, target, seq * 2 + 1 FROM t),
f AS (SELECT user_id, lower(name) AS low, arg_min(name, ord) AS name FROM x GROUP BY user_id, lower(name))
SELECT t.user_id AS doc_id, a.name AS source, relation, b.name AS target, count(*) AS n
FROM t JOIN f a ON t.user_id = a.user_id AND lower(source) = a.low JOIN f b ON t.user_id = b.user_id AND lower(target) = b.low
WHERE a.name <> b.name GROUP BY t.user_id, a.name, relation, b.name
"""


def _registered(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_suppkey") % 20).alias("doc_id"), (F.col("l_orderkey") % 9).alias("chunk_idx"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("type"))


def registry(s, d):
    return ig.entity_registry(_registered(s, d), most=30).select("doc_id", "name", "type", F.col("number").cast("long").alias("number"), "seen")


REGISTRY = """
WITH x AS (
  SELECT l_suppkey % 20 AS doc_id, l_orderkey % 9 AS chunk_idx, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos,
         CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_type AS type
  FROM lineitem JOIN part ON l_partkey = p_partkey),
f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY chunk_idx, pos) = 1),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx, pos) AS number, count(*) OVER (PARTITION BY doc_id) AS most FROM f)
SELECT doc_id, name, type, number, most - number < 30 AS seen FROM g
"""


def status(s, d):
    docs = table(s, d, "documents").select("doc_id")
    rows = table(s, d, "lineitem").select((F.col("l_orderkey") % 400).alias("doc_id"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return ig.pipeline_status(docs, rows)


STATUS = """
WITH x AS (SELECT l_orderkey % 400 AS doc_id, 'p' || CAST(l_partkey % 50 AS VARCHAR) AS source, 's' || CAST(l_suppkey AS VARCHAR) AS target FROM lineitem),
n AS (SELECT doc_id, count(DISTINCT v) AS entity_count FROM (SELECT doc_id, source AS v FROM x UNION ALL SELECT doc_id, target FROM x) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS relation_count FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN relation_count > 0 THEN 'Completed' ELSE 'Failed' END AS status,
       coalesce(entity_count, 0) AS entity_count, coalesce(relation_count, 0) AS relation_count
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

def templates(s, d):
    kinds = s.createDataFrame([("general", "General", ["Entity"]), ("legal", "Legal", ["Party", "Court"]), ("news_journalism", "News", ["Person", "Event"])], "class string, label string, entity_types array<string>")
    docs = table(s, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "news_journalism").when(F.col("quality") == 1, "legal").otherwise("odd").alias("doc_class"))
    return ig.lookup_template(docs, kinds).select("doc_id", "label", F.array_join("entity_types", ",").alias("entity_types"))


def edge_list(s, d):
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.col("c_name").alias("Person A"), F.when(F.col("c_custkey") % 2 == 0, "LIVES_IN").otherwise("MARRIED_TO").alias("Relationship"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("Spouse of "), "c_name")).alias("Person B"))
    return ig.edge_list_to_triples(rows, ["c_custkey"])


QUERIES = {
    "x12_lookup_template": (templates, "SELECT doc_id, CASE WHEN toxic = 1 THEN 'News' WHEN quality = 1 THEN 'Legal' ELSE 'General' END AS label, CASE WHEN toxic = 1 THEN 'Person,Event' WHEN quality = 1 THEN 'Party,Court' ELSE 'Entity' END AS entity_types FROM labels"),
    "s8_read_edge_list": (edge_list, "SELECT c_custkey, c_name AS source, 'Person' AS source_type, CASE WHEN c_custkey % 2 = 0 THEN 'LIVES_IN' ELSE 'MARRIED_TO' END AS relation, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'Spouse of ' || c_name END AS target, CASE WHEN c_custkey % 2 = 0 THEN 'Location' ELSE 'Person' END AS target_type FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "x1_normalise_entity_name": (normalise, r"""SELECT doc_id, md5(replace(replace(regexp_replace(regexp_replace('''a'' "b" -- cde ' || text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), chr(8211), '-'), chr(8212), '-')) AS name_md5 FROM documents"""),
    "x2_cap_text": (cap, "SELECT doc_id, least(length(text), 20000) AS n, length(text) > 20000 AS truncated FROM documents"),
    "x3_chunk_text": (chunk, "SELECT doc_id, i AS chunk_idx, md5(substr(text, CAST(i * 1300 + 1 AS BIGINT), 1500)) AS content_md5 FROM (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 1500 THEN 0 ELSE CAST(ceil((length(text) - 1500) / 1300.0) AS BIGINT) END)) AS i FROM documents)"),
    "x4_reject_sparse_text": (sparse, r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 100 AS sparse FROM documents"),
    "s2_x6_x7_csv_to_triples": (csv_triples, CSV_SQL),
    "s3_json_to_triples": (json_triples, JSON_SQL),
    "x8_x9_extraction_entities": (extraction_entities, "SELECT c_custkey AS doc_id, c_name AS name, 'Person' AS type FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, n_name, 'Entity' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0"),
    "x10_j12_extraction_relations": (extraction_relations, "SELECT c_custkey AS doc_id, c_name AS source, 'Person' AS source_type, 'LIVES_IN' AS relation, n_name AS target, 'Entity' AS target_type FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0"),
    "x11_validate_class": (classes, "SELECT doc_id, CASE WHEN toxic = 1 THEN 'news_journalism' WHEN quality = 1 THEN 'legal' ELSE 'general' END AS doc_class FROM labels"),
    "x13_parse_entity_list": (entity_list, "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE 'n' || CAST(item_id AS VARCHAR) || '|m' END AS names FROM benchmark"),
    "x14_x15_suggestions": (suggestions, r"SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'a,b' || CAST(turn AS VARCHAR) END AS suggestions, md5(regexp_replace(CASE WHEN turn % 2 = 1 THEN text || '  end <suggestions>x</suggestions>' ELSE text END, '^\s+|\s+$', '', 'g')) AS answer_md5 FROM conversations"),
    "x18_truncate_fields": (truncated, "SELECT doc_id, md5(substr(text, 1, 80)) AS title, md5(substr(text, 1, 400)) AS message, md5(substr(text, 1, 500)) AS sample FROM documents"),
    "j5_alias_candidates": (lambda s, d: aliases(s, d).withColumnRenamed("full", "full_name"), f"WITH {ALIAS} SELECT doc_id, name, full_name FROM a"),
    "g10_w8_alias_resolution": (alias_resolved, ALIAS_RESOLVED),
    "g11_resolve_triples": (resolved, RESOLVED),
    "w3_case_fold_names": (folded, FOLDED),
    "w4_entity_registry": (registry, REGISTRY),
    "st3_pipeline_status": (status, STATUS),
}
