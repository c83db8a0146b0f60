"""Queries over the graph of the star schema, and over the link graph of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as tx
from lattica.operators import graph as g
from lattica.operators import paths as p
from lattica.operators.text_index import TextIndex
from lattica.plans.base import GRAPH, graph, stored_graph, table, triples
from lattica.sources.shared import new_path


def _files(df, col="source_files"):
    return df.withColumn(col, F.array_join(col, ","))


def entities(s, d):
    return graph(s, d)[0]


def relations(s, d):
    return _files(graph(s, d)[1])


def reupsert(s, d):
    """The graph of all triples but the shipped ones, with the shipped ones added afterwards."""
    rows = triples(s, d)
    late = rows.where("relation = 'SUPPLIES'")
    e, r = g.upsert_entities(rows.where("relation != 'SUPPLIES'")), g.upsert_relations(rows.where("relation != 'SUPPLIES'"))
    return _files(g.upsert_relations(late, r)).join(g.upsert_entities(late, e).select("user_id", F.col("name").alias("source"), F.col("type").alias("source_type")), ["user_id", "source"])


def neighbours(s, d):
    return g.both_ways(graph(s, d)[1]).groupBy("user_id", "node", "is_forward").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def degrees(s, d):
    return g.degree(*stored_graph(s, d))


def _requests(s, d):
    """A node to look at for each supplier, in upper case for odd keys."""
    base = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return base.select(F.col("s_suppkey").alias("req_id"), F.col("r_name").alias("user_id"), F.col("s_name").alias("name"))


REQ = "q AS (SELECT s_suppkey AS req_id, r_name AS user_id, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def expand(s, d):
    return g.expand_node(_requests(s, d), *stored_graph(s, d))


def detail(s, d):
    head, rels, files = g.node_detail(_requests(s, d).withColumn("name", F.upper("name")), *stored_graph(s, d))
    counts = rels.groupBy("req_id", F.col("node").alias("name")).agg(F.count("*").alias("relations"), F.sum(F.col("is_outgoing").cast("long")).alias("outgoing"), F.sum("weight").alias("weight"))
    return head.join(counts, ["req_id", "name"]).join(files.groupBy("req_id").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files")), "req_id")


def search(s, d):
    asked = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("req_id"), F.col("r_name").alias("user_id"), F.concat(F.lit(" "), F.lit("#"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(" ")).alias("q"))
    return g.search_entities(asked, *stored_graph(s, d)).select("req_id", "name", "type", "degree", F.col("rank").cast("long").alias("rank"))


def full(s, d):
    return _files(g.full_graph(graph(s, d)[1])).withColumn("rank", F.col("rank").cast("long"))


def filtered(s, d):
    return g.doc_filter(graph(s, d)[1], F.array(F.lit("1995"), F.lit("nation"))).groupBy("user_id", "type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def hidden(s, d):
    e, r = g.hide_types(*stored_graph(s, d), ["Location", "Person"])
    return e.groupBy("user_id", F.lit("entities").alias("kind")).agg(F.count("*").alias("n")).unionByName(r.groupBy("user_id", F.lit("relations").alias("kind")).agg(F.count("*").alias("n")))


def deduped_entities(s, d):
    return g.dedup_entities(*stored_graph(s, d))[1]


def deduped_relations(s, d):
    return _files(g.dedup_entities(*stored_graph(s, d))[2])


def dedup_mapping(s, d):
    return g.dedup_entities(*stored_graph(s, d))[0]


def dedup_report(s, d):
    return g.dedup_summary(g.dedup_entities(*stored_graph(s, d))[0])


CANON = ", w AS (SELECT *, first_value(name) OVER (PARTITION BY user_id, lower(name) ORDER BY degree DESC, name) AS canonical FROM d)"


def _gone(s, d):
    return table(s, d, "region").select(F.col("r_name").alias("user_id"), F.explode(F.array(F.lit("customer"), F.lit("ship_1995"))).alias("file"))


def deleted(s, d):
    e, r = g.delete_documents(*stored_graph(s, d), _gone(s, d))
    return e.select("user_id", "name", F.lit(0).cast("long").alias("weight")).unionByName(r.groupBy("user_id", F.col("source").alias("name")).agg(F.sum("weight").alias("weight")))


def shrunk(s, d):
    return _files(g.delete_documents(*stored_graph(s, d), _gone(s, d), shrink=True)[1])


def orphaned(s, d):
    e, r = stored_graph(s, d)
    return g.orphans(e, r.where("type != 'LOCATED_IN'"))


def merged(s, d):
    e, _ = graph(s, d)
    old = e.where("type = 'Organization'").withColumn("type", F.lit("Old"))
    return g.merge_graphs(old, e.where("type IN ('Organization', 'Location')"), ["user_id", "name"])


def fresh(s, d):
    e, _ = graph(s, d)
    return g.new_nodes(e.where("type != 'Product'"), e, ["user_id", "name"])


def highlighted(s, d):
    terms = _requests(s, d).select("req_id", "user_id", F.concat(F.lit("#"), F.substring_index("name", "#", -1)).alias("term"))
    return g.highlight_match(graph(s, d)[0], terms)


def typed(s, d):
    e, _ = graph(s, d)
    told = e.withColumn("proposed", F.when(F.col("name").rlike("[13579]$"), "Event").when(F.col("name").rlike("0$"), "Entity").otherwise("Nonsense"))
    return g.apply_types(e, told, ["Person", "Organization", "Location", "Event", "Concept", "Technology", "Entity"]).groupBy("user_id", "type", "updated").agg(F.count("*").alias("n"))


def untyped(s, d):
    e, _ = graph(s, d)
    return g.untyped_entities(e.withColumn("type", F.when(F.col("type") != "Organization", F.col("type")))).select("user_id", "name", F.col("rank").cast("long").alias("rank"))


def facts(s, d):
    r = graph(s, d)[1]
    return r.select("user_id", tx.render_fact(F.col("source"), F.col("type"), F.col("target"), F.col("source_files")).alias("fact"))


def starters(s, d):
    top = g.top_entities(*stored_graph(s, d), k=3).groupBy("user_id").pivot("rank", [1, 2, 3]).agg(F.first("name"))
    return top.select("user_id", F.array_join(tx.starter_questions(F.col("1"), F.col("2"), F.col("3")), "\n").alias("questions"))


def _links(s, d):
    """Pages, and the links between them by address; one tenant, web."""
    pages, web = table(s, d, "pages"), F.lit("web").alias("user_id")
    out = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    nodes = pages.select(web, F.col("url").alias("id")).distinct()
    return nodes, out.select(web, F.col("url").alias("source"), F.col("href").alias("target")).join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def _directed(s, d):
    """The names and links of the whole graph."""
    e, r = stored_graph(s, d)
    return e.select("user_id", F.col("name").alias("id")), r.select("user_id", "source", "target")


def ranked(s, d):
    nodes, links = _directed(s, d)
    return p.pagerank(nodes, links).select("user_id", "id", F.round("pagerank", 6).alias("pagerank"))


DIRECTED = """, k AS (SELECT user_id, source, target FROM r), v AS (SELECT user_id, name AS id FROM e)"""


def _pagerank_sql(given: str, rounds: int = 20) -> str:
    """The rounds unrolled, over links k and nodes v."""
    out = f"WITH {given}, o AS (SELECT user_id, source, count(*) AS n FROM k GROUP BY user_id, source), z AS (SELECT user_id, count(*) AS n FROM v GROUP BY user_id), p0 AS MATERIALIZED (SELECT v.user_id, id, 1.0 / z.n AS pr, o.n AS out, z.n FROM v JOIN z ON v.user_id = z.user_id LEFT JOIN o ON v.user_id = o.user_id AND id = source)"
    for i in range(rounds):
        out += f""", s{i} AS (SELECT user_id, coalesce(sum(pr) FILTER (WHERE out IS NULL), 0) AS lost FROM p{i} GROUP BY user_id),
g{i} AS (SELECT k.user_id, target, sum(pr / out) AS got FROM k JOIN p{i} ON k.user_id = p{i}.user_id AND k.source = p{i}.id GROUP BY k.user_id, target),
p{i + 1} AS MATERIALIZED (SELECT a.user_id, a.id, 0.85 * coalesce(got, 0) + 0.15 / n + 0.85 * lost / n AS pr, out, n
  FROM p{i} a JOIN s{i} ON a.user_id = s{i}.user_id LEFT JOIN g{i} ON a.user_id = g{i}.user_id AND a.id = g{i}.target)"""
    return out + f" SELECT user_id, id, round(10 * pr / max(pr) OVER (PARTITION BY user_id), 6) AS pagerank FROM p{rounds}"


def levels(s, d):
    nodes, links = _directed(s, d)
    return p.hierarchy_levels(nodes, links).withColumn("level", F.col("level").cast("long"))


LEVELS = f"""WITH RECURSIVE {GRAPH}{DIRECTED},
root AS (SELECT v.user_id, v.id FROM v LEFT JOIN k ON v.user_id = k.user_id AND v.id = k.target WHERE k.target IS NULL),
walk AS (
  SELECT user_id, id, 0 AS level FROM root
  UNION SELECT k.user_id, k.target, level + 1 FROM walk JOIN k ON walk.user_id = k.user_id AND walk.id = k.source WHERE level < 8),
best AS (SELECT user_id, id, min(level) AS level FROM walk GROUP BY user_id, id)
SELECT v.user_id, v.id, coalesce(level, max(level) OVER (PARTITION BY v.user_id) + 1) AS level
FROM v LEFT JOIN best ON v.user_id = best.user_id AND v.id = best.id"""


def paths(s, d):
    """From each supplier's nation to the first part it supplies, within its region."""
    asked = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pair_id"), F.col("r_name").alias("user_id"), F.upper("n_name").alias("from"), F.when(F.col("n_nationkey") % 3 == 0, F.lit("hot plate")).when(F.col("n_nationkey") % 3 == 1, F.lower("n_name")).otherwise("nowhere").alias("to"))
    return p.shortest_path(asked, graph(s, d)[1], max_hops=6)


def path_lengths(s, d):
    return paths(s, d)[0].withColumn("length", F.col("length").cast("long"))


def path_links(s, d):
    """The nodes of the paths, and the relation that leads to each, in its true direction."""
    return paths(s, d)[1].withColumn("step", F.col("step").cast("long"))


PATHS = f"""WITH RECURSIVE {GRAPH},
q AS (SELECT n_nationkey AS pair_id, r_name AS user_id, lower(n_name) AS a,
  CASE n_nationkey % 3 WHEN 0 THEN 'hot plate' WHEN 1 THEN lower(n_name) ELSE 'nowhere' END AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT DISTINCT user_id, lower(node) AS node, lower(other) AS other, node AS n1, other AS n2 FROM sym),
walk AS (
  SELECT DISTINCT pair_id, q.user_id, b, n1 AS pos, 0 AS hops FROM q JOIN u ON q.user_id = u.user_id AND u.node = a
  UNION SELECT pair_id, walk.user_id, b, n2, hops + 1 FROM walk JOIN u ON walk.user_id = u.user_id AND walk.pos = u.n1 WHERE hops < 6),
f AS (SELECT pair_id, min(hops) AS length FROM walk WHERE lower(pos) = b GROUP BY pair_id)
SELECT q.pair_id, length IS NOT NULL AS found, length FROM q LEFT JOIN f ON q.pair_id = f.pair_id"""


PATH_LINKS = (
    PATHS.split("f AS (SELECT pair_id")[0]
    + """dist AS (SELECT pair_id, user_id, b, pos, min(hops) AS hops FROM walk GROUP BY pair_id, user_id, b, pos),
par AS (
  SELECT d.pair_id, d.pos AS node, min(p.pos) AS parent
  FROM dist d JOIN u ON d.user_id = u.user_id AND d.pos = u.n1 JOIN dist p ON d.pair_id = p.pair_id AND u.n2 = p.pos AND p.hops = d.hops - 1 GROUP BY d.pair_id, d.pos),
goal AS (SELECT pair_id, user_id, min(hops) AS step, arg_min(pos, ROW(hops, pos)) AS node FROM dist WHERE lower(pos) = b GROUP BY pair_id, user_id),
back AS (
  SELECT * FROM goal
  UNION ALL SELECT back.pair_id, user_id, step - 1, parent FROM back JOIN par ON back.pair_id = par.pair_id AND back.node = par.node WHERE step > 0),
link AS (SELECT * FROM sym QUALIFY row_number() OVER (PARTITION BY user_id, node, other ORDER BY weight DESC, type, NOT is_forward) = 1)
SELECT back.pair_id, step, back.node, CASE WHEN is_forward THEN link.node ELSE link.other END AS source, CASE WHEN is_forward THEN link.other ELSE link.node END AS target, type AS label, weight
FROM back LEFT JOIN par ON step > 0 AND back.pair_id = par.pair_id AND back.node = par.node
     LEFT JOIN link ON back.user_id = link.user_id AND par.parent = link.node AND back.node = link.other"""
)


def page_rank_of_pages(s, d):
    return p.pagerank(*_links(s, d)).select("id", F.round("pagerank", 6).alias("pagerank"))


PAGES = """h AS (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
k AS (SELECT 'web' AS user_id, url AS source, href AS target FROM h WHERE href IN (SELECT url FROM pages)),
v AS (SELECT DISTINCT 'web' AS user_id, url AS id FROM pages)"""


def indexed(s, d):
    """Names of suppliers in a stored index, those of other entities added, and parts of nations' numbers looked up."""
    names = graph(s, d)[0].select("user_id", F.lower("name").alias("text"), (F.col("type") == "Organization").alias("first"))
    index = TextIndex(s, new_path(s, "text-index")).add(names.where("first")).add(names.where("NOT first"))
    nation = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return index.search(nation.select(F.col("r_name").alias("user_id"), F.concat(F.lit("r#0000000"), F.col("n_nationkey") % 10).alias("needle")))


G = f"WITH {GRAPH} "
STATISTICS = """SELECT user_id, 'node_count' AS metric, NULL AS key, count(*) AS value, 1 AS rank FROM e GROUP BY user_id
UNION ALL SELECT user_id, 'link_count', NULL, count(*), 1 FROM r GROUP BY user_id
UNION ALL SELECT user_id, 'type', type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) FROM (SELECT user_id, type, count(*) AS n FROM e GROUP BY user_id, type)
UNION ALL SELECT * FROM (SELECT user_id, 'top_entity', name, degree, row_number() OVER (PARTITION BY user_id ORDER BY degree DESC, name) AS k FROM d) WHERE k <= 8
UNION ALL SELECT user_id, 'relation_type', type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) FROM (SELECT user_id, type, count(*) AS n FROM r GROUP BY user_id, type)
UNION ALL SELECT user_id, 'doc', file, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, file) FROM (SELECT user_id, file, count(*) AS n FROM (SELECT user_id, unnest(source_files) AS file FROM r) GROUP BY user_id, file)"""

QUERIES = {
    "g1_a9_upsert_entities": (entities, G + "SELECT * FROM e"),
    "g1_a8_upsert_relations": (relations, G + "SELECT user_id, source, target, type, weight, list_aggregate(source_files, 'string_agg', ',') AS source_files FROM r"),
    "g1_upsert_existing": (reupsert, G + "SELECT r.user_id, source, target, r.type, weight, list_aggregate(source_files, 'string_agg', ',') AS source_files, e.type AS source_type FROM r JOIN e ON r.user_id = e.user_id AND r.source = e.name WHERE r.user_id || source IN (SELECT user_id || source FROM r)"),
    "j1_neighbours": (neighbours, G + "SELECT user_id, node, is_forward, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM sym GROUP BY user_id, node, is_forward"),
    "a1_degree": (degrees, G + "SELECT * FROM d"),
    "a2_graph_counts": (lambda s, d: g.graph_counts(*stored_graph(s, d)), G + "SELECT user_id, (SELECT count(*) FROM e WHERE e.user_id = r.user_id) AS nodes, count(*) AS links FROM r GROUP BY user_id"),
    "a3_type_distribution": (lambda s, d: g.type_distribution(graph(s, d)[0]), G + "SELECT user_id, type, count(*) AS n FROM e GROUP BY user_id, type"),
    "a4_top_relation_types": (lambda s, d: g.top_relation_types(graph(s, d)[1], 2), G + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, type) AS rank FROM (SELECT user_id, type, count(*) AS n FROM r GROUP BY user_id, type)) WHERE rank <= 2"),
    "a5_doc_contributions": (lambda s, d: g.document_contributions(graph(s, d)[1]), G + "SELECT user_id, file, count(*) AS n FROM (SELECT user_id, unnest(source_files) AS file FROM r) GROUP BY user_id, file"),
    "a6_document_metrics": (lambda s, d: g.document_metrics(triples(s, d)), G + "SELECT c.user_id, c.source_file, entity_count, relation_count FROM (SELECT user_id, source_file, count(*) AS relation_count FROM t GROUP BY user_id, source_file) c JOIN (SELECT user_id, source_file, count(DISTINCT v) AS entity_count FROM (SELECT user_id, source_file, source AS v FROM t UNION ALL SELECT user_id, source_file, target FROM t) GROUP BY user_id, source_file) n ON c.user_id = n.user_id AND c.source_file = n.source_file"),
    "a7_document_summary": (
        lambda s, d: g.document_summary(graph(s, d)[1]),
        G
        + """, x AS (SELECT user_id, unnest(source_files) AS file, source, target, type FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, file ORDER BY source, target, type) AS rank FROM x),
n AS (SELECT user_id, file, count(DISTINCT v) AS entity_count FROM (SELECT user_id, file, source AS v FROM f WHERE rank <= 80 UNION ALL SELECT user_id, file, target FROM f WHERE rank <= 80) GROUP BY user_id, file),
c AS (SELECT user_id, file, count(*) FILTER (rank <= 80) AS relation_count, string_agg(source || ' --[' || type || ']--> ' || target, chr(10) ORDER BY rank) FILTER (rank <= 50) AS context FROM f GROUP BY user_id, file),
m AS (SELECT user_id, file, v, count(*) AS n FROM (SELECT user_id, file, source AS v FROM x UNION ALL SELECT user_id, file, target FROM x) GROUP BY user_id, file, v),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, file ORDER BY n DESC, v) AS rank FROM m),
l AS (SELECT user_id, file, string_agg(v, '|' ORDER BY rank) AS top_entities FROM b WHERE rank <= 5 GROUP BY user_id, file)
SELECT c.user_id, c.file, relation_count, context, entity_count, top_entities FROM c JOIN n ON c.user_id = n.user_id AND c.file = n.file JOIN l ON c.user_id = l.user_id AND c.file = l.file""",
    ),
    "a10_node_sources": (lambda s, d: _files(g.node_sources(graph(s, d)[1]), "files"), G + "SELECT user_id, node AS name, list_aggregate(list_sort(list(DISTINCT file)), 'string_agg', ',') AS files FROM (SELECT user_id, node, unnest(source_files) AS file FROM sym) GROUP BY user_id, node"),
    "l2_top_entities": (lambda s, d: g.top_entities(*stored_graph(s, d)), G + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY degree DESC, name) AS rank FROM d) WHERE rank <= 8"),
    "g6_graph_stats": (
        lambda s, d: g.graph_stats(*stored_graph(s, d)),
        G
        + STATISTICS,
    ),
    "g4_expand_node": (
        expand,
        f"WITH {GRAPH}, {REQ}, x AS (SELECT q.req_id, sym.*, row_number() OVER (PARTITION BY req_id ORDER BY weight DESC, other, type, is_forward DESC) AS rank FROM q JOIN sym ON q.user_id = sym.user_id AND q.name = sym.node) SELECT req_id, CASE WHEN is_forward THEN node ELSE other END AS source, CASE WHEN is_forward THEN other ELSE node END AS target, x.type AS label, weight, a.degree, other AS id, b.type AS id_type, b.degree AS other_degree FROM x JOIN d a ON x.user_id = a.user_id AND node = a.name JOIN d b ON x.user_id = b.user_id AND other = b.name WHERE rank <= 50",
    ),
    "g5_node_detail": (
        detail,
        f"WITH {GRAPH}, {REQ}, h AS (SELECT req_id, d.* FROM q JOIN d ON q.user_id = d.user_id AND lower(q.name) = lower(d.name)), c AS (SELECT req_id, name, count(*) AS relations, count(*) FILTER (is_forward) AS outgoing, CAST(sum(weight) AS BIGINT) AS weight FROM h JOIN sym ON h.user_id = sym.user_id AND h.name = node GROUP BY req_id, name), f AS (SELECT req_id, list_aggregate(list_sort(list(DISTINCT file)), 'string_agg', ',') AS files FROM (SELECT req_id, unnest(source_files) AS file FROM h JOIN sym ON h.user_id = sym.user_id AND h.name = node) GROUP BY req_id) SELECT h.req_id, h.name, type, degree, relations, outgoing, weight, files FROM h JOIN c ON h.req_id = c.req_id AND h.name = c.name JOIN f ON h.req_id = f.req_id",
    ),
    "l1_search_entities": (
        search,
        G + ", q AS (SELECT n_nationkey AS req_id, r_name AS user_id, '#' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS q FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT * FROM (SELECT req_id, name, type, degree, row_number() OVER (PARTITION BY req_id ORDER BY degree DESC, name) AS rank FROM q JOIN d ON q.user_id = d.user_id AND contains(lower(name), lower(q))) WHERE rank <= 20",
    ),
    "l1_j4_text_index": (indexed, G + ", q AS (SELECT DISTINCT r_name AS user_id, 'r#0000000' || CAST(n_nationkey % 10 AS VARCHAR) AS needle FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT DISTINCT q.user_id, needle, lower(name) AS text FROM q JOIN e ON q.user_id = e.user_id AND contains(lower(name), needle)"),
    "l3_full_graph": (full, G + "SELECT user_id, source, target, type, weight, list_aggregate(source_files, 'string_agg', ',') AS source_files, rank, count(*) OVER (PARTITION BY user_id) >= 500 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source, target, type) AS rank FROM r) WHERE rank <= 500"),
    "p2_doc_filter": (filtered, G + "SELECT user_id, type, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM r WHERE len(list_filter(source_files, lambda x: contains(x, '1995') OR contains(x, 'nation'))) > 0 GROUP BY user_id, type"),
    "p3_hide_types": (hidden, G + ", h AS (SELECT * FROM e WHERE type NOT IN ('Location', 'Person')) SELECT user_id, 'entities' AS kind, count(*) AS n FROM h GROUP BY user_id UNION ALL SELECT r.user_id, 'relations', count(*) FROM r JOIN h a ON r.user_id = a.user_id AND source = a.name JOIN h b ON r.user_id = b.user_id AND target = b.name GROUP BY r.user_id"),
    "w2_g2_dedup_mapping": (dedup_mapping, G + CANON + " SELECT user_id, name, canonical FROM w WHERE name <> canonical"),
    "g2_dedup_entities": (deduped_entities, G + CANON + " SELECT user_id, name, type FROM w WHERE name = canonical"),
    "g2_dedup_relations": (
        deduped_relations,
        G + CANON + ", y AS (SELECT r.user_id, a.canonical AS source, b.canonical AS target, r.type, weight, source_files FROM r JOIN w a ON r.user_id = a.user_id AND source = a.name JOIN w b ON r.user_id = b.user_id AND target = b.name WHERE a.canonical <> b.canonical) SELECT user_id, source, target, type, CAST(sum(weight) AS BIGINT) AS weight, list_aggregate(list_sort(list_distinct(flatten(list(source_files)))), 'string_agg', ',') AS source_files FROM y GROUP BY user_id, source, target, type",
    ),
    "g2_dedup_summary": (dedup_report, G + CANON + " SELECT user_id, count(DISTINCT canonical) AS groups, count(*) AS deleted FROM w WHERE name <> canonical GROUP BY user_id"),
    "g3_j7_delete_document": (deleted, G + ", l AS (SELECT * FROM r WHERE NOT list_has_any(source_files, ['customer', 'ship_1995'])) SELECT user_id, node AS name, 0 AS weight FROM (SELECT DISTINCT user_id, source AS node FROM l UNION SELECT DISTINCT user_id, target FROM l) UNION ALL SELECT user_id, source, CAST(sum(weight) AS BIGINT) FROM l GROUP BY user_id, source"),
    "g3_delete_document_shrink": (shrunk, G + ", l AS (SELECT user_id, source, target, type, weight, list_filter(source_files, lambda x: x NOT IN ('customer', 'ship_1995')) AS source_files FROM r) SELECT user_id, source, target, type, weight, list_aggregate(source_files, 'string_agg', ',') AS source_files FROM l WHERE len(source_files) > 0"),
    "j7_orphan_entities": (orphaned, G + "SELECT * FROM e WHERE user_id || '|' || name NOT IN (SELECT user_id || '|' || node FROM sym WHERE type <> 'LOCATED_IN')"),
    "u1_merge_graphs": (merged, G + "SELECT user_id, name, CASE type WHEN 'Organization' THEN 'Old' ELSE type END AS type FROM e WHERE type IN ('Organization', 'Location')"),
    "u2_new_nodes": (fresh, G + "SELECT * FROM e WHERE type = 'Product'"),
    "u3_distinct_names": (lambda s, d: g.distinct_names(triples(s, d)), G + "SELECT user_id, name FROM e"),
    "p8_highlight_match": (highlighted, f"WITH {GRAPH}, {REQ} SELECT DISTINCT req_id, e.name FROM q JOIN e ON q.user_id = e.user_id AND contains(lower(e.name), '#' || lower(split_part(q.name, '#', 2)))"),
    "j9_apply_types": (typed, G + "SELECT user_id, type, updated, count(*) AS n FROM (SELECT user_id, CASE WHEN regexp_matches(name, '[13579]$') THEN 'Event' ELSE type END AS type, regexp_matches(name, '[13579]$') AS updated FROM e) GROUP BY user_id, type, updated"),
    "p10_untyped_entities": (untyped, G + "SELECT * FROM (SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY name) AS rank FROM e WHERE type IN ('Organization', 'Entity')) WHERE rank <= 100"),
    "x16_x17_render_fact": (facts, G + "SELECT user_id, '[Source: ' || source_files[1] || '] ' || source || ' --[' || type || ']--> ' || target AS fact FROM r"),
    "x19_starter_questions": (starters, G + ", b AS (SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY degree DESC, name) AS k FROM d) SELECT a.user_id, 'Tell me about ' || a.name || chr(10) || 'What is the relationship between ' || a.name || ' and ' || b.name || '?' || chr(10) || 'What role does ' || c.name || ' play in this knowledge base?' || chr(10) || 'What are the most important concepts here?' AS questions FROM b a JOIN b ON a.user_id = b.user_id AND b.k = 2 JOIN b c ON a.user_id = c.user_id AND c.k = 3 WHERE a.k = 1"),
    "g8_pagerank": (ranked, _pagerank_sql(f"{GRAPH}{DIRECTED}")),
    "g9_hierarchy_levels": (levels, LEVELS),
    "g7_shortest_path": (path_lengths, PATHS),
    "g7_path_links": (path_links, PATH_LINKS),
    "g8_pagerank_pages": (page_rank_of_pages, f"SELECT id, pagerank FROM ({_pagerank_sql(PAGES)})"),
}
