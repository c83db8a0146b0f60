"""Hybrid retrieval for a table of questions (question_id, user_id, entities, docs, and embeddings: a vector, or null, for each of the entities)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import render_fact, trim
from lattica.operators.graph import best, both_ways
from lattica.operators.search import containing
from lattica.operators.vectors import vector_topk
from lattica.sources.shared import stored

REFUSAL = "I could not find anything about this in the knowledge base."
#: Rows kept for each question from exact names and substrings, and for each of its terms from vectors.
LIMITS = {"exact": 50, "substring": 30, "vector": 50}
ORDER = ["start", "m", "type1", "forward1", "k", "type2", "forward2"]


def match_exact(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, user_id, docs, start): entities named in the question, in any case."""
    asked = questions.select("question_id", "user_id", "docs", F.explode("entities").alias("term")).withColumn("low", F.lower("term"))
    return asked.join(entities.select("user_id", F.col("name").alias("start"), F.lower("name").alias("low")), ["user_id", "low"]).select("question_id", "user_id", "docs", "start").distinct()


def match_substring(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """The same for names that contain a term, or that a term contains; candidates come from indexes of letter triples of both."""
    asked = questions.select("question_id", "user_id", "docs", F.explode("entities").alias("term")).select("question_id", "user_id", "docs", F.lower("term").alias("low"))
    names = entities.select("user_id", F.col("name").alias("start"), F.lower("name").alias("name_low"))
    found = containing(asked, names, "low", "name_low").select("question_id", "user_id", "docs", "start")
    return found.unionByName(containing(names, asked, "name_low", "low").select("question_id", "user_id", "docs", "start")).distinct()


def _allowed(files: str):
    """A relation of the selected documents, or any if none is selected."""
    return F.coalesce(F.size("docs"), F.lit(0)).between(-1, 0) | F.exists(files, lambda f: F.exists("docs", lambda d: f.contains(d)))


#: What the rows of second hops belong to, for all questions together.
SEEN = ["picked", "user_id", "m"]


def first_hops(starts: DataFrame, sym: DataFrame, k: int, of: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """First-hop relations of each start, the k first ones of a question, or of other keys, numbered and stored.

    They come first in the order of rows, and each gives a row at least, so no later one can be shown.
    """
    one = starts.join(sym.select("user_id", F.col("node").alias("start"), F.col("other").alias("m"), F.col("type").alias("type1"), F.col("is_forward").alias("forward1"), F.col("weight").alias("weight1"), F.col("source_files").alias("files1")), ["user_id", "start"]).where(_allowed("files1") & (trim(F.col("start")) != "") & (trim(F.col("m")) != ""))
    first = [F.desc("weight1"), F.asc("start"), F.asc("m"), F.asc("type1"), F.asc("forward1")]
    picked = F.when(F.size("docs") > 0, F.xxhash64(F.array_sort("docs"))).otherwise(F.lit(0)).alias("picked")
    return stored(best(one, list(of), first, k, "first").select("*", picked), "first-hops")


def _two(sym: DataFrame) -> DataFrame:
    return sym.select("user_id", F.col("node").alias("m"), F.col("other").alias("k"), F.col("type").alias("type2"), F.col("is_forward").alias("forward2"), F.col("source_files").alias("files2"))


def _seen_from(rows: DataFrame, sym: DataFrame) -> DataFrame:
    """The second hops of the nodes that rows meet, once for all questions (once for each selection of documents)."""
    return _two(sym).join(rows.groupBy(*SEEN).agg(F.first("docs").alias("docs")), ["user_id", "m"]).where((F.col("k") != F.col("m")) & _allowed("files2")).drop("docs")


def shown(one: DataFrame, sym: DataFrame, most: Column, of: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """The first hops that have a row among the ``most`` of their key, and how many second hops each may have to look at (wanted).

    Sizes, summed up in the order of the first hops, tell; no second hop is joined but those back to the start.
    """
    sizes = _seen_from(one, sym).groupBy(*SEEN).agg(F.count("*").alias("size"))
    ends = one.where("start != m").groupBy(*SEEN, "start").agg(F.first("docs").alias("docs"))
    back = ends.join(_two(sym).withColumnRenamed("k", "start"), ["user_id", "m", "start"]).where(_allowed("files2")).groupBy(*SEEN, "start").agg(F.count("*").alias("back"))
    one = one.join(sizes, SEEN, "left").join(back, [*SEEN, "start"], "left").withColumn("back", F.coalesce("back", F.lit(0)))
    given = F.greatest(F.coalesce("size", F.lit(0)) - F.col("back"), F.lit(1))
    before = F.coalesce(F.sum(given).over(Window.partitionBy(*of).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stored(one.withColumn("wanted", most - before + F.col("back")).where(F.col("wanted") > F.col("back")).drop("size", "back", "first"), "first-hops")


def _with_second(one: DataFrame, sym: DataFrame, k: int, of: tuple[str, ...]) -> DataFrame:
    """The first hops that are shown, each with its second hops or without one, the k best rows of a key."""
    widest = one.agg(F.max("wanted")).first()[0] or 0
    leading = best(_seen_from(one, sym), SEEN, [F.asc("k"), F.asc("type2"), F.asc("forward2")], widest, "place")
    a, b = one.alias("a"), leading.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in SEEN]
    rows = a.join(b, [*same, F.col("b.k") != F.col("a.start"), F.col("b.place") <= F.col("a.wanted")], "left").select("a.*", *[f"b.{c}" for c in ("k", "type2", "forward2", "files2")]).drop("picked", "wanted")
    order = [F.desc("weight1"), *[F.asc_nulls_last(c) for c in ORDER]]
    return best(rows, list(of), order, k)


def hops(starts: DataFrame, sym: DataFrame, k: int, of: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """First-hop relations of each start, each with its second hops or without one, the k best of a question, or of other keys, by weight.

    sym holds the relations from both ends (``both_ways``). Rows are enumerated in rank order with an early stop: of the
    first hops only those that can be shown are kept, and their sizes tell how many second hops the last of them
    still has to give; nothing else is joined. The second hops of a node are ranked once for all questions that meet it
    (once for each selection of documents), and only the leading ones go on: a hub sends as many rows as a question
    can show, and those of the relations back to the start, which are left out.
    """
    return _with_second(shown(first_hops(starts, sym, k, of), sym, F.lit(k), of), sym, k, of)


def nearest_starts(questions: DataFrame, entities: DataFrame, k: int = 3) -> DataFrame:
    """(question_id, user_id, docs, term, start): the k nearest entities of each embedded term of a question, if they are its tenant's."""
    terms = questions.select("question_id", "user_id", F.posexplode("embeddings").alias("term", "embedding")).withColumn("query_id", F.struct("question_id", "term"))
    near = vector_topk(terms.where("embedding IS NOT NULL"), entities, k).select("query_id.question_id", "query_id.term", F.col("name").alias("start"))
    return near.join(questions.select("question_id", "user_id", "docs"), "question_id")


#: What has a rank and a limit of its own.
KEYS = ("question_id", "step", "term")


def _firsts(questions: DataFrame, entities: DataFrame, sym: DataFrame, k_vector: int) -> DataFrame:
    """The first hops of the steps of ``retrieve`` that can be shown, without step C for a k_vector of 0."""
    marked = lambda df, step: df.select("question_id", "user_id", "docs", "start", F.lit(step).alias("step"), F.lit(None).cast("int").alias("term"))
    exact = first_hops(marked(match_exact(questions, entities), "A"), sym, LIMITS["exact"], KEYS)
    rest = questions.join(exact.select("question_id").distinct(), "question_id", "left_anti")
    starts = marked(match_substring(rest, entities), "B")
    if k_vector and "embeddings" in questions.columns and "embedding" in entities.columns:
        starts = starts.unionByName(nearest_starts(questions, entities, k_vector).withColumn("step", F.lit("C")))
    return exact.unionByName(first_hops(starts, sym, max(LIMITS.values()), KEYS).where(F.col("first") <= _most()))


def _most() -> Column:
    """The rows that a question's step shows."""
    return F.when(F.col("step") == "A", LIMITS["exact"]).when(F.col("step") == "B", LIMITS["substring"]).otherwise(LIMITS["vector"])


def _both_ways(relations: DataFrame) -> DataFrame:
    return stored(both_ways(relations.select("user_id", "source", "target", "type", "weight", "source_files")), "both-ways")


def retrieve(questions: DataFrame, entities: DataFrame, relations: DataFrame, k_vector: int = 3, degrees: bool = True) -> DataFrame:
    """Rows (question_id, step, term, rank, start, first hop, second hop, degrees).

    A from exact names, B from substrings for questions without a row of A, C from the nearest vectors of each embedded
    term, each term with its own rank and limit; term is null in A and B. The view of the relations from both ends and the
    degrees are stored once for all steps; second hops are looked for once for all steps too. Without ``degrees`` there are none.
    """
    sym = _both_ways(relations)
    first = shown(_firsts(questions, entities, sym, k_vector), sym, _most(), KEYS)
    rows = _with_second(first, sym, max(LIMITS.values()), KEYS).where(F.col("rank") <= _most())
    if not degrees:
        return rows.drop("docs")
    known = sym.groupBy("user_id", F.col("node").alias("name")).agg(F.count("*").alias("degree"))
    rows = stored(rows, "rows")
    wanted = rows.select("user_id", F.explode(F.array("start", "m")).alias("name")).distinct()
    known = stored(known.join(wanted, ["user_id", "name"], "left_semi"), "degrees")
    for end, label in (("start", "s_deg"), ("m", "m_deg")):
        rows = rows.join(known.select("user_id", F.col("name").alias(end), F.col("degree").alias(label)), ["user_id", end], "left")
    return rows.drop("docs")


def matched_names(questions: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``matched`` of what ``retrieve`` finds, without its vectors, second hops and degrees: a first hop that is shown tells its start."""
    sym = _both_ways(relations)
    return shown(_firsts(questions, entities, sym, 0), sym, _most(), KEYS).select("question_id", F.col("start").alias("id")).distinct()


def retrieved_nodes(rows: DataFrame) -> DataFrame:
    """(question_id, id, degree): the degree of a node is that of its first row; a second hop counts 1."""
    ends = F.array(F.struct(F.col("start").alias("id"), F.col("s_deg").alias("degree"), F.lit(0).alias("role")), F.struct(F.col("m").alias("id"), F.col("m_deg").alias("degree"), F.lit(1).alias("role")), F.struct(F.col("k").alias("id"), F.lit(1).cast("long").alias("degree"), F.lit(2).alias("role")))
    seen = rows.select("question_id", "step", "term", "rank", F.explode(ends).alias("e")).where("e.id IS NOT NULL AND trim(e.id) != ''")
    return seen.groupBy("question_id", F.col("e.id").alias("id")).agg(F.min_by("e.degree", F.struct("step", "term", "rank", "e.role")).alias("degree"))


def retrieved_links(rows: DataFrame) -> DataFrame:
    """(question_id, source, target, label): each relation once, in its true direction."""
    way = lambda a, b, f, t: F.struct(F.when(F.col(f), F.col(a)).otherwise(F.col(b)).alias("source"), F.when(F.col(f), F.col(b)).otherwise(F.col(a)).alias("target"), F.col(t).alias("label"))
    return rows.select("question_id", F.explode(F.array(way("start", "m", "forward1", "type1"), way("m", "k", "forward2", "type2"))).alias("l")).select("question_id", "l.*").where("label IS NOT NULL").distinct()


def matched(rows: DataFrame) -> DataFrame:
    """(question_id, id): starts by name, not those by vectors."""
    return rows.where("step != 'C'").select("question_id", F.col("start").alias("id")).distinct()


def build_context(rows: DataFrame) -> DataFrame:
    """(question_id, context): the distinct facts of first hops, then those of second hops, in order of appearance."""
    fact = lambda a, b, f, t, files: F.when(F.col(t).isNotNull(), render_fact(F.when(F.col(f), F.col(a)).otherwise(F.col(b)), F.col(t), F.when(F.col(f), F.col(b)).otherwise(F.col(a)), F.col(files)))
    told = rows.select("question_id", F.struct("step", "term", "rank").alias("at"), F.explode(F.array(F.struct(F.lit(1).alias("hop"), fact("start", "m", "forward1", "type1", "files1").alias("fact")), F.struct(F.lit(2).alias("hop"), fact("m", "k", "forward2", "type2", "files2").alias("fact")))).alias("f")).where("f.fact IS NOT NULL")
    first = told.groupBy("question_id", "f.hop", "f.fact").agg(F.min("at").alias("at"))
    part = lambda hop: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hop") == hop, F.struct("at", "fact")))), lambda x: x["fact"]), "\n")
    parts = first.groupBy("question_id").agg(part(1).alias("direct"), part(2).alias("related"))
    section = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(f"## {title}\n"), c, F.lit("\n")))
    return parts.select("question_id", F.concat_ws("\n", section("Direct Facts", "direct"), section("Related Context", "related")).alias("context"))


def answerability(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(question_id, n_nodes, refusal): the refusal text for questions without a node."""
    counts = retrieved_nodes(rows).groupBy("question_id").agg(F.count("*").alias("n_nodes"))
    return questions.select("question_id").join(counts, "question_id", "left").select("question_id", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.when(F.col("n_nodes").isNull(), REFUSAL).alias("refusal"))
