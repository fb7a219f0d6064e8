"""Queries that search through an index: phrases, substrings, vectors, and a bucketed graph."""

from pyspark.sql import functions as F

from vulnloom.operators import graph, text_index, vector_index
from vulnloom.plans.core import _EDGE, _edges
from vulnloom.plans.files import _folder
from vulnloom.plans.logical_sql import sql
from vulnloom.plans.lookups import _padded
from vulnloom.plans.registry import query
from vulnloom.session import stored
from vulnloom.sinks import tables

_PHRASES = f"""SELECT item_id AS phrase_id, array_to_string(string_split(trim({_padded('text')}), ' ')[1:3], ' ') AS phrase FROM benchmark ORDER BY item_id LIMIT 20"""


@query("phrase_index_search", f"""WITH asked AS ({_PHRASES}) SELECT phrase_id, doc_id FROM asked, documents
    WHERE phrase <> '' AND contains({_padded('documents.text')}, ' ' || phrase || ' ')""")
def phrase_index_search(t):
    """Twenty phrases, the first words of benchmark items, found in all documents by word positions; a tenth of the documents is indexed twice."""
    folder, documents = _folder(t), t.table("documents")
    words = F.slice(text_index.text_words(F.col("text")), 1, 3)
    phrases = t.table("benchmark").orderBy("item_id").limit(20).select(F.col("item_id").alias("phrase_id"), F.array_join(words, " ").alias("phrase"))
    stale = documents.where("doc_id % 10 = 3").withColumn("text", F.concat_ws(" ", F.lit("an older text:"), "text", F.array_join(F.reverse(F.split("text", " ")), " ")))
    text_index.add_phrase_segment(stale, "doc_id", "text", folder, 1)
    text_index.add_phrase_segment(documents, "doc_id", "text", folder, 2)
    return text_index.search_phrases(t.spark, folder, phrases).withColumnRenamed("key", "doc_id")


@query("substring_index_search", sql("""SELECT pattern, count(*) AS n_products, min(product) AS first_product
    FROM (SELECT DISTINCT right(lower(c_name), 1 + (c_custkey % 4)::INT) AS pattern FROM customer), (SELECT DISTINCT product FROM affect)
    WHERE contains(lower(product), pattern) GROUP BY pattern""", "affect"))
def substring_index_search(t):
    """Patterns of one to four signs, the ends of customer names, and the products that hold each of them."""
    folder = _folder(t)
    patterns = t.table("customer").select(F.expr("right(lower(c_name), 1 + cast(c_custkey % 4 as int))").alias("pattern"))
    text_index.add_gram_segment(t.affects(), "product", folder, 1)
    found = text_index.search_substrings(t.spark, folder, patterns)
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_products"), F.min("key").alias("first_product"))


def _nearest_sql(measure):
    return f"""SELECT query, vec_id, round(s, 6) AS similarity, rank FROM (
        SELECT q.vec_id AS query, e.vec_id, round({measure}, 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({measure}, 9) DESC, e.vec_id) AS rank
        FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id < 200) q WHERE e.vec_id <> q.vec_id) WHERE rank <= 10"""


def _queries(t):
    return t.table("embeddings").where("vec_id < 200").select(F.col("vec_id").alias("query"), "embedding")


def _shown(found):
    return found.select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query("vectors_nearest_dot", _nearest_sql("list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"))
def vectors_nearest_dot(t):
    """The ten nearest of 200 query vectors each, exactly, in one pass over all vectors."""
    return _shown(vector_index.search_exact(t.table("embeddings"), _queries(t)))


@query("vectors_nearest_cosine", _nearest_sql("list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"))
def vectors_nearest_cosine(t):
    return _shown(vector_index.search_exact(t.table("embeddings"), _queries(t), cosine=True))


@query("vectors_in_lists", "SELECT count(*) AS n_vectors, 200 AS n_queries, 2000 AS n_found, true AS recall_reached FROM embeddings")
def vectors_in_lists(t):
    """The same search in the lists of an inverted file: vectors in lists, answers, and whether 90 % of the exact answers are among them."""
    vectors, wanted = t.table("embeddings"), _queries(t)
    centres = vector_index.fit_centres(vectors, 16, key="vec_id", cosine=True)
    lists = stored(vector_index.in_lists(vectors, centres, key="vec_id", cosine=True), "lists")
    found = stored(vector_index.search_lists(lists, wanted, centres, probes=14, cosine=True), "found")
    exact = vector_index.search_exact(vectors, wanted, cosine=True)
    hits = found.select("query", "key").join(exact, ["query", "key"]).agg(F.count(F.lit(1)).alias("n")).scalar()
    return lists.agg(F.count(F.lit(1)).alias("n_vectors")).select(
        "n_vectors", F.lit(wanted.count()).alias("n_queries"), F.lit(found.count()).cast("long").alias("n_found"), (hits >= 0.9 * exact.count()).alias("recall_reached"))


@query("bucketed_snapshot_products", sql("SELECT product, cve_id FROM product_cve", "product_cve"))
def bucketed_snapshot_products(t):
    """Products of every vulnerability, from edges bucketed by the advisory: mentions meet products where they lie."""
    table = tables.save_bucketed(_edges(t), _folder(t))
    return graph.products_from_snapshot(table)


@query("bucketed_neighbours", sql("""SELECT id, count(*) AS n_neighbours FROM (SELECT src AS id, dst FROM edge UNION SELECT dst, src FROM edge) GROUP BY id""",
    "mention", "affect", "classified", edge=_EDGE))
def bucketed_neighbours(t):
    """Number of neighbours of every node, from edges bucketed by their first and by their second node."""
    folder = _folder(t)
    rows = graph.edge_rows(t.mentions(), t.affects(), t.classified_as())
    out = tables.save_bucketed(rows, f"{folder}/out", distinct=True)
    # the edges are made once and read back for the other end
    return graph.neighbour_numbers(out, tables.save_bucketed(out, f"{folder}/in", by="dst"))
