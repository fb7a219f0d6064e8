"""The vulnerability graph as tables: build, neighbours, ego graph, rank, counts.

Nodes are vulnerabilities, advisories, products and weaknesses.  Edges go from advisory
to vulnerability and product, and from vulnerability to weakness, so every path has at
most two edges.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vulnloom.functions.names import normalize_name
from vulnloom.session import discard, stored

SNAPSHOT_VERSION = 3


def product_cve(mentions: DataFrame, affects: DataFrame) -> DataFrame:
    """Distinct (product, cve_id): the base of scoring, similarity and propagation."""
    # merged at every size: short files of many advisories would go through the driver
    return mentions.join(affects.hint("merge"), "dsa_id").select("product", "cve_id").distinct()


def product_cwe(pairs: DataFrame, classified: DataFrame) -> DataFrame:
    return pairs.join(classified, "cve_id").select("product", "cwe_id").distinct()


def associations(advisories: DataFrame, ids="cve_ids") -> DataFrame:
    """One row per advisory and listed vulnerability, from an id array column."""
    return advisories.select("dsa_id", F.explode(F.array_distinct(ids)).alias("cve_id"))


def filled_cves(vulnerabilities: DataFrame, mentions: DataFrame, severities=None) -> DataFrame:
    """Vulnerabilities of the graph.  A mentioned id without a record keeps empty attributes.

    With ``severities`` the records are filtered, while mentioned ids stay as placeholders.
    """
    records = vulnerabilities
    if severities:
        records = records.where(F.col("severity").isin([s.upper() for s in severities]))
    mentioned = mentions.select("cve_id").distinct().withColumn("is_mentioned", F.lit(True))
    records = records.withColumn("has_record", F.lit(True))
    return (
        records.join(mentioned, "cve_id", "full_outer")
        .withColumn("is_mentioned", F.coalesce("is_mentioned", F.lit(False)))
        .withColumn("has_record", F.coalesce("has_record", F.lit(False)))
        .withColumn("severity", F.coalesce("severity", F.lit("")))
    )


def build(vulnerabilities, advisories, mentions, affects, classified, severities=None):
    """Node and edge tables of the whole graph."""
    cves = filled_cves(vulnerabilities, mentions, severities)
    if severities:
        kept = vulnerabilities.where(F.col("severity").isin([s.upper() for s in severities])).select("cve_id")
        classified = classified.join(kept, "cve_id", "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    nodes = (
        cves.select(F.col("cve_id").alias("id"), F.lit("cve").alias("type"), F.col("cve_id").alias("label"),
                    "severity", "score", "published", none("string").alias("title"))
        .unionByName(advisories.select(
            F.col("dsa_id").alias("id"), F.lit("dsa").alias("type"), F.col("dsa_id").alias("label"),
            "severity", none("double").alias("score"), "published", "title"))
        .unionByName(affects.select("product").distinct().select(
            F.concat(F.lit("product::"), "product").alias("id"), F.lit("product").alias("type"),
            F.col("product").alias("label"), none("string").alias("severity"), none("double").alias("score"),
            none("timestamp_ntz").alias("published"), none("string").alias("title")))
        .unionByName(classified.select("cwe_id").distinct().select(
            F.col("cwe_id").alias("id"), F.lit("cwe").alias("type"), F.col("cwe_id").alias("label"),
            none("string").alias("severity"), none("double").alias("score"),
            none("timestamp_ntz").alias("published"), none("string").alias("title")))
    )
    return nodes, edges(mentions, affects, classified)


def edges(mentions, affects, classified) -> DataFrame:
    """Distinct (src, dst, relation)."""
    return edge_rows(mentions, affects, classified).distinct()


def edge_rows(mentions, affects, classified) -> DataFrame:
    """(src, dst, relation), repeated where the inputs repeat."""
    return (
        mentions.select(F.col("dsa_id").alias("src"), F.col("cve_id").alias("dst"), F.lit("mentions").alias("relation"))
        .unionByName(affects.select(
            F.col("dsa_id").alias("src"), F.concat(F.lit("product::"), "product").alias("dst"),
            F.lit("affects").alias("relation")))
        .unionByName(classified.select(
            F.col("cve_id").alias("src"), F.col("cwe_id").alias("dst"), F.lit("classified_as").alias("relation")))
    )


def new_in(snapshot: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The new edges that the snapshot does not hold, each once."""
    return new_edges.dropDuplicates(["src", "dst"]).join(snapshot.select("src", "dst"), ["src", "dst"], "left_anti").select(*snapshot.columns)


def extend(snapshot: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Edge set of a snapshot after new advisories arrived; only the new edges are compared."""
    return snapshot.unionByName(new_in(snapshot, new_edges))


def stats(nodes: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Counts per node type and relation, and the two totals."""
    by_type = nodes.rollup("type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("node").alias("kind"), F.coalesce("type", F.lit("total")).alias("name"), "n")
    by_relation = edge_table.rollup("relation").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("edge").alias("kind"), F.coalesce("relation", F.lit("total")).alias("name"), "n")
    return by_type.unionByName(by_relation)


def neighbours(edge_table: DataFrame, node: str, relation=None, direction="both") -> DataFrame:
    """Distinct neighbours of one node, optionally through one relation."""
    table = edge_table.where(F.col("relation") == relation) if relation else edge_table
    out = table.where(F.col("src") == node).select(F.col("dst").alias("id"))
    into = table.where(F.col("dst") == node).select(F.col("src").alias("id"))
    chosen = {"out": [out], "in": [into], "both": [out, into]}[direction]
    result = chosen[0] if len(chosen) == 1 else chosen[0].unionByName(chosen[1])
    return result.distinct()


def products_from_snapshot(edges_by_src: DataFrame) -> DataFrame:
    """Distinct (product, cve_id) from edges bucketed by ``src``: both edges of a path start at the advisory, so the buckets are joined as they lie."""
    mentions = edges_by_src.where("relation = 'mentions'").select("src", F.col("dst").alias("cve_id"))
    affects = edges_by_src.where("relation = 'affects'").select("src", F.expr("substring(dst, 10)").alias("product"))
    return mentions.hint("merge").join(affects, "src").select("product", "cve_id").distinct()


def neighbour_numbers(edges_by_src: DataFrame, edges_by_dst: DataFrame) -> DataFrame:
    """(id, n_neighbours) of every node, from edges bucketed by ``src`` and by ``dst``; a neighbour in both directions counts once."""
    # distinct by the bucketed end keeps its partitioning, so each side counts where it lies
    out = edges_by_src.select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()
    into = edges_by_dst.select(F.col("dst").alias("id"), F.col("src").alias("other")).distinct()
    both = out.hint("merge").join(into, ["id", "other"]).groupBy("id").agg(F.count(F.lit(1)).alias("n_both"))
    counted = out.groupBy("id").agg(F.count(F.lit(1)).alias("n_out")).hint("merge").join(
        into.groupBy("id").agg(F.count(F.lit(1)).alias("n_in")), "id", "full_outer").hint("merge").join(both, "id", "left")
    zero = F.lit(0)
    return counted.select("id", (F.coalesce("n_out", zero) + F.coalesce("n_in", zero) - F.coalesce("n_both", zero)).alias("n_neighbours"))


def ego_nodes(edge_table: DataFrame, centre: DataFrame, radius: int) -> DataFrame:
    """Nodes within ``radius`` undirected steps of the centre ids (column ``id``)."""
    both_ways = edge_table.select("src", "dst").unionByName(
        edge_table.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    known = centre.select("id").distinct()
    frontier = known
    for _ in range(radius):
        reached = (
            both_ways.join(frontier.withColumnRenamed("id", "src"), "src", "left_semi")
            .select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti"))
        frontier = stored(reached, "frontier")  # else each step would compute all earlier ones again
        known = known.unionByName(frontier)
    return known


def induced_edges(edge_table: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    return (
        edge_table.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "relation"))


def rank(nodes_cve, nodes_product, mentions, affects, classified, alpha=0.85) -> DataFrame:
    """Page rank of every node as a share of the largest, in closed form.

    All nodes receive the same teleport and dangling mass, and only the share of the
    maximum is used, so that mass is set to 1 and the two edge levels are summed once.
    The sums are stored, so that the largest is not looked for by summing again.
    Inputs must hold distinct edges.
    """
    fan_out = (
        mentions.select("dsa_id").unionByName(affects.select("dsa_id"))
        .groupBy("dsa_id").agg(F.count(F.lit(1)).alias("fan_out")))
    to_cve = (
        mentions.join(fan_out, "dsa_id").groupBy("cve_id")
        .agg((1.0 + alpha * F.sum(1.0 / F.col("fan_out"))).alias("r")))
    cve = nodes_cve.select("cve_id").join(to_cve, "cve_id", "left").select("cve_id", F.coalesce("r", F.lit(1.0)).alias("r"))
    product = nodes_product.select("product").join(
        affects.join(fan_out, "dsa_id").groupBy("product")
        .agg((1.0 + alpha * F.sum(1.0 / F.col("fan_out"))).alias("r")), "product", "left")
    weakness_count = classified.groupBy("cve_id").agg(F.count(F.lit(1)).alias("fan_out"))
    weakness = (
        classified.join(weakness_count, "cve_id").join(cve, "cve_id").groupBy("cwe_id")
        .agg((1.0 + alpha * F.sum(F.col("r") / F.col("fan_out"))).alias("r")))
    advisory = fan_out.select(F.col("dsa_id").alias("id"), F.lit("dsa").alias("type"), F.lit(1.0).alias("r"))
    table = stored(
        cve.select(F.col("cve_id").alias("id"), F.lit("cve").alias("type"), "r")
        .unionByName(product.select(F.col("product").alias("id"), F.lit("product").alias("type"),
                                    F.coalesce("r", F.lit(1.0)).alias("r")))
        .unionByName(weakness.select(F.col("cwe_id").alias("id"), F.lit("cwe").alias("type"), "r"))
        .unionByName(advisory), "ranks")
    peak = table.agg(F.max("r").alias("peak")).scalar()
    return table.select("id", "type", (F.col("r") / peak).alias("rank"))


def power_rank(edge_table: DataFrame, nodes: DataFrame, alpha=0.85, tolerance=1e-6, rounds=100) -> DataFrame:
    """(id, rank, in_degree, rounds): page rank of any directed edge table (src, dst), cycles included, by power iteration.

    ``nodes`` (id) names the nodes; ends of edges that it lacks are left out.  A repeated edge counts
    once.  The rank of nodes without outgoing edges is dealt to all.  A round's rank is a
    table in the shared folder.  It ends when the ranks moved by less than the number of nodes times
    the tolerance; when no round of ``rounds`` comes to that, the rank is the share of the
    largest in-degree and ``rounds`` is null.
    """
    known = stored(nodes.select("id").distinct(), "nodes")
    n = known.count()
    ends = stored(edge_table.select("src", "dst").distinct().join(known.select(F.col("id").alias("src")), "src", "left_semi").join(
        known.select(F.col("id").alias("dst")), "dst", "left_semi"), "ends")
    fan_out = ends.groupBy("src").agg(F.count(F.lit(1)).alias("fan_out"))
    links = stored(ends.join(fan_out, "src").select("src", "dst", (F.lit(1.0) / F.col("fan_out")).alias("share")), "links")
    sinks = known.join(fan_out.withColumnRenamed("src", "id"), "id", "left").select("id", F.col("fan_out").isNull().alias("sink"))
    current = stored(sinks.withColumn("rank", F.lit(1.0 / max(n, 1))).withColumn("moved", F.lit(None).cast("double")), "ranks")
    degrees = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    settled, lost = (None, current.where("sink").count() / n) if n else (0, 0.0)
    for turn in range(1, rounds + 1 if n else 1):
        base = (1.0 - alpha + alpha * lost) / n
        given = links.join(current.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("rank") * F.col("share")).alias("given"))
        rank_now = F.lit(base) + alpha * F.coalesce("given", F.lit(0.0))
        following = stored(current.join(given, "id", "left").select("id", "sink", rank_now.alias("rank"), F.abs(rank_now - F.col("rank")).alias("moved")), "ranks")
        discard(current)
        current = following
        state = current.agg(F.sum("moved").alias("moved"), F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)).alias("lost")).first()
        lost = state["lost"]
        if state["moved"] < n * tolerance:
            settled = turn
            break
    ranked = current.join(degrees, "id", "left").select("id", "rank", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    if settled is not None:
        return ranked.withColumn("rounds", F.lit(settled))
    most = ranked.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("most")).scalar()
    return ranked.withColumn("rank", F.col("in_degree") / most).withColumn("rounds", F.lit(None).cast("int"))


def _product_ranks(u, starts, sizes, codes, state):
    """Ranks of some products: base and what advisories (``u``) and weaknesses give them."""
    base, advisory, given = state
    sums = np.zeros(len(u))
    if len(codes):
        full = sizes > 0
        sums[full] = np.add.reduceat(given[codes], starts[full])
    return base + advisory * u + sums


def _product_columns(batch):
    """(u, first place, number and codes of the weaknesses) of a batch of products."""
    lists = batch.column("codes")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column("u").to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes, sizes, lists.flatten().to_numpy(zero_copy_only=False)


def _product_round(products: DataFrame, now, before):
    """(moved, lost, what each weakness receives) of all products between two states; one pass, nothing is shuffled but sums."""
    width = len(now[2])

    def scan(batches):
        moved, lost, received = 0.0, 0.0, np.zeros(width)
        for batch in batches:
            columns = u, starts, sizes, codes = _product_columns(batch)
            rank = _product_ranks(*columns, now)
            moved += np.abs(rank - _product_ranks(*columns, before)).sum()
            lost += rank[sizes == 0].sum()
            received += np.bincount(codes, np.repeat(rank / np.maximum(sizes, 1), sizes), width)
        yield pa.RecordBatch.from_pydict({"code": np.arange(-2, width), "value": np.concatenate([[moved, lost], received])})

    sums = np.zeros(width + 2)
    for code, value in products.select("u", "codes").mapInArrow(scan, "code long, value double").groupBy("code").agg(F.sum("value")).collect():
        sums[code + 2] = value
    return sums[0], sums[1], sums[2:]


def weakness_rank(mentions, affects, classified, product_weaknesses, alpha=0.85, tolerance=1e-6, rounds=100) -> DataFrame:
    """The rows of ``power_rank`` for the graph's edges (``edges``) and both ways between products and weaknesses.

    The rounds are those of the power iteration, but no edge moves in them.  Nothing points at
    advisories, so they all have one rank; a vulnerability's rank is a base and a multiple of what its advisories give,
    which is summed once.  Only products and weaknesses point at each other: a product is a row with its
    weaknesses, a round one pass over these rows with the ranks of the weaknesses, a catalogue of
    bounded size, which the driver holds.  Ids that are null are left out; mentions are distinct.
    """
    spark = mentions.sparkSession
    mentions, affects = mentions.dropna(), affects.dropna().distinct()
    classified, product_weaknesses = classified.dropna().distinct(), product_weaknesses.dropna()
    one = F.count(F.lit(1))
    fans = stored(mentions.groupBy("dsa_id").agg(one.alias("n")).unionByName(affects.groupBy("dsa_id").agg(one.alias("n"))).groupBy("dsa_id").agg(
        F.sum("n").alias("n")), "fans")
    share = F.sum(1.0 / F.col("n"))
    into = lambda rows, key: rows.hint("merge").join(fans, "dsa_id").groupBy(key).agg(share.alias("u"), one.alias("d"))
    zero = lambda c, kind="long": F.coalesce(c, F.lit(0).cast(kind)).alias(c)
    kinds = classified.groupBy("cve_id").agg(one.alias("k"))
    cves = stored(into(mentions, "cve_id").hint("merge").join(kinds, "cve_id", "full_outer").select("cve_id", zero("u", "double"), zero("d"), zero("k")), "cves")
    fed = classified.hint("merge").join(cves, "cve_id").groupBy("cwe_id").agg(one.alias("n"), F.sum(1 / F.col("k")).alias("a"), F.sum(F.col("u") / F.col("k")).alias("b"))
    held = product_weaknesses.groupBy("cwe_id").agg(one.alias("held"))
    catalogue = fed.join(held, "cwe_id", "full_outer").orderBy("cwe_id").select("cwe_id", zero("n"), zero("a", "double"), zero("b", "double"), zero("held")).collect()
    names = [r["cwe_id"] for r in catalogue]
    n_fed, a, b, held = (np.array([r[c] for r in catalogue], float) for c in ("n", "a", "b", "held"))
    codes = spark.createDataFrame([(name, i) for i, name in enumerate(names)], "cwe_id string, code int")
    sets = product_weaknesses.join(codes, "cwe_id").groupBy("product").agg(F.collect_list("code").alias("codes"))
    products = stored(into(affects, "product").hint("merge").join(sets, "product", "full_outer").select(
        "product", zero("u", "double"), zero("d"), F.coalesce("codes", F.array().cast("array<int>")).alias("codes")), "products")
    n_dsa = fans.count()
    n_cve, ends, given_to_ends = cves.agg(one, F.count_if(F.col("k") == 0), F.coalesce(F.sum(F.when(F.col("k") == 0, F.col("u"))), F.lit(0.0))).first()
    n = n_dsa + n_cve + products.count() + len(names)
    # (base, factor of u) of vulnerabilities, (base, factor of u, gift of each weakness) of products
    start = 1.0 / max(n, 1)
    advisory, cve, product, weakness = start, (start, 0.0), (start, 0.0, np.zeros(len(names))), np.full(len(names), start)
    settled, turn = (None, 0) if n else (0, 0)
    _, lost, received = _product_round(products, product, product)
    while settled is None and turn < rounds:
        turn += 1
        lost += ends * cve[0] + given_to_ends * cve[1] + weakness[held == 0].sum()
        base = (1.0 - alpha + alpha * lost) / n
        cve_now, product_now = (base, alpha * advisory), (base, alpha * advisory, alpha * weakness / np.maximum(held, 1))
        weakness_now = base + alpha * (a * cve[0] + b * cve[1] + received)
        moved, lost, received = _product_round(products, product_now, product)
        moved += n_dsa * abs(base - advisory) + np.abs(weakness_now - weakness).sum() + cves.agg(
            F.coalesce(F.sum(F.abs(F.lit(cve_now[0] - cve[0]) + F.lit(cve_now[1] - cve[1]) * F.col("u"))), F.lit(0.0))).first()[0]
        advisory, cve, product, weakness = base, cve_now, product_now, weakness_now
        if moved < n * tolerance:
            settled = turn

    def ranked(batches):
        for batch in batches:
            columns = _product_columns(batch)
            yield pa.RecordBatch.from_arrays([batch.column("product"), pa.array(_product_ranks(*columns, product)), pa.array(batch.column("d").to_numpy() + columns[2])],
                                             ["product", "rank", "in_degree"])

    every = (
        fans.select(F.col("dsa_id").alias("id"), F.lit(advisory).alias("rank"), F.lit(0).cast("long").alias("in_degree"))
        .unionByName(cves.select(F.col("cve_id").alias("id"), (F.lit(cve[0]) + F.lit(cve[1]) * F.col("u")).alias("rank"), F.col("d").alias("in_degree")))
        .unionByName(products.select("product", "u", "d", "codes").mapInArrow(ranked, "product string, rank double, in_degree long").select(
            F.concat(F.lit("product::"), "product").alias("id"), "rank", "in_degree"))
        .unionByName(spark.createDataFrame([(x, float(r), int(d)) for x, r, d in zip(names, weakness, n_fed + held)], "id string, rank double, in_degree long")))
    if settled is not None:
        return every.withColumn("rounds", F.lit(settled))
    most = every.agg(F.greatest(F.max("in_degree"), F.lit(1)).alias("most")).scalar()
    return every.withColumn("rank", F.col("in_degree") / most).withColumn("rounds", F.lit(None).cast("int"))


def weakness_links(product_weaknesses: DataFrame, edge_table: DataFrame) -> DataFrame:
    """(src, dst): the edges of the graph, and both ways between products and their weaknesses, so that there are cycles."""
    own = product_weaknesses.select(F.concat(F.lit("product::"), "product").alias("src"), F.col("cwe_id").alias("dst"))
    return edge_table.select("src", "dst").unionByName(own).unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def top_products(affects: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Products with the most distinct vulnerabilities; products without any count 0."""
    counts = pairs.groupBy("product").agg(F.count(F.lit(1)).alias("n_cves"))
    return (
        affects.select("product").distinct().join(counts, "product", "left")
        .select("product", F.coalesce("n_cves", F.lit(0)).alias("n_cves"))
        .orderBy(F.desc("n_cves"), "product").limit(k))


def top_weaknesses(classified: DataFrame, k: int) -> DataFrame:
    return (
        classified.groupBy("cwe_id").agg(F.count(F.lit(1)).alias("n_cves"))
        .orderBy(F.desc("n_cves"), "cwe_id").limit(k))


def product_degrees(affects: DataFrame) -> DataFrame:
    return affects.distinct().groupBy("product").agg(F.count(F.lit(1)).alias("in_degree"))


def fuzzy_products(degrees: DataFrame, text: str, limit: int = 15) -> DataFrame:
    """Products whose name holds the text, most referenced first."""
    key = (text or "").strip().lower()
    hits = degrees.where(F.contains(F.lower("product"), F.lit(key)) & F.lit(key != ""))
    return hits.orderBy(F.desc("in_degree"), "product").limit(limit)


def resolve_node(nodes: DataFrame, degrees: DataFrame, text: str) -> DataFrame:
    """The node meant by a text: exact id, product name, upper-case id, best fuzzy product."""
    wanted = F.lit(text)
    step = (
        F.when(F.col("id") == wanted, 1)
        .when(F.col("id") == F.concat(F.lit("product::"), normalize_name(wanted)), 2)
        .when(F.col("id") == F.upper(wanted), 3))
    exact = nodes.select("id", step.alias("step"), F.lit(0).cast("bigint").alias("in_degree")).where("step is not null")
    fuzzy = fuzzy_products(degrees, text, 1).select(
        F.concat(F.lit("product::"), "product").alias("id"), F.lit(4).alias("step"), "in_degree")
    return exact.unionByName(fuzzy).orderBy("step", F.desc("in_degree"), "id").limit(1).select("id", "step")


def first_product_containing(pairs: DataFrame, text: str) -> DataFrame:
    """The first product, by name, that holds the text."""
    return (
        pairs.where(F.contains(F.lower("product"), F.lit(text.lower())))
        .agg(F.min("product").alias("product")).where("product is not null"))
