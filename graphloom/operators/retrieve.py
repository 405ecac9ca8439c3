"""Retrieval modes over a two-layer component graph, all questions in one plan.

Tables: low (node, top, vec) are lower components with their parents, tops
(node, doc, vec) upper ones, links (top, dst) say which document an upper
component points to.  Nodes are of any type that can be ordered; structs of
document and component id work.  questions has (qid, vec), subqueries (qid,
sq_pos, vec).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..checkpoints import cut
from ..functions.vector import dot, pair_max, total
from .knn import knn, ranked

#: Lower components in which a beam is looked for, and those, for each of the beam, that are looked at first.
SEED_HITS, FEW_HITS = 2048, 16


def single_knn(questions: DataFrame, tops: DataFrame, low: DataFrame, level: str, k: int) -> DataFrame:
    """Nearest components of one level or both: (qid, level, node, score, rank)."""
    if level not in ("top", "low", "both"):
        raise ValueError(f"level is {level!r}; top, low or both are known")
    tagged = [
        df.select(F.struct(F.lit(name).alias("level"), F.col("node").alias("id")).alias("node"), "vec")
        for name, df in (("top", tops), ("low", low))
        if level in (name, "both")
    ]
    corpus = tagged[0] if len(tagged) == 1 else tagged[0].unionByName(tagged[1])
    return knn(questions, corpus, k).select("qid", "node.level", F.col("node.id").alias("node"), "score", "rank")


def topdown(questions: DataFrame, tops: DataFrame, low: DataFrame, beam: int, k: int) -> DataFrame:
    """Upper components by kNN, scored anew by their best child: (qid, node, score, rank), node the best child.

    A component without a child scores 0 and stands for itself, or keeps its own score if no
    component of the question's has a child.
    """
    found = knn(questions, tops.select("node", "vec"), beam).select("qid", F.col("node").alias("top"), F.col("score").alias("own"))
    children = low.select(F.col("top").alias("parent"), F.col("node").alias("child"), F.col("vec").alias("child_vec")).where("child_vec is not null")
    pairs = found.join(children, F.col("top") == F.col("parent"), "left").join(
        questions.select(F.col("qid").alias("q"), F.col("vec").alias("q_vec")), F.col("qid") == F.col("q")
    )
    pairs = pairs.withColumn("s", F.when(F.col("child").isNotNull(), dot("q_vec", "child_vec")))
    best = pairs.groupBy("qid", "top", "own").agg(F.max("s").alias("s"), F.min_by("child", F.struct(-F.col("s"), F.col("child"))).alias("child"))
    any_child = F.max(F.col("child").isNotNull()).over(W.partitionBy("qid"))
    best = best.withColumn("score", F.when(any_child, F.coalesce("s", F.lit(0.0))).otherwise(F.col("own")))
    return ranked(best.select("qid", F.coalesce("child", "top").alias("node"), "score"), k)


def seed_beam(questions: DataFrame, low: DataFrame, beam: int, hits: int = SEED_HITS) -> DataFrame:
    """(qid, node, rank): the first beam upper components met among the nearest lower ones.

    Most questions meet as many among their first few hits; only those that don't are searched for all hits.
    """
    corpus = low.select(F.struct("node", "top").alias("node"), "vec")
    few = min(hits, FEW_HITS * beam)
    found = knn(questions, corpus, few)
    if few < hits:
        found = cut(found.select("qid", "node", "rank"))
        met = found.groupBy("qid").agg(F.count("*").alias("n"), F.count_distinct("node.top").alias("tops"))
        rest = cut(met.where((F.col("n") == few) & (F.col("tops") < beam)).select(F.col("qid").alias("q")))
        if not rest.isEmpty():
            more = knn(questions.join(rest, F.col("qid") == F.col("q"), "left_semi"), corpus, hits).select("qid", "node", "rank")
            found = found.join(rest, F.col("qid") == F.col("q"), "left_anti").unionByName(more)
    first = found.groupBy("qid", F.col("node.top").alias("node")).agg(F.min("rank").alias("hit"))
    return ranked(first.withColumn("score", -F.col("hit")), beam).select("qid", "node", "rank")


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select("qid", F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _with_isolated(beam: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs, and beam nodes that are in none as units of one node: hi is null."""
    met = pairs.select("qid", F.explode(F.array("lo", "hi")).alias("n")).distinct().withColumnRenamed("qid", "q")
    alone = beam.join(met, (F.col("qid") == F.col("q")) & (F.col("node") == F.col("n")), "left_anti")
    lo = alone.select("qid", F.col("node").alias("lo"))
    return pairs.unionByName(lo.withColumn("hi", F.lit(None).cast(pairs.schema["hi"].dataType)))


def subgraph_one_hop(beam: DataFrame, tops: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, lo, hi): each beam node with all others of its document, and with all of the documents it links to.

    A link back to the node itself leaves the unit of the node alone.
    """
    beam = beam.select("qid", "node")
    where = tops.select(F.col("node").alias("n"), F.col("doc").alias("own_doc"))
    there = tops.select(F.col("node").alias("other"), F.col("doc").alias("other_doc"))
    placed = beam.join(where, F.col("node") == F.col("n"))
    inside = placed.join(there, F.col("own_doc") == F.col("other_doc")).where("node <> other")
    out = beam.join(links, F.col("node") == F.col("top")).join(there, F.col("dst") == F.col("other_doc"))
    pairs = _pairs(inside, "node", "other").unionByName(_pairs(out, "node", "other")).distinct()
    pairs = pairs.withColumn("hi", F.when(F.col("lo") != F.col("hi"), F.col("hi")))
    single = pairs.where("hi is null")
    return _with_isolated(beam, pairs.where("hi is not null").unionByName(single.withColumn("hi", F.col("lo")))).withColumn(
        "hi", F.when(F.col("hi") != F.col("lo"), F.col("hi"))
    )


def subgraph_zero_hop(beam: DataFrame, tops: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, lo, hi): pairs within the beam that share a document or are linked, and the beam's other nodes alone.

    The beam bounds what one question pairs.
    """
    where = tops.select(F.col("node").alias("n"), F.col("doc").alias("doc"))
    placed = beam.select("qid", "node").join(where, F.col("node") == F.col("n")).drop("n")
    other = placed.select(F.col("qid").alias("q"), F.col("node").alias("other"), F.col("doc").alias("other_doc"))
    same = placed.join(other, (F.col("qid") == F.col("q")) & (F.col("doc") == F.col("other_doc")))
    out = placed.join(links, F.col("node") == F.col("top")).join(other, (F.col("qid") == F.col("q")) & (F.col("dst") == F.col("other_doc")))
    both = _pairs(same, "node", "other").unionByName(_pairs(out, "node", "other")).where("lo <> hi").distinct()
    return _with_isolated(beam.select("qid", "node"), both)


def isolated(units: DataFrame) -> DataFrame:
    """The units of one node."""
    return units.where("hi is null").select("qid", F.col("lo").alias("node"))


def with_subqueries(questions: DataFrame, subqueries: DataFrame) -> DataFrame:
    """subqueries, with the question's own vector for questions that have none."""
    none = questions.join(subqueries.select(F.col("qid").alias("q")).distinct(), F.col("qid") == F.col("q"), "left_anti")
    return subqueries.select("qid", F.col("sq_pos").cast("int").alias("sq_pos"), "vec").unionByName(none.select("qid", F.lit(0).alias("sq_pos"), "vec"))


def node_vectors(units: DataFrame, low: DataFrame, subqueries: DataFrame) -> DataFrame:
    """(qid, node, v): for each node of the units and each sub-query, in order, the best inner product with one of its children.

    A node without a child's vector has zeros.  Each child is scored once for
    a sub-query, whatever units it is in.
    """
    nodes = units.select("qid", F.explode(F.array("lo", "hi")).alias("node")).where("node is not null").distinct()
    asked = subqueries.select(F.col("qid").alias("q"), F.col("sq_pos"), F.col("vec").alias("q_vec"))
    children = low.select(F.col("top"), F.col("vec").alias("child_vec")).where("child_vec is not null")
    reached = nodes.join(children, F.col("node") == F.col("top"), "left").drop("top")
    scored = reached.join(asked, F.col("qid") == F.col("q"))
    best = scored.groupBy("qid", "node", "sq_pos").agg(F.coalesce(F.max(dot("q_vec", "child_vec")), F.lit(0.0)).alias("m"))
    return best.groupBy("qid", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("sq_pos", "m"))), lambda x: x["m"]).alias("v"))


def unit_scores(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qid, lo, hi, score, kind): scores of nodes and edges by late interaction.

    An edge scores the sum over sub-queries of the better of its nodes; if one
    node alone scores no less, the unit is that node (lo of equals), of kind node.
    """
    a = vectors.select(F.col("qid").alias("qa"), F.col("node").alias("na"), F.col("v").alias("va"))
    b = vectors.select(F.col("qid").alias("qb"), F.col("node").alias("nb"), F.col("v").alias("vb"))
    both = units.join(a, (F.col("qid") == F.col("qa")) & (F.col("lo") == F.col("na"))).join(
        b, (F.col("qid") == F.col("qb")) & (F.col("hi") == F.col("nb")), "left"
    )
    both = both.select("qid", "lo", "hi", total("va").alias("sa"), F.when(F.col("hi").isNotNull(), total("vb")).alias("sb"), F.when(F.col("hi").isNotNull(), total(pair_max("va", "vb"))).alias("edge"))
    single = F.col("hi").isNull() | (F.greatest("sa", "sb") >= F.col("edge"))
    a_wins = F.col("hi").isNull() | (F.col("sa") >= F.col("sb"))
    none = F.lit(None).cast(units.schema["hi"].dataType)
    return both.select(
        "qid",
        F.when(~single | a_wins, F.col("lo")).otherwise(F.col("hi")).alias("lo"),
        F.when(single, none).otherwise(F.col("hi")).alias("hi"),
        F.when(single, F.when(a_wins, F.col("sa")).otherwise(F.col("sb"))).otherwise(F.col("edge")).alias("score"),
        F.when(single, "node").otherwise("edge").alias("kind"),
    )


def rank_units(scored: DataFrame, questions: DataFrame, tops: DataFrame, k: int) -> DataFrame:
    """(qid, rank, node_a, node_b, score, kind): distinct units by score, with the node nearer to the question first."""
    best = scored.groupBy("qid", "lo", "hi", "kind").agg(F.max("score").alias("score"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "lo", F.asc_nulls_first("hi"))
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    asked = questions.select(F.col("qid").alias("q"), F.col("vec").alias("q_vec"))
    a = tops.select(F.col("node").alias("na"), F.col("vec").alias("va"))
    b = tops.select(F.col("node").alias("nb"), F.col("vec").alias("vb"))
    rows = best.join(asked, F.col("qid") == F.col("q")).join(a, F.col("lo") == F.col("na"), "left").join(b, F.col("hi") == F.col("nb"), "left")
    near = lambda v: F.coalesce(F.when(F.col(v).isNotNull(), dot("q_vec", v)), F.lit(0.0))
    swap = F.col("hi").isNotNull() & (near("vb") > near("va"))
    return rows.select(
        "qid", "rank", F.when(swap, F.col("hi")).otherwise(F.col("lo")).alias("node_a"), F.when(swap, F.col("lo")).otherwise(F.col("hi")).alias("node_b"), "score", "kind"
    )


def _round(beam: DataFrame, questions: DataFrame, subqueries: DataFrame, tops: DataFrame, low: DataFrame, links: DataFrame, hop: str, k: int) -> DataFrame:
    if hop not in ("0_hop", "1_hop"):
        raise ValueError(f"hop is {hop!r}; 0_hop or 1_hop are known")
    # The beam, the units and their nodes' vectors are each read several times.
    units = cut((subgraph_one_hop if hop == "1_hop" else subgraph_zero_hop)(cut(beam), tops, links))
    vectors = cut(node_vectors(units, low, with_subqueries(questions, subqueries)))
    return rank_units(unit_scores(units, vectors), questions, tops, k)


def late_interaction(questions, subqueries, tops, low, links, beam: int = 30, k: int = 100, hop: str = "1_hop") -> DataFrame:
    """One round: seed beam, subgraph, scores, the k best units."""
    return _round(seed_beam(questions, low, beam), questions, subqueries, tops, low, links, hop, k)


def next_beam(ranked_units: DataFrame, beam: int) -> DataFrame:
    """The first beam distinct nodes in the order of ranked units."""
    seen = ranked_units.select("qid", "rank", F.posexplode(F.array("node_a", "node_b")).alias("pos", "node")).where("node is not null")
    first = seen.groupBy("qid", "node").agg(F.min(F.struct("rank", "pos")).alias("first"))
    w = W.partitionBy("qid").orderBy("first")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beam).select("qid", "node", "rank")


def iterative_late_interaction(questions, subqueries, tops, low, links, beam: int = 30, k: int = 100, iterations: int = 1) -> DataFrame:
    """Rounds over one-hop subgraphs, each from the best nodes of the one before; the last round's units are returned."""
    if iterations < 1:
        raise ValueError("at least one iteration is needed")
    nodes = seed_beam(questions, low, beam)
    for _ in range(iterations - 1):
        nodes = cut(next_beam(_round(nodes, questions, subqueries, tops, low, links, "1_hop", k), beam))
    return _round(nodes, questions, subqueries, tops, low, links, "1_hop", k)


def beam_paths(questions, subqueries, low: DataFrame, neighbours: DataFrame, beam: int) -> DataFrame:
    """(qid, path, score, rank): paths of lower components, one for each sub-query, by the sum of their inner products.

    The first sub-query finds the start; each next one extends every path by
    all neighbours (node, near) of its end, and the best beam paths stay.  A
    question's paths end early if none can be extended.  The number of rounds is that of
    sub-queries of the question that has most.
    """
    asked = with_subqueries(questions, subqueries)
    last = asked.agg(F.max("sq_pos")).first()[0]
    if last is None:
        return knn(questions, low, 0).select("qid", F.array("node").alias("path"), "score", "rank")
    first = asked.where("sq_pos = 0").select("qid", "vec")
    paths = knn(first, low.select("node", "vec"), beam).select("qid", F.array("node").alias("path"), "score", "rank")
    vecs = low.select(F.col("node").alias("next"), F.col("vec").alias("next_vec")).where("next_vec is not null")
    near = neighbours.select(F.col("node").alias("from"), F.col("near").alias("to"))
    w = W.partitionBy("qid").orderBy("ended", F.desc("score"), "path")
    for step in range(1, last + 1):
        paths = cut(paths)
        q = asked.where(F.col("sq_pos") == step).select(F.col("qid").alias("q"), F.col("vec").alias("q_vec"))
        longer = (
            paths.join(q, F.col("qid") == F.col("q"))
            .join(near, F.element_at("path", -1) == F.col("from"))
            .join(vecs, F.col("to") == F.col("next"))
            .select("qid", F.concat("path", F.array("next")).alias("path"), (F.col("score") + dot("q_vec", "next_vec")).alias("score"), F.lit(0).alias("ended"))
        )
        # A question's paths as they are count only if none of them could be made longer.
        both = longer.unionByName(paths.select("qid", "path", "score", F.lit(1).alias("ended")))
        best = both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= beam)
        best = best.withColumn("least", F.min("ended").over(W.partitionBy("qid")))
        paths = best.where("ended = least").select("qid", "path", "score", "rank")
    return paths


MODES = ("single_knn", "single_topdown", "late_interaction", "iterative_late_interaction", "decomposed_topdown")


def retrieve(questions, subqueries, tops, low, links, mode: str = "iterative_late_interaction", k: int = 100, beam: int = 30, iterations: int = 1, hop: str = "1_hop", level: str = "top", neighbours=None) -> DataFrame:
    """One entry to all modes; parameters that a mode doesn't have are ignored."""
    if mode == "single_knn":
        return single_knn(questions, tops, low, level, k)
    if mode == "single_topdown":
        return topdown(questions, tops, low, beam, k)
    if mode == "late_interaction":
        return late_interaction(questions, subqueries, tops, low, links, beam, k, hop)
    if mode == "iterative_late_interaction":
        return iterative_late_interaction(questions, subqueries, tops, low, links, beam, k, iterations)
    if mode == "decomposed_topdown":
        return beam_paths(questions, subqueries, low, neighbours, beam)
    raise ValueError(f"mode is {mode!r}; known are {', '.join(MODES)}")


def run_name(model: str, mode: str, k: int = 100, beam: int = 30, iterations: int = 1, hop: str = "1_hop", level: str = "top") -> str:
    """The name of a run's folder: model, mode and the parameters that the mode has."""
    parts = {"single_knn": f"k{k}_{level}", "single_topdown": f"k{k}_bw{beam}", "late_interaction": f"k{k}_bw{beam}_{hop}", "iterative_late_interaction": f"k{k}_bw{beam}_ni{iterations}"}
    return f"{model}_{mode}_{parts.get(mode, 'defaultparams')}"
