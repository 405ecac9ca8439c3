"""Queries over the vector graph, with their SQL.  Beam 5 and ten results, as the tables are small."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..checkpoints import cut
from ..operators import graph as G
from ..operators import retrieve as R
from ..sources import vectors

BEAM, K = 5, 10


def _knn(level):
    def query(spark, sf_dir):
        g = vectors.load(spark, sf_dir)
        return R.single_knn(g.questions, g.tops, g.low, level, K)

    return query


def knn_topk(spark, sf_dir):
    return _knn("low")(spark, sf_dir).drop("level")


def topdown_rerank(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return R.topdown(g.questions, g.tops, g.low, BEAM, K)


def seed_beam(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return R.seed_beam(g.questions, g.low, BEAM)


def _beam(g):
    return cut(R.seed_beam(g.questions, g.low, BEAM))


def subgraph_1hop(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return R.subgraph_one_hop(_beam(g), g.tops, g.links)


def subgraph_0hop(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return R.subgraph_zero_hop(_beam(g), g.tops, g.links)


def isolated_nodes(spark, sf_dir):
    return R.isolated(subgraph_0hop(spark, sf_dir))


def subgraph_nodes(spark, sf_dir):
    """Distinct nodes of a subgraph, with the number of units they are in."""
    units = subgraph_1hop(spark, sf_dir)
    return units.select("qid", F.explode(F.array("lo", "hi")).alias("node")).where("node is not null").groupBy("qid", "node").agg(F.count("*").alias("units"))


def _vectors(g):
    units = cut(R.subgraph_one_hop(_beam(g), g.tops, g.links))
    return units, R.node_vectors(units, g.low, R.with_subqueries(g.questions, g.subqueries))


def node_maxsim(spark, sf_dir):
    _, v = _vectors(vectors.load(spark, sf_dir))
    return v.select("qid", "node", F.posexplode("v").alias("sq_pos", "m"))


def _scored(spark, sf_dir):
    units, v = _vectors(vectors.load(spark, sf_dir))
    return R.unit_scores(units, v)


def edge_late_interaction(spark, sf_dir):
    return _scored(spark, sf_dir).where("kind = 'edge'").drop("kind")


def edge_collapse(spark, sf_dir):
    return _scored(spark, sf_dir).where("kind = 'node'").select("qid", F.col("lo").alias("node"), "score").distinct()


def late_interaction_topk(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return R.late_interaction(g.questions, g.subqueries, g.tops, g.low, g.links, BEAM, K)


def late_interaction_0hop(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return R.late_interaction(g.questions, g.subqueries, g.tops, g.low, g.links, BEAM, K, "0_hop")


def iterative_late_interaction(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return R.iterative_late_interaction(g.questions, g.subqueries, g.tops, g.low, g.links, BEAM, K, iterations=2)


def _neighbours(g):
    docs = g.tops.select(F.col("node").alias("t"), "doc")
    placed = g.low.select("node", "top").join(docs, F.col("top") == F.col("t")).select("node", "top", "doc")
    return G.low_neighbours(placed, g.links)


def low_neighbours(spark, sf_dir):
    return _neighbours(vectors.load(spark, sf_dir))


def beam_paths(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    found = R.beam_paths(g.questions, g.subqueries, g.low, _neighbours(g), BEAM)
    return found.select("qid", "rank", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "score")


def intra_edges(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return G.intra_edges(g.low.select(F.expr("top div 4").alias("doc"), "top", F.col("node").alias("cid")))


def inter_edges(spark, sf_dir):
    g = vectors.load(spark, sf_dir)
    return g.links.select("top", "dst").distinct()


def component_stats(spark, sf_dir):
    """Components by level and in all, with the mean for a document."""
    g = vectors.load(spark, sf_dir)
    both = g.tops.select(F.lit("top").alias("level"), "doc").unionByName(g.low.select(F.lit("low").alias("level"), F.expr("top div 4").alias("doc")))
    return both.rollup("level").agg(F.count("*").alias("n"), (F.count("*") / F.count_distinct("doc")).alias("per_doc")).select(F.coalesce("level", F.lit("all")).alias("level"), "n", "per_doc")


def edge_stats_by_modality(spark, sf_dir):
    """Edges within documents by the modality that a component's number gives it."""
    named = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("top") % 3 + 1).cast("int"))
    inside = intra_edges(spark, sf_dir).select(named.alias("modality"), F.lit("intra").alias("kind"))
    out = inter_edges(spark, sf_dir).select(named.alias("modality"), F.lit("inter").alias("kind"))
    return inside.unionByName(out).groupBy("modality", "kind").agg(F.count("*").alias("n"))


def shard_offsets(spark, sf_dir):
    """Row offsets of vector shards (labels) put one after the other."""
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    sizes = emb.groupBy(F.col("label").cast("bigint").alias("shard")).agg(F.count("*").alias("n"))
    w = W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row for each shard only
    return sizes.withColumn("first_row", F.sum("n").over(w) - F.col("n"))


_G = """
with emb as (select vec_id as node, vec_id // 5 as top, vec_id // 20 as doc, embedding::double[] as vec, label from embeddings),
tops as (select top as node, doc, vec from emb where node % 5 = 0),
links as (select node as top, (node * 7 + 3) % (select max(doc) + 1 from emb) as dst from tops where node % 3 = 0),
q as (select node as qid, vec from emb where node % 25 = 0),
sq as (select q.qid, s.sq_pos, e.vec from q, (values (0), (1), (2)) s(sq_pos), emb e where e.node = (q.qid + 11 * s.sq_pos) % (select count(*) from emb))"""
_RANK = "row_number() over (partition by qid order by score desc, {})::int as rank"


def _seed(name="beam", source=""):
    return f""",
hits as (select qid, node, top, list_inner_product(q.vec, emb.vec) as score from q, emb),
cut as (select qid, top, row_number() over (partition by qid order by score desc, node, top) as hit from hits qualify hit <= 2048),
{name} as (select qid, top as node, row_number() over (partition by qid order by min(hit), top)::int as rank from cut group by qid, top qualify rank <= {BEAM})"""


def _one_hop(beam="beam", to="units"):
    return f""",
{to}_p as (select distinct qid, least(node, other) as lo, nullif(greatest(node, other), least(node, other)) as hi from (
    select b.qid, b.node, o.node as other from {beam} b join tops t on t.node = b.node join tops o on o.doc = t.doc and o.node <> b.node
    union all select b.qid, b.node, o.node from {beam} b join links l on l.top = b.node join tops o on o.doc = l.dst)),
{to} as (select * from {to}_p union all select qid, node, null from {beam} b
    where not exists (select 1 from {to}_p p where p.qid = b.qid and (p.lo = b.node or p.hi = b.node)))"""


_ZERO = """,
pz as (select distinct qid, least(node, other) as lo, greatest(node, other) as hi from (
    select a.qid, a.node, b.node as other from beam a join tops s on s.node = a.node join beam b on b.qid = a.qid and b.node <> a.node join tops t on t.node = b.node
    where t.doc = s.doc or exists (select 1 from links l where l.top = a.node and l.dst = t.doc))),
units as (select * from pz union all select qid, node, null from beam b where not exists (select 1 from pz p where p.qid = b.qid and (p.lo = b.node or p.hi = b.node)))"""


def _scores(units="units", tag=""):
    return f""",
nodes{tag} as (select distinct qid, unnest([lo, hi]) as node from {units}),
best{tag} as (select n.qid, n.node, sq.sq_pos, max(list_inner_product(sq.vec, e.vec)) as m from nodes{tag} n join sq on sq.qid = n.qid join emb e on e.top = n.node group by all),
vec{tag} as (select qid, node, list(m order by sq_pos) as v from best{tag} group by all),
duo{tag} as (select u.qid, u.lo, u.hi, a.v[1] + a.v[2] + a.v[3] as sa, b.v[1] + b.v[2] + b.v[3] as sb,
    greatest(a.v[1], b.v[1]) + greatest(a.v[2], b.v[2]) + greatest(a.v[3], b.v[3]) as edge
    from {units} u join vec{tag} a on a.qid = u.qid and a.node = u.lo left join vec{tag} b on b.qid = u.qid and b.node = u.hi),
scored{tag} as (select qid, case when hi is null or not single or sa >= sb then lo else hi end as lo, case when hi is null or single then null else hi end as hi,
    case when hi is null then sa when not single then edge when sa >= sb then sa else sb end as score, case when hi is null or single then 'node' else 'edge' end as kind
    from (select *, greatest(sa, sb) >= edge as single from duo{tag}))"""


def _ranked(tag=""):
    return f""",
top{tag} as (select *, row_number() over (partition by qid order by score desc, lo, hi nulls first)::int as rank from (select distinct qid, lo, hi, score, kind from scored{tag}) qualify rank <= {K}),
near{tag} as (select t.*, list_inner_product(q.vec, a.vec) as ra, coalesce(list_inner_product(q.vec, b.vec), 0.0) as rb from top{tag} t
    join q on q.qid = t.qid join tops a on a.node = t.lo left join tops b on b.node = t.hi),
final{tag} as (select qid, rank, case when hi is not null and rb > ra then hi else lo end as node_a, case when hi is not null and rb > ra then lo else hi end as node_b, score, kind from near{tag})"""


def _both_levels(level):
    parts = []
    if level in ("top", "both"):
        parts.append("select 'top' as level, node, vec from tops")
    if level in ("low", "both"):
        parts.append("select 'low', node, vec from emb")
    return f"{_G}, c(level, node, vec) as ({' union all '.join(parts)}) select qid, level, c.node, list_inner_product(q.vec, c.vec) as score, {_RANK.format('level, c.node')} from q, c qualify rank <= {K}"


_NEAR = """,
placed as (select node, top, doc from emb),
near as (select a.node, b.node as near from placed a join placed b on a.doc = b.doc and a.node <> b.node
    union select a.node, b.node from placed a join links l on l.top = a.top join placed b on b.doc = l.dst)"""
_STEP = """,
s{i} as (select p.qid, p.path || [n.near] as path, p.score + list_inner_product(sq.vec, e.vec) as score, row_number() over (partition by p.qid order by p.score + list_inner_product(sq.vec, e.vec) desc, p.path || [n.near])::int as rk{i}
    from s{p} p join sq on sq.qid = p.qid and sq.sq_pos = {i} join near n on n.node = p.path[-1] join emb e on e.node = n.near qualify rk{i} <= {b})"""

QUERIES = {
    "knn_topk": knn_topk,
    "knn_top_level": _knn("top"),
    "knn_both": _knn("both"),
    "topdown_rerank": topdown_rerank,
    "seed_beam": seed_beam,
    "subgraph_0hop": subgraph_0hop,
    "subgraph_1hop": subgraph_1hop,
    "subgraph_nodes": subgraph_nodes,
    "isolated_nodes": isolated_nodes,
    "node_maxsim": node_maxsim,
    "edge_late_interaction": edge_late_interaction,
    "edge_collapse": edge_collapse,
    "late_interaction_topk": late_interaction_topk,
    "late_interaction_0hop": late_interaction_0hop,
    "iterative_late_interaction": iterative_late_interaction,
    "low_neighbours": low_neighbours,
    "beam_paths": beam_paths,
    "intra_edges": intra_edges,
    "inter_edges": inter_edges,
    "component_stats": component_stats,
    "edge_stats_by_modality": edge_stats_by_modality,
    "shard_offsets": shard_offsets,
}

_INTRA = "select a.doc, a.top, a.node as cid, b.node as other from emb a join emb b on a.top = b.top and a.node <> b.node"
ORACLES = {
    "knn_topk": f"{_G} select qid, node, list_inner_product(q.vec, emb.vec) as score, {_RANK.format('node')} from q, emb qualify rank <= {K}",
    "knn_top_level": _both_levels("top"),
    "knn_both": _both_levels("both"),
    "topdown_rerank": f"""{_G}, found as (select qid, q.vec, tops.node, row_number() over (partition by qid order by list_inner_product(q.vec, tops.vec) desc, tops.node) as r from q, tops qualify r <= {BEAM}),
c as (select qid, found.node as top, emb.node, list_inner_product(found.vec, emb.vec) as s from found join emb on emb.top = found.node),
b as (select qid, top, node, s from c qualify row_number() over (partition by qid, top order by s desc, node) = 1)
select qid, node, s as score, row_number() over (partition by qid order by s desc, node)::int as rank from b qualify rank <= {K}""",
    "seed_beam": f"{_G}{_seed()} select * from beam",
    "subgraph_0hop": f"{_G}{_seed()}{_ZERO} select * from units",
    "subgraph_1hop": f"{_G}{_seed()}{_one_hop()} select * from units",
    "subgraph_nodes": f"{_G}{_seed()}{_one_hop()} select qid, node, count(*) as units from (select qid, unnest([lo, hi]) as node from units) where node is not null group by all",
    "isolated_nodes": f"{_G}{_seed()}{_ZERO} select qid, lo as node from units where hi is null",
    "node_maxsim": f"{_G}{_seed()}{_one_hop()}{_scores()} select qid, node, sq_pos, m from best",
    "edge_late_interaction": f"{_G}{_seed()}{_one_hop()}{_scores()} select qid, lo, hi, score from scored where kind = 'edge'",
    "edge_collapse": f"{_G}{_seed()}{_one_hop()}{_scores()} select distinct qid, lo as node, score from scored where kind = 'node'",
    "late_interaction_topk": f"{_G}{_seed()}{_one_hop()}{_scores()}{_ranked()} select * from final",
    "late_interaction_0hop": f"{_G}{_seed()}{_ZERO}{_scores()}{_ranked()} select * from final",
    "iterative_late_interaction": f"""{_G}{_seed()}{_one_hop()}{_scores()}{_ranked()},
flat as (select qid, rank, unnest([node_a, node_b]) as node, unnest([0, 1]) as pos from final),
beam2 as (select qid, node, row_number() over (partition by qid order by min(rank * 2 + pos)) as rk from flat where node is not null group by qid, node qualify rk <= {BEAM})
{_one_hop("beam2", "units2")}{_scores("units2", "_2")}{_ranked("_2")} select * from final_2""",
    "low_neighbours": f"{_G}{_NEAR} select * from near",
    "beam_paths": f"""{_G}{_NEAR}, s0 as (select sq.qid, [emb.node] as path, list_inner_product(sq.vec, emb.vec) as score, row_number() over (partition by sq.qid order by list_inner_product(sq.vec, emb.vec) desc, emb.node)::int as rk
    from sq, emb where sq_pos = 0 qualify rk <= {BEAM}){_STEP.format(i=1, p=0, b=BEAM)}{_STEP.format(i=2, p=1, b=BEAM)}
select qid, rk2 as rank, array_to_string(path, '>') as path, score from s2""",
    "intra_edges": f"{_G} {_INTRA}",
    "inter_edges": f"{_G} select distinct top, dst from links",
    "component_stats": f"{_G}, b as (select 'top' as level, doc from tops union all select 'low', doc from emb) select coalesce(level, 'all') as level, count(*) as n, count(*) / count(distinct doc) as per_doc from b group by rollup(level)",
    "edge_stats_by_modality": f"{_G}, e as ({_INTRA}), k as (select top, 'intra' as kind from e union all select top, 'inter' from (select distinct top, dst from links)) select ['text', 'table', 'image'][top % 3 + 1] as modality, kind, count(*) as n from k group by all",
    "shard_offsets": "select shard, n, (sum(n) over (order by shard) - n)::bigint as first_row from (select label::bigint as shard, count(*) as n from embeddings group by all)",
}
