"""Lookups, joins, aggregations and graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoweave import functions as X
from mnemoweave.operators import aggregates as A
from mnemoweave.operators import lookups as L
from mnemoweave.operators import relations as R
from mnemoweave.plans import ranking, traversal
from mnemoweave.testviews import SQL, graph

A_PART, B_PART, DOC, ORDER = "p1", "p7", "cust-37", "7"
START, END = 820454400, 852076800  # 1996
QUERIES: dict = {}


def _add(name, plan, sql, prelude=True):
    QUERIES[name] = (lambda spark, sf_dir: plan(graph(spark, sf_dir)), (SQL + sql if prelude else sql) if sql else None)


CHUNK = ["id", "source_document", "timestamp", "chunk_type", "memory_category", "text"]
CHUNK_SQL = 'id, source_document, "timestamp", chunk_type, memory_category, text'
TAGGED = "id IN (SELECT chunk_id FROM tags WHERE tag = '{}')"

# lookups
_add("f1_get_entity", lambda g: L.entity(g, A_PART).select("id", "canonical_name", "entity_type", "access_count", "updated_at"), f"SELECT id, canonical_name, entity_type, access_count, updated_at FROM entities WHERE id = '{A_PART}'")
_add("f2_get_chunk", lambda g: L.chunk(g, ORDER).select(*CHUNK), f"SELECT {CHUNK_SQL} FROM chunks WHERE id = '{ORDER}'")
_add("f3_chunks_by_document", lambda g: L.chunks_by_document(g, DOC).select(*CHUNK), f"SELECT {CHUNK_SQL} FROM chunks WHERE source_document = '{DOC}'")
_add("f4_time_window", lambda g: L.chunks_in_window(g, START, END).select(*CHUNK), f'SELECT {CHUNK_SQL} FROM chunks WHERE "timestamp" BETWEEN {START} AND {END}')
_add("f4_time_window_until", lambda g: L.chunks_in_window(g, None, START).select(*CHUNK), f'SELECT {CHUNK_SQL} FROM chunks WHERE "timestamp" <= {START}')
_add("f4_time_window_open", lambda g: L.chunks_in_window(g).select(*CHUNK), f'SELECT {CHUNK_SQL} FROM chunks WHERE "timestamp" IS NOT NULL')
_add("f5_entities_by_project", lambda g: L.entities_by_project(g, "size-3").select("id"), "SELECT id FROM entities WHERE project = 'size-3'")
_add(
    "f6_search_entities", lambda g: L.search_entities(g, "BRAND#1", 50).select("id", "canonical_name", "priority"),
    "SELECT id, canonical_name, CASE WHEN contains(lower(canonical_name), 'brand#1') THEN 0 ELSE 1 END AS priority FROM entities WHERE contains(lower(canonical_name), 'brand#1') OR contains(lower(alias), 'brand#1') ORDER BY priority, canonical_name, id LIMIT 50",
)
_add(
    "f7_lookup_by_name", lambda g: L.lookup_by_name(g, "Brand#12").select("id", "kind"),
    "SELECT id, kind FROM (SELECT *, rank() OVER (ORDER BY kind DESC) AS r FROM (SELECT id, 'name' AS kind FROM entities WHERE lower(canonical_name) = 'brand#12' UNION ALL SELECT id, 'alias' FROM entities WHERE lower(alias) = 'brand#12')) WHERE r = 1",
)
_add("f8_lookup_by_document", lambda g: L.lookup_by_document(g, DOC).select("id"), f"SELECT id FROM entities WHERE id IN (SELECT entity_id FROM entity_documents WHERE document = '{DOC}')")
_add("f9_lookup_by_type", lambda g: L.lookup_by_type(g, "PROMO").select("id", "canonical_name"), "SELECT id, canonical_name FROM entities WHERE entity_type = 'PROMO'")
_add("f10_resolve_entity", lambda g: L.resolve(g, A_PART).select("id", "canonical_name"), f"SELECT id, canonical_name FROM entities WHERE id = '{A_PART}'")
_add("f11_all_entity_ids", lambda g: L.all_entity_ids(g), "SELECT id FROM entities")
_add("f12_document_hashes", lambda g: g.document_hashes, "SELECT DISTINCT source_document AS document, sha256(source_document) AS sha256 FROM chunks")
_add(
    "f13_key_entities", lambda g: L.key_entities(g.entities.withColumn("rank", F.col("access_count").cast("double")), "STANDARD", 10).select("id", "rank"),
    "SELECT id, CAST(access_count AS DOUBLE) AS rank FROM entities WHERE entity_type = 'STANDARD' ORDER BY rank DESC, id LIMIT 10",
)
_add(
    "f14_search_by_source", lambda g: L.search_by_source(g, DOC)[1],
    f"SELECT e.id, e.canonical_name, e.entity_type, count(DISTINCT t.chunk_id) AS chunks FROM tags t JOIN chunks c ON c.id = t.chunk_id JOIN entities e ON e.id = t.tag WHERE c.source_document = '{DOC}' GROUP BY ALL",
)
_add("f17_keyword_hits", lambda g: g.chunks.select("id", L.keyword_hits(F.col("text"), F.array(F.lit("URGENT"), F.lit("order"), F.lit("37"))).alias("hits")), "SELECT id, CAST(contains(lower(text), 'urgent') AS INT) + CAST(contains(lower(text), 'order') AS INT) + CAST(contains(lower(text), '37') AS INT) AS hits FROM chunks")
_add(
    "f23_consistency", lambda g: g.mentions.join(g.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(F.lit("entity").alias("missing"), F.col("entity_id").alias("id")).unionByName(g.mentions.join(g.chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select(F.lit("chunk").alias("missing"), F.col("chunk_id").alias("id"))),
    "SELECT 'entity' AS missing, entity_id AS id FROM mentions WHERE entity_id NOT IN (SELECT id FROM entities) UNION ALL SELECT 'chunk', chunk_id FROM mentions WHERE chunk_id NOT IN (SELECT id FROM chunks)",
)

# joins
_add("j1_cooccurrences", lambda g: R.neighbours(g, A_PART).select("src", "neighbor_id", "chunk_id", "weight"), f"SELECT src, dst AS neighbor_id, chunk_id, weight FROM edges WHERE src = '{A_PART}'")
_add(
    "j2_cooccurrences_agg", lambda g: R.neighbour_counts(g, A_PART),
    f'SELECT e.id, e.canonical_name, e.entity_type, count(*) AS "count", max(d."timestamp") AS latest FROM edges d JOIN entities e ON e.id = d.dst WHERE d.src = \'{A_PART}\' GROUP BY ALL',
)
_add("j3_chunks_for_entities", lambda g: R.chunks_of_entities(g, [A_PART, B_PART]).select(*CHUNK), f"SELECT {CHUNK_SQL} FROM chunks WHERE {TAGGED.format(A_PART)} OR {TAGGED.format(B_PART)}")
_add(
    "j4_evidence", lambda g: R.evidence(g, A_PART, B_PART).select(*CHUNK),
    f'SELECT {CHUNK_SQL} FROM chunks WHERE {TAGGED.format(A_PART)} AND {TAGGED.format(B_PART)} ORDER BY coalesce("timestamp", 0) DESC, id LIMIT 15',
)
_add("j5_generate_cooccurrences", lambda g: g.edges.select("src", "dst", "chunk_id", "weight"), "SELECT src, dst, chunk_id, weight FROM edges")
_add("j6_temporal_chain", lambda g: R.temporal_chain(g, A_PART).select("id", "at"), f"SELECT id, coalesce(\"timestamp\", created_at) AS at FROM chunks WHERE id IN (SELECT chunk_id FROM mentions WHERE entity_id = '{A_PART}')")
_HOPS = "WITH RECURSIVE " + SQL.removeprefix("WITH ") + ", hop AS (SELECT '{start}' AS id, 0 AS hop UNION SELECT d.dst, hop.hop + 1 FROM hop JOIN edges d ON d.src = hop.id WHERE hop.hop < {n}{cond})"
_add("j7_neighborhood_1", lambda g: traversal.neighbourhood(g, A_PART, 1), _HOPS.format(start=A_PART, n=1, cond="") + " SELECT id, min(hop) AS hop FROM hop GROUP BY id", False)
_add("j7_neighborhood_2", lambda g: traversal.neighbourhood(g, A_PART, 2), _HOPS.format(start=A_PART, n=2, cond="") + " SELECT id, min(hop) AS hop FROM hop GROUP BY id", False)
_add(
    "j7_neighborhood_window", lambda g: traversal.neighbourhood(g, A_PART, 2, START, END),
    _HOPS.format(start=A_PART, n=2, cond=f' AND d."timestamp" BETWEEN {START} AND {END}') + " SELECT id, min(hop) AS hop FROM hop GROUP BY id", False,
)
_add(
    "j8_induced_subgraph", lambda g: R.induced(g, g.entities.where("entity_type = 'PROMO'"))[0].select("src", "dst", "chunk_id"),
    "SELECT src, dst, chunk_id FROM edges WHERE src IN (SELECT id FROM entities WHERE entity_type = 'PROMO') AND dst IN (SELECT id FROM entities WHERE entity_type = 'PROMO')",
)
_IDS = [f"p{i}" for i in range(1, 60)]
_IN = ", ".join(f"'{i}'" for i in _IDS)
_add("j9_export_subgraph", lambda g: R.export_subgraph(g, _IDS + ["nobody"])[1].select("src", "dst", "chunk_id"), f"SELECT src, dst, chunk_id FROM edges WHERE src IN ({_IN}) AND dst IN ({_IN})")
_add("j10_orphans", lambda g: R.orphans(g).select("id"), "SELECT id FROM entities WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)")
_add(
    "j17_relationship_briefs", lambda g: R.relationship_briefs(g, g.entities.where("entity_type = 'PROMO'")),
    'SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS "count", max("timestamp") AS latest FROM edges WHERE src IN (SELECT id FROM entities WHERE entity_type = \'PROMO\') AND dst IN (SELECT id FROM entities WHERE entity_type = \'PROMO\') GROUP BY ALL',
)
_add(
    "j18_pending_items", lambda g: R.pending_items(g, g.entities.where(F.col("id").isin(A_PART, B_PART))).select(*CHUNK),
    f"SELECT {CHUNK_SQL} FROM chunks WHERE chunk_type IN ('Decision', 'ActionItem') AND id IN (SELECT chunk_id FROM mentions WHERE entity_id IN ('{A_PART}', '{B_PART}'))",
)
_add(
    "j20_tag_names", lambda g: R.tag_names(g, L.chunks_by_document(g, DOC)).select("id", F.array_join("names", "; ").alias("names")),
    f"SELECT c.id, string_agg(e.canonical_name, '; ' ORDER BY t.pos) AS names FROM chunks c JOIN tags t ON t.chunk_id = c.id JOIN entities e ON e.id = t.tag WHERE c.source_document = '{DOC}' GROUP BY c.id",
)
_add(
    "j26_expected_cooccurrence", lambda g: R.edge_between(g, g.entities.where("access_count > 30").select(F.col("canonical_name").alias("name_a"), F.lit(1).alias("k")).join(g.entities.where(F.col("id").isin(A_PART, B_PART)).select(F.upper("canonical_name").alias("name_b"), F.lit(1).alias("k")), "k").drop("k")),
    f"SELECT a.canonical_name AS name_a, upper(b.canonical_name) AS name_b, EXISTS (SELECT 1 FROM edges d WHERE d.src = a.id AND d.dst = b.id) AS found FROM entities a, entities b WHERE a.access_count > 30 AND b.id IN ('{A_PART}', '{B_PART}')",
)
_add(
    "j27_changed_documents", lambda g: R.changed_documents(g.document_hashes.withColumn("sha256", F.when(F.col("document").endswith("3"), "other").otherwise(F.col("sha256"))), g.document_hashes),
    "SELECT DISTINCT source_document AS document, 'other' AS sha256 FROM chunks WHERE source_document LIKE '%3'",
)
_add("j28_prefix_search", lambda g: R.prefix_search(g, "cust-10").select(*CHUNK), f"SELECT {CHUNK_SQL} FROM chunks WHERE source_document LIKE 'cust-10%'")
_add(
    "j29_cross_anchor_union", lambda g: R.neighbours(g, A_PART).unionByName(R.neighbours(g, B_PART)).select("src", "dst", "chunk_id").distinct(),
    f"SELECT DISTINCT src, dst, chunk_id FROM edges WHERE src IN ('{A_PART}', '{B_PART}')",
)

# aggregations
_add("a1_statistics", A.statistics, "SELECT (SELECT count(*) FROM entities) AS entity_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM chunks) AS chunk_count, (SELECT count(DISTINCT document) FROM entity_documents) AS document_count")
_add("a1_entities_by_type", A.entities_by_type, "SELECT 'Custom(' || entity_type || ')' AS entity_type, count(*) AS n FROM entities GROUP BY ALL")
_PR = SQL + """, w AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY ALL), t AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), n AS (SELECT count(*) AS n FROM entities), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM entities, n)
""" + "".join(
    f", r{i} AS MATERIALIZED (SELECT e.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(s.s, 0) AS r FROM entities e CROSS JOIN n LEFT JOIN (SELECT t.dst, sum(r.r * t.p) AS s FROM t JOIN r{i - 1} r ON r.id = t.src GROUP BY t.dst) s ON s.dst = e.id)\n"
    for i in range(1, 21)
)
_add("a3_pagerank", lambda g: ranking.pagerank(g.entities, g.edges).select("id", F.round("rank", 9).alias("rank")), _PR + "SELECT id, round(r, 9) AS rank FROM r20", False)
_add("a4_out_weight", lambda g: A.out_weight(g.edges).select("src", F.round("weight", 6).alias("weight")), "SELECT src, round(sum(weight), 6) AS weight FROM edges GROUP BY src")
_add("a5_recalc_weights", lambda g: A.reweighted(g.edges).select("src", "dst", "chunk_id", "weight"), "SELECT src, dst, chunk_id, CAST(count(*) OVER (PARTITION BY src, dst) AS DOUBLE) AS weight FROM edges")
_add(
    "a6_dedup_edges", lambda g: A.deduplicated(g.edges).select("src", "dst", "chunk_id", F.round("weight", 6).alias("weight")),
    "SELECT src, dst, chunk_id, round(s, 6) AS weight FROM (SELECT *, sum(weight) OVER (PARTITION BY src, dst) AS s, row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, chunk_id) AS n FROM edges) WHERE n = 1",
)
_add(
    "a7_top_connections", lambda g: A.top_neighbours(g, 3),
    'SELECT id, neighbor, "count", place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "count" DESC, neighbor) AS place FROM (SELECT src AS id, dst AS neighbor, count(*) AS "count" FROM edges GROUP BY ALL)) WHERE place <= 3',
)
_add("a8_last_seen", A.last_seen, 'SELECT e.id, coalesce(m.latest, e.updated_at) AS last_seen FROM entities e LEFT JOIN (SELECT src, max("timestamp") AS latest FROM edges GROUP BY src) m ON m.src = e.id')
_add("a9_pair_counts", lambda g: A.pair_counts(g.edges), "SELECT a, b, count(*) AS n FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY ALL")
_add("a10_distinct_edges", lambda g: A.distinct_edge_count(g.edges), "SELECT count(DISTINCT (least(src, dst), greatest(src, dst), chunk_id)) AS n FROM edges")
_SESSIONS = "SELECT entity_id, 'claude-session://project-' || (CAST(regexp_extract(document, '(\\d+)$', 1) AS INT) % 3) || '/' || document AS document FROM entity_documents"
_add(
    "a11_cross_project", lambda g: A.cross_project_entities(g._replace(entity_documents=g.entity_documents.select("entity_id", F.concat(F.lit("claude-session://project-"), (F.regexp_extract("document", r"(\d+)$", 1).cast("int") % 3).cast("string"), F.lit("/"), "document").alias("document")))).select("id", F.array_join("projects", ",").alias("projects")),
    "SELECT entity_id AS id, string_agg(DISTINCT p, ',' ORDER BY p) AS projects FROM (SELECT entity_id, regexp_extract(document, '^claude-session://([^/]+)/', 1) AS p FROM (" + _SESSIONS + ")) GROUP BY entity_id HAVING count(DISTINCT p) > 1",
)
_add(
    "a12_goal_status", lambda g: A.goal_status(g, 852076800, kind="PROMO"),
    "SELECT m.entity_id AS id, count(*) AS mentions, max(c.\"timestamp\") AS latest, CASE WHEN max(c.\"timestamp\") IS NULL THEN 'unknown' WHEN max(c.\"timestamp\") < 852076800 - 30 * 86400 THEN 'stale' ELSE 'active' END AS status FROM mentions m JOIN chunks c ON c.id = m.chunk_id WHERE m.entity_id IN (SELECT id FROM entities WHERE entity_type = 'PROMO') GROUP BY m.entity_id",
)
_add("a25_low_access", lambda g: A.low_access_count(g, 30), "SELECT count_if(access_count < 30) AS n FROM entities")
_add("m10_prune_edges", lambda g: A.pruned(A.reweighted(g.edges), 2).select("src", "dst", "chunk_id"), "SELECT src, dst, chunk_id FROM (SELECT *, count(*) OVER (PARTITION BY src, dst) AS n FROM edges) WHERE n >= 2")
_add(
    "m7_decay", lambda g: g.entities.select("id", X.decayed(F.col("access_count"), F.col("updated_at"), 1000000000, 30).alias("access_count")),
    "SELECT id, CAST(round(access_count * exp(greatest(1000000000 - updated_at, 0) * (-0.6931471805599453 / (30 * 86400)))) AS BIGINT) AS access_count FROM entities",
)
_add("w4_top_per_type", lambda g: A.top_by_group(g.entities, ["entity_type"], [F.desc("access_count"), F.col("id")], 5).select("entity_type", "id", "place"), "SELECT entity_type, id, place FROM (SELECT entity_type, id, row_number() OVER (PARTITION BY entity_type ORDER BY access_count DESC, id) AS place FROM entities) WHERE place <= 5")
_add(
    "w3_prefix_budget", lambda g: A.within_budget(g.chunks, X.token_estimate(F.col("text")), 20, [F.desc("created_at"), F.col("id")], ["source_document"]).select("id", "source_document", "used"),
    "SELECT id, source_document, used FROM (SELECT id, source_document, CAST(sum(trunc(len(regexp_extract_all(text, '\\S+')) * 1.3)) OVER (PARTITION BY source_document ORDER BY created_at DESC, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM chunks) WHERE used <= 20",
)
_add("edge_weights_by_type", lambda g: g.edges.groupBy("chunk_type").agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.count(F.lit(1)).alias("n")), "SELECT chunk_type, min(weight) AS low, max(weight) AS high, count(*) AS n FROM edges GROUP BY ALL")
_add(
    "g6_chunk_scores", lambda g: A.hops_of_chunks(g.chunks, traversal.neighbourhood(g, A_PART, 1)).join(g.chunks.select("id", "chunk_type"), "id").select("id", (X.distance_weight(F.col("min_hop")) * X.score_weight(F.col("chunk_type"))).alias("score")).where("score > 1e-6"),
    SQL + f", hop AS (SELECT '{A_PART}' AS id, 0 AS hop UNION ALL SELECT DISTINCT dst, 1 FROM edges WHERE src = '{A_PART}'), m AS (SELECT c.id, c.chunk_type, min(coalesce(h.hop, 99)) AS hop FROM chunks c LEFT JOIN tags t ON t.chunk_id = c.id LEFT JOIN hop h ON h.id = t.tag GROUP BY ALL) SELECT id, 1 / pow(2.0::DOUBLE, greatest(hop - 1, 0)) * CASE chunk_type WHEN 'Decision' THEN 1.0::DOUBLE WHEN 'ActionItem' THEN 0.9::DOUBLE WHEN 'StatusUpdate' THEN 0.7::DOUBLE WHEN 'Preference' THEN 0.6::DOUBLE WHEN 'Background' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS score FROM m WHERE hop < 99", False,
)
_add("t1k_top_ranked", lambda g: ranking.top_ranked(ranking.pagerank(g.entities, g.edges), 10).select("id"), _PR + "SELECT id FROM r20 ORDER BY r DESC, id LIMIT 10", False)
_add("g1_density", lambda g: A.statistics(g).select((F.col("edge_count") / F.greatest("entity_count", F.lit(1))).alias("density")), "SELECT (SELECT count(*) FROM edges)::DOUBLE / greatest((SELECT count(*) FROM entities), 1) AS density")
