"""Mutations, reflection, retrieval, agent context, evaluation and the file graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoweave import functions as X
from mnemoweave.operators import aggregates as A
from mnemoweave.operators import relations as R
from mnemoweave.plans import agent, embedding, evaluation, ingestion, mutations, ranking, reflection, repo, retrieval
from mnemoweave.streaming import spool, watch
from mnemoweave.testviews import SQL, graph, read

QUERIES: dict = {}
KEEP, MERGE, DOC, NOW = "p1", "p7", "cust-37", 1_000_000_000


def _add(name, plan, sql=None, prelude=True):
    QUERIES[name] = (lambda spark, sf_dir: plan(graph(spark, sf_dir)), (SQL + sql if prelude else sql) if sql else None)


def _pairs(g, *pairs):
    return g.entities.sparkSession.createDataFrame([(k, m, 0.97, "manual") for k, m in pairs], "keep_id string, merge_id string, confidence double, method string")


def _documents(g, *names):
    return g.chunks.sparkSession.createDataFrame([(n,) for n in names], "document string")


def _merged(g):
    return mutations.merge_entities(g, _pairs(g, (KEEP, MERGE), ("p2", "p9")), NOW)


_TO = f"CASE {{0}} WHEN '{MERGE}' THEN '{KEEP}' WHEN 'p9' THEN 'p2' ELSE {{0}} END"
_ROW = "SELECT 'x1' AS id, 'Fresh one' AS canonical_name"

# mutations
_add("m1_add_entity", lambda g: mutations.add_entities(g, g.entities.limit(1).select(F.lit("x1").alias("id"), F.lit("Fresh one").alias("canonical_name"))).entities.select("id", "canonical_name"), f"SELECT id, canonical_name FROM entities UNION ALL {_ROW}")
_NEW = lambda g: g.chunks.where("id = '7'").select(F.explode(F.array(F.struct(F.lit("p1").alias("a"), F.lit("p7").alias("b")), F.struct(F.lit("p1").alias("a"), F.lit("p1").alias("b")), F.struct(F.lit("p1").alias("a"), F.lit("ghost").alias("b")))).alias("e"), F.lit("new").alias("chunk_id"), F.lit("Decision").alias("chunk_type")).select("e.a", "e.b", "chunk_id", "chunk_type")
_add("m2_add_cooccurrence", lambda g: mutations.add_cooccurrences(g, _NEW(g)).edges.where("chunk_id = 'new'").select("src", "dst", "weight"), "SELECT 'p1' AS src, 'p7' AS dst, 2.0::DOUBLE AS weight UNION ALL SELECT 'p7', 'p1', 2.0", False)
_add(
    "m3_store_chunk", lambda g: mutations.store_chunks(g, g.chunks.where("id = '7'").withColumn("tags", F.array(F.lit("p1"), F.lit("p1"), F.lit("ghost")))).mentions.where("chunk_id = '7'"),
    "SELECT entity_id, chunk_id FROM mentions WHERE chunk_id = '7' UNION SELECT 'p1', '7' WHERE EXISTS (SELECT 1 FROM chunks WHERE id = '7')",
)
_add(
    "m4_merge_entities", lambda g: _merged(g).entities.select("id", "canonical_name", F.array_join(F.array_sort("aliases"), ",").alias("aliases"), "access_count", "updated_at", F.size("merge_history").alias("merges")),
    f"""SELECT e.id, e.canonical_name, (SELECT string_agg(DISTINCT a, ',' ORDER BY a) FROM (SELECT e.alias AS a UNION SELECT unnest([m.canonical_name, m.alias]) FROM entities m WHERE m.id = k.merge_id)) AS aliases,
    CAST(e.access_count + coalesce((SELECT access_count FROM entities m WHERE m.id = k.merge_id), 0) AS BIGINT) AS access_count, CASE WHEN k.merge_id IS NULL THEN e.updated_at ELSE {NOW} END AS updated_at, CASE WHEN k.merge_id IS NULL THEN 0 ELSE 1 END AS merges
    FROM entities e LEFT JOIN (VALUES ('{KEEP}', '{MERGE}'), ('p2', 'p9')) k(keep_id, merge_id) ON k.keep_id = e.id WHERE e.id NOT IN ('{MERGE}', 'p9')""",
)
_add("m4_merge_edges", lambda g: _merged(g).edges.select("src", "dst", "chunk_id", "weight"), f"SELECT * FROM (SELECT {_TO.format('src')} AS src, {_TO.format('dst')} AS dst, chunk_id, weight FROM edges) WHERE src <> dst")
_add(
    "m4_merge_tags", lambda g: _merged(g).chunks.select("id", F.array_join("tags", ",").alias("tags")),
    f"SELECT c.id, coalesce(string_agg({_TO.format('t.tag')}, ',' ORDER BY t.pos), '') AS tags FROM chunks c LEFT JOIN tags t ON t.chunk_id = c.id GROUP BY c.id",
)
_add("m4_merge_mentions", lambda g: _merged(g).mentions, f"SELECT DISTINCT {_TO.format('entity_id')} AS entity_id, chunk_id FROM mentions")
_add("m5_remove_entity", lambda g: mutations.remove_entities(g, g.entities.where("id = 'p1'")).edges.select("src", "dst", "chunk_id"), "SELECT src, dst, chunk_id FROM edges WHERE src <> 'p1' AND dst <> 'p1'")
_DEAD = f", dead AS (SELECT id FROM chunks WHERE source_document = '{DOC}'), listing AS (SELECT entity_id FROM entity_documents WHERE document = '{DOC}'), alive AS (SELECT entity_id FROM entity_documents WHERE document <> '{DOC}' UNION SELECT entity_id FROM mentions WHERE NOT (chunk_id IN (SELECT id FROM dead) AND entity_id IN (SELECT entity_id FROM listing)) UNION SELECT src FROM edges WHERE chunk_id NOT IN (SELECT id FROM dead))"
_add(
    "m6_remove_document", lambda g: mutations.remove_documents(g, _documents(g, DOC)).counts,
    SQL + _DEAD + "SELECT (SELECT count(*) FROM dead) AS chunks_removed, (SELECT count(*) FROM edges WHERE chunk_id IN (SELECT id FROM dead)) AS edges_removed, (SELECT count(*) FROM listing WHERE entity_id NOT IN (SELECT entity_id FROM alive)) AS entities_removed, (SELECT count(*) FROM listing WHERE entity_id IN (SELECT entity_id FROM alive)) AS entities_updated", False,
)
_add("m6_remaining_mentions", lambda g: mutations.remove_documents(g, _documents(g, DOC), lazy=True).state.mentions, SQL + _DEAD + "SELECT * FROM mentions WHERE chunk_id NOT IN (SELECT id FROM dead)", False)
_add("m9_dedup_state", lambda g: mutations.dedup_edges(g).edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight")), "SELECT src, count(DISTINCT dst) AS n, round(sum(weight), 6) AS weight FROM edges GROUP BY src")
_add("m12_changed", lambda g: mutations.split_by_change(g.document_hashes.withColumn("sha256", F.when(F.col("document") == DOC, "new").otherwise(F.col("sha256"))), g)[0].select("document"), f"SELECT '{DOC}' AS document", False)
_add("m16_cleanup_orphans", lambda g: mutations.cleanup_orphans(g._replace(edges=g.edges.where("src <> 'p1' and dst <> 'p1'")), NOW).entities.select("id"), "SELECT id FROM entities WHERE id <> 'p1'")
_add("m20_clear_prefix", lambda g: mutations.clear_prefix(g, "cust-1", lazy=True).state.chunks.select("id"), "SELECT id FROM chunks WHERE source_document NOT LIKE 'cust-1%'")
_add("m17_upkeep", lambda g: reflection.upkeep(g, NOW)[1], "SELECT count_if(CASE WHEN updated_at < 1000000000 THEN round(access_count * exp((1000000000 - updated_at) * (-0.6931471805599453 / (30 * 86400)))) ELSE access_count END < 5) AS n FROM entities")

# reflection
_NAMED = "n AS (SELECT id, entity_type, alias, lower(canonical_name) AS a, lower(alias) AS b, access_count AS k FROM entities)"
_add(
    "j11_alias_candidates", lambda g: reflection.alias_candidates(g, 0.3),
    SQL + ", " + _NAMED + "SELECT CASE WHEN y.k > x.k THEN y.id ELSE x.id END AS keep_id, CASE WHEN y.k > x.k THEN x.id ELSE y.id END AS merge_id, 1.0::DOUBLE / 3 AS confidence, 'alias_overlap' AS method FROM n x JOIN n y ON x.entity_type = y.entity_type AND x.id < y.id AND x.b = y.b", False,
)


def _vector_pairs(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    g = graph(spark, sf_dir)
    e = v.select(F.col("vec_id").cast("string").alias("id"), F.lit("n").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), F.col("label").cast("string").alias("entity_type"))
    found = reflection.vector_candidates(g._replace(entities=e, mentions=g.mentions.where(F.lit(False))), v.select(F.col("vec_id").cast("string").alias("entity_id"), F.col("embedding").cast("array<double>").alias("vector")), 0.35)
    return found.select("keep_id", "merge_id", F.round("confidence", 6).alias("confidence"))


QUERIES["j12_vector_candidates"] = (_vector_pairs, "SELECT CAST(a.vec_id AS VARCHAR) AS keep_id, CAST(b.vec_id AS VARCHAR) AS merge_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS confidence FROM embeddings a JOIN embeddings b ON a.label = b.label AND CAST(a.vec_id AS VARCHAR) < CAST(b.vec_id AS VARCHAR) WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35")
_SERIAL = (
    SQL.replace("WITH tag AS", "WITH RECURSIVE tag AS", 1) + ", " + _NAMED + """, cand AS (
  SELECT CASE WHEN y.k > x.k THEN y.id ELSE x.id END AS keep_id, CASE WHEN y.k > x.k THEN x.id ELSE y.id END AS merge_id FROM n x JOIN n y ON x.entity_type = y.entity_type AND x.id < y.id AND x.b = y.b
), placed AS (
  SELECT *, row_number() OVER (ORDER BY keep_id, merge_id) AS i, CAST(substr(keep_id, 2) AS INT) + 1 AS k, CAST(substr(merge_id, 2) AS INT) + 1 AS m FROM cand
), steps AS (
  SELECT list_reduce(list([k, m] ORDER BY i), lambda done, x: CASE WHEN list_contains(done, -x[1]) OR list_contains(done, -x[2]) THEN done ELSE list_concat(done, [x[1], -x[2]]) END, CAST([] AS INT[])) AS done FROM placed
), taken AS (
  SELECT 'p' || (done[2 * j + 1] - 1) AS keep_id, 'p' || (-done[2 * j + 2] - 1) AS merge_id FROM steps, range(CAST(len(done) // 2 AS BIGINT)) AS r(j)
), chain AS (
  SELECT merge_id, keep_id FROM taken UNION ALL SELECT c.merge_id, t.keep_id FROM chain c JOIN taken t ON t.merge_id = c.keep_id
), ended AS (
  SELECT * FROM chain WHERE keep_id NOT IN (SELECT merge_id FROM taken)
) """
)
_add("m15_execute_merges", lambda g: reflection.carried_out(g, reflection.alias_merges(g, 0.3), NOW).entities.select("id", F.size("merge_history").alias("absorbed")), _SERIAL + "SELECT id, CAST((SELECT count(*) FROM ended WHERE keep_id = id) AS INT) AS absorbed FROM entities WHERE id NOT IN (SELECT merge_id FROM taken)", False)
_add("m18_reflect_light", lambda g: reflection.reflect(g, NOW, full=False).entities.select("id"), "SELECT id FROM entities")

# retrieval and agent context
_RANKS = lambda g: g.entities.select("id", F.col("access_count").cast("double").alias("rank"))
_SIMILAR = lambda g: g.entities.select("id", (F.col("access_count") % 7 / 7.0).alias("similarity"))
_add(
    "g3_anchors", lambda g: retrieval.anchors(_SIMILAR(g), _RANKS(g), 5).select("id", F.round("score", 9).alias("score")),
    "SELECT id, round(similarity * 0.8::DOUBLE + access_count / (SELECT max(access_count) FROM entities) * 0.2::DOUBLE, 9) AS score FROM (SELECT id, access_count, access_count % 7 / 7.0::DOUBLE AS similarity FROM entities ORDER BY similarity DESC, id LIMIT 15) ORDER BY similarity * 0.8::DOUBLE + access_count / (SELECT max(access_count) FROM entities) * 0.2::DOUBLE DESC, id LIMIT 5",
)
_add(
    "g4_expand", lambda g: retrieval.expanded(g, g.entities.where("id in ('p1', 'p7')").select("id"), 1, 40).chunks.select("id", "min_hop", F.round("score", 9).alias("score")),
    """, start AS (SELECT id FROM entities WHERE id IN ('p1', 'p7')
), member AS (SELECT id AS anchor, id FROM start UNION SELECT s.id, e.dst FROM start s JOIN edges e ON e.src = s.id
), near AS (SELECT DISTINCT e.src, e.dst, e.chunk_id FROM edges e JOIN member a ON a.id = e.src JOIN member b ON b.id = e.dst AND b.anchor = a.anchor
), paired AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near
), one AS (SELECT dst AS id FROM paired WHERE src IN (SELECT id FROM start) AND dst NOT IN (SELECT id FROM start)
), two AS (SELECT dst AS id FROM paired WHERE src IN (SELECT id FROM one)
), far AS (SELECT id, CASE WHEN id IN (SELECT id FROM start) THEN 0 WHEN id IN (SELECT id FROM one) THEN 1 ELSE 2 END AS hop FROM (SELECT DISTINCT id FROM member)
), kept AS (SELECT * FROM far ORDER BY hop, id LIMIT 40
), shown AS (SELECT DISTINCT chunk_id FROM near WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)
) SELECT c.id, min(k.hop) AS min_hop, round(CASE WHEN min(k.hop) < 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * CASE any_value(c.chunk_type) WHEN 'Decision' THEN 1.0::DOUBLE WHEN 'ActionItem' THEN 0.9::DOUBLE WHEN 'StatusUpdate' THEN 0.7::DOUBLE WHEN 'Background' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END, 9) AS score
FROM chunks c JOIN shown ON shown.chunk_id = c.id JOIN tags t ON t.chunk_id = c.id JOIN kept k ON k.id = t.tag GROUP BY c.id""",
)
_add("g10_assemble", lambda g: g.entities.sparkSession.createDataFrame([(retrieval.assembled(g, embedding.embedded(g.entities.select("id", "canonical_name"), "canonical_name", lambda t: embedding.hashing_embedder(t, 16)).select(F.col("id").alias("entity_id"), "vector"), _RANKS(g), embedding.hashing_embedder(["Part 1"], 16)[0], 10, 6000),)], "context string"))
_add(
    "g11_knowledge_map", lambda g: retrieval.knowledge_map(g, _RANKS(g), 20).select("entity_type", "id", "rank", "near"),
    "SELECT b.entity_type, b.id, CAST(b.access_count AS DOUBLE) AS rank, (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT o.canonical_name AS x FROM edges d JOIN entities o ON o.id = d.dst WHERE d.src = b.id ORDER BY x LIMIT 5)) AS near FROM (SELECT * FROM entities ORDER BY access_count DESC, id LIMIT 20) b",
)
_add("g12_entity_profile", lambda g: agent.entity_profile(g, KEEP)[1].select("id", "count"), f"SELECT dst AS id, count(*) AS \"count\" FROM edges WHERE src = '{KEEP}' GROUP BY dst ORDER BY \"count\" DESC, id LIMIT 10")
_add("g13_mentions", lambda g: agent.mentions(g, KEEP, 20).select("id", "at"), f"SELECT id, coalesce(\"timestamp\", created_at) AS at FROM chunks WHERE id IN (SELECT chunk_id FROM mentions WHERE entity_id = '{KEEP}') ORDER BY coalesce(\"timestamp\", created_at) DESC, id DESC LIMIT 20")
_add("g14_timeline", lambda g: agent.timeline(g, KEEP, 10).select("id", "at"), f"SELECT id, coalesce(\"timestamp\", created_at) AS at FROM chunks WHERE id IN (SELECT chunk_id FROM mentions WHERE entity_id = '{KEEP}') ORDER BY coalesce(\"timestamp\", created_at) DESC, id DESC LIMIT 10")
_add(
    "g15_summary", lambda g: agent.summary_line(g, KEEP),
    f"SELECT e.canonical_name || ' (' || e.entity_type || '): ' || (SELECT string_agg(canonical_name, ', ' ORDER BY n DESC, id) FROM (SELECT o.id, o.canonical_name, count(*) AS n FROM edges d JOIN entities o ON o.id = d.dst WHERE d.src = '{KEEP}' GROUP BY ALL ORDER BY n DESC, o.id LIMIT 3)) || ', ' || (SELECT count(*) FROM mentions WHERE entity_id = '{KEEP}') || ' chunks' AS line FROM entities e WHERE e.id = '{KEEP}'",
)
_TEXTS = lambda g: g.entities.select(F.col("id").alias("text_id"), F.concat(F.lit("About "), "canonical_name", F.lit("5 and "), F.upper("canonical_name"), F.lit(". Bought as x"), F.element_at("aliases", 1), F.lit("; ring, "), F.element_at(F.split("canonical_name", " "), 2)).alias("text"))
_add(
    "j14_mentions_in_text", lambda g: agent.mentions_in(g, _TEXTS(g)),
    """, texts AS (
  SELECT id AS text_id, lower('About ' || canonical_name || '5 and ' || upper(canonical_name) || '. Bought as x' || alias || '; ring, ' || split_part(canonical_name, ' ', 2)) AS text FROM entities
), names AS (
  SELECT id, lower(canonical_name) AS name, TRUE AS own FROM entities UNION ALL SELECT id, lower(alias), FALSE FROM entities
) SELECT text_id, id, max(CASE WHEN NOT own THEN 0.6::DOUBLE WHEN regexp_matches(text, '(^|[^\\w])' || regexp_escape(name) || '($|[^\\w])') THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END) AS match FROM texts JOIN names ON contains(text, name) WHERE length(name) >= 3 GROUP BY ALL""",
)
_add(
    "j15_candidates", lambda g: agent.candidates(g.entities.where("access_count > 40").select("id", F.lit(1.0).alias("match")), _SIMILAR(g).where("similarity > 0.8"), 30).select("id", F.round("score", 9).alias("score")),
    "SELECT id, round(CASE WHEN s > 0.8 THEN s ELSE 0 END + CASE WHEN access_count > 40 THEN 0.3::DOUBLE ELSE 0 END, 9) AS score FROM (SELECT id, access_count, access_count % 7 / 7.0::DOUBLE AS s FROM entities) WHERE s > 0.8 OR access_count > 40 ORDER BY CASE WHEN s > 0.8 THEN s ELSE 0 END + CASE WHEN access_count > 40 THEN 0.3::DOUBLE ELSE 0 END DESC, id LIMIT 30",
)
_add(
    "g18_entity_briefs", lambda g: agent.briefs(g, g.entities.where("id in ('p1', 'p7')"), _RANKS(g)).select("id", F.round("importance", 9).alias("importance"), "last_seen", "mentions"),
    "SELECT e.id, round(e.access_count / (SELECT max(access_count) FROM entities)::DOUBLE, 9) AS importance, coalesce((SELECT max(\"timestamp\") FROM edges WHERE src = e.id), e.updated_at) AS last_seen, (SELECT count(*) FROM mentions WHERE entity_id = e.id) AS mentions FROM entities e WHERE e.id IN ('p1', 'p7')",
)
_BUCKET = "CASE entity_type WHEN 'PROMO' THEN 'Goal' WHEN 'STANDARD' THEN 'Skill' WHEN 'SMALL' THEN 'Concept' ELSE 'Other' END"
_add(
    "g20_profile", lambda g: agent.profile(g._replace(entities=g.entities.withColumn("entity_type", F.expr(_BUCKET))), _RANKS(g)).select("bucket", "id", "place"),
    f"SELECT bucket, id, place FROM (SELECT {_BUCKET} AS bucket, id, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY access_count DESC, id) AS place FROM entities WHERE {_BUCKET} <> 'Other' AND ({_BUCKET} <> 'Concept' OR access_count >= 3)) WHERE place <= 10",
)
_add(
    "g24_memory_split", lambda g: agent.split_memories(g.chunks.withColumn("source_document", F.concat(F.when(F.col("memory_category") == "Episodic", "chatbot://episodic/").otherwise("chatbot://core/"), "source_document"))).select("memory", "id", "place"),
    "SELECT memory, id, place FROM (SELECT CASE WHEN memory_category = 'Episodic' THEN 'episodic' ELSE 'core' END AS memory, id, row_number() OVER (PARTITION BY memory_category = 'Episodic' ORDER BY coalesce(\"timestamp\", 0) DESC, id) AS place FROM chunks) WHERE place <= 2",
)
_add(
    "j19_recent_events", lambda g: retrieval.recent_events(g, g.entities.where("id = 'p1'"), 1).select("id"),
    "SELECT id FROM chunks WHERE id IN (SELECT chunk_id FROM tags WHERE tag = 'p1' OR tag IN (SELECT dst FROM edges WHERE src = 'p1')) ORDER BY coalesce(\"timestamp\", 0) DESC, id LIMIT 15",
)

# evaluation
_EXP = "SELECT id AS document, canonical_name AS name FROM entities WHERE access_count % 2 = 0"
_add(
    "a14_precision_recall_f1", lambda g: evaluation.extraction_quality(g.entities.where("access_count % 2 = 0").select(F.col("id").alias("document"), F.col("canonical_name").alias("name")), g.entities.where("access_count % 3 = 0").select(F.col("id").alias("document"), F.upper("canonical_name").alias("name"))).select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1"))),
    'SELECT round(tp / (tp + fp)::DOUBLE, 9) AS "precision", round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 9) AS f1 FROM (SELECT count_if(access_count % 6 = 0) AS tp, count_if(access_count % 3 = 0 AND access_count % 2 <> 0) AS fp, count_if(access_count % 2 = 0 AND access_count % 3 <> 0) AS fn FROM entities)',
)
_KW = lambda: F.array(F.lit("URGENT"), F.lit("order"), F.lit("37"))
_HITS = "(CAST(contains(lower(text), 'urgent') AS INT) + CAST(contains(lower(text), 'order') AS INT) + CAST(contains(lower(text), '37') AS INT))"
_add("a15_keyword_score", lambda g: evaluation.keyword_score(g.chunks.select(F.col("id").alias("query_id"), F.col("text").alias("context"), _KW().alias("keywords"))), f"SELECT round(avg({_HITS} / 3.0::DOUBLE), 4) AS score FROM chunks")
_add("a16_context_efficiency", lambda g: evaluation.context_efficiency(g.chunks.select(F.col("id").alias("query_id"), F.col("text").alias("context"), _KW().alias("keywords"))), f"SELECT round(avg(score), 4) AS score FROM (SELECT {_HITS} / (len(regexp_extract_all(text, '[^ ]+')) * 1.3::DOUBLE) * 1000 AS score FROM chunks ORDER BY id LIMIT 30)")
_add("a17_resilience", lambda g: evaluation.resilience(g.chunks.select(F.col("id").alias("document")), g.edges.where("weight >= 1.8").select(F.col("chunk_id").alias("document"))), "SELECT avg(CASE WHEN id IN (SELECT chunk_id FROM edges WHERE weight >= 1.8) THEN 1.0::DOUBLE ELSE 0 END) AS score FROM chunks")
_add("j25_expected_found", lambda g: evaluation.extraction_counts(g.entities.where("access_count % 2 = 0").select(F.col("entity_type").alias("document"), F.col("canonical_name").alias("name")), g.entities.where("access_count % 3 = 0").select(F.col("entity_type").alias("document"), F.col("canonical_name").alias("name"))), "SELECT entity_type AS document, count_if(access_count % 6 = 0) AS tp, count_if(access_count % 3 = 0 AND access_count % 2 <> 0) AS fp, count_if(access_count % 2 = 0 AND access_count % 3 <> 0) AS fn FROM entities WHERE access_count % 2 = 0 OR access_count % 3 = 0 GROUP BY ALL")


# the file graph: nations import regions, customers use nations
def _file_edges(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    one = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("Import").alias("kind"))
    return one.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("SymbolUsage").alias("kind")))


_FILES = "WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'Import' AS kind FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'SymbolUsage' FROM customer) "
QUERIES["j21_dependents"] = (lambda s, d: repo.dependents(_file_edges(s, d), "n3"), _FILES + "SELECT src AS path, kind FROM e WHERE dst = 'n3'")
QUERIES["j22_repo_neighborhood"] = (
    lambda s, d: repo.neighbourhood(_file_edges(s, d), s.createDataFrame([("n3",)], "path string"), 2).select("path", "hop", "weight"),
    _FILES + "SELECT path, 1 AS hop, 1.0::DOUBLE AS weight FROM (SELECT dst AS path FROM e WHERE src = 'n3' UNION SELECT src FROM e WHERE dst = 'n3')",
)
QUERIES["j24_edge_upsert"] = (
    lambda s, d: repo.upserted_edges(_file_edges(s, d), _file_edges(s, d).withColumn("kind", F.when(F.col("src").startswith("c1"), "Import").otherwise("SymbolUsage"))),
    _FILES + "SELECT src, dst, CASE WHEN kind = 'Import' OR src LIKE 'c1%' THEN 'Import' ELSE kind END AS kind FROM e",
)
QUERIES["a2_repo_statistics"] = (
    lambda s, d: _file_edges(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("targets")),
    _FILES + "SELECT kind, count(*) AS n, count(DISTINCT dst) AS targets FROM e GROUP BY kind",
)
QUERIES["t2k_top_files"] = (
    lambda s, d: ranking.top_ranked(ranking.pagerank(_file_edges(s, d).select(F.explode(F.array("src", "dst")).alias("id")), ranking.file_edges_weighted(_file_edges(s, d))), 5).select("id", F.round("rank", 9).alias("rank")),
    None,
)


# the spool: events as fragments
def _fragments(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    state = F.element_at(F.array(*map(F.lit, ("pending", "extracted", "failed"))), (F.col("event_id") % 3 + 1).cast("int"))
    at = (F.col("event_id") * 60).cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("source_id"), F.col("event_type").alias("text"), F.lit("Episodic").alias("category"), F.lit(None).cast("string").alias("project"),
        F.lit(None).cast("string").alias("entity_hints"), at.alias("created_at"), F.when(state == "extracted", at).alias("extracted_at"), state.alias("extraction_status"),
        F.when(state == "extracted", F.concat(F.lit("b"), (F.col("event_id") % 17).cast("string"))).alias("batch_id"), F.when(state == "failed", "boom").alias("error"),
    )


_FR = "WITH f AS (SELECT event_id AS id, 'u' || user_id AS source_id, event_type AS text, CAST(event_id * 60 AS BIGINT) AS created_at, ['pending', 'extracted', 'failed'][event_id % 3 + 1] AS status, CASE WHEN event_id % 3 = 1 THEN 'b' || (event_id % 17) END AS batch_id FROM events) "
QUERIES["a18_spool_histogram"] = (lambda s, d: spool.histogram(_fragments(s, d)), _FR + "SELECT s.status, count(f.id) AS n FROM (VALUES ('pending'), ('extracting'), ('extracted'), ('failed')) s(status) LEFT JOIN f ON f.status = s.status GROUP BY s.status UNION ALL SELECT 'total', count(*) FROM f")
QUERIES["a19_recent_batches"] = (
    lambda s, d: spool.recent_batches(_fragments(s, d)).select("batch_id", "extracted_at", "fragments", F.array_join("sources", ",").alias("sources")),
    _FR + "SELECT b.batch_id, b.extracted_at, b.fragments, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT source_id AS x FROM f WHERE f.batch_id = b.batch_id ORDER BY x LIMIT 5)) AS sources FROM (SELECT batch_id, max(created_at) AS extracted_at, count(*) AS fragments FROM f WHERE batch_id IS NOT NULL GROUP BY batch_id ORDER BY extracted_at DESC, batch_id LIMIT 10) b",
)
QUERIES["a21_group_concat"] = (lambda s, d: spool.by_source(_fragments(s, d)).select("source_id", "text", F.size("ids").alias("n")), _FR + "SELECT source_id, string_agg(text, chr(10) || chr(10) ORDER BY created_at, id) AS text, CAST(count(*) AS INT) AS n FROM f GROUP BY source_id")
QUERIES["t10k_spool_claim"] = (lambda s, d: spool.claim(_fragments(s, d), 50).select("id", "source_id"), _FR + "SELECT id, source_id FROM f WHERE status = 'pending' ORDER BY source_id, created_at, id LIMIT 50")
QUERIES["t13k_failed_sample"] = (lambda s, d: spool.failed_sample(_fragments(s, d), 20).select("id"), _FR + "SELECT id FROM f WHERE status = 'failed' ORDER BY id DESC LIMIT 20")
QUERIES["r8_retention"] = (lambda s, d: spool.retained(_fragments(s, d), 3_000_000, 30).select("id"), _FR + "SELECT id FROM f WHERE NOT (status = 'extracted' AND created_at < 3000000 - 30 * 86400)")


_MOVED = lambda f: spool.moved(f, f.where("id % 7 = 0").select("id", F.concat(F.lit("e"), "id").alias("error")), "failed", 9)
QUERIES["r5_moved"] = (lambda s, d: _MOVED(_fragments(s, d)).select("id", "extraction_status", "error"), _FR + "SELECT id, CASE WHEN id % 7 = 0 THEN 'failed' ELSE status END AS extraction_status, CASE WHEN id % 7 = 0 THEN 'e' || id WHEN status = 'failed' THEN 'boom' END AS error FROM f")
QUERIES["r5_retry_failed"] = (lambda s, d: spool.retry_failed(_fragments(s, d)).select("id", "extraction_status", "error"), _FR + "SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS extraction_status, CAST(NULL AS VARCHAR) AS error FROM f")
QUERIES["r5_reset_stale"] = (lambda s, d: spool.reset_stale(_fragments(s, d).withColumn("extraction_status", F.when(F.col("id") % 2 == 0, "extracting").otherwise("failed")), 200_000).select("id", "extraction_status"), _FR + "SELECT id, CASE WHEN id % 2 <> 0 THEN 'failed' WHEN created_at < 200000 - 3600 THEN 'pending' ELSE 'extracting' END AS extraction_status FROM f")


def _file_events(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("create", "modify", "remove", "rename", "other"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.concat(F.lit("/repo/f"), "user_id", F.when(F.col("user_id") % 4 == 0, ".txt").otherwise(".py")).alias("path"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at"))


_KINDS = "['create', 'modify', 'remove', 'rename', 'other'][event_id % 5 + 1]"
QUERIES["r3_normalised_events"] = (
    lambda s, d: watch.normalised_batch(_file_events(s, d), s.createDataFrame([("/repo/f1.py",)], "path string")).groupBy("path", "event").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH e AS (SELECT '/repo/f' || user_id || CASE WHEN user_id % 4 = 0 THEN '.txt' ELSE '.py' END AS path, {_KINDS} AS kind, ts, event_id FROM events
), k AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'remove' THEN FALSE WHEN kind <> 'other' THEN TRUE END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), path = '/repo/f1.py') AS known FROM e
), m AS (SELECT path, CASE WHEN kind = 'create' AND NOT known THEN 'Created' WHEN kind IN ('create', 'modify', 'rename') THEN 'Modified' WHEN kind = 'remove' AND known THEN 'Deleted' END AS event FROM k)
SELECT path, event, count(*) AS n FROM m WHERE event IS NOT NULL GROUP BY ALL""",
)
QUERIES["r2_debounced"] = (
    lambda s, d: watch.debounced(_file_events(s, d), "1 hour").select("path", "kind", F.unix_micros("at").alias("at")),
    f"""WITH e AS (SELECT '/repo/f' || user_id || CASE WHEN user_id % 4 = 0 THEN '.txt' ELSE '.py' END AS path, {_KINDS} AS kind, ts FROM events
), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY path ORDER BY ts)
), n AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT path, arg_max(kind, ts) AS kind, CAST(epoch_us(max(ts)) AS BIGINT) AS at FROM n GROUP BY path, burst""",
)
QUERIES["f15_file_filter"] = (lambda s, d: watch.filtered(_file_events(s, d), ["py"], [".git"], []).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT ['create', 'modify', 'remove', 'rename', 'other'][event_id % 5 + 1] AS kind, count(*) AS n FROM events WHERE user_id % 4 <> 0 GROUP BY ALL")


# ingestion over documents with the rule-based client
def _ingested(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("source_document"), "text", F.lit("Episodic").alias("memory_category"))
    return ingestion.ingest(graph(spark, sf_dir), docs, NOW)


QUERIES["p20_ingest"] = (lambda s, d: ingestion.rolled_up(_ingested(s, d).results), None)
_add(
    "e1_descriptors", lambda g: embedding.entity_descriptors(g),
    """, near AS (
  SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS place FROM edges GROUP BY src, dst
), named AS (
  SELECT src, string_agg(canonical_name, ', ' ORDER BY place) AS near FROM near JOIN entities ON id = dst WHERE place <= 7 GROUP BY src
), stems AS (
  SELECT entity_id, string_agg(document, ', ' ORDER BY document) AS stems FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY document) AS k FROM entity_documents) WHERE k <= 3 GROUP BY entity_id
) SELECT id, concat_ws(' | ', canonical_name || ' (' || entity_type || ')', 'aka: ' || alias, 'Co-occurs with: ' || near, 'Sources: ' || stems) AS text FROM entities LEFT JOIN named ON src = id LEFT JOIN stems ON entity_id = id""",
)


def _letters(texts):
    return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz0123456789"] for t in texts]


def _mentioned(g):
    """Each entity named without its first word and its last character: names that several others contain."""
    name = F.lower(F.regexp_replace("canonical_name", r"^\S+ (.*).$", "$1"))
    return g.entities.select("id", F.lit("d").alias("source_document"), F.concat(F.lit("on "), name).alias("text"), F.lit(False).alias("failed"), F.array(F.struct(name.alias("name"), F.lit("project").alias("entity_type"))).alias("tags"))


_CLOSE = """, m AS (
  SELECT id AS chunk_id, regexp_replace(lower(canonical_name), '^\\S+ (.*).$', '\\1') AS name FROM entities
), vec AS (
  SELECT name, list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789', ''), lambda c: (length(name) - length(replace(name, c, '')))::DOUBLE) AS v FROM (SELECT DISTINCT trim(name) AS name FROM m UNION SELECT lower(canonical_name) FROM entities)
), scored AS (
  SELECT k.name, e.id, list_cosine_similarity(a.v, b.v) AS s FROM (SELECT DISTINCT trim(name) AS name FROM m) k JOIN entities e ON contains(lower(e.canonical_name), k.name) JOIN vec a ON a.name = k.name JOIN vec b ON b.name = lower(e.canonical_name)
), best AS (
  SELECT name, id AS entity_id, s FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(s, 12) DESC, id DESC) AS r FROM scored) WHERE r = 1
), met AS (
  SELECT m.chunk_id, trim(m.name) AS name, entity_id, s FROM m LEFT JOIN best ON best.name = trim(m.name)
) """
_add("j13_vector_links", lambda g: ingestion.linked(g, _mentioned(g), embed=_letters).tagged.select("chunk_id", "name", "existing_id"), _CLOSE + "SELECT chunk_id, name, CASE WHEN s >= 0.85 THEN entity_id END AS existing_id FROM met")
_add("j13_vector_review", lambda g: ingestion.linked(g, _mentioned(g), embed=_letters).review.select("name", "entity_id", F.round("similarity", 6).alias("similarity")), _CLOSE + "SELECT name, entity_id, round(s, 6) AS similarity FROM met WHERE s >= 0.70 AND s < 0.85")


class _Failing(ingestion.RuleClient):
    """Fails on texts whose number of characters leaves no remainder or one by three, and never on whole batches."""

    def tag(self, texts):
        return [None if len(t) % 3 < 2 and len(t) > 150 else [] for t in texts]


def _spoken(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("text is not null")
    source = F.concat(F.lit("conv-"), "conv_id")
    docs = turns.groupBy(source.alias("source_document")).agg(F.when(F.min("conv_id") % 10 != 3, F.concat_ws("", F.sort_array(F.collect_list("text")))).alias("text")).withColumn("memory_category", F.lit("Episodic"))
    raw = turns.select(source.alias("source_document"), F.col("turn").cast("int").alias("position"), F.lit(None).cast("string").alias("section_name"), "role", F.lit(None).cast("long").alias("timestamp"), F.lit("Episodic").alias("memory_category"), "text").withColumnRenamed("role", "speaker")
    return ingestion.ingest(graph(spark, sf_dir), docs, NOW, _Failing(), raw=raw).results.select("source_document", "status", "chunks", "failed_chunks")


_BAD = "length(text) % 3 < 2 AND length(text) > 150"
QUERIES["p16_statuses"] = (
    _spoken,
    f"""WITH t AS (SELECT 'conv-' || conv_id AS d, conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS call, CAST({_BAD} AS INT) AS bad FROM conversations WHERE text IS NOT NULL
), calls AS (SELECT d, call, sum(count(*)) OVER w AS done, sum(sum(bad)) OVER w AS failed FROM t GROUP BY d, call WINDOW w AS (PARTITION BY d ORDER BY call)
), stop AS (SELECT d, min(call) AS call FROM calls WHERE done > 2 AND failed / done > 0.5 GROUP BY d
), f AS (SELECT d, any_value(conv_id) AS conv_id, count(*) AS chunks, count(*) FILTER (WHERE bad = 1 OR t.call > coalesce(stop.call, t.call)) AS failed FROM t LEFT JOIN stop USING (d) GROUP BY d)
SELECT d AS source_document, CASE WHEN conv_id % 10 = 3 THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN conv_id % 10 = 3 THEN 0 ELSE chunks END AS chunks, CASE WHEN conv_id % 10 = 3 THEN 0 ELSE failed END AS failed_chunks FROM f""",
)


def _reembedded(g):
    """2 for entities that a second pass embeds, 1 for those whose vector holds; every fifth is gone by then."""
    alone = lambda e: g._replace(entities=e, edges=g.edges.limit(0), entity_documents=g.entity_documents.limit(0))
    none = g.entities.sparkSession.createDataFrame([], "entity_id string, sha256 string, vector array<double>")
    first = embedding.refreshed(alone(g.entities), none, lambda texts: [[1.0] for _ in texts])
    renamed = g.entities.where("access_count % 5 <> 1").withColumn("canonical_name", F.when(F.col("access_count") % 3 == 0, F.upper("canonical_name")).otherwise(F.col("canonical_name")))
    return embedding.refreshed(alone(renamed), first, lambda texts: [[2.0] for _ in texts]).select("entity_id", F.col("vector")[0].alias("pass"))


_add("e4_refreshed_vectors", _reembedded, 'SELECT id AS entity_id, CASE WHEN access_count % 3 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS pass FROM entities WHERE access_count % 5 <> 1')


# a repository: regions, nations that import them, customers that use nations' symbols; one region and every tenth customer go
def _repository(s, d):
    named = lambda t, c, k: read(s, d, t).select(F.concat(F.lit(k), c, F.lit(".py")).alias("path"))
    n, c = read(s, d, "nation"), read(s, d, "customer")
    files = named("region", "r_regionkey", "r").unionByName(named("nation", "n_nationkey", "n")).unionByName(named("customer", "c_custkey", "c"))
    files = files.select("path", F.lit("Python").alias("language"), F.lit("x").alias("content"), F.lit(0).cast("long").alias("content_hash"))
    edges = n.select(F.concat(F.lit("n"), "n_nationkey", F.lit(".py")).alias("src"), F.concat(F.lit("r"), "n_regionkey", F.lit(".py")).alias("dst"), F.lit("Import").alias("kind"))
    edges = edges.unionByName(c.select(F.concat(F.lit("c"), "c_custkey", F.lit(".py")).alias("src"), F.concat(F.lit("n"), "c_nationkey", F.lit(".py")).alias("dst"), F.lit("SymbolUsage").alias("kind")))
    defs = read(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("symbol"), F.concat(F.lit("n"), "s_nationkey", F.lit(".py")).alias("path"))
    uses = c.select(F.concat(F.lit("c"), "c_custkey", F.lit(".py")).alias("path"), F.concat(F.lit("s"), (F.col("c_custkey") % 50).cast("string")).alias("symbol"))
    return repo.RepoState(files, edges, defs, uses, s.createDataFrame([], "target string, importer string"))


_leaves = lambda df: df.where("path = 'r2.py' or path rlike '^c[0-9]*3[.]py$'").select("path")
QUERIES["a2_statistics_of_files"] = (
    lambda s, d: (lambda r: repo.statistics(repo.without_files(r, _leaves(r.files))))(_repository(s, d)),
    "SELECT (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 3) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region WHERE r_regionkey <> 2) AS files, (SELECT count(*) FROM nation WHERE n_regionkey <> 2) AS imports, (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 3) AS usages, (SELECT count(*) FROM supplier) AS symbols, (SELECT count(*) FROM customer WHERE c_custkey % 10 <> 3) AS files_with_usages, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS unresolved",
)
QUERIES["f21_unresolved_imports"] = (lambda s, d: (lambda r: repo.unresolved(repo.without_files(r, _leaves(r.files)), 10))(_repository(s, d)), "SELECT 'r2.py' AS target, count(*) AS waiters FROM nation WHERE n_regionkey = 2")
QUERIES["f23_inconsistencies_of_files"] = (
    lambda s, d: (lambda r: repo.inconsistencies(r._replace(files=r.files.join(_leaves(r.files), "path", "left_anti"))))(_repository(s, d)),
    "SELECT 'edge' AS what, 'r2.py' AS path UNION ALL SELECT k, 'c' || c_custkey || '.py' FROM customer, (VALUES ('edge'), ('symbol')) v(k) WHERE c_custkey % 10 = 3",
)
QUERIES["j23_waiting_imports"] = (
    lambda s, d: (lambda r: repo.with_file(repo.without_files(r, _leaves(r.files)), s.createDataFrame([("r2.py", "back")], "path string, content string")).edges)(_repository(s, d)),
    "SELECT 'n' || n_nationkey || '.py' AS src, 'r' || n_regionkey || '.py' AS dst, 'Import' AS kind FROM nation UNION ALL SELECT 'c' || c_custkey || '.py', 'n' || c_nationkey || '.py', 'SymbolUsage' FROM customer WHERE c_custkey % 10 <> 3",
)
_add("w8_rank_listing", lambda g: A.rank_listing(g.entities.select("id", "access_count"), [F.desc("access_count"), F.col("id")], 50), "SELECT row_number() OVER (ORDER BY access_count DESC, id) AS place, id, access_count FROM entities ORDER BY access_count DESC, id LIMIT 50")
_add("a24_share_of_top", lambda g: A.share_of_top(g.entities.select("id", "access_count"), "access_count").select("id", F.round("share", 9).alias("share")), "SELECT id, round(access_count / (SELECT max(access_count) FROM entities)::DOUBLE, 9) AS share FROM entities")
