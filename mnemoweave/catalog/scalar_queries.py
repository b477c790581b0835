"""Filters, set operations and scalars that the other catalogues leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemoweave import functions as X
from mnemoweave.operators import aggregates as A
from mnemoweave.operators import lookups as L
from mnemoweave.plans import ingestion, reflection, repo
from mnemoweave.plans.conversations import tool_counts
from mnemoweave.sources.capture import messages, transcript
from mnemoweave.testviews import SQL, graph, read

QUERIES: dict = {}


def _on(name, table, plan, sql):
    QUERIES[name] = (lambda spark, sf_dir: plan(read(spark, sf_dir, table)), sql)


def _graph(name, plan, sql):
    QUERIES[name] = (lambda spark, sf_dir: plan(graph(spark, sf_dir)), SQL + sql)


# filters
_on("f16_noise_files", "customer", lambda d: d.select("c_custkey", L.noise_file(F.concat(F.lit("src/"), F.element_at(F.array(F.lit("test_a.py"), F.lit("__init__.py"), F.lit("conftest.py"), F.lit("a_test.go"), F.lit("main.py")), (F.col("c_custkey") % 5 + 1).cast("int"))), F.lit("# note\nx = 1\n")).alias("noise")), "SELECT c_custkey, c_custkey % 5 <> 4 AS noise FROM customer")
_on("f18_filter_by_type", "events", lambda d: d.where(F.col("event_type") == "click").select("event_id"), "SELECT event_id FROM events WHERE event_type = 'click'")
_on("f19_valid_mentions", "documents", lambda d: d.select("doc_id", L.valid_mention(F.lower(F.element_at(F.split("text", " "), 1)), F.col("lang"), F.col("text"), ["en", "de"]).alias("valid")), "SELECT doc_id, coalesce(trim(split_part(text, ' ', 1)) <> '' AND contains(lower(text), lower(trim(split_part(text, ' ', 1)))) AND lang IN ('en', 'de'), false) AS valid FROM documents")
_on("f20_not_filler", "conversations", lambda d: d.where(L.not_filler(F.when(F.col("role") == "system", "Filler").otherwise(F.col("role")))).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE role <> 'system'")
_graph(
    "f22_review_queue", lambda g: reflection.review_queue(g.entities.select(F.col("id").alias("keep_id"), F.col("entity_type").alias("merge_id"), (F.col("access_count") / 50).alias("confidence"), F.lit("m").alias("method"))).select("keep_id", "confidence"),
    "SELECT id AS keep_id, access_count / 50.0::DOUBLE AS confidence FROM entities WHERE access_count / 50.0::DOUBLE < 0.95",
)
_on("f24_path_category", "nation", lambda d: d.select("n_nationkey", X.path_category(F.concat(F.element_at(F.array(F.lit("meetings/"), F.lit("Associates/"), F.lit("work/"), F.lit("other/"), F.lit("")), F.col("n_nationkey") % 5 + 1), F.lit("a.md"))).alias("category")), "SELECT n_nationkey, ['Episodic', 'Semantic', 'Procedural', 'Episodic', 'Episodic'][n_nationkey % 5 + 1] AS category FROM nation")
_on("f25_language", "nation", lambda d: d.select("n_nationkey", X.language_of(F.element_at(F.array(F.lit("a.py"), F.lit("b/C.RS"), F.lit("x.mjs"), F.lit("y.tsx"), F.lit("Makefile")), F.col("n_nationkey") % 5 + 1)).alias("language")), "SELECT n_nationkey, ['Python', 'Rust', 'JavaScript', 'TypeScriptTsx', 'Unknown'][n_nationkey % 5 + 1] AS language FROM nation")

# joins and aggregations
_graph(
    "j13_exact_links", lambda g: ingestion.linked(g, g.entities.select("id", F.lit("d").alias("source_document"), F.concat("canonical_name", F.lit(" and Nobody")).alias("text"), F.lit(False).alias("failed"), F.array(F.struct(F.upper("canonical_name").alias("name"), F.lit("Project").alias("entity_type")), F.struct(F.lit("Nobody").alias("name"), F.lit("person").alias("entity_type")), F.struct(F.lit("absent").alias("name"), F.lit("person").alias("entity_type"))).alias("tags"))).tagged,
    "SELECT id AS chunk_id, 0 AS pos, upper(canonical_name) AS name, 'Project' AS entity_type, id AS existing_id FROM entities UNION ALL SELECT id, 1, 'Nobody', 'Person', NULL FROM entities",
)
_on("a20_tool_usage", "events", lambda d: d.groupBy("user_id").agg(tool_counts(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: F.concat(s["event_type"], F.lit(": x")))).alias("tools")), "SELECT user_id, string_agg(CASE WHEN n > 1 THEN event_type || ' x' || n ELSE event_type END, ', ' ORDER BY n DESC, f) AS tools FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
_graph("a24_normalised_rank", lambda g: g.entities.select("id", F.round(F.col("access_count") / F.max("access_count").over(Window.partitionBy("entity_type")), 9).alias("share")), "SELECT id, round(access_count / (max(access_count) OVER (PARTITION BY entity_type))::DOUBLE, 9) AS share FROM entities")
_on("a27_rollup", "orders", lambda d: ingestion.rolled_up(d.select(F.element_at(F.create_map(*(F.lit(x) for x in ("F", "complete", "O", "partial", "P", "failed"))), F.col("o_orderstatus")).alias("status"), F.lit(2).alias("chunks"))), "SELECT count(*) AS documents, count_if(o_orderstatus = 'F') AS complete, count_if(o_orderstatus = 'O') AS partial, count_if(o_orderstatus = 'P') AS failed, CAST(count(*) * 2 AS BIGINT) AS chunks FROM orders")
_graph("a28_distinct_tags", lambda g: g.chunks.select("source_document", F.explode("tags").alias("tag")).distinct().groupBy("source_document").agg(F.count(F.lit(1)).alias("n")), "SELECT c.source_document, count(DISTINCT t.tag) AS n FROM chunks c JOIN tags t ON t.chunk_id = c.id GROUP BY ALL")

# windows
_on("w5_carry_forward", "conversations", lambda d: d.select("conv_id", "turn", F.last(F.when(F.col("turn") % 3 == 0, F.col("role")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn")).alias("section")), "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
_on("w7_first_last", "events", lambda d: d.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first"), F.max_by("event_type", "event_id").alias("last")), 'SELECT user_id, arg_min(event_type, event_id) AS "first", arg_max(event_type, event_id) AS "last" FROM events GROUP BY user_id')
_on("w9_last_history", "conversations", lambda d: A.last_within_budget(d, (F.length("text") / 4).cast("int"), 60, [F.desc("turn")], ["conv_id"]).select("conv_id", "turn", "place"), "SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place, sum(trunc(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 60 OR place = 1")
_on("w10_greedy_packing", "nation", lambda d: repo.packed(d.select(F.col("n_name").alias("id"), F.length("n_name").alias("tokens"), F.col("n_nationkey").alias("place")), 40).select("used", F.array_join("ids", ",").alias("ids")), None)

# sets
_graph("u1_alias_union", lambda g: g.entities.select("id", F.array_join(F.array_union("aliases", F.array("canonical_name", F.element_at("aliases", 1))), "|").alias("names")), "SELECT id, alias || '|' || canonical_name AS names FROM entities")
_graph("u2_tag_difference", lambda g: g.chunks.select("id", F.size(F.array_except("tags", F.array(F.lit("p1"), F.lit("p7")))).alias("n")), "SELECT c.id, CAST(count(t.tag) FILTER (t.tag NOT IN ('p1', 'p7')) AS INT) AS n FROM chunks c LEFT JOIN tags t ON t.chunk_id = c.id GROUP BY c.id")
_graph("u3_jaccard", lambda g: g.chunks.where(F.size("tags") > 0).select("id", F.round(X.jaccard(F.col("tags"), F.array(F.lit("none"), F.element_at("tags", 1))), 9).alias("j")), "SELECT chunk_id AS id, round(1.0::DOUBLE / (count(*) + 1), 9) AS j FROM tags GROUP BY chunk_id")
_graph("u5_peripheral", lambda g: g.entities.select("id").join(g.chunks.where("chunk_type = 'Decision'").select(F.explode("tags").alias("id")).distinct(), "id", "left_anti"), "SELECT id FROM entities WHERE id NOT IN (SELECT tag FROM tags WHERE chunk_id IN (SELECT id FROM chunks WHERE chunk_type = 'Decision'))")

# scalars
_on("x8_module_name", "nation", lambda d: d.select("n_nationkey", X.module_name(F.concat(F.element_at(F.array(F.lit("src/"), F.lit("lib/a/"), F.lit("b/")), F.col("n_nationkey") % 3 + 1), F.lower("n_name"), F.lit("/__init__.py"))).alias("module")), "SELECT n_nationkey, ['', 'a.', 'b.'][n_nationkey % 3 + 1] || lower(n_name) AS module FROM nation")
_on("x9_tool_summary", "events", lambda d: d.select("event_id", X.tool_summary(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("/a/f"), "user_id").alias("file_path")))).otherwise("{}")).alias("summary")), "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ': f' || user_id ELSE event_type END AS summary FROM events")
_graph("x11_descriptor", lambda g: g.entities.select("id", X.descriptor(F.col("canonical_name"), F.col("entity_type"), F.col("aliases"), F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("text")), "SELECT id, canonical_name || ' (' || entity_type || ') | aka: ' || alias || ' | Sources: a, b, c' AS text FROM entities")
_on("x14_day_in_text", "orders", lambda d: d.select("o_orderkey", X.day_in_text(F.concat(F.lit("due "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" or so"))).alias("at")), "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS at FROM orders")
_on("x15_iso_seconds", "events", lambda d: d.select("event_id", X.iso_seconds(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("at")), "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events")
_on("x18_distance_weight", "nation", lambda d: d.select("n_nationkey", X.distance_weight(F.col("n_nationkey")).alias("w")), "SELECT n_nationkey, 1 / pow(2.0::DOUBLE, greatest(n_nationkey - 1, 0)) AS w FROM nation")
_graph("x19_combined_score", lambda g: g.entities.select("id", F.round(X.combined_score(F.col("access_count") % 5 / 5, F.col("access_count"), F.lit(50.0)), 9).alias("score")), "SELECT id, round(0.8::DOUBLE * (access_count % 5 / 5.0::DOUBLE) + 0.2::DOUBLE * access_count / 50, 9) AS score FROM entities")
_graph("x22_set_hash", lambda g: g.chunks.select("id", (X.set_hash(F.col("tags")) == X.set_hash(F.reverse("tags"))).alias("same")), "SELECT id, true AS same FROM chunks")
_on("x38_type_label", "part", lambda d: d.select("p_partkey", X.type_label(X.type_name(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"Custom": "'), "p_type", F.lit('"}'))).otherwise("Person"))).alias("kind")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Custom(' || p_type || ')' ELSE 'Person' END AS kind FROM part")
_on("p17_plugin_transcript", "conversations", lambda d: d.select("conv_id", "turn", transcript(messages(F.to_json(F.struct(F.array(F.struct("role", "text")).alias("messages"))))).alias("t")), "SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN '' ELSE CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE role END || ': ' || text END AS t FROM conversations")


# answers of a language model, written from parts in three forms
def _answer(n):
    return (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('```json\n[{"Name": "'), n, F.lit('", "TYPE": "Tool"}]\n```')))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Sure! {'entities': [{'entity': '"), n, F.lit("', 'kind': 'Tool'},]}")))
        .otherwise(F.concat(F.lit('1. {"mention": "'), n, F.lit('"}\n2. {"name": "Second", "category": "Other"}')))
    )


_on(
    "x29_entities_in_answers", "part", lambda d: d.select("p_partkey", F.posexplode(X.entities_in(_answer(F.col("p_name")))).alias("pos", "e")).select("p_partkey", "pos", "e.name", "e.entity_type"),
    "SELECT p_partkey, 0 AS pos, p_name AS name, CASE WHEN p_partkey % 3 = 2 THEN 'concept' ELSE 'tool' END AS entity_type FROM part UNION ALL SELECT p_partkey, 1, 'Second', 'other' FROM part WHERE p_partkey % 3 = 2",
)
_on(
    "x31_batch_tags", "part", lambda d: d.select("p_partkey", F.posexplode(X.batch_tags(F.concat(F.lit('Here: {"1": [{"name": "'), "p_name", F.lit('"}], "3": []} done')), F.col("p_partkey") % 4 + 1)).alias("pos", "json")),
    """SELECT p_partkey, CAST(k AS INT) AS pos, CASE k WHEN 0 THEN '[{"name":"' || p_name || '"}]' WHEN 2 THEN '[]' END AS json FROM part, range(4) AS r(k) WHERE k <= p_partkey % 4""",
)
_LABELS = ("decision", "discussion", "background")
_on(
    "x32_batch_labels", "orders", lambda d: d.select("o_orderkey", F.array_join(X.batch_labels(F.concat(F.lit("1. Decision\n2) "), F.when(F.col("o_orderstatus") == "F", "unsure").otherwise("discussion - "), F.lit("\n\nbackground\n4: decision")), _LABELS, F.lit(3)), ",").alias("labels")),
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'decision,background,decision' ELSE 'decision,discussion,background' END AS labels FROM orders",
)
_on(
    "x33_single_label", "orders", lambda d: d.select("o_orderkey", X.single_label(F.concat(F.lit(" **"), F.when(F.col("o_orderstatus") == "F", "Decision").when(F.col("o_orderstatus") == "O", "nothing").otherwise("DISCUSSION"), F.lit("**. Since")), _LABELS).alias("label")),
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'decision' WHEN 'O' THEN 'background' ELSE 'discussion' END AS label FROM orders",
)
