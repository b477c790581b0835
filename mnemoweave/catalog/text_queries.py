"""Scalars, parsing, conversations and vectors over the driver's text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemoweave import functions as X
from mnemoweave.plans import conversations as C
from mnemoweave.plans import embedding as E
from mnemoweave.plans import parsing as P
from mnemoweave.testviews import read

QUERIES: dict = {}


def _add(name, table, plan, sql):
    QUERIES[name] = (lambda spark, sf_dir: plan(read(spark, sf_dir, table), F.col("text")), sql)



_add("x2_token_estimate", "documents", lambda d, text: d.select("doc_id", X.token_estimate(text).alias("tokens")), r"SELECT doc_id, CAST(trunc(len(regexp_extract_all(text, '[^\s]+')) * 1.3) AS INT) AS tokens FROM documents")
_add("x4_shortened", "documents", lambda d, text: d.select("doc_id", X.shortened(text).alias("short")), r"SELECT doc_id, CASE WHEN length(text) > 200 THEN rtrim(left(text, 197)) || '...' ELSE text END AS short FROM documents")
_add("x6_quoted", "documents", lambda d, text: d.select("doc_id", X.quoted(text).alias("quoted")), r"SELECT doc_id, '> ' || replace(text, chr(10), chr(10) || '> ') AS quoted FROM documents")
_add("x7_path_stem", "pages", lambda d, text: d.select("page_id", X.path_stem(F.regexp_replace("url", r"[?#].*$", "")).alias("stem"), X.basename(F.regexp_replace("url", r"[?#].*$", "")).alias("name")), r"SELECT page_id, regexp_replace(name, '^(.+)\.[^.]*$', '\1') AS stem, name FROM (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages)")
_add("x10_stars", "orders", lambda d, text: d.select("o_orderkey", X.stars(F.col("o_totalprice"), F.lit(400000.0)).alias("stars")), "SELECT o_orderkey, repeat('★', CAST(least(greatest(ceil(o_totalprice / 400000.0::DOUBLE * 5), 1), 5) AS INT)) AS stars FROM orders")
_add("x12_day", "orders", lambda d, text: d.select("o_orderkey", X.day(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("day")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
_add("x13_day_seconds", "orders", lambda d, text: d.select("o_orderkey", X.day_seconds(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("at")), "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS at FROM orders")
_add("x17_decay", "events", lambda d, text: d.select("event_id", X.decayed(F.col("event_id") % 100, F.col("user_id") * 1000, 2000000, 30).alias("left")), "SELECT event_id, CAST(round((event_id % 100) * exp(greatest(2000000 - user_id * 1000, 0) * (-0.6931471805599453 / (30 * 86400)))) AS BIGINT) AS \"left\" FROM events")
_add("x21_content_hash", "documents", lambda d, text: d.select("doc_id", X.content_hash(text).alias("sha256")), "SELECT doc_id, sha256(text) AS sha256 FROM documents")
_add("x39_signatures", "documents", lambda d, text: d.select("doc_id", X.signatures(F.concat(F.lit("def a():\n  x\nclass B:\n"), text)).alias("lines")), r"SELECT doc_id, array_to_string(list_filter(string_split('def a():' || chr(10) || '  x' || chr(10) || 'class B:' || chr(10) || text, chr(10)), lambda l: regexp_matches(ltrim(l), '^(def |class |async def |fn )')), chr(10)) AS lines FROM documents")
_add("p2_document_type", "documents", lambda d, text: d.select("doc_id", P.document_type(text).alias("kind")), r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?m)^\*\*([^*:]+?):\*\*\s*|^\*\*([^*]+?)\*\*:\s*|^(Speaker\s+\d+):\s*') THEN 'meeting_transcript' WHEN len(regexp_extract_all(text, '(?m)^(?:#+\s*)?(\d{4}-\d{2}-\d{2}|\w+\s+\d{1,2},?\s+\d{4})$')) >= 2 THEN 'date_structured' WHEN regexp_matches(text, '(?m)^(#{2,3})\s+(.+)$') THEN 'markdown' ELSE 'plain_text' END AS kind FROM documents")
_add("p6_paragraphs", "documents", lambda d, text: d.select("doc_id", F.posexplode(P.paragraphs(text)).alias("n", "p")), r"SELECT doc_id, CAST(n - 1 AS INT) AS n, p FROM (SELECT doc_id, unnest(l) AS p, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents))")
_add("p7_sentences", "documents", lambda d, text: d.select("doc_id", F.posexplode(P.sentences(text)).alias("n", "sentence")), r"SELECT doc_id, CAST(n - 1 AS INT) AS n, sentence FROM (SELECT doc_id, unnest(l) AS sentence, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents))")
_add("p8_word_windows", "documents", lambda d, text: d.select("doc_id", F.posexplode(P.word_windows(text)).alias("n", "w")).select("doc_id", "n", F.md5("w").alias("md5")), r"SELECT doc_id, CAST(k AS INT) AS n, md5(array_to_string(w[k * 539 + 1:k * 539 + 615], ' ')) AS md5 FROM (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 615) / 539.0), 0) AS INT) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents) WHERE len(w) > 0)")
_add("p1_parse_plain", "documents", lambda d, text: P.parsed(d.select(F.concat(F.lit("doc-"), "doc_id").alias("source_document"), "text", F.lit("Episodic").alias("memory_category"))).groupBy("source_document").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars")), None)
_add("p11_chat_document", "conversations", lambda d, text: C.chat_document(d), r"SELECT conv_id, string_agg('**' || upper(left(role, 1)) || lower(substr(role, 2)) || ':** ' || regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE lower(role) <> 'system' AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' GROUP BY conv_id")
_add("w1_exchanges", "conversations", lambda d, text: C.chat_exchanges(d), "SELECT conv_id, exchange, count(*) AS turns, string_agg(text, chr(10) ORDER BY turn) AS text FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS exchange FROM conversations) GROUP BY conv_id, exchange")
_VEC = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"
QUERIES["t3k_vector_topk"] = (
    lambda spark, sf_dir: E.top_similar(read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id", read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"], 10).select("vec_id", F.round("similarity", 6).alias("similarity")),
    f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}) DESC, vec_id LIMIT 10",
)
_add("e3_file_pieces", "documents", lambda d, text: E.file_pieces(d.select(F.concat(F.lit("f"), "doc_id").alias("path"), F.concat(text, F.lit("\ndef a():\n pass")).alias("content"))).groupBy("path").agg(F.count(F.lit(1)).alias("pieces")), r"SELECT 'f' || doc_id AS path, CASE WHEN len(regexp_extract_all(c, '[^ \t\n\x0B\f\r]+')) <= 300 OR trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 1 ELSE 2 + len(regexp_extract_all(text, '(?m)^\s*(?:async\s+def |def |class |fn |pub fn |pub struct |struct |impl |func |function |export function |export class |interface )')) END AS pieces FROM (SELECT doc_id, text, text || chr(10) || 'def a():' || chr(10) || ' pass' AS c FROM documents)")


# documents of each form, written from orders: one for each customer, a part for each of its orders
def _written(name, part, before="", sql=""):
    """``part``: an order's lines, in Spark; ``sql``: (rows of the parsed document in SQL)."""

    def plan(spark, sf_dir):
        o = read(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
        docs = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part().alias("p")))), lambda x: x["p"]), "\n").alias("text"), F.count(F.lit(1)).alias("n")).where("n > 1")
        docs = docs.select(F.concat(F.lit("c"), "o_custkey").alias("source_document"), F.concat(F.lit(before), "text").alias("text"), F.lit("Episodic").alias("memory_category"))
        return P.parsed(docs).select("source_document", "position", "section_name", "speaker", "timestamp", "text")

    QUERIES[name] = (plan, "WITH o AS (SELECT *, 'c' || o_custkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) " + sql)


_SPEAKS = lambda: F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("**Clerk "), "o_orderkey", F.lit(":** "))).when(F.col("o_orderkey") % 3 == 1, F.lit("**Agent**: ")).otherwise(F.concat(F.lit("Speaker "), "o_orderkey", F.lit(": ")))
_written(
    "p3_transcript", lambda: F.concat(_SPEAKS(), F.lit("Order "), "o_orderkey", F.lit(" is\n"), "o_orderstatus", F.lit(".\n")), "Short notes\n",
    "SELECT d AS source_document, CAST(i - 1 AS INT) AS position, CAST(NULL AS VARCHAR) AS section_name, CASE o_orderkey % 3 WHEN 0 THEN 'Clerk ' || o_orderkey WHEN 1 THEN 'Agent' ELSE 'Speaker ' || o_orderkey END AS speaker, CAST(NULL AS BIGINT) AS \"timestamp\", 'Order ' || o_orderkey || ' is' || chr(10) || o_orderstatus || '.' AS text FROM o WHERE n > 1",
)
_written(
    "p4_markdown", lambda: F.concat(F.when(F.col("o_orderkey") % 2 == 0, "## ").otherwise("### "), F.lit("Order "), "o_orderkey", F.lit("\n\n Of "), "o_custkey", F.lit(" \n  \nPriority "), "o_orderpriority", F.lit("\n")), "",
    "SELECT d AS source_document, CAST(2 * (i - 1) + k AS INT) AS position, 'Order ' || o_orderkey AS section_name, CAST(NULL AS VARCHAR) AS speaker, CAST(NULL AS BIGINT) AS \"timestamp\", CASE k WHEN 0 THEN 'Of ' || o_custkey ELSE 'Priority ' || o_orderpriority END AS text FROM o, range(2) AS r(k) WHERE n > 1",
)
_written(
    "p5_date_sections", lambda: F.concat(F.when(F.col("o_orderkey") % 2 == 0, "## ").otherwise(""), "day", F.lit("\nOrder "), "o_orderkey", F.lit(".\n\nStatus "), "o_orderstatus", F.lit("\n")), "",
    "SELECT d AS source_document, CAST(i - 1 AS INT) AS position, strftime(o_orderdate, '%Y-%m-%d') AS section_name, CAST(NULL AS VARCHAR) AS speaker, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS \"timestamp\", 'Order ' || o_orderkey || '.' || chr(10) || chr(10) || 'Status ' || o_orderstatus AS text FROM o WHERE n > 1",
)


def _session_chunks(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").where("text is not null")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.lit("/home/x/proj").alias("cwd"), F.struct(F.col("text").alias("content")).alias("message")))
    raw = t.groupBy(F.col("conv_id").cast("string").alias("session")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return C.session_chunks(C.session_lines(raw)).select("source_document", "position", "section_name", "text")


_T = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
QUERIES["p9_session_chunks"] = (
    _session_chunks,
    f"""WITH t AS (SELECT conv_id, turn, role, {_T} AS x, sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL
), e AS (SELECT conv_id, n, concat_ws(chr(10) || chr(10), 'User: ' || string_agg(x, chr(10) ORDER BY turn) FILTER (WHERE role = 'user' AND x <> ''), 'Assistant: ' || string_agg(x, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant' AND x <> '')) AS text FROM t GROUP BY conv_id, n
), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS k FROM e WHERE text <> '')
SELECT 'claude-session://proj/s' || conv_id AS source_document, CAST(k - 1 AS INT) AS position, 'Exchange ' || k AS section_name, text FROM p""",
)
QUERIES["a22_file_similarity"] = (
    lambda spark, sf_dir: E.top_similar(read(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vector")), "label", read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"], 5).select("label", F.round("similarity", 6).alias("similarity")),
    f"SELECT label, round(max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC})), 6) AS similarity FROM embeddings GROUP BY label ORDER BY max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC})) DESC, label LIMIT 5",
)
