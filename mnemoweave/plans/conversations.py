"""Conversations and coding sessions: exchanges, metadata, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemoweave.functions import basename, iso_seconds, token_estimate, tool_summary
from mnemoweave.plans.parsing import long_splitter, stripped

MOST_TOKENS = 1200
_BLOCKS = "array<struct<type:string,text:string,name:string,input:string>>"


def session_lines(raw: DataFrame) -> DataFrame:
    """(session, line_no, type, sessionId, cwd, gitBranch, timestamp, content) of rows (session, text): one JSON object a
    line; blank and malformed lines are left out."""
    each = raw.select("session", F.posexplode(F.split("text", "\n")).alias("line_no", "value")).where(F.trim("value") != "")
    ok = each.where(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"))
    field = lambda k: F.get_json_object("value", f"$.{k}").alias(k.split(".")[-1])
    return ok.select("session", "line_no", field("type"), field("sessionId"), field("cwd"), field("gitBranch"), field("timestamp"), field("message.content"))


def _content() -> tuple[Column, Column]:
    """(texts, tool summaries) of a line's content, a string or an array of blocks; other blocks are left out."""
    blocks = F.from_json("content", _BLOCKS)
    is_blocks = F.ltrim("content").startswith("[") & blocks.isNotNull()
    plain = F.array(stripped(F.col("content")))
    texts = F.when(is_blocks, F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: stripped(F.coalesce(b["text"], F.lit(""))))).otherwise(plain)
    tools = F.when(is_blocks, F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: tool_summary(b["name"], b["input"]))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t != ""), F.filter(tools, lambda t: t != "")


def exchanges(lines: DataFrame) -> DataFrame:
    """(session, number, timestamp, user_text, assistant_texts, tool_uses): a user line begins one.

    Those without any content are left out; the last is also if it holds tool uses only.
    """
    texts, tools = _content()
    kept = lines.where(F.col("type").isin("user", "assistant")).select("session", "line_no", "type", "timestamp", texts.alias("texts"), tools.alias("tools"))
    order = Window.partitionBy("session").orderBy("line_no")
    kept = kept.withColumn("n", F.sum(F.when(F.col("type") == "user", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = lambda kind, c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("line_no", F.col(c).alias("x"))))), lambda s: s["x"]))
    g = kept.groupBy("session", "n").agg(
        F.min_by("timestamp", "line_no").alias("timestamp"), F.array_join(ordered("user", "texts"), "\n").alias("user_text"),
        ordered("assistant", "texts").alias("assistant_texts"), ordered("assistant", "tools").alias("tool_uses"),
    )
    spoken = (F.col("user_text") != "") | (F.size("assistant_texts") > 0)
    is_last = F.col("n") == F.max("n").over(Window.partitionBy("session"))
    g = g.withColumn("last", is_last).where(spoken | (~F.col("last") & (F.size("tool_uses") > 0)))
    return g.withColumn("number", F.row_number().over(Window.partitionBy("session").orderBy("n"))).select("session", "number", "timestamp", "user_text", "assistant_texts", "tool_uses")


def tool_counts(tools: Column) -> Column:
    """``name xN`` for each tool of an array of summaries, the most used first, then by first use."""
    names = F.transform(tools, lambda t: F.trim(F.substring_index(t, ":", 1)))
    counted = F.transform(F.array_distinct(names), lambda n: F.struct((-F.size(F.filter(names, lambda m: m == n))).alias("k"), F.array_position(names, n).alias("at"), n.alias("n")))
    return F.array_join(F.transform(F.array_sort(counted), lambda s: F.when(s["k"] < -1, F.concat(s["n"], F.lit(" x"), -s["k"])).otherwise(s["n"])), ", ")


def session_info(lines: DataFrame) -> DataFrame:
    """(session, session_id, project_path, project_name, git_branch): the first of each, branch up to the line where id and
    directory are known; ``unknown`` without one."""
    real = lines.where(F.col("type").isNotNull() & ~F.col("type").isin("file-history-snapshot", "summary", "progress"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    at = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col("line_no")))
    found = real.groupBy("session").agg(first("sessionId"), first("cwd"), first("gitBranch"), at("gitBranch").alias("branch_at"), F.greatest(at("sessionId"), at("cwd")).alias("stop"), F.count_if(F.col("cwd").isNull() | F.col("sessionId").isNull()).alias("_m"))
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    branch = F.when(F.col("branch_at") <= F.coalesce("stop", F.col("branch_at")), F.col("gitBranch"))
    return found.select("session", known(F.col("sessionId")).alias("session_id"), known(F.col("cwd")).alias("project_path"), known(basename(F.col("cwd"))).alias("project_name"), known(branch).alias("git_branch"))


def session_metadata(lines: DataFrame) -> DataFrame:
    """``session_info`` with start and end times, the number of exchanges and a map of tool counts."""
    e = exchanges(lines)
    times = e.groupBy("session").agg(F.min_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("number"))).alias("start_time"), F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("number"))).alias("end_time"), F.count(F.lit(1)).alias("exchange_count"))
    tools = e.select("session", F.explode("tool_uses").alias("t")).groupBy("session", F.trim(F.substring_index("t", ":", 1)).alias("tool")).agg(F.count(F.lit(1)).alias("n"))
    tools = tools.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("tool", "n"))).alias("tool_usage_summary"))
    return session_info(lines).join(times, "session", "left").join(tools, "session", "left").fillna(0, ["exchange_count"])


def session_chunks(lines: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Raw chunks of sessions: one for each exchange, or parts of it where it is too long."""
    e = exchanges(lines).join(session_info(lines), "session")
    part = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    tools = F.when(F.size("tool_uses") > 0, F.concat(F.lit("[Tools: "), tool_counts(F.col("tool_uses")), F.lit("]")))
    text = F.concat_ws("\n\n", part("User: ", F.col("user_text")), part("Assistant: ", F.array_join("assistant_texts", "\n")), tools)
    source = F.concat(F.lit("claude-session://"), "project_name", F.lit("/"), "session_id")
    rows = e.select(source.alias("source_document"), "number", iso_seconds(F.col("timestamp")).alias("timestamp"), text.alias("text"))
    parts = F.when(token_estimate(F.col("text")) <= most, F.array("text")).otherwise(long_splitter(most)("text"))
    rows = rows.select("source_document", "number", "timestamp", F.posexplode(parts).alias("part", "text"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source_document", "number")))
    name = F.concat(F.lit("Exchange "), "number", F.when(F.col("n") > 1, F.concat(F.lit(" (part "), F.col("part") + 1, F.lit(")"))).otherwise(""))
    order = Window.partitionBy("source_document").orderBy("number", "part")
    return rows.select("source_document", (F.row_number().over(order) - 1).alias("position"), name.alias("section_name"), F.lit(None).cast("string").alias("speaker"), "timestamp", F.lit("Episodic").alias("memory_category"), "text")


def session_documents(sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, raw chunks) of session files (session, text): a document for each session id, its text that of its files."""
    lines = session_lines(sessions)
    source = F.concat(F.lit("claude-session://"), "project_name", F.lit("/"), "session_id").alias("source_document")
    named = session_info(lines).select("session", source).join(sessions.select("session", "text"), "session")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("session", "text"))), lambda s: s["text"]), "\n")
    return named.groupBy("source_document").agg(whole.alias("text")).withColumn("memory_category", F.lit("Episodic")), session_chunks(lines)


def chat_document(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, text): each chat as one text of ``**Role:** ...`` turns without system and blank ones."""
    spoken = turns.where((F.lower(role) != "system") & (stripped(F.col(text)) != ""))
    line = F.concat(F.lit("**"), F.initcap(role), F.lit(":** "), stripped(F.col(text)))
    return spoken.groupBy(conversation).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l")))), lambda s: s["l"]), "\n\n").alias("text"))


def chat_exchanges(turns: DataFrame) -> DataFrame:
    """(conv_id, exchange, turns, text): a user turn begins a new exchange; turns before the first are exchange 0."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    n = turns.withColumn("exchange", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order))
    return n.groupBy("conv_id", "exchange").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))


def oversize(chunks: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    return chunks.where(token_estimate(F.col("text")) > most)
