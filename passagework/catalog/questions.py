"""Registered queries: routing, prompts, answers and history."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.catalog.common import SQL_TOKEN, sql_strip, sql_text, table, texts, turns
from passagework.functions.fixed_values import (
    BASE_SYSTEM,
    NEWS_INSTRUCTION,
    PASSAGE_PREVIEW,
    ROUTES,
    TWEET_INSTRUCTION,
)
from passagework.functions.forecast import parse_forecast
from passagework.functions.prompts import (
    build_prompt,
    chat_prompt,
    messages,
    sentiment_instruction,
)
from passagework.functions.text import preview, strip_think
from passagework.operators.agents import batch_answer, route_queries, routing_counts
from passagework.operators.dealing import answer_by_cost
from passagework.operators.history import fit_history, prompt_history, prune_turns
from passagework.session import spread

HEADLINE = "Does this headline talk about the price going up?"
FORECAST = "Please predict the stock movement for the next week."


def _prompts(spark, sf_dir):
    """Every document as a question; its language decides the instruction."""
    docs = texts(spark, sf_dir)
    lang = F.col("lang")
    instruction = (
        F.when(lang == "en", sentiment_instruction(F.when(F.col("source") == "src0", "post")))
        .when(lang == "de", HEADLINE)
        .when(lang == "fr", FORECAST)
        .otherwise("")
    )
    return docs.select(
        F.col("doc_id").alias("query_id"), "lang", build_prompt(instruction, "text").alias("query")
    )


def _routed(spark, sf_dir):
    """Labelled toxic: the sentiment agent is asked for; low quality: the missing one."""
    labels = table(spark, sf_dir, "labels")
    wanted = (
        F.when(F.col("toxic") == 1, "sentiment")
        .when(F.col("quality") == 0, "forecaster")
        .otherwise("")
    )
    overrides = labels.select(F.col("doc_id").alias("query_id"), wanted.alias("agent_override"))
    prompts = _prompts(spark, sf_dir).join(overrides, "query_id", "left")
    return route_queries(prompts, override="agent_override")


def q_build_prompts(spark, sf_dir):
    return _prompts(spark, sf_dir).select("query_id", "query")


def q_route_queries(spark, sf_dir):
    return _routed(spark, sf_dir).select("query_id", "agent_override", "query_type", "agent_used")


def q_routing_counts(spark, sf_dir):
    return routing_counts(_routed(spark, sf_dir), "lang")


def count_words_model():
    """Stands in for a model: thinks, then reports the number of words it was given."""

    def answer(prompts):
        return [f"<think>reading</think>\n {len(p.split())} words " for p in prompts]

    return answer


def refusing_model():
    """Stands in for a model that fails on questions about a headline."""

    def answer(prompts):
        if any("headline" in p for p in prompts):
            raise ValueError("no headlines, please")
        return ["seen" for _ in prompts]

    return answer


def q_batch_answer(spark, sf_dir):
    routed = _routed(spark, sf_dir).withColumnRenamed("query", "prompt")
    models = {"sentiment": count_words_model, "multitask": refusing_model}
    return batch_answer(routed, models).select("query_id", "agent_used", "answer", "error")


def q_answer_by_cost(spark, sf_dir):
    """The same questions, equal ones asked once, dealt to tasks by what they cost."""
    routed = _routed(spark, sf_dir).withColumnRenamed("query", "prompt")
    models = {"sentiment": count_words_model, "multitask": refusing_model}
    return answer_by_cost(routed, models).select("query_id", "agent_used", "answer", "error")


def q_strip_think(spark, sf_dir):
    """Whole texts with no end marker, one, two, and one at the very end."""
    text, end = F.col("text"), F.lit("</think>")
    answer = (
        F.when(F.col("lang") == "en", F.concat(F.lit("<think>"), "source", end, F.lit("\n "), text))
        .when(F.col("lang") == "de", F.concat(text, end, text, end, F.col("source")))
        .when(F.col("lang") == "fr", F.concat(text, end))
        .otherwise(F.concat(F.lit(" \n"), text, F.lit("\t ")))
    )
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", strip_think(answer).alias("answer"))


def q_answer_preview(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return docs.select(
        "doc_id", preview("text").alias("answer"), preview("text", PASSAGE_PREVIEW, True).alias("passage")
    )


def q_prune_turns(spark, sf_dir):
    """The limit of 500 is longer than these conversations, so 3 is taken beside it."""
    said = turns(spark, sf_dir)
    few = prune_turns(said, 3).withColumn("kept", F.lit("3"))
    many = prune_turns(said).withColumn("kept", F.lit("500"))
    return few.unionByName(many).select("kept", "conv_id", "turn", "role", "content")


def q_prompt_history(spark, sf_dir):
    history = prompt_history(turns(spark, sf_dir), 4)
    return history.select("conv_id", F.posexplode("history").alias("pos", "m")).select(
        "conv_id", "pos", "m.role", "m.content"
    )


def q_fit_history(spark, sf_dir):
    kept = fit_history(turns(spark, sf_dir), 120)
    return kept.select(
        "conv_id", "turn", F.col("tokens").cast("bigint"), F.col("tokens_to_end").cast("bigint")
    )


def q_chat_messages(spark, sf_dir):
    """Every conversation's first message asked again after its newest ones."""
    said = turns(spark, sf_dir)
    opening = said.groupBy("conv_id").agg(F.min(F.struct("turn", "content")).alias("first"))
    asked = opening.join(prompt_history(said), "conv_id", "left")
    listed = messages(F.lit(BASE_SYSTEM), "history", F.col("first.content"))
    return asked.select("conv_id", listed.alias("m")).select(
        "conv_id", F.size("m").alias("n_messages"), chat_prompt("m").alias("prompt")
    )


def q_parse_forecast(spark, sf_dir):
    """Every order told as a forecast: its status the direction, its priority a concern."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    move = F.when(F.col("o_orderstatus") == "F", "Prediction: Up by ").when(
        F.col("o_orderstatus") == "O", "Prediction: down "
    )
    share = F.format_string("%d", F.floor(F.col("o_totalprice") / 10000))
    answer = F.concat(
        F.lit("[Positive Developments]:\n1. order "), F.col("o_orderkey").cast("string"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "\n").otherwise(
            F.concat(F.lit("\n\n[Potential Concerns]:\n1. "), "o_orderpriority", F.lit("\n\n"))
        ),
        F.lit("[Prediction & Analysis]:\n"),
        F.coalesce(F.concat(move, share, F.lit("%.")), F.lit("Nothing to predict.")),
        F.lit(" Analysis: steady."),
    )
    return orders.select("o_orderkey", parse_forecast(answer).alias("p")).select(
        "o_orderkey", "p.*"
    )


QUERIES = {
    "build_prompts": q_build_prompts,
    "route_queries": q_route_queries,
    "routing_counts": q_routing_counts,
    "batch_answer": q_batch_answer,
    "answer_by_cost": q_answer_by_cost,
    "strip_think": q_strip_think,
    "answer_preview": q_answer_preview,
    "prune_turns": q_prune_turns,
    "prompt_history": q_prompt_history,
    "fit_history": q_fit_history,
    "chat_messages": q_chat_messages,
    "parse_forecast": q_parse_forecast,
}

_PROMPTS = f"""
prompts AS (
    SELECT doc_id AS query_id, lang,
           CASE WHEN lang = 'en' AND source = 'src0' THEN {sql_text(TWEET_INSTRUCTION)}
                WHEN lang = 'en' THEN {sql_text(NEWS_INSTRUCTION)}
                WHEN lang = 'de' THEN {sql_text(HEADLINE)}
                WHEN lang = 'fr' THEN {sql_text(FORECAST)}
                ELSE '' END || chr(10) || 'Input: ' || text AS query
    FROM documents)
"""


def _sql_route(column: str) -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), {sql_text(w)})" for w in words)
        + f" THEN '{agent}'"
        for agent, words in ROUTES
    )
    return f"CASE {cases} ELSE 'multitask' END"


_ROUTED = f"""
{_PROMPTS},
overrides AS (
    SELECT doc_id AS query_id,
           CASE WHEN toxic = 1 THEN 'sentiment' WHEN quality = 0 THEN 'forecaster' ELSE '' END
               AS agent_override
    FROM labels),
typed AS (
    SELECT p.*, agent_override,
           coalesce(nullif(agent_override, ''), {_sql_route('query')}) AS query_type
    FROM prompts p LEFT JOIN overrides USING (query_id)),
routed AS (
    SELECT *, CASE WHEN query_type = 'forecaster' THEN 'multitask' ELSE query_type END
              AS agent_used
    FROM typed)
"""

_HISTORY = """
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest
    FROM conversations)
"""

_BATCH = f"""
        WITH {_ROUTED}
        SELECT query_id, agent_used,
               CASE WHEN agent_used = 'sentiment'
                    THEN len(regexp_extract_all(query, {SQL_TOKEN})) || ' words'
                    WHEN NOT contains(query, 'headline') THEN 'seen' END AS answer,
               CASE WHEN agent_used = 'multitask' AND contains(query, 'headline')
                    THEN 'ValueError: no headlines, please' END AS error
        FROM routed"""

ORACLES = {
    "build_prompts": f"WITH {_PROMPTS} SELECT query_id, query FROM prompts",
    "route_queries": f"""
        WITH {_ROUTED} SELECT query_id, agent_override, query_type, agent_used FROM routed""",
    "routing_counts": f"""
        WITH {_ROUTED}
        SELECT lang, agent_used, count(*) AS n_queries FROM routed GROUP BY ALL""",
    "batch_answer": _BATCH,
    "answer_by_cost": _BATCH,
    "strip_think": f"""
        WITH answers AS (
            SELECT doc_id,
                   CASE lang
                       WHEN 'en' THEN '<think>' || source || '</think>' || chr(10) || ' ' || text
                       WHEN 'de' THEN text || '</think>' || text || '</think>' || source
                       WHEN 'fr' THEN text || '</think>'
                       ELSE ' ' || chr(10) || text || chr(9) || ' ' END AS answer
            FROM documents)
        SELECT doc_id,
               {sql_strip('''CASE WHEN instr(answer, '</think>') > 0
                                  THEN substr(answer, instr(answer, '</think>') + 8)
                                  ELSE answer END''')} AS answer
        FROM answers""",
    "answer_preview": """
        SELECT doc_id,
               CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS answer,
               text[1:80] || '...' AS passage
        FROM documents""",
    "prune_turns": f"""
        WITH {_HISTORY}
        SELECT '3' AS kept, conv_id, turn, role, text AS content FROM ranked WHERE newest <= 3
        UNION ALL
        SELECT '500', conv_id, turn, role, text FROM ranked WHERE newest <= 500""",
    "prompt_history": f"""
        WITH {_HISTORY}
        SELECT conv_id,
               CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos,
               role, text AS content
        FROM ranked WHERE newest <= 4""",
    "fit_history": f"""
        WITH counted AS (
            SELECT conv_id, turn,
                   greatest(len(regexp_extract_all(text, {SQL_TOKEN})), 1) AS tokens
            FROM conversations),
        summed AS (
            SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC
                                             ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_to_end
            FROM counted)
        SELECT * FROM summed WHERE tokens_to_end <= 120""",
    "chat_messages": f"""
        WITH {_HISTORY},
        opening AS (SELECT conv_id, arg_min(text, turn) AS first FROM conversations GROUP BY 1),
        past AS (
            SELECT conv_id, CAST(count(*) AS INTEGER) AS n,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10),
                              '' ORDER BY turn) AS turns
            FROM ranked WHERE newest <= 20 GROUP BY conv_id)
        SELECT conv_id, n + 2 AS n_messages,
               '<|im_start|>system' || chr(10) || {sql_text(BASE_SYSTEM)} || '<|im_end|>' || chr(10)
               || turns || '<|im_start|>user' || chr(10) || first || '<|im_end|>' || chr(10)
               || '<|im_start|>assistant' || chr(10) AS prompt
        FROM opening JOIN past USING (conv_id)""",
    "parse_forecast": """
        WITH told AS (
            SELECT *, CAST(floor(o_totalprice / 10000) AS BIGINT) AS share,
                   o_orderstatus IN ('F', 'O') AS moves
            FROM orders)
        SELECT o_orderkey,
               '1. order ' || o_orderkey AS positive_developments,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN '1. ' || o_orderpriority END
                   AS potential_concerns,
               CASE o_orderstatus
                   WHEN 'F' THEN 'Prediction: Up by ' || share || '%.'
                   WHEN 'O' THEN 'Prediction: down ' || share || '%.'
                   ELSE 'Nothing to predict.' END || ' Analysis: steady.' AS prediction_analysis,
               CASE o_orderstatus WHEN 'F' THEN 'up' WHEN 'O' THEN 'down' END AS direction,
               CASE WHEN moves THEN CAST(share AS DOUBLE) END AS percent
        FROM told""",
}
