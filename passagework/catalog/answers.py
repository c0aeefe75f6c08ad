"""Registered queries: questions answered from end to end, and their evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from passagework.catalog import retrieval
from passagework.catalog.common import (
    SQL_TOKEN,
    SQL_WS,
    documents,
    sql_distance,
    sql_text,
    sql_vectors,
    table,
    turns,
)
from passagework.catalog.evaluation import (
    METRICS,
    PUBLISHED,
    SCORE,
    balance,
    cases,
    seven_classes,
    sql_cases,
    sql_class,
    sql_scores,
)
from passagework.catalog.questions import HEADLINE, count_words_model
from passagework.functions.fixed_values import (
    BASE_SYSTEM,
    CONTEXT_END,
    CONTEXT_INTRO,
    EMPTY_INDEX_WARNING,
    PUBLISHED_SCORES,
)
from passagework.operators.chunking import index_documents
from passagework.operators.embedding import HashedEmbedder
from passagework.operators.metrics import avg_keyword_score, graded
from passagework.plans.answer import answer_queries
from passagework.plans.batch import resume_batch, run_batch
from passagework.plans.evaluate import (
    cases_result,
    evaluate_cases,
    evaluate_tasks,
    headline_examples,
    phrasebank_examples,
    scored_examples,
    seven_class_examples,
    tweet_examples,
)
from passagework.plans.replay import replay_conversations
from passagework.session import shared_folder, spread, written
from passagework.sources.index_store import empty_index
from passagework.sources.turn_log import load_turns

EMBEDDER = HashedEmbedder()
MAX_BROADCAST_LABELS = 1_000_000
MODELS = {"sentiment": count_words_model, "multitask": count_words_model}


def _questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def q_answer_queries(spark, sf_dir):
    index = index_documents(documents(spark, sf_dir), EMBEDDER)
    answers = answer_queries(
        _questions(spark, sf_dir), index, MODELS, embedder=EMBEDDER, dim=EMBEDDER.dim
    )
    return answers.select(
        "query_id", "answer", "agent_used", "query_type", "rag_used", "rag_status", "error"
    )


def q_batch_files(spark, sf_dir):
    """A file of questions, answered into a file of answers, read back."""
    questions, answers = shared_folder(spark, "questions"), shared_folder(spark, "answers")
    _questions(spark, sf_dir).select("query").write.json(questions + ".jsonl")
    index = index_documents(documents(spark, sf_dir), EMBEDDER)
    run_batch(
        spark, questions + ".jsonl", answers, index, MODELS, embedder=EMBEDDER, dim=EMBEDDER.dim
    )
    fields = "query string, answer string, agent_used string, rag_status string, error string"
    return spark.read.schema(fields).json(answers)


def q_batch_resume(spark, sf_dir):
    """The questions of half the alphabet answered, then a file of all with blank and broken lines; what
    the answers and the log then hold."""
    questions, answers = shared_folder(spark, "questions"), shared_folder(spark, "answers")
    log = shared_folder(spark, "batch-log")
    asked = _questions(spark, sf_dir)
    index = written(index_documents(documents(spark, sf_dir), EMBEDDER), "index")
    line = F.to_json(F.struct("query"))
    asked.where("query < 'N'").select(line).write.text(questions + "-half.jsonl")
    broken = F.array(line, F.lit(" "), F.lit('{"query": '), F.lit('{"question": "?"}'))
    asked.select(F.explode(broken)).write.text(questions + "-all.jsonl")
    for part in ("half", "all"):
        resume_batch(spark, f"{questions}-{part}.jsonl", answers, index, MODELS, log=log,
                     slices=2, embedder=EMBEDDER, dim=EMBEDDER.dim)
    fields = "query string, answer string, agent_used string, rag_status string, error string"
    replies = spark.read.schema(fields).json(answers).select(F.lit("answers").alias("file"), "*")
    logged = load_turns(spark, log).select(
        F.lit("log").alias("file"), F.when(F.col("role") == "user", F.col("content")).alias("query"),
        F.when(F.col("role") == "assistant", F.col("content")).alias("answer"),
        *[F.lit(None).cast("string").alias(c) for c in ("agent_used", "rag_status", "error")],
    )
    return replies.unionByName(logged)


def extracting_reader():
    """Stands in for a model: says what the first passage it was given says."""

    def answer(prompts):
        replies = []
        for prompt in prompts:
            if CONTEXT_INTRO not in prompt:
                replies.append("No context.")
                continue
            context = prompt.split(CONTEXT_INTRO, 1)[1].split(CONTEXT_END, 1)[0]
            first = context.split("\n\n[2] source=", 1)[0]
            replies.append(first.split("\n", 1)[1])
        return replies

    return answer


def _qa_cases(spark, sf_dir):
    """Benchmark texts as questions; their first, third and fifth words are expected."""
    words = F.regexp_extract_all("query", F.lit("[A-Za-z]+"), F.lit(0))
    level = F.element_at(
        F.array(*[F.lit(d) for d in ("core", "intermediate", "advanced")]),
        (F.pmod("query_id", F.lit(3)) + 1).cast("int"),
    )
    keywords = F.filter(
        F.array(*[F.get(words, i) for i in (0, 2, 4)]), lambda w: w.isNotNull()
    )
    return _questions(spark, sf_dir).select(
        F.col("query_id").alias("example_id"), F.col("query").alias("question"),
        keywords.alias("keywords"), level.alias("difficulty"),
    )


def _qa_answered(spark, sf_dir):
    """Questions put to an index of all chunks, answered by what was retrieved."""
    index = index_documents(documents(spark, sf_dir), EMBEDDER)
    readers = {"sentiment": extracting_reader, "multitask": extracting_reader}
    answers = answer_queries(
        _questions(spark, sf_dir), index, readers, embedder=EMBEDDER, dim=EMBEDDER.dim,
        columns=["answer"],
    )
    recorded = answers.select(F.col("query_id").alias("example_id"), "answer", "agent_used")
    return evaluate_cases(_qa_cases(spark, sf_dir), recorded)


def q_qa_cases(spark, sf_dir):
    """Every question with its answer and the keywords retrieval has found for it."""
    hits = F.array_join("keywords_hit", "|").alias("keywords_hit")
    return _qa_answered(spark, sf_dir).select(
        "example_id", "question", "difficulty", "response", "agent_used", "score", hits
    )


def q_qa_result(spark, sf_dir):
    result = cases_result(_qa_answered(spark, sf_dir), "difficulty")
    n = F.try_element_at("routing", F.lit("multitask")).alias("n_multitask")
    return result.select("task", "difficulty", "n_samples", "avg_keyword_score", n)


def q_evaluate_with_passages(spark, sf_dir):
    """Labelled documents asked about by their text, beside an index of the labelled ones
    of good quality: a document that is in it is found by its own text and judged good."""
    docs = documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    if labels.count() <= MAX_BROADCAST_LABELS:
        labelled = docs.join(F.broadcast(labels), "doc_id")
    else:  # the documents are shuffled, once
        labelled = written(docs.join(labels, "doc_id"), "labelled")
    index = index_documents(
        labelled.where("quality = 1").select("doc_id", "text", "metadata"), EMBEDDER, auto_chunk=False
    )
    asked = labelled.select(
        F.col("doc_id").alias("example_id"), F.lit(HEADLINE).alias("instruction"),
        F.col("text").alias("input"),
        F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("output"),
    )
    examples = headline_examples(asked)
    answers = answer_queries(
        examples.withColumn("query_id", F.col("example_id")), index,
        {"multitask": echoing_judge, "sentiment": echoing_judge}, embedder=EMBEDDER,
        dim=EMBEDDER.dim, keep=["task", "example_id"], columns=["answer"],
    )
    results = evaluate_tasks(examples, answers)
    return results.select("task", "n_samples", "accuracy", "f1_weighted", "f1_binary")


def echoing_judge():
    """Stands in for a model: yes if the first passage is the text it is asked about."""

    def answer(prompts):
        replies = []
        for prompt in prompts:
            context = prompt.split(CONTEXT_INTRO, 1)[-1].split(CONTEXT_END, 1)[0]
            passage = context.split("\n\n[2] source=", 1)[0].split("\n", 1)[-1]
            asked = prompt.rsplit("\nInput: ", 1)[-1] if CONTEXT_INTRO in prompt else ""
            text = asked.rsplit("<|im_end|>\n<|im_start|>assistant", 1)[0]
            replies.append("Yes." if passage and passage == text else "No.")
        return replies

    return answer


def q_answer_with_history(spark, sf_dir):
    """Every conversation's first message asked again, with what fits of its history."""
    said = turns(spark, sf_dir)
    opening = said.groupBy("conv_id").agg(F.min(F.struct("turn", "content")).alias("first"))
    queries = opening.select(
        F.col("conv_id").alias("query_id"), "conv_id", F.col("first.content").alias("query")
    )
    answers = answer_queries(
        queries, empty_index(spark), MODELS, said, EMBEDDER, history=3, budget=150
    )
    return answers.select("conv_id", "answer", "rag_status", "rag_warning")


def remembering_model():
    """Stands in for a model: a number made of the answer before, the question's words
    and how many messages it was shown."""

    def answer(prompts):
        answers = []
        for prompt in prompts:
            turns = prompt.split("<|im_start|>")[2:-1]
            before = [t for t in turns if t.startswith("assistant")]
            last = int(before[-1].split()[1]) if before else 0
            asked = turns[-1].removeprefix("user\n").rsplit("<|im_end|>", 1)[0]
            words = len(re.findall("[^ \t\n\r\f\x0b]+", asked))
            answers.append(f"{(31 * last + words + 7 * (len(turns) - 1)) % 9973} so far")
        return answers

    return answer


def q_replay_conversations(spark, sf_dir):
    """What users said, answered in turn beside what was said before; read from the log."""
    said = turns(spark, sf_dir)
    queries = said.where("role = 'user'").select(
        "conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("query_id"),
        F.col("content").alias("query"),
    )
    folder, log = shared_folder(spark, "replay"), shared_folder(spark, "replay-log")
    replay_conversations(
        queries, empty_index(spark), {"multitask": remembering_model, "sentiment": remembering_model},
        folder, said.where("role = 'system'"), EMBEDDER, history=4, order="turn", log=log,
    )
    kept = load_turns(spark, log)
    return kept.select(F.col("conv_id").cast("bigint"), "turn", "role", "content")


def instruction_reader():
    """Stands in for a model: judges by the wording of the question alone."""

    def answer(prompts):
        asked = [p.rsplit("<|im_start|>user\n", 1)[1] for p in prompts]
        return ["Positive." if "tweet" in q else "quite negative" if "BUILDING" in q else "?"
                for q in asked]

    return answer


def q_evaluate_answers(spark, sf_dir):
    """Customers as scored sentences: prompts, retrieval, answers, metrics.

    Each document is one passage of the index here.
    """
    customers = spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.col("c_custkey").alias("example_id"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("sentence"),
        balance().alias("sentiment_score"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "post").otherwise("headline").alias("format"),
    )
    examples = scored_examples(customers)
    index = index_documents(documents(spark, sf_dir), EMBEDDER, auto_chunk=False)
    answers = answer_queries(
        examples.withColumn("query_id", F.col("example_id")),
        index,
        {"sentiment": instruction_reader},
        embedder=EMBEDDER,
        dim=EMBEDDER.dim,
        keep=["task", "example_id"],
        columns=["answer"],
    )
    results = evaluate_tasks(examples, answers)
    n_sentiment = F.try_element_at("routing", F.lit("sentiment"))
    return results.withColumn("n_sentiment", n_sentiment).drop("routing", "f1_binary")


def last_digit_reader():
    """Stands in for a model: judges by the last digit of the question, fails on a 9."""

    def answer(prompts):
        digits = [p.rsplit("<|im_end|>", 1)[0][-1] for p in prompts]
        if "9" in digits:
            raise ValueError("no nines, please")
        return ["Yes, it is Positive" if d in "0123" else "negative, I fear" if d in "456" else "no"
                for d in digits]

    return answer


def q_evaluate_all_tasks(spark, sf_dir):
    """The five labelled tasks, from tables to scores beside the published ones.

    Without an index; questions that end in 9 get no answer and count as wrong.
    """
    customers = spread(table(spark, sf_dir, "customer"), "c_custkey").select(
        F.col("c_custkey").alias("example_id"),
        F.concat_ws(" ", "c_mktsegment", "c_name").alias("sentence"),
        F.pmod("c_nationkey", F.lit(3)).alias("label"),
        balance().alias("sentiment_score"),
        F.col("c_mktsegment").alias("format"),
        seven_classes().alias("classes"),
    )
    renamed = customers.withColumnRenamed("sentence", "text")
    news = customers.select(
        "example_id", F.col("sentence").alias("news"), F.col("classes").alias("label")
    )
    headlines = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("example_id"),
        F.lit(HEADLINE).alias("instruction"),
        F.concat(F.lit("document "), "doc_id").alias("input"),
        F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("output"),
    )
    examples = (
        phrasebank_examples(customers)
        .unionByName(scored_examples(customers))
        .unionByName(tweet_examples(renamed))
        .unionByName(seven_class_examples(news))
        .unionByName(headline_examples(headlines))
    )
    models = {"sentiment": last_digit_reader, "multitask": last_digit_reader}
    answers = answer_queries(
        examples.withColumn("query_id", F.concat_ws("/", "task", "example_id")),
        empty_index(spark),
        models,
        embedder=EMBEDDER,
        keep=["task", "example_id"],
        columns=["answer"],
    ).where(F.col("error").isNull())
    published = spark.createDataFrame(
        PUBLISHED_SCORES, "task string, system string, score double"
    )
    results = evaluate_tasks(examples, answers, published).select(
        "*",
        F.try_element_at("routing", F.lit("sentiment")).alias("n_sentiment"),
        F.try_element_at("routing", F.lit("multitask")).alias("n_multitask"),
        F.explode("published").alias("p"),
    )
    return results.select(
        *[c for c in results.columns if c not in ("routing", "published", "p")],
        "p.system",
        "p.reference",
        F.round("p.delta", 6).alias("delta"),
    )


def q_evaluate_questions(spark, sf_dir):
    """The open questions put to every document; those without a label have no answer.

    A text answers all of them, so it is graded where it lies: it is not copied for
    each case, and only labels meet the documents.
    """
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = docs.select("doc_id", graded("text", cases()).alias("answered"),
                         graded(F.lit(""), cases()).alias("silent"))
    put = scored.join(labelled, "doc_id", "left").select(
        F.inline(F.when(F.col("labelled"), F.col("answered")).otherwise(F.col("silent")))
    )
    scores = avg_keyword_score(put, "difficulty")
    return scores.withColumn("avg_keyword_score", F.round("avg_keyword_score", 6))


QUERIES = {
    "answer_queries": q_answer_queries,
    "answer_with_history": q_answer_with_history,
    "batch_files": q_batch_files,
    "batch_resume": q_batch_resume,
    "replay_conversations": q_replay_conversations,
    "qa_cases": q_qa_cases,
    "qa_result": q_qa_result,
    "evaluate_with_passages": q_evaluate_with_passages,
    "evaluate_answers": q_evaluate_answers,
    "evaluate_all_tasks": q_evaluate_all_tasks,
    "evaluate_questions": q_evaluate_questions,
}

_PROMPT = f"""
    '<|im_start|>system' || chr(10) || {sql_text(BASE_SYSTEM)}
    || CASE WHEN context_block IS NULL THEN '' ELSE
         {sql_text(CONTEXT_INTRO)} || context_block || {sql_text(CONTEXT_END)} END
    || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
    || '<|im_start|>assistant' || chr(10)
"""
_ANSWERS = f"""
{retrieval.STATUSES},
answers AS (
    SELECT query_id, text, rag_status, n_passing > 0 AS rag_used,
           len(regexp_extract_all({_PROMPT}, {SQL_TOKEN})) || ' words' AS answer
    FROM statuses)
"""

_QA = f"""
{retrieval.STATUSES},
qa AS (
    SELECT q.query_id AS example_id, q.text AS question,
           ['core', 'intermediate', 'advanced'][q.query_id % 3 + 1] AS difficulty,
           coalesce(m.text, 'No context.') AS response,
           list_filter(list_transform([1, 3, 5],
                           lambda i: regexp_extract_all(q.text, '[A-Za-z]+')[i]),
                       lambda w: w IS NOT NULL) AS keywords
    FROM questions q LEFT JOIN (
        SELECT query_id, text FROM numbered WHERE passing AND i = 1) m USING (query_id)),
graded AS (
    SELECT *, list_filter(keywords, lambda w: contains(lower(response), lower(w))) AS hit FROM qa),
scored AS (
    SELECT *, round(CAST(len(hit) AS DOUBLE) / nullif(len(keywords), 0), 4) AS score FROM graded)
"""

ORACLES = {
    "batch_resume": f"""
        WITH {_ANSWERS}
        SELECT 'answers' AS file, text AS query, answer, 'multitask' AS agent_used, rag_status,
               NULL::VARCHAR AS error FROM answers
        UNION ALL
        SELECT 'answers', NULL, NULL, NULL, NULL, 'line is not a JSON object with a query'
        FROM benchmark, range(2)
        UNION ALL SELECT 'log', text, NULL, NULL, NULL, NULL FROM answers
        UNION ALL SELECT 'log', NULL, answer, NULL, NULL, NULL FROM answers""",
    "qa_cases": f"""
        WITH {_QA}
        SELECT example_id, question, difficulty, trim(response, {SQL_WS}) AS response,
               'multitask' AS agent_used, score, array_to_string(hit, '|') AS keywords_hit
        FROM scored""",
    "qa_result": f"""
        WITH {_QA}
        SELECT 'QA' AS task, difficulty, count(*) AS n_samples,
               round(avg(score), 4) AS avg_keyword_score, count(*) AS n_multitask
        FROM scored GROUP BY difficulty""",
    "evaluate_with_passages": f"""
        WITH labelled AS (
            SELECT d.doc_id, text, quality FROM documents d JOIN labels USING (doc_id)),
        asked AS (
            SELECT doc_id AS query_id, {sql_text(HEADLINE)} || chr(10) || 'Input: ' || text AS text
            FROM labelled),
        good AS (SELECT doc_id, text FROM labelled WHERE quality = 1),
        {sql_vectors('asked_vectors', 'asked', 'query_id')},
        {sql_vectors('good_vectors', 'good', 'doc_id')},
        pairs AS (
            SELECT query_id, doc_id, {sql_distance('q.v', 'x.v')} AS score
            FROM asked_vectors q, good_vectors x),
        nearest AS (
            SELECT query_id, text FROM pairs JOIN good USING (doc_id) WHERE score <= 1.2::DOUBLE
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, md5(
                length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || '::0:' || text)) = 1),
        answered AS (
            SELECT 'Headline' AS task, CAST(CAST(quality = 1 AS INTEGER) AS VARCHAR) AS target,
                   CAST(CAST(coalesce(n.text = l.text, false) AS INTEGER) AS VARCHAR) AS prediction
            FROM labelled l LEFT JOIN nearest n ON n.query_id = l.doc_id),
        {sql_scores('answered', 'task')}
        SELECT task, n_samples, accuracy, f1_weighted, f1_binary FROM (
            SELECT task, {METRICS.format(d=4)},
                   round(coalesce(max(f1) FILTER (label = '1'), 0), 4) AS f1_binary
            FROM scores GROUP BY task)""",
    "answer_queries": f"""
        WITH {_ANSWERS}
        SELECT query_id, answer, 'multitask' AS agent_used, 'multitask' AS query_type, rag_used,
               rag_status, NULL::VARCHAR AS error
        FROM answers""",
    "batch_files": f"""
        WITH {_ANSWERS}
        SELECT text AS query, answer, 'multitask' AS agent_used, rag_status, NULL::VARCHAR AS error
        FROM answers""",
    "answer_with_history": f"""
        WITH counted AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest,
                   sum(greatest(len(regexp_extract_all(text, {SQL_TOKEN})), 1)) OVER (
                       PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING)
                       AS tokens_to_end
            FROM conversations),
        opening AS (SELECT conv_id, arg_min(text, turn) AS first FROM conversations GROUP BY 1),
        past AS (
            SELECT conv_id,
                   string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10),
                              '' ORDER BY turn) AS turns
            FROM counted JOIN opening USING (conv_id)
            WHERE newest <= 3 AND tokens_to_end + {len(BASE_SYSTEM.split())}
                  + len(regexp_extract_all(first, {SQL_TOKEN})) <= 150
            GROUP BY conv_id),
        prompts AS (
            SELECT conv_id,
                   '<|im_start|>system' || chr(10) || {sql_text(BASE_SYSTEM)} || '<|im_end|>'
                   || chr(10) || coalesce(turns, '') || '<|im_start|>user' || chr(10) || first
                   || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt
            FROM opening LEFT JOIN past USING (conv_id))
        SELECT conv_id, len(regexp_extract_all(prompt, {SQL_TOKEN})) || ' words' AS answer,
               'empty_index' AS rag_status, {sql_text(EMPTY_INDEX_WARNING)} AS rag_warning
        FROM prompts""",
    "replay_conversations": f"""
        WITH RECURSIVE q AS (
            SELECT c.conv_id, text, coalesce(n_system, 0) AS n_system,
                   row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS n,
                   len(regexp_extract_all(text, {SQL_TOKEN})) AS words
            FROM conversations c LEFT JOIN (
                SELECT conv_id, count(*) AS n_system FROM conversations
                WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = c.conv_id
            WHERE role = 'user'),
        a AS (
            SELECT conv_id, n, (words + 7 * least(4, n_system)) % 9973 AS answer FROM q WHERE n = 1
            UNION ALL
            SELECT q.conv_id, q.n,
                   (31 * answer + words + 7 * least(4, n_system + 2 * (q.n - 1))) % 9973
            FROM a JOIN q ON q.conv_id = a.conv_id AND q.n = a.n + 1)
        SELECT conv_id, n_system + 2 * (n - 1) AS turn, 'user' AS role, text AS content FROM q
        UNION ALL
        SELECT conv_id, n_system + 2 * n - 1, 'assistant', answer || ' so far'
        FROM a JOIN q USING (conv_id, n)""",
    "evaluate_answers": f"""
        WITH answered AS (
            SELECT 'FiQA-SA' AS task, {sql_class(SCORE)} AS target,
                   CASE c_mktsegment WHEN 'MACHINERY' THEN 'positive'
                                     WHEN 'BUILDING' THEN 'negative' ELSE 'neutral' END
                       AS prediction
            FROM customer),
        {sql_scores('answered', 'task')}
        SELECT task, {METRICS.format(d=4)}, (SELECT count(*) FROM customer) AS n_sentiment
        FROM scores GROUP BY task""",
    "evaluate_all_tasks": f"""
        WITH asked AS (
            SELECT unnest(['FPB', 'TFNS', 'FiQA-SA', 'NWGI']) AS task, right(c_name, 1) AS digit,
                   c_nationkey % 3 AS label, c_acctbal FROM customer
            UNION ALL
            SELECT 'Headline', right(CAST(doc_id AS VARCHAR), 1), quality, NULL FROM labels),
        answered AS (
            SELECT task,
                   CASE task
                       WHEN 'FPB' THEN ['negative', 'neutral', 'positive'][label + 1]
                       WHEN 'TFNS' THEN ['negative', 'positive', 'neutral'][label + 1]
                       WHEN 'FiQA-SA' THEN {sql_class(SCORE)}
                       WHEN 'NWGI' THEN CASE WHEN c_acctbal < 2000 THEN 'negative'
                                             WHEN c_acctbal < 6500 THEN 'neutral'
                                             WHEN c_acctbal < 9500 THEN 'positive'
                                             ELSE 'neutral' END
                       ELSE CAST(CAST(label = 1 AS INTEGER) AS VARCHAR) END AS target,
                   CASE WHEN digit = '9' THEN NULL
                        WHEN task = 'Headline' THEN CASE WHEN digit < '4' THEN '1' ELSE '0' END
                        WHEN digit < '4' THEN 'positive' WHEN digit < '7' THEN 'negative'
                        ELSE 'neutral' END AS prediction,
                   digit
            FROM asked),
        counted AS (
            SELECT task, target, prediction, count(*) AS n FROM answered GROUP BY ALL),
        sides AS (
            SELECT task, target AS label, n AS support, 0 AS predicted,
                   CASE WHEN target = prediction THEN n ELSE 0 END AS tp FROM counted
            UNION ALL SELECT task, prediction, 0, n, 0 FROM counted),
        sums AS (
            SELECT task, label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp
            FROM sides GROUP BY task, label),
        scores AS (SELECT *, 2.0::DOUBLE * tp / (support + predicted) AS f1 FROM sums),
        results AS (
            SELECT task, {METRICS.format(d=4)},
                   round(coalesce(max(f1) FILTER (label = '1'), 0), 4) AS f1_binary
            FROM scores GROUP BY task),
        routing AS (
            SELECT task, nullif(count(*) FILTER (task <> 'Headline'), 0) AS n_sentiment,
                   nullif(count(*) FILTER (task = 'Headline'), 0) AS n_multitask
            FROM answered WHERE digit <> '9' GROUP BY task),
        published(task, system, reference) AS (VALUES {PUBLISHED})
        SELECT task, n_samples, accuracy, f1_weighted,
               CASE WHEN task <> 'Headline' THEN f1_macro END AS f1_macro,
               CASE WHEN task <> 'Headline' THEN f1_micro END AS f1_micro,
               CASE WHEN task = 'Headline' THEN f1_binary END AS f1_binary,
               n_sentiment, n_multitask, system, reference,
               round(f1_weighted - reference, 6) AS delta
        FROM results JOIN routing USING (task) JOIN published USING (task)""",
    "evaluate_questions": f"""
        WITH cases AS ({sql_cases()}),
        graded AS (
            SELECT difficulty, len(keywords) AS n,
                   CASE WHEN doc_id IN (SELECT doc_id FROM labels)
                        THEN len(list_filter(keywords, lambda w: contains(lower(text), lower(w))))
                        ELSE 0 END AS hits
            FROM documents, cases)
        SELECT difficulty, count(*) AS n_samples,
               round(avg(CAST(hits AS DOUBLE) / n), 6) AS avg_keyword_score
        FROM graded GROUP BY difficulty""",
}
