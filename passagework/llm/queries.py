"""One query per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm import (
    collocations,
    conversation_repair,
    embedding_links,
    exact_dedup,
    importance,
    mixing,
    sentence_pieces,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
    training_order,
)
from passagework.llm.common import table
from passagework.llm.conversation_sql import OP11_SQL
from passagework.session import shared_folder


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.encode(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), check=True
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id"
    )


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = mixing.replicated(docs, mixing.target_rates(docs))
    return found.select("row.doc_id", "row.source", "n_copies", "copy", "mix_key", "row.text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.without_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards are written to the shared folder; the rows are what their files hold."""
    import public_tokenizers

    records = training_order.training_order(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
    folder = shared_folder(spark, "shards")
    return training_order.read_index(training_order.write_index(records, folder), folder)


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the text labelled good; kept is their share among the labelled."""
    labels = table(spark, sf_dir, "labels").filter("quality in (0, 1)")
    share = labels.agg(F.avg("quality")).first()[0] or 0.0
    good = labels.filter("quality = 1").select("doc_id")
    return importance.resampled(table(spark, sf_dir, "documents"), good, share)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repairs(hurt, F.col("present"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeated_bytes(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


OP4_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links,
       least(vec_id, coalesce(c.b, vec_id)) AS component_id,
       vec_id <= coalesce(c.b, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

# A rate above 64 is drawn in equal parts, each by a number of its own.
OP6_SQL = """
WITH s AS (
    SELECT source, sum(strlen(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source),
w AS (
    SELECT source, size, sqrt(size) AS weight, sum(size) OVER () AS size_all,
           sum(sqrt(size)) OVER () AS weight_all FROM s),
r AS (
    SELECT source, rate, parts, rate / parts AS mean FROM (
        SELECT *, greatest(1, CAST(ceil(rate / 64.0) AS INTEGER)) AS parts FROM (
            SELECT source,
                   CAST(round(weight * (size_all / weight_all) / size, 9) AS DOUBLE) AS rate
            FROM w))),
k AS (
    SELECT source, mean,
           unnest(range(0, CAST(ceil(mean + 10 * sqrt(mean) + 30) AS INTEGER) + 1)) AS k FROM r),
p AS (SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p FROM k),
c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
l AS (SELECT source, list(c ORDER BY k) AS cs FROM c GROUP BY source),
d AS (
    SELECT doc_id, d.source, text, cs, list_transform(range(1, parts + 1), lambda part:
               CAST('0x' || substr(md5('mix:' || doc_id || ':' || part), 1, 13) AS BIGINT)
                   / 4503599627370496.0) AS us
    FROM documents d JOIN r ON r.source IS NOT DISTINCT FROM d.source
         JOIN l ON l.source IS NOT DISTINCT FROM d.source),
n AS (
    SELECT doc_id, source, text,
           CAST(list_sum(list_transform(us, lambda u: len(list_filter(cs, lambda x: x <= u))))
                AS INTEGER) AS n_copies
    FROM d),
e AS (SELECT *, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy FROM n)
SELECT doc_id, source, n_copies, copy, md5('mix:order:' || doc_id || ':' || copy) AS mix_key, text
FROM e
"""

OP10_SQL = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
           sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
    FROM documents),
w AS (
    SELECT doc_id, h,
           first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY h) AS group_size
    FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM w
"""

# Every window of 50 words in full: a document's word is removed if a window
# around it is also one of a smaller document.
OP7_SQL = """
WITH t AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
win AS (
    SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM t WHERE len(w) >= 50)),
hit AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM win)
    WHERE first < doc_id),
gone AS (
    SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i + 1, i + 51)) AS p FROM hit)),
lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(array_to_string(
           CASE WHEN n IS NULL THEN w
                ELSE list_filter(w, lambda x, j: NOT list_contains(ps, j)) END, ' '), ''))
           AS kept_sha256
FROM t LEFT JOIN lists USING (doc_id)
"""

OP12_SQL = """
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
    FROM (SELECT lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (
    SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase
    FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
          FROM p, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY lang, m, phrase),
c AS (
    SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k
    FROM f WHERE m > 1 AND n >= 10),
s AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r,
           (1000000::HUGEINT * c.a * c.a) // (x.n::HUGEINT * y.n) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1 : c.k], ' ')
           JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[c.k + 1 :], ' ')),
cut AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
    SELECT lang, phrase, max(a) AS more FROM (
        SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase
        FROM c WHERE m = 3) GROUP BY lang, phrase),
ranked AS (
    SELECT cut.*, row_number() OVER (
        PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM cut LEFT JOIN held USING (lang, phrase) WHERE more IS NULL OR 100 * more < 50 * a),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""

# Every string of 100 bytes in full, as hexadecimal digits.
OP13_SQL = """
WITH t AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
win AS (
    SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k
    FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM t WHERE len(h) >= 200)),
hit AS (
    SELECT doc_id, i FROM win
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
islands AS (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
        SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100
                               THEN 0 ELSE 1 END AS new FROM hit)),
runs AS (
    SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM islands GROUP BY doc_id, island),
ends AS (
    SELECT doc_id, low, high FROM runs
    UNION ALL SELECT doc_id, len(h) // 2, NULL FROM t),
parts AS (
    SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low, high NULLS LAST), 0) AS a,
           low AS b FROM ends),
kept AS (
    SELECT doc_id, count(*) - 1 AS n_spans, sum(b - a) AS n_kept,
           string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k
    FROM parts JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(len(h) // 2 - n_kept AS BIGINT) AS n_removed, n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM t JOIN kept USING (doc_id)
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_simhash": op3_simhash,
    "op4_embedding_links": op4_embedding_links,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_training_order": op8_training_order,
    "op9_importance": op9_importance,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_collocations": op12_collocations,
    "op13_suffix_dedup": op13_suffix_dedup,
}
ORACLES = {
    "op4_embedding_links": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_suffix_dedup": OP13_SQL,
}
