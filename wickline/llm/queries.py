"""The registered queries of the training-data operators, one a module's operator.

Each applies its operator to a whole table and derives the contract's columns
from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wickline.llm import bpe, chat, codes, fingerprints, lm, mixing, neardup, negatives, pieces, sharding, topk, toxicity, urls
from wickline.llm.common import doc_remainder, table


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by rules and then by its path template."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return topk.exact_topk(queries, vectors, k=10)


def op4_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates, by three-word shingles and 85 per cent."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, numerator=85)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the words that the mix takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a machine that has seen two thirds of the labels."""
    docs, remainder = table(spark, sf_dir, "documents"), doc_remainder(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder != 1)
    scored = docs.select("doc_id", (remainder == 1).alias("held_out"), toxicity.score(model, F.col("text"), spark).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by the public word-end vocabulary, encoded and decoded."""
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def told(turns: DataFrame) -> DataFrame:
    """The log that ends in these turns (conv_id, turn, role, text): each a draft, which is edited or, if it is an
    assistant's, generated anew, with the rest of its text as a delta.  Turns that tie are messages in the order of role and text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    again = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    steps = [("open", F.reverse(text)), (again, F.substring(text, F.lit(1), half)), ("delta", F.substring(text, half + 1, F.length(text)))]
    log = F.array(*[F.struct(F.lit(i).alias("step"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), part.alias("text")) for i, (kind, part) in enumerate(steps)])
    # numbered first: in one select the rows would be numbered after they are multiplied
    events = turns.withColumn("message", place).select("conv_id", "message", "role", F.explode(log).alias("e"))
    return events.select("conv_id", (F.col("message") * 3 + F.col("e.step")).alias("seq"), "message", "e.kind", F.when(F.col("e.step") == 0, F.col("role")).alias("role"), "e.text")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(told(rows.unionByName(planted))))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by a model of nine tenths of the documents."""
    scored = lm.score_documents(table(spark, sf_dir, "documents"), ~lm.held_out(F.col("doc_id")))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside that of its edited text."""
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_dual_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth vector's five positives, some labels being moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), topk.scaled(F.col("embedding"), 256).alias("v"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code of eight parts, by codebooks of sixteen entries after six rounds."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", topk.scaled(F.col("embedding"), 4096).alias("v"))
    return codes.vector_codes(vectors)


def op13_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces by the public SentencePiece model, encoded and decoded."""
    import public_tokenizers

    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_minimax_shards, op2_url_templates, op3_exact_topk, op4_minhash_join, op5_source_mix, op6_toxicity, op7_bpe_tree, op8_chat_format, op9_bloom_lm, op10_prefix_fingerprints, op11_dual_tree_negatives, op12_part_codes, op13_piece_backtracking)}



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and means, a pair of common table expressions each; for vectors of one length that ``parts`` divides."""
    def assigned(k: int) -> str:
        return f"""a{k} AS (SELECT row, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.row, p, e, list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} b USING (p)) GROUP BY row, p)"""

    steps = [assigned(0)]
    for k in range(1, rounds + 1):
        steps.append(f"""b{k} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k - 1} b LEFT JOIN (SELECT p, e, list(m ORDER BY d) AS c FROM
            (SELECT x.p, a.e, d.d, CAST(floor(sum(x.v[d.d])::DOUBLE / count(*)) AS BIGINT) AS m FROM x JOIN a{k - 1} a USING (row, p) CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS d) d GROUP BY x.p, a.e, d.d) GROUP BY p, e) m USING (p, e))""")
        steps.append(assigned(k))
    return f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        x AS (SELECT row, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS v FROM v CROSS JOIN (SELECT unnest(range({parts})) AS p)),
        b0 AS (SELECT p, row - 1 AS e, v AS c FROM x WHERE row <= {entries}),
        {", ".join(steps)},
        o AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
        FROM o JOIN v USING (row)
    """


ORACLE_SQL = {
    "op2_url_templates": """
        WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), '') AS h,
                          coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        r0 AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
        r1 AS (SELECT *, '.' || host AS d, regexp_replace(path, '[0-9]+', '*', 'g') AS look FROM r0),
        r AS (SELECT page_id, host, path, look,
                     CASE WHEN d LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
                          WHEN d LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                          WHEN d LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                          WHEN d LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
                          WHEN d LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM r1),
        l AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label FROM r),
        t0 AS (SELECT host, look, string_split(look, '/') AS s, string_split(look, '/')[1] AS t, count(*) AS n,
                      count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS b FROM l GROUP BY host, look),
        v0 AS (SELECT host, t FROM t0 GROUP BY host, t HAVING count(DISTINCT s[2]) > 20 AND count(DISTINCT s[2]) * 2.0 > sum(n)),
        t1 AS (SELECT host, look, s, n, a, b, t || CASE WHEN s[2] IS NULL THEN '' WHEN (host, t) IN (SELECT (host, t) FROM v0) THEN '/*' ELSE '/' || s[2] END AS t FROM t0),
        v1 AS (SELECT host, t FROM t1 GROUP BY host, t HAVING count(DISTINCT s[3]) > 20 AND count(DISTINCT s[3]) * 2.0 > sum(n)),
        t2 AS (SELECT host, look, s, n, a, b, t || CASE WHEN s[3] IS NULL THEN '' WHEN (host, t) IN (SELECT (host, t) FROM v1) THEN '/*' ELSE '/' || s[3] END AS t FROM t1),
        v2 AS (SELECT host, t FROM t2 GROUP BY host, t HAVING count(DISTINCT s[4]) > 20 AND count(DISTINCT s[4]) * 2.0 > sum(n)),
        t3 AS (SELECT host, look, a, b, t || CASE WHEN s[4] IS NULL THEN '' WHEN (host, t) IN (SELECT (host, t) FROM v2) THEN '/*' ELSE '/' || s[4] END
                      || CASE WHEN len(s) > 4 THEN '/' || array_to_string(s[5:], '/') ELSE '' END AS t FROM t2),
        g AS (SELECT coalesce(sum(b) / nullif(sum(a) + sum(b), 0), 0.5) AS base FROM t3),
        p AS (SELECT t, (sum(b) + 5.0 * (SELECT base FROM g)) / (sum(b) + sum(a) + 5.0) AS p FROM t3 GROUP BY t),
        c AS (SELECT host, t, CAST(sum(b) AS DOUBLE) AS b, CAST(sum(a) + sum(b) AS DOUBLE) AS m FROM t3 GROUP BY host, t),
        e AS (SELECT *, regexp_replace(t, '/[^/]*$', '') AS parent FROM c),
        f AS (SELECT host, parent, sum(b) / nullif(sum(m), 0) AS share FROM e GROUP BY host, parent),
        k AS (SELECT e.*, m = 0 OR abs(b / nullif(m, 0) - share) <= 2.0 * sqrt(share * (1 - share) / m) AS alike FROM e JOIN f USING (host, parent)),
        q AS (SELECT host, parent, sum(b) AS all_b, sum(m) AS all_m FROM k WHERE alike GROUP BY host, parent),
        j AS (SELECT host, t, CASE WHEN alike THEN (all_b + 5.0 * p) / (all_m + 5.0) ELSE (b + 5.0 * p) / (m + 5.0) END AS purity
              FROM k LEFT JOIN q USING (host, parent) JOIN p USING (t))
        SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM l JOIN t3 USING (host, look) JOIN j USING (host, t)
    """,
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op4_minhash_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept
        FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
    # valid where no size band has more than `rows_per_task` documents, so that each is one part
    "op5_source_mix": """
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM s),
        o AS (SELECT *, 2.0 * source_size / weight AS full_at,
                     1.5 * (sum(source_size) OVER ())::DOUBLE - 2.0 * coalesce((sum(source_size) OVER b)::DOUBLE, 0) AS rest,
                     sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight
              FROM w WINDOW b AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT coalesce(arg_min(rest / open_weight, full_at) FILTER (rest / open_weight < full_at), 1e300) AS level FROM o),
        t AS (SELECT source, source_size, CASE WHEN level * weight >= 2.0 * source_size THEN 2.0 * source_size ELSE level * weight END::DOUBLE AS target,
                     ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM o, l),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.start, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS place
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * least(floor(rate * place + start) - floor(rate * (place - 1) + start), ceil(rate)) AS BIGINT) AS taken FROM p
    """,
    "op8_chat_format": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (SELECT *, regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '(<)(\\|turn\\|>|\\|end\\|>|s>|/s>|<SYS>>|</SYS>>)|(\\[)(INST\\]|/INST\\])', '\\1\\3' || chr(92) || chr(92) || '\\2\\4', 'g') AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(escaped) + length(role) + 8 + 1 + 8) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_dual_tree_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * positive_score AND 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
    """,
    "op12_part_codes": _codes_sql(),
}
