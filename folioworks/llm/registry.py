"""The registered corpus queries, one for each operator, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact, fertility, importance, licences, mixing, packing, phrases, quality, quotes, secret_scan, simhash, toxicity
from .scratch import table


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no quotes, so its turns are first written as mail that quotes the two turns before."""
    linked = quotes.reply_order(quotes.as_mail(table(spark, sf_dir, "conversations")))
    return linked.select(
        F.col("thread").alias("conv_id"), F.col("seq").alias("turn"), "parent_seq", "root_seq", "depth", "n_quotes", "n_linked", F.md5("clean_text").alias("clean_md5")
    )


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pieces = public_tokenizers.path(fertility.RANKS), public_tokenizers.path(fertility.PIECES)
    return fertility.fertility_rules(table(spark, sf_dir, "documents"), ranks, pieces)


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = phrases.drop_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", phrases.digest(F.col("kept_text")).alias("kept_sha256"))


def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(packing.VOCABULARY))


def op6_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.licence_scan(docs, licences.fit(docs))
    names = F.array_join(F.transform("families", lambda x: F.concat(x["family"], F.lit(":"), x["n"])), ",")
    return found.select("doc_id", "n_paragraphs", F.size("families").alias("n_families"), names.alias("families"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_ns_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_secret_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE said AS (
    SELECT conv_id, turn, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), plain AS (
    SELECT *, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS body FROM said
), first_said AS (
    SELECT conv_id, body, min(turn) AS source FROM plain GROUP BY ALL
), links AS (
    SELECT m.conv_id, m.turn, m.text, f1.source AS parent_seq,
           (coalesce(p1.body, '') <> '')::BIGINT + (p1.turn IS NOT NULL AND coalesce(p2.body, '') <> '')::BIGINT AS n_quotes
    FROM plain m LEFT JOIN plain p1 ON p1.conv_id = m.conv_id AND p1.turn = m.turn - 1
    LEFT JOIN plain p2 ON p2.conv_id = m.conv_id AND p2.turn = m.turn - 2
    LEFT JOIN first_said f1 ON f1.conv_id = m.conv_id AND f1.body = p1.body AND p1.body <> ''
), walk AS (
    SELECT conv_id, turn, turn AS root_seq, 0 AS depth FROM links WHERE parent_seq IS NULL
    UNION ALL
    SELECT l.conv_id, l.turn, w.root_seq, w.depth + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.parent_seq = w.turn
)
SELECT conv_id, turn, parent_seq, root_seq, depth::BIGINT AS depth, n_quotes, n_quotes AS n_linked,
       md5(regexp_replace(coalesce(text, ''), '^\n+|\n+$', '', 'g')) AS clean_md5
FROM links JOIN walk USING (conv_id, turn)
"""

OP3_SQL = f"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS line, regexp_extract_all(coalesce(text, ''), '{mixing.WORD}') AS words FROM documents
), positions AS (
    SELECT doc_id, line, unnest(words) AS word, generate_subscripts(words, 1) AS place, words FROM split
), windows AS (
    SELECT doc_id, line, place, word,
           CASE WHEN place + {phrases.WINDOW - 1} <= len(words) THEN md5(array_to_string(words[place:place + {phrases.WINDOW - 1}], ' ')) END AS window_text
    FROM positions
), counted AS (
    SELECT doc_id, line, place, word, window_text IS NOT NULL AND count(*) OVER (PARTITION BY window_text) > 1 AS again FROM windows
), marked AS (
    SELECT doc_id, line, place, word, bool_or(again) OVER (PARTITION BY line ORDER BY place ROWS BETWEEN {phrases.WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
    FROM counted
), kept AS (
    SELECT line, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '') AS text FROM marked GROUP BY line
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (line)
"""

OP7_SQL = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))::BIGINT AS size FROM documents
), sums AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM sums
), filled AS (
    SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
    FROM weighed
), final AS (
    SELECT min_by(level, cap / weight) AS level FROM filled WHERE cap >= level * weight
), targets AS (
    SELECT source, source_size, coalesce(least(cap::DOUBLE, final.level * weight), cap::DOUBLE) AS target FROM weighed LEFT JOIN final ON true
), ranked AS (
    SELECT d.doc_id, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id)::DOUBLE AS place,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
           ('0x' || substr(md5('{mixing.SEED}/' || coalesce(d.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296 AS shift
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * least(floor(place * each + shift)::BIGINT - floor((place - 1) * each + shift)::BIGINT, 2)::BIGINT AS taken
FROM ranked
"""

OP8_SQL = """
WITH lowered AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id DESC) = 1 AS kept, sha256(body) AS text_sha256
FROM lowered WINDOW same AS (PARTITION BY body)
"""


_LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT_WORDS = rf"regexp_extract_all({_LOWER_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH crc AS MATERIALIZED (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS steps FROM range(256) AS t(n)
), split AS MATERIALIZED (
    SELECT row_number() OVER () AS line, doc_id, {_SPLIT_WORDS} AS words FROM documents
), goal AS (
    SELECT row_number() OVER () AS line, {_SPLIT_WORDS} AS words FROM benchmark
), placed AS (
    SELECT 0 AS side, line, unnest(words) AS word, generate_subscripts(words, 1) AS i, words FROM split
    UNION ALL SELECT 1, line, unnest(words), generate_subscripts(words, 1), words FROM goal
), grams AS MATERIALIZED (
    SELECT side, line, word AS gram FROM placed UNION ALL SELECT side, line, word || ' ' || words[i + 1] FROM placed WHERE i < len(words)
), bytes AS (
    SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM grams)
), hashed AS MATERIALIZED (
    SELECT gram, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {importance.BUCKETS} AS bucket FROM bytes, crc
), counted AS (
    SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM grams JOIN hashed USING (gram) GROUP BY bucket
), totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM counted), gain AS MATERIALIZED (
    SELECT bucket, floor({importance.SCALE} * ln(((t + 1)::DOUBLE * (s_all + {importance.BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (t_all + {importance.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counted, totals
), weighed AS (
    SELECT line, count(*) AS n_features, sum(gain)::BIGINT AS total FROM grams JOIN hashed USING (gram) JOIN gain USING (bucket) WHERE side = 0 GROUP BY line
), scored AS (
    SELECT line, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
           ('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8))::UBIGINT::DOUBLE AS h FROM split LEFT JOIN weighed USING (line)
), summed AS (
    SELECT *, weight + floor(-{importance.SCALE}::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored
), ranked AS (
    SELECT line, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM summed WHERE n_words >= {importance.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, score, rank FROM summed LEFT JOIN (SELECT * FROM ranked WHERE rank <= {importance.PERCENT} * n // 100) USING (line)
"""

_SQUARED = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _lloyd(rounds: int = centroids.ROUNDS) -> str:
    """Assignments a0... and centroids c1... of each round after the first centroids c0."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near{r} AS (SELECT k.line, c.c, {_SQUARED} AS d FROM kept k, c{r} c)")
        steps.append(f"a{r} AS (SELECT line, arg_min(c, (d, c)) AS c, min(d) AS d FROM near{r} GROUP BY line)")
        if r < rounds:
            steps.append(f"parts{r} AS (SELECT a.c, i, sum(k.v[i])::BIGINT AS s, count(*) AS n FROM a{r} a JOIN kept k USING (line), range(1, {centroids.COMPONENTS + 1}) AS t(i) GROUP BY a.c, i)")
            steps.append(f"means{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM parts{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN means{r} m USING (c))")
    return ",\n".join(steps)


OP12_SQL = f"""
WITH whole AS (
    SELECT vec_id, row_number() OVER () AS line, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {centroids.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.COMPONENTS}
), kept AS MATERIALIZED (SELECT * FROM whole), c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY c LIMIT {centroids.CLUSTERS}
), {_lloyd()}
SELECT k.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN kept k USING (line) JOIN c{centroids.ROUNDS} c ON c.c = a.c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quotation_links,
        op2_tokeniser_fertility,
        op3_repeated_phrases,
        op4_boosted_quality,
        op5_best_fit_packing,
        op6_toxic_spans,
        op7_systematic_mix,
        op8_exact_groups,
        op9_licence_scan,
        op10_simhash_groups,
        op11_importance_resample,
        op12_ns_centroids,
        op13_secret_structures,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_links": OP1_SQL, "op3_repeated_phrases": OP3_SQL, "op7_systematic_mix": OP7_SQL, "op8_exact_groups": OP8_SQL, "op11_importance_resample": OP11_SQL, "op12_ns_centroids": OP12_SQL}
