"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barscreen.llm.common import table


def op1_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "epoch")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_efficiency_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.secrets import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op4_minimum_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_skip_chain_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.personal import scanned

    return scanned(table(spark, sf_dir, "documents"))


def op6_relational_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.chat import digests

    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    return digests(conversations.unionByName(extra))


def op7_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.pivots import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.quality import scored

    found = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "text_score", "meta_score", "score", "keep")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_set_similarity_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.lines import deduplicated

    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.spelling import grouped

    return grouped(table(spark, sf_dir, "documents"))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barscreen.llm.warc import read_back

    return read_back(table(spark, sf_dir, "pages")).drop("intact", "archive")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hierarchical_mixing,
        op2_simhash_near_dedup,
        op3_token_efficiency_secrets,
        op4_minimum_bin_slack_packing,
        op5_skip_chain_crf_pii,
        op6_relational_chat_format,
        op7_pivot_near_dedup,
        op8_co_trained_quality,
        op9_exact_top_k,
        op10_set_similarity_line_dedup,
        op11_conversation_prefix_trie,
        op12_spelling_variants,
        op13_warc_round_trip,
    )
}


def _crc32(codes: str) -> str:
    """DuckDB text for the CRC-32 of a list of bytes."""
    bits = "lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), {bits})), 4294967295)"


_UTF8 = """flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
            ELSE [192 | (unicode(x)::BIGINT >> 6), 128 | (unicode(x)::BIGINT & 63)] END))"""

_SOUND = "e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLE_SQL: dict[str, str] = {
    "op6_relational_chat_format": """
        WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        marked AS (SELECT *, coalesce(lag(role) OVER w = role, false) AS same,
                regexp_replace(replace(text, chr(92), chr(92) || chr(92)), '(<[|]|</?s>|[[]/?INST])', '\\1 ', 'g') AS grown
            FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(7 + sum(length(grown) + CASE WHEN same THEN 8 ELSE 23 + length(role) END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op10_set_similarity_line_dedup": """
        WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n
            FROM documents),
        sized AS (SELECT doc_id, n, line, list_sort(list_distinct(list_filter(string_split(translate(lower(line), chr(9) || chr(13) || chr(11) || chr(12), '    '), ' '), lambda x: x <> ''))) AS ws
            FROM lines),
        sets AS (SELECT *, row_number() OVER (ORDER BY doc_id, n) AS id FROM (SELECT ws, len(ws) AS c, min_by(doc_id, (doc_id, n)) AS doc_id, min_by(n, (doc_id, n)) AS n
            FROM sized WHERE len(ws) >= 1 GROUP BY ws)),
        words AS (SELECT id, c, unnest(ws) AS w FROM sets),
        met AS (SELECT a.id, a.c, b.c AS d, count(*) AS common FROM words a JOIN words b ON a.w = b.w AND b.id < a.id AND 0.8 * greatest(a.c, b.c) <= least(a.c, b.c) + 1e-9
            GROUP BY a.id, b.id, a.c, b.c),
        matched AS (SELECT DISTINCT id FROM met WHERE common >= 0.8 * (c + d - common) - 1e-9),
        gone AS (SELECT z.doc_id, z.n FROM sized z JOIN sets s ON z.ws = s.ws WHERE (z.doc_id, z.n) <> (s.doc_id, s.n) OR s.id IN (FROM matched)),
        marked AS (SELECT l.doc_id, l.n, l.line, g.n IS NOT NULL AS dropped FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.n = g.n)
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '') AS text, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_removed
        FROM marked GROUP BY doc_id""",
    "op11_conversation_prefix_trie": f"""
        WITH own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32(_UTF8.format(text="CAST(conv_id AS VARCHAR)"))} % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM own)),
        joined AS (SELECT c.conv_id, k, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND k <= h
            UNION ALL SELECT c.conv_id, k, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND k > h),
        said AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, length(role) || ':' || role || length(text) || ':' || text AS said,
                octet_length(encode(text)) AS bytes FROM joined),
        members AS (SELECT conv_id, 0 AS d, '' AS path, 0 AS bytes FROM convs
            UNION ALL SELECT conv_id, d, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)), bytes FROM said),
        linked AS (SELECT *, lag(path) OVER w AS parent, max(d) OVER (PARTITION BY conv_id) = d AS at_end FROM members WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
        nodes AS (SELECT d, path, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
            FROM linked GROUP BY d, path),
        kids AS (SELECT parent, count(*) AS n FROM nodes WHERE d > 0 GROUP BY parent),
        counted AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM nodes v LEFT JOIN kids ON kids.parent = v.path),
        sums AS (SELECT m.path, sum(v.own) AS saved, count(*) FILTER (v.n_children = 0) AS leaves FROM counted v JOIN members m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.path)
        SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
        FROM counted v JOIN sums s ON s.path = v.path LEFT JOIN nodes u ON v.d > 0 AND u.path = v.parent""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
        hashed AS (SELECT run, n, {_crc32(_UTF8.format(text="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM counted),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0
                THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        cuts AS (SELECT word, n, unnest(range(length(word))) AS k FROM words),
        cut AS (SELECT word, n, k, substr(word, 1, CAST(k AS INT)) || '*' || substr(word, CAST(k AS INT) + 2) AS wild, substr(word, 1, CAST(k AS INT)) || substr(word, CAST(k AS INT) + 2) AS shorter FROM cuts),
        near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.wild = b.wild AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.shorter = b.word
            UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.shorter = b.word),
        best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
        forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
            FROM words w LEFT JOIN best b ON w.word = b.word),
        paths AS (SELECT word, word AS at FROM forms UNION ALL SELECT p.word, f.form FROM paths p JOIN forms f ON p.at = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN paths p ON p.word = f.word JOIN forms e ON p.at = e.word AND e.form IS NULL""",
    "op13_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        sized AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT s.page_id, CAST(s.payload_bytes AS BIGINT) AS payload_bytes, s.payload_digest, CASE WHEN f.first_id < s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN f.first_id < s.page_id THEN f.first_id END AS refers_to
        FROM sized s LEFT JOIN firsts f USING (payload_digest)""",
    "op7_pivot_near_dedup": f"""
        WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        sound AS (SELECT i, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v WHERE label IS NOT NULL AND {_SOUND} AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
        unit AS (SELECT i, vec_id, label, list_transform(e, lambda x: x / size) AS e FROM sound),
        links AS (SELECT a.i, b.i AS j, b.vec_id FROM unit a JOIN unit b ON a.label = b.label AND a.i <> b.i AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.98),
        reached AS (SELECT i, i AS j FROM v UNION SELECT r.i, l.j FROM reached r JOIN links l ON l.i = r.j),
        least AS (SELECT r.i, min(v.vec_id) AS component_id FROM reached r JOIN v ON v.i = r.j GROUP BY r.i),
        counted AS (SELECT i, count(*) AS n FROM links GROUP BY i)
        SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, coalesce(v.vec_id = l.component_id, false) AS kept FROM v JOIN least l ON l.i = v.i LEFT JOIN counted c ON c.i = v.i""",
    "op9_exact_top_k": f"""
        WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_SOUND.replace("e IS", "embedding IS", 1).replace("(e,", "(embedding,")}),
        met AS (SELECT q.i, q.vec_id AS query_id, v.vec_id, v.i AS j, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.i <> v.i AND len(q.e) = len(v.e))
        SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id, j) AS nth FROM met) AS x WHERE nth <= 5""",
}
