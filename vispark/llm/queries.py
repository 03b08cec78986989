"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Words that the encoder keeps where a query does little else (some 250 MB a Python worker at most).
ENCODER_WORDS = 800_000


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.binary_output import read_token_files, write_token_files
    from vispark.llm.common import scratch

    path = scratch(spark, "token_files")
    write_token_files(_read(spark, sf_dir, "documents"), path, end_id=0, cache_words=ENCODER_WORDS)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.top_k_search import exact_top_k

    return exact_top_k(_read(spark, sf_dir, "embeddings"), k=5, scale=256, query_step=50)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.pii import pii_digest

    return pii_digest(_read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.license_scan import scan_licenses

    found = scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), length=1024, end_id=2, cache_words=ENCODER_WORDS)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.toxicity import fit_severity, score_severity

    docs = _read(spark, sf_dir, "documents")
    return score_severity(docs, fit_severity(docs, _read(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.chat_format import format_preferences, with_neighbours_answers

    pairs = format_preferences(*with_neighbours_answers(_read(spark, sf_dir, "conversations")))
    return pairs.select(
        F.col("pair_id").alias("conv_id"),
        "prompt_turns",
        F.sha2("prompt", 256).alias("prompt_sha256"),
        F.sha2("chosen", 256).alias("chosen_sha256"),
        F.sha2("rejected", 256).alias("rejected_sha256"),
        "chosen_mask",
        "rejected_mask",
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.spelling import letter_runs, spelling_variants, with_slips, word_counts

    runs = letter_runs(_read(spark, sf_dir, "documents"))
    return spelling_variants(word_counts(runs.select(with_slips(runs).alias("word"))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vispark.llm.collocations import collocations

    return collocations(_read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_binary_output,
        op2_exact_top_k,
        op3_pii,
        op4_license_scan,
        op5_packing,
        op6_mixing,
        op7_toxicity,
        op8_exact_dedup,
        op9_ngram_join,
        op10_chat_format,
        op11_spelling_variants,
        op12_line_dedup,
        op13_collocations,
    )
}

ORACLE_SQL = {
    "op2_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, coalesce('0' || source, '1') AS skey, coalesce(text, '') AS text,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents),
        k AS (
            SELECT doc_id, skey, size,
                   -ln((CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || skey || '|' || size), 1, 12)
                        AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0)
                   / CASE WHEN length(text) = 0 THEN 1.0
                          ELSE greatest(0.05, pow(length(translate(text, '#$%&*|~^<>{}[]!', '')) / length(text), 8.0)) END AS key
            FROM d),
        s AS (
            SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
                   CAST(CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
            FROM k GROUP BY skey),
        l AS (
            SELECT *, source_size * 2.0::DOUBLE AS lim, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget,
                   sum(weight) OVER () AS all_weight FROM s),
        v AS (
            SELECT *, (budget - coalesce(sum(lim) OVER w, 0)) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS level
            FROM l WINDOW w AS (ORDER BY lim / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT level AS final FROM v WHERE lim / weight >= level ORDER BY lim / weight, skey LIMIT 1),
        t AS (SELECT skey, source_size, coalesce(least(lim, weight * final), lim) AS target FROM v LEFT JOIN f ON true),
        r AS (
            SELECT k.*, t.source_size, t.target,
                   CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
                   sum(size) OVER (PARTITION BY k.skey ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
            FROM k JOIN t USING (skey))
        SELECT doc_id, size, source_size, target,
               CAST((epochs + CASE WHEN target - epochs * source_size > 0 AND middle <= target - epochs * source_size THEN 1 ELSE 0 END)
                    * size AS BIGINT) AS taken
        FROM r""",
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
                     row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS n FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op10_chat_format": r"""
        WITH t AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        l AS (SELECT pair_id, max({'turn': turn, 'text': text}) AS last FROM t WHERE role = 'assistant' GROUP BY pair_id),
        s AS (SELECT l.pair_id, l.last.turn AS turn, l.last.text AS text, o.last.text AS other
              FROM l LEFT JOIN l o ON o.pair_id = l.pair_id + 1),
        r AS (SELECT t.pair_id, t.turn, t.role, coalesce(s.other, t.text) AS text
              FROM t LEFT JOIN s ON t.pair_id = s.pair_id AND t.turn = s.turn AND t.role = 'assistant' AND t.text = s.text
              WHERE s.pair_id IS NULL OR s.other IS NOT NULL),
        n AS (SELECT 0 AS side, *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) - 1 AS pos FROM t
              UNION ALL
              SELECT 1, *, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, text) - 1 FROM r),
        m AS (SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT {'r': role, 't': text}) = 1 AS same FROM n GROUP BY pair_id, pos),
        p AS (SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN pos END), count(*)) AS prefix FROM m GROUP BY pair_id),
        x AS (SELECT n.*, prefix, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM n JOIN p USING (pair_id)),
        y AS (SELECT *, CASE WHEN pos >= prefix THEN sum(CASE WHEN pos >= prefix THEN length(piece) ELSE 0 END)
                     OVER (PARTITION BY pair_id, side ORDER BY pos) - length(piece) END AS begin_ FROM x)
        SELECT pair_id AS conv_id, CAST(max(prefix) AS BIGINT) AS prompt_turns,
               sha256(coalesce(string_agg(CASE WHEN side = 0 AND pos < prefix THEN piece END, '' ORDER BY pos), '')) AS prompt_sha256,
               sha256(coalesce(string_agg(CASE WHEN side = 0 AND pos >= prefix THEN piece END, '' ORDER BY pos), '')) AS chosen_sha256,
               sha256(coalesce(string_agg(CASE WHEN side = 1 AND pos >= prefix THEN piece END, '' ORDER BY pos), '')) AS rejected_sha256,
               coalesce(string_agg(CASE WHEN side = 0 AND pos >= prefix AND role = 'assistant'
                    THEN CAST(begin_ + 22 AS BIGINT) || ':' || CAST(begin_ + length(piece) - 1 AS BIGINT) END, ',' ORDER BY pos), '') AS chosen_mask,
               coalesce(string_agg(CASE WHEN side = 1 AND pos >= prefix AND role = 'assistant'
                    THEN CAST(begin_ + 22 AS BIGINT) || ':' || CAST(begin_ + length(piece) - 1 AS BIGINT) END, ',' ORDER BY pos), '') AS rejected_mask
        FROM y GROUP BY pair_id""",
    "op11_spelling_variants": r"""
        WITH RECURSIVE t(i, c, r) AS (
            SELECT i, i, 0 FROM range(256) x(i)
            UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, r + 1 FROM t WHERE r < 8),
        tab AS MATERIALIZED (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS tab FROM t WHERE r = 8),
        d AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents),
        k AS MATERIALIZED (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m FROM d GROUP BY 1, 2),
        x AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM k),
        h AS (SELECT run, m, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT))),
                lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]))) AS h FROM x, tab),
        w AS MATERIALIZED (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(m) AS BIGINT) AS n
            FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(m) >= 5),
        g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
        p AS MATERIALIZED (
            SELECT a.word, b.word AS near, b.n AS near_n FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM g a JOIN w b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM g a JOIN w b ON a.rest = b.word),
        b AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n FROM p GROUP BY 1),
        f AS MATERIALIZED (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n,
                   CASE WHEN best_n >= 5 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND p.near_n = b.best_n) END AS form
            FROM w LEFT JOIN b USING (word)),
        s(word, reached, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON s.reached = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, form, r.root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(reached, step) AS root FROM s GROUP BY 1) r USING (word)""",
    "op12_line_dedup": r"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS MATERIALIZED (
            SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)),
        f AS (SELECT key FROM l WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT r) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM l JOIN d USING (r) LEFT JOIN f USING (key) GROUP BY r, doc_id""",
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
              FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) x(k))),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING k = 1 OR count(*) >= 100),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
        c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
        u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
        s AS (SELECT u.lang, u.phrase, u.a, x.f AS l, y.f AS r, n.n, cut, 1000::HUGEINT * a * n.n // (x.f::HUGEINT * y.f) AS score
              FROM u JOIN n USING (lang) JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
        m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        o AS (SELECT DISTINCT lang, a, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:], ' ')]) AS phrase FROM c)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m ANTI JOIN o USING (lang, phrase, a))
        WHERE rank <= 2000""",
}
