"""Contract queries of the operators and the pipeline: (spark, sf_dir) ->
DataFrame over whole tables, and the DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .langid import language_id
from .license_scan import BASE, NOTICES, license_scan
from .line_dedup import line_dedup
from .mixing import mixture
from .packing import pack
from .periodic_runs import periodic_runs
from .pii_crf import semi_markov_pii
from .textutil import scratch_path, table
from .token_output import read_token_files, write_token_files
from .toxicity import toxicity
from .vector_codes import vector_codes
from .vptree import nearest

#: target weights by level of the tree; names not listed weigh 1
MIX_WEIGHTS = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semi_markov_pii(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)
            .select("doc_id", "n_shingles", "component_id"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (line_dedup(table(spark, sf_dir, "documents"))
            .select("doc_id", "text", "lines_removed"))


def op6_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder, digest=True)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def with_echoes(doc_id: Column, text: Column) -> Column:
    """The text; if crc32 of its decimal id is a multiple of ten, its words
    from a place on repeat with a period, both taken from that number."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("bigint")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    # the words are bound once, so that they are not cut again for each of them
    return F.when((F.pmod(h, F.lit(10)) == 0) & (F.size(words) > 0), F.transform(F.array(words), repeat)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_echoes(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return (periodic_runs(docs).withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", (-F.col("best.less")).alias("length"), "best.period",
                    F.floor(-F.col("best.less") * 1000 / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = license_scan(table(spark, sf_dir, "documents"))
    base = places.withColumn("base", F.filter("places", lambda p: p["base"]))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(c)["label"])), ",")
    return base.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(F.col("base")["start"]).alias("first_word"),
        F.array_max(F.col("base")["start"]).alias("last_word"), names("base").alias("base_labels"), names("places").alias("labels"),
        F.coalesce(F.array_max(F.col("places")["share"]), F.lit(0.0)).alias("score"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_packing, op3_semi_markov_pii, op4_jaccard_join, op5_line_dedup, op6_vantage_point, op7_mixing,
    op8_exact_dedup, op9_language_id, op10_token_output, op11_vector_codes, op12_periodic_runs, op13_license_scan)}


def _codes_sql(rounds: int = 4) -> str:
    """Every part against every entry of its codebook, round after round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
          a{r} AS MATERIALIZED (
            SELECT p.vec_id, p.part, p.s, min({{'d': list_sum(list_transform(list_zip(p.s, c.s), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT,
                                               'e': c.entry}}) AS best
            FROM p JOIN c{r} c USING (part) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
          m{r} AS (
            SELECT part, entry, list(mean ORDER BY pos) AS s FROM (
              SELECT part, entry, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean
              FROM (SELECT part, best.e AS entry, unnest(s) AS x, unnest(range(len(s))) AS pos FROM a{r}) GROUP BY ALL)
            GROUP BY ALL),
          c{r + 1} AS MATERIALIZED (
            SELECT c.part, c.entry, coalesce(m.s, c.s) AS s FROM c{r} c LEFT JOIN m{r} m USING (part, entry))""")
    return f"""
        WITH z AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS z
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
          p AS MATERIALIZED (
            SELECT vec_id, part, z[part * len(z) // 4 + 1 : (part + 1) * len(z) // 4] AS s
            FROM z CROSS JOIN range(4) t(part)),
          c0 AS MATERIALIZED (
            SELECT part, s, (row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1) AS entry
            FROM p QUALIFY entry < 256),
          {",".join(steps)},
          f AS (
            SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error
            FROM a{rounds} GROUP BY vec_id)
        SELECT f.vec_id, f.code, f.error, sum(f.error) OVER (PARTITION BY z.label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
        FROM f JOIN z USING (vec_id)"""


def _license_sql() -> str:
    """Every template at every place of every text."""
    row = lambda t: "({}, {}, {}, {})".format(
        repr(t.label), t in BASE, t.words, [{"at": at, "words": words} for at, words in t.phrases])
    return r"""
        WITH template(label, base, words, phrases) AS (VALUES """ + ", ".join(row(t) for t in BASE + NOTICES) + r"""),
          doc AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l
            FROM documents),
          place AS (
            SELECT d.doc_id, t.label, t.base, d.i AS start,
                   list_sum(list_transform(range(len(t.words)), lambda j:
                     CASE WHEN d.i - t.phrases[1]['at'] + j >= 0 AND d.l[d.i - t.phrases[1]['at'] + j + 1] = t.words[j + 1] THEN 1 ELSE 0 END))
                     / len(t.words)::DOUBLE AS share
            FROM (SELECT doc_id, l, unnest(l) AS w, unnest(range(len(l))) AS i FROM doc) d
            JOIN template t ON d.w = t.phrases[1]['words'][1]
            WHERE len(list_filter(t.phrases, lambda p: d.l[d.i - t.phrases[1]['at'] + p['at'] + 1 : d.i - t.phrases[1]['at'] + p['at'] + len(p['words'])]
                                                       IS DISTINCT FROM p['words'])) = 0)
        SELECT d.doc_id, any_value(len(d.l))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
               min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
               coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
        FROM doc d LEFT JOIN place USING (doc_id) GROUP BY d.doc_id"""


ORACLE = {
    "op6_vantage_point": """
        WITH v AS (
          SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (
          SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
        r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank,
                 vec_id, score
          FROM d)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_mixing": r"""
        WITH doc AS (
            SELECT doc_id, CASE WHEN source IS NULL THEN 'none' WHEN substr(md5(source), 1, 1) < '4' THEN 'd0'
                                WHEN substr(md5(source), 1, 1) < '8' THEN 'd1' WHEN substr(md5(source), 1, 1) < 'c' THEN 'd2' ELSE 'd3' END AS domain,
                   coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
                   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
            FROM documents),
          leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM doc GROUP BY ALL),
          by_domain AS (
            SELECT *, CASE WHEN is_full THEN cap ELSE left_over * w // nullif(open_weight, 0) END AS budget FROM (
              SELECT *, greatest(total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER p, 0), 0)::HUGEINT AS left_over,
                     sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p AS open_weight
              FROM (
                SELECT *, cap * onward <= greatest(total - before, 0) * w AS is_full FROM (
                  SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
                         sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS onward
                  FROM (SELECT domain, sum(tokens)::HUGEINT * 2 AS cap, (CASE domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 2 ELSE 1 END)::HUGEINT AS w, (SELECT sum(tokens) * 4 // 5 FROM leaf)::HUGEINT AS total FROM leaf GROUP BY domain)
                  WINDOW q AS (PARTITION BY 1 ORDER BY cap::DOUBLE / w::DOUBLE, domain)))
              WINDOW p AS (PARTITION BY 1))),
          by_lang AS (
            SELECT *, CASE WHEN is_full THEN cap ELSE left_over * w // nullif(open_weight, 0) END AS budget FROM (
              SELECT *, greatest(total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER p, 0), 0)::HUGEINT AS left_over,
                     sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p AS open_weight
              FROM (
                SELECT *, cap * onward <= greatest(total - before, 0) * w AS is_full FROM (
                  SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
                         sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS onward
                  FROM (SELECT l.domain, l.lang, sum(tokens)::HUGEINT * 2 AS cap, (CASE l.lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END)::HUGEINT AS w, any_value(d.budget)::HUGEINT AS total FROM leaf l JOIN by_domain d USING (domain) GROUP BY l.domain, l.lang)
                  WINDOW q AS (PARTITION BY domain ORDER BY cap::DOUBLE / w::DOUBLE, lang)))
              WINDOW p AS (PARTITION BY domain))),
          by_source AS (
            SELECT *, CASE WHEN is_full THEN cap ELSE left_over * w // nullif(open_weight, 0) END AS budget FROM (
              SELECT *, greatest(total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER p, 0), 0)::HUGEINT AS left_over,
                     sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p AS open_weight
              FROM (
                SELECT *, cap * onward <= greatest(total - before, 0) * w AS is_full FROM (
                  SELECT *, coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
                         sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS onward
                  FROM (SELECT l.domain, l.lang, l.source, l.tokens, l.tokens * 2 AS cap, 1::HUGEINT AS w, g.budget::HUGEINT AS total FROM leaf l JOIN by_lang g USING (domain, lang))
                  WINDOW q AS (PARTITION BY domain, lang ORDER BY cap::DOUBLE / w::DOUBLE, source)))
              WINDOW p AS (PARTITION BY domain, lang))),
          taken AS (
            SELECT domain, lang, source, coalesce(budget // nullif(tokens, 0), 0)::BIGINT AS whole,
                   (budget - coalesce(budget // nullif(tokens, 0), 0) * tokens)::BIGINT AS rest
            FROM by_source),
          run AS (
            SELECT d.*, t.whole, t.rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source
                     ORDER BY md5('17:' || t.whole::VARCHAR || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto
            FROM doc d JOIN taken t USING (domain, lang, source)),
          times AS (SELECT *, whole + (CASE WHEN (rest > 0 OR whole = 0) AND upto <= rest THEN 1 ELSE 0 END) AS n FROM run)
        SELECT doc_id, domain, lang, source, n_tokens, unnest(range(n))::INTEGER AS epoch FROM times""",
    "op8_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               text_sha256
        FROM t
        WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "op11_vector_codes": _codes_sql(),
    "op12_periodic_runs": r"""
        WITH crc AS (
            SELECT doc_id, text, xor(4294967295, list_reduce(
                     list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                     lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1))))) AS h
            FROM documents),
          cut AS (SELECT doc_id, h, h // 10 AS g, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS l FROM crc),
          tail AS (
            SELECT *, len(l) AS n, g % nullif(len(l), 0) AS a, 1 + (len(l) - g % nullif(len(l), 0)) // (3 + g % 8) AS p FROM cut),
          t AS MATERIALIZED (
            SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                     THEN list_transform(range(n), lambda i: l[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % p END)]) ELSE l END AS l
            FROM tail),
          gram AS (
            SELECT doc_id, n, i, array_to_string(l[i + 1 : i + 5], ' ') AS gram, CASE WHEN i > 0 THEN l[i] END AS before
            FROM (SELECT *, unnest(range(n - 4)) AS i FROM t)),
          pair AS (
            SELECT x.doc_id, x.i, y.i AS j FROM gram x JOIN gram y USING (doc_id, gram)
            WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n AND (x.before IS NULL OR x.before <> y.before)),
          longest AS (
            SELECT doc_id, i, j, coalesce(list_position(list_transform(range(n - j), lambda k: l[i + k + 1] = l[j + k + 1]), false) - 1, n - j) AS same
            FROM pair JOIN t USING (doc_id)),
          run AS MATERIALIZED (
            SELECT doc_id, i AS start, j - i + same AS length, min(j - i) AS period FROM longest
            WHERE 3 * (j - i) <= same AND j - i + same >= 6 GROUP BY ALL),
          told AS (
            SELECT doc_id, count(*) AS n_runs, min({'less': -length, 'start': start, 'period': period}) AS best,
                   string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
            FROM run GROUP BY doc_id),
          gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
          kept AS (
            SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words
            FROM (SELECT doc_id, unnest(l) AS w, unnest(range(n)) AS i FROM t) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, (-best.less)::BIGINT AS length, best.period::BIGINT AS period,
               (-best.less * 1000 // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
        FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_license_scan": _license_sql(),
}
