"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.llm.common import table
from keepsake.llm import (bpe, chat, collocations, divergence, exact_dedup, line_dedup, minhash, mixing, pii, quality,
                          token_files, toxicity, url_filter)
from keepsake.session import scratch_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def deco(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return deco(fn) if fn else deco


_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(sql=f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {_NORM} AS norm FROM documents) WINDOW g AS (PARTITION BY norm)
""")
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query
def op9_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest_columns(pii.find_personal_data(docs))


@query
def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages).select("page_id", "judged.host", "judged.path", "judged.rule",
                                               "judged.verdict", "judged.score")


@query
def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    kinds = dict(rows.dtypes)
    extra = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return chat.digest_columns(chat.format_chat(chat.conversation_records(rows.unionByName(extra), varied=True)))


@query
def op5_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def quality_sql(columns: str) -> str:
    """DuckDB SQL of the quality report over ``documents``; ``columns`` are what it returns."""
    from keepsake.llm.quality import LEAST, MAX_REPEAT, MEASURES, MIN_WORDS, REACH

    sides = []
    for m, (low, high) in MEASURES.items():
        sides.append(f"max(CASE WHEN measure = '{m}' THEN q3 + {REACH} * (q3 - q1) + {high} END) AS {m}_max")
        if low is not None:
            sides.append(f"max(CASE WHEN measure = '{m}' THEN q1 - {REACH} * (q3 - q1) - {low} END) AS {m}_min")
    names = [s.split(" AS ")[1] for s in sides]
    picked = ", ".join(f"CASE WHEN f.n_docs >= {LEAST} THEN f.{s} WHEN l.n_docs >= {LEAST} THEN l.{s} ELSE a.{s} END AS {s}"
                       for s in names)
    good = " AND ".join([f"d.{m} <= t.{m}_max" for m in MEASURES]
                        + [f"d.{m} >= t.{m}_min" for m, (low, _) in MEASURES.items() if low is not None])

    def fence(level: str) -> str:
        keys = f"{level}, " if level else ""
        by = f"GROUP BY {level}" if level else ""
        return f"""(SELECT {keys}{', '.join(sides)}, max(n_docs) AS n_docs FROM (
            SELECT {keys}measure, max(n_docs) AS n_docs, min(CASE WHEN up_to * 100 >= 25 * n_docs THEN bucket END) AS q1,
                   min(CASE WHEN up_to * 100 >= 75 * n_docs THEN bucket END) AS q3
            FROM (SELECT {keys}measure, bucket, sum(n) OVER (PARTITION BY {keys}measure) AS n_docs,
                         sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket) AS up_to
                  FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM sketch GROUP BY {keys}measure, bucket))
            GROUP BY {keys}measure) {by})"""
    blanks = "[\\x20\\x09-\\x0D]+"
    measures = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM doc WHERE NOT base_failed"
                                  for m in MEASURES)
    return f"""
WITH raw AS (SELECT doc_id, lang, source, coalesce(text, '') AS t,
       list_filter(regexp_split_to_array(coalesce(text, ''), '{blanks}'), lambda x: x <> '') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)),
                   lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM raw WHERE len(w) >= 3),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
                               FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
counts AS (SELECT raw.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
       coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM raw LEFT JOIN rep USING (doc_id)),
doc AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
       CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words END AS symbol_rate,
       CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_line_rate,
       CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeat_rate,
       CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_length FROM counts),
sketch AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE
       (v >> (length(bin(v)) - 6)::BIGINT) << (length(bin(v)) - 6)::BIGINT END AS bucket, count(*) AS n
       FROM ({measures}) GROUP BY ALL),
t AS (SELECT f.lang, f.source, {picked} FROM {fence('lang, source')} f
      LEFT JOIN {fence('lang')} l ON f.lang IS NOT DISTINCT FROM l.lang, {fence('')} a)
SELECT {columns}
FROM (SELECT d.*, t.* EXCLUDE (lang, source),
             CASE WHEN d.base_failed THEN false ELSE coalesce({good}, true) END AS kept
      FROM doc d LEFT JOIN t ON d.lang IS NOT DISTINCT FROM t.lang AND d.source IS NOT DISTINCT FROM t.source) x
"""


def _quality_columns() -> str:
    from keepsake.llm.quality import MEASURES, _sides

    rates = [f"{c}::BIGINT AS {c}" for c in [*MEASURES, *_sides()]]
    return ", ".join(["doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept", *rates])


@query(sql=quality_sql(_quality_columns()))
def op1_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest_columns(bpe.encode_documents(docs, tokenizer_path()))


@query
def op7_minhash_dedup(spark, sf_dir):
    return minhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_BLANK = "[\\x20\\x09-\\x0D]+"
_LINES = f"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'),
    '{line_dedup.BLOCKS}', chr(10), 'g'), '<[^<>]*>', '', 'g'), chr(10)),
    lambda x: regexp_replace(x, '^{_BLANK}|{_BLANK}$', '', 'g')), lambda x: x <> '')"""


@query(sql=f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, {_LINES} AS lines,
       CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host FROM pages),
total AS (SELECT host, count(*) AS host_pages FROM p WHERE host <> '' GROUP BY host),
often AS (SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p WHERE host <> '')
          JOIN total USING (host) WHERE host_pages >= {line_dedup.MIN_PAGES}
          GROUP BY host, line, host_pages HAVING count(*) > {line_dedup.RATIO}::DOUBLE * host_pages),
drops AS (SELECT host, list(line) AS d FROM often GROUP BY host)
SELECT page_id, p.host, coalesce(host_pages, 0)::BIGINT AS host_pages, len(lines)::BIGINT AS n_lines,
       (len(lines) - len(list_filter(lines, lambda x: NOT coalesce(list_contains(d, x), false))))::BIGINT AS n_dropped,
       sha256(coalesce(array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(d, x), false)), chr(10)), '')) AS text_sha256
FROM p LEFT JOIN total USING (host) LEFT JOIN drops USING (host)
""")
def op8_line_dedup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = line_dedup.drop_boilerplate(pages)
    return out.select("page_id", "cleaned.host", "cleaned.host_pages", "cleaned.n_lines", "cleaned.n_dropped",
                      F.sha2(F.col("cleaned.text"), 256).alias("text_sha256"))


def divergence_sql() -> str:
    """DuckDB SQL of the divergence audit over ``documents``."""
    from keepsake.llm.divergence import LEAST, SCALE, TOP

    return f"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all({_NORM}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
hits AS (SELECT r, lang, source, unnest(terms) AS term FROM doc),
kept AS (SELECT lang, term FROM hits GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST}),
found AS (SELECT lang, source, term, count(*) AS n FROM hits JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT d.lang, d.source, coalesce(f.n, 0)::HUGEINT AS n, coalesce(k.v, 0)::HUGEINT AS v
          FROM (SELECT DISTINCT lang, source FROM doc) d
          LEFT JOIN (SELECT lang, source, sum(n) AS n FROM found GROUP BY ALL) f USING (lang, source)
          LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) k USING (lang)),
p AS (SELECT s.lang, s.source, k.term, coalesce(f.n, 0) AS n,
             1 + {SCALE}::HUGEINT * (coalesce(f.n, 0) + 1) // (s.n + s.v) AS p
      FROM sizes s JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
q AS (SELECT lang, term, 1 + {SCALE}::HUGEINT * (n + 1) // (total + v) AS q
      FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM found GROUP BY ALL)
      JOIN (SELECT lang, sum(n) AS total, max(v) AS v FROM sizes GROUP BY lang) USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
          FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
          FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= {TOP}
"""


@query(sql=divergence_sql())
def op11_source_divergence(spark, sf_dir):
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


@query
def op12_token_files(spark, sf_dir):
    path = scratch_dir(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.checksums(token_files.read_tokens(spark, path))


def collocation_sql() -> str:
    """DuckDB SQL of the phrase collocations over ``documents``."""
    from keepsake.llm.collocations import COVERED, LEAST, TOP

    return f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_NORM}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spots, range(1, 4) AS s(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
parts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
cuts AS (SELECT p.lang, p.k, p.phrase, p.a, c.c, x.f AS l, y.f AS r, 1000000 * p.a * p.a // (x.f * y.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS c FROM parts) c JOIN parts p USING (lang, phrase)
         JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(p.w[1:c.c], ' ')
         JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(p.w[c.c + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM parts WHERE k = 3),
cover AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT x.lang, x.phrase, x.a, x.l, x.r, x.score, n.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, x.phrase) AS rank
  FROM lowest x JOIN n USING (lang) LEFT JOIN cover c ON c.lang = x.lang AND c.phrase = x.phrase AND x.k = 2
  WHERE c.most IS NULL OR 100 * c.most < {COVERED} * x.a) WHERE rank <= {TOP}
"""


@query(sql=collocation_sql())
def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))
