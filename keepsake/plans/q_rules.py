"""Rule-categorisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepsake.functions.core import keyword_haystack, link_hosts
from keepsake.functions.rulesets import DEFAULT_CATEGORIES, NO_CATEGORY, SAMPLE_CATEGORIES, rule_rows
from keepsake.operators import rule_index as RI
from keepsake.operators import rules as R
from keepsake.plans.registry import register
from keepsake.plans.tables import posts, table, with_posts

# -- DuckDB spellings ---------------------------------------------------------

_WORD = r"[^\p{L}\p{N}_]"


def duck_regex(pattern: str) -> str:
    r"""RE2 has an ASCII-only ``\b``; spell word boundaries at the ends out."""
    left, core, right = R.search_edges(pattern)
    return "(?i)" + (f"(^|{_WORD})" if left else "") + core + (f"({_WORD}|$)" if right else "")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rules_cte(categories) -> str:
    rows = ", ".join(
        f"({_q(c)}, {o}, {_q(k)}, {_q(duck_regex(p) if k == 'kw' else p)})"
        for c, o, k, _s, p in rule_rows(categories))
    return f"rules(category, ord, kind, pat) AS (VALUES {rows})"


SQL_HOST = ("regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//(?:[^/?#]*@)?([^/?#:\\[]*)', 1)), "
            "'^www\\.', '')")
SQL_HOSTS = f"list_filter(list_transform(links, lambda u: {SQL_HOST}), lambda h: h <> '')"
SQL_HAY = ("lower(text) || '  ' || lower(array_to_string(hashtags, ' ')) || '  ' || "
           "lower(array_to_string(links, ' ')) || '  ' || lower(author_handle)")


def points_ctes(src: str = "posts") -> list[str]:
    """hay/kwp/domp/points CTEs computing per-category points of ``src``."""
    return [
        f"hay AS (SELECT id, {SQL_HAY} AS hay, {SQL_HOSTS} AS hosts FROM {src})",
        "hosts AS (SELECT id, unnest(hosts) AS host FROM hay)",
        """kwp AS (SELECT h.id, r.category, r.ord, count(*) AS kw_points
                   FROM hay h JOIN rules r ON r.kind = 'kw' AND regexp_matches(h.hay, r.pat)
                   GROUP BY h.id, r.category, r.ord)""",
        """domp AS (SELECT x.id, r.category, r.ord, 2 * count(DISTINCT r.pat) AS dom_points
                    FROM hosts x JOIN rules r ON r.kind = 'dom' AND (x.host = r.pat OR ends_with(x.host, '.' || r.pat))
                    GROUP BY x.id, r.category, r.ord)""",
        """points AS (SELECT coalesce(k.id, d.id) AS id, coalesce(k.category, d.category) AS category,
                             coalesce(k.ord, d.ord) AS ord,
                             CAST(coalesce(k.kw_points, 0) AS BIGINT) AS kw_points,
                             CAST(coalesce(d.dom_points, 0) AS BIGINT) AS dom_points,
                             CAST(coalesce(k.kw_points, 0) + coalesce(d.dom_points, 0) AS BIGINT) AS score
                      FROM kwp k FULL OUTER JOIN domp d ON k.id = d.id AND k.ord = d.ord)""",
        f"""cats AS (SELECT id, list(category ORDER BY score DESC, ord) AS cats FROM points GROUP BY id)""",
    ]


# -- queries --------------------------------------------------------------------


@register("keyword_haystack", with_posts(f"SELECT id, {SQL_HAY} AS hay FROM posts"))
def keyword_haystack_q(spark, sf_dir):
    return posts(spark, sf_dir).select("id", keyword_haystack().alias("hay"))


@register("link_hosts", f"""
SELECT page_id, array_to_string({SQL_HOSTS.replace('links', '[url]')}, '|') AS hosts FROM pages""")
def link_hosts_q(spark, sf_dir):
    pg = table(spark, sf_dir, "pages")
    return pg.select("page_id", F.array_join(link_hosts(F.array(F.col("url"))), "|").alias("hosts"))


def _points(spark, sf_dir, cats):
    p = R.category_points(posts(spark, sf_dir), cats)
    return p.select("id", "category", "ord", F.col("kw_points").cast("bigint").alias("kw_points"),
                    F.col("dom_points").cast("bigint").alias("dom_points"),
                    F.col("score").cast("bigint").alias("score"))


@register("rule_scores", with_posts("SELECT id, category, kw_points FROM kwp",
                                     rules_cte(SAMPLE_CATEGORIES), *points_ctes()))
def rule_scores_q(spark, sf_dir):
    """Keyword points per (post, category): one per matching pattern."""
    return _points(spark, sf_dir, SAMPLE_CATEGORIES).where(F.col("kw_points") > 0).select(
        "id", "category", "kw_points")


@register("domain_scores", with_posts("SELECT id, category, CAST(dom_points AS BIGINT) AS dom_points FROM domp",
                                       rules_cte(SAMPLE_CATEGORIES), *points_ctes()))
def domain_scores_q(spark, sf_dir):
    """Domain points per (post, category): two per matching rule domain."""
    return _points(spark, sf_dir, SAMPLE_CATEGORIES).where(F.col("dom_points") > 0).select(
        "id", "category", "dom_points")


@register("category_scores", with_posts("SELECT id, category, ord, kw_points, dom_points, score FROM points",
                                         rules_cte(SAMPLE_CATEGORIES), *points_ctes()))
def category_scores_q(spark, sf_dir):
    return _points(spark, sf_dir, SAMPLE_CATEGORIES)


@register("category_rank", with_posts(
    "SELECT id, category, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rank FROM points",
    rules_cte(SAMPLE_CATEGORIES), *points_ctes()))
def category_rank_q(spark, sf_dir):
    c = R.categorize(posts(spark, sf_dir), SAMPLE_CATEGORIES)
    return c.select("id", F.posexplode("categories").alias("pos", "category")).select(
        "id", "category", (F.col("pos") + 1).cast("bigint").alias("rank"))


def _enrich_sql(categories) -> str:
    return with_posts(f"""
SELECT p.id,
       coalesce(c.cats[1], '{NO_CATEGORY}') AS topic,
       coalesce(array_to_string(c.cats, '|'), '{NO_CATEGORY}') AS tags
FROM posts p LEFT JOIN cats c ON c.id = p.id""", rules_cte(categories), *points_ctes())


def _enrich_df(spark, sf_dir, cats):
    e = R.rule_enrich(posts(spark, sf_dir), cats)
    return e.select("id", F.col("_res.topic").alias("topic"), F.array_join("_res.tags", "|").alias("tags"))


@register("rule_enrich", _enrich_sql(SAMPLE_CATEGORIES))
def rule_enrich_q(spark, sf_dir):
    return _enrich_df(spark, sf_dir, SAMPLE_CATEGORIES)


@register("rule_enrich_default", _enrich_sql(DEFAULT_CATEGORIES))
def rule_enrich_default_q(spark, sf_dir):
    """The default (shipped) category rules over all posts."""
    return _enrich_df(spark, sf_dir, DEFAULT_CATEGORIES)


@register("rule_enrich_pages", f"""
WITH {rules_cte(SAMPLE_CATEGORIES)},
pg AS (SELECT CAST(page_id AS VARCHAR) AS id, html AS text, []::VARCHAR[] AS hashtags, [url] AS links,
              '' AS author_handle FROM pages),
{",".join(points_ctes("pg"))}
SELECT p.id, coalesce(c.cats[1], '{NO_CATEGORY}') AS topic,
       coalesce(array_to_string(c.cats, '|'), '{NO_CATEGORY}') AS tags
FROM pg p LEFT JOIN cats c ON c.id = p.id""")
def rule_enrich_pages_q(spark, sf_dir):
    """Rules over raw pages: whole HTML as text, the page URL as the link."""
    pg = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"),
        F.array().cast("array<string>").alias("hashtags"), F.array("url").alias("links"),
        F.lit("").alias("author_handle"))
    e = R.rule_enrich(pg, SAMPLE_CATEGORIES)
    return e.select("id", F.col("_res.topic").alias("topic"), F.array_join("_res.tags", "|").alias("tags"))


# -- a rule table taken from the data: words as whole-word rules, benchmark words as plain ones, hosts as domains ----

_BIG_RULES = r"""rules AS (
    SELECT DISTINCT 'w' || substr(w, 1, 1) AS category, unicode(w) AS ord, 'word' AS kind, w
    FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS w FROM documents)
    UNION ALL SELECT DISTINCT 's' || substr(w, 1, 1), 1000000 + unicode(w), 'part', w
    FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}{6,}')) AS w FROM benchmark)
    UNION ALL SELECT DISTINCT 'd' || h, 2000000, 'dom', h
    FROM (SELECT array_to_string(string_split(h, '.')[-2:], '.') AS h FROM (SELECT unnest(hosts) AS h FROM hay)))"""
_BIG_HITS = r"""hits AS (
    SELECT h.id, r.category, r.ord, 1 AS kw, 0 AS dom
    FROM (SELECT id, unnest(list_distinct(regexp_split_to_array(hay, '[^\p{L}\p{N}_]+'))) AS w FROM hay) h
    JOIN rules r ON r.kind = 'word' AND r.w = h.w
    UNION ALL SELECT h.id, r.category, r.ord, 1, 0 FROM hay h JOIN rules r ON r.kind = 'part' AND contains(h.hay, r.w)
    UNION ALL SELECT DISTINCT h.id, r.category, r.ord, 0, 2 FROM (SELECT id, unnest(hosts) AS host FROM hay) h
    JOIN rules r ON r.kind = 'dom' AND (h.host = r.w OR ends_with(h.host, '.' || r.w)))"""
_BIG_POINTS = """points AS (SELECT id, category, ord, sum(kw)::BIGINT AS kw_points, sum(dom)::BIGINT AS dom_points,
    sum(kw + dom)::BIGINT AS score FROM hits GROUP BY id, category, ord)"""


def data_rules(spark, sf_dir):
    """A large rule table: every word of 4 letters of the documents, every one of 6 of the benchmark, every site."""
    def words(name, least):
        found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{%d,}" % least), F.lit(0))
        return table(spark, sf_dir, name).select(F.explode(found).alias("w")).distinct()

    def rows(df, mark, start, kind, pattern):
        return df.select(F.concat(F.lit(mark), F.substring("w", 1, 1)).alias("category"), (F.ascii("w") + start).alias("ord"),
                         F.lit(kind).alias("kind"), F.lit(0).alias("seq"), pattern.alias("pattern"))
    w = F.col("w")
    hosts = posts(spark, sf_dir).select(F.explode(link_hosts("links")).alias("h")).select(
        F.substring_index("h", ".", -2).alias("w")).distinct()
    sites = hosts.select(F.concat(F.lit("d"), w).alias("category"), F.lit(2000000).alias("ord"), F.lit("dom").alias("kind"),
                         F.lit(0).alias("seq"), w.alias("pattern"))
    return (rows(words("documents", 4), "w", 0, "kw", F.concat(F.lit(r"\b"), w, F.lit(r"\b")))
            .unionByName(rows(words("benchmark", 6), "s", 1000000, "kw", w)).unionByName(sites))


@register("indexed_rule_scores", with_posts("SELECT id, category, ord, kw_points, dom_points, score FROM points",
                                             f"hay AS (SELECT id, {SQL_HAY} AS hay, {SQL_HOSTS} AS hosts FROM posts)",
                                             _BIG_RULES, _BIG_HITS, _BIG_POINTS))
def indexed_rule_scores_q(spark, sf_dir):
    """Tens of thousands of rules over all posts, through the q-gram index."""
    p = RI.category_points(posts(spark, sf_dir), data_rules(spark, sf_dir))
    return p.select("id", "category", "ord", *[F.col(c).cast("bigint").alias(c) for c in ("kw_points", "dom_points", "score")])


@register("indexed_category_rank", with_posts(
    "SELECT id, category, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rank FROM points",
    rules_cte(SAMPLE_CATEGORIES), *points_ctes()))
def indexed_category_rank_q(spark, sf_dir):
    """The ranking of ``category_rank``, through the index."""
    c = RI.categorize(posts(spark, sf_dir), R.rules_frame(spark, SAMPLE_CATEGORIES))
    return c.select("id", F.posexplode("categories").alias("pos", "category")).select(
        "id", "category", (F.col("pos") + 1).cast("bigint").alias("rank"))
