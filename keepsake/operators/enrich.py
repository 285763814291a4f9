"""Incremental enrichment of pending posts.

Shape of one run (all lazy, one plan):

    targets  = pending (or all with ``force``), optionally the first N by id
    backfill = posts with empty text take fetched content (join or function)
    enricher = adds ``_res`` = struct(summary, topic, tags, error) per target
    apply    = summary/topic overwritten, tags unless manual, flags set

Enrichers are ``DataFrame -> DataFrame`` functions that add ``_res``.  The rule
enricher is a projection; a mapping/response enricher is one equi-join on id;
a user Python function runs through ``mapInPandas`` (one client per task,
errors caught per row).  A failure never aborts the batch: it lands in the
row's ``enrich_error``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions.core import falsy_coalesce, nonblank, strip_ws
from keepsake.schema import POST_FIELDS, POST_SCHEMA

RES_TYPE = T.StructType([
    T.StructField("summary", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])
# Messages and markers that stored posts carry.
NOT_FOUND = "tweet not found"
NO_MAPPING = "no enrichment provided for this id"
FETCH_DISABLED = "fetch disabled; record is missing text"
MANUAL = "manual"
AUTO = "auto"


# -- targets ------------------------------------------------------------------


def is_pending() -> Column:
    """Not enriched and no earlier error."""
    return (~F.coalesce(F.col("enriched"), F.lit(False))) & (F.coalesce(F.col("enrich_error"), F.lit("")) == "")


def pending(posts: DataFrame) -> DataFrame:
    return posts.where(is_pending())


def select_targets(posts: DataFrame, force: bool = False) -> DataFrame:
    return posts if force else pending(posts)


def mark_targets(posts: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Add boolean ``_target``.

    Without a limit the flag is a row predicate (no shuffle).  With a limit
    the first N target ids are found with a distributed top-N and joined
    back; Spark broadcasts them below its own size limit.
    """
    pred = F.lit(True) if force else is_pending()
    if limit is None:
        return posts.withColumn("_target", pred)
    if limit < 0:
        raise ValueError("limit must be >= 0")
    ids = posts.where(pred).select("id").orderBy("id").limit(limit).withColumn("_target", F.lit(True))
    return (posts.join(ids, "id", "left")
            .withColumn("_target", F.coalesce(F.col("_target"), F.lit(False))))


# -- backfill -------------------------------------------------------------------

CONTENT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("author_handle", T.StringType()),
    T.StructField("author_name", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("media", POST_SCHEMA["media"].dataType),
])


def _needs_fetch() -> Column:
    return F.col("_target") & (F.coalesce(F.col("text"), F.lit("")) == "")


def _merge_content(df: DataFrame, found: Column, prefix: str) -> DataFrame:
    """Apply fetched columns ``<prefix>text`` ... to rows that needed a fetch."""
    need = _needs_fetch() & found

    def c(name):
        return F.col(prefix + name)

    out = df.select(
        *[F.col(f) for f in df.columns if not f.startswith(prefix)
          and f not in ("text", "author_handle", "author_name", "created_at", "media")],
        F.when(need, c("text")).otherwise(F.col("text")).alias("text"),
        F.when(need, falsy_coalesce("author_handle", c("author_handle"))).otherwise(F.col("author_handle")).alias("author_handle"),
        F.when(need, falsy_coalesce("author_name", c("author_name"))).otherwise(F.col("author_name")).alias("author_name"),
        F.when(need, falsy_coalesce("created_at", c("created_at"))).otherwise(F.col("created_at")).alias("created_at"),
        F.when(need & (F.coalesce(F.size("media"), F.lit(0)) == 0),
               F.coalesce(c("media"), F.array().cast(POST_SCHEMA["media"].dataType)))
        .otherwise(F.col("media")).alias("media"),
    )
    return out


def backfill_from_content(df: DataFrame, content: DataFrame) -> DataFrame:
    """Rows needing text take it from ``content`` (id + any CONTENT_SCHEMA
    columns).  Text is taken when the id is present even if it is ''; the
    other fields only fill falsy values.  Absent id -> ``tweet not found``.

    One left equi-join on id; Spark broadcasts ``content`` when its size check
    allows, otherwise both sides shuffle on id.
    """
    cols = [f.name for f in CONTENT_SCHEMA.fields]
    present = set(content.columns)
    c = content.select(
        *[(F.col(n).cast(CONTENT_SCHEMA[n].dataType) if n in present else F.lit(None).cast(CONTENT_SCHEMA[n].dataType))
          .alias("_c_" + n) for n in cols],
        F.lit(True).alias("_c_found"))
    j = df.join(c, df["id"] == c["_c_id"], "left")
    found = F.coalesce(F.col("_c_found"), F.lit(False))
    j = j.withColumn("_fetch_error",
                     F.when(_needs_fetch() & ~found, F.lit(NOT_FOUND)).otherwise(F.col("_fetch_error"))
                     if "_fetch_error" in df.columns else
                     F.when(_needs_fetch() & ~found, F.lit(NOT_FOUND)))
    j = j.withColumn("_c_text", F.coalesce(F.col("_c_text"), F.lit("")))
    return _merge_content(j, found, "_c_")


def fetch_disabled(df: DataFrame, message: str = FETCH_DISABLED) -> DataFrame:
    """Rows that need text fail with ``message`` (offline runs)."""
    err = F.when(_needs_fetch(), F.lit(message))
    if "_fetch_error" in df.columns:
        err = F.coalesce(F.col("_fetch_error"), err)
    return df.withColumn("_fetch_error", err)


def retry(fn: Callable, retries: int = 3, sleep: Callable[[float], None] = time.sleep,
          retry_on: tuple[type[BaseException], ...] = (Exception,)) -> Callable:
    """``fn`` with up to ``retries`` calls, pausing 1 s, 2 s, 4 s ... before the second and later ones.

    Any result, also ``None`` (not found), ends it; only ``retry_on`` errors count as transient.
    """
    pauses = [0, *(2.0 ** k for k in range(retries - 1))]

    def persistent(*args, **kwargs):
        problems: list[BaseException] = []
        for pause in pauses:
            if pause:
                sleep(pause)
            try:
                return fn(*args, **kwargs)
            except retry_on as problem:
                problems.append(problem)
        raise RuntimeError(f"failed after {len(problems)} attempts: {problems[-1]}") from problems[-1]

    return persistent


class Failure(NamedTuple):
    """What is kept of an exception that a user function raised for one row."""

    kind: str
    message: str

    @classmethod
    def of(cls, problem: BaseException) -> Failure:
        return cls(type(problem).__name__, " ".join(str(problem).split()))

    def note(self) -> str:
        """The row's error: one line, the kind of failure where it says nothing."""
        return self.message or self.kind


def backfill_with_fetcher(df: DataFrame, fetcher: Callable, *, setup: Callable[[], object] | None = None,
                          attempts: int = 3, at_once: int = 8, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Backfill through a user function ``id -> content dict | None | raise``.

    With ``setup`` the function also gets what that returns, a client made once per
    task.  Each task calls it for up to ``at_once`` ids at a time, in threads; an id
    whose call raises is tried ``attempts`` times in all.  ``None`` gives ``tweet not
    found`` and is final.  Results keep the order of the ids, whatever call ends first.

    Only rows that need text are fetched.  The answers are written once to the shared
    folder, because both the enricher and the result read them and a second call could
    answer differently.
    """
    import pandas as pd

    schema = T.StructType([T.StructField("id", T.StringType())] +
                          [T.StructField("_f_" + n, CONTENT_SCHEMA[n].dataType) for n in
                           ("text", "author_handle", "author_name", "created_at", "media")] +
                          [T.StructField("_f_found", T.BooleanType()), T.StructField("_f_error", T.StringType())])
    empty = {f.name: None for f in schema.fields}

    def answer(call: Callable, id_: str) -> dict:
        rec = empty | {"id": id_, "_f_found": False}
        try:
            content = call(id_)
        except Exception as exc:  # isolate the failure to this row
            return rec | {"_f_error": Failure.of(exc.__cause__ or exc).note()}
        if content is None:
            return rec | {"_f_error": NOT_FOUND}
        media = [{"thumb": m.get("thumb"), "type": m.get("type"), "url": m.get("url")} for m in (content.get("media") or [])]
        return rec | {"_f_text": content.get("text", None), "_f_author_handle": content.get("author_handle", ""),
                      "_f_author_name": content.get("author_name", ""), "_f_created_at": content.get("created_at", ""),
                      "_f_media": media, "_f_found": True}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = fetcher
        if setup is not None:
            client = setup()

            def call(id_):
                return fetcher(id_, client)
        steady = retry(call, attempts, sleep)
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                rows = list(pool.map(lambda id_: answer(steady, id_), pdf["id"]))
                yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    from keepsake.session import scratch_dir, ship_package
    ship_package(df.sparkSession)
    need = df.where(_needs_fetch()).select("id")
    answers = scratch_dir(df.sparkSession)
    need.mapInPandas(run, schema).write.parquet(answers)
    fetched = df.sparkSession.read.schema(schema).parquet(answers)
    j = df.join(fetched, "id", "left")
    found = F.coalesce(F.col("_f_found"), F.lit(False))
    err = F.when(_needs_fetch() & ~found, F.col("_f_error"))
    if "_fetch_error" in df.columns:
        err = F.coalesce(F.col("_fetch_error"), err)
    j = j.withColumn("_fetch_error", err).withColumn(
        "_f_text", F.coalesce(F.col("_f_text"), F.col("text")))
    return _merge_content(j.drop("_f_error"), found, "_f_")


# -- enrichers --------------------------------------------------------------------


def normalize_result(summary: Column, topic: Column, tags: Column) -> Column:
    """summary/topic trimmed; tags trimmed, lower-cased, blanks dropped."""
    clean = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(strip_ws(t)))
    return F.struct(strip_ws(F.coalesce(summary, F.lit(""))).alias("summary"),
                    strip_ws(F.coalesce(topic, F.lit(""))).alias("topic"),
                    F.filter(clean, lambda t: t != "").alias("tags"),
                    F.lit(None).cast("string").alias("error"))


def mapping_enricher(mapping: DataFrame, skip_missing: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Enrich from a table ``(id, summary, topic, tags)``, optionally with the ``error`` of an entry.

    Missing ids become the per-row error ``no enrichment provided for this id``
    (or are left pending with ``skip_missing``).
    """
    res = normalize_result(F.col("summary"), F.col("topic"), F.col("tags"))
    if "error" in mapping.columns:
        res = res.withField("error", F.col("error").cast("string"))
    m = mapping.select(F.col("id").alias("_m_id"), res.alias("_m_res"))

    def enrich(df: DataFrame) -> DataFrame:
        j = df.join(m, df["id"] == m["_m_id"], "left")
        missing = F.struct(F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("topic"),
                           F.lit(None).cast("array<string>").alias("tags"),
                           F.lit(None if skip_missing else NO_MAPPING).cast("string").alias("error"))
        res = F.when(F.col("_m_id").isNotNull(), F.col("_m_res")).otherwise(missing)
        out = j.withColumn("_res", res).drop("_m_id", "_m_res")
        if skip_missing:
            out = out.withColumn("_target", F.col("_target") & F.col("_res.error").isNull()
                                 & F.col("_res.summary").isNotNull())
        return out

    return enrich


def response_enricher(responses: DataFrame, skip_missing: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Enrich from model responses ``(id, response)``; one that can't be parsed is that row's error."""
    from keepsake.functions.json import parse_response

    parsed = responses.select("id", parse_response(F.col("response")).alias("r"))
    return mapping_enricher(parsed.select("id", "r.summary", "r.topic", "r.tags", "r.error"), skip_missing)


def udf_enricher(fn: Callable[[dict], dict], setup: Callable[[], object] | None = None,
                 columns: tuple[str, ...] = ("id", "url", "author_handle", "author_name", "text",
                                             "lang", "hashtags", "links")) -> Callable[[DataFrame], DataFrame]:
    """Run a Python function ``row dict -> {summary, topic, tags}`` per target.

    ``setup`` (optional) builds a client once per task; it is passed to
    ``fn(row, client)``.  Exceptions are stored per row, never raised.
    """
    import pandas as pd

    out_schema = T.StructType([T.StructField("_u_id", T.StringType()), T.StructField("_u_res", RES_TYPE)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = setup() if setup else None
        for pdf in batches:
            ids, res = [], []
            for rec in pdf.to_dict("records"):
                for k, v in rec.items():
                    if hasattr(v, "tolist"):
                        rec[k] = v.tolist()
                try:
                    r = fn(rec, client) if setup else fn(rec)
                    tags = r.get("tags", [])
                    res.append({"summary": str(r.get("summary", "")), "topic": str(r.get("topic", "")),
                                "tags": [str(t) for t in tags] if isinstance(tags, list) else [],
                                "error": None})
                except Exception as exc:
                    res.append({"summary": None, "topic": None, "tags": None, "error": Failure.of(exc).note()})
                ids.append(rec["id"])
            yield pd.DataFrame({"_u_id": ids, "_u_res": res})

    def enrich(df: DataFrame) -> DataFrame:
        from keepsake.session import ship_package
        ship_package(df.sparkSession)
        todo = df.where(F.col("_target") & F.col("_fetch_error").isNull()).select(*columns)
        results = todo.mapInPandas(run, out_schema)
        j = df.join(results, df["id"] == results["_u_id"], "left")
        return j.withColumn("_res", F.col("_u_res")).drop("_u_id", "_u_res")

    return enrich


def rules_enricher(rules=None) -> Callable[[DataFrame], DataFrame]:
    from keepsake.functions.rulesets import DEFAULT_CATEGORIES
    from keepsake.operators.rules import rule_enrich

    rs = rules if rules is not None else DEFAULT_CATEGORIES

    def enrich(df: DataFrame) -> DataFrame:
        return rule_enrich(df, rs)

    return enrich


# -- apply ------------------------------------------------------------------------


def apply_results(df: DataFrame, now: str) -> DataFrame:
    """Write ``_res``/``_fetch_error`` back onto the post columns.

    Success: summary/topic overwritten, tags replaced unless manual (then
    ``tags_source='auto'``), enriched, ``enriched_at=now``, error cleared.
    Failure: only ``enrich_error`` changes (a backfill that succeeded is kept).
    """
    tgt = F.col("_target")
    err = F.coalesce(F.col("_fetch_error"), F.col("_res.error"))
    ok = tgt & err.isNull() & F.col("_res").isNotNull()
    failed = tgt & err.isNotNull()
    manual = F.coalesce(F.col("tags_source"), F.lit("")) == MANUAL
    new = {
        "summary": F.when(ok, F.coalesce(F.col("_res.summary"), F.lit(""))).otherwise(F.col("summary")),
        "topic": F.when(ok, F.coalesce(F.col("_res.topic"), F.lit(""))).otherwise(F.col("topic")),
        "tags": F.when(ok & ~manual, F.coalesce(F.col("_res.tags"), F.array().cast("array<string>")))
        .otherwise(F.col("tags")),
        "tags_source": F.when(ok & ~manual, F.lit(AUTO)).otherwise(F.col("tags_source")),
        "enriched": F.when(ok, F.lit(True)).otherwise(F.col("enriched")),
        "enriched_at": F.when(ok, F.lit(now)).otherwise(F.col("enriched_at")),
        "enrich_error": F.when(ok, F.lit("")).when(failed, err).otherwise(F.col("enrich_error")),
    }
    status = F.when(ok, F.lit("enriched")).when(failed, F.lit("error"))
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in POST_FIELDS], status.alias("_status"))


def enrich_pending(posts: DataFrame, enricher: Callable[[DataFrame], DataFrame], *, now: str,
                   force: bool = False, limit: int | None = None, content: DataFrame | None = None,
                   fetcher: Callable | None = None, offline: bool = False) -> DataFrame:
    """One enrichment run; returns all posts plus ``_status`` ('enriched',
    'error' or NULL for untouched rows).  ``now`` is injected (no clock).

    Only targets go through backfill and enricher; the other rows are set
    beside the result unread.
    """
    done, rest = split_enrich(posts, enricher, now=now, force=force, limit=limit, content=content, fetcher=fetcher,
                              offline=offline)
    return done.unionByName(rest)


def split_enrich(posts: DataFrame, enricher: Callable[[DataFrame], DataFrame], *, now: str,
                 force: bool = False, limit: int | None = None, content: DataFrame | None = None,
                 fetcher: Callable | None = None, offline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(targets after enrichment, untouched rows), both with ``_status``."""
    marked = mark_targets(posts, force=force, limit=limit)
    df = marked.where("_target").withColumn("_fetch_error", F.lit(None).cast("string"))
    if content is not None:
        df = backfill_from_content(df, content)
    elif fetcher is not None:
        df = backfill_with_fetcher(df, fetcher)
    elif offline:
        df = fetch_disabled(df)
    done = apply_results(enricher(df), now)
    rest = marked.where("not _target").select(*POST_FIELDS, F.lit(None).cast("string").alias("_status"))
    return done, rest


#: Enrichers that a job can choose by name; add one with ``ENRICHERS[name] = factory``.
ENRICHERS: dict[str, Callable[..., Callable[[DataFrame], DataFrame]]] = {
    "rules": rules_enricher, "mapping": mapping_enricher, "responses": response_enricher, "udf": udf_enricher}


def enrich_stats(result: DataFrame) -> DataFrame:
    """One row: enriched, errors (from ``_status``)."""
    return result.agg(F.count_if(F.col("_status") == "enriched").alias("enriched"),
                      F.count_if(F.col("_status") == "error").alias("errors"))


def drop_status(result: DataFrame) -> DataFrame:
    return result.drop("_status")


__all__ = ["pending", "select_targets", "mark_targets", "backfill_from_content", "backfill_with_fetcher",
           "fetch_disabled", "retry", "mapping_enricher", "response_enricher", "ENRICHERS", "udf_enricher", "rules_enricher",
           "apply_results", "enrich_pending", "enrich_stats", "normalize_result", "nonblank"]
