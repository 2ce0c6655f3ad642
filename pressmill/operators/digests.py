"""Digests from selected candidates: requests, responses, quality gate, repair, translation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill import fixed_values as fv
from pressmill.config import Profile
from pressmill.functions import text as tx
from pressmill.functions.text import clean, col, first_text
from pressmill.operators.lineage import cut_lineage

MIN_SELECTED = 450
MIN_USABLE = 80
REQUEST_FIELDS = (
    "title_original", "source", "url", "published_date", "language", "matched_keywords",
    "suggested_type", "suggested_soft_hard",
)
_TYPES = (fv.POLICY, fv.TECHNOLOGY, fv.INDUSTRY)
_CLASSES = (fv.SOFT_SCIENCE, fv.HARD_SCIENCE)


# ---------------------------------------------------------------------------
# full text of selected rows


def merge_full_text(candidates: DataFrame, fetched: DataFrame, *, url: str = "url") -> DataFrame:
    """Longer of stored and refetched text; title and date overwritten when given.

    ``fetched``: ``url, title_original, published_date, raw_text, extraction_warning``,
    one row per URL.
    """
    extra = ("title_original", "published_date", "raw_text", "extraction_warning")
    right = fetched.select(F.col("url").alias("_url"), *[F.col(c).alias(f"_f_{c}") for c in extra])
    joined = candidates.join(right, F.trim(F.col(url)) == F.col("_url"), "left")
    old, new = tx.source_text("raw_text", "raw_text_preview"), clean("_f_raw_text")
    longer = F.length(new) > F.length(old)
    size = F.greatest(F.length(old), F.length(new))
    warning = clean("_f_extraction_warning")
    status = fulltext_status(size, first_text(clean("_f_title_original"), "title_original"), url)
    existing = clean("extraction_warning")
    return joined.select(
        *[c for c in candidates.columns if c not in ("raw_text", "raw_text_preview", "title_original", "published_date", "extraction_warning")],
        F.when(longer, new).otherwise(first_text("raw_text", old)).alias("raw_text"),
        F.when(longer, tx.cut(new)).otherwise(F.col("raw_text_preview")).alias("raw_text_preview"),
        first_text(clean("_f_title_original"), "title_original").alias("title_original"),
        first_text(clean("_f_published_date"), "published_date").alias("published_date"),
        F.when(warning == "", F.coalesce("extraction_warning", F.lit("")))
        .otherwise(F.concat_ws("; ", F.nullif(existing, F.lit("")), warning)).alias("extraction_warning"),
        F.length(old).alias("before_chars"), size.alias("selected_fulltext_chars"),
        status.alias("selected_fulltext_status"),
        F.when((size < MIN_SELECTED) & (warning == ""), fv.WARN_FULLTEXT_SHORT).otherwise(warning).alias("selected_fulltext_warning"),
    )


def fulltext_status(chars: Column, title: Column | str, url: Column | str) -> Column:
    usable = (chars >= MIN_USABLE) | ((clean(title) != "") & (clean(url) != ""))
    return F.when(chars >= MIN_SELECTED, "ok").when(usable, "short").otherwise("failed")


# ---------------------------------------------------------------------------
# the model call


def with_generated(
    df: DataFrame, fn: Callable[[list[dict]], list[str | None]], request: str = "request", *,
    batch_size: int = 20, response: str = "response", error: str = "error", partitions: int | None = None,
) -> DataFrame:
    """Call ``fn`` on batches of request JSON texts; one response text per request.

    A batch that raises is retried row by row, so one bad request costs only itself; the
    reason is kept in ``error``.  The model is the slow part: pass ``partitions`` to set
    how many calls run at once.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(response, T.StringType()), T.StructField(error, T.StringType())])

    def call(batches):
        for pdf in batches:
            answers, errors = [], []
            for start in range(0, len(pdf), batch_size):
                requests = list(pdf[request].iloc[start:start + batch_size])
                try:
                    got = list(fn(requests))
                    if len(got) != len(requests):
                        raise ValueError("one response per request expected")
                    answers += got
                    errors += [None] * len(got)
                except Exception:
                    for one in requests:
                        try:
                            answers.append(fn([one])[0])
                            errors.append(None)
                        except Exception as exc:
                            answers.append(None)
                            errors.append(str(exc) or type(exc).__name__)
            yield pdf.assign(**{response: pd.Series(answers, index=pdf.index, dtype=object), error: pd.Series(errors, index=pdf.index, dtype=object)})

    source = df.repartition(partitions) if partitions else df
    return source.mapInPandas(call, schema)


def request_json(df: DataFrame, extra: dict[str, Column] | None = None, max_text: int | None = None) -> Column:
    text = tx.source_text("raw_text", "raw_text_preview")
    if max_text is not None:
        text = F.substring(text, 1, max_text)
    present = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in REQUEST_FIELDS]
    more = [v.alias(k) for k, v in (extra or {}).items()]
    return F.to_json(F.struct(*present, text.alias("news_text"), *more))


def normalize_response(df: DataFrame, profile: Profile, response: str = "response") -> DataFrame:
    """Digest columns from model text, with fallbacks to the candidate's own fields."""
    given = lambda name: F.coalesce(F.try_variant_get("_v", f"$.{name}", "string"), F.lit(""))
    words = F.try_variant_get("_v", "$.keywords", "array<string>")
    as_text = F.filter(F.transform(F.split(given("keywords"), ","), lambda p: F.trim(p)), lambda w: w != "")
    own = lambda name: F.col(name) if name in df.columns else F.lit("")
    kind = first_text(given("type"), own("suggested_type"), F.lit(fv.TECHNOLOGY))
    soft = first_text(given("soft_hard"), own("suggested_soft_hard"), F.lit(fv.HARD_SCIENCE))
    if profile.require_simplified_chinese:
        kind = F.when(kind.isin(*_TYPES), kind).otherwise(fv.TECHNOLOGY)
        soft = F.when(soft.isin(*_CLASSES), soft).otherwise(fv.HARD_SCIENCE)
    parsed = df.withColumn("_v", tx.model_json(response))
    return (
        parsed.withColumn("title_cn", clean(first_text(given("title_cn"), own("title_original"))))
        .withColumn("summary_cn", F.substring(clean(first_text(given("summary_cn"), own("raw_text_preview"))), 1, profile.max_summary_chars))
        .withColumn("keywords", F.coalesce(words, as_text))
        .withColumn("type", kind).withColumn("soft_hard", soft).drop("_v")
    )


def needs_script_repair(title: Column | str, summary: Column | str, profile: Profile) -> Column:
    if not profile.require_simplified_chinese:
        return F.lit(False)
    t, s = clean(title), clean(summary)
    return (
        (t == "") | (s == "") | ~t.rlike(tx.CJK_BASIC) | ~s.rlike(tx.CJK_BASIC)
        | F.concat_ws(" ", t, s).rlike(tx.KANA_OR_HANGUL)
    )


def quality_issue(title: Column | str, summary: Column | str, profile: Profile) -> Column:
    """First failing rule as text, empty text for a good digest."""
    t, s = clean(title), clean(summary)
    both = F.concat_ws(" ", t, s)
    marker = F.get(F.filter(tx.text_array(fv.PLACEHOLDER_MARKERS), lambda m: F.contains(both, m)), F.lit(0))
    out = F.when((t == "") | (s == ""), fv.ISSUE_EMPTY)
    if profile.require_simplified_chinese:
        out = out.when(needs_script_repair(t, s, profile), fv.ISSUE_SCRIPT)
    out = out.when(marker.isNotNull(), F.concat(F.lit(fv.ISSUE_MARKER), marker))
    if profile.require_simplified_chinese:
        out = out.when(tx.cjk_chars(s) < 45, fv.ISSUE_SHORT_CJK)
    else:
        out = out.when(F.length(s) < 80, fv.ISSUE_SHORT)
    return out.otherwise("")


def fallback_keywords(df: DataFrame) -> Column:
    if "matched_keywords" not in df.columns:
        return tx.text_array([])
    words = F.transform(F.split(F.coalesce("matched_keywords", F.lit("")), "[,;，；、]"), lambda w: clean(F.substring_index(w, ":", -1)))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.rlike(tx.KANA_OR_HANGUL)))


def with_fallback_digest(df: DataFrame) -> DataFrame:
    """Digest text made from source, topic and keywords; the gate rejects it by its wording."""
    words = fallback_keywords(df)
    own = lambda name: clean(name) if name in df.columns else F.lit("")
    kind = F.trim(own("suggested_type"))
    topic = F.coalesce(F.get(words, F.lit(0)), F.when(kind.isin(*_TYPES), kind), F.lit(fv.FALLBACK_TOPIC))
    source = first_text(own("source"), F.lit(fv.FALLBACK_SOURCE))
    existing = own("title_translated_candidate")
    good = existing.rlike(tx.CJK_BASIC) & ~existing.rlike(tx.KANA_OR_HANGUL)
    before, after = fv.FALLBACK_TITLE
    title = F.when(good, existing).otherwise(F.concat(source, F.lit(before), topic, F.lit(after)))
    shown = first_text(F.array_join(F.slice(words, 1, 4), "、"), topic)
    opening, rest = fv.FALLBACK_SUMMARY
    summary = F.substring(F.concat(source, F.lit(opening), shown, F.lit(rest)), 1, 260)
    return (
        df.withColumn("_t", title).withColumn("_s", summary).withColumn("keywords", F.slice(words, 1, 8))
        .withColumn("type", first_text(own("suggested_type"), F.lit(fv.TECHNOLOGY)))
        .withColumn("soft_hard", first_text(own("suggested_soft_hard"), F.lit(fv.HARD_SCIENCE)))
        .withColumn("title_cn", F.col("_t")).withColumn("summary_cn", F.col("_s")).drop("_t", "_s")
    )


def with_demo_digest(df: DataFrame, *, allow_demo: bool) -> DataFrame:
    """Digest straight from the candidate's text, only when explicitly allowed."""
    if not allow_demo:
        raise ValueError("demo digests must be allowed explicitly")
    own = lambda name: clean(name) if name in df.columns else F.lit("")
    text = tx.source_text("raw_text", "raw_text_preview")
    body = F.when(F.length(text) > 200, F.concat(F.rtrim(F.substring(text, 1, 200)), F.lit("。"))).otherwise(text)
    words = F.transform(F.split(F.translate(own("matched_keywords"), ";", ","), ","), lambda w: F.trim(F.substring_index(w, ":", -1)))
    return (
        df.withColumn("title_cn", first_text(own("title_translated_candidate"), own("title_original")))
        .withColumn("summary_cn", first_text(body, F.lit(fv.DEMO_EMPTY_TEXT)))
        .withColumn("keywords", F.slice(F.filter(words, lambda w: w != ""), 1, 8))
        .withColumn("type", first_text(own("suggested_type"), F.lit(fv.TECHNOLOGY)))
        .withColumn("soft_hard", first_text(own("suggested_soft_hard"), F.lit(fv.HARD_SCIENCE)))
    )


_DIGEST = ("title_cn", "summary_cn", "keywords", "type", "soft_hard")


def generate(df: DataFrame, fn, profile: Profile, *, attempts: int = 2, batch_size: int = 20, partitions: int | None = None, mode: str = "model") -> DataFrame:
    """Digest of every row with ``issue`` (empty when good) and ``generation_mode``.

    Rows that fail the gate are sent again: with the previous text in the request, or,
    from the second repair on, as a clean-up request when only the script is wrong.  Rows
    that still fail get the fallback text.
    """
    columns = df.columns
    call = lambda rows: with_generated(rows, fn, batch_size=batch_size, partitions=partitions)

    def judged(rows: DataFrame) -> DataFrame:
        out = normalize_response(rows, profile)
        failed = F.col("error").isNotNull()
        return out.withColumn(
            "issue", F.when(failed, F.concat(F.lit(fv.ISSUE_FAILED), F.col("error"))).otherwise(quality_issue("title_cn", "summary_cn", profile))
        ).withColumn("generation_mode", F.when(failed, "failed").otherwise(mode)).drop("response", "request", "error")

    first = cut_lineage(judged(call(df.withColumn("request", request_json(df)))))
    finished = first.where((F.col("issue") == "") | (F.col("generation_mode") == "failed"))
    if not profile.require_simplified_chinese:
        return first
    open_rows = first.where((F.col("issue") != "") & (F.col("generation_mode") != "failed"))
    for attempt in range(1, attempts + 1):
        previous = open_rows.select(*columns, *[F.col(c).alias(f"_p_{c}") for c in _DIGEST])
        repair = request_json(
            previous,
            {"previous_title_cn": F.col("_p_title_cn"), "previous_summary_cn": F.col("_p_summary_cn"), "repair_attempt": F.lit(attempt)},
            max_text=5000,
        )
        if attempt > 1:
            tidy_up = F.to_json(F.struct(*[F.col(f"_p_{c}").alias(c) for c in _DIGEST]))
            repair = F.when(needs_script_repair("_p_title_cn", "_p_summary_cn", profile), tidy_up).otherwise(repair)
        again = cut_lineage(judged(call(previous.withColumn("request", repair))))
        # a repair call that failed leaves the previous text in place for the next one
        lost = F.col("generation_mode") == "failed"
        for c in _DIGEST:
            again = again.withColumn(c, F.when(lost, F.col(f"_p_{c}")).otherwise(F.col(c)))
        again = again.withColumn("issue", F.when(lost, quality_issue("title_cn", "summary_cn", profile)).otherwise(F.col("issue")))
        again = again.withColumn("generation_mode", F.lit(mode)).select(*first.columns)
        finished = finished.unionByName(again.where(F.col("issue") == ""))
        open_rows = again.where(F.col("issue") != "")
    rest = with_fallback_digest(open_rows.select(*columns)).withColumn("generation_mode", F.lit(mode))
    rest = rest.withColumn("issue", quality_issue("title_cn", "summary_cn", profile))
    return finished.unionByName(rest.select(*first.columns))


def accepted_digests(generated: DataFrame) -> DataFrame:
    return generated.where(F.col("issue") == "").withColumn(
        "source_text_chars", F.length(tx.source_text("raw_text", "raw_text_preview"))
    )


def quality_report(generated: DataFrame) -> DataFrame:
    return generated.where(F.col("issue") != "").select(
        "title_original", "source", "url", "issue", "generation_mode",
        F.length(tx.source_text("raw_text", "raw_text_preview")).alias("source_text_chars"),
    )


# ---------------------------------------------------------------------------
# titles


def translate_titles(df: DataFrame, fn, *, key: str = "candidate_id", batch_sizes: Sequence[int] = (20, 5, 1)) -> DataFrame:
    """Fill ``title_translated_candidate`` of Korean titles.

    ``fn`` takes request JSON texts ``{candidate_id, title}`` and returns JSON texts with
    ``title_cn``.  What stays unresolved is asked again in smaller batches.  Invalid
    translations are discarded.
    """
    todo = df.where(tx.needs_translation("title_original", "title_translated_candidate", "language"))
    open_rows = todo.select(F.col(key).alias("_id"), clean("title_original").alias("_title")).distinct()
    resolved = None
    for size in batch_sizes:
        request = F.to_json(F.struct(F.col("_id").alias("candidate_id"), F.col("_title").alias("title")))
        answered = with_generated(open_rows.withColumn("request", request), fn, batch_size=size)
        parsed = tx.model_json("response")
        raw = F.coalesce(F.try_variant_get(parsed, "$.title_cn", "string"), F.try_variant_get(parsed, "$.translation", "string"))
        checked = cut_lineage(answered.withColumn("_new", tx.normalize_translation(raw)).withColumn(
            "_ok", tx.valid_translation("_new", "_title")
        ).select("_id", "_title", "_new", "_ok"))
        good = checked.where("_ok").select("_id", "_new")
        resolved = good if resolved is None else resolved.unionByName(good)
        open_rows = checked.where(~F.col("_ok")).select("_id", "_title")
    chosen = resolved.groupBy("_id").agg(F.min("_new").alias("_new"))
    out = df.join(chosen, F.col(key) == F.col("_id"), "left")
    return out.withColumn("title_translated_candidate", F.coalesce("_new", "title_translated_candidate")).drop("_id", "_new")
