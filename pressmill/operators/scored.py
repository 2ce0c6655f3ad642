"""Scoring a table of articles and rescoring an existing pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.config import ScoreSettings
from pressmill.functions import keywords as kw
from pressmill.functions import scoring as sc
from pressmill.functions.terms import TermIndex
from pressmill.functions.text import candidate_id, clean, first_text, preview
from pressmill.functions.urls import url_host
from pressmill.operators.similar import best_similarity

CARRIED = (
    "source", "country_region", "language", "published_date", "url", "source_section", "source_type",
    "source_priority", "max_articles_per_run", "extraction_warning",
)


def known_history_terms(samples: DataFrame | None, settings: ScoreSettings, keywords: str = "keywords") -> list[str]:
    """Dictionary terms that occur among the words of historical keyword texts.

    Only terms of the dictionary can overlap with it, so the answer never holds more
    entries than the dictionary, however long the history is.
    """
    if samples is None:
        return []
    terms = sorted({k.term.strip().lower() for k in settings.keywords if len(k.term.strip()) >= 2})
    if not terms:
        return []
    words = samples.select(F.explode(F.split(F.lower(clean(keywords)), r"[,;；、\s]+")).alias("word"))
    return [r.word for r in words.where(F.col("word").isin(*terms)).distinct().collect()]


def score_parts(df: DataFrame, settings: ScoreSettings, samples: DataFrame | None = None, *, sample_title: str = "title", sample_keywords: str = "keywords") -> DataFrame:
    """Add tidy text, keyword matches and one ``part_*`` column per part to each article.

    The parts are plain columns: fields of a struct would be expanded into every use.
    """
    terms, profile = settings.terms, settings.profile
    out = df
    for c in ("extraction_warning", "source_type", "country_region"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
    if "source_priority" not in out.columns:
        out = out.withColumn("source_priority", F.lit(1))
    out = out.withColumn("_t", clean("title_original")).withColumn("_x", clean("raw_text"))
    if samples is None:
        out = out.withColumn("title_similarity", F.lit(0.0))
    else:
        out = best_similarity(out, samples, "_t", sample_title)
    out = out.withColumn("_all", F.concat_ws(" ", "_t", "_x", clean("extraction_warning")))
    # lower-cased once, and read once for all terms of the dictionary and of the lists
    topic_text = clean("raw_text_preview") if "raw_text_preview" in df.columns else F.lit("")
    index = TermIndex(kw.dictionary(settings.keywords), sc.searched_lists(terms, profile))
    found = index.in_article(F.lower("_t"), F.lower("_x"), F.lower(clean("extraction_warning")), F.when(F.col("_x") == "", F.lower(topic_text)).otherwise(""))
    out = out.withColumn("_found", found).withColumn("_low", F.lower("_all")).withColumn("matches", F.col("_found.matches"))
    text, low = F.col("_low"), index.found(F.col("_found.low"))
    title, body, both = (index.found(F.col(f"_found.{part}")) for part in ("title", "body", "both"))
    history = known_history_terms(samples, settings, sample_keywords)
    region = sc.region_preference(low, "country_region", terms, profile)
    parts = {
        "relevance": kw.keyword_score("matches"),
        "info": sc.info_score(text, low),
        "strategy": sc.strategic_score(low, terms),
        "novelty": sc.novelty_score(low, terms),
        "authority": sc.authority_score("source_type", "source_priority"),
        "compilable": sc.compilable_score(F.col("_t"), F.col("_x")),
        "policy": sc.policy_score(low, "source_type", terms),
        "region_bonus": region["bonus"],
        "region_penalty": region["penalty"],
        "region_entity": region["entity"],
        "from_region": region["from_region"],
        "similarity_bonus": sc.similarity_bonus(F.col("title_similarity")),
        "history_bonus": kw.history_bonus("matches", history),
        "negative_penalty": sc.negative_penalty(F.col("_all"), low, terms),
        "consumer": sc.consumer_topic(low, terms),
        "excluded": sc.excluded_by_terms(title, body, both, terms),
        "type": sc.suggested_type("matches", low, terms),
    }
    return out.withColumns({f"part_{name}": value for name, value in parts.items()})


PARTS = (
    "relevance", "info", "strategy", "novelty", "authority", "compilable", "policy", "region_bonus",
    "region_penalty", "region_entity", "from_region", "similarity_bonus", "history_bonus",
    "negative_penalty", "consumer", "excluded",
)


def score_articles(df: DataFrame, settings: ScoreSettings, samples: DataFrame | None = None, *, keep: tuple[str, ...] = ("seq", "run_date"), sample_title: str = "title", sample_keywords: str = "keywords") -> DataFrame:
    """Candidate rows: score, explanation, matches, suggested classes and carried columns."""
    base = score_parts(df, settings, samples, sample_title=sample_title, sample_keywords=sample_keywords)
    p = {name: F.col(f"part_{name}") for name in PARTS}
    raw = (
        p["relevance"] + p["info"] + p["strategy"] + p["novelty"] + p["authority"] + p["compilable"]
        + p["policy"] + p["region_bonus"] + p["similarity_bonus"] + p["history_bonus"]
        - p["negative_penalty"] - p["region_penalty"]
    )
    label = "/".join(settings.profile.preferred_regions) or "profile region"
    carried = [F.col(c) if c in base.columns else F.lit("").alias(c) for c in CARRIED]
    domain = url_host("url")
    if "source_domain" in df.columns:
        domain = first_text("source_domain", domain)
    kept = [F.col(c) for c in keep if c in df.columns]
    return base.select(
        *kept,
        candidate_id("url", "title_original").alias("candidate_id"),
        sc.total_score(raw, p["consumer"], p["excluded"]).alias("score"),
        sc.explanation(p, label).alias("recommended_reason"),
        F.col("_t").alias("title_original"),
        F.lit("").alias("title_translated_candidate"),
        *carried,
        domain.alias("source_domain"),
        kw.keyword_text("matches").alias("matched_keywords"),
        sc.reference_score(p["similarity_bonus"], p["history_bonus"]).alias("reference_similarity_score"),
        F.col("part_type").alias("suggested_type"),
        sc.suggested_soft_hard("matches", F.col("_all"), settings.terms).alias("suggested_soft_hard"),
        preview("_x").alias("raw_text_preview"),
        F.col("_x").alias("raw_text"),
        F.lit("").alias("selected"),
        F.lit("").alias("notes"),
    )


RESCORED = ("score", "recommended_reason", "matched_keywords", "reference_similarity_score")
KEPT_IF_GIVEN = ("candidate_id", "suggested_type", "suggested_soft_hard", "raw_text_preview")


def rescore_pool(pool: DataFrame, settings: ScoreSettings, samples: DataFrame | None = None, *, seq: str = "seq") -> DataFrame:
    """New scores for an existing pool; existing id, classes and preview stay."""
    article = pool.withColumn("raw_text", first_text("raw_text", "raw_text_preview"))
    if "source_priority" not in pool.columns:
        article = article.withColumn("source_priority", F.lit(3))
    scored = score_articles(article, settings, samples, keep=(seq,)).select(
        F.col(seq).alias("_seq"), *[F.col(c).alias(f"_new_{c}") for c in (*RESCORED, *KEPT_IF_GIVEN)]
    )
    out = pool.join(scored, F.col(seq) == F.col("_seq"))
    for c in RESCORED:
        out = out.withColumn(c, F.col(f"_new_{c}"))
    for c in KEPT_IF_GIVEN:
        out = out.withColumn(c, first_text(c, f"_new_{c}") if c in pool.columns else F.col(f"_new_{c}"))
    return out.drop("_seq", *[f"_new_{c}" for c in (*RESCORED, *KEPT_IF_GIVEN)])
