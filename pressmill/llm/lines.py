"""Line deduplication with a tree of line templates, in DataFrame functions only.

Contract. A text is cut into lines at each \\n. A line's tokens are what stands between runs of space,
\\t, \\r, \\v and \\f; a token with a digit 0-9 counts as ``<*>``. The tree has fixed depth: lines with
as many tokens and equal first LEAD tokens share a leaf. Within a leaf the different token lines are
compared by position: a token is constant if more than half of them have it there. A line of which
SIMILARITY of the tokens or more are constant takes the leaf's template (the others become ``<*>``);
any other line is a template of its own. A template that MIN_DOCS documents or more hold recurs; its
lines are dropped from all documents but the one with the smallest id, so one copy of what many share
stays. Lines without tokens are never dropped.

A null text stays null and has no lines; an empty text has one line. Rows that repeat an id are one
document for the counts, and each is cleaned. Rows without an id are not counted and stay as they
are. An empty table gives an empty result. Further columns are carried along by ``without_recurring``.

Lines are compared by 128-bit hashes; only one line for each different one of the leaves that can
hold a shared template is read as text again. Leaves, templates and documents are counted in two
steps, so a line that a third of all documents hold is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import cut

LEAD = 3
SIMILARITY = 0.8
MIN_DOCS = 5
#: Only token beginnings can start a match, so a very long token is read once.
DIGIT_TOKEN = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+"


def token_line(line: Column) -> Column:
    """The line's tokens, single spaces between them, tokens with digits masked."""
    plain = F.trim(F.regexp_replace(line, "[ \\t\\r\\x0B\\f]+", " "))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, DIGIT_TOKEN, "<*>")).otherwise(plain)


def wide_hash(prefix: str, *columns: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*columns).alias(f"{prefix}1"), F.xxhash64(F.lit(7), *columns).alias(f"{prefix}2")]


def hashed_lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, tokens, lead, shape1, shape2)`` of all lines with tokens; a leaf is (tokens, lead)."""
    lines = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    shaped = lines.select("doc_id", "line_no", token_line(F.col("line")).alias("shape")).where("shape != ''")
    count = F.octet_length("shape") - F.octet_length(F.replace("shape", F.lit(" "), F.lit(""))) + 1
    return shaped.select(
        "doc_id", "line_no", count.cast("int").alias("tokens"), F.xxhash64(F.substring_index("shape", " ", LEAD)).alias("lead"),
        *wide_hash("shape", F.col("shape")),
    )


def of_common_leaves(lines: DataFrame) -> DataFrame:
    """The lines of leaves that MIN_DOCS documents hold; no template of another leaf can recur."""
    common = cut(
        lines.select("tokens", "lead", "doc_id").distinct().groupBy("tokens", "lead").count()
        .where(F.col("count") >= MIN_DOCS).select(F.col("tokens").alias("n"), F.col("lead").alias("l"))
    )
    return lines.join(common, (F.col("tokens") == F.col("n")) & (F.col("lead") == F.col("l")), "left_semi")


def templates(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """``(s1, s2, t1, t2, template)``: for the lines that take their leaf's template its hash and text."""
    wide = lines.where(F.col("tokens") > LEAD)
    leaves = cut(
        wide.select("tokens", "lead", "shape1", "shape2").distinct().groupBy(F.col("tokens").alias("l1"), F.col("lead").alias("l2"))
        .agg(F.count("*").alias("shapes")).where("shapes > 1")
    )
    # one place of each different line, grouped by document to read it there
    places = (
        wide.join(leaves, (F.col("tokens") == F.col("l1")) & (F.col("lead") == F.col("l2")))
        .groupBy("shape1", "shape2", "l1", "l2", "shapes").agg(F.min(F.struct("doc_id", "line_no")).alias("at"))
        .groupBy(F.col("at.doc_id").alias("p_id"))
        .agg(F.collect_list(F.struct("at.line_no", "shape1", "shape2", "l1", "l2", "shapes")).alias("places"))
    )
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    line = F.element_at(F.split("text", "\n", -1), F.col("place.line_no") + 1)
    read = texts.join(places, F.col("doc_id") == F.col("p_id")).select("text", F.explode("places").alias("place")).select(
        "place.*", token_line(line).alias("shape")
    )
    # a repeated id may have another text there: only the line that was meant counts
    meant = read.where((F.xxhash64("shape") == F.col("shape1")) & (F.xxhash64(F.lit(7), F.col("shape")) == F.col("shape2")))
    tokens = cut(
        meant.dropDuplicates(["shape1", "shape2"])
        .select("l1", "l2", "shapes", "shape1", "shape2", F.posexplode(F.split("shape", " ", -1)).alias("at", "token"))
    )
    constant = tokens.groupBy("l1", "l2", "at", "token").agg(F.count("*").alias("n"), F.max("shapes").alias("of")).where(
        F.col("n") * 2 > F.col("of")
    )
    kept = constant.select(F.col("l1").alias("c1"), F.col("l2").alias("c2"), F.col("at").alias("c_at"), F.col("token").alias("c_token"))
    known = tokens.join(
        cut(kept),
        (F.col("l1") == F.col("c1")) & (F.col("l2") == F.col("c2")) & (F.col("at") == F.col("c_at")) & (F.col("token") == F.col("c_token")),
        "left",
    )
    return (
        known.groupBy(F.col("shape1").alias("s1"), F.col("shape2").alias("s2"))
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(
                F.struct("at", F.coalesce("c_token", F.lit("<*>")).alias("token"))
            )), lambda x: x["token"]), " ").alias("template"),
            (F.count("c_token") >= F.count("*") * F.lit(SIMILARITY)).alias("alike"),
        )
        .where("alike").select("s1", "s2", *wide_hash("t", F.col("template")), "template")
    )


def recurring_lines(docs: DataFrame) -> DataFrame:
    """``(__d_id, __gone)``: the numbers of the lines to drop from each document that has any."""
    lines = cut(of_common_leaves(cut(hashed_lines(docs))))
    merged = cut(templates(lines, docs))
    named = lines.join(merged, (F.col("shape1") == F.col("s1")) & (F.col("shape2") == F.col("s2")), "left").select(
        "doc_id", "line_no", F.coalesce("t1", "shape1").alias("t1"), F.coalesce("t2", "shape2").alias("t2")
    )
    holders = named.select("t1", "t2", "doc_id").distinct().groupBy("t1", "t2").agg(
        F.count("*").alias("holders"), F.min("doc_id").alias("first_id")
    )
    recurring = cut(
        holders.where(F.col("holders") >= MIN_DOCS).select(F.col("t1").alias("r1"), F.col("t2").alias("r2"), "first_id")
    )
    return (
        named.join(recurring, (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")))
        .where("doc_id != first_id").groupBy(F.col("doc_id").alias("__d_id")).agg(F.collect_set("line_no").alias("__gone"))
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """All rows and columns of docs with the remaining text, and ``__lines``, ``__dropped``."""
    found = recurring_lines(docs)
    split = F.split("text", "\n", -1)
    left = F.filter(split, lambda line, at: ~F.array_contains("__gone", at))
    joined = docs.join(found, docs["doc_id"] == F.col("__d_id"), "left")
    counted = joined.withColumns({
        "__lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(split)),
        "__rest": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")),
        "__dropped": F.when(F.col("__gone").isNull() | F.col("text").isNull(), 0).otherwise(F.size(split) - F.size(left)),
    })
    return counted.withColumn("text", F.col("__rest")).select(*docs.columns, "__lines", "__dropped")


def line_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_md5)`` of every row."""
    return cleaned(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"),
        F.md5("text").alias("kept_md5"),
    )


def without_recurring(docs: DataFrame) -> DataFrame:
    return cleaned(docs).select(*docs.columns)


#: The same for DuckDB; with {docs} for the table.
CLEANED_SQL = f"""
    lines as (
        select doc_id, line_no, line, trim(regexp_replace(line, '[ \\t\\r\\x0B\\f]+', ' ', 'g'), ' ') as plain
        from (
            select doc_id, unnest(string_split(text, chr(10))) as line,
                   generate_subscripts(string_split(text, chr(10)), 1) as line_no
            from {{docs}} where doc_id is not null and text is not null
        )
    ),
    shaped as (
        select doc_id, line_no, string_split(shape, ' ') as tokens, shape
        from (select *, regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') as shape from lines) where shape != ''
    ),
    leafed as (
        select *, len(tokens) as n, array_to_string(tokens[1:{LEAD}], ' ') as lead from shaped
    ),
    shapes as (select distinct n, lead, shape, tokens from leafed where n > {LEAD}),
    sizes as (select n, lead, count(*) as shapes from shapes group by all having count(*) > 1),
    cells as (
        select n, lead, shape, shapes, unnest(tokens) as token, generate_subscripts(tokens, 1) as pos
        from shapes join sizes using (n, lead)
    ),
    constants as (
        select n, lead, pos, token from cells group by n, lead, pos, token having count(*) * 2 > max(shapes)
    ),
    merged as (
        select shape, string_agg(case when k.token is null then '<*>' else c.token end, ' ' order by c.pos) as template
        from cells c left join constants k on c.n = k.n and c.lead = k.lead and c.pos = k.pos and c.token = k.token
        group by c.n, c.lead, shape having count(k.token) >= count(*) * {SIMILARITY}
    ),
    named as (
        select doc_id, line_no, coalesce(template, l.shape) as template
        from leafed l left join merged m on l.shape = m.shape
    ),
    recurring as (
        select template, min(doc_id) as first_id from named group by template having count(distinct doc_id) >= {MIN_DOCS}
    ),
    dropped as (
        select doc_id, list(distinct line_no) as gone
        from named join recurring using (template) where doc_id != first_id group by doc_id
    ),
    cleaned as (
        select d.* exclude (text), text is null as no_text, len(string_split(text, chr(10))) as n_lines,
               case when gone is null then text else array_to_string(
                   [x[1] for x in list_zip(string_split(text, chr(10)), range(1, len(string_split(text, chr(10))) + 1))
                    if not list_contains(gone, x[2])], chr(10)) end as text,
               case when gone is null then 0 else len(list_intersect(gone, range(1, len(string_split(text, chr(10))) + 1))) end as n_dropped
        from {{docs}} d left join dropped using (doc_id)
    )"""

DIGEST_SQL = (
    "with" + CLEANED_SQL.format(docs="documents") + """
    select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(n_dropped as bigint) as n_dropped, md5(text) as kept_md5
    from cleaned"""
)
