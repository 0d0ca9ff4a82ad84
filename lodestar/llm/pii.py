"""Personal data: entities by pattern, and information-theoretic sanitisation of the terms that reveal them.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that the patterns find. A
term (a run of letters and digits, lower-cased) co-occurs with an entity where it stands within `CONTEXT` code
points of it. With p(t) and p(e) the shares of all documents that hold the term and the entity, and p(t|e) the
share of the entity's occurrences with the term beside them,

    disclosure(t, e) = log(p(t|e) / p(t)) / -log p(e)

is the part of the entity's information that the term gives away: 1 where it stands with this entity only and
always, 0 where it is independent. Terms of at least `DISCLOSURE`, seen in at least `SUPPORT` different
contexts of the entity (copies of one passage count once), are spans too, wherever they stand: contexts only
rate a term, and a revealing one is then found in the words of all documents. Sanitised texts have placeholders
for entities, [NUM] for revealing numbers and [NAME] for revealing capitalised words; other revealing terms
are removed.

Everything runs as DataFrame operations; counts cover all documents. Defined results: null texts count as empty and stay
null in the pipeline; repeated rows and null ids count each for itself; an empty table gives an empty result; very long
texts are handled whole, in time proportional to their length and matches. The stage keeps other columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import Written, table
from lodestar.llm.spans import around, blanked, cut, located, replaced, written_out

CONTEXT = 60
DISCLOSURE = 0.9
SUPPORT = 3

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats match as the plain ones do, since what follows them is outside their class; they never go back.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(__text, '@')"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "__text rlike '[0-9][.][0-9]'"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "__text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(__text, '+')"),
}
_DIGITS = "regexp_replace(s.hit, '[^0-9]', '')"
_LUHN = f"""aggregate(zip_with(split(reverse({_DIGITS}), ''), sequence(1, length({_DIGITS})), (d, i) -> case
    when d = '' then 0 when i % 2 = 1 then int(d) when int(d) < 5 then 2 * int(d) else 2 * int(d) - 9 end), 0, (a, d) -> a + d) % 10 = 0"""
HOLDS = {
    "email": "true",
    "ip": "forall(split(s.hit, '[.]'), x -> x rlike '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
    "card": f"case when length({_DIGITS}) between 13 and 19 then {_LUHN} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
TERM = r"[\p{L}\p{N}]+"


def entities(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, __key (a hash of the text), __text, __spans: array of (kind, start, end, hit) by kind, then start."""
    slim = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    found = cut(slim, "__text", PATTERNS)
    parts = [f"transform(filter({located(f'__g_{k}', f'__m_{k}')}, s -> {HOLDS[k]}), s -> struct('{k}' as kind, s.start, s.end, s.hit))" for k in KINDS]
    return found.select(id_col, *keep, "__text", F.xxhash64("__text").alias("__key"), F.expr(f"concat({', '.join(parts)})").alias("__spans"))


# The text with blanks for its entities, so that places stay and words that touch an entity are told from it.
_BARE = blanked("__text", "array_sort(transform(__spans, s -> struct(s.start, s.end)))")


def contexts(found: DataFrame, id_col: str) -> DataFrame:
    """(__id, __key, entity, context, term): each term beside each entity, outside all entities.

    context is a hash of what stands on both sides of an occurrence. Words that the window cuts at its outer edge don't count.
    """
    rows = found.where("size(__spans) > 0").withColumn("__bare", F.expr(_BARE))
    sides = rows.select(F.col(id_col).alias("__id"), "__key", F.length("__text").alias("n"), F.expr(around("__bare", "__spans", CONTEXT)).alias("w"))
    one = sides.select("__id", "__key", "n", F.explode("w").alias("s"))  # texts stay behind
    left = F.expr(rf"case when s.of.start > {CONTEXT} then regexp_replace(s.before, r'^{TERM}', '') else s.before end")
    right = F.expr(rf"case when s.of.end + {CONTEXT} < n then regexp_replace(s.after, r'(?<![\p{{L}}\p{{N}}]){TERM}$', '') else s.after end")
    sides = one.select("__id", "__key", F.concat_ws(":", "s.of.kind", "s.of.hit").alias("entity"), F.xxhash64("s.before", "s.after").alias("context"), F.concat_ws(" ", left, right).alias("beside"))
    terms = F.array_distinct(F.regexp_extract_all(F.lower("beside"), F.lit(TERM), F.lit(0)))
    return sides.select("__id", "__key", "entity", "context", F.explode_outer(terms).alias("term"))


def disclosing(docs: DataFrame, beside: DataFrame, text_col: str) -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity. Counts combine before each shuffle."""
    once = beside.where("term is not null").groupBy("entity", "term", "context", "__id", "__key").agg(F.lit(1).alias("one"))
    pairs = once.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("support"))
    pairs = pairs.where(F.col("support") >= SUPPORT)
    occurrences = beside.groupBy("entity", "__id", "__key", "context").agg(F.lit(1).alias("one")).groupBy("entity", "__id", "__key").agg(F.count("*").alias("n"))
    by_entity = occurrences.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("docs_e"))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(TERM), F.lit(0)))).alias("term"))
    by_term = words.groupBy("term").agg(F.count("*").alias("docs_t"))
    total = docs.agg(F.count("*").alias("n_docs"))
    rated = pairs.join(by_entity, "entity").join(by_term, "term").join(F.broadcast(total))  # one row
    ratio = F.log(F.least(F.lit(1.0), F.col("n_te") / F.col("n_e")) * F.col("n_docs") / F.col("docs_t")) / -F.log(F.col("docs_e") / F.col("n_docs"))
    return rated.where(F.col("docs_e") < F.col("n_docs")).where(ratio >= DISCLOSURE).select("entity", "term", ratio.alias("disclosure"))


def revealing(found: DataFrame, id_col: str) -> DataFrame:
    """(__id, __key, __revealing): the revealing terms of each text that has some, whether it holds an entity or not.

    found: entities() of all texts, written. What is derived is written too, so that Spark broadcasts tables only where
    they are small; a term that is frequent in a large join is split by the adaptive plan.
    """
    keep = Written(found.sparkSession)
    beside = keep(contexts(found, id_col))
    terms = keep(disclosing(found, beside, "__text").select("term").distinct())
    bare = found.select(F.col(id_col).alias("__id"), "__key", F.expr(_BARE).alias("__bare"))
    words = bare.select("__id", "__key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("__bare"), F.lit(TERM), F.lit(0)))).alias("term"))
    return keep(words.join(terms, "term").groupBy("__id", "__key").agg(F.collect_set("term").alias("__revealing")))


def with_terms(found: DataFrame, terms: DataFrame, id_col: str) -> DataFrame:
    """entities() with __terms: the places (start, end, hit) of revealing terms, outside all entities."""
    rows = found.join(terms.withColumnRenamed("__key", "__key2"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__key2")), "left").drop("__key2", "__id")
    rows = rows.withColumn("__bare", F.expr(f"case when __revealing is not null then {_BARE} else '' end"))
    rows = cut(rows, "__bare", {"term": (TERM, "__revealing is not null")})
    return rows.withColumn("__terms", F.expr(f"filter({located('__g_term', '__m_term')}, s -> array_contains(__revealing, lower(s.hit)))"))


_TO = "case s.kind when 'email' then '[EMAIL]' when 'ip' then '[IP]' when 'card' then '[CARD]' else '[PHONE]' end"
_TERM_TO = r"case when s.hit rlike r'^\p{N}+$' then '[NUM]' when s.hit rlike r'^\p{Lu}' then '[NAME]' else '' end"
_CLEAN = replaced("__text", f"""array_sort(concat(transform(__spans, s -> struct(s.start, s.end, {_TO} as to)),
    transform(__terms, s -> struct(s.start, s.end, {_TERM_TO} as to))))""")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms, sanitised (the text without them)."""
    found = Written(docs.sparkSession)(entities(docs, id_col, text_col))
    rows = with_terms(found, revealing(found, id_col), id_col)
    rows = rows.withColumn("__all", F.expr("concat(transform(__spans, s -> struct(s.kind, s.start, s.end)), transform(__terms, s -> struct('term' as kind, s.start, s.end)))"))
    counts = [F.expr(f"bigint(size(filter(__spans, s -> s.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        id_col, *counts, F.expr(f"sha2({written_out('__spans')}, 256)").alias("base_sha256"), F.expr(written_out("__all")).alias("spans"), F.expr("bigint(size(__terms))").alias("n_terms"), F.expr(_CLEAN).alias("sanitised")
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    return found.withColumn("sanitised", F.sha2("sanitised", 256)).withColumnRenamed("sanitised", "sanitised_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their texts sanitised and n_chars, where it is a column, counted anew.

    Revealing terms go from every text, with an entity or without; they join by id and text. Null texts stay null.
    """
    other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    prepared = docs.select("doc_id", F.struct(*other).alias("__rest"), F.col("text").isNotNull().alias("__had"), "text")
    found = Written(spark)(entities(prepared, "doc_id", "text", ("__rest", "__had")))
    rows = with_terms(found, revealing(found, "doc_id"), "doc_id")
    done = rows.select("doc_id", "__rest", F.expr(f"case when __had then {_CLEAN} end").alias("text"))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return done.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"__rest.`{c}`")).alias(c) for c in docs.columns])
