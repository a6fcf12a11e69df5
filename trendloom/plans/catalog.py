"""The registered queries: every operator run over the document-shaped views.

A query takes (spark, sf_dir) and returns a DataFrame. Doubles are rounded to six places, since
sums depend on the order of partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom import schemas as S
from trendloom.functions import answers, arrays, ids, labels, text
from trendloom.operators import (
    agreement, bayes, compare, corpus, keywords, profile, publications, reshape, results, sampling, scoring, trends,
)
from trendloom.plans import lifecycle
from trendloom.plans.stub import make_stub
from trendloom.plans.views import Tables
from trendloom.session import scratch_dir
from trendloom.sources import archives, delimited, sinks
from trendloom.streaming.incremental import score_landing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def query(name: str):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))
        return build

    return register


def labelled(t: Tables) -> DataFrame:
    return profile.typed_labels(t.classification, "is_genuine_ai", "is_llm_related")


def genuine(t: Tables) -> DataFrame:
    return profile.genuine(labelled(t))


def grouped(t: Tables) -> DataFrame:
    return profile.with_tech_groups(genuine(t))


# --- sources and sinks -----------------------------------------------------

CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


@query("scan_csv_strings")
def _(t):
    path = scratch_dir(t.spark, "csv")
    t.texts.select(F.concat(F.lit(" "), "doc_id", F.lit(" ")).alias(" doc_id "), "lang", "text").write.options(**CSV).csv(path)
    return delimited.read_csv_strings(t.spark, path, ids=["doc_id"])


@query("scan_csv_typed")
def _(t):
    path = scratch_dir(t.spark, "csv")
    columns = ["ep_id", "year", "is_genuine_ai", "ai_technique", "confidence"]
    t.classification.select(columns).write.options(**CSV).csv(path)
    schema = S.struct(ep_id=S.STRING, year=S.INT, is_genuine_ai=S.BOOL, ai_technique=S.STRING, confidence=S.STRING)
    return delimited.read_csv_typed(t.spark, path, schema)


def write_lines(rows: DataFrame, header: str, line, path: str, partition: str | None = None) -> None:
    """Tab-separated files as they come from outside: unquoted lines under a header."""
    columns = [line.alias(header)] + ([F.col(partition)] if partition else [])
    writer = rows.select(*columns).write.options(header=True, sep="\x01", quote="\x02", escape="\x02")
    (writer.partitionBy(partition) if partition else writer).csv(path)


@query("scan_bulk_tsv")
def _(t):
    """One line in sixteen carries a field too many and is skipped, as many lack their last one."""
    path = scratch_dir(t.spark, "tsv")
    number = F.substring(F.md5(F.concat("patent_id", "text")), 1, 1)
    line = F.concat_ws(
        "\t", "patent_id", "seq", F.when(number != "0", F.col("text")), F.when(number == "1", F.lit("surplus"))
    )
    write_lines(t.claims, "patent_id\tseq\ttext", line, path)
    schema = S.struct(patent_id=S.STRING, seq=S.STRING, text=S.STRING)
    return delimited.read_bulk_tsv(t.spark, path, schema).drop("file_path")


@query("scan_bulk_tsv_quoted")
def _(t):
    """Whole texts, with their line breaks, tabs and quotes, in quoted fields."""
    path = scratch_dir(t.spark, "tsv")
    t.texts.select("doc_id", "lang", "text").write.options(**CSV, sep="\t").csv(path)
    return delimited.read_bulk_tsv(t.spark, path, S.struct(doc_id=S.STRING, lang=S.STRING, text=S.STRING)).drop("file_path")


@query("land_zip_archives")
def _(t):
    root, out = scratch_dir(t.spark, "zip"), scratch_dir(t.spark, "landed")
    lifecycle.zip_partitions(t.claims.select("patent_id", "seq", "text").repartition("patent_id"), root)
    archives.land_archives(t.spark, root, out, ["patent_id", "seq", "text"])
    return t.spark.read.parquet(out).where(F.col("error").isNull()).select("patent_id", "seq", "text")


@query("scan_yearly_files")
def _(t):
    root = scratch_dir(t.spark, "yearly")
    prefix = F.when(F.col("claim_type") == "granted", "g").otherwise("pg")
    rows = t.claims.withColumn("file", F.format_string("%s_claims_%d.tsv", prefix, "year"))
    # A few tasks write each year, so that the years' sizes don't bound the writers; even years order their columns otherwise.
    rows = rows.repartition("file", F.pmod(F.xxhash64("patent_id"), F.lit(2)))
    for folder, kind, number in (("g", "granted", "patent_id"), ("pg", "pregrant", "document_number")):
        own = rows.where(F.col("claim_type") == kind)
        straight, turned = F.concat_ws("\t", "patent_id", "seq", "text"), F.concat_ws("\t", "text", "patent_id", "seq")
        write_lines(own.where("year % 2 = 1"), f"{number}\tclaim_sequence\tclaim_text", straight, f"{root}/{folder}1", "file")
        write_lines(own.where("year % 2 = 0"), f"claim_text\t{number}\tclaim_sequence", turned, f"{root}/{folder}0", "file")
    files = {"granted": f"{root}/g[01]/file=g_claims_*.tsv", "pregrant": f"{root}/pg[01]/file=pg_claims_*.tsv"}
    return delimited.read_yearly_claims(t.spark, files)


@query("resolve_columns")
def _(t):
    renamed = t.claims.select(
        F.col("text").alias("Claim_Text"), F.col("seq").alias("claim_sequence "), F.col("patent_id").alias("Patent_ID"), "year"
    )
    return delimited.select_roles(renamed, delimited.CLAIM_ROLES)


@query("scan_publications_nested")
def _(t):
    return t.publications().select(
        "publication_number", "publication_date", F.concat_ws("|", F.col("cpc.code")).alias("codes"),
        F.coalesce(F.array_size("priority_claim.filing_date"), F.lit(0)).alias("n_priorities"),
    )


@query("union_variant_rows")
def _(t):
    rows = t.classification
    good = rows.where(F.col("status") == "success").select("doc_id", "status", "ai_technique")
    bad = rows.where(F.col("status") != "success").select("doc_id", "status", F.lit("no answer").alias("raw_response"))
    return sinks.union_variant_rows(good, bad)


@query("write_projected")
def _(t):
    path = scratch_dir(t.spark, "projected")
    columns = ["ep_id", "year", "cpc", "is_genuine_ai", "ai_technique", "status"]
    sinks.write_projected(t.classification, columns, path)
    return t.spark.read.parquet(path)


@query("write_summary_report")
def _(t):
    return profile.summary_report(labelled(t))


# --- ids and universe ------------------------------------------------------


@query("id_kind")
def _(t):
    return t.universe.select("doc_id", ids.id_kind(F.col("doc_id")).alias("kind"))


@query("reissue_join_key")
def _(t):
    titles = t.granted_titles.select(ids.join_key(F.col("patent_id")).alias("key"), "patent_title")
    docs = t.universe.select("doc_id", ids.join_key(F.col("doc_id")).alias("key"))
    return docs.join(titles, "key").select("doc_id", "key", "patent_title")


@query("universe_counts")
def _(t):
    return corpus.universe_counts(t.universe)


@query("restrict_to_universe")
def _(t):
    return corpus.restrict_to_universe(t.claims, t.universe, "patent_id")


@query("first_seen_dedup")
def _(t):
    return reshape.keep_first(t.claims, ["patent_id"], ["year", "seq", "text"])


@query("source_tag")
def _(t):
    return t.universe.select("doc_id", ids.source_tag(F.col("doc_id")).alias("source"))


# --- projections and predicates --------------------------------------------


@query("text_flags")
def _(t):
    docs = t.documents.select("doc_id", F.col("text").alias("abstract"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"))
    return corpus.text_flags(docs).select("doc_id", "has_title", "has_abstract")


@query("presence_flags")
def _(t):
    return corpus.presence_flags(t.model_input).select("doc_id", "has_abstract", "has_claim", "has_both")


@query("truncate_text")
def _(t):
    body = F.col("text")
    return t.documents.select(
        "doc_id", text.truncate(body, S.CLAIM_CHARS).alias("claim"), text.truncate(body, S.ABSTRACT_CHARS).alias("abstract"),
        text.truncate(body, S.RAW_CHARS).alias("raw"), text.ellipsize(body).alias("shown"),
    )


@query("status_filter")
def _(t):
    return profile.successes(t.classification).select("doc_id", "status")


@query("genuine_split")
def _(t):
    ok = profile.successes(labelled(t))
    return profile.genuine(ok).select("doc_id", F.lit("genuine").alias("part")).unionByName(
        profile.non_genuine(ok).select("doc_id", F.lit("non_genuine").alias("part"))
    )


@query("normalise_bool")
def _(t):
    words = t.classification.select("doc_id", F.concat(F.lit(" "), F.upper("is_genuine_ai"), F.lit("\t")).alias("word"), "is_llm_related")
    return words.select(
        "doc_id", labels.normalise_bool(F.col("word")).alias("is_genuine_ai"),
        labels.normalise_bool(F.col("is_llm_related")).alias("is_llm_related"),
    )


@query("require_text")
def _(t):
    return corpus.require_text(t.model_input).select("doc_id", "abstract")


@query("recode_labels")
def _(t):
    return grouped(t).select("doc_id", "tech_grouped", "tech_grouped2")


@query("recode_nullable")
def _(t):
    return genuine(t).select("doc_id", labels.recode_nullable(F.col("ai_technique"), S.TECH_COMPARISON).alias("tech_cmp"))


@query("display_labels")
def _(t):
    return grouped(t).select(
        "doc_id", labels.caption(F.col("application_domain"), S.DOMAIN_CAPTIONS).alias("domain"),
        labels.caption(F.col("contribution_type"), S.CONTRIBUTION_CAPTIONS).alias("contribution"),
        labels.caption(F.col("tech_grouped"), S.TECH_GROUP_CAPTIONS).alias("technique"),
        labels.caption(F.col("tech_grouped2"), S.HEATMAP_TECH_CAPTIONS).alias("heat_technique"),
        labels.caption(F.col("application_domain"), S.HEATMAP_DOMAIN_CAPTIONS).alias("heat_domain"),
    )


@query("country_groups")
def _(t):
    c = F.col("applicant_country")
    return t.country.select("ep_id", c.isin(S.EU27).alias("is_eu27"), c.isin(S.EU10).alias("is_eu10"))


@query("year_range")
def _(t):
    return t.universe.where(F.col("year").between(S.REGRESSION_FROM_YEAR, S.LAST_YEAR))


@query("rename_prefix")
def _(t):
    old = t.classification.select("doc_id", *[F.col(c).alias(f"v4_{c}") for c in ("is_genuine_ai", "ai_technique", "innovation_orientation")])
    new = t.rater_pair.select("doc_id", F.col("second_genuine").alias("is_genuine_ai"))
    return new.join(old, "doc_id")


# --- joins -----------------------------------------------------------------


def assembled(t: Tables) -> DataFrame:
    return corpus.assemble_text(t.universe, t.granted_titles, t.granted_abstracts, t.pregrant_abstracts)


def claim_table(t: Tables) -> DataFrame:
    return corpus.first_claims(t.claims, t.universe)


def merged(t: Tables) -> DataFrame:
    return corpus.corpus_left_join(t.universe, assembled(t), claim_table(t))


@query("corpus_left_join")
def _(t):
    return sinks.project_columns(merged(t), corpus.MODEL_INPUT)


@query("model_corpus")
def _(t):
    docs = corpus.model_corpus(t.universe, t.granted_titles, t.granted_abstracts, t.pregrant_abstracts, t.claims)
    return sinks.project_columns(docs, corpus.MODEL_INPUT)


@query("assemble_text")
def _(t):
    return assembled(t)


@query("bridge_join")
def _(t):
    bridge = t.universe.select("doc_id", "year")
    base = t.classification.select("doc_id", "ai_technique")
    return reshape.lookup_join(base, ["doc_id"], [(bridge, ["year"])])


@query("text_join")
def _(t):
    base = t.classification.select("doc_id", "ai_technique")
    return reshape.lookup_join(base, ["doc_id"], [(t.texts.select("doc_id", "text"), ["text"])])


@query("anti_processed")
def _(t):
    done = t.classification.where(F.col("year") <= 2016)
    return scoring.unprocessed(t.universe, done)


@query("semi_target")
def _(t):
    return reshape.membership_join(t.universe, t.texts, ["doc_id"], "left_semi")


@query("result_input_zip")
def _(t):
    prompts = t.texts.select("doc_id", "lang", F.col("text").alias("prompt"))
    return scoring.score_batches(prompts, lambda: lambda batch: [str(len(p)) for p in batch])


def us_investment(t: Tables) -> DataFrame:
    return trends.literal_dimension(t.spark, S.US_INVESTMENT, "year", "int")


def eu_investment(t: Tables) -> DataFrame:
    return trends.literal_dimension(t.spark, S.EU10_INVESTMENT, "year", "int")


@query("dim_lookup")
def _(t):
    counts = profile.count_by_year(genuine(t))
    return counts.join(F.broadcast(us_investment(t)), "year", "left")


def epo_countries(t: Tables) -> DataFrame:
    epo = genuine(t).where(F.col("office") == "EPO")
    return epo.select("ep_id", "year", "innovation_orientation").join(t.country.select("ep_id", "applicant_country"), "ep_id")


@query("label_country_join")
def _(t):
    return epo_countries(t)


@query("rater_pair_join")
def _(t):
    first = t.rater_pair.select("doc_id", "first_genuine", "first_technique")
    second = t.rater_pair.select("doc_id", "second_genuine", "second_technique")
    return first.join(second, "doc_id")


# --- nested arrays ---------------------------------------------------------


@query("pick_localized")
def _(t):
    return t.publications().select(
        "publication_number", arrays.pick_localized(F.col("title_localized")).alias("title"),
        arrays.pick_localized(F.col("abstract_localized"), require_text=True).alias("abstract"),
    )


@query("earliest_priority_country")
def _(t):
    return t.publications().select("publication_number", arrays.earliest_priority_country(F.col("priority_claim")).alias("country"))


@query("collect_codes")
def _(t):
    return t.publications().select("publication_number", F.concat_ws("|", arrays.collect_codes(F.col("cpc"))).alias("codes"))


@query("exists_text")
def _(t):
    return t.publications().where(arrays.has_long_text(F.col("abstract_localized"))).select("publication_number")


@query("exists_code_match")
def _(t):
    return t.publications().select(
        "publication_number", arrays.has_code(F.col("cpc"), S.CPC_CANDIDATE).alias("narrow"),
        arrays.has_code(F.col("cpc"), S.CPC_COUNTRY).alias("wide"),
    )


@query("first_code_match")
def _(t):
    codes = arrays.collect_codes(F.col("cpc"))
    return t.publications().select("publication_number", arrays.first_code(codes, S.CPC_CANDIDATE).alias("cpc"))


@query("not_exists_us_priority")
def _(t):
    return t.publications().where(arrays.no_us_priority(F.col("priority_claim"))).select("publication_number")


@query("first_country")
def _(t):
    return t.publications().select(
        "publication_number", arrays.first_country(F.col("assignee_harmonized")).alias("applicant_country"),
        arrays.first_country(F.col("inventor_harmonized")).alias("inventor_country"),
    )


@query("candidate_query")
def _(t):
    return publications.ordered_candidates(t.publications())


@query("country_query")
def _(t):
    return publications.applicant_countries(t.publications())


@query("year_from_yyyymmdd")
def _(t):
    day = F.col("publication_date")
    return t.publications().select(
        "publication_number", arrays.year_of_date(day).alias("parsed"), arrays.year_of_number(day).alias("divided")
    )


@query("number_prefix")
def _(t):
    return t.publications().select(
        "publication_number", (F.col("country_code") == "EP").alias("by_country"),
        F.col("publication_number").startswith("EP").alias("by_number"),
    )


# --- first claims ----------------------------------------------------------


@query("first_claim")
def _(t):
    return corpus.first_claim(t.claims)


@query("first_claim_dedup")
def _(t):
    return claim_table(t)


@query("claim_coverage")
def _(t):
    return corpus.claim_coverage(corpus.claim_records(t.claims, t.universe), t.universe)


# --- aggregations ----------------------------------------------------------


@query("count_by_year")
def _(t):
    return profile.count_by_year(genuine(t))


@query("count_by_year_dense")
def _(t):
    return profile.count_by_year_dense(genuine(t))


@query("value_counts_topk")
def _(t):
    return profile.value_counts_topk(genuine(t), "application_domain", 10)


@query("crosstab")
def _(t):
    return profile.crosstab(genuine(t), "year", "innovation_orientation", S.ORIENTATIONS)


@query("fixed_crosstab")
def _(t):
    return profile.fixed_crosstab(grouped(t))


@query("row_share")
def _(t):
    return profile.row_share(profile.crosstab_long(genuine(t), "year", "innovation_orientation"), "year")


@query("share_of_total")
def _(t):
    return profile.share_of_total(genuine(t), "application_domain")


@query("conditional_share_by_year")
def _(t):
    return profile.conditional_share_by_year(genuine(t), F.col("innovation_orientation") == "applied", "office")


@query("coverage_report")
def _(t):
    return profile.coverage_report(corpus.presence_flags(t.model_input), "has_abstract", "has_claim", "has_both")


@query("coverage_by_year")
def _(t):
    return profile.coverage_by_year(corpus.presence_flags(t.model_input), "has_claim")


@query("label_summary")
def _(t):
    return profile.label_summary(labelled(t))


@query("all_dimension_profile")
def _(t):
    return profile.all_dimension_profile(genuine(t))


@query("missing_count")
def _(t):
    return profile.missing_count(t.model_input, "title", "abstract", "claim1_text")


@query("country_breakdown")
def _(t):
    return profile.country_breakdown(epo_countries(t), "applicant_country")


@query("country_year_matrix")
def _(t):
    return profile.country_year_matrix(epo_countries(t), "applicant_country", S.EU10)


# --- windows and trends ----------------------------------------------------


@query("yoy_jump")
def _(t):
    return trends.yoy_jump(profile.count_by_year(genuine(t)))


@query("avg_annual_change")
def _(t):
    return trends.avg_annual_change(profile.count_by_year(genuine(t)))


@query("stack_bounds")
def _(t):
    return trends.stack_bounds(profile.crosstab(grouped(t), "year", "tech_grouped", S.STACK_ORDER))


@query("first_last_value")
def _(t):
    shares = profile.row_share(profile.crosstab_long(genuine(t), "year", "innovation_orientation"), "year")
    return trends.first_last_value(shares, "innovation_orientation")


def growth(t: Tables) -> DataFrame:
    return trends.exp_growth_fit(profile.count_by_year(grouped(t), "tech_grouped"), "tech_grouped")


@query("exp_growth_fit")
def _(t):
    return growth(t).withColumns({"a": F.round("a", 2), "growth_pct": F.round("growth_pct", 3)})


@query("fit_curve_points")
def _(t):
    return rounded(trends.fit_curve_points(growth(t), "tech_grouped"), 2)


@query("linear_trend")
def _(t):
    shares = profile.conditional_share_by_year(genuine(t), F.col("innovation_orientation") == "applied", "office")
    return trends.linear_trend(shares, "share", "office")


@query("group_slope")
def _(t):
    return trends.group_slope(profile.count_by_year(epo_countries(t), "applicant_country"), "applicant_country")


@query("scatter_fit")
def _(t):
    totals = profile.value_counts(epo_countries(t), "applicant_country")
    amounts = trends.literal_dimension(t.spark, S.EU10_INVESTMENT_2023, "applicant_country", "string")
    return trends.scatter_fit(totals.join(F.broadcast(amounts), "applicant_country"), "amount", "n")


def regression_rows(t: Tables) -> DataFrame:
    """Counts of both offices from 2015 on, each with its own region's investment."""
    amounts = us_investment(t).withColumn("office", F.lit("USPTO")).unionByName(
        eu_investment(t).withColumn("office", F.lit("EPO"))
    )
    counts = profile.count_by_year(genuine(t).where(F.col("year") >= S.REGRESSION_FROM_YEAR), "office")
    return trends.regression_features(counts.join(F.broadcast(amounts), ["office", "year"]))


@query("log_log_ols")
def _(t):
    return trends.log_log_ols(regression_rows(t), "office")


@query("log_log_fitted")
def _(t):
    rows = regression_rows(t)
    fitted = trends.log_log_fitted(rows, trends.log_log_ols(rows, "office"), "office")
    return fitted.select("office", "year", "n", "fitted")


@query("r_squared")
def _(t):
    shares = profile.conditional_share_by_year(genuine(t), F.col("innovation_orientation") == "applied", "office")
    return trends.r_squared(trends.linear_trend(shares, "share", "office"), "share", "fitted", "office")


@query("covid_flag")
def _(t):
    return regression_rows(t)


# --- text and answers ------------------------------------------------------

SYSTEM = "Label the document."


@query("clean_text")
def _(t):
    return t.model_input.select("doc_id", text.clean_text(F.col("abstract")).alias("abstract"))


@query("build_prompt_full")
def _(t):
    return t.model_input.select(
        "doc_id", text.prompt_full(SYSTEM, F.col("title"), F.col("abstract"), F.col("claim1_text")).alias("prompt")
    )


@query("build_prompt_short")
def _(t):
    return t.model_input.select("doc_id", text.prompt_short(SYSTEM, F.col("title"), F.col("abstract")).alias("prompt"))


@query("build_prompt_pilot")
def _(t):
    title, abstract = F.col("title"), F.col("abstract")
    return corpus.require_text(t.model_input).select(
        "doc_id", text.prompt_pilot(title, abstract).alias("prompt"), text.prompt_abstract_only(abstract).alias("short_prompt")
    )


@query("strip_fence_any")
def _(t):
    return t.answers.select("k", answers.strip_fence_any(text.clean_text(F.col("answer"))).alias("body"))


@query("strip_fence_prefix")
def _(t):
    return t.answers.select("k", answers.strip_fence_prefix(text.clean_text(F.col("answer"))).alias("body"))


@query("slice_braces")
def _(t):
    return t.answers.select("k", answers.slice_braces(F.col("answer")).alias("body"))


PARSED = ["doc_id", "is_genuine_ai", "ai_technique", "confidence", "reasoning", "status"]


@query("parse_labels")
def _(t):
    return answers.parse_labels(t.answers, "answer", "braces").select(PARSED)


@query("parse_labels_prefix")
def _(t):
    return answers.parse_labels(t.answers, "answer", "prefix", S.SHORT_LABELS).select(PARSED)


@query("parse_status")
def _(t):
    skip = answers.skip_without_text(t.answers, "answer")
    found = answers.parse_labels(t.answers.withColumn("skip", skip), "answer", "pilot")
    return found.select("doc_id", F.coalesce("skip", "status").alias("status"), "raw_response")


@query("keyword_match")
def _(t):
    names = ["foundation", "federated", "agents", "distillation"]
    rows = genuine(t)
    return rows.select(
        "doc_id", *[keywords.keyword_match(F.col("reasoning"), p).alias(n) for n, p in zip(names, S.EMERGING_FAMILIES.values())]
    )


@query("emergence_rate")
def _(t):
    return keywords.emergence_rate(genuine(t), "reasoning")


# --- samples ---------------------------------------------------------------


def success_rows(t: Tables) -> DataFrame:
    return profile.successes(labelled(t))


@query("proportional_alloc")
def _(t):
    return sampling.proportional_alloc(labelled(t))


@query("stratified_sample")
def _(t):
    return sampling.stratified_sample(labelled(t), "doc_id").select("doc_id", "year", "rank")


@query("balanced_sample")
def _(t):
    return sampling.balanced_sample(success_rows(t), "doc_id").select("doc_id", "year", "is_genuine_ai", "rank")


@query("diverse_sample")
def _(t):
    return sampling.diverse_sample(success_rows(t), "doc_id").select("part", "rank", "doc_id", "ai_technique")


@query("review_sample")
def _(t):
    pool = sampling.stratified_sample(success_rows(t), "doc_id").drop("rank")
    return sampling.review_sample(pool, "doc_id", 60).select("part", "doc_id", "false_positive_reason")


@query("head_sample")
def _(t):
    rows = sampling.head_sample(corpus.presence_flags(t.model_input), "doc_id")
    return rows.select("doc_id", "year", "title", "abstract", "claim1_text")


# --- validation ------------------------------------------------------------


def raters(t: Tables) -> DataFrame:
    return t.rater_pair


@query("confusion")
def _(t):
    return agreement.confusion(raters(t), "first_genuine", "second_genuine")


@query("cohen_kappa")
def _(t):
    return agreement.cohen_kappa(raters(t), "first_technique", "second_technique")


@query("recall_f1")
def _(t):
    return agreement.recall_f1(raters(t), "first_genuine", "second_genuine", "office")


@query("agreement_rate")
def _(t):
    pairs = {
        "technique": ("first_technique", "second_technique"),
        "orientation": ("first_orientation", "second_orientation"),
    }
    return agreement.agreement_rate(raters(t), ["first_genuine", "second_genuine"], pairs)


@query("agreement_with_older_labels")
def _(t):
    """Orientation of genuine rows against an older run, where that one has a value."""
    pairs = {"orientation": ("second_orientation", "first_orientation")}
    return agreement.agreement_rate(raters(t), ["second_genuine"], pairs, present=["first_orientation"])


@query("combine_batches")
def _(t):
    return agreement.combine_batches(raters(t), "first_genuine", "second_genuine", "office")


@query("schema_conformance")
def _(t):
    return agreement.schema_conformance(t.classification)


@query("null_rule_check")
def _(t):
    return agreement.null_rule_check(labelled(t), ["ai_technique", "application_domain", "innovation_orientation"])


# --- scoring and incremental runs ------------------------------------------


def label_texts(docs: DataFrame) -> DataFrame:
    """Prompt, answer, labels: what a labelling run does with documents (doc_id, text)."""
    prompts = docs.select("doc_id", text.prompt_short(SYSTEM, F.lit(""), F.col("text")).alias("prompt"))
    return answers.parse_labels(scoring.score_batches(prompts, make_stub)).select(
        "doc_id", "is_genuine_ai", "ai_technique", "status"
    )


RESULTS = S.struct(doc_id=S.STRING, is_genuine_ai=S.BOOL, ai_technique=S.STRING, status=S.STRING)


@query("score_batches")
def _(t):
    prompts = t.model_input.select(
        "doc_id", "year", text.prompt_full(SYSTEM, F.col("title"), F.col("abstract"), F.col("claim1_text")).alias("prompt")
    )
    found = answers.parse_labels(scoring.score_batches(prompts, make_stub))
    return found.select("doc_id", "year", "is_genuine_ai", "ai_technique", "status")


# Documents whose id's digest opens with one of these digits are kept from the fit.
HELD_OUT = ["0", "1", "2"]


def judged_texts(t: Tables) -> DataFrame:
    """Every document with its human label, if it has one."""
    known = t.labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    held = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1).isin(HELD_OUT)
    return t.documents.select("doc_id", "text").join(known, "doc_id", "left").withColumn("held_out", held)


def fit_and_apply(docs: DataFrame) -> DataFrame:
    model = bayes.train_bayes(docs.where(~F.col("held_out")), "text", "toxic")
    return bayes.apply_bayes(model, docs).withColumnRenamed("found", "found_toxic")


@query("train_text_classifier")
def _(t):
    """Fitted on the labelled documents outside the held-out part, applied to all documents."""
    return fit_and_apply(judged_texts(t))


@query("classifier_holdout")
def _(t):
    """Over the labelled documents held out of the fit: how many are called right, by the model and
    by calling all of them what most labelled documents are."""
    docs = judged_texts(t)
    both = docs.drop("text").join(fit_and_apply(docs), "doc_id")
    judged = F.col("held_out") & F.col("toxic").isNotNull()
    right, mostly = F.col("found_toxic") == F.col("toxic"), F.count_if("toxic") * 2 > F.count("toxic")
    n = F.count_if(judged)
    found = both.agg(
        F.count("found_toxic").alias("n_scored"), F.count("toxic").alias("n_labelled"), n.alias("n_held_out"),
        (F.count_if(judged & right) / n).alias("accuracy"),
        (F.when(mostly, F.count_if(judged & F.col("toxic"))).otherwise(F.count_if(judged & ~F.col("toxic"))) / n).alias("majority_share"),
        (F.count_if(judged & right & F.col("toxic")) / F.nullif(F.count_if(judged & F.col("toxic")), F.lit(0))).alias("recall"),
    )
    return found


@query("resume_checkpoint")
def _(t):
    """A run over the early years, then one over everything: the second adds only the rest."""
    out = scratch_dir(t.spark, "results")
    docs = t.texts.select("doc_id", "text", "lang")
    scoring.append_results(label_texts(docs.where(F.col("lang") == "en")), out, 0)
    done = scoring.read_results(t.spark, out, RESULTS)
    scoring.append_results(label_texts(scoring.unprocessed(docs, done)), out, 1)
    return scoring.latest_results(scoring.read_results(t.spark, out, RESULTS)).drop("run")


@query("compacted_results")
def _(t):
    """Four batches, one of them written twice, merged into one folder: every document keeps one result."""
    out, docs = scratch_dir(t.spark, "results"), t.texts.select("doc_id", "text")
    digit = F.conv(F.substring(F.md5("doc_id"), 1, 1), 16, 10).cast("int")
    for number in (0, 1, 2, 3, 1):
        scoring.append_results(label_texts(docs.where(F.floor(digit / 4) == number)), out, number)
    results.compact(t.spark, out, RESULTS)
    return scoring.read_results(t.spark, out, RESULTS).drop("run")


def text_prompts(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", text.prompt_short(SYSTEM, F.lit(""), F.col("text")).alias("prompt"))


def make_failing_stub():
    """The stub, but for prompts whose digest's fourth digit is even it has no answer."""
    score = make_stub()

    def partly(prompts):
        if any(int(hashlib.md5(p.encode()).hexdigest()[3], 16) % 2 == 0 for p in prompts):
            raise RuntimeError("no answer")
        return score(prompts)

    return partly


@query("resumed_run")
def _(t):
    """A run over a third of the documents ends early; repeated over all, it labels only the rest."""
    out, prompts = scratch_dir(t.spark, "results"), text_prompts(t)
    early = prompts.where(F.substring(F.md5("doc_id"), 1, 1).isin("0", "1", "2", "3", "4"))
    for docs in (early, prompts):
        found = lifecycle.label_prompts(docs, make_stub, "braces", S.LABELS, results=out, rows_per_task=500, tasks_per_write=8)
    written = scoring.read_results(t.spark, out, S.struct(doc_id=S.STRING)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_results"))
    return found.join(written, "doc_id").select("doc_id", "is_genuine_ai", "ai_technique", "status", "n_results")


@query("retry_failed")
def _(t):
    """A scorer fails on half of the documents; they get error rows, which a second run replaces."""
    out, prompts = scratch_dir(t.spark, "results"), text_prompts(t)
    lifecycle.label_prompts(prompts, make_failing_stub, "braces", S.LABELS, results=out)
    second = lifecycle.label_prompts(prompts, make_stub, "braces", S.LABELS, results=out, retry_failed=True)
    written = scoring.read_results(t.spark, out, S.struct(doc_id=S.STRING, status=S.STRING))
    before = written.groupBy("doc_id").agg(F.min_by("status", "run").alias("first_status"))
    return second.join(before, "doc_id").select("doc_id", "is_genuine_ai", "ai_technique", "status", "first_status")


@query("incremental_stream")
def _(t):
    landing, out, log = (scratch_dir(t.spark, n) for n in ("landing", "results", "log"))
    docs = t.event_docs
    docs.repartitionByRange(4, "doc_id").write.parquet(landing)
    docs.where(F.col("text").contains("error")).write.mode("append").parquet(landing)
    schema = S.struct(doc_id=S.STRING, text=S.STRING)
    score_landing(t.spark, landing, schema, out, log, label_texts, RESULTS, files_per_batch=2)
    return scoring.read_results(t.spark, out, RESULTS).drop("run", "batch")


# --- sets, order, comparison -----------------------------------------------


@query("union_all")
def _(t):
    titles = t.granted_titles.select(F.col("patent_id").alias("doc_id"), F.lit("title").alias("kind"))
    abstracts = t.pregrant_abstracts.select(F.col("pgpub_id").alias("doc_id"), F.lit("abstract").alias("kind"))
    return titles.unionByName(abstracts)


@query("set_union")
def _(t):
    return t.granted_titles.select("patent_id").union(t.claims.select("patent_id")).distinct()


@query("sort_limit")
def _(t):
    return t.country.orderBy("year", "ep_id").limit(20)


@query("two_corpus_compare")
def _(t):
    return compare.side_by_side(compare.yearly_comparison(genuine(t)))


@query("two_corpus_techniques")
def _(t):
    return compare.technique_comparison(genuine(t))


# --- lifecycles ------------------------------------------------------------


@query("technique_share_by_year")
def _(t):
    return lifecycle.technique_share_by_year(t.classification)


@query("label_corpus")
def _(t):
    """Bulk tables to labels in one plan."""
    return lifecycle.label_corpus(
        t.universe, t.granted_titles, t.granted_abstracts, t.pregrant_abstracts, t.claims, SYSTEM, make_stub
    ).select("doc_id", "year", "is_genuine_ai", "ai_technique", "status")


@query("label_candidates")
def _(t):
    return lifecycle.label_candidates(t.publications(), SYSTEM, make_stub).select(
        "ep_id", "year", "cpc", "is_genuine_ai", "ai_technique", "status"
    )
