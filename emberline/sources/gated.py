"""Sources asked only for topics they hold, and calls for funding: studies, devices, drugs, models, tenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import dates
from emberline.functions.text import casefold
from emberline.sources.connectors import V, first_nonempty, items, refs, register, union_last

# Words that make a topic one of machine learning, and parts of words that make it one of health.
ML_HINTS = (
    "model", "models", "neural", "llm", "llms", "vision", "speech", "transformer", "transformers", "diffusion",
    "embedding", "embeddings", "agent", "agents", "inference", "generative", "gpt", "nlp", "multimodal",
    "classification", "detection", "recognition", "ocr", "rag", "fine-tuning", "pretrained", "tokenizer",
    "language", "learning", "segmentation", "translation", "chatbot", "copilot", "reinforcement",
    "kv", "quantization", "distillation", "compression", "red-teaming", "jailbreak", "prompt",
)
HEALTH_HINTS = (
    "health", "medical", "medicine", "clinical", "biotech", "biomedical", "pharma", "drug",
    "diagnostic", "therapeutic", "therapy", "cancer", "vaccine", "patient", "disease",
    "insulin", "diabetes", "implant", "prosthetic", "hospital", "surgical", "gene therapy",
    "здрав", "медицин", "клиничес", "биотех", "фарма", "лекарств", "диагност",
    "терап", "онколог", "вакцин", "пациент", "болезн", "инсулин", "диабет", "имплант",
    "хирург", "больниц",
)
CALL_TYPES, TENDER_TYPES = ("1", "2", "8"), ("0",)


def is_ml_topic(terms: Column) -> Column:
    """Of an array of terms: a word of the list, or ai or ml standing alone."""
    text = F.lower(F.array_join(terms, " "))
    words = F.regexp_extract_all(text, F.lit(r"[a-z0-9][a-z0-9+\-]*"), F.lit(0))
    return F.arrays_overlap(words, F.array(*map(F.lit, ML_HINTS))) | text.rlike(r"\b(?:ai|ml)\b")


def is_health_topic(terms: Column) -> Column:
    text = casefold(F.array_join(terms, " "))
    return F.exists(F.array(*map(F.lit, HEALTH_HINTS)), lambda h: F.contains(text, h))


def known(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("unknown"))


def bare(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


@register("clinicaltrials", "market", "post", gate=is_health_topic)
def clinicaltrials(bodies: DataFrame) -> DataFrame:
    schema = "studies array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string,studyFirstPostDateStruct:struct<date:string>>,designModule:struct<studyType:string>,descriptionModule:struct<briefSummary:string>>>>"
    rows = items(bodies, schema, "studies").select(F.col("x.protocolSection").alias("x"))
    nct, title = F.trim(V["identificationModule"]["nctId"]), F.trim(V["identificationModule"]["briefTitle"])
    posted = dates.date_prefix(V["statusModule"]["studyFirstPostDateStruct"]["date"])
    text = F.concat(
        F.lit("Clinical study "), nct, F.lit(". Title: "), title, F.lit(". Study type: "), known(V["designModule"]["studyType"]), F.lit(". Status: "), known(V["statusModule"]["overallStatus"]),
        F.lit(". First posted: "), known(posted), F.lit(". "), F.coalesce(F.trim(V["descriptionModule"]["briefSummary"]), F.lit("")),
    )
    good = rows.where((F.length(nct) > 0) & (F.length(title) > 0))
    return refs(good, url=F.concat(F.lit("https://clinicaltrials.gov/study/"), nct), title=title, observed_at=posted, text=text, source_id=nct, kind=F.lit("trial"))


@register("openfda_510k", "market", "post", gate=is_health_topic)
def openfda_510k(bodies: DataFrame) -> DataFrame:
    rows = items(bodies, "results array<struct<device_name:string,k_number:string,decision_date:string,decision_description:string,applicant:string,product_code:string>>", "results")
    name, number = F.trim(V["device_name"]), F.trim(V["k_number"])
    day = dates.date_prefix(V["decision_date"])
    text = F.concat(F.lit("FDA 510(k) medical-device record. Device: "), name, F.lit(". Decision: "), bare(V["decision_description"]),
                    F.lit(". Decision date: "), known(day), F.lit(". Applicant: "), known(V["applicant"]), F.lit(". Product code: "), known(V["product_code"]), F.lit(". K-number: "), number, F.lit("."))
    good = rows.where((F.length(name) > 0) & (F.length(number) > 0))
    return refs(good, url=F.concat(F.lit("https://www.accessdata.fda.gov/scripts/cdrh/cfdocs/cfpmn/pmn.cfm?ID="), number), title=name, observed_at=day, text=text, source_id=number, kind=F.lit("regulation"), company=V["applicant"])


@register("openfda_drugs", "market", "post", gate=is_health_topic)
def openfda_drugs(bodies: DataFrame) -> DataFrame:
    rows = items(bodies, "results array<struct<application_number:string,products:array<struct<brand_name:string,active_ingredients:string>>,submissions:array<struct<submission_status_date:string>>>>", "results")
    number = F.trim(V["application_number"])
    product = F.get(V["products"], F.lit(0))  # its ingredients, an array, are read as the text that they are
    name = F.coalesce(F.nullif(product["brand_name"], F.lit("")), F.nullif(product["active_ingredients"], F.lit("")), F.lit("FDA drug record"))
    raw = F.get(V["submissions"], F.lit(0))["submission_status_date"]
    day = dates.compact_date(raw)
    url = F.concat(F.lit("https://www.accessdata.fda.gov/scripts/cder/daf/index.cfm?event=overview.process&ApplNo="), number)
    text = F.concat(F.lit("FDA drug approval record. Product: "), name, F.lit(". Application: "), number, F.lit(". Latest submission date: "), known(day), F.lit("."))
    return refs(rows.where(F.length(number) > 0), url=url, title=name, observed_at=day, text=text, source_id=number, kind=F.lit("regulation"))


@register("sedia", "money", "strict")
def sedia(bodies: DataFrame) -> DataFrame:
    """Calls and tenders of the EU portal by their types; others go, and a repeated reference counts once, its first day's row."""
    listed = "array<string>"
    schema = f"results array<struct<reference:string,title:string,summary:string,metadata:struct<type:{listed},identifier:{listed},title:{listed},callTitle:{listed},startDate:{listed},esST_publicationDate:{listed},es_SortDate:{listed}>>>"
    rows = items(bodies, schema, "results")
    m = V["metadata"]
    first = lambda c: F.get(c, F.lit(0))
    any_of = lambda kinds: F.arrays_overlap(m["type"], F.array(*map(F.lit, kinds)))
    kind = F.when(any_of(CALL_TYPES), "grant_call").when(any_of(TENDER_TYPES), "tender")
    day = F.coalesce(dates.date_prefix(first(m["startDate"])), dates.date_prefix(first(m["esST_publicationDate"])), dates.epoch_ms_day(first(m["es_SortDate"]).try_cast("long"), "UTC"))
    named = rows.select(kind.alias("kind"), F.trim(F.coalesce(F.nullif(first(m["identifier"]), F.lit("")), V["reference"])).alias("id"), F.trim(F.coalesce(F.nullif(first(m["title"]), F.lit("")), V["title"])).alias("title"), day.alias("day"), F.trim(F.coalesce(first(m["callTitle"]), V["summary"], F.lit(""))).alias("summary"))
    good = named.where(F.col("kind").isNotNull() & (F.length("id") > 0) & (F.length("title") > 0) & F.col("day").isNotNull())
    best = good.groupBy("id").agg(F.min(F.struct("day", "kind", "title", "summary")).alias("b")).select("id", "b.*")
    url = F.concat(F.lit("https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/topic-details/"), "id")
    label = F.when(F.col("kind") == "tender", "EU tender").otherwise("EU funding call")
    text = F.concat(label, F.lit(": "), "title", F.lit(". Published: "), F.col("day").cast("string"), F.lit(". Reference: "), "id", F.lit(".\n\n"), "summary")
    return refs(best, url=url, title=F.col("title"), observed_at=F.col("day"), text=text, source_id=F.col("id"), kind=F.col("kind"), customer=F.when(F.col("kind") == "tender", "European Commission"))


def family_collapse(references: DataFrame, family: Column) -> DataFrame:
    """Of patents of one family (a title without signs) the earliest stays, of one day the smallest id."""
    ranked = references.withColumn("__family", family)
    best = ranked.groupBy("__family").agg(F.min_by(F.struct(*references.columns), F.struct(F.coalesce("observed_at", F.lit("9999-12-31").cast("date")), "source_id")).alias("b"))
    return best.select("b.*")


def patents_chain(sources: list[DataFrame]) -> DataFrame:
    """The first source that has rows, in order of preference."""
    return first_nonempty(sources)


def structured_sources(parts: list[DataFrame]) -> DataFrame:
    """All sources' references; of a repeated address the last source's."""
    return union_last(parts)
