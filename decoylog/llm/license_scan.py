"""License scans by canonical digest (DataFrame functions only).

A text is put in a canonical form: lower case; copyright lines, rules and comment
signs at the ends of lines taken out; typographic signs, equivalent spellings and
addresses of either scheme made one; everything but letters and digits turned
into single spaces.  The SHA-256 of the canonical form of the *entire* text is
joined to the digests of known licences, whose table is made by the same
expressions from the texts below.  Only a text that is a licence, in whatever
layout, matches; one that merely mentions a licence does not.

Defined results: a null, empty or wordless text has no digest and no licence;
repeated rows each give their row; a known text given twice counts once (its
first name in order); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decoylog.llm.license_texts import KNOWN, WHOLE

# Spellings that licence texts use for one another.
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "acknowledgements": "acknowledgments",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "artefacts": "artifacts",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "owner": "holder",
    "owners": "holders",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "wilful": "willful",
}
#: A line that only names who holds the copyright, and when.  Running text that
#: happens to break before the word "copyright" has no sign or year behind it.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n(©]*"
    r"(?:copyright[^\p{L}\p{N}\n]*(?:\(c\)|©|\d{4})|\(c\)[^\p{L}\p{N}\n]*\d{4}|©)[^\n]*$"
    r"|(?m)^[^\p{L}\p{N}\n]*all rights reserved\.?[ \t]*$"
)


def canonical(text: Column) -> Column:
    """The form in which equal licences are equal; empty for a text without words."""
    form = F.lower(text)
    form = F.regexp_replace(form, r"\r\n?", "\n")
    form = F.regexp_replace(form, COPYRIGHT_LINE, " ")
    form = F.regexp_replace(form, r"https?://(www\.)?|['‘’`](?=s\b)", "")
    form = F.replace(form, F.lit("&"), F.lit(" and "))
    words = F.split(F.btrim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " ")), " ")
    standard = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    # The set test is a hash lookup; few words get as far as the map.
    same = F.transform(
        words,
        lambda w: F.when(w.isin(*EQUIVALENT), F.element_at(standard, w)).otherwise(w),
    )
    return F.array_join(same, " ")


def with_digest(rows: DataFrame, name: str) -> DataFrame:
    """``text`` replaced by the digest of its canonical form; null for no words."""
    forms = rows.withColumn("text", canonical(F.col("text")))
    digest = F.when(F.col("text") != "", F.sha2(F.col("text").cast("binary"), 256))
    return forms.withColumn(name, digest).drop("text")


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id and digest of the known texts; one row per digest."""
    rows = list((texts or KNOWN).items())
    table = spark.createDataFrame(rows, "license_id string, text string")
    return (
        with_digest(table, "license_digest")
        .where("license_digest IS NOT NULL")
        .groupBy("license_digest")
        .agg(F.min("license_id").alias("license_id"))
    )


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest and license_id (null: no known licence) of every row.

    The table of known digests is a few rows; a longer one is joined by whatever
    means Spark finds best, each document matching one row at most.
    """
    if known is None:
        spark = docs.sparkSession
        whole = spark.createDataFrame(list(WHOLE.items()), "license_id string, license_digest string")
        known = known_digests(spark).unionByName(whole)
    rows = with_digest(docs.select("doc_id", "text"), "digest")
    return rows.join(known, rows["digest"] == known["license_digest"], "left").select(
        "doc_id", "digest", "license_id"
    )
