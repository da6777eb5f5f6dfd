"""License scans by canonical digests of entire texts.

Texts that differ in case, punctuation, white space, copyright lines or equivalent spellings have one
canonical form, and its SHA-256 is looked up in a table of known licenses by a hash join. All of it is DataFrame
functions. Known are complete licence texts (the short ones in license_texts, the long ones by digest) and one-sentence
notices. A document is matched as a whole, and so is each of its lines, since notices mostly stand on a line of their own.

Case (A-Z), punctuation of ASCII and of typography, comment marks, white space and line breaks don't count. A copyright
line is one that names a year, a sign or a name after the word or the sign, or says that all rights are reserved; "(c) You
must retain" is an item of a list and stays.

Defined results: very long texts are canonised whole, like any other; a null or blank text, or one of copyright lines alone, has the canonical form '' and no
license; if several known texts share a digest, the first license_id by order is named; repeated rows
repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm.common import cut, keyed
from provspark.llm.license_texts import LONG, SHORT

#: Equivalent spellings, as whole words of a canonical form.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("behaviour", "behavior"), ("favour", "favor"), ("organisation", "organization"), ("redistributions", "redistribution"), ("v", "version"), ("https", "http"))
#: Notices that are known from the start, by license. A caller can give any other table.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License v2.0"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Typographic marks and blanks, each taken for a blank, besides the ASCII ones below.
TYPOGRAPHY = "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u00ab\u00bb\u2039\u203a\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2022\u00b7\u2026\u00a0\u2003\u2009\u200b\u202f\u3000\ufeff\u00a9\u00a7"
#: What takes a line out: a copyright notice, maybe behind a comment mark.
WORD, SIGN, WHOSE, NAMES = r"([Cc]opyright|COPYRIGHT)", r"(\([cC]\)|\x{A9})", r"([0-9]{4}|<|\[|\{)", r"([A-Z][^\s]*[ \t\r]*){1,6}\z"
COPYRIGHT = rf"^[ \t]*([/*#;%!<>|.-]+[ \t]*)?({WORD}[ \t:,]*({SIGN}|{WHOSE})|{WORD}[ \t:]+(by )?{NAMES}|{SIGN}[ \t]*({WHOSE}|{WORD})|{SIGN}[ \t]+{NAMES}|([Aa]ll [Rr]ights [Rr]eserved|ALL RIGHTS RESERVED)[.!]?[ \t\r*/#-]*\z)"
#: ASCII that is neither a letter nor a digit nor the end of a line.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FROM, TO = UPPER + TYPOGRAPHY, UPPER.lower() + " " * len(TYPOGRAPHY)
#: Known texts up to which their digests are broadcast, so that documents stay where they are.
BROADCAST = 100_000


def canonical(text: Column) -> Column:
    """Lower case (A-Z) without copyright lines; runs of marks are one blank; spellings agree. Lines stay apart."""
    lines = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    x = F.regexp_replace(F.translate(F.array_join(lines, "\n"), FROM, TO), MARKS, " ")
    # Two blanks between words and around lines, so that each word has one on either side to itself.
    x = F.concat(F.lit("  "), F.replace(F.replace(x, F.lit(" "), F.lit("  ")), F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for old, new in SPELLINGS:
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.regexp_replace(x, " +", " ")


def digest(form: Column) -> Column:
    """SHA-256 of a canonical form, its lines joined; null where that is empty."""
    joined = F.trim(F.regexp_replace(form, "[ \n]+", " "))
    return F.when(joined != "", F.sha2(joined.cast("binary"), 256))


def line_digests(form: Column) -> Column:
    return F.filter(F.transform(F.split(form, "\n"), lambda x: F.when(F.trim(x) != "", F.sha2(F.trim(x).cast("binary"), 256))), lambda d: d.isNotNull())


def texts() -> list[tuple[str, str]]:
    """(license_id, text) of all known texts: notices, and the short licences with each title and without."""
    return [*KNOWN, *((i, head + body) for i, titles, body in SHORT for head in ("", *(f"{t}\n\n" for t in titles)))]


def known(spark: SparkSession) -> DataFrame:
    """known, a digest, and license_id."""
    given = spark.createDataFrame(texts(), "license_id string, text string").select(digest(canonical(F.col("text"))).alias("known"), "license_id")
    return given.unionByName(spark.createDataFrame([(d, i) for i, _, d in LONG], "known string, license_id string"))


def scan(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the entire text, license_id if that is a known text, n_notices (lines that are one) and notices, their licenses joined by commas.

    licenses: (license_id, text) instead of those that are known from the start. Texts are canonised once and never
    shuffled. The known digests are counted and, up to BROADCAST of them, broadcast; beyond that digests are shuffled to them, and a
    frequent text or notice is a hot key of a join that the optimizer can split.
    """
    table = known(docs.sparkSession) if licenses is None else licenses.select(digest(canonical(F.col("text"))).alias("known"), F.col("license_id").cast("string").alias("license_id"))
    table = cut(table.filter("known IS NOT NULL").groupBy("known").agg(F.min("license_id").alias("license_id")))
    if table.count() <= BROADCAST:
        table = F.broadcast(table)
    forms = keyed(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", canonical(F.col("text")).alias("form"))
    # Position 0 is the whole text, the others are its lines.
    parts = forms.select("rid", "doc_id", F.posexplode(F.concat(F.array(digest(F.col("form"))), line_digests(F.col("form")))).alias("at", "d"))
    hit = parts.join(table, F.col("d") == F.col("known"), "left").filter("at = 0 OR license_id IS NOT NULL")
    notice = F.when(F.col("at") > 0, F.col("license_id"))
    found = hit.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("at") == 0, F.col("d"))).alias("digest"),
        F.max(F.when(F.col("at") == 0, F.col("license_id"))).alias("license_id"),
        F.count(notice).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(notice)), ",").alias("notices"),
    )
    return found.drop("rid")


def sql() -> str:
    """scan() of documents against the known texts, for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, {quote(COPYRIGHT)})), chr(10))"
    form = f"regexp_replace(translate({form}, {quote(FROM)}, {quote(TO)}), {quote(MARKS)}, ' ', 'g')"
    form = f"'  ' || replace(replace({form}, ' ', '  '), chr(10), '  ' || chr(10) || '  ') || '  '"
    for old, new in SPELLINGS:
        form = f"replace({form}, ' {old} ', ' {new} ')"
    form = f"regexp_replace({form}, ' +', ' ', 'g')"
    whole = "trim(regexp_replace(form, '[ \n]+', ' ', 'g'), ' ')"
    rows = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in texts())
    long = ", ".join(f"({quote(d)}, {quote(i)})" for i, _, d in LONG)
    return f"""
WITH given(license_id, text) AS (VALUES {rows}),
forms AS (SELECT license_id, {form} AS form FROM given),
known AS (SELECT d, min(license_id) AS license_id FROM (SELECT sha256({whole}) AS d, license_id FROM forms UNION ALL VALUES {long}) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {form} AS form FROM documents),
whole AS (SELECT rid, doc_id, CASE WHEN {whole} <> '' THEN sha256({whole}) END AS digest FROM docs),
lines AS (SELECT rid, trim(unnest(string_split(form, chr(10))), ' ') AS line FROM docs),
notices AS (SELECT rid, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
            FROM lines JOIN known ON d = sha256(line) WHERE line <> '' GROUP BY rid)
SELECT doc_id, digest, license_id, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known ON digest = d LEFT JOIN notices USING (rid)
"""
