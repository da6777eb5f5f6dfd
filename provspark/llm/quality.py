"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at one property of a document and votes good (1), bad (-1) or abstains (0).
Each kind of bad documents that is thought of is seen by two rules or more, so that their agreement tells more than their
number. Expectation-maximisation over the table of vote patterns (3 ** rules rows at most, whatever the number
of documents) estimates for every rule how often it is right on good and on bad documents; a
document's posterior probability of being good then replaces a filter that all rules must pass.

Defined results: a null or blank text has no words, fails the base rules and isn't kept; a rule whose
denominator is 0 abstains; words are what blanks separate, so texts in scripts without blanks fail the base rules, and
capitals are ASCII's; very long texts are counted whole; equal windows of words are told by their 64-bit digests; repeated rows are judged one by one; an empty table gives an empty result;
other columns, also ones called like ours, are ignored by verdicts() and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import BLANK_CHARS, BLANKS, cut, keyed, nested

ROUNDS = 60
#: Where the search begins: most documents are good, rules seldom call a good one bad, and each sees a part of the bad ones.
PRIOR, ON_GOOD, ON_BAD = 0.8, 0.9995, 0.4
#: Added to either side of each estimated share.
SMOOTH = 1.0
#: Votes on good documents that are assumed beforehand, as a share of the rows: of them a share ON_GOOD is right. They only keep
#: estimates from 1 and decide for kinds of documents that a single rule sees; what votes say moves the accuracies.
TRUST = 0.25
#: Letters and digits of any script, as members of a regular expression's class; marks that end or divide a sentence.
ALNUM, STOPS = r"\p{L}\p{N}", ".,;:?!\u3001\u3002\uff0c\uff1a\uff1b\uff01\uff1f"
#: A word without any letter or digit.
BARE = rf"(?<![^{BLANKS}])[^{ALNUM}{BLANKS}]++(?![^{BLANKS}])"


def band(x: Column, good: tuple[float, float], bad: tuple[float, float]) -> Column:
    """Vote good inside one closed interval, bad outside the other, wider one; abstain between and on null."""
    return F.when(x.isNull(), 0).when(x.between(*good), 1).when((x < bad[0]) | (x > bad[1]), -1).otherwise(0)


#: By rule, where it votes good and outside which it votes bad.
BANDS = {
    "length": ((80, 1e12), (30, 1e12)),
    "word_length": ((3, 10), (2, 14)),
    "symbols": ((0, 0.02), (0, 0.1)),
    "repeated_lines": ((0, 0.05), (0, 0.3)),
    "repeated_words": ((0, 0.05), (0, 0.25)),
    "shouting": ((0, 0.05), (0, 0.3)),
    "capitals": ((0, 0.35), (0, 1.5)),
    "punctuation": ((0.01, 0.4), (0.001, 0.9)),
    "letters": ((0.9, 1), (0.8, 1)),
    "bare_words": ((0, 0.02), (0, 0.1)),
}


def rules(at: Callable[[str], Column]) -> dict[str, Column]:
    """The votes by name; at(count) is the column of a count that stats() makes."""
    share = lambda c, of: F.when(at(of) > 0, at(c) / at(of))
    figures = {
        "length": at("n_words"),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "shouting": share("n_exclaims", "n_words"),
        "capitals": share("n_capitals", "n_words"),
        "punctuation": share("n_stops", "n_words"),
        "letters": share("n_alnum", "word_chars"),
        "bare_words": share("n_bare", "n_words"),
    }
    return {name: band(figures[name], good, bad) for name, (good, bad) in BANDS.items()}


def count_of(text: Column, members: str) -> Column:
    """How many characters of a text are members of a regular expression's class."""
    return F.char_length(F.regexp_replace(text, f"[^{members}]+", "")).cast("bigint")


def opaque(x: Column) -> Column:
    """The same value, in a form the optimizer doesn't take apart: it would copy each count into every vote that reads it."""
    return F.transform(F.array(x), lambda y: y)[0]


def stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep, then the base counts and what the rules need, by row."""
    own = lambda c: f"_q_{c}"
    text, trimmed, words, windows, order = (F.col(own(c)) for c in ("text", "trim", "words", "windows", "order"))
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(own("text")))
    df = df.withColumn(own("trim"), F.trim(text, F.lit(BLANK_CHARS)))
    df = df.withColumn(own("words"), F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+")))
    # The 64-bit digest of the three words stands for each window.
    df = df.withColumn(own("windows"), F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, words[i + 1], words[i + 2]))))
    # Only texts in which a window recurs are sorted: equal windows then stand side by side.
    df = df.withColumn(own("order"), F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    df = df.withColumn(own("lines"), lines)
    recurs = F.sort_array(
        F.transform(
            F.filter(F.transform(order, lambda e, k: F.struct(e["i"].alias("i"), (((k > 0) & (F.get(order, k - 1)["h"] == e["h"])) | ((k + 1 < F.size(order)) & (F.get(order, k + 1)["h"] == e["h"]))).alias("again"))), lambda e: e["again"]),
            lambda e: e["i"],
        )
    )
    covered = F.aggregate(
        recurs,
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    long = lambda c: c.cast("bigint")
    made = {
        "n_words": long(F.size(words)),
        "word_chars": long(F.char_length(F.array_join(words, ""))),
        "n_symbols": count_of(text, "#*$%&|<>"),
        "n_dup_lines": long(F.size(own("lines")) - F.size(F.array_distinct(own("lines")))),
        "n_repeat_words": F.when(order.isNull(), F.lit(0).cast("bigint")).otherwise(covered),
        "n_lines": long(F.size(own("lines"))),
        "n_exclaims": count_of(text, "!"),
        "n_capitals": count_of(text, "A-Z"),
        "n_stops": count_of(text, STOPS),
        "n_alnum": count_of(text, ALNUM),
        "n_bare": long(F.regexp_count(text, F.lit(BARE))),
    }
    return df.select(*[F.col(f"`{c}`") for c in keep], opaque(F.struct(*[c.alias(n) for n, c in made.items()])).alias(own("stats")))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, then _q_stats, _q_failed (the base rules fail) and _q_votes, in the order of rules()."""
    df = stats(docs, keep)
    at = lambda c: F.col("_q_stats")[c]
    return df.withColumns({
        "_q_failed": (at("n_words") < 50) | (100 * at("n_repeat_words") > 50 * at("n_words")),
        "_q_votes": F.concat_ws(",", *[v.cast("string") for v in rules(at).values()]),
    })


def posteriors(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """By vote pattern: _q_pattern and _q_posterior, the probability that such a document is good.

    Two-coin model with abstention: a rule that votes is right on good documents with one
    probability and on bad ones with another, independently of the other rules. All rows count,
    through the counts by pattern; there are 3 ** rules patterns at most.
    """
    n = len(BANDS)
    counts = rows.groupBy(F.col("_q_votes").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.agg(F.array_sort(F.collect_list(F.struct("p", F.transform(F.split("p", ","), lambda v: v.cast("int")).alias("v"), "n"))).alias("t")).filter(F.size("t") > 0)
    fitted = one.withColumn("m", F.expr(f"aggregate(sequence(1, {rounds}), {start(n)}, (m, round) -> {again(n)})"))
    return fitted.select(F.explode(F.expr(f"transform(t, r -> struct(r.p AS _q_pattern, {posterior('r')} AS _q_posterior))")).alias("x")).select("x.*")


def start(n: int) -> str:
    """The model before the first round, as SQL."""
    fill = lambda x: f"array_repeat(cast({x} AS double), {n})"
    return f"struct(cast({PRIOR} AS double) AS prior, {fill(ON_GOOD)} AS g, {fill(ON_BAD)} AS b)"


def posterior(r: str) -> str:
    """The probability that pattern r is of good documents under model m, as SQL."""
    odds = f"aggregate(sequence(0, size({r}.v) - 1), ln((1 - m.prior) / m.prior), (x, j) -> x + CASE {r}.v[j] WHEN 1 THEN ln((1 - m.b[j]) / m.g[j]) WHEN -1 THEN ln(m.b[j] / (1 - m.g[j])) ELSE 0D END)"
    return f"(1 / (1 + exp({odds})))"


def again(n: int) -> str:
    """One round of expectation-maximisation: model m to the next, as SQL. Each share is smoothed, so none is 0 or 1."""
    total = lambda what: f"aggregate(w, 0D, (x, r) -> x + {what})"
    share = lambda vote, q, up, down: f"transform(sequence(0, {n - 1}), j -> ({total(f'if(r.v[j] = {vote}, r.n * {q}, 0D)')} + {up}) / ({total(f'if(r.v[j] <> 0, r.n * {q}, 0D)')} + {down}))"
    rows = total("r.n")
    prior = f"({total('r.n * r.q')} + {SMOOTH}) / ({rows} + {2 * SMOOTH})"
    on_good = share(1, "r.q", f"{ON_GOOD * TRUST} * {rows}", f"{TRUST} * {rows}")
    on_bad = share(-1, "(1 - r.q)", SMOOTH, 2 * SMOOTH)
    weighed = f"transform(t, r -> struct(r.v AS v, r.n AS n, {posterior('r')} AS q))"
    return f"element_at(transform(array({weighed}), w -> struct({prior} AS prior, {on_good} AS g, {on_bad} AS b)), 1)"


def with_posterior(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """Rows of judged() with their posterior. The table of patterns has 3 ** rules rows at most, so it is broadcast."""
    return rows.join(F.broadcast(fitted), F.col("_q_votes") == F.col("_q_pattern"), "left").withColumn("_q_kept", F.when(F.col("_q_failed"), 0.0).otherwise(F.coalesce("_q_posterior", F.lit(0.0))) >= 0.5)


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the votes and the posterior. The counts are made once and kept in a checkpoint."""
    rows = cut(judged(keyed(docs), ["doc_id"]))
    out = with_posterior(rows, posteriors(rows))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *[F.col("_q_stats")[c].alias(c) for c in counts], F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.col("_q_votes").alias("votes"), F.round("_q_posterior", 6).alias("posterior"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that verdicts() would keep.

    Counts are made twice, once for the model and once for the filter, so whole texts are neither
    shuffled nor written.
    """
    rows = nested(docs, "text")
    fitted = cut(posteriors(judged(rows, [])))
    return with_posterior(judged(rows, ["row"]), fitted).filter("_q_kept").select("row.*")


def sql() -> str:
    """verdicts() of documents, for DuckDB: counts by unnesting, expectation-maximisation as a recursive query."""
    blanks = r"\x20\x09-\x0D"
    chars = lambda members: f"length(regexp_replace(t, '[^{members}]+', '', 'g'))"
    names = list(BANDS)
    n, per = len(names), lambda c: f"CASE WHEN n_words > 0 THEN {c}::DOUBLE / n_words END"
    values = {
        "length": "n_words", "word_length": per("word_chars"), "symbols": per("n_symbols"), "repeated_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines END", "repeated_words": per("n_repeat_words"),
        "shouting": per("n_exclaims"), "capitals": per("n_capitals"), "punctuation": per("n_stops"), "letters": "CASE WHEN word_chars > 0 THEN n_alnum::DOUBLE / word_chars END", "bare_words": per("n_bare"),
    }
    vote = lambda x, good, bad: f"CASE WHEN ({x}) IS NULL THEN 0 WHEN ({x}) BETWEEN {good[0]} AND {good[1]} THEN 1 WHEN ({x}) < {bad[0]} OR ({x}) > {bad[1]} THEN -1 ELSE 0 END"
    votes = ", ".join(vote(values[name], *BANDS[name]) for name in names)
    chance = "1 / (1 + exp(ln((1 - prior) / prior) + list_sum(list_transform(range(1, {n} + 1), lambda j: CASE v[j] WHEN 1 THEN ln((1 - b[j]) / g[j]) WHEN -1 THEN ln(b[j] / (1 - g[j])) ELSE 0 END))))".replace("{n}", str(n))
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, CASE WHEN regexp_matches(t, '[^{blanks}]') THEN list_filter(regexp_split_to_array(t, '[{blanks}]+'), lambda x: x <> '') ELSE [] END AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blanks}]')) AS lines FROM d),
win AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM s, unnest(range(1, len(words) - 1)) AS u(i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
c AS (SELECT s.rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {chars("#*$%&|<>")} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, {chars("!")} AS n_exclaims,
{chars("A-Z")} AS n_capitals, {chars(STOPS)} AS n_stops, {chars(ALNUM)} AS n_alnum, len(list_filter(words, lambda x: NOT regexp_matches(x, '[{ALNUM}]'))) AS n_bare FROM s LEFT JOIN cov ON cov.rid = s.rid),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{votes}] AS v FROM c),
pat AS (SELECT v, count(*)::DOUBLE AS n FROM j GROUP BY v),
m AS (SELECT 0 AS i, {PRIOR}::DOUBLE AS prior, list_transform(range({n}), lambda x: {ON_GOOD}::DOUBLE) AS g, list_transform(range({n}), lambda x: {ON_BAD}::DOUBLE) AS b
UNION ALL SELECT i + 1, any_value(p), list(gj ORDER BY j), list(bj ORDER BY j) FROM (
SELECT i, j, (sum(n * q) + {SMOOTH}) / (sum(n) + {2 * SMOOTH}) AS p, (sum(CASE WHEN v[j] = 1 THEN n * q ELSE 0 END) + {ON_GOOD * TRUST} * sum(n)) / (sum(CASE WHEN v[j] <> 0 THEN n * q ELSE 0 END) + {TRUST} * sum(n)) AS gj,
(sum(CASE WHEN v[j] = -1 THEN n * (1 - q) ELSE 0 END) + {SMOOTH}) / (sum(CASE WHEN v[j] <> 0 THEN n * (1 - q) ELSE 0 END) + {2 * SMOOTH}) AS bj
FROM (SELECT i, v, n, {chance} AS q FROM m, pat WHERE i < {ROUNDS}), unnest(range(1, {n} + 1)) AS u(j) GROUP BY i, j) GROUP BY i),
f AS (SELECT v, {chance} AS q FROM m, pat WHERE i = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, array_to_string(j.v, ',') AS votes, round(q, 6) AS posterior FROM j JOIN f ON j.v = f.v
"""
