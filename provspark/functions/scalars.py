"""Scalar expressions over provenance fields; all are native columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: System names by what a model's name contains, in order of precedence.
VENDORS = ((("claude", "anthropic"), "anthropic"), (("gpt", "openai"), "openai"), (("gemini", "google"), "google_ai_studio"), (("llama", "meta"), "meta"))
#: Hedging words by the confidence that they suggest.
LOW_WORDS = ("uncertain", "not sure", "unclear", "might", "possibly", "perhaps", "i'm not confident", "hard to say", "it's unclear")
HIGH_WORDS = ("definitely", "certainly", "clearly", "i'm confident", "i know", "without doubt", "obviously", "sure")
MEDIUM_WORDS = ("likely", "probably", "seems", "appears", "i think", "i believe")
#: Flag bits of an artifact's header byte and of its extended byte.
FLAGS = {"provenance": 1, "semantic": 2, "trace": 4, "alternatives": 8, "delta": 16, "signature": 32, "multisig": 64, "streaming": 128}
FLAGS2 = {"compressed": 1, "zstd": 2, "task": 4}
#: Sizes in bytes of hybrid keys and signatures.
HYBRID_KEY, PQ_KEY, HYBRID_SIGNATURE, PQ_SIGNATURE = 1984, 1952, 3373, 3309


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def vendor(model: Column) -> Column:
    """The system that a model's name suggests, 'custom' if none does."""
    name, out = F.lower(model), F.lit("custom")
    for words, system in reversed(VENDORS):
        seen = F.lit(False)
        for w in words:
            seen = seen | name.contains(w)
        out = F.when(seen, system).otherwise(out)
    return out


def mentions(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur in a text, whatever their case."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") for w in words), F.lit(0))


def hedged_mean(text: Column) -> Column:
    """A weak confidence from hedging words: 0.88, 0.45, 0.70 or 0.75."""
    low, high, medium = (mentions(text, w) for w in (LOW_WORDS, HIGH_WORDS, MEDIUM_WORDS))
    return F.when((high > low) & (high > medium), 0.88).when(low > high, 0.45).when(medium > 0, 0.70).otherwise(0.75)


def hedged_variance(text: Column) -> Column:
    mean = hedged_mean(text)
    return F.when(mean == 0.88, 0.02).when(mean == 0.45, 0.08).otherwise(0.05)


def step_type(position: Column, count: Column) -> Column:
    """The kind of a reasoning step by its place, from 0, among count."""
    return F.when(position == 0, "evidence").when(position == count - 1, "conclusion").otherwise("inference")


def confidence_bar(mean: Column, width: int = 12) -> Column:
    """mean as a bar of width characters, filled to the nearest one, halves to even."""
    full = F.bround(mean * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, rounded down; needs the session time zone UTC."""
    return F.call_function("div", F.unix_micros(ts.cast("timestamp")), F.lit(1000).cast("bigint"))


def iso_ms(ms: Column) -> Column:
    """Epoch milliseconds as ISO 8601 with milliseconds in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso_ms(text: Column) -> Column:
    """Epoch milliseconds of ISO 8601, 0 where it isn't."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0).cast("bigint"))


def nanos(ms: Column) -> Column:
    return ms * F.lit(1_000_000).cast("bigint")


def resume_token(seq: Column, body_hash: Column) -> Column:
    """base64url of a 4-byte big-endian sequence number and a 32-byte hash (hexadecimal)."""
    return F.translate(F.base64(F.unhex(F.concat(F.lpad(F.hex(seq), 8, "0"), body_hash))), "+/", "-_")


def token_seq(token: Column) -> Column:
    """The sequence number of a resume token; null if it isn't 36 bytes."""
    raw = F.unbase64(F.translate(token, "-_", "+/"))
    return F.when(F.length(raw) == 36, F.conv(F.hex(F.substring(raw, 1, 4)), 16, 10).cast("bigint"))


def token_hash(token: Column) -> Column:
    raw = F.unbase64(F.translate(token, "-_", "+/"))
    return F.when(F.length(raw) == 36, F.lower(F.hex(F.substring(raw, 5, 32))))


def token_confirms(token: Column, prefix: Column) -> Column:
    """Whether a resume token's hash is that of the bytes received."""
    return F.coalesce(token_hash(token) == F.sha2(prefix.cast("binary"), 256), F.lit(False))


#: Fixed value: how a reference to a node of another document begins.
CROSS_DOCUMENT = "spif:sha256:"


def is_cross(ref: Column) -> Column:
    return ref.startswith(CROSS_DOCUMENT) & ref.contains("#")


def ref_document(ref: Column) -> Column:
    """The content id in a cross-document reference, null for a local one."""
    return F.when(is_cross(ref), F.split_part(F.substr(ref, F.lit(len(CROSS_DOCUMENT) + 1)), F.lit("#"), F.lit(1)))


def ref_node(ref: Column) -> Column:
    """What follows the first '#' of a cross-document reference."""
    return F.when(is_cross(ref), F.substr(ref, F.instr(ref, F.lit("#")) + 1))


def input_hash(messages: Column) -> Column:
    """SHA-256 of messages (array of struct<role, content>) as JSON with sorted keys and a blank after each comma and colon; '' without any."""
    text = lambda x: F.regexp_replace(F.to_json(F.array(F.coalesce(x, F.lit("")))), r"^\[|\]$", "")
    one = lambda m: F.concat(F.lit('{"content": '), text(m["content"]), F.lit(', "role": '), text(m["role"]), F.lit("}"))
    whole = F.concat(F.lit("["), F.array_join(F.transform(messages, one), ", "), F.lit("]"))
    return F.when(F.size(messages) > 0, F.sha2(whole.cast("binary"), 256)).otherwise("")


def slug(key: Column) -> Column:
    """A key as a file name: all but ASCII letters, digits and -_.~ percent-encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def vector_fingerprint(vector: Column) -> Column:
    """16 hexadecimal digits of the first 32 numbers in thousandths, modulo 256."""
    one = lambda x: F.lpad(F.hex((x.cast("double") * 1000).cast("bigint").bitwiseAND(255)), 2, "0")
    return F.substring(F.sha2(F.unhex(F.array_join(F.transform(F.slice(vector, 1, 32), one), "")), 256), 1, 16)


def named_value(option: Column) -> tuple[Column, Column]:
    """Name and value of NAME=VALUE, split at the first '='; nulls without one."""
    has = option.contains("=")
    at = F.instr(option, F.lit("="))
    return F.when(has, F.substr(option, F.lit(1), at - 1)), F.when(has, F.substr(option, at + 1))


def short_list(ids: Column, limit: int = 20) -> Column:
    """The first ids, and how many more there are."""
    more = F.size(ids) - limit
    return F.concat(F.array_join(F.slice(ids, 1, limit), ", "), F.when(more > 0, F.concat(F.lit(" … and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.char_length(text) / 4).cast("bigint")


def approx_tokens_base64(data: Column) -> Column:
    """A quarter of the characters of the base64 of bytes."""
    return F.floor((4 * F.ceil(F.length(data) / 3)) / 4).cast("bigint")


def flag(flags: Column, name: str) -> Column:
    """A presence hint; layers themselves decide."""
    return flags.bitwiseAND(FLAGS[name]) != 0


def pq_status(algorithm: Column, size: Column, key_size: Column, ed_ok: Column, pq_ok: Column, require_pq: Column, backend: Column) -> Column:
    """valid, invalid or unverifiable for a hybrid or post-quantum signature.

    key_size: bytes of the resolved key, null if none; ed_ok and pq_ok: what the two verifications say;
    backend: whether the second one can be made at all.
    """
    hybrid = (
        F.when(size != HYBRID_SIGNATURE, "invalid")
        .when(key_size.isNull() | ~key_size.isin(HYBRID_KEY, 32), "unverifiable")
        .when(~ed_ok, "invalid")
        .when(~require_pq, "valid")
        .when((key_size != HYBRID_KEY) | ~backend, "unverifiable")
        .when(pq_ok, "valid")
        .otherwise("invalid")
    )
    only = (
        F.when(~require_pq, "unverifiable")
        .when(size != PQ_SIGNATURE, "invalid")
        .when(key_size.isNull() | (key_size != PQ_KEY) | ~backend, "unverifiable")
        .when(pq_ok, "valid")
        .otherwise("invalid")
    )
    return F.when(algorithm == "ed25519+ml-dsa-65", hybrid).when(algorithm == "ml-dsa-65", only).otherwise("unverifiable")
