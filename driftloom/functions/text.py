"""Text functions on columns, all built in: token estimates, cleaning, markers, passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
#: The two shapes of marker that stand for text kept elsewhere; both carry a content address.
PLACEHOLDER_HEAD = "[stored segment | ref={ref} | ~{tokens} tokens | {bytes} bytes]"
BACKREF = "[repeats an earlier message | ref={ref}]"
MARKER_PATTERN = (
    r"\[stored segment \| ref=(sha256:[0-9a-f]{64}) \| ~[0-9]+ tokens \| [0-9]+ bytes\]"
    r"|\[repeats an earlier message \| ref=(sha256:[0-9a-f]{64})\]"
)
BLOB_LEAST = 512
HEAD_LINES, TAIL_LINES = 40, 20
PASSAGE_WORDS = 40


def token_estimate(text: Column) -> Column:
    """Code points over 3.5, rounded up."""
    return F.ceil(F.char_length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def approx_chars(tokens: Column) -> Column:
    return F.round(tokens * F.lit(CHARS_PER_TOKEN)).cast("long")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def content_address(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def is_content_address(ref: Column) -> Column:
    return ref.rlike(r"\Asha256:[0-9a-f]{64}\z")


def strip_ansi(text: Column) -> Column:
    """Without escape sequences, an unended one included, carriage returns and control characters
    other than line feed and tab."""
    return F.regexp_replace(text, r"\x1b(?:\[[^\x40-\x7e]*[\x40-\x7e]?|[^\[])?|[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")


def normalize_space(text: Column) -> Column:
    """Unix line ends, no white space at line ends, blank lines never two together; a last line end
    stays only if the text ended in one."""
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    trimmed = F.regexp_replace(unix, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    single = F.regexp_replace(F.regexp_replace(trimmed, r"\A\n{2,}", "\n"), r"\n{3,}", "\n\n")
    return F.when(text.endswith("\n"), single).otherwise(F.regexp_replace(single, r"\n+\z", ""))


def longest_blob(text: Column) -> Column:
    """The longest run of base64 characters of BLOB_LEAST or more, the first of equals, or null."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/_=-]{%d,})" % BLOB_LEAST))
    start = F.lit(None).cast("string")
    return F.aggregate(runs, start, lambda best, run: F.when(best.isNull() | (F.length(run) > F.length(best)), run).otherwise(best))


def extract_blob(text: Column) -> Column:
    """The longest blob replaced by a marker with its size; null without one."""
    blob = longest_blob(text)
    at = F.position(blob, text)
    before = F.substr(text, F.lit(1), at - 1)
    after = F.substr(text, at + F.length(blob))
    return F.when(blob.isNotNull(), F.concat(before, F.lit("[blob of "), F.length(blob).cast("string"), F.lit(" bytes left out]"), after))


def lines(text: Column) -> Column:
    """Lines without their ends; no last empty one."""
    parts = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when(text.endswith("\n") | (text == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def head_tail(text: Column) -> Column:
    """The first and last lines with a marker for those between; null for short texts."""
    ls = lines(text)
    n = F.size(ls)
    left_out = n - HEAD_LINES - TAIL_LINES
    return F.when(
        left_out > 0,
        F.concat_ws("\n", F.slice(ls, 1, HEAD_LINES), F.concat(F.lit("[... "), left_out.cast("string"), F.lit(" lines left out ...]")), F.slice(ls, -TAIL_LINES, TAIL_LINES)),
    )


def placeholder(ref: Column, tokens: Column, size: Column, summary: Column, file_line: bool = False) -> Column:
    """The block that stands for a stored segment: header, summary, and how to get the original."""
    head = F.concat(F.lit("[stored segment | ref="), ref, F.lit(" | ~"), tokens.cast("string"), F.lit(" tokens | "), size.cast("string"), F.lit(" bytes]"))
    parts = [head, summary, F.concat(F.lit('Full text: retrieve("'), ref, F.lit('")'))]
    if file_line:
        parts.append(F.concat(F.lit("or read refs/"), F.replace(ref, F.lit(":"), F.lit("-")), F.lit(".txt")))
    return F.concat_ws("\n", *parts)


def backref(ref: Column) -> Column:
    return F.concat(F.lit("[repeats an earlier message | ref="), ref, F.lit("]"))


def extract_refs(text: Column) -> Column:
    """The addresses in complete markers of either shape, in order; bare addresses do not count."""
    whole = F.regexp_extract_all(text, F.lit(MARKER_PATTERN), F.lit(0))
    return F.transform(whole, lambda m: F.regexp_extract(m, r"ref=(sha256:[0-9a-f]{64})", 1))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters and numbers."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def passages(text: Column) -> Column:
    """Non-blank lines if there are several; else windows of 40 words; else the whole text."""
    ls = F.filter(lines(text), lambda x: F.trim(x) != "")
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(PASSAGE_WORDS)), lambda i: F.array_join(F.slice(words, i + 1, PASSAGE_WORDS), " "))
    return F.when(F.size(ls) > 1, ls).when(F.size(words) > PASSAGE_WORDS, windows).otherwise(F.array(text))


def first_line(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit("\n"), F.lit(1)))


def join_or_none(items: Column, sep: str = ", ") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, sep)).otherwise(F.lit("(none)"))


def embedded_json(text: Column) -> Column:
    """From the first { to the last }, or empty."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def normalized_version(text: Column) -> Column:
    return F.regexp_replace(F.split_part(F.trim(text), F.lit(" "), F.lit(1)), r"\Av", "")


def synthetic_tokens(text: Column) -> Column:
    """Bytes over 4, plus 1: the estimate in synthesised responses."""
    return (F.floor(F.octet_length(text) / 4) + 1).cast("long")


#: Headers that end at each hop or frame the body (fixed values of HTTP).
HOP_HEADERS = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "content-length")


def forwarded_headers(headers: Column) -> Column:
    """array<struct<name, value>> without hop-by-hop and framing headers; repeats stay."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*HOP_HEADERS))
