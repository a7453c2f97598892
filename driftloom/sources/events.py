"""Server-sent events: usage read from a response, and frames of a synthesised one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a response that are looked through, and the names that the wire format has (fixed values).
SCAN_CAP = 64 * 1024
COUNTS = ("cache_creation_input_tokens", "cache_read_input_tokens", "input_tokens")
START = f"struct<message: struct<model: string, usage: struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>>"


def usage(body: Column) -> Column:
    """The first usage under a message_start event that has its model and all three counts, or null:
    struct<model, creation, read, input>. Null and empty bodies have none.

    A response is cut at its event lines, and JSON is parsed for data lines under message_start alone."""
    head = F.make_valid_utf8(F.substring(body.cast("binary"), 1, SCAN_CAP).cast("string"))
    events = F.split(F.concat(F.lit("\n"), head), "\nevent:")
    starts = F.filter(F.slice(events, 2, F.greatest(F.size(events), F.lit(1))), lambda e: e.rlike(r"\A ?message_start\r?(\n|\z)"))
    lines = F.flatten(F.transform(starts, lambda e: F.regexp_extract_all(e, F.lit(r"\ndata: ?([^\n]*)"), F.lit(1))))
    read = F.transform(lines, lambda x: F.from_json(x, START)["message"])
    found = F.transform(read, lambda m: F.struct(m["model"].alias("model"), m["usage"][COUNTS[0]].alias("creation"), m["usage"][COUNTS[1]].alias("read"), m["usage"][COUNTS[2]].alias("input")))
    whole = F.filter(found, lambda u: u["model"].isNotNull() & (u["creation"] >= 0) & (u["read"] >= 0) & (u["input"] >= 0))
    return F.try_element_at(whole, F.lit(1))


def frames(message_id: Column, model: Column, text: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """array<struct<event, data>>: the six frames of a response with one text block, in order."""
    start = F.to_json(F.struct(F.lit("message_start").alias("type"), F.struct(message_id.alias("id"), model.alias("model"), F.lit("assistant").alias("role"), F.struct(input_tokens.alias("input_tokens"), F.lit(1).alias("output_tokens")).alias("usage")).alias("message")))
    fixed = lambda kind: F.lit('{"type":"%s","index":0}' % kind)
    delta = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), text.alias("text")).alias("delta")))
    end = F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(F.lit("end_turn").alias("stop_reason")).alias("delta"), F.struct(output_tokens.alias("output_tokens")).alias("usage")))
    parts = [("message_start", start), ("content_block_start", F.lit('{"type":"content_block_start","index":0,"content_block":{"type":"text","text":""}}')), ("content_block_delta", delta), ("content_block_stop", fixed("content_block_stop")), ("message_delta", end), ("message_stop", F.lit('{"type":"message_stop"}'))]
    return F.array(*[F.struct(F.lit(e).alias("event"), d.alias("data")) for e, d in parts])


def framed(fs: Column) -> Column:
    return F.array_join(F.transform(fs, lambda f: F.concat(F.lit("event: "), f["event"], F.lit("\ndata: "), f["data"], F.lit("\n\n"))), "")
