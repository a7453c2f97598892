"""Later results of a tool as differences from an earlier one."""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_BYTES, MOST_BYTES, MOST_LINES = 1_024, 512 * 1_024, 10_000
HEADER = "[differs little from the earlier {tool} result {base}; unified diff against it]"


def difference(base: str, target: str, tool: str, base_id: str) -> str | None:
    """A header and the unified diff, if it has at most half the bytes of target."""
    a, b = len(base.encode()), len(target.encode())
    if min(a, b) < LEAST_BYTES or max(a, b) >= MOST_BYTES:
        return None
    left, right = base.split("\n"), target.split("\n")
    if max(len(left), len(right)) > MOST_LINES:
        return None
    # a diff holds the lines that target does not share: nothing to gain if those are too many
    shared = set(left)
    if 2 * sum(len(x.encode()) + 1 for x in right if x not in shared) > b:
        return None
    body = "\n".join(difflib.unified_diff(left, right, n=3, lineterm=""))
    out = HEADER.format(tool=tool, base=base_id) + "\n" + body
    return out if 2 * len(out.encode()) <= b else None


def rebuilt(base: str, rendered: str) -> str:
    """The target again, from its base and its rendered difference."""
    left, out, at = base.split("\n"), [], 0
    body = rendered.split("\n")[1:]
    if body and body != [""]:
        for line in body[2:]:
            if line.startswith("@@"):
                start, n = re.match(r"@@ -(\d+)(?:,(\d+))?", line).groups()
                first = int(start) - (n != "0")
                out += left[at:first]
                at = first
            elif line[:1] == "-":
                at += 1
            elif line[:1] == "+":
                out.append(line[1:])
            else:
                out.append(line[1:])
                at += 1
    return "\n".join(out + left[at:])


@F.arrow_udf(T.StringType())
def rebuilt_udf(bases: pa.Array, diffs: pa.Array) -> pa.Array:
    return pa.array([rebuilt(b, x) for b, x in zip(bases.to_pylist(), diffs.to_pylist(), strict=True)], pa.string())


def sequential_diffs(leaves: DataFrame) -> DataFrame:
    """leaves: session_id string, seq long, tool string, content string. Adds base_seq and diff where
    a leaf is told as a difference from the latest earlier leaf of its tool that is not itself one.

    Rows of a session are read in order by one task that holds the last base of each tool, so its
    memory does not grow with the session.
    """
    schema = T._parse_datatype_string("session_id string, seq long, tool string, content string, base_seq long, diff string")

    def run(batches):
        session, bases = None, {}
        for batch in batches:
            base_seq, diffs = [], []
            for sid, seq, tool, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if sid != session:
                    session, bases = sid, {}
                base = bases.get(tool)
                made = difference(base[1], content, tool, str(base[0])) if base and content is not None else None
                base_seq.append(base[0] if made else None)
                diffs.append(made)
                if made is None and content is not None and len(content.encode()) >= LEAST_BYTES:
                    bases[tool] = (seq, content)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(base_seq, pa.int64()), pa.array(diffs, pa.string())], names=schema.names)

    ordered = leaves.select("session_id", "seq", "tool", "content").repartition(F.xxhash64("session_id")).sortWithinPartitions("session_id", "seq")
    return ordered.mapInArrow(run, schema)
