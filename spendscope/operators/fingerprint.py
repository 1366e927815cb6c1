"""Raw request bodies -> prompt-free fingerprints: a narrow job, no shuffle.

Blocks follow the order in which the vendors build a prompt (tools, output format, system, messages). They
are canonical JSON: sorted keys, compact, non-ASCII kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.functions import json_values as js
from spendscope.functions.hashing import keyed_fingerprint

# Fields that do not belong to the prompt, and fields that hold text of a call.
TRANSPORT_FIELDS = ["stream", "metadata", "user", "store"]
CACHE_MARKS = ["cache_control", "prompt_cache_breakpoint"]
TEXT_FIELDS = ["request", "response", "output", "choices", "content"]
EMPTY_JSON = ["null", "false", '""', "0", "0.0", "[]", "{}"]


def canonical(value: Column) -> Column:
    return F.to_json(value)


def without(value: Column, names: list[str]) -> Column:
    """Canonical text of an object without some of its keys."""
    return F.to_json(F.map_filter(js.as_object(value), lambda k, _: ~k.isin(names)))


def _wrapped(key: str, text: Column) -> Column:
    return F.concat(F.lit('{"' + key + '":'), text, F.lit("}"))


def _optional_block(request: Column, key: str) -> Column:
    text = canonical(js.get(request, key, "variant"))
    return F.when(text.isNotNull() & ~text.isin(EMPTY_JSON), F.array(_wrapped(key, text))).otherwise(_no_blocks())


def _no_blocks() -> Column:
    return F.array().cast("array<string>")


def _system_blocks(request: Column) -> Column:
    system = F.when(js.has_key(request, "system"), js.get(request, "system", "variant")).otherwise(
        js.get(request, "instructions", "variant")
    )
    parts = js.as_list(system)
    whole = canonical(system)
    return (
        F.when(parts.isNotNull(), F.transform(parts, lambda p: _wrapped("system", canonical(p))))
        .when(whole.isNotNull() & ~whole.isin(EMPTY_JSON), F.array(_wrapped("system", whole)))
        .otherwise(_no_blocks())
    )


def _message_blocks(message: Column) -> Column:
    content = F.try_variant_get(message, "$.content", "variant")
    parts = js.as_list(content)
    role = F.coalesce(
        canonical(F.try_variant_get(message, "$.role", "variant")),
        canonical(F.try_variant_get(message, "$.type", "variant")),
        F.lit('""'),
    )
    first = F.concat(F.lit('{"part":'), canonical(F.get(parts, F.lit(0))), F.lit(',"role":'), role, F.lit("}"))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), canonical)
    return (
        F.when(js.as_object(message).isNull(), F.array(canonical(message)))
        .when(F.size(parts) > 0, F.concat(F.array(first), rest))
        .otherwise(F.array(without(message, CACHE_MARKS)))
    )


def prompt_blocks(request: Column) -> Column:
    """Ordered canonical blocks of a Chat Completions, Responses or Messages body."""
    messages = F.when(js.has_key(request, "messages"), js.get(request, "messages", "variant")).otherwise(
        js.get(request, "input", "variant")
    )
    lone = F.concat(F.lit('{"content":'), canonical(messages), F.lit(',"role":"user"}'))
    listed = F.flatten(F.transform(js.as_list(messages), _message_blocks))
    is_text = canonical(messages).startswith('"')
    return F.concat(
        _optional_block(request, "tools"),
        _optional_block(request, "response_format"),
        _optional_block(request, "text"),
        _system_blocks(request),
        F.when(is_text, F.array(lone)).otherwise(F.coalesce(listed, _no_blocks())),
    )


def fingerprint(request: Column, salt: bytes) -> Column:
    """Fingerprint struct of a body; NULL fields where there is no body."""
    present = js.as_object(request).isNotNull()
    return keyed_fingerprint(
        F.when(present, prompt_blocks(request)), F.when(present, without(request, TRANSPORT_FIELDS)), salt
    )


def redacted_lines(lines: DataFrame, salt: bytes) -> DataFrame:
    """Log lines (``rec`` VARIANT) with request and response text replaced by the fingerprint."""
    request = js.get(F.col("rec"), "request", "variant")
    stamped = lines.withColumn("fp", fingerprint(request, salt))
    kept = F.map_filter(js.as_object(F.col("rec")), lambda k, _: ~k.isin(TEXT_FIELDS))
    added = F.map_from_arrays(F.array(F.lit("fingerprint")), F.array(F.to_variant_object("fp")))
    base = F.when(
        F.col("fp.request_hash").isNotNull(),
        F.map_concat(F.map_filter(kept, lambda k, _: k != "fingerprint"), added),
    ).otherwise(kept)
    line = F.when(F.col("rec").isNull(), F.raise_error(F.concat(F.lit("not a JSON line in "), "source")).cast("string"))
    return stamped.select("source", "seq", line.otherwise(F.to_json(base)).alias("line"))


def write_redacted(lines: DataFrame, salt: bytes, folder: str) -> None:
    redacted_lines(lines, salt).select("line").write.text(folder)
