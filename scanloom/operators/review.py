"""Model review of chunks: prompt text, pluggable scorer, response parsing."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scanloom import fixed_values as fv
from scanloom.functions import text

SYSTEM_PROMPT = (
    "You review source code for security weaknesses. Answer with one JSON object {\"findings\": [...]} and nothing else. "
    "Each finding has title, description, severity (CRITICAL, HIGH, MEDIUM, LOW), confidence (HIGH, MEDIUM, LOW), "
    "line_number relative to the start of the chunk or null, code_snippet, explanation, fix_suggestion, category, owasp, "
    "cwe, attack_scenario, business_impact, references and patch (unified diff)."
)


class RateLimited(Exception):
    """Raised by a scorer when its provider refuses the call for rate reasons."""


def _rate_limited(failure: Exception) -> bool:
    """By name: on an executor that has this package installed a scorer's class is another one than the shipped one."""
    return any((c.__module__, c.__qualname__) == (RateLimited.__module__, RateLimited.__qualname__) for c in type(failure).__mro__)


def reviewable(packs: DataFrame) -> DataFrame:
    return packs.where(F.length(text.strip(F.col("content"))) >= fv.MIN_REVIEW_CHARS)


def prompt(path: Column, chunk_type: Column, name: Column, start_line: Column, content: Column) -> Column:
    return F.concat(
        F.lit("File Path: "), path, F.lit("\nChunk Type: "), chunk_type, F.lit("\nChunk Block Name: "), name,
        F.lit("\nStart Line Number: "), start_line.cast("string"), F.lit("\nCode Content:\n```\n"), content, F.lit("\n```"))


def with_prompt(packs: DataFrame) -> DataFrame:
    c = F.col
    return packs.withColumn("prompt", prompt(c("relative_path"), c("chunk_type"), c("name"), c("start_line"), c("content")))


_RESPONSES = "repository_name string, chunk_rank int, chunk_id string, file_path string, start_line int, response string, note string, error string"


def call_scorer(prompts: DataFrame, scorer: Callable[..., str], wait: float = fv.RETRY_WAIT_SECONDS, system: str | None = None) -> DataFrame:
    """Ask ``scorer(prompt)`` for every prompt, or ``scorer(system, prompt)`` with a system prompt, in rank order per repository.

    A rate limit is retried once; a second one ends the repository's review with a
    note. Other errors give no response and stand in ``error``. A group has at most ``REVIEW_LIMIT`` rows.
    """
    def review(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in group.sort_values("chunk_rank").itertuples():
            response, note, error = None, None, None
            for attempt in (1, 2):
                try:
                    response = scorer(r.prompt) if system is None else scorer(system, r.prompt)
                    break
                except Exception as failure:  # a scorer may fail in any way; the other calls go on
                    if not _rate_limited(failure):
                        error = f"{type(failure).__name__}: {failure}"
                        break
                    if attempt == 2:
                        note = fv.RATE_LIMIT_NOTE
                    else:
                        time.sleep(wait)
            rows.append((r.repository_name, r.chunk_rank, r.chunk_id, r.relative_path, r.start_line, response, note, error))
            if note:
                break
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _RESPONSES.split(", ")])

    slim = prompts.select("repository_name", "chunk_rank", "chunk_id", "relative_path", "start_line", "prompt")
    return slim.groupBy("repository_name").applyInPandas(review, _RESPONSES)


def join_responses(packs: DataFrame, responses: DataFrame) -> DataFrame:
    """Use a stored ``responses(repository_name, chunk_id, response)`` table instead of a scorer."""
    return packs.join(responses, ["repository_name", "chunk_id"]).select(
        "repository_name", "chunk_rank", "chunk_id", F.col("relative_path").alias("file_path"), "start_line", "response",
        F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("error"))


def failed_calls(responses: DataFrame) -> DataFrame:
    """Calls that gave no response because the scorer failed."""
    return responses.where(F.col("error").isNotNull()).select("repository_name", "chunk_rank", "chunk_id", "file_path", "error")


def rebase_line(relative: Column, start_line: Column) -> Column:
    """Model line (text) to file line: numbers below the chunk start count from it, unusable ones become the start."""
    whole = relative.try_cast("bigint")
    line = (
        F.when(whole.isNull(), start_line)
        .when(whole < start_line, start_line + whole - 1)
        .otherwise(whole)
    )
    return F.coalesce(line.try_cast("int"), start_line.cast("int"))


_TEXT_FIELDS = list(fv.REVIEW_DEFAULTS)
_OPTIONAL = ["code_snippet", "owasp", "cwe", "attack_scenario", "business_impact", "patch"]


def parse_responses(responses: DataFrame) -> DataFrame:
    """Findings of model responses.

    A missing field takes its default; an explicit null or a non-string in a required
    text field, or a list/object as line number, voids the whole response. Malformed
    JSON yields nothing.
    """
    parsed = F.expr("try_variant_get(try_parse_json(response), '$.findings', 'array<variant>')")
    doc = responses.select("*", F.explode(F.array(parsed)).alias("_items"))  # parsed once: nothing is inlined past this
    item = "_item"
    kind = lambda f: f"schema_of_variant(variant_get(x, '$.{f}'))"
    present = lambda f: f"variant_get(x, '$.{f}') is not null"
    bad_text = " or ".join(f"({present(f)} and {kind(f)} <> 'STRING')" for f in _TEXT_FIELDS)
    bad_optional = " or ".join(f"({present(f)} and {kind(f)} not in ('STRING', 'VOID'))" for f in _OPTIONAL)
    bad_line = f"({present('line_number')} and ({kind('line_number')} like 'ARRAY%' or {kind('line_number')} like 'OBJECT%'))"
    bad_list = f"({present('references')} and {kind('references')} not in ('VOID', 'ARRAY<STRING>', 'ARRAY<VOID>'))"
    bad_item = "schema_of_variant(x) not like 'OBJECT%'"
    valid = doc.where(F.expr(f"not exists(_items, x -> {bad_item} or {bad_text} or {bad_optional} or {bad_line} or {bad_list})"))
    keep = [F.col("repository_name").alias("scan_id"), "chunk_rank", "file_path", "start_line"]
    rows = text.explode_array(valid, keep, F.col("_items"), item, "item")

    def field(name):
        return F.expr(f"try_variant_get({item}, '$.{name}', 'string')")

    number = F.expr(f"schema_of_variant(variant_get({item}, '$.line_number'))")

    def whole(kind, raw):
        """JSON numbers are cut to whole, text must already be whole."""
        bare = text.strip(raw)
        return F.when(kind == "STRING", F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare)).when(
            kind == "BOOLEAN", raw.try_cast("boolean").cast("int").cast("string")).otherwise(
            raw.try_cast("double").try_cast("bigint").cast("string"))

    relative = text.let(F.struct(number.alias("kind"), field("line_number").alias("raw")), lambda v: whole(v["kind"], v["raw"]))
    rows = rows.select("*", F.explode(F.array(text.let(relative, lambda r: rebase_line(r, F.col("start_line"))))).alias("_line"))
    line = F.col("_line")
    given = {f: F.coalesce(field(f), F.lit(default)) for f, default in fv.REVIEW_DEFAULTS.items()}
    return rows.select(
        "scan_id",
        F.struct(F.lit(2).alias("phase"), F.lit(0).cast("bigint").alias("file_seq"), F.col("chunk_rank").alias("scanner"),
                 F.col("item").alias("rule"), F.lit(0).alias("line"), F.lit("").alias("tail")).alias("finding_seq"),
        F.concat_ws("-", F.lit("ai"), F.coalesce(field("category"), F.lit("None")), "file_path", line).alias("finding_id"),
        given["title"].alias("title"), given["description"].alias("description"),
        F.upper(given["severity"]).alias("severity"), F.upper(given["confidence"]).alias("confidence"),
        "file_path", line.alias("line_number"), field("code_snippet").alias("code_snippet"),
        given["explanation"].alias("explanation"), given["fix_suggestion"].alias("fix_suggestion"),
        given["category"].alias("category"), field("owasp").alias("owasp"), field("cwe").alias("cwe"),
        field("attack_scenario").alias("attack_scenario"), field("business_impact").alias("business_impact"),
        F.coalesce(F.expr(f"try_variant_get({item}, '$.references', 'array<string>')"), F.array().cast("array<string>"))
        .alias("references"),
        field("patch").alias("patch"),
    )


def skip_notes(responses: DataFrame) -> DataFrame:
    """One note per repository whose review was cut short."""
    return responses.where(F.col("note").isNotNull()).groupBy("repository_name").agg(F.max("note").alias("note"))
