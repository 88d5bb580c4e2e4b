"""Judge verdicts in loose JSON."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracemill.functions.text import let, strip

_STEP = "struct<step_number:string,reason:string,reasoning:string,original_claim:string,contradiction_found:string,correction_made:string>"
_VERDICT = "struct<backtracking_detected:string,final_answer:string,backtracking_steps:string,confidence:string,overall_reasoning:string>"


def loose_json(x) -> Column:
    """The JSON object in a model's reply: a fenced block if there is one, from the first to the last brace."""

    def fenced(t: Column) -> Column:
        return F.when(F.instr(t, "```json") > 0, strip(F.substring_index(F.substring(t, F.instr(t, "```json") + 7, F.length(t)), "```", 1))).when(t.startswith("```"), strip(F.try_element_at(F.split(t, "```"), F.lit(2)))).otherwise(t)

    def braces(t: Column) -> Column:
        a, b = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((a > 0) & (F.instr(t, "}") > 0) & (b > a), F.substring(t, a, b - a + 1)).otherwise(t)

    return let(let(strip(F.col(x) if isinstance(x, str) else x), fenced), braces)


def verdict(x) -> Column:
    """Judge's reply as struct: detected, final_answer, confidence in 0 to 1, steps of (step_number, reason), reasoning.

    Members of the wrong kind count as missing; steps that aren't objects are dropped.
    """

    def step(d: Column) -> Column:
        told = F.concat_ws("; ", *[F.when(strip(d[k]) != "", F.concat(F.lit(f"{k}: "), strip(d[k]))) for k in ("original_claim", "contradiction_found", "correction_made")])
        return F.struct(F.coalesce(d["step_number"].try_cast("int"), F.lit(0)).alias("step_number"), F.coalesce(d["reason"], d["reasoning"], told).alias("reason"))

    def whole(j: Column) -> Column:
        items = F.coalesce(F.from_json(j["backtracking_steps"], "array<string>"), F.array().cast("array<string>"))
        objects = F.transform(F.filter(items, lambda s: s.startswith("{")), lambda s: F.from_json(s, _STEP))
        return F.struct(
            F.coalesce(j["backtracking_detected"].try_cast("boolean"), F.lit(False)).alias("backtracking_detected"),
            F.coalesce(j["final_answer"], F.lit("")).alias("final_answer"),
            F.transform(objects, step).alias("backtracking_steps"),
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(j["confidence"].try_cast("double"), F.lit(0.0)))).alias("confidence"),
            F.coalesce(j["overall_reasoning"], F.lit("")).alias("overall_reasoning"),
        )

    return let(F.from_json(loose_json(x), _VERDICT), whole)


def batch_reply(x) -> Column:
    """A batch service's line: text of the first candidate, token counts, finish reason, error."""
    s = F.col(x) if isinstance(x, str) else x
    get = lambda p: F.get_json_object(s, p)
    parts = F.from_json(get("$.response.candidates[0].content.parts"), "array<struct<text:string>>")
    return F.struct(
        get("$.key").alias("key"),
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"),
        get("$.response.candidates[0].finishReason").alias("finish_reason"),
        F.coalesce(get("$.response.usageMetadata.promptTokenCount"), get("$.response.usage_metadata.prompt_token_count")).try_cast("long").alias("prompt_tokens"),
        F.coalesce(get("$.response.usageMetadata.candidatesTokenCount"), get("$.response.usage_metadata.candidates_token_count")).try_cast("long").alias("output_tokens"),
        F.when(get("$.error").isNotNull(), get("$.error")).when(get("$.response").isNull(), "no response").alias("error"),
    )


def list_length(x) -> Column:
    """Number of items of a JSON list; null if it is none."""
    s = F.col(x) if isinstance(x, str) else x
    return F.when(F.ltrim(s).startswith("["), F.json_array_length(s))


def canonical(x) -> Column:
    """A nested value as text that does not depend on the order of any map's keys, at whatever depth.

    Maps need text keys. Lists keep their order; for lists that stand for sets see canonical_set. Null is null.
    """
    v = F.col(x) if isinstance(x, str) else x
    held = F.to_json(F.to_variant_object(F.array(v)))  # in a list, as a plain value can't be converted alone
    return F.when(v.isNotNull(), F.substring(held, F.lit(2), F.length(held) - 2))


def canonical_json(x) -> Column:
    """The same for a value that is written as JSON; null if it does not parse, or names a key twice."""
    return F.to_json(F.try_parse_json(F.col(x) if isinstance(x, str) else x))


def canonical_set(x) -> Column:
    """A list that stands for a set, as the sorted distinct texts of its items; items may be nested."""
    return F.array_sort(F.array_distinct(F.transform(F.col(x) if isinstance(x, str) else x, lambda v: F.coalesce(canonical(v), F.lit("null")))))
