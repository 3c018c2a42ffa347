"""Classification of candidate messages by a scorer whose answers are recorded."""

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from letterlens.fixed_values import (
    LOG_HEADER_LENGTH, LOG_REASONING_LENGTH, PRICE_INPUT, PRICE_OUTPUT, PROMPT_BODY_LENGTH, PROMPT_FORMAT, REVIEW_BANDS,
)
from letterlens.functions.names import confidence_name
from letterlens.functions.text import immediate_reply
from letterlens.scale import materialize
from letterlens.schema import RESPONSES
from letterlens.sources.archives import matching_files
from letterlens.sources.mime import body_text

KEYS = ["archive", "msg_index"]
NOT_READ = "Failed to read EML file"
NOT_EXTRACTED = "Failed to extract email data: "


def candidates(messages: DataFrame, body_length: int = PROMPT_BODY_LENGTH) -> DataFrame:
    """What the scorer sees of each message that has parts: sender, date, subject, and so much of the reply text."""
    reply = immediate_reply(body_text(html_mode="strip"))
    return messages.select(
        *KEYS,
        "file_name",
        F.when(F.col("header_error").isNotNull(), F.concat(F.lit(NOT_EXTRACTED), "header_error"))
        .when(F.col("n_headers") == 0, F.lit(NOT_READ)).alias("read_error"),
        F.col("from_decoded").alias("sender"),
        F.coalesce("date_raw", F.lit("")).alias("date"),
        "subject",
        F.substring(reply, 1, body_length).alias("body"),
    )


def user_message(criteria: str) -> Column:
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("sender", "date", "subject", "body")]
    return F.format_string(PROMPT_FORMAT, F.lit(criteria), *fields)


ATTEMPT = T.StructType(
    [
        T.StructField("attempt", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("prompt_tokens", T.LongType()),
        T.StructField("completion_tokens", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


def score(
    found: DataFrame, system_prompt: str, criteria: str, scorer: Callable[[str, str], tuple[str, int, int]],
    retries: int = 1, match_key: str = "is_match", strict: bool = False,
) -> DataFrame:
    """Call scorer(system prompt, user message) -> (answer, tokens in, tokens out) per candidate, and
    record every attempt. It asks again until an answer is usable by the rule that replays apply. The
    record is stored: recomputing a lost task must not ask again."""
    found = materialize(found, "scoring")
    attempts_type = to_arrow_type(T.ArrayType(ATTEMPT))

    def attempts(message: str) -> list[dict]:
        made = []
        for attempt in range(retries + 1):
            row = {"attempt": attempt, "content": None, "prompt_tokens": 0, "completion_tokens": 0, "error": None}
            made.append(row)
            try:
                row["content"], row["prompt_tokens"], row["completion_tokens"] = scorer(system_prompt, message)
                if usable(row["content"], match_key, strict):
                    break
            except Exception as error:
                row["error"] = str(error)
        return made

    @F.arrow_udf(T.ArrayType(ATTEMPT))
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([attempts(m) for m in batch.to_pylist()], attempts_type)

    readable = found.filter(F.col("read_error").isNull())
    asked = readable.select(*KEYS, ask.asNondeterministic()(user_message(criteria)).alias("made"))
    return materialize(asked.select(*KEYS, F.inline("made")), "responses")


def score_batches(
    found: DataFrame, system_prompt: str, criteria: str,
    scorer: Callable[[str, list[str]], list[tuple[str, int, int] | Exception]], ledger: str,
    retries: int = 1, match_key: str = "is_match", strict: bool = False, batch_rows: int = 64, slices: int = 8,
) -> DataFrame:
    """Call scorer(system prompt, user messages) -> an answer or an exception for each, and append every attempt to the ledger, a
    folder of attempts. Messages without a usable answer are asked again, together, up to `retries` times.

    Candidates are asked in slices, each of which is committed to the ledger as it ends. A run that broke off is
    continued by calling again: whoever has a usable answer in the ledger is not asked, and attempts of others are counted on."""
    spark = found.sparkSession
    rows = found.filter(F.col("read_error").isNull()).select(*KEYS, user_message(criteria).alias("message"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(*KEYS), F.lit(slices)))
    first = F.lit(0).alias("first")
    if matching_files(spark, f"{ledger}/*.parquet"):
        made = parsed_attempts(spark.read.schema(RESPONSES).parquet(ledger), match_key, strict).groupBy(*KEYS).agg(
            (F.max("attempt") + 1).alias("first"), F.bool_or("valid").alias("answered")
        )
        rows = rows.join(made, KEYS, "left").filter(~F.coalesce("answered", F.lit(False))).drop("answered")
        first = F.coalesce("first", F.lit(0)).alias("first")
    waiting = materialize(rows.select(*KEYS, "slice", "message", first), "scoring")
    schema = to_arrow_schema(RESPONSES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                open_rows, made = batch.slice(start, batch_rows).to_pylist(), []
                for attempt in range(retries + 1):
                    answers = scorer(system_prompt, [row["message"] for row in open_rows]) if open_rows else []
                    left = []
                    for row, answer in zip(open_rows, answers, strict=True):
                        failed = isinstance(answer, Exception)
                        content, tokens_in, tokens_out = (None, 0, 0) if failed else answer
                        made.append({
                            "archive": row["archive"], "msg_index": row["msg_index"], "attempt": row["first"] + attempt, "content": content,
                            "prompt_tokens": tokens_in, "completion_tokens": tokens_out, "error": str(answer) if failed else None,
                        })
                        if failed or not usable(content, match_key, strict):
                            left.append(row)
                    open_rows = left
                yield pa.RecordBatch.from_pylist(made, schema)

    for number in range(slices):
        part = waiting.filter(F.col("slice") == number).drop("slice")
        part.mapInArrow(ask, RESPONSES).write.mode("append").parquet(ledger)
    return spark.read.schema(RESPONSES).parquet(ledger)


def usable(content: str | None, match_key: str, strict: bool) -> bool:
    """Whether an answer is complete: a decision, and a confidence that is a number."""
    try:
        answer = json.loads(content)
    except (TypeError, ValueError):
        return False
    if not isinstance(answer, dict) or match_key not in answer or isinstance(answer.get("confidence"), bool):
        return False
    return isinstance(answer.get("confidence"), (int, float)) and (not strict or isinstance(answer[match_key], bool))


def parsed_attempts(responses: DataFrame, match_key: str = "is_match", strict: bool = False) -> DataFrame:
    """Add valid, decision, label, confidence, reasoning and problem to recorded attempts.

    The decision follows truthiness, so the text "false" counts as true; strict=True turns any
    answer that is not a JSON boolean into a problem.
    """
    answer = F.try_parse_json("content")
    match = F.expr(f"try_variant_get(answer, '$.{match_key}', 'variant')")
    confidence = F.expr("try_variant_get(answer, '$.confidence', 'variant')")
    kind = F.schema_of_variant(match)
    as_text = F.expr(f"try_variant_get(answer, '$.{match_key}', 'string')")
    falsy = (
        F.is_variant_null(match)
        | ((kind == "BOOLEAN") & (as_text == "false"))
        | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.expr("try_cast(answer_text as double)") == 0))
        | ((kind == "STRING") & (as_text == ""))
        | as_text.isin("[]", "{}") & kind.rlike("^(ARRAY|OBJECT)")
    )
    number = F.schema_of_variant(confidence).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    complete = match.isNotNull() & confidence.isNotNull() & number
    if strict:
        complete = complete & (kind == "BOOLEAN")
    return (
        responses.withColumn("answer", answer)
        .withColumn("answer_text", as_text)
        .withColumn("valid", F.col("error").isNull() & F.coalesce(complete, F.lit(False)))
        .withColumn("decision", F.col("valid") & ~F.coalesce(falsy, F.lit(False)))
        .withColumn("label", F.lower(F.coalesce("answer_text", F.lit("none"))))
        .withColumn("confidence", F.when(number, F.expr("try_variant_get(answer, '$.confidence', 'double')")))
        .withColumn("reasoning", F.coalesce(F.expr("try_variant_get(answer, '$.reasoning', 'string')"), F.lit("")))
        .withColumn(
            "problem",
            F.when(F.col("valid"), F.lit(None).cast("string")).otherwise(
                F.coalesce(
                    "error",
                    F.when(F.col("answer").isNull(), F.lit("Invalid JSON"))
                    .otherwise(F.lit("Invalid JSON structure")),
                )
            ),
        )
        .drop("answer", "answer_text")
    )


def final_attempts(parsed: DataFrame) -> DataFrame:
    """Per message the first valid attempt, or the last one; attempts counts all that were recorded."""
    fields = F.struct(
        "attempt", "valid", "decision", "label", "confidence", "reasoning", "problem", "prompt_tokens",
        "completion_tokens",
    )
    first_valid = F.min_by(F.when(F.col("valid"), fields), F.when(F.col("valid"), F.col("attempt")))
    return (
        parsed.groupBy(*KEYS)
        .agg(
            F.coalesce(first_valid, F.max_by(fields, "attempt")).alias("final"),
            F.count("*").alias("attempts"),
        )
        .select(*KEYS, "final.*", "attempts")
    )


def routed(found: DataFrame, finals: DataFrame) -> DataFrame:
    """One row per candidate with route, output name and zeroed tokens where the scorer failed."""
    both = found.join(finals, KEYS, "left")
    ok = F.coalesce("valid", F.lit(False)) & F.col("read_error").isNull()
    failed_name = F.concat(F.lit("failed_"), F.col("file_name"))
    zero = F.lit(0).cast("bigint")
    return both.select(
        *found.columns,
        F.when(ok, F.when(F.col("decision"), "matched").otherwise("rejected")).otherwise("failed").alias("route"),
        F.when(ok, F.col("label")).otherwise("error").alias("decision_label"),
        F.when(ok, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.col("reasoning")).otherwise("").alias("reasoning"),
        F.when(ok, F.col("prompt_tokens")).otherwise(zero).alias("prompt_tokens"),
        F.when(ok, F.col("completion_tokens")).otherwise(zero).alias("completion_tokens"),
        F.when(ok, F.lit("")).otherwise(F.coalesce("read_error", "problem", F.lit("No response"))).alias("error"),
        F.coalesce("attempts", zero).alias("attempts"),
        F.coalesce(
            F.when(ok & F.col("confidence").isNotNull(), confidence_name(F.col("confidence"), F.col("file_name"))),
            failed_name,
        ).alias("output_name"),
    )


def classification_log(
    rows: DataFrame, reasoning_length: int = LOG_REASONING_LENGTH, header_length: int = LOG_HEADER_LENGTH
) -> DataFrame:
    """The log columns in file order, and attempts. Per-row clock readings stay null."""
    return rows.select(
        F.col("file_name").alias("filename"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        F.col("decision_label").alias("llm_decision"),
        "confidence",
        F.substring("reasoning", 1, reasoning_length).alias("reasoning"),
        "prompt_tokens",
        "completion_tokens",
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        F.lit(None).cast("bigint").alias("processing_time_ms"),
        F.col("error").alias("error_message"),
        F.lit(False).alias("retried"),
        F.when(F.col("read_error").isNull(), F.substring("sender", 1, header_length))
        .otherwise("").alias("from_address"),
        F.when(F.col("read_error").isNull(), F.substring("subject", 1, header_length))
        .otherwise("").alias("subject"),
        F.col("output_name").alias("output_filename"),
        "attempts",
    )


def call_cost(
    tokens_in: Column, tokens_out: Column, price_in: float = PRICE_INPUT, price_out: float = PRICE_OUTPUT
) -> Column:
    """USD from token counts and prices per million tokens."""
    return tokens_in / F.lit(1e6) * F.lit(price_in) + tokens_out / F.lit(1e6) * F.lit(price_out)


def token_totals(responses: DataFrame, price_in: float = PRICE_INPUT, price_out: float = PRICE_OUTPUT) -> DataFrame:
    """Tokens and cost of all attempts made, also of those whose answer was not usable."""
    sums = responses.agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("output_tokens"),
        F.count("*").alias("calls"),
    )
    return sums.withColumns(
        {
            "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
            "total_cost_usd": call_cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out),
        }
    )


def route_counts(rows: DataFrame) -> DataFrame:
    """One row: processed, and count and percentage per route."""
    routes = ("matched", "rejected", "failed")
    counts = rows.agg(
        F.count("*").alias("processed"), *[F.count_if(F.col("route") == r).alias(r) for r in routes]
    )
    shares = {f"{r}_pct": F.round(F.try_divide(F.col(r) * 100.0, F.col("processed")), 1) for r in routes}
    return counts.withColumns(shares)


def confidence_band(confidence: Column, bounds: tuple[float, ...] = REVIEW_BANDS) -> Column:
    """1 for the highest band, counting up; one more than the bounds for the rest."""
    band = F.lit(len(bounds) + 1)
    for number, bound in reversed(list(enumerate(bounds, start=1))):
        band = F.when(confidence >= bound, F.lit(number)).otherwise(band)
    return band


def cost_projection(totals: DataFrame, prices: list[tuple[str, float, float]], messages: int = 1000) -> DataFrame:
    """Cost of a number of calls like the average one, per price list (name, in, out)."""
    listed = F.array(
        *[F.struct(F.lit(n).alias("price_list"), F.lit(i).alias("p_in"), F.lit(o).alias("p_out")) for n, i, o in prices]
    )
    per_list = totals.select("input_tokens", "output_tokens", "calls", F.inline(listed))
    total = F.col("input_tokens") / 1e6 * F.col("p_in") + F.col("output_tokens") / 1e6 * F.col("p_out")
    return per_list.select("price_list", F.try_divide(total * messages, F.col("calls")).alias("cost_usd"))


def by_confidence(rows: DataFrame, top: int | None = None) -> DataFrame:
    ordered = rows.orderBy(F.desc("confidence"), *KEYS)
    return ordered.limit(top) if top else ordered
