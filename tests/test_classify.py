"""Classification: validation, retries, routes, costs, logs and the report."""

import json

import pytest
from pyspark.sql import functions as F

from letterlens.fixed_values import CLASSIFICATION_LOG, PROMPT_BANDS
from letterlens.operators.classify import (
    call_cost, candidates, classification_log, confidence_band, cost_projection, final_attempts,
    parsed_attempts, route_counts, routed, score, token_totals, user_message,
)
from letterlens.operators.selection import select_routed
from letterlens.plans.classification import classify, run_classification, with_bytes
from letterlens.schema import RESPONSES
from letterlens.sinks.messages import read_routes, write_routes
from letterlens.sources.mime import with_headers, with_parts

ANSWERS = {
    # index: attempts (content), route, output name
    0: (['{"is_match": true, "confidence": 0.29, "reasoning": "%s"}' % ("r" * 250)], "matched", "28_m0.eml"),
    1: (['{"is_match": false, "confidence": 0.57}'], "rejected", "56_m1.eml"),
    2: (['{"is_match": "false", "confidence": 1.0}'], "matched", "100_m2.eml"),
    3: (['{"is_match": [], "confidence": 1}'], "rejected", "100_m3.eml"),
    4: (["not json", '{"is_match": true, "confidence": 0.9}'], "matched", "90_m4.eml"),
    5: (['{"confidence": 0.5}', '{"is_match": true}'], "failed", "failed_m5.eml"),
    6: (['{"is_match": null, "confidence": 0.5}'], "rejected", "50_m6.eml"),
    7: (['{"is_match": true, "confidence": "high"}'], "failed", "failed_m7.eml"),
    8: (['[1, 2]', '3'], "failed", "failed_m8.eml"),
    9: (['{"is_match": 0.0, "confidence": 0}'], "rejected", "00_m9.eml"),
    10: (['{"is_match": "", "confidence": 0.05}'], "rejected", "05_m10.eml"),
    11: (['{"is_match": {"a": 1}, "confidence": 0.5}'], "matched", "50_m11.eml"),
    12: ([], "failed", "failed_m12.eml"),
}


@pytest.fixture(scope="module")
def mail(spark):
    rows = [("a", i, f"m{i}.eml", f"From: A {i} <a@b.cz>\nDate: d\nSubject: S{i}\n\n{'long text ' * 500}".encode()) for i in range(12)]
    rows.append(("a", 12, "m12.eml", b""))
    return with_headers(spark.createDataFrame(rows, "archive string, msg_index long, file_name string, raw binary"))


@pytest.fixture(scope="module")
def responses(spark):
    rows = [("a", i, n, c, 100, 10, None) for i, (made, _, _) in ANSWERS.items() for n, c in enumerate(made)]
    return spark.createDataFrame(rows, RESPONSES)


@pytest.fixture(scope="module")
def found(mail):
    return candidates(with_parts(mail)).cache()


def test_routes(found, responses):
    rows = {r.msg_index: r for r in classify(found, responses).collect()}
    assert {i: (r.route, r.output_name) for i, r in rows.items()} == {i: a[1:] for i, a in ANSWERS.items()}
    assert rows[4].attempts == 2 and rows[5].prompt_tokens == 0 and rows[12].error == "Failed to read EML file"
    log = classification_log(classify(found, responses))
    assert log.columns == [*CLASSIFICATION_LOG, "attempts"]
    entries = {r.filename: r for r in log.collect()}
    assert len(entries["m0.eml"].reasoning) == 200 and entries["m2.eml"].llm_decision == "false"
    assert entries["m5.eml"].llm_decision == "error" and entries["m12.eml"].from_address == ""
    assert entries["m0.eml"].from_address == "A 0 <a@b.cz>" and entries["m1.eml"].total_tokens == 110


def test_strict_and_alias(found, responses, spark):
    strict = {r.msg_index: r.route for r in classify(found, responses, strict=True).collect()}
    assert [i for i, r in strict.items() if r == "matched"] and strict[2] == strict[7] == strict[3] == "failed"
    other = spark.createDataFrame([("a", 0, 0, '{"is_vacation_response": true, "confidence": 0.8}', 1, 1, None)], RESPONSES)
    finals = final_attempts(parsed_attempts(other, match_key="is_vacation_response"))
    assert routed(found, finals).filter("msg_index = 0").first().route == "matched"


def test_totals(found, responses):
    totals = token_totals(responses).first()
    calls = sum(len(a[0]) for a in ANSWERS.values())
    assert (totals.calls, totals.input_tokens, totals.output_tokens) == (calls, 100 * calls, 10 * calls)
    assert totals.total_cost_usd == pytest.approx(calls * (100 * 0.15 + 10 * 0.6) / 1e6)
    prices = {r.price_list: r.cost_usd for r in cost_projection(token_totals(responses), [("x", 2.5, 10.0)]).collect()}
    assert prices["x"] == pytest.approx((100 * 2.5 + 10 * 10) / 1e6 * 1000)
    counts = route_counts(classify(found, responses)).first()
    assert (counts.processed, counts.matched, counts.rejected, counts.failed) == (13, 4, 5, 4)
    assert counts.matched_pct == 30.8


def test_published_costs(spark):
    cost = lambda i, o, *p: spark.range(1).select(call_cost(F.lit(i), F.lit(o), *p)).first()[0]
    assert round(cost(245, 28), 6) == 0.000054
    assert round(cost(300, 50, 2.5, 10.0) * 1000, 2) == 1.25 and round(cost(300, 50, 10.0, 30.0) * 1000, 2) == 4.5


def test_bands(spark):
    df = spark.createDataFrame([(c,) for c in (1.0, 0.95, 0.9, 0.7, 0.6, 0.5, 0.1)], "c double")
    rows = df.select(confidence_band(F.col("c")).alias("r"), confidence_band(F.col("c"), PROMPT_BANDS).alias("p")).collect()
    assert [r.r for r in rows] == [1, 1, 1, 2, 3, 3, 4] and [r.p for r in rows] == [1, 1, 2, 3, 3, 4, 5]


def test_prompt(found):
    text = found.filter("msg_index = 1").select(user_message("Is it?")).first()[0]
    body = ("long text " * 500).strip()[:4000]
    assert text == (
        f"Is it?\n\nEMAIL TO ANALYZE:\nFrom: A 1 <a@b.cz>\nDate: d\nSubject: S1\n\n{body}\n\nRespond with JSON only:\n"
        '{"is_match": true/false, "confidence": 0.95, "reasoning": "brief explanation"}'
    )


def test_run_with_scorer(spark, mail, tmp_path):
    def scorer(system, message):
        if "Subject: S1\n" in message:
            raise RuntimeError("down")
        return json.dumps({"is_match": "Subject: S2\n" in message, "confidence": 0.8, "reasoning": system}), 7, 3

    out = str(tmp_path)
    report = run_classification(mail, "sys", "crit", out, scorer=scorer).first()
    assert (report.summary.total_processed, report.summary.matched, report.summary.failed) == (13, 1, 2)
    assert report.summary.total_tokens == 110 and report.configuration.user_prompt == "crit"
    names = {(r.route, r.file_name) for r in spark.read.parquet(f"{out}/routes").collect()}
    assert ("matched", "80_m2.eml") in names and ("failed", "failed_m1.eml") in names and len(names) == 13
    failed = spark.read.parquet(f"{out}/log").filter("filename = 'm1.eml'").first()
    assert (failed.error_message, failed.attempts) == ("down", 2)
    assert json.loads(spark.read.text(f"{out}/report").first()[0])["summary"]["rejected"] == 10


def test_all_attempts_count(found, spark):
    answers = ["no", "{}", '{"is_match": true, "confidence": 0.7}']
    made = spark.createDataFrame([("a", 0, i, c, 1, 1, None) for i, c in enumerate(answers)], RESPONSES)
    row = classify(found, made).filter("msg_index = 0").first()
    assert (row.route, row.attempts) == ("matched", 3)


def test_scoring_equals_its_replay(mail, spark):
    asked = spark.sparkContext.accumulator(0)

    def scorer(system, message):
        asked.add(1)
        return '{"is_vacation_response": true, "confidence": 0.9}', 5, 1

    made = score(candidates(with_parts(mail)), "s", "c", scorer, match_key="is_vacation_response")
    assert asked.value == made.count() == 12
    routes = classify(candidates(with_parts(mail)), made, "is_vacation_response").groupBy("route").count().collect()
    assert {r.route: r["count"] for r in routes} == {"matched": 12, "failed": 1}


def test_selection_reads_few_folders(spark, mail, found, responses, tmp_path):
    rows = classify(found, responses)
    whole = with_bytes(mail, rows)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    dated = whole.withColumn("date_wall", F.expr("timestamp_ntz'2024-01-05 00:00:00' + make_dt_interval(cast(msg_index * 10 as int))"))
    write_routes(dated, str(tmp_path / "routes"))
    stored = read_routes(spark, str(tmp_path / "routes"))
    assert stored.count() == 13 and stored.filter("route = 'failed'").count() == 4
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    chosen = select_routed(stored, ["matched", "rejected"], 0.5, 0.95, "2024-01-25", "2024-03-16", sender=" A@b.cz")
    assert sorted(r.file_name for r in chosen.collect()) == ["50_m6.eml", "90_m4.eml"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    folders = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "route" in folders and "month" in folders
    assert "GreaterThanOrEqual(confidence,0.5)" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_lengths_are_arguments(mail, found, responses):
    assert candidates(with_parts(mail), body_length=7).filter("msg_index = 1").first().body == "long te"
    log = classification_log(classify(found, responses), reasoning_length=3, header_length=2)
    row = log.filter("filename = 'm0.eml'").first()
    assert (row.reasoning, row.from_address, row.subject) == ("rrr", "A ", "S0")


def test_unreadable_headers_are_not_scored(mail):
    broken = mail.withColumn("header_error", F.when(F.col("msg_index") == 3, F.lit("bad")))
    row = candidates(with_parts(broken)).filter("msg_index = 3").first()
    assert row.read_error == "Failed to extract email data: bad"


def test_batches_go_on_after_a_break(spark, tmp_path):
    """Each slice is committed; a second run asks only those without a usable answer, and counts their attempts on."""
    from letterlens.operators.classify import score_batches

    rows = [("a", i, f"{i}.eml", None, "s", "d", f"n{i}", "b") for i in range(40)] + [("a", 99, "x.eml", "unreadable", "", "", "", "")]
    found = spark.createDataFrame(rows, "archive string, msg_index long, file_name string, read_error string, sender string, date string, subject string, body string")
    ledger, asked = str(tmp_path / "ledger"), tmp_path / "asked"
    asked.mkdir()

    def scorer(broken):
        def answers(system, messages):
            out = []
            for message in messages:
                n = int(message.split("Subject: n")[1].split("\n")[0])
                (asked / f"{broken}-{n}").touch()
                if n == 17 and broken:
                    raise SystemExit("lost")
                out.append(ValueError("busy") if n == 5 and broken else (f'{{"is_match": {str(n % 2 == 0).lower()}, "confidence": 1}}', 1, 1))
            return out

        return answers

    with pytest.raises(Exception):
        score_batches(found, "s", "c", scorer(True), ledger, slices=4)
    score_batches(found, "s", "c", scorer(False), ledger, slices=4)
    made = spark.read.parquet(ledger).collect()
    usable = [r.msg_index for r in made if r.error is None]
    assert sorted(usable) == list(range(40))
    assert len({(r.msg_index, r.attempt) for r in made}) == len(made)
    again = {int(p.name.split("-")[1]) for p in asked.glob("False-*")}
    done = {r.msg_index for r in made} - again
    assert 17 in again and all((asked / f"True-{n}").exists() for n in done)


def test_keyword_candidates_bear_their_prompt(spark, tmp_path):
    """The digest is that of the whole message to the scorer: it follows the text of the document, as far as it is sent."""
    from hashlib import sha256

    from workloads.stores import extract_classify

    texts = {1: "Call 5551 now.", 2: "Call 5552 now.", 3: "no keyword", 4: "  Call 5554 now, " + "é" * 5000, 5: "Reply 5555, long enough.\n> On Monday you wrote 777\nmore"}
    docs = spark.createDataFrame([(i, text, "en", "src") for i, text in texts.items()], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    replies = {i: text for i, text in texts.items() if i != 3} | {4: texts[4].strip()[:4000], 5: "Reply 5555, long enough."}
    sent = {
        i: "Is this about work?\n\nEMAIL TO ANALYZE:\nFrom: Účastník <src@docs.example.com>\n"
        f"Date: {day}, 0{i + 1} Jan 2024 00:00:00 +0100\nSubject: Dokument {i}\n\n{replies[i]}\n\nRespond with JSON only:\n"
        '{"is_match": true/false, "confidence": 0.95, "reasoning": "brief explanation"}'
        for i, day in {1: "Tue", 2: "Wed", 4: "Fri", 5: "Sat"}.items()
    }
    found = extract_classify(spark, str(tmp_path))
    assert {r.doc_id: r.prompt_digest for r in found.collect()} == {i: sha256(message.encode()).hexdigest() for i, message in sent.items()}
