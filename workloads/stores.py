"""Whole jobs over mail made from the given tables, their stores read back."""

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from letterlens.operators.classify import candidates, score_batches, user_message
from letterlens.operators.naming import unique_names
from letterlens.operators.selection import also_in
from letterlens.plans.attachment_export import run_attachments
from letterlens.plans.classification import classify
from letterlens.plans.extraction import Search, find_matches, run_extraction
from letterlens.plans.repack import repack
from letterlens.scale import materialize, ordered_rank, scratch_path
from letterlens.sinks.messages import write_archive
from letterlens.sources.archives import read_archives
from letterlens.sources.mime import body_text, with_headers, with_parts
from letterlens.streaming.intake import start_intake, start_named_intake, stream_matches, stream_messages, stream_outcomes
from letterlens.streaming.names import start_names
from workloads import classification, table, text_table
from workloads.mail import as_bytes, conversation_archive, conversation_mail, conversation_subject, document_mail, encoded, headers, mail_date, role_address, other_role, text_part
from workloads.messages import MAIL_TEXT, PAGE_NAMES, PAGES, exported_files, parsed_pages, with_source_key
from workloads.texts import PATTERNS, czech, hits_sql

NUL = "\0"
FAULTY_KIND = f"Content-Type: text/plain; charset*=u{NUL}''utf-8\n\nlost\n"
KINDS = 5  # of which the first three cannot be read in whole


def faulty_raw(kind: Column) -> Column:
    """A turn as a message: 0 has a charset that no parser reads, 1 a sender that none reads, 2 a sound part before a part
    with such a charset; the others are sound."""
    message_id = F.format_string("<c%d.t%d@example.com>", "conv_id", "turn")
    sender = F.when(kind == 1, F.lit("(" * 3000 + "x" + ")" * 3000)).otherwise(role_address(F.col("role")))
    head = headers(sender, role_address(other_role()), conversation_subject(), mail_date(F.col("conv_id"), F.col("turn")), message_id)
    both = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="=_b"\n\n--=_b\n'), text_part(F.col("text")),
        F.lit(f"\n--=_b\n{FAULTY_KIND}\n--=_b--\n"),
    )
    return as_bytes(F.concat(head, F.when(kind == 0, F.lit(FAULTY_KIND)).when(kind == 2, both).otherwise(text_part(F.col("text")))))


def faulty_mail(spark: SparkSession, folder: str) -> DataFrame:
    rows = text_table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(KINDS))
    return rows.select(F.col("conv_id").cast("string").alias("archive"), F.col("turn").alias("msg_index"), faulty_raw(kind).alias("raw"))


def extracted(spark: SparkSession, folder: str) -> str:
    output = scratch_path(spark, "extraction")
    run_extraction(with_headers(faulty_mail(spark, folder)), Search(PATTERNS), output).collect()
    return output


def quarantine(spark, folder):
    """Messages that a stage could not read in whole, as the job has stored them."""
    rows = spark.read.parquet(f"{extracted(spark, folder)}/failed")
    return rows.select(
        F.col("archive").cast("bigint").alias("conv_id"), F.col("msg_index").alias("turn"), "file_name", "stage",
        F.substring_index("reason", ":", 1).alias("fault"),
    )


def extraction_store(spark, folder):
    """Log and saved messages, joined by file name. A message read in part is saved as well if that part holds a keyword."""
    output = extracted(spark, folder)
    log, saved = spark.read.parquet(f"{output}/log"), spark.read.parquet(f"{output}/messages")
    raw = F.col("raw").cast("string")
    return log.join(saved, log["filename"] == saved["file_name"]).select(
        F.regexp_extract(raw, r"Message-ID: <c([0-9]+)\.t", 1).cast("bigint").alias("conv_id"),
        F.regexp_extract(raw, r"Message-ID: <c[0-9]+\.t([0-9]+)@", 1).cast("bigint").alias("turn"),
        "filename", "collision", "subject", F.array_join("matched_keywords", ", ").alias("matched_keywords"),
    )


def attachment_store(spark, folder):
    """Saved attachments and the log that goes with them."""
    output = scratch_path(spark, "attachments")
    run_attachments(parsed_pages(spark, folder), PAGE_NAMES, output).collect()
    log = spark.read.parquet(f"{output}/log").select("uuid", "message_id", "total_size_bytes")
    saved = spark.read.parquet(f"{output}/attachments").withColumn("uuid", F.substring_index("file_name", "_", 1))
    return saved.join(log, "uuid").select("message_id", "file_name", F.sha2("payload", 256).alias("digest"), "total_size_bytes")


def archive_index(spark, folder):
    """Places of all messages over the archives, in archive order."""
    messages = with_source_key(read_archives(spark, conversation_archive(spark, folder), every_file=True))
    ranks = ordered_rank(messages.select("archive", "msg_index"), [], ["archive", "msg_index"], "place")
    return messages.select("archive", "msg_index", "conv_id", "turn").join(ranks, ["archive", "msg_index"]).select("conv_id", "turn", "place")


def repack_append(spark, folder):
    """Two appends of single-message files, even turns and then odd ones, read back in archive order."""
    source, target = exported_files(spark, folder), scratch_path(spark, "repacked")
    for digits in ("02468", "13579"):
        repack(spark, source, target, rf"[{digits}]\.eml$").collect()
    messages = with_source_key(read_archives(spark, target, every_file=True))
    ranks = ordered_rank(messages.select("archive", "msg_index"), [], ["archive", "msg_index"], "place")
    return messages.select("archive", "msg_index", "conv_id", "turn").join(ranks, ["archive", "msg_index"]).select("conv_id", "turn", "place")


def stream_quarantine(spark, folder):
    """Archives that arrive as a stream: matches and unreadable messages of each batch, in two stores."""
    arrived, table, failed = (scratch_path(spark, name) for name in ("archive", "stream", "stream-failed"))
    write_archive(faulty_mail(spark, folder), arrived, ["archive", "msg_index"])
    judged = stream_outcomes(stream_messages(spark, arrived), Search(PATTERNS))
    start_named_intake(judged, table, scratch_path(spark, "stream-state"), failed).awaitTermination()
    rows = [spark.read.parquet(path).select(F.lit(name).alias("store"), "raw") for path, name in ((table, "matched"), (failed, "failed"))]
    raw = F.col("raw").cast("string")
    return rows[0].unionByName(rows[1]).select(
        "store", F.regexp_extract(raw, r"Message-ID: <c([0-9]+)\.t", 1).cast("bigint").alias("conv_id"),
        F.regexp_extract(raw, r"Message-ID: <c[0-9]+\.t([0-9]+)@", 1).cast("bigint").alias("turn"),
    )


def stream_names(spark, folder):
    """Names per role for the matches of a stream, with few files a batch and a restart in between."""
    arrived, found, names, state = (scratch_path(spark, name) for name in ("archive", "stream", "stream-names", "names-state"))
    write_archive(conversation_mail(spark, folder), arrived, ["archive", "msg_index"])
    matches = stream_matches(stream_messages(spark, arrived), Search(PATTERNS))
    role = F.regexp_extract(F.element_at("from_addrs", 1), "^[a-z]+", 0)
    named = matches.withColumn("base_name", F.concat(role, F.lit(".eml")))
    start_intake(named, found, scratch_path(spark, "stream-state")).awaitTermination()
    for _ in range(2):
        start_names(spark, found, names, state, files_per_batch=3).awaitTermination()
    return spark.read.parquet(names).select(F.regexp_extract("base", "^[a-z]+", 0).alias("role"), "file_name", "collision")


def _quoted_printable(text: Column, charset: str) -> Column:
    return F.regexp_replace(F.hex(F.encode(text, charset)), "(..)", "=$1")


def _mixed_part(text: Column, kind: Column, subtype: str = "plain") -> Column:
    """A text part in one of four forms; what a form cannot hold becomes a question mark."""
    head = f"Content-Type: text/{subtype}"
    latin = F.regexp_replace(text, r"[^\x00-\xff]", "?")
    ascii_ = F.regexp_replace(text, r"[^\x00-\x7f]", "?")
    return (
        F.when(kind == 0, text_part(text, subtype))
        .when(kind == 1, F.concat(F.lit(f"{head}; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\n"), _quoted_printable(latin, "ISO-8859-1")))
        .when(kind == 2, F.concat(F.lit(f"{head}; charset=nonsense\nContent-Transfer-Encoding: quoted-printable\n\n"), _quoted_printable(ascii_, "UTF-8")))
        .otherwise(F.concat(F.lit(f"{head}; charset=utf-16le\nContent-Transfer-Encoding: base64\n\n"), F.regexp_replace(F.base64(F.encode(text, "UTF-16LE")), r"\s", ""), F.lit("\n")))
    )


def _document_bodies(spark: SparkSession, folder: str, content: Column) -> DataFrame:
    rows = text_table(spark, folder, "documents", "doc_id", "text", "lang")
    head = F.concat(F.lit("From: a@docs.example.com\nSubject: "), encoded(F.col("lang")), F.lit("\nMIME-Version: 1.0\n"))
    mail = rows.select(
        F.col("doc_id").cast("string").alias("archive"), F.lit(0).cast("bigint").alias("msg_index"), as_bytes(F.concat(head, content)).alias("raw")
    )
    return with_parts(mail).select(F.col("archive").cast("bigint").alias("doc_id"), body_text().alias("body"))


def charset_mix(spark, folder):
    """Bodies of single-part messages: base64 and quoted-printable; charsets declared, narrow, unknown, and wide."""
    return _document_bodies(spark, folder, _mixed_part(F.col("text"), F.pmod("doc_id", F.lit(4))))


def multipart_bodies(spark, folder):
    """Bodies of messages with a plain part, an HTML part in another charset, and a part of another kind that is not read."""
    kind = F.pmod("doc_id", F.lit(4))
    html = F.concat(F.lit("<html><body><p>"), F.col("lang"), F.lit("</p><script>no()</script></body></html>"))
    content = F.concat(
        F.lit('Content-Type: multipart/alternative; boundary="=_m"\n\n--=_m\n'), _mixed_part(F.col("text"), kind), F.lit("\n--=_m\n"),
        _mixed_part(html, F.pmod(kind + 1, F.lit(4)), "html"), F.lit("\n--=_m\n"), text_part(F.lit("BEGIN"), "calendar"), F.lit("\n--=_m--\n"),
    )
    return _document_bodies(spark, folder, content)


def _answers(system_prompt: str, messages: list[str]) -> list:
    """A scorer that goes by the number in the subject: every seventh answer is no JSON, every third is a match."""
    numbers = [int(re.search(r"\nSubject: Dokument (\d+)\n", message)[1]) for message in messages]
    return [
        ("no answer" if n % 7 == 0 else json.dumps({"is_match": n % 3 == 0, "confidence": 0.5, "reasoning": ""}), len(system_prompt), 1)
        for n in numbers
    ]


def collisions_prior(spark, folder):
    """Names of later turns against the names that an earlier run gave to the first two turns of each thread."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.concat("role", F.lit(".eml")).alias("base_name"))
    first = unique_names(turns.filter("turn < 2"), ["conv_id", "turn"], "base_name").select(F.col("file_name").alias("filename"))
    later = unique_names(turns.filter("turn >= 2"), ["conv_id", "turn"], "base_name", materialize(first, "log"))
    return later.select("conv_id", "turn", "file_name", "collision")


def classify_scored(spark, folder):
    """All documents scored in batches, the attempts kept in a ledger, and routed from a replay of it."""
    found = candidates(with_parts(with_headers(document_mail(spark, folder))))
    made = score_batches(found, "system", "criteria", _answers, scratch_path(spark, "attempts"))
    rows = classify(found, made)
    return rows.select(F.col("msg_index").alias("doc_id"), "route", "attempts", "prompt_tokens")


def extract_classify(spark, folder):
    """Messages that hold a keyword, and only these, as candidates of the classifier, each with what the scorer is sent."""
    mail = with_headers(document_mail(spark, folder))
    found = candidates(with_parts(also_in(mail, find_matches(mail, Search(PATTERNS)), ["archive", "msg_index"])))
    prompt = F.sha2(user_message("Is this about work?"), 256)
    return found.select(F.col("msg_index").alias("doc_id"), "sender", "subject", prompt.alias("prompt_digest"))


QUERIES = {
    f.__name__: f
    for f in (quarantine, extraction_store, attachment_store, archive_index, repack_append, stream_quarantine, stream_names, charset_mix, multipart_bodies, classify_scored, extract_classify, collisions_prior)
}

DOCUMENT_TEXT = f"""
SELECT doc_id, {czech("'Dokument ' || doc_id || CASE WHEN length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) < 10 THEN '' ELSE ' ' || text END")} AS t
FROM documents"""
KIND = f"(conv_id + turn) % {KINDS}"
FAULTY_TEXT = MAIL_TEXT.replace("FROM conversations", f"FROM (SELECT conv_id, turn, CASE {KIND} WHEN 0 THEN '' ELSE text END AS text FROM conversations WHERE {KIND} <> 1)")
MATCHED = hits_sql(FAULTY_TEXT, "conv_id, turn")
NARROWED = r"""CASE doc_id % 4 WHEN 1 THEN regexp_replace(text, '[^\x{0}-\x{ff}]', '?', 'g')
  WHEN 2 THEN regexp_replace(text, '[^\x{0}-\x{7f}]', '?', 'g') ELSE text END"""

SQL = {
    "quarantine": f"""
SELECT conv_id, turn, 'failed_email_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END || '.eml' AS file_name,
  CASE kind WHEN 1 THEN 'header' ELSE 'body' END AS stage, CASE kind WHEN 1 THEN 'RecursionError' ELSE 'ValueError' END AS fault
FROM (SELECT conv_id, turn, {KIND} AS kind, row_number() OVER (ORDER BY conv_id::VARCHAR, turn) AS n FROM conversations WHERE {KIND} < 3)""",
    "extraction_store": MATCHED + """,
joined AS (SELECT conv_id, turn, string_agg(keyword, ', ' ORDER BY pattern_id, pos) AS matched_keywords FROM firsts WHERE nth = 1 GROUP BY conv_id, turn)
SELECT f.conv_id, f.turn, strftime(TIMESTAMP '2024-01-01' + to_days((f.conv_id % 3650)::INTEGER) + to_minutes(f.turn), '%Y%m%d_%H%M%S') || '_' || role
  || f.conv_id || '_c' || f.conv_id || 't' || f.turn || '_' || CASE WHEN f.turn > 0 THEN 'Re_' ELSE '' END || 'Vlákno_' || f.conv_id || '.eml' AS filename,
  false AS collision, CASE WHEN f.turn > 0 THEN 'Re: ' ELSE '' END || 'Vlákno ' || f.conv_id AS subject, matched_keywords
FROM joined f JOIN conversations c ON f.conv_id = c.conv_id AND f.turn = c.turn""",
    "attachment_store": PAGES + """
SELECT '<p' || page_id || '@example.com>' AS message_id, sha256(html) AS digest, size AS total_size_bytes,
  sha256(host || '|' || page_id) || '_001' || coalesce(nullif(regexp_extract(name, '[^/.][^/]*(\\.[^./]*)$', 1), ''), '.bin') AS file_name
FROM att""",
    "archive_index": "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS place FROM conversations",
    "repack_append": """
SELECT conv_id, turn, row_number() OVER (ORDER BY turn % 2, 'c' || conv_id || '_t' || turn || '.eml') AS place FROM conversations""",
    "stream_quarantine": MATCHED + f"""
SELECT DISTINCT 'matched' AS store, conv_id, turn FROM firsts
UNION ALL SELECT 'failed', conv_id, turn FROM conversations WHERE {KIND} < 3""",
    "stream_names": hits_sql(MAIL_TEXT, "conv_id, turn") + """,
n AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS k
  FROM (SELECT DISTINCT conv_id, turn FROM firsts) f JOIN conversations c USING (conv_id, turn))
SELECT role, role || CASE WHEN k = 0 THEN '' WHEN k < 1000 THEN '_' || lpad(k::VARCHAR, 3, '0') ELSE '_' || k END || '.eml' AS file_name,
  k > 0 AS collision FROM n""",
    "charset_mix": f"SELECT doc_id, {NARROWED} AS body FROM documents",
    "collisions_prior": """
WITH taken AS (SELECT role, count(*) AS n FROM conversations WHERE turn < 2 GROUP BY role),
later AS (SELECT conv_id, turn, c.role, coalesce(t.n, 0) + row_number() OVER (PARTITION BY c.role ORDER BY conv_id, turn) - 1 AS k
  FROM conversations c LEFT JOIN taken t ON c.role = t.role WHERE turn >= 2)
SELECT conv_id, turn, role || CASE WHEN k = 0 THEN '' WHEN k < 1000 THEN '_' || lpad(k::VARCHAR, 3, '0') ELSE '_' || k END || '.eml' AS file_name,
  k > 0 AS collision FROM later""",
    "classify_scored": """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'matched' ELSE 'rejected' END AS route,
  CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 6 END::BIGINT AS prompt_tokens
FROM documents""",
    "extract_classify": hits_sql(DOCUMENT_TEXT, "doc_id") + f"""
SELECT DISTINCT doc_id, 'Účastník <' || source || '@docs.example.com>' AS sender, 'Dokument ' || doc_id AS subject, prompt_digest
FROM hits JOIN ({classification.SENT}SELECT doc_id, source, {classification.PROMPT_DIGEST} AS prompt_digest FROM s) USING (doc_id)""",
    "multipart_bodies": f"SELECT doc_id, {NARROWED} || ' ' || lang AS body FROM documents",
}
