"""Message operators over mail made from conversations and pages."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from letterlens.functions.names import message_file_name
from letterlens.functions.text import fold_czech, strip_tags
from letterlens.operators.attachments import (
    attachment_rows, attachment_summary, named_attachments, of_sizes, of_types,
)
from letterlens.operators.keywords import all_hits
from letterlens.operators.naming import failure_names, unique_names
from letterlens.operators.participants import address_roles, of_any_target, of_target
from letterlens.operators.selection import also_in, of_dates
from letterlens.plans.attachment_export import count_attachments, find_attachments
from letterlens.plans.extraction import Search, count_matches, find_matches
from letterlens.plans.repack import repack
from letterlens.scale import scratch_path
from letterlens.sinks.logs import attachment_log
from letterlens.sinks.messages import export_files
from letterlens.sources.archives import first_messages, read_archives
from letterlens.sources.messages import read_message_files
from letterlens.sources.mime import body_text, with_headers, with_parts
from letterlens.streaming.intake import start_intake, stream_matches, stream_messages
from workloads import table
from workloads.mail import (
    conversation_archive, conversation_mail, conversation_raw, page_mail, parsed_conversations,
)
from workloads.texts import PATTERNS, REPLIED_SQL, czech, hits_sql, replied, stripped, tags_cut

PAGE_NAMES = r"\.html$|^4"
TURN_FROM_ID = r"\.t([0-9]+)@"
CONV_FROM_ID = r"<c([0-9]+)\."


def with_source_key(messages: DataFrame) -> DataFrame:
    """conv_id and turn, recovered from the parsed Message-ID."""
    return messages.withColumns(
        {
            "conv_id": F.regexp_extract("message_id", CONV_FROM_ID, 1).cast("bigint"),
            "turn": F.regexp_extract("message_id", TURN_FROM_ID, 1).cast("bigint"),
        }
    )


def parsed_pages(spark: SparkSession, folder: str) -> DataFrame:
    return with_headers(page_mail(spark, folder))


def _round_trip(messages: DataFrame) -> DataFrame:
    whole = with_source_key(with_parts(messages))
    return whole.select(
        "conv_id", "turn", F.element_at("from_addrs", 1).alias("sender"), F.element_at("to_addrs", 1).alias("recipient"),
        "subject", F.date_format("date_wall", "yyyy-MM-dd HH:mm").alias("sent"), body_text().alias("body"),
        F.size("parts").cast("bigint").alias("n_parts"),
    )


def mail_round_trip(spark, folder):
    """Written as archive files, read back and parsed."""
    return _round_trip(read_archives(spark, conversation_archive(spark, folder), every_file=True))


def exported_files(spark: SparkSession, folder: str) -> str:
    """Every turn as one .eml file in the shared folder."""
    path = scratch_path(spark, "files")
    uri = path if "://" in path else f"file://{path}"
    names = F.format_string("c%d_t%d.eml", "conv_id", "turn")
    export_files(conversation_mail(spark, folder).withColumn("file_name", names), "raw", uri)
    return path


def message_files(spark, folder):
    return _round_trip(read_message_files(spark, exported_files(spark, folder)))


def repacked(spark, folder):
    """Single-message files packed into archive files and read back."""
    target = scratch_path(spark, "repacked")
    repack(spark, exported_files(spark, folder), target)
    return _round_trip(read_archives(spark, target, every_file=True))


def participant_filter(spark, folder):
    mail = of_target(parsed_conversations(spark, folder), " User7@Mail.Example.com ")
    return mail.select("conv_id", "turn")


def sender_filter(spark, folder):
    mail = of_target(parsed_conversations(spark, folder), "user7@mail.example.com", from_only=True)
    return mail.select("conv_id", "turn")


def target_table(spark, folder):
    """All messages that involve the sender of a system turn."""
    mail = parsed_conversations(spark, folder)
    system = table(spark, folder, "conversations").filter("role = 'system'")
    targets = system.select(F.format_string("SYSTEM%d@mail.example.com", "conv_id").alias("address"))
    return of_any_target(mail, ["conv_id", "turn"], targets).select("conv_id", "turn")


def address_role_table(spark, folder):
    return address_roles(parsed_conversations(spark, folder), ["conv_id", "turn"])


def message_filename(spark, folder):
    mail = parsed_conversations(spark, folder)
    name = message_file_name(F.col("date_wall"), F.col("from_addrs"), F.col("message_id"), F.col("subject"))
    return mail.select("conv_id", "turn", name.alias("file_name"))


def collisions(spark, folder):
    """Names without the turn: one name per role, so the largest group holds half of all rows."""
    turns = table(spark, folder, "conversations")
    named = turns.select("conv_id", "turn", F.concat("role", F.lit(".eml")).alias("base_name"))
    return unique_names(named, ["conv_id", "turn"], "base_name").select("conv_id", "turn", "file_name", "collision")


def first_n(spark, folder):
    return first_messages(conversation_mail(spark, folder), 2).select("conv_id", "turn")


def matched_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return find_matches(parsed_conversations(spark, folder), Search(PATTERNS))


def extraction(spark, folder):
    rows = matched_conversations(spark, folder)
    return rows.select("conv_id", "turn", F.inline_outer("hits"))


def reply_only(spark, folder):
    """The search in the text above the quoted turn only."""
    mail = replied(spark, folder).select(
        "conv_id", "turn", F.col("conv_id").cast("string").alias("archive"), F.col("turn").alias("msg_index"),
        conversation_raw(F.col("body")).alias("raw"),
    )
    found = find_matches(with_headers(mail), Search(PATTERNS, reply_only=True))
    return found.select("conv_id", "turn", F.inline_outer("hits"))


def failed_names(spark, folder):
    """Numbered names for the system turns, taken as the failed messages."""
    failed = table(spark, folder, "conversations").filter("role = 'system'")
    return failure_names(failed, ["conv_id", "turn"])


def date_range(spark, folder):
    mail = of_dates(parsed_conversations(spark, folder), "2024-01-15", "2024-02-20")
    return mail.select("conv_id", "turn")


def run_counters(spark, folder):
    mail = parsed_conversations(spark, folder)
    return count_matches(mail, Search(PATTERNS))


def stream_intake(spark, folder):
    """The same search over archive files that arrive as a stream."""
    arrived, result = conversation_archive(spark, folder), scratch_path(spark, "stream")
    matches = stream_matches(stream_messages(spark, arrived), Search(PATTERNS))
    start_intake(matches, result, scratch_path(spark, "stream-state")).awaitTermination()
    found = with_source_key(spark.read.schema(matches.schema).parquet(result))
    return found.select("conv_id", "turn", F.inline_outer("hits"))


def page_attachments(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    return find_attachments(parsed_pages(spark, folder), PAGE_NAMES, with_payload=with_payload)


def attachment_hits(spark, folder):
    rows = attachment_rows(page_attachments(spark, folder, with_payload=True), ["msg_index", "uuid"])
    named = named_attachments(rows, F.col("uuid"))
    return named.select(
        F.col("msg_index").alias("page_id"), F.col("ordinal").cast("bigint").alias("ordinal"), "filename",
        "content_type", "size", F.sha2("payload", 256).alias("digest"), "file_name",
    )


def attachment_rollup(spark, folder):
    keys = ["msg_index", "uuid", "date_raw", "from_raw", "subject_raw", "subject", "message_id"]
    log = attachment_log(attachment_summary(page_attachments(spark, folder), keys))
    return log.select(
        "message_id", "subject", F.col("attachment_count").cast("bigint").alias("attachment_count"),
        F.array_join("attachment_names", " | ").alias("attachment_names"),
        F.array_join(F.col("attachment_sizes").cast("array<string>"), " | ").alias("attachment_sizes"),
        F.array_join("attachment_types", " | ").alias("attachment_types"), "total_size_bytes",
    )


def attachment_totals(spark, folder):
    return count_attachments(parsed_pages(spark, folder), PAGE_NAMES)


def size_filter(spark, folder):
    rows = attachment_rows(page_attachments(spark, folder), ["msg_index"])
    kept = of_sizes(of_types(rows, ["text/html"]), 1500, 4000)
    return kept.select(F.col("msg_index").alias("page_id"), "size")


def content_and_attachment(spark, folder):
    """Pages whose text holds a keyword and whose name matches."""
    pages = table(spark, folder, "pages")
    texts = pages.select("page_id", fold_czech(strip_tags(F.col("html"))).alias("folded"))
    hits = all_hits(texts, ["page_id"], "folded", [r"licen[cs]e", r"[0-9]{3,}"]).select("page_id")
    named = page_attachments(spark, folder).select(F.col("msg_index").alias("page_id"))
    return also_in(named, hits, ["page_id"])


QUERIES = {
    "mail_round_trip": mail_round_trip,
    "message_files": message_files,
    "repack": repacked,
    "participant_filter": participant_filter,
    "sender_filter": sender_filter,
    "target_table": target_table,
    "address_roles": address_role_table,
    "message_filename": message_filename,
    "collisions": collisions,
    "first_n": first_n,
    "extraction": extraction,
    "reply_only": reply_only,
    "failure_names": failed_names,
    "date_range": date_range,
    "run_counters": run_counters,
    "stream_intake": stream_intake,
    "attachment_hits": attachment_hits,
    "attachment_rollup": attachment_rollup,
    "attachment_totals": attachment_totals,
    "size_filter": size_filter,
    "content_and_attachment": content_and_attachment,
}

OTHER = "CASE role WHEN 'user' THEN 'assistant' ELSE 'user' END"
SUBJECT = "CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END || 'Vlákno ' || conv_id"
SENT = "(TIMESTAMP '2024-01-01' + to_days((conv_id % 3650)::INTEGER) + to_minutes(turn))"
ROUND_TRIP = f"""
SELECT conv_id, turn, role || conv_id || '@mail.example.com' AS sender,
       {OTHER} || conv_id || '@mail.example.com' AS recipient, {SUBJECT} AS subject,
       strftime({SENT}, '%Y-%m-%d %H:%M') AS sent, text AS body, 1::BIGINT AS n_parts
FROM conversations"""
PAGES = """
WITH named AS (
  SELECT *, regexp_extract(url, '[^/]*$', 0) AS name, strlen(html) AS size, split_part(url, '/', 3) AS host FROM pages),
att AS (SELECT * FROM named WHERE regexp_matches(lower(name), '\\.html$|^4') AND size > 0)
"""
MAIL_TEXT = f"""
SELECT conv_id, turn, {czech(f"({SUBJECT}) || CASE WHEN length(trim(text, chr(9) || chr(10) || chr(13) || ' ')) < 10 THEN '' ELSE ' ' || text END")} AS t
FROM conversations"""
MAIL_HITS = hits_sql(MAIL_TEXT, "conv_id, turn") + (
    "SELECT conv_id, turn, pattern_id, keyword, pos FROM firsts WHERE nth = 1"
)

BODY, REPLY = "text || tail", stripped("text")
REPLY_TEXT = f"""
SELECT conv_id, turn, {czech(f"({SUBJECT}) || CASE WHEN length({stripped('reply')}) < 10 THEN '' ELSE ' ' || reply END")} AS t
FROM (SELECT conv_id, turn, CASE WHEN length({stripped(BODY)}) < 10 THEN {BODY}
        WHEN tail <> '' THEN CASE WHEN {REPLY} = '' THEN {BODY} ELSE {REPLY} END
        WHEN length({REPLY}) < 20 THEN text ELSE {REPLY} END AS reply
      FROM ({REPLIED_SQL}))"""

SQL = {
    "mail_round_trip": ROUND_TRIP,
    "message_files": ROUND_TRIP,
    "repack": ROUND_TRIP,
    "participant_filter": f"""
SELECT conv_id, turn FROM conversations WHERE conv_id = 7 AND (role = 'user' OR {OTHER} = 'user')""",
    "sender_filter": "SELECT conv_id, turn FROM conversations WHERE conv_id = 7 AND role = 'user'",
    "target_table": "SELECT conv_id, turn FROM conversations WHERE role = 'system'",
    "address_roles": f"""
SELECT conv_id, turn, 'from' AS role, role || conv_id || '@mail.example.com' AS address FROM conversations
UNION ALL SELECT conv_id, turn, 'to', {OTHER} || conv_id || '@mail.example.com' FROM conversations""",
    "message_filename": f"""
SELECT conv_id, turn, strftime({SENT}, '%Y%m%d_%H%M%S') || '_' || role || conv_id || '_c' || conv_id || 't' || turn
  || '_' || replace(CASE WHEN turn > 0 THEN 'Re_ ' ELSE '' END || 'Vlákno ' || conv_id, '_ ', ' ').replace(' ', '_')
  || '.eml' AS file_name FROM conversations""",
    "collisions": """
WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS k
           FROM conversations)
SELECT conv_id, turn, role || CASE WHEN k = 0 THEN '' WHEN k < 1000 THEN '_' || lpad(k::VARCHAR, 3, '0')
  ELSE '_' || k END || '.eml' AS file_name, k > 0 AS collision FROM n""",
    "first_n": "SELECT conv_id, turn FROM conversations WHERE turn < 2",
    "extraction": MAIL_HITS,
    "reply_only": hits_sql(REPLY_TEXT, "conv_id, turn") + (
        "SELECT conv_id, turn, pattern_id, keyword, pos FROM firsts WHERE nth = 1"
    ),
    "failure_names": """
SELECT conv_id, turn, 'failed_email_' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END || '.eml'
  AS file_name FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations
  WHERE role = 'system')""",
    "date_range": f"""
SELECT conv_id, turn FROM conversations WHERE {SENT}::DATE BETWEEN DATE '2024-01-15' AND DATE '2024-02-20'""",
    "run_counters": hits_sql(MAIL_TEXT, "conv_id, turn") + """
SELECT (SELECT count(*) FROM conversations) AS processed,
       (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn FROM hits)) AS matched, 0::BIGINT AS failed""",
    "stream_intake": MAIL_HITS,
    "attachment_hits": PAGES + """
SELECT page_id, 1::BIGINT AS ordinal, name AS filename, 'text/html' AS content_type, size, sha256(html) AS digest,
  sha256(host || '|' || page_id) || '_001' || coalesce(nullif(regexp_extract(name, '[^/.][^/]*(\\.[^./]*)$', 1), ''), '.bin')
  AS file_name FROM att""",
    "attachment_rollup": PAGES + """
SELECT '<p' || page_id || '@example.com>' AS message_id, url AS subject, 1::BIGINT AS attachment_count,
  name AS attachment_names, size::VARCHAR AS attachment_sizes, 'text/html' AS attachment_types,
  size AS total_size_bytes FROM att""",
    "attachment_totals": PAGES + """
SELECT host AS archive, count(*) AS processed, count(*) FILTER (WHERE page_id IN (SELECT page_id FROM att)) AS matched,
  count(*) FILTER (WHERE page_id IN (SELECT page_id FROM att)) AS attachments, 0::BIGINT AS failed
FROM named GROUP BY ROLLUP (host)""",
    "size_filter": PAGES + "SELECT page_id, size FROM att WHERE size BETWEEN 1500 AND 4000",
    "content_and_attachment": PAGES + f"""
SELECT page_id FROM att WHERE regexp_matches({czech(tags_cut('html'))}, 'licen[cs]e|[0-9]{{3,}}')""",
}
