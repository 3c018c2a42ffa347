"""Messages that cannot be read in whole: recorded with stage and reason, counted, and searched as far as they go."""

import pytest
from pyspark.errors import SparkRuntimeException

from letterlens.operators.attachments import late_attachments
from letterlens.plans.attachment_export import count_attachments, run_attachments
from letterlens.plans.extraction import Search, count_matches, run_extraction
from letterlens.sources.archives import read_archives
from letterlens.sources.mime import name_row, payload_row, with_headers
from letterlens.streaming.intake import start_named_intake, stream_messages, stream_outcomes

HEAD = b"From x\nFrom: a@b.cz\nSubject: %s\n"
LOST = b"Content-Type: text/plain; charset*=u\x00''utf-8\n\nnever away\n"
NESTED = b"(" * 3000 + b"x" + b")" * 3000
PARTS = b'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: text/plain\n\n%s\n--b\n%s\n--b--\n\n'
ARCHIVE = b"".join((
    HEAD % b"sound" + b"\nI am away today\n\n",
    HEAD % b"lost" + LOST + b"\n",
    HEAD % b"half" + PARTS % (b"I am away today", LOST),
    b"From x\nFrom: " + NESTED + b"\nSubject: away\n\nI am away today\n\n",
    HEAD % b"nothing" + b"\nno word of it\n\n",
))


@pytest.fixture
def archive(tmp_path):
    (tmp_path / "a.mbox").write_bytes(ARCHIVE)
    return str(tmp_path / "a.mbox")


def test_extraction_records_every_stage(spark, archive, tmp_path):
    out = str(tmp_path / "out")
    mail = read_archives(spark, archive)
    assert tuple(run_extraction(mail, Search(["away"]), out).first()) == (5, 2, 3)
    failed = spark.read.parquet(f"{out}/failed").orderBy("file_name").collect()
    assert [(r.file_name, r.msg_index, r.stage, r.reason.split(":")[0]) for r in failed] == [
        ("failed_email_0001.eml", 1, "body", "ValueError"), ("failed_email_0002.eml", 2, "body", "ValueError"),
        ("failed_email_0003.eml", 3, "header", "RecursionError"),
    ]
    assert bytes(failed[0].raw).endswith(b"never away\n")
    # A message read in part is matched by that part, and failed as well.
    assert sorted(r.subject for r in spark.read.parquet(f"{out}/log").collect()) == ["half", "sound"]
    assert tuple(count_matches(mail, Search(["away"])).first()) == (5, 2, 3)
    # A body that the header rules out is not parsed and does not fail.
    assert tuple(count_matches(mail, Search(["away"], target="no@b.cz")).first()) == (5, 0, 1)


def test_counters_parse_once(spark, archive):
    counted = count_matches(with_headers(read_archives(spark, archive).select("archive", "msg_index", "raw")), Search(["away"]), ["archive"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("headers(") == 1 and plan.count("body(") == 1
    rows = counted.collect()
    assert sorted((r.archive is None, r.processed, r.matched, r.failed) for r in rows) == [(False, 5, 2, 3), (True, 5, 2, 3)]


def attachment(name, data=b"data", extra=b""):
    return b"Content-Type: application/pdf\nContent-Disposition: attachment; " + name + b"\n" + extra + b"\n" + data


def test_payloads_are_decoded_for_matching_names_only(spark, tmp_path, monkeypatch):
    parts = [attachment(b"filename=a.pdf"), attachment(b"filename=b.txt"), attachment(b"filename=c.pdf", b""), attachment(b"filename=d.pdf", b"dd")]
    raw = b'Content-Type: multipart/mixed; boundary="b"\n\n--b\n' + b"\n--b\n".join(parts) + b"\n--b--\n"
    names = name_row(raw)
    assert [(p["ord"], p["filename"]) for p in names["parts"]] == [(1, "a.pdf"), (2, "b.txt"), (3, "c.pdf"), (4, "d.pdf")]
    seen = []
    from email.message import Message

    whole = Message.get_payload
    monkeypatch.setattr(Message, "get_payload", lambda self, *a, **k: (k.get("decode") and seen.append(self.get_filename())) or whole(self, *a, **k))
    assert [p["size"] for p in payload_row(raw, [1, 4], False)["loaded"]] == [4, 2] and seen == ["a.pdf", "d.pdf"]
    monkeypatch.undo()
    df = spark.createDataFrame([("a", 0, raw), ("a", 1, b""), ("a", 2, None)], "archive string, msg_index long, raw binary")
    rows = late_attachments(df, r"\.pdf$", with_payload=True).orderBy("msg_index").collect()
    assert [(a.ordinal, a.filename, a.size, bytes(a.payload)) for a in rows[0].attachments] == [(1, "a.pdf", 4, b"data"), (2, "d.pdf", 2, b"dd")]
    assert [(len(r.attachments), r.stage) for r in rows] == [(2, None), (0, None), (0, None)]


def test_attachment_faults(spark, tmp_path):
    good, bad = attachment(b"filename=a.pdf"), attachment(b"filename*=u\x00''a.pdf")
    (tmp_path / "a.mbox").write_bytes(b"".join(HEAD % b"s" + b'Content-Type: multipart/mixed; boundary="b"\n\n--b\n' + p + b"\n--b--\n\n" for p in (
        good, bad, good + b"\n--b\n" + bad + b"\n--b\n" + good,
    )))
    out, mail = str(tmp_path / "out"), read_archives(spark, str(tmp_path / "a.mbox"))
    total = run_attachments(mail, "pdf", out).filter("archive is null").first()
    assert (total.processed, total.matched, total.attachments, total.failed) == (3, 2, 2, 2)
    assert sorted((r.msg_index, r.stage) for r in spark.read.parquet(f"{out}/failed").collect()) == [(1, "names"), (2, "names")]
    assert spark.read.parquet(f"{out}/attachments").count() == 2
    assert count_attachments(mail, "pdf").filter("archive is null").first().failed == 2


def test_stream_keeps_failures_under_their_batch(spark, tmp_path):
    inbox, table, failed = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "failed")
    inbox.mkdir()
    for number in range(2):
        (inbox / f"{number}.mbox").write_bytes(ARCHIVE)
        judged = stream_outcomes(stream_messages(spark, str(inbox)), Search(["away"]))
        start_named_intake(judged, table, str(tmp_path / "state"), failed).awaitTermination()
    assert sorted((r.batch, r.stage) for r in spark.read.parquet(failed).collect()) == sorted([(b, s) for b in (0, 1) for s in ("body", "body", "header")])
    names = sorted(r.filename for r in spark.read.parquet(table).collect())
    assert names == [f"00000000_000000_a_nomsgid_{s}{n}.eml" for s in ("half", "sound") for n in ("", "_001")]


def test_no_copy_of_the_archives_is_stored(spark, archive, tmp_path, monkeypatch):
    """Extraction stores counts per block and what it keeps, nothing else."""
    import letterlens.scale as scale
    from letterlens.operators import counters
    from letterlens.sources import archives

    stored = []
    whole = scale.materialize

    def watched(df, label):
        kept = whole(df, label)
        stored.append((label, "raw" in df.columns, kept.count()))
        return kept

    monkeypatch.setattr(archives, "materialize", watched)
    monkeypatch.setattr(counters, "materialize", watched)
    run_extraction(read_archives(spark, archive), Search(["away"]), str(tmp_path / "out"))
    assert [x for x in stored if x[1]] == [("outcomes", True, 4)]


def test_changed_archive_is_noticed(spark, tmp_path):
    path = tmp_path / "long.mbox"
    path.write_bytes(b"".join(b"From x\nSubject: %d\n\n%s\n" % (i, b"line\n" * 400) for i in range(60)))
    mail = read_archives(spark, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        with pytest.raises(SparkRuntimeException, match="changed since"):
            mail.count() and mail.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
