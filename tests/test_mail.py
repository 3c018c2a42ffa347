"""Archive splitting, message parsing and naming, one case per rule."""

import mailbox
import os
from email.message import EmailMessage
from email.mime.application import MIMEApplication
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from compare import difference
from letterlens.fixed_values import CHARSET_ORDER
from letterlens.functions.html import visible_text
from letterlens.functions.names import (
    attachment_file_name, confidence_name, message_file_name, message_id_token, safe_name_part,
)
from letterlens.operators.attachments import attachment_rows, attachment_summary, with_attachments
from letterlens.operators.keywords import searchable
from letterlens.operators.naming import failure_names, unique_names
from letterlens.operators.participants import check_target, of_any_target, of_target
from letterlens.plans.attachment_export import count_attachments, run_attachments
from letterlens.plans.repack import name_prefix, repack
from letterlens.scale import ordered_rank
from letterlens.sinks.messages import write_archive
from letterlens.sources.archives import first_messages, read_archives
from letterlens.sources.lists import choose_patterns, read_prompt
from letterlens.sources import mime
from letterlens.sources.messages import read_message_files, read_message_tree
from letterlens.sources.mime import body_text, pieces, with_headers, with_parts
from workloads import texts


def parsed(spark, *raws, **options):
    rows = [("a", i, r if isinstance(r, bytes) else r.encode()) for i, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "archive string, msg_index long, raw binary")
    return with_parts(with_headers(df), **options)


def bodies(df, mode="visible"):
    return [r[0] for r in df.orderBy("msg_index").select(body_text(mode)).collect()]


def test_archives_equal_mailbox(spark, tmp_path):
    """Same messages, bytes and order as the standard library's reader, over several splits."""
    long = b"".join(b"line %d of a long text\n" % i for i in range(200))
    archives = {
        "one.mbox": b"From a\nSubject: 1\n\nbody\n\nFrom b\nSubject: 2\n\nFrom c\n>From kept\nno blank before\nFrom d\n\nFrom e\nx\n\n\n\n",
        "junk.mbox": b"no envelope\nat first\nFrom a\nSubject: x\n\nbody\n\n",
        "bare": b"From a\nSubject: \xe9\xff\n\n8-bit \xfe\n\n",
        "bare_no_archive": b"Just text\nFrom a\nSubject: no\n\n",
        "other.txt": b"From a\nSubject: no\n\n",
        "long.mbox": b"".join(b"From x\nSubject: %d\n\n%s\n" % (i, long[: i * 37]) for i in range(60)),
        "crlf.mbox": b"From a\r\nSubject: x\r\n\r\nbody\r\n\r\nFrom b\r\nSubject: y\r\n\r\nz\r\n",
    }
    for name, data in archives.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = read_archives(spark, str(tmp_path)).orderBy("archive", "msg_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in rows:
        got.setdefault(os.path.basename(r.archive), []).append((r.msg_index, bytes(r.raw)))
    assert sorted(got) == ["bare", "crlf.mbox", "junk.mbox", "long.mbox", "one.mbox"]
    for name, messages in got.items():
        box = mailbox.mbox(tmp_path / name)
        assert messages == [(i, box.get_bytes(k)) for i, k in enumerate(box.keys())], name
    assert first_messages(read_archives(spark, str(tmp_path)), 1).count() == 5
    assert read_archives(spark, str(tmp_path / "other.txt")).count() == 1


def test_charset_order(spark):
    czech = "Žluťoučký kůň je tady"
    plain = "Content-Type: text/plain{}\nContent-Transfer-Encoding: 8bit\n\n"
    raws = [
        plain.format("").encode() + czech.encode("utf-8"),
        plain.format("; charset=utf-8").encode() + czech.encode("utf-8"),
        plain.format("; charset=nonsense").encode() + czech.encode("cp1250"),
        plain.format("").encode() + b"\x81\x83 \xc3\x28",
    ]
    # Undeclared UTF-8 is read as windows-1250 wherever that decodes.
    want = [r.split(b"\n\n", 1)[1] for r in raws]
    want = [None, czech, czech, want[3].decode("latin1")]
    try:
        want[0] = czech.encode().decode("cp1250")
    except UnicodeDecodeError:
        want[0] = czech
    assert bodies(parsed(spark, *raws)) == want
    assert bodies(parsed(spark, raws[0], charset_order=("utf-8", "latin1"))) == [czech]


def test_bodies(spark):
    mixed = MIMEMultipart()
    mixed.attach(MIMEText("plain part", "plain", "utf-8"))
    mixed.attach(MIMEText("<p>html <b>part</b></p><script>x()</script>", "html", "utf-8"))
    mixed.attach(MIMEText("col\n1", "csv", "utf-8"))
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("nested text")
    outer = EmailMessage()
    outer.set_content("outer text")
    outer.add_attachment(inner)
    outer.add_attachment("attached text", filename="a.txt")
    calendar = MIMEText("BEGIN", "calendar", "utf-8")
    df = parsed(spark, mixed.as_bytes(), outer.as_bytes(), calendar.as_bytes(), b"", "Subject: only\n\n")
    assert bodies(df) == ["plain part html part", "outer text\n nested text\n attached text\n", "BEGIN", "", ""]
    assert bodies(df, "strip")[0] == "plain part html part x()"
    assert [r[0] for r in df.orderBy("msg_index").select("n_headers").collect()][3] == 0


def test_search_text_rules(spark):
    # A short body is left out, the default subject is searched, folding may lengthen the text.
    df = searchable(parsed(spark, "Subject: S\n\nabsence", "Subject:  \n\nten chars and more", "To: x@y.z\n\nten chars and more", "Subject: =?utf-8?b?xLDwn5iA?=\n\n"))
    got = [r.folded for r in df.orderBy("msg_index").select("folded").collect()]
    assert got == ["s", "(no subject) ten chars and more", "(no subject) ten chars and more", "i̇😀"]


def test_headers(spark):
    raw = (
        b"From: =?utf-8?q?Nov=C3=A1k=2C_Jan?= <Jan@Firma.CZ>\nTo: A@b.cz\nTo: second@b.cz\nCc: x@y.z, \"Q, R\" <q@r.s>\n"
        b"Subject: =?utf-8?b?xb1sdcWl?= =?bogus?q?=E9?= tail\nDate: Mon, 15 Jan 2024 10:30:00 -0500\n\n"
    )
    eight_bit = b"Subject: caf\xe9\nDate: never\n\n"
    a, b = with_headers(parsed(spark, raw, eight_bit).select("archive", "msg_index", "raw")).orderBy("msg_index").collect()
    assert a.to_addrs == ["a@b.cz"] and a.cc_addrs == ["x@y.z", "q@r.s"]
    assert a.headers["to"] == ["A@b.cz", "second@b.cz"]
    assert a.subject == "Žluťé tail" or a.subject.startswith("Žluť")
    assert str(a.date_wall) == "2024-01-15 10:30:00" and str(a.date_utc) == "2024-01-15 15:30:00"
    assert b.subject == "café" and b.date_wall is None and b.from_addrs == []


def test_targets(spark):
    df = parsed(spark, "From: a@x.y\nTo: B@x.y\n\n", "From: b@x.y\nBcc: a@x.y\n\n", "From: c@x.y\nReply-To: a@x.y\n\n")
    index = lambda d: sorted(r.msg_index for r in d.select("msg_index").collect())
    assert index(of_target(df, "A@x.y ")) == [0, 2] and index(of_target(df, "b@x.y", True)) == [1]
    assert index(of_target(df, None)) == [0, 1, 2]
    table = spark.createDataFrame([("B@x.y",), ("c@x.y",), ("none",)], "address string")
    assert index(of_any_target(df, ["archive", "msg_index"], table)) == [0, 1, 2]
    assert index(of_any_target(df, ["archive", "msg_index"], table, from_only=True)) == [1, 2]
    with pytest.raises(ValueError):
        check_target("nobody")


def attachments_mail():
    mail = MIMEMultipart()
    mail["Subject"] = " "
    mail.attach(MIMEText("text", "plain", "utf-8"))
    for name, data in (("Smlouva ČÍSLO.PDF", b"%PDF"), ("empty.pdf", b""), ("notes.txt", b"n"), (".hidden", b"h")):
        part = MIMEApplication(data, "pdf")
        part.add_header("Content-Disposition", "attachment", filename=("utf-8", "", name))
        mail.attach(part)
    named = MIMEApplication(b"by name", "pdf", name="=?utf-8?q?p=C5=99=C3=ADloha=2Epdf?=")
    mail.attach(named)
    return mail.as_bytes()


def test_attachments(spark, tmp_path):
    df = parsed(spark, attachments_mail(), "Subject: none\n\ntext", with_payload=True)
    rows = attachment_rows(with_attachments(df, r"\.pdf$"), ["msg_index"]).collect()
    assert [(r.ordinal, r.filename, r.folded_name, bytes(r.payload), r.size) for r in rows] == [
        (1, "Smlouva ČÍSLO.PDF", "smlouva cislo.pdf", b"%PDF", 4), (2, "příloha.pdf", "priloha.pdf", b"by name", 7)
    ]
    # Folded names are lower case, so a case-sensitive pattern with capitals finds nothing.
    assert with_attachments(df, "PDF", case_sensitive=True).isEmpty()
    assert with_attachments(df, "PDF", case_sensitive=True, fold=False).count() == 1
    summary = attachment_summary(with_attachments(df, "."), ["msg_index"]).first()
    assert (summary.attachment_count, summary.total_size_bytes) == (4, 13)
    mail = with_headers(df.select("archive", "msg_index", "raw"))
    total = count_attachments(mail, "pdf").filter("archive is null").first()
    assert (total.processed, total.matched, total.attachments, total.failed) == (2, 1, 2, 0)
    run_attachments(mail, "pdf", str(tmp_path))
    log = spark.read.option("header", True).csv(f"{tmp_path}/log_csv").first()
    assert (log.attachment_count, log.attachment_sizes, log.attachment_types) == ("2", "4 | 7", "application/pdf | application/pdf")
    saved = spark.read.parquet(f"{tmp_path}/attachments").orderBy("file_name").collect()
    assert [s.file_name[-8:] for s in saved] == ["_001.PDF", "_002.pdf"]
    assert {s.file_name[:64] for s in saved} == {log.uuid}


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    lit = F.lit
    assert one(spark, safe_name_part(lit('  a<b>:"/\\|?* __c  d'))) == "a_b_c_d"
    assert one(spark, safe_name_part(lit("???"))) == "unknown"
    assert one(spark, safe_name_part(lit("abc def"), 4)) == "abc_"
    assert one(spark, message_id_token(lit("<--@x>"))) == "" and one(spark, message_id_token(lit(""))) == "nomsgid"
    assert one(spark, message_id_token(lit("<A-1.b_2@host>"))) == "A1b2"
    none = F.lit(None)
    name = message_file_name(none.cast("timestamp_ntz"), F.array().cast("array<string>"), none.cast("string"), lit(" "))
    assert one(spark, name) == "00000000_000000_unknown_nomsgid_no_subject.eml"
    for original, ext in (("a.tar.gz", ".gz"), (".bashrc", ".bin"), ("a", ".bin"), ("x.d/file", ".bin"), ("a.", ".")):
        assert one(spark, attachment_file_name(lit("k"), lit(7), lit(original))) == f"k_007{ext}"
    for value, prefix in ((0.29, "28"), (0.57, "56"), (1.0, "100"), (0.05, "05")):
        assert one(spark, confidence_name(lit(value), lit("m.eml"))) == f"{prefix}_m.eml"


def test_unique_names(spark):
    base = ["x.eml", "x.eml", "x_001.eml", "x.eml", "y.eml"]
    rows = spark.createDataFrame(list(enumerate(base)), "k int, base string")
    got = {r.k: (r.file_name, r.collision) for r in unique_names(rows, ["k"], "base").collect()}
    assert got[0] == ("x.eml", False) and got[2] == ("x_001.eml", False) and got[4] == ("y.eml", False)
    # x_001.eml is a message's own name, so the repeats take the next slots.
    assert got[1] == ("x_002.eml", True) and got[3] == ("x_003.eml", True)
    own_first = spark.createDataFrame(list(enumerate(["x_001.eml", "x.eml", "x.eml", "x_003.eml", "x.eml"])), "k int, base string")
    names = {r.k: r.file_name for r in unique_names(own_first, ["k"], "base").collect()}
    assert names == {0: "x_001.eml", 1: "x.eml", 2: "x_002.eml", 3: "x_003.eml", 4: "x_004.eml"}
    chained = ["x" + "_001" * (i // 2) + ".eml" for i in range(60)]
    chain = unique_names(spark.createDataFrame(list(enumerate(chained)), "k int, base string"), ["k"], "base")
    assert chain.select("file_name").distinct().count() == 60
    prior = spark.createDataFrame([("y.eml",), ("y_001.eml",)], "filename string")
    assert unique_names(rows, ["k"], "base", prior).filter("k = 4").first().file_name == "y_002.eml"
    failed = failure_names(rows.filter("k > 2"), ["k"])
    assert {r.k: r.file_name for r in failed.collect()} == {3: "failed_email_0001.eml", 4: "failed_email_0002.eml"}


def test_rank_of_a_hot_group(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("g"), "id")
    ranks = ordered_rank(rows, ["g"], ["id"], "nth")
    wrong = ranks.filter(
        F.col("nth") != F.when(F.col("g") == "cold", F.floor(F.col("id") / 10) + 1).otherwise(
            F.floor(F.col("id") / 10) * 9 + F.col("id") % 10 + 1)
    )
    assert ranks.count() == 20000 and wrong.isEmpty()


def test_visible_text(spark):
    cases = {
        "<p>a&amp;b<br>c</p><!-- no --> d <style>s{}</style><script>t('</p>')</script>": "a&b c d",
        "": "", "plain": "plain", "<div>x<template>no</template>y": "x y", "<p>open <b>bold": "open bold",
    }
    df = spark.createDataFrame(list(cases.items()), "h string, want string").withColumn("t", visible_text("h"))
    assert all(r.t == r.want for r in df.collect())


def test_visible_text_of_bare_references(spark):
    html = "<title>a &amp; b &copy; c&#33; d &amp</title>&copy 1 &notit; &x; &#33 &&quot;"
    row = spark.createDataFrame([(html,)], "html string").select(
        visible_text("html").alias("decoded"), visible_text("html", bare_references=False).alias("kept")
    ).first()
    assert row.decoded == 'a & b © c! d & © 1 ¬it; &x; ! &"'
    assert row.kept == 'a & b © c! d &amp &copy 1 &notit; &x; &#33 &"'


def test_html_visible_equals_sql_on_a_cut_title(spark, tmp_path):
    html = "<title>Fish &amp; chips &amp</title><p>&quot;x&quot; &copy</p>"
    spark.createDataFrame([(1, html)], "page_id long, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    assert difference(texts.html_visible(spark, str(tmp_path)), texts.SQL["html_visible"], str(tmp_path)) is None


def test_parsers_hold_few_messages_at_a_time():
    batch = pa.array([b"x" * 600_000] * 3 + [None, b""] + [b"Subject: a\n\nb"] * 600, pa.binary())
    lengths = [length for _, length in pieces(batch)]
    assert lengths[:3] == [1, 1, 256] and sum(lengths) == len(batch) and list(pieces(batch[:0])) == []
    for udf in (mime._headers(), mime._body(True, False, CHARSET_ORDER), mime._names()):
        made = list(udf.func(iter([batch])))
        assert [len(rows) for rows in made] == lengths
    made = list(mime._payloads(True).func(iter([(batch, pa.array([[0]] * len(batch)))])))
    assert [len(rows) for rows in made] == lengths
    same = [pa.array([value] * len(batch)) for value in ("a", 0, True)]
    placed = list(mime._placed_headers().func(iter([(*same, batch)])))
    assert [len(rows) for rows in placed] == lengths
    assert [row["block_pos"].as_py() for rows in placed for row in rows] == list(range(len(batch)))


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i}.eml").write_bytes(b"Subject: a\n\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # else 200 files are few splits
    try:
        messages, files = read_message_tree(spark, str(tmp_path))
        assert messages.rdd.getNumPartitions() == files.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
        assert read_message_files(spark, str(tmp_path)).rdd.getNumPartitions() == files.rdd.getNumPartitions()
        assert "Coalesce" in messages.repartitionByRange("archive")._jdf.queryExecution().executedPlan().toString()
        assert messages.count() == files.filter("is_message").count() == 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_repack(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "95_a.eml").write_bytes(b"Subject: a\n\nFrom here\n>From there\nend")
    (tmp_path / "in" / "sub" / "40_b.EML").write_bytes(b"Subject: b\n\n\xff\xfe bytes\n")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    out = str(tmp_path / "out")
    assert tuple(repack(spark, str(tmp_path / "in"), out).first()) == (2, 0, 1)
    rows = read_archives(spark, out, every_file=True).orderBy("archive", "msg_index").collect()
    assert [bytes(r.raw) for r in rows] == [b"Subject: a\n\n>From here\n>From there\nend\n", b"Subject: b\n\n\xff\xfe bytes\n"]
    repack(spark, str(tmp_path / "in"), out, name_prefix(["9", "100"]))
    assert read_archives(spark, out, every_file=True).count() == 3
    files = read_message_files(spark, str(tmp_path / "in"))
    assert [r.file_name for r in files.select("file_name").collect()] == ["95_a.eml"]


def test_configuration_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# comment\n\n  \\babc\\b  \nx+\n")
    (tmp_path / "empty.txt").write_text("# nothing\n")
    path = lambda n: str(tmp_path / n)
    assert choose_patterns(spark, path("p.txt")) == ["\\babc\\b", "x+"]
    assert choose_patterns(spark, path("empty.txt"), path("p.txt")) == ["\\babc\\b", "x+"]
    assert len(choose_patterns(spark, path("missing.txt"))) == 94
    (tmp_path / "several").mkdir()
    for i in range(20):
        (tmp_path / "several" / f"{i:02d}.txt").write_text("".join(f"# {i}\n a{i}b{j}\n" for j in range(i)))
    assert choose_patterns(spark, path("several")) == [f"a{i}b{j}" for i in range(20) for j in range(i)]
    (tmp_path / "prompt.txt").write_text("\n Two\nlines \n")
    assert read_prompt(spark, path("prompt.txt")) == "Two\nlines"


def test_explicit_paths(spark, tmp_path):
    folder = tmp_path / "my mail"
    folder.mkdir()
    (folder / "in.txt").write_bytes(b"From x\nSubject: a\n\nbody\n\n")
    for path in (f"{folder}/in.txt", f"{folder}/*.txt", f"file:{folder}/in.txt"):
        assert read_archives(spark, path).count() == 1
    with pytest.raises((FileNotFoundError, AnalysisException)):
        read_archives(spark, f"{folder}/none-*.txt")


def test_repacked_bytes(spark, tmp_path):
    raw = b"Subject: a\n\nFrom caf\xe9\nfrom \xff\n>From x\nFrom y\n"
    df = spark.createDataFrame([(1, bytearray(raw))], "k int, raw binary")
    write_archive(df, f"{tmp_path}/out.mbox", ["k"])
    back = read_archives(spark, f"{tmp_path}/out.mbox").collect()
    assert [bytes(r.raw) for r in back] == [raw.replace(b"\nFrom ", b"\n>From ")]


def test_unreadable_messages_are_kept(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(b"From x\nSubject: a\n\nbody\n\nFrom y\nSubject: b\n\nbody\n\n")
    mail = read_archives(spark, str(tmp_path / "a.mbox"))
    broken = mail.withColumn("header_error", F.when(F.col("msg_index") == 1, F.lit("bad header")))
    run_attachments(broken, r".*", str(tmp_path / "out"))
    failed = spark.read.parquet(str(tmp_path / "out" / "failed")).collect()
    assert [(r.file_name, r.reason, bytes(r.raw)[:10]) for r in failed] == [("failed_email_0001.eml", "bad header", b"Subject: b")]


def test_appends_keep_their_order(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "all.mbox")
    source.mkdir()
    for name in ("b1", "a1", "z2", "c2"):
        (source / f"{name}.eml").write_bytes(b"Subject: %s\n\nx\n" % name.encode())
    for number in "21":
        assert tuple(repack(spark, str(source), out, rf"{number}\.eml$").first()) == (2, 0, 0)
    broken = tmp_path / "all.mbox" / "run=000003"
    broken.mkdir()
    (broken / "part-00000.txt").write_bytes(b"From x\nSubject: broken off\n\n")
    subjects = [r.subject for r in read_archives(spark, out).orderBy("archive", "msg_index").collect()]
    assert subjects == ["c2", "z2", "a1", "b1"]
    repack(spark, str(source), out, "none")
    assert read_archives(spark, out).count() == 4
    repack(spark, str(source), out, "a1")
    assert [r.subject for r in read_archives(spark, out).orderBy("archive", "msg_index").collect()] == [*subjects, "a1"]
    manifest = spark.read.parquet(f"{out}/_manifest/run=000001")
    assert manifest.agg(F.sum("rows")).first()[0] == 2


def test_own_numbers_of_a_hot_name(spark):
    """Thousands of own numbers in one family: each repeat takes the next free one."""
    own = [f"x_{i:03d}.eml" for i in range(1, 9000, 3)]
    base = own[:1500] + ["x.eml"] * 4000 + own[1500:] + ["x_004.eml", "y.eml", "y.eml"]
    rows = spark.createDataFrame(list(enumerate(base)), "k int, base string")
    got = {r.k: r.file_name for r in unique_names(rows, ["k"], "base").collect()}
    taken, number, want = set(own), 0, {}
    for k, name in enumerate(base):
        if name == "x.eml":
            while number and f"x_{number:03d}.eml" in taken:
                number += 1
            want[k] = f"x_{number:03d}.eml" if number else name
            number += 1
    assert {k: got[k] for k in want} == want
    assert len(set(got.values())) == len(base)
