"""The eight-message sample: known matches, keywords and offsets."""

import pytest

from letterlens.fixed_values import ATTACHMENT_LOG, DEFAULT_SEARCH_PATTERNS, EXTRACTION_LOG
from letterlens.plans.extraction import Search, count_matches, find_matches, run_extraction
from letterlens.sources.archives import read_archives
from letterlens.sources.samples import write_sample_archive

TARGET = "jan.novak@firma.cz"
ALL = {
    1: ["dovolena@0", "dovolene@29", "do 31.8@38"],
    2: ["out of office@0"],
    3: ["nemocenska@0", "nemocenske@31", "vratim se@53"],
    5: ["mimo kancelar@21", "vratim se@55"],
    6: ["dovolene@11", "dovolena@82"],
    7: ["dovolena@0", "dovolenou@28"],
    8: ["dovolena@6", "dovolenou@39", "radna dovolen@0", "radnou dovolen@32", "do 15.9@49"],
}


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sample") / "archive")
    write_sample_archive(spark, path)
    return read_archives(spark, path, every_file=True)


def found(messages, **options):
    rows = find_matches(messages, Search(DEFAULT_SEARCH_PATTERNS, **options)).select("msg_index", "hits").collect()
    return {r.msg_index + 1: [f"{h.keyword}@{h.pos}" for h in r.hits] for r in rows}


def test_all(messages):
    assert found(messages) == ALL


def test_target(messages):
    assert found(messages, target=TARGET) == {k: v for k, v in ALL.items() if k != 7}


def test_sender_only(messages):
    assert found(messages, target=TARGET, from_only=True) == {1: ALL[1]}


def test_reply_only(messages):
    assert found(messages, target=TARGET, reply_only=True) == {
        **{k: v for k, v in ALL.items() if k != 7}, 6: ["dovolene@11"]
    }


def test_limit_counts_before_filters(messages):
    assert sorted(found(messages, target=TARGET, limit=4)) == [1, 2, 3]


def test_counters(messages):
    assert tuple(count_matches(messages, Search(DEFAULT_SEARCH_PATTERNS, target=TARGET)).first()) == (8, 6, 0)


def test_run(spark, messages, tmp_path):
    out = str(tmp_path)
    assert tuple(run_extraction(messages, Search(DEFAULT_SEARCH_PATTERNS), out).first()) == (8, 7, 0)
    log = spark.read.option("header", True).csv(f"{out}/log_csv")
    assert log.columns == EXTRACTION_LOG and len(ATTACHMENT_LOG) == 12
    row = log.filter("filename like '%abc123%'").first()
    assert row.filename == "20240102_080000_jan.novak_abc123_Dovolená.eml"
    assert (row.collision, row.subject) == ("False", "Dovolená")
    assert row.matched_keywords == "dovolena, dovolene, do 31.8" and row.match_positions == "0, 29, 38"
    assert row["from_address"].startswith("=?utf-8?b?")
    saved = {r.file_name: bytes(r.raw) for r in spark.read.parquet(f"{out}/messages").collect()}
    assert len(saved) == 7 and saved[row.filename].startswith(b"Content-Type: text/plain")
    again = run_extraction(messages, Search(DEFAULT_SEARCH_PATTERNS), str(tmp_path / "again"), prior_log=log)
    assert tuple(again.first()) == (8, 7, 0)
    names = {r.filename for r in spark.read.parquet(f"{tmp_path}/again/log").collect()}
    assert "20240102_080000_jan.novak_abc123_Dovolená_001.eml" in names
