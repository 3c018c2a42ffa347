"""Incremental intake: resumed from the checkpoint, names unique over batches."""

import json
import random

import pyarrow as pa
import pytest

from letterlens.plans.extraction import Search
from letterlens.streaming.intake import start_intake, start_named_intake, stream_matches, stream_messages
from letterlens.streaming.names import Slots, _packed, start_names

MAIL = b"From x\nFrom: a@b.cz\nSubject: %s\nMessage-ID: <same@id>\n\n%s\n\n"
SEARCH = Search([r"\babsen[ct][a-z]*", r"away"])


def arrive(folder, name, *messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(b"".join(MAIL % m for m in messages))


def test_intake_resumes(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    for expected, batch in ((1, [(b"s", b"I am away today"), (b"s", b"nothing to see")]), (2, [(b"absence", b"")])):
        arrive(inbox, f"{expected}.mbox", *batch)
        matches = stream_matches(stream_messages(spark, str(inbox)), SEARCH)
        start_intake(matches, table, state).awaitTermination()
        assert spark.read.schema(matches.schema).parquet(table).count() == expected


def test_search_options_are_honoured_or_refused(spark, tmp_path):
    arrive(tmp_path / "in", "1.mbox", (b"s", b"I am away today"))
    with pytest.raises(ValueError):
        stream_matches(stream_messages(spark, str(tmp_path / "in")), Search(["away"], limit=1))


def test_names_over_batches(spark, tmp_path):
    inbox, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    for number in range(2):
        arrive(inbox, f"{number}.mbox", (b"s", b"I am away today"), (b"s", b"still away today"))
        start_named_intake(stream_matches(stream_messages(spark, str(inbox)), SEARCH), table, state).awaitTermination()
    names = sorted(r.filename for r in spark.read.parquet(table).collect())
    stem = "00000000_000000_a_same_s"
    assert names == [f"{stem}.eml", f"{stem}_001.eml", f"{stem}_002.eml", f"{stem}_003.eml"]


def test_slots_against_a_list_of_names():
    """Every name is given once; a free name is kept; numbers follow the highest."""
    rnd = random.Random(5)
    for _ in range(300):
        slots, given = Slots(), set()
        for _ in range(rnd.randint(1, 40)):
            name = "x" + "".join(rnd.choice(["", "_001", "_002", "_007", "_000", "_0003"]) for _ in range(2)) + ".eml"
            uses = rnd.randint(1, 4)
            free = name not in given
            numbers = slots.take(name, uses).tolist()
            new = [name if k == 0 else f"{name[:-4]}_{k:03d}.eml" for k in numbers]
            assert (new[0] == name) == free and len(set(new)) == uses and not given & set(new)
            given |= set(new)
            slots = Slots(slots.stored())


def test_slots_stay_few():
    slots = Slots()
    for _ in range(50):
        slots.take("a.eml", 1000)
    assert json.loads(slots.stored()) == {"a.eml": [[0, 50_000]]}


def test_names_as_state(spark, tmp_path):
    table, names, state = (str(tmp_path / n) for n in ("table", "names", "state"))
    before = {}
    for run, bases in enumerate((["a.eml"] * 5 + ["a_002.eml", "b.eml"], ["a.eml"] * 3 + ["a_001.eml", "b.eml"], [])):
        rows = [(f"{run}", 0, i, base, b"raw") for i, base in enumerate(bases)]
        stored = spark.createDataFrame(rows, "archive string, block_start long, block_pos long, base_name string, raw binary")
        stored.repartition(2).write.mode("append").parquet(table)
        start_names(spark, table, names, state, files_per_batch=1).awaitTermination()
        now = {(r.archive, r.block_pos): r.file_name for r in spark.read.parquet(names).collect()}
        assert len(now) == len(set(now.values())) and before.items() <= now.items()
        before = now
    assert len(before) == 12 and {"a.eml", "a_001.eml", "a_002.eml", "b.eml", "b_001.eml"} <= set(before.values())
    plan = spark.read.parquet(names).filter("collision <> (file_name <> base)")
    assert plan.isEmpty()


def test_places_travel_as_numbers_per_run_of_a_block():
    rows = [("r", name, archive, 0, at) for at, (name, archive) in enumerate([("a", "x"), ("b", "x"), ("a", "x"), ("a", "y"), ("a", "x")])]
    columns = ["root", "base_name", "archive", "block_start", "block_pos"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], columns)
    packed = pa.Table.from_batches(_packed(iter([batch, batch[:0]]))).to_pylist()
    assert [tuple(row[c] for c in columns[1:]) for row in packed] == [
        ("a", "x", 0, [0, 2]), ("b", "x", 0, [1]), ("a", "y", 0, [3]), ("a", "x", 0, [4]),
    ]
