import json
import zipfile

import pandas as pd

from tallymark import sources, streaming
from tallymark.operators import intake


def test_actions_stream_equals_batch(spark, tmp_path):
    rows = [(c, s, ["assign", "category", "workflow", "not_spam"][s % 4], None if s % 3 else s - 2) for c in (1, 2, 3) for s in range(12)]
    log = spark.createDataFrame(rows, streaming.ACTION)
    log.where("seq < 6").coalesce(1).write.parquet(str(tmp_path / "in"))
    got: list[pd.DataFrame] = []

    def go():
        stream = streaming.apply_actions(streaming.new_files(spark, str(tmp_path / "in"), streaming.ACTION))
        streaming.run_once(stream, str(tmp_path / "ck"), lambda df, _: got.append(df.toPandas()))

    go()
    log.where("seq >= 6").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    names = [x.split()[0] for x in streaming.OUTCOME.split(", ")]
    order = lambda df: df[names].sort_values(["case_id", "seq"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(pd.concat([x for x in got if len(x)])), order(streaming.replay_actions(log).toPandas()), check_dtype=False)


def test_emails_and_archives(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    for name, body in {"a": {"email_id": "1", "from": "x", "subject": "s", "body": "b", "attachments": ["p/a.txt"]}, "b": {"email_id": "", "subject": "s"}}.items():
        (tmp_path / "inbox" / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "inbox" / "c.json").write_text("{no json")
    good, bad = sources.read_emails(spark, str(tmp_path / "inbox"))
    assert [r.email_id for r in good.collect()] == ["1"]
    assert {r.file: r.reason for r in bad.collect()} == {"b.json": "email_id", "c.json": "invalid_json"}
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("p/a.txt", "hello")
        z.writestr("../evil.txt", "x")
    found = sources.expand_archives(spark.read.format("binaryFile").load(str(tmp_path / "x.zip"))).collect()
    assert {r.member: r.error for r in found} == {"p/a.txt": None, "../evil.txt": "unsafe_member"}


def test_import_twice_adds_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id int, digest string")
    first = intake.import_outcome(rows)
    assert {r.doc_id: r.outcome for r in first.collect()} == {1: "accepted", 2: "duplicate", 3: "accepted"}
    again = intake.import_outcome(rows, first.where("outcome = 'accepted'"))
    assert {r.outcome for r in again.collect()} == {"duplicate"}
