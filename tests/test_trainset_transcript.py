import json
import os

from ragloom.operators.trainset import clean_distinct, read_examples, split_pairs
from ragloom.operators.transcript import export_transcripts, transcript_lines


def test_training_set_json(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "dataset.json")
    with open(p, "w") as f:
        json.dump([{"text": " Q one? || A one. \n"}, {"text": "Q one? || A one."}, {"text": "no mark here"}], f)
    ex = read_examples(spark, p)
    assert sorted(r.text for r in clean_distinct(ex).collect()) == ["Q one? || A one.", "no mark here"]
    pairs, rejects = split_pairs(clean_distinct(ex))
    assert [(r.question, r.answer) for r in pairs.collect()] == [("Q one?", "A one.")]
    assert [r.text for r in rejects.collect()] == ["no mark here"]


def test_transcript_export(spark, tmpdir_path):
    conv = spark.createDataFrame([(1, 0, "user", " hi 👍 👎 "), (1, 1, "assistant", "hello"), (2, 0, "user", "x")],
                                 "conv_id long, turn long, role string, text string")
    lines = transcript_lines(conv, header="H")
    out = os.path.join(tmpdir_path, "t")
    export_transcripts(lines, out)
    d = os.path.join(out, "conv_id=1")
    body = "".join(open(os.path.join(d, f)).read() for f in sorted(os.listdir(d)) if f.startswith("part-"))
    assert body == "H\n\nYou (turn 0):\nhi\n\nAI Assistant (turn 1):\nhello\n\n"


def test_training_set_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "dataset.csv")
    with open(p, "w") as f:
        f.write('text\n"Q1? || multi\nline answer"\n"plain row"\n"Q1? || multi line answer"\n')
    ex = read_examples(spark, p, fmt="csv")
    got = sorted(r.text for r in clean_distinct(ex).collect())
    assert got == ["Q1? || multi line answer", "plain row"]
