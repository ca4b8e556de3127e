"""Captions in JSON of any shape, and rolling captions against a plain fold."""

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators import stateful as S
from lectern.sources import transcripts


def test_json_of_unknown_shape(spark):
    files = {
        "plain": '{"segments": [{"start": 1.9, "text": " so  it\\nbegan "}, {"start": "0:01:05", "text": "later"}, {"text": "no time"}, {"start": 3, "text": ""}, {"start": 4}, "no object", null]}',
        "bare": '[{"offset": 7, "content": "first key wins", "transcript": "not this"}, {"begin": null, "start_time": "2:00", "utterance": "under an earlier key"}]',
        "ms": '{"data": [{"startMs": 250000, "text": "millis"}, {"startMs": 99999, "text": "short"}]}',
        "words": '{"results": [{"t": 5, "speaker": "Ada", "words": [{"word": "one"}, {"word": "two"}, {"w": 1}]}, {"t": 6, "words": [{"word": "unsaid"}]}, {"t": 8, "speaker": 3, "speaker_label": "B", "text": "labelled"}]}',
        "deep": '{"a": {"items": {"cues": {"x": 1}}}, "b": {"c": [{"transcript": [{"start": 2, "text": "too deep to win"}]}], "cues": [{"start": 1, "body": "near"}]}}',
        "order": '{"cues": [{"start": 1, "text": "no"}], "segments": [], "results": [{"start": 2, "text": "yes"}]}',
        "under": '{"results": {"page": {"data": [{"t": 3, "text": "under two"}]}}}',
        "broken": '{"segments": [', "scalar": "5", "empty": "", "none": None, "nothing": '{"a": {"b": [1, 2]}}',
    }
    df = spark.createDataFrame(list(files.items()), "id string, body string")
    got = {}
    for r in transcripts.json_captions(df, "id", "body").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.t, r.text, r.speaker))
    assert got.pop("plain") == [(1, "so it began", None), (65, "later", None), (0, "no time", None)]
    assert got.pop("bare") == [(7, "first key wins", None), (120, "under an earlier key", None)]
    assert got.pop("ms") == [(250, "millis", None), (99999, "short", None)]
    assert got.pop("words") == [(5, "one two", "Ada"), (8, "labelled", "B")]
    assert got == {"deep": [(1, "near", None)], "order": [(2, "yes", None)], "under": [(3, "under two", None)]}
    assert transcripts.json_captions(df.limit(0), "id", "body").count() == 0


@given(st.lists(st.sampled_from("ab"), max_size=12), st.lists(st.sampled_from("ab"), max_size=8))
def test_overlap(said, new):
    assert S.overlap(said, new) == max(n for n in range(len(new) + 1) if n == 0 or said[-n:] == new[:n])


def test_rolling_captions_over_batches(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for key in range(5):
        said = []
        for pos in range(300):
            new = [rng.choice("abc") for _ in range(rng.randrange(5))]
            rows.append((key, pos, " ".join(new)))
            n = next(n for n in range(len(new), -1, -1) if n == 0 or said[-10:][-n:] == new[:n] and n <= len(said[-10:]))
            said = (said + new[n:])[-10:]
            if new[n:]:
                want.setdefault(key, []).append(" ".join(new[n:]))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = S.dedupe_rolling(spark.createDataFrame(rows, "id long, pos long, text string"), keep=10).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("r")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: [x.text for x in r.r] for r in got} == want
