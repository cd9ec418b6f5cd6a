"""What a call costs: spans are merged in one reading, and lines without spoken numbers are not read word by word."""

import random

from spanloom.functions import spoken
from spanloom.operators import policy, spans


def test_merge_reads_its_spans_once_and_equals_a_choice_for_each_character(spark):
    rng, harm = random.Random(7), {r["type"]: r["harm"] for r in policy.types(spark).collect()}
    rows = []
    for key in range(60):
        for n in range(rng.randrange(9)):
            start = rng.randrange(30)
            rows.append((key, start, start + rng.choice([0, 1, 2, 5, 9]), rng.choice(["PERSON", "OTP", "LOCATION", "unheard"]), rng.choice(["format", "context", "propagate"]), rng.choice([0.5, 1.0]), n))
    merged = spans.merge(spark.createDataFrame(rows, "id int, start int, end int, type string, layer string, score double, input_pos int"), policy.types(spark))
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # that of harms
    rank = spans.V.LAYERS.index
    want = set()
    for key in range(60):
        own, last = [r for r in rows if r[0] == key], None
        best = [min((r for r in own if r[1] <= p < r[2]), key=lambda r: (-harm.get(r[3], 0), -rank(r[4]), r[1] - r[2], -r[5], r[6]), default=None) for p in range(41)]
        for p, r in enumerate(best):
            if r is not None and r is not last:
                end = next(q for q in range(p, 41) if best[q] is not r)
                want.add((key, p, end, *r[3:]))
            last = r
    got = [tuple(r) for r in merged.collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_lines_that_tell_of_no_number_are_passed_over(monkeypatch):
    read, plain = [], spoken.words_of
    monkeypatch.setattr(spoken, "words_of", lambda text: read.append(text) or plain(text))
    text = "hello there\nmy pin is one two three four\nthank you user12\nİ five six seven\nann at mail dot com dot sg\n42 to 7"
    found = spoken.rewrites(text)
    assert [text[a:z] for a, z, _ in found] == ["one two three four", "five six seven", "ann at mail dot com dot sg", "42 to 7"][: len(found)] and len(found) >= 3
    assert read == [x for x in text.split("\n") if x not in ("hello there", "thank you user12")]
    assert spoken.rewrites("nothing\nhere") == [] and len(read) == 4
