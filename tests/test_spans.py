"""Literal cases of checks and spoken forms, merging against brute force, and what no tier may show."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import checks, spoken
from spanloom.functions import values as V
from spanloom.operators import detect, metrics, policy, render, spans
from spanloom.plans import registry
from spanloom.sources import transcripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("check", "value", "valid"),
    [
        (checks.nric_valid, "S1234567D", True), (checks.nric_valid, "S1234567A", False), (checks.nric_valid, "", False),
        (checks.luhn_valid, "4111 1111 1111 1111", True), (checks.luhn_valid, "4111 1111 1111 1112", False),
        (checks.iban_valid, "GB29 NWBK 6016 1331 9268 19", True), (checks.iban_valid, "GB28 NWBK 6016 1331 9268 19", False),
    ],
)
def test_check_digits(spark, check, value, valid):
    assert one(spark, check(F.lit(value))) is valid


@pytest.mark.parametrize(
    ("said", "written"),
    [
        ("otp is four five six double seven eight", "otp is 456778"), ("oh okay one moment", "oh okay one moment"),
        ("wu liu qi ba jiu ling", "567890"), ("satu dua tiga empat", "1234"), ("nine for two three uh four five", "942345"),
        ("call 9 ,543 -6 ,140 now", "call 95436140 now"), ("forty thousand dollars", "40000 dollars"), ("born nineteen eighty five", "born 1985"),
    ],
)
def test_spoken_forms(spark, said, written):
    assert one(spark, spoken.normalize_with_map(F.lit(said)))["norm"] == written


def test_merge_equals_the_best_span_of_each_character(spark):
    draw = random.Random(5)
    harm = {r["type"]: r["harm"] for r in policy.types(spark).collect()}
    rows = []
    for call in range(60):
        for pos in range(draw.randrange(0, 7)):
            start = draw.randrange(12)
            rows.append((call, start, start + draw.randrange(1, 9), draw.choice(sorted(harm)), draw.choice(V.LAYERS), draw.choice([0.5, 1.0]), pos))
    given = spark.createDataFrame(rows, "id int, start int, end int, type string, layer string, score double, input_pos int")
    mine = {(r["id"], r["start"], r["end"], r["type"], r["input_pos"]) for r in spans.merge(given, policy.types(spark)).collect()}
    best = {}
    for r in sorted(rows, key=lambda r: (-harm[r[3]], -V.LAYERS.index(r[4]), r[1] - r[2], -r[5], r[6])):
        for at in range(r[1], r[2]):
            best.setdefault((r[0], at), r)
    expected = set()
    for (call, at), r in best.items():
        if best.get((call, at - 1)) is not r:
            end = at
            while best.get((call, end)) is r:
                end += 1
            expected.add((call, at, end, r[3], r[6]))
    assert mine == expected


def test_surrogates_keep_the_shape_and_stay_valid(spark):
    surfaces = [("NRIC", "S1234567D"), ("PHONE", "9123 4567"), ("IBAN", "GB29 NWBK 6016 1331 9268 19"), ("PHONE", "jiu yi er san wu liu qi ba")]
    rows = spark.createDataFrame(surfaces, "type string, surface string").withColumn("mac", F.sha2("surface", 256))
    got = [r["x"] for r in rows.select(render.surrogate(F.col("type"), F.col("surface"), F.col("mac")).alias("x")).collect()]
    assert one(spark, checks.nric_valid(F.lit(got[0]))) and got[0] != "S1234567D"
    assert got[1][0] == "9" and got[1][4] == " " and len(got[1]) == 9
    assert one(spark, checks.iban_valid(F.lit(got[2]))) and got[2] != surfaces[2][1]
    assert one(spark, spoken.digit_tokens(F.lit(got[3]))) != "91235678"


def test_credentials_are_in_no_tier(spark):
    said = [
        (1, 0, "can you read me the otp"), (1, 1, "four five six double seven eight"), (1, 2, "what is your account number"), (1, 3, "012-345678-9"),
        (2, 0, "my otp is 778899"), (2, 1, None), (3, 0, ""),
    ]
    turns = spark.createDataFrame(said, "call_id int, turn int, text string")
    found = detect.detect(turns)
    texts = detect.call_texts(turns)
    shown = render.render(texts, render.replacements(found, texts, policy.actions(spark), b"test")).collect()
    assert {r["id"] for r in shown} == {1, 2, 3}  # a call without spans is shown as well
    for r in shown:
        assert "778899" not in r["text"] and "double seven" not in r["text"]
        if r["id"] == 1 and r["tier"] != "RED":
            assert "012-345678-9" not in r["text"]


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], "id int, start int, end int, type string, layer string, score double, input_pos int")
    assert spans.merge(none, policy.types(spark)).count() == 0
    assert spans.coverage(none).count() == 0
    assert metrics.per_span(none.withColumn("harm", F.lit(1)), none).count() == 0


def test_exact_interval_of_a_share():
    low, high = metrics.clopper_pearson(11, 100)
    assert round(low, 4) == 0.0562 and round(high, 4) == 0.1883


RULES = [
    ("PERSON", "may i have your full name\nokay lim wei ming", "lim wei ming"), ("PERSON", "my name is Tan Ah Kow from here", "Tan Ah Kow"),
    ("PERSON", "hello, this is siti rahman", "siti rahman"), ("PERSON", "well this is marcus teo speaking", "marcus teo"),
    ("PERSON", "my name is joan, j, o, a, n", "j, o, a, n"), ("OTP", "the otp is 445566", "445566"), ("PIN", "my pin is 4455", "4455"),
    ("AMOUNT", "i earn 5000 a month", "5000"), ("AMOUNT", "i lost about 60000", "60000"), ("CVV", "three digits at the back is 456", "456"),
    ("CARD_EXPIRY", "it expires 08/29", "08/29"), ("SECURITY_ANSWER", "my first pet was mochi", "mochi"),
    ("DOB", "i was born on 3rd of march 1985", "3rd of march 1985"), ("DOB", "dob 3/4/85", "3/4/85"), ("ACCOUNT_NO", "my account number is 77 8899 11", "77 8899 11"),
    ("PHONE", "call me at 2345 6789", "2345 6789"), ("TXN_REF", "the reference number is ab 7788991", "ab 7788991"), ("EMPLOYER", "i work uh at um acme trading", "acme trading"),
    ("PERSON", "my mother kavitha nair", "kavitha nair"), ("LOCATION", "i live in sunny grove", "sunny grove"), ("BRANCH", "the bedok branch", "bedok"),
    ("NRIC", "last four of my nric 368 b", "368 b"), ("EMAIL", "tan at gmail dot com", "at gmail dot com"), ("ADDRESS", "blk two three four", "blk two three four"),
    ("OCCUPATION", "i'm a retiree", "retiree"), ("PASSPORT", "passport number k1234567e", "k1234567e"),
    ("IBAN", "iban is g b two nine n w b k six zero", "g b two nine n w b k six zero"), ("SWIFT", "swift code is d b s s s g s g", "d b s s s g s g"),
]


def test_every_cue_rule(spark):
    texts = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(RULES)], "id int, text string")
    found = {(r["id"], r["type"], RULES[r["id"]][1][r["start"] : r["end"]]) for r in detect.cue_spans(texts).collect()}
    assert {(i, t, value) for i, (t, _, value) in enumerate(RULES)} <= found
    said = ["this is a pretty good question", "my mother said so", "we met near tiong uh bahru", "lorong chuan", None]
    texts = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    assert detect.cue_spans(texts).count() == 0
    places = {(r["id"], said[r["id"]][r["start"] : r["end"]]) for r in detect.lexicon_spans(texts).collect()}
    assert places == {(2, "tiong uh bahru"), (3, "lorong chuan")}


def test_replies_in_words(spark):
    calls = [
        ["what is your mother's maiden name", "okay it was pei shan lah", "thank you"],
        ["and your first pet please tell me", "kopi", "ok"],
        ["can you read me the security code on the back", "uh four five six", "ok"],
        ["what is your pin", "double seven eight nine yes", "ok"],
        ["please read the card number", "four one two three", "eight eight one zero", "nine nine seven six okay", "all done"],
        ["may i have the otp", None, "what is your pin", "no thanks"],
    ]
    turns = spark.createDataFrame([(i, k, text) for i, call in enumerate(calls) for k, text in enumerate(call)], "call_id int, turn int, text string")
    whole = ["\n".join(text or "" for text in call) for call in calls]
    found = {(r["id"], r["type"], whole[r["id"]][r["start"] : r["end"]]) for r in detect.dialogue_spans(turns).collect()}
    assert found == {
        (0, "SECURITY_ANSWER", "pei shan"), (1, "SECURITY_ANSWER", "kopi"), (2, "CVV", "four five six"), (3, "PIN", "double seven eight nine"),
        (4, "CARD_NO", "four one two three"), (4, "CARD_NO", "eight eight one zero"), (4, "CARD_NO", "nine nine seven six"),
    }


def test_word_errors_of_long_texts(spark):
    draw = random.Random(7)
    ref = [f"word{i}" for i in range(700)]
    hyp = [ref[i + 256] if i % 90 == 0 and i < 400 else w for i, w in enumerate(ref) if draw.random() > 0.02]
    pairs = [(" ".join(ref), " ".join(hyp)), (" ".join(ref[:300]), " ".join(ref[256:556])), ("A  b c", "a b d"), ("", "a b"), ("same", " Same "), (None, "a"), ("a", None)]

    def edits(a, b):
        if a is None or b is None:
            return None
        a, b = ([w for w in x.lower().split()] or [""] for x in (a, b))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, ref string, hyp string").select("id", metrics.word_errors(F.col("ref"), F.col("hyp")).alias("n"))
    assert {r["id"]: r["n"] for r in rows.collect()} == {i: edits(*p) for i, p in enumerate(pairs)}


def test_annotated_lines_are_cleaned_and_kept(spark, tmp_path):
    given = [
        ("<mandarin>\u5403\u996d:chi fan</mandarin> already", "chi fan already"), ("<malay>makan:makan</malay> and <tamil>x:vanakkam</tamil>", "makan and vanakkam"),
        ("so (ppl) then [um] <noise/> yes", "so then yes"), ("i wan~ want ~go to", "i want to"), ("#singapore# is nice!", "singapore is nice"),
        ("wel_come to-day", "wel come to day"), ("plain words", "plain words"), ("", ""), (None, None),
    ]
    marks = ["<a>p:q</a>", "<noise>", "(x y)", "[z]", "cut~", "~off", "a_b", "c-d", "#!", "word", "two words"]
    draw = random.Random(9)

    def brute(text):
        out = re.sub(r"<[a-z]+>([^<]*):([^<]*)</[a-z]+>", r"\2", text)
        for pair in ("<>", "()", "[]"):
            kept = ""
            while out:
                head, opened, rest = out.partition(pair[0])
                inside, closed, tail = rest.partition(pair[1])
                kept, out = (kept + head + " ", tail) if closed else (kept + head + opened + rest, "")
            out = kept
        words = out.replace("cut~", " ").replace("~off", " ").replace("_", " ").replace("-", " ").replace("#", "").replace("!", "")
        return " ".join(words.split())

    drawn = [" ".join(draw.choices(marks, k=8)) for _ in range(100)]
    texts = given + [(text, brute(text)) for text in drawn]
    rows = [(1, i, text) for i, (text, _) in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id int, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    registry.load()
    got = {r["turn"]: r["text"] for r in registry.QUERIES["raw_clean"](spark, str(tmp_path)).collect()}
    assert got == {i: clean for i, (_, clean) in enumerate(texts)}


def test_running_sums_equal_a_plain_sum(spark):
    from spanloom.functions.offsets import running_sums

    lists = [[], [3], list(range(127)), list(range(129)), [7] * 1000]
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select(running_sums(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == [[sum(x[:i]) for i in range(len(x))] for x in lists]


def test_offsets_of_a_long_text_are_found_in_reasonable_time(spark):
    import time

    from spanloom.operators import metrics

    text = "word ünd " * 10_000
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    whole = spark.createDataFrame([(1, 0, 4, "PERSON")], "id long, start int, end int, type string")
    began = time.time()
    scores = metrics.span_scores(whole, whole, texts).collect()
    found = spans.find_spans(texts, "ünd", "PERSON", "format", 1.0).collect()
    assert scores[0]["tp"] == 1 and [r["start"] for r in found] == [m.start() for m in re.finditer("ünd", text)]
    assert time.time() - began < 30


def test_texts_without_spans_and_unknown_types_are_rendered_safely(spark):
    texts = spark.createDataFrame([(1, "call tan now"), (2, "nothing here"), (3, None), (4, "")], "id long, text string")
    found = spark.createDataFrame([(1, 5, 8, "UNHEARD", "format", 1.0)], "id long, start int, end int, type string, layer string, score double")
    replaced = render.replacements(found, texts, policy.actions(spark), b"k")
    got = {(r["id"], r["tier"]): r["text"] for r in render.render(texts, replaced).collect()}
    assert len(got) == 12 and {got[1, t] for t in V.TIERS} == {"call [REDACTED] now"} and {got[2, t] for t in V.TIERS} == {"nothing here"}
    assert {got[3, t] for t in V.TIERS} == {None} and {got[4, t] for t in V.TIERS} == {""}
    pieces = {(r["id"], r["tier"]): [p["text"] for p in r["pieces"]] for r in render.rendered_pieces(texts, replaced).where("id < 3").collect()}
    assert pieces[1, "RED"] == ["call ", "[REDACTED]", " now"] and pieces[2, "GREEN"] == ["nothing here"]


def test_names_are_found_again_beside_letters_that_grow_when_folded(spark):
    text = "my name is rahman.\nİİİİ hello Rahman, RAHMAN\nrahmans"
    texts = spark.createDataFrame([(1, text)], "id long, text string")
    known = spark.createDataFrame([(1, 11, 17, "PERSON", "context", 0.9)], "id long, start int, end int, type string, layer string, score double")
    got = sorted((r["start"], r["end"]) for r in detect.propagated_spans(texts, known).collect())
    assert [text[a:b] for a, b in got] == ["Rahman", "RAHMAN"]


def test_phrases_and_prefilters_find_what_patterns_find():
    import random

    from spanloom.functions import phrases, spoken

    rng = random.Random(5)
    parts = [w for words in V.LEXICONS.values() for w in words] + ["tan", "my name is Lim", "İş", "42", "S$5k", "a@b.sg", "012-345678-9", "otp", "İstanbul TAMPINES", "naïve", "x", ".", "\n"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(200)]
    lists = [x.words for x in detect.LEXICON_RULES]
    found = phrases.Phrases(lists).automaton()
    for text in texts:
        own = {}
        for k, a, b in found(phrases.folded(text)):
            own.setdefault(k, []).append((a, b))
        for k, words in enumerate(lists):
            assert own.get(k, []) == [m.span() for m in re.finditer("(?i)" + spoken.any_of(words), text)]
    patterns = [r.pattern for r in detect.CUE_RULES] + ["(?i)" + p for _, p, _ in V.FORMATS] + [r"(?:ab|c\d)+x?", r"[a-z]+", r"(?i)İ?stan"]
    may = phrases.Prefilter(patterns)
    assert len(may.always) < len(patterns) // 3
    for text in texts:
        kept = set(may.rules(phrases.folded(text)))
        assert all(k in kept or re.search(p, text) is None for k, p in enumerate(patterns))
    many = [f"phrase number{i}" for i in range(100_000)]
    assert list(phrases.Phrases([many]).automaton()("say phrase number99999 twice, phrase number99999")) == [(0, 4, 22), (0, 30, 48)]


def test_markup_keeps_long_lines_and_calls_of_one_large_file(spark):
    long = "x" * 1_200_000
    lines = [("f", 0, "C: before any call")] + [("f", 10 * i + k, t) for i in range(1, 30) for k, t in enumerate([f"### call{i} low", "C: my name is {{PERSON:Tan Ah Kow}} ok {{OTP:12}}", "noise", "A: yes"])]
    lines.append(("f", 10_000, "C: " + long + " {{OTP:99}}"))
    turns, gold = transcripts.parse_markup(spark.createDataFrame(lines, "file string, n long, line string").repartition(3))
    assert turns.count() == 29 * 2 + 1 and gold.count() == 29 * 2 + 1
    last = gold.where("value = '99'").collect()[0]
    assert (last["call_id"], last["turn"], last["start"], last["end"]) == ("call29", 2, 1_200_001, 1_200_003)
