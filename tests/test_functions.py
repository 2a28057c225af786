from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from klangsieb.functions import arrays, hashing, text
from klangsieb.functions.plain import plain_word_parts, plain_words


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()] or ["id"]).select(column).first()[0]


def test_plain_words():
    assert plain_words("Gr&ouml;&szlig;e, STRASSE & Fluß3-mal­​x") == ["grösse", "strasse", "fluss3", "malx"]
    assert plain_words("über ẞ &amp;amp;") == ["über", "ss", "amp"] and plain_words(None) == plain_words(" … ") == []
    long = "ab cd&nbsp;e " * 5000
    assert [w for part in plain_word_parts(long, 100) for w in part] == plain_words(long)
    assert [w for part in plain_word_parts("x" * 5000, 100) for w in part] == ["x" * 5000]


@pytest.mark.parametrize("key", ["les-00000001", "ü", ""])
def test_hashes(spark, key):
    d = hashlib.sha1(key.encode()).hexdigest()
    assert one(spark, hashing.byte_fraction(F.lit(key))) == int(d[:2], 16) / 255
    assert one(spark, hashing.word_fraction(F.lit(key))) == int(d[:8], 16) / 0xFFFFFFFF
    for n in (1, 2, 97, 10**12):
        assert one(spark, hashing.digest_mod(F.lit(key), F.lit(n).cast("bigint"))) == int(d, 16) % n
    assert one(spark, hashing.job_seed(F.lit(key))) == int(d[:8], 16) % 2**31
    assert one(spark, hashing.frame_seed(F.lit(76), F.lit("ab"), F.lit(7))) == (76 * 7 + 97 + 98) % 10000 % 7
    assert one(spark, hashing.rolling_digest(F.array(F.lit("a"), F.lit("b")))) == hashlib.sha256(b"ab").hexdigest()


def test_texts(spark):
    cases = [
        (text.clean(F.lit(" – Hé…  [x]  “y” -")), "Hé... x y"), (text.clean(F.lit("[]")), None), (text.digit_ratio(F.lit("a1b2")), 0.5),
        (text.sentence_case(F.lit("ja")), "Ja."), (text.sentence_case(F.lit("nein!")), "Nein!"), (text.fold_case(F.lit("Maß MASẞ")), "mass masss"),
        (text.all_lower(F.lit("alles klein 3")), True), (text.all_lower(F.lit("3 4")), False), (text.eval_form(F.lit("Ach, »so«_x é!")), "ach so _x é"),
        (text.eval_form_signs(F.lit("5 % ß €"), F.lit("de")), "5 prozent ss euro"), (text.slug(F.lit("Ab c/ü.d")), "ab-c-d"),
        (text.language_of(F.lit("x-en")), "en"), (text.language_of(F.lit("x-fr")), "de"), (text.language_of(F.lit("en")), "de"),
        (text.value_in_label(F.lit("run_val6_338.pt")), 6.338), (text.value_in_label(F.lit("run")), math.inf), (text.stem(F.lit("a/b.c.wav")), "b.c"),
        (text.proportional_cut(F.lit("a b c. d e, f g h"), F.lit(0.5)), "a b c"), (text.proportional_cut(F.lit("a b, c d e f g h"), F.lit(0.5)), "a b"), (text.proportional_cut(F.lit("a b"), F.lit(0.1)), "a b"),
        (text.syllables(F.lit("ˈtsvœlf")), 1), (text.syllables(F.lit("ˈfʁøːlɪç")), 2), (text.stressed_syllable(F.lit("fɛˈʁaːtən")), 1), (text.stressed_syllable(F.lit("abc")), 0),
        (text.human_bytes(F.lit(1536)), "1.5 KiB"), (text.human_bytes(F.lit(12)), "12 B"), (text.percent_interval(F.lit(0.123), F.lit(0.1), F.lit(0.15)), "12.3 % (10.0–15.0)"),
        (text.percent_interval(F.lit(None).cast("double"), F.lit(0.1), F.lit(0.15)), "–"), (text.nfc(F.lit("ü")), "ü"), (text.transcript_line(F.lit(" a&amp;b  c ")), "a&b c"),
        (text.number_words(F.lit("Um 12 Uhr 1x 2024 99999"), F.lit("de")), "Um zwölf Uhr 1x zweitausendvierundzwanzig 99999"),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]


def test_spelled_numbers():
    want = {
        "de": {0: "null", 1: "eins", 21: "einundzwanzig", 100: "einhundert", 101: "einhunderteins", 999: "neunhundertneunundneunzig", 1000: "eintausend", 7300: "siebentausenddreihundert"},
        "en": {13: "thirteen", 42: "forty-two", 105: "one hundred and five", 2019: "two thousand and nineteen", 1100: "one thousand, one hundred"},
        "pt": {16: "dezesseis", 35: "trinta e cinco", 100: "cem", 101: "cento e um", 200: "duzentos", 1000: "mil", 1999: "mil novecentos e noventa e nove", 2100: "dois mil e cem"},
    }
    for lang, words in want.items():
        assert {n: text.spell(n, lang) for n in words} == words
        assert len({text.spell(n, lang) for n in range(10_000)}) == 10_000


def test_case_is_restored():
    table = {"hund": "Hund", "übersetzer": "Übersetzer", "online": "online"}
    assert text.restore_case("der hund bellt. ein online-übersetzer, ja", table) == "Der Hund bellt. Ein Online-Übersetzer, ja"
    assert text.restore_case("Der hund", table) == "Der hund" and text.restore_case("12", table) == "12"


def test_tokenizer(spark):
    pub = pytest.importorskip("public_tokenizers")
    got = spark.createDataFrame([("Hello world",), (None,), ("",)], "t string").select(text.subword_tokens(F.col("t"), pub.path("byte_bpe_50k.json")).alias("x")).collect()
    assert got[0][0] == [15496, 995] and got[1][0] is None and got[2][0] == []


def test_arrays(spark):
    a = F.array(*map(F.lit, [3.0, -1.0, 0.5]))
    i = F.array(*map(F.lit, [1, 0, 2, 0, 3]))
    empty = F.array().cast("array<int>")
    cases = [
        (arrays.cosine(a, a), 1.0), (arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), None), (arrays.left_pad(i, F.lit(7), F.lit(9)), [9, 9, 1, 0, 2, 0, 3]),
        (arrays.fit_length(i, 3, F.lit(0)), [1, 0, 2]), (arrays.fit_length(i, 6, F.lit(7)), [1, 0, 2, 0, 3, 7]), (arrays.chunks(i, 2), [[1, 0], [2, 0], [3]]), (arrays.chunks(empty, 2), []),
        (arrays.block_runs(i, F.lit(0)), [1, 1]), (arrays.block_runs(empty, F.lit(0)), []), (arrays.block_number(i, F.lit(0)), [0, 0, 1, 1, 2]),
        (arrays.segment_mask(F.array(F.lit(2), F.lit(1)), F.array(F.lit(True), F.lit(False))), [True, True, False]),
        (arrays.positions_of_mask(F.array(F.lit(False), F.lit(True), F.lit(True))), [1, 0, 1]), (arrays.transpose(F.array(i, i)), [[x, x] for x in (1, 0, 2, 0, 3)]), (arrays.drop_last(i), [1, 0, 2, 0]),
        (arrays.nucleus(F.array(*map(F.lit, [0.1, 0.6, 0.3])), 0.6, 3), [1, 2]), (arrays.nucleus(F.array(*map(F.lit, [0.1, 0.6, 0.3])), 0.5, 3), [1]), (arrays.nucleus(F.array(*map(F.lit, [0.5, 0.5])), 1.0, 1), [0]),
        (arrays.penalize(a, F.array(F.lit(0), F.lit(1), F.lit(99)), 2.0), [1.5, -2.0, 0.5]), (arrays.guide(a, F.array(F.lit(4.0), F.lit(-1.0), F.lit(0.0)), 2.0), [5.0, -1.0, -0.5]),
        (arrays.mask_range(a, 1, 1), [3.0, -math.inf, 0.5]), (arrays.peak_normalize(F.array(F.lit(0.1), F.lit(-0.05))), [0.95, -0.475]), (arrays.peak_normalize(F.array(F.lit(0.5))), [0.5]),
        (arrays.ceil_to(F.lit(33), 32), 64), (arrays.learning_rate(F.lit(5), 10, 110), 0.5), (arrays.learning_rate(F.lit(110), 10, 110), 0.0), (arrays.same_sequence(i, i), True),
        (arrays.lookup(F.create_map(F.lit("a"), F.lit(1)), F.lit("b"), F.lit(0)), 0), (arrays.overlay(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))), {"a": 2}),
    ]
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    for k, (_, want) in enumerate(cases):
        assert got[k] == (pytest.approx(want) if isinstance(want, (float, list)) and want and isinstance(want[0] if isinstance(want, list) else want, float) else want), k
    fl = spark.range(1).select(arrays.first_last_means(a).alias("x"), arrays.first_last_means(F.array(F.lit(2.0))).alias("y"), arrays.quiet_and_loud(a).alias("z")).first()
    assert tuple(fl["x"]) == (1.0, -0.25) and tuple(fl["y"]) == (2.0, 2.0) and tuple(fl["z"]) == (-1.0, 3.0)
    m = spark.range(1).select(arrays.mix_at_snr(F.array(F.lit(1.0), F.lit(-1.0)), F.array(F.lit(2.0), F.lit(2.0)), 0.0).alias("x")).first()["x"]
    assert m == pytest.approx([2.0, 0.0])
    with pytest.raises(Exception, match="nothing is left"):
        spark.range(1).select(arrays.drop_last(F.array(F.lit(1)))).collect()


def test_rounded_keeps_the_sign_of_zero(spark):
    cases = [(-1e-9, "-0.0"), (-0.0, "-0.0"), (0.0, "0.0"), (1e-9, "0.0"), (-5e-7, "-1e-06"), (2.5e-6, "3e-06"), (1.25, "1.25"), (1e305, "1e+305"), (float("-inf"), "-inf"), (float("nan"), "nan"), (None, "None")]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x double").select("i", arrays.rounded(F.col("x"), 6)).collect()
    assert [repr(r[1]) for r in sorted(rows)] == [w for _, w in cases]
