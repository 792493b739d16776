"""Column functions on literal edge cases, against plain Python where it defines the result."""

import base64
import math
import random

import pytest
from pyspark.sql import functions as F

from evalmill.functions import answers, binary, numbers, text
from evalmill.session import session_conf


def values(spark, rows, column, schema="v string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    found = {r.i: r.x for r in df.select("i", column(F.col("v")).alias("x")).collect()}
    return [found[i] for i in range(len(rows))]


def channels(spark, raws):
    return [
        None if r is None else tuple(r)
        for r in values(spark, raws, answers.parse_channels)
    ]


def test_strip_removes_every_whitespace_python_does(spark):
    rows = [" a ", "\t\na ", " a b　", "\x1ca\x1f", "", "  ", "​a"]
    assert values(spark, rows, text.strip_text) == [r.strip() for r in rows]


def test_tagged_channels_shapes(spark):
    c, m = "<|channel|>", "<|message|>"
    raws = [
        f"{c}analysis{m}think<|end|><|start|>assistant{c}final{m}Answer: A<|return|>",
        f"{c}FINAL{m}\n B \n<|end|>",
        f"{c}analysis{m}cut off",
        f"{c}final{m}A<|end|>{c}final{m}B<|return|>",
        f"{c}analysis{m}x{c}final{m}B<|return|>",
        f"{c}final{m}A<|end|>{c}final{m}not closed",
        f"{c}commentary{m}<|end|>tail",
        f"{c}fin al{m}x<|end|>{c}final{m}ok<|end|>",
        f"<|end|>{c}final{m}ok<|end|>",
        f"{c}final<|end|>{m}no<|return|>",
        f"{c}{m}no name<|end|>",
        f"{c}gedanke_ä{m}x<|end|>{c}final{m}a<|b|>c<|end|>",
        "",
        "   \n",
        "plain text ",
    ]
    assert channels(spark, raws) == [
        ("Answer: A", "think", None),
        ("B", None, None),
        (raws[2], None, None),
        ("B", None, None),
        (raws[4], f"x{c}final{m}B", None),
        ("A", None, None),
        (raws[6], None, ""),
        ("ok", None, None),
        ("ok", None, None),
        (raws[9], None, None),
        (raws[10], None, None),
        ("a<|b|>c", None, None),
        ("", None, None),
        ("", None, None),
        ("plain text", None, None),
    ]


def test_tagged_channels_follow_the_pattern_on_random_texts(spark):
    import re

    pattern = re.compile(r"<\|channel\|>(\w+)<\|message\|>(.*?)(?:<\|end\|>|<\|return\|>)", re.S)
    pieces = [
        "<|channel|>", "<|message|>", "<|end|>", "<|return|>", "<|start|>", "final", "FINAL",
        "analysis", "commentary", "other", " ", "\n", "x", "<", "|>", "é",
    ]
    rng = random.Random(7)
    raws = ["".join(rng.choices(pieces, k=rng.randint(1, 24))) for _ in range(3000)]
    for _ in range(1500):
        raws.append("".join(
            f"<|channel|>{rng.choice(pieces[5:10])}<|message|>{rng.choice(pieces)}"
            f"{rng.choice(pieces[2:5])}" for _ in range(rng.randint(1, 5))
        ))

    def expected(raw):
        last = {name.lower(): content.strip() for name, content in pattern.findall(raw)}
        return last.get("final", raw.strip()), last.get("analysis"), last.get("commentary")

    assert channels(spark, raws) == [expected(r) for r in raws]


def test_long_outputs_do_not_overflow_the_regex_stack(spark):
    body = "<b>" * 200_000
    raw = f"<|channel|>final<|message|>{body}<|end|>"
    assert channels(spark, [raw]) == [(body, None, None)]


def test_choice_letter(spark):
    rows = ["Answer: Apple", "Because", "ANSWER: B", "answer: E answer: B", "b", "", None,
            "The answer :\n C", "Answer: d", "D) yes", " A"]
    assert values(spark, rows, answers.choice_letter) == [
        "A", "B", "A", "B", "?", "?", "?", "C", "A", "D", "?"
    ]


def test_gold_letter(spark):
    df = spark.createDataFrame(
        [(0, None), (3, None), (4, None), (-1, None), (None, " b\t"), (None, None), (1, "c")],
        "idx int, txt string",
    )
    rows = df.select(
        answers.gold_letter(F.col("idx"), F.col("txt")).alias("gold"),
        answers.gold_error(F.col("idx")).alias("error"),
    ).collect()
    assert [r.gold for r in rows] == ["A", "D", None, None, "B", None, "B"]
    assert [r.error is None for r in rows] == [True, True, False, False, True, True, True]
    with pytest.raises(ValueError):
        answers.gold_letter()


def test_round_exact_is_pythons_round(spark):
    rng = random.Random(3)
    rows = [0.0, 0.03125, 0.12345, 2.675, 1.005, 0.5, 1e-5, -0.00005, -2.675, 123456.785, 0.00005]
    rows += [rng.randint(0, n) / n for n in (7, 32, 64, 1000, 20000, 99999) for _ in range(200)]
    rows += [k / 10**5 + 5e-5 for k in range(0, 2000)]
    rows += [rng.uniform(-5000, 5000) for _ in range(500)]
    for digits in (1, 2, 3, 4):
        found = values(spark, rows, lambda c, d=digits: numbers.round_exact(c, d), "v double")
        assert found == [round(r, digits) for r in rows]


def test_unit_conversions(spark):
    sizes = [0, 1, 8_804_682_956, 515_396_075, 2**40 + 12345]
    assert values(spark, sizes, numbers.gibibytes, "v bigint") == [
        round(s / 1024 / 1024 / 1024, 3) for s in sizes
    ]
    seconds = [882.0, 0.3, 90.0, 899.7]
    assert values(spark, seconds, numbers.minutes, "v double") == [
        round(s / 60, 2) for s in seconds
    ]


def test_number_texts(spark):
    rows = ["12", " 7 ", "1_000", "1__0", "+3", "-3", "1.0", "1e5", "", "x", "9" * 25]
    assert values(spark, rows, numbers.parse_integer) == [
        12, 7, 1000, None, 3, -3, None, None, None, None, None
    ]
    rows = ["1.5", ".5", "1.", "1e5", "-2", "1_0.5", "nan", "-inf", "1.2.3", "x", ""]
    found = values(spark, rows, numbers.parse_float)
    assert math.isnan(found.pop(6))
    assert found == [1.5, 0.5, 1.0, 1e5, -2.0, 10.5, -math.inf, None, None, None]


def test_utc_iso_does_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            row = spark.sql(
                "SELECT TIMESTAMP '2024-03-10T12:34:56Z' AS z, "
                "TIMESTAMP_NTZ '2024-03-10 12:34:56' AS n"
            ).select(numbers.utc_iso(F.col("z")), numbers.utc_iso(F.col("n"), zoned=False)).first()
            assert tuple(row) == ("2024-03-10T12:34:56Z", "2024-03-10T12:34:56Z")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_snippets(spark):
    rows = ["", "abc", "äöü" * 3, None]
    assert values(spark, rows, lambda c: text.first_chars(c, 3)) == ["", "abc", "äöü", None]
    assert values(spark, rows, lambda c: text.first_chars(c, 3, "...")) == [
        "", "abc", "äöü...", None
    ]
    assert values(spark, rows, lambda c: text.last_chars(c, 2)) == ["", "bc", "öü", None]
    assert values(spark, rows, text.blank_to_null) == [None, "abc", "äöüäöüäöü", None]


def test_levels(spark):
    rows = ["LOW", "Medium", "high", "max", "", None]
    assert values(spark, rows, text.is_level) == [True, True, True, False, False, False]
    assert values(spark, rows, text.normalise_level)[:2] == ["low", "medium"]


def decoded(value):
    try:
        return base64.b64decode(value.encode(), validate=False)
    except ValueError:
        return None


def test_decode_base64_as_python_does(spark):
    rows = ["QUJD", "QUI=", "QQ==", "QUI", "QQ", "Q", "", "QU\nJD", "Q!U?J D", "QUJD====",
            "QQ=", "QQ==QUJD", "QUI=QUJD", "äQUJD", "QUJDR"]
    found = [None if v is None else bytes(v) for v in values(spark, rows, binary.decode_base64)]
    assert found == [decoded(r) for r in rows]


def test_encode_then_decode(spark):
    rows = [bytes(range(256)) * k for k in range(4)]
    texts = values(spark, rows, binary.encode_base64, "v binary")
    assert texts == [base64.b64encode(r).decode() for r in rows]
    assert [bytes(v) for v in values(spark, texts, binary.decode_base64)] == rows


def test_image_parameters(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"data"
    good = base64.b64encode(png).decode()
    rows = [good, f"  {good}\n", f"data:image/png;base64,{good}", good.rstrip("="),
            "data:image/png;base64", "", None, "/some/file.png", good + "é", good[:-3] + "!" + good[-3:]]
    found = values(spark, rows, binary.image_bytes)
    assert [bytes(f) == png if f is not None else None for f in found[:4]] == [True] * 4
    assert found[4] is None
    formats = values(spark, rows, lambda c: binary.image_format(binary.image_bytes(c)))
    assert formats == ["png"] * 4 + [None] * 5 + ["png"]
    assert values(
        spark,
        [b"\xff\xd8\xff\xe0", b"GIF89a..", b"RIFF0000WEBP", b"BM12", b"RIFF", b""],
        binary.image_format,
        "v binary",
    ) == ["jpeg", "gif", "webp", "bmp", None, None]


def test_utc_iso_around_clock_changes(spark):
    instants = ["2024-03-10T02:30:00Z", "2024-03-10T07:00:00Z", "2024-11-03T05:30:00Z", "2024-11-03T06:30:00Z", "1969-12-31T23:59:59Z"]
    with session_conf(spark, spark__sql__session__timeZone="America/New_York"):
        df = spark.createDataFrame([(i,) for i in instants], "t string").select("t", F.col("t").cast("timestamp").alias("ts"))
        assert all(r.t == r.iso for r in df.select("t", numbers.utc_iso(F.col("ts")).alias("iso")).collect())


@pytest.mark.parametrize(
    "text", ["QUJD=REVG", "QQ=Q", "Q=Q=Q=Q=", "=QUJD", "QUJ=D", "QUJDRA==", "QUJDRA=", "QQ=", "QQ==QQ==", "Q===",
             "QUI=QUI=", "Q=UI=", "=QQ==", "QU=I", "QU=I=", "QUI=D", "", "=", "QU JD\n"]
)
def test_inner_padding_is_read_as_python_does(spark, text):
    try:
        want = base64.b64decode(text)
    except ValueError:
        want = None
    got = spark.createDataFrame([(text,)], "t string").select(binary.decode_base64(F.col("t")).alias("b")).first().b
    assert (None if got is None else bytes(got)) == want


def test_more_image_formats(spark):
    heads = {"tiff": b"II*\0", "ico": b"\0\0\1\0", "jpeg2000": b"\0\0\0\x0cjP  ", "avif": b"\0\0\0 ftypavif", "psd": b"8BPS"}
    df = spark.createDataFrame([(k, v + b"0" * 20) for k, v in heads.items()], "k string, b binary")
    assert all(r.k == r.f for r in df.select("k", binary.image_format(F.col("b")).alias("f")).collect())
