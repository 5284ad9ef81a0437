import hashlib
import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from citeweave.functions import hashing, metrics
from citeweave.functions import text as T
from citeweave.plans import sql as S

SAMPLES = ["", "  ", "...!?", "Battery-Thermal Management, NASA!", "Don't re-use X-57's 3.5 kW", "Größe über ÉTÉ", "a\tb\nc",
    "\u00a0a\u00a0b c\u3000d\u2009", "ﬁre ΟΔΟΣ Straße İstanbul ŉ", "\x1cx\x85y\x0bz\n", "中文\u3000文本 Ωmega ǅ",
]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_lexical_tokens_match_the_plain_pattern(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    got = {r.i: r.t for r in rows.select("i", T.lexical_tokens(F.col("s")).alias("t")).collect()}
    for i, sample in enumerate(SAMPLES):
        assert got[i] == re.findall(T.LEXICAL_TOKEN, sample.lower())


def test_words_match_split(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    for r in rows.select("s", T.words(F.col("s")).alias("w")).collect():
        assert r.w == r.s.split()


def test_distinct_stems_match_all_stems(spark):
    texts = [*SAMPLES, "Cells cooling cooled CELL cell batteries battery flies fly flying 12 12", "\u00a0caf\u00e9 \u2009x"]
    rows = spark.createDataFrame([(s,) for s in texts], "s string")
    for r in rows.select(T.distinct_stems(F.col("s")).alias("got"), T.stemmed_tokens(F.col("s")).alias("all")).collect():
        assert r.got == list(dict.fromkeys(r["all"]))


def test_blanks_and_case_follow_the_standard_library(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    s = F.col("s")
    for r in rows.select("s", T.strip(s).alias("strip"), T.collapse(s).alias("collapse"), T.fold_case(s).alias("fold")).collect():
        assert (r.strip, r.collapse, r.fold) == (r.s.strip(), " ".join(r.s.split()), r.s.casefold())
    sql = f"SELECT {S.strip('s')}, {S.collapse('s')}, {S.fold('s')}, {S.words('s')} FROM (SELECT ? AS s)"
    for text in SAMPLES:
        assert duckdb.execute(sql, [text]).fetchone() == (text.strip(), " ".join(text.split()), text.casefold(), text.split())


def test_fingerprint_is_that_of_the_canonical_json(spark):
    schema = "claim string, cited array<struct<z: string, a: bigint>>, note string"
    values = [("a \"q\"\nß/", [("x", 1), (None, 2)], None), ("a", [], "b"), (None, None, "b"), ("b", None, None)]
    rows = spark.createDataFrame(values, schema)
    keyed = rows.select(F.struct(*rows.columns).alias("t"))
    got = [r.x for r in keyed.select(hashing.fingerprint(F.col("t"), rows.schema).alias("x")).collect()]
    want = [
        {"claim": c, "cited": v if v is None else [{"z": z, "a": a} for z, a in v], "note": n} for c, v, n in values
    ]
    assert got == [hashlib.sha256(json.dumps(w, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for w in want]


@pytest.mark.parametrize(
    "token, expected",
    [
        ("batteries", "battery"), ("running", "runn"), ("tested", "test"), ("cells", "cell"), ("class", "class"),
        ("bed", "bed"), ("2024", "2024"), ("studies", "study"), ("storing", "storage"), ("gas", "gas"),
    ],
)
def test_stem(spark, token, expected):
    assert one(spark, T.stem(F.col("t")), t=token) == expected


def test_query_term_kinds(spark):
    q = "What is the exact X-57 NASA mandated rule for every 3 eVTOL batteries permanently in 2024?"
    assert one(spark, T.numeric_terms(F.col("q")), q=q) == ["57", "3", "2024"]
    assert one(spark, T.named_anchors(F.col("q")), q=q) == ["57", "nasa", "evtol"]
    assert one(spark, T.claim_qualifiers(F.col("q")), q=q) == ["mandate", "every"]
    assert one(spark, T.scope_qualifiers(F.col("q")), q=q) == ["every_3_evtol", "permanently_2024"]


def test_normalizers(spark):
    page = "\x00a  b \r\n\r\n\r\n\tc\r d \n\n"
    assert one(spark, T.normalize_page_text(F.col("p")), p=page) == "a b\n\nc\nd"
    assert one(spark, T.normalize_title(F.col("p")), p="<b>Tom &amp; &eacute;l&nbsp;  X</b>") == "tom & él x"
    assert one(spark, T.normalize_title(F.col("p")), p="plain") == "plain"
    assert one(spark, T.normalize_semantic_text(F.col("p")), p=" A--b, C! ") == "a b c"


def test_extract_statement(spark):
    cut = lambda s, n: one(spark, T.extract_statement(F.col("s"), n), s=s)
    assert cut("short  text", 50) == "short text"
    assert cut("One. Two three four five", 12) == "One."
    assert cut("alpha beta gamma", 11) == "alpha beta…"
    assert cut("abcdefghij", 4) == "abcd…"


def test_hashes_and_rates(spark):
    import hashlib

    digest = hashlib.sha256(b"7:k").digest()
    assert one(spark, hashing.stable_fraction(7, F.col("k")), k="k") == int.from_bytes(digest[:8], "big") / 2.0**64
    assert one(spark, metrics.success_rate(F.lit(0), F.lit(0))) == 1.0
    assert one(spark, metrics.coverage_ratio(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, metrics.null_strict_sum(F.array(F.lit(1.0), F.lit(None).cast("double")))) is None
    assert sum(one(spark, metrics.softmax(F.array(F.lit(3.0), F.lit(-2.0))))) == pytest.approx(1.0)
    assert one(spark, metrics.signed_points(F.lit(13.158))) == "+13.16 pp"
    assert one(spark, T.strip_code_fence(F.col("s")), s='```json\n{"a": 1}\n```') == '{"a": 1}'


def test_latin_letters_and_blanks_fold_and_split_as_in_the_standard_library(spark):
    letters = [chr(i) for i in range(1, 0x180)] + ["Straße µ", "ǅ İ ﬁ", "\x1cA\x1fB\x85C　d", "", "  "]
    got = spark.createDataFrame([(t, f"x{t}y") for t in letters], "t string, u string").select(
        "t", T.fold_case(F.col("t")).alias("f"), T.words(F.col("t")).alias("w"), T.words(F.col("u")).alias("v")
    ).collect()
    for row in got:
        assert (row.f, row.w, row.v) == (row.t.casefold(), row.t.split(), f"x{row.t}y".split()), repr(row.t)
    assert not any(chr(i).isspace() or chr(i).casefold() != chr(i) for i in range(0x20000, 0x110000))
