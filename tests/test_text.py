import pytest
from pyspark.sql import functions as F

from lynceus.functions import text as T
from lynceus.functions import validators as V
from lynceus.plans import queries as Q


def run(spark, f, values):
    df = spark.createDataFrame([(values,)], "v array<string>")
    return df.select(f(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (T.clean_names, ["Jo-an D'Arc#3rd", "Jo an DArc 3rd"], ["jo an darc 3rd"]),
        (T.clean_names, ["A--B"], ["a  b"]),
        (T.clean_names, ["Ünal Æther", "Светлана"], ["unal aether", "svetlana"]),
        (T.clean_names_light, ["Светлана-2"], ["светлана 2"]),
        (T.clean_literal_names, ["a-b c", "ab c"], ["ab c"]),
        (T.clean_address_parts, ["1, rue X"], ["1  rue x"]),
        (T.tokenize_clean_names, ["a Bc  d-e"], ["bc", "de"]),
        (T.normalize_identifiers, ["fr 12-3(x)", "1"], ["FR123X"]),
        (T.name_parts, ["DOE, Jane"], [["doe", "", "jane"]]),
        (T.name_parts_flat, ["DOE, J Jane", "jane"], ["doe", "jane"]),
        (T.index_name_keys, ["Jane Doe", "Li"], ["doejane"]),
        (T.index_name_parts, ["Jane Q Doe"], ["jane", "doe"]),
        (T.extract_numbers, ["a12b3", "12"], ["12", "3"]),
        (T.tokenize_names, ["ab.c,d'e"], [["abc", "de"]]),
        (T.clean_names, None, []),
        (T.clean_names, [], []),
    ],
)
def test_arrays(spark, f, given, want):
    assert run(spark, f, given) == want


def test_latinize_scripts(spark):
    words = ["plain", "Straße", "Łódź", "Наталья", "Ελλάδα", "カタカナ", "щ"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(T.latinize(F.col("w")).alias("o")).collect()
    assert [r.o for r in got] == ["plain", "Strasse", "Lodz", "Natal'ya", "Ellada", "katakana", "shch"]


def test_soundex_of_digits_is_empty(spark):
    assert run(spark, T.soundex_codes, ["robert", "12"]) == ["R163", ""]


def test_combined_names(spark):
    df = spark.createDataFrame([({"firstName": ["A", "B"], "lastName": ["C"]}, 1), ({"firstName": ["A"]}, 21), ({}, 0)], "p map<string, array<string>>, n int")
    assert [r.o for r in df.select(T.combine_names(F.col("p"), F.col("n")).alias("o")).collect()] == [["A C", "B C"], [], []]


VALID = [
    (V.isin, ["US0378331005", "GB0002634946"], ["US0378331006", "U10378331005", "", "US037833100"]),
    (V.lei, ["5493001KJTIIGC8Y1R12"], ["5493001KJTIIGC8Y1R13", "5493001KJTIIGC8Y1R1"]),
    (V.bic, ["DEUTDEFF", "deutdeff500"], ["DEUTDEF", "DEUTDEFF5", "1EUTDEFF"]),
    (V.inn, ["7707083893", "500100732259"], ["7707083894", "500100732258", "77070838"]),
    (V.ogrn, ["1027700132195"], ["1027700132196", "102770013219x"]),
    (V.imo_mmsi, ["IMO9074729", "123456789"], ["IMO9074728", "12345678", "9074729"]),
]


@pytest.mark.parametrize(("check", "good", "bad"), VALID)
def test_validators(spark, check, good, bad):
    df = spark.createDataFrame([(x,) for x in good + bad], "x string").select(check(F.col("x")).alias("o"))
    assert [r.o for r in df.collect()] == [True] * len(good) + [False] * len(bad)


def test_lei_codes_are_worked_out_not_tried(spark):
    """The check digits are the first of all hundred that hold; no plan tries them, nor walks a code by a fold."""
    rows = spark.range(0, 300).withColumn("k", F.col("id") * 7919)
    (good, bad), (first, after) = Q._lei(F.col("k")), Q._checked(F.concat(F.lit("AB"), F.lpad(F.col("k").cast("string"), 16, "0")), V.lei, 2)
    got = rows.select(good.alias("good"), bad.alias("bad"), first.alias("first"), after.alias("after"), V.lei(good).alias("yes"), V.lei(bad).alias("no")).collect()
    plain = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97 == 1
    assert all(r.good == r.first and r.bad == r.after and r.yes and plain(r.good) and not r.no for r in got)
    codes = [("ABCDEFGHIJKLMNOPQR" + f"{i:02d}",) for i in range(100)] + [("529900T8BM49AURSDO55",), ("529900t8bm49aursdo55",), ("1" * 20,), ("",), (None,)]
    seen = {r.x: r.ok for r in spark.createDataFrame(codes, "x string").withColumn("ok", V.lei(F.col("x"))).collect()}
    assert all(ok == (bool(x) and len(x) == 20 and x == x.upper() and plain(x)) for x, ok in seen.items())
    made = spark.range(9).select(*Q._CODED["lei_code_match"][2](F.col("id"))).columns
    assert not any("filter(" in c or "aggregate(" in c for c in made)
