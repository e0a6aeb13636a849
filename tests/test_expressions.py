import pytest
from pyspark.sql import functions as F

from quillon.functions.expressions import QueryError, compile_query, complexity, conjuncts, query_columns, suggestions
from quillon.operators.derive import MUON_COLUMNS, RECOIL_COLUMNS
from quillon.table import LazyTable

FIVE = [(5.279, 2.1, 10), (5.280, 2.5, 20), (5.278, 1.8, 30), (5.281, 3.0, 40), (5.279, 2.2, 50)]
# The muon selection that must compile unchanged.
MUON_SELECTION = (
    "mu1nCDCHits>4&mu2nCDCHits>4&0.8>mu1clusterEoP&0.8>mu2clusterEoP&2.6179938779914944>pRecoilTheta>0.29670597283903605&11>totalMuonMomentum&"
    "absdPhi>1.5707963267948966&2.03>mu1Theta>0.61&2.03>mu2Theta>0.61&(absdPhiMu1>0.4014257279586958|absdThetaMu1>0.4014257279586958)&"
    "(absdPhiMu2>0.4014257279586958|absdThetaMu2>0.4014257279586958)&0.35>mu1clusterE&0.35>mu2clusterE&3>abs(m2Recoil)&min_deltaMuPRecoil>-0.01"
)


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, "M_bc double, pRecoil double, value bigint")


@pytest.mark.parametrize("text, rows", [("pRecoil > 2.0", 4), ("value >= 30", 3), ("M_bc > 5.278 and pRecoil < 3.0", 3), ("value == 20 or value == 40", 2), ("~(value > 20) & pRecoil>2", 2), ("value % 20 == 10 and value not in [10]", 2), ("45>value>15", 3)])
def test_rows(five, text, rows):
    assert five.where(compile_query(text, five.columns)).count() == rows


def test_muon_selection_compiles_and_derives(spark):
    from quillon.sources.synthetic import generate

    events = generate(spark, "mumu", 2000)
    assert {*MUON_COLUMNS, *RECOIL_COLUMNS} <= set(events.columns)
    kept = LazyTable(events).query(MUON_SELECTION)
    assert 0 < kept.count() < 2000
    assert complexity(MUON_SELECTION)["level"] == "medium"
    assert len(conjuncts(MUON_SELECTION)) == 15


@pytest.mark.parametrize("text", ["a >", "__import__('os')", "a.b.c > 1", "a if b else c", "lambda: 1", "a[0] > 1", "x := 3", "'unclosed", "@"])
def test_what_is_refused(text):
    with pytest.raises((QueryError, KeyError)):
        compile_query(text)


def test_names(five):
    with pytest.raises(KeyError):
        compile_query("nothing > 1", five.columns)
    with pytest.raises(QueryError):
        compile_query("value > @x", five.columns)
    assert query_columns("a > 1 & abs(b - a) < pi") == ["a", "b"]
    assert suggestions("abs(a) > 1 & b > 2")


def test_literals_are_not_rewritten(spark):
    df = spark.createDataFrame([("a&b",), ("a and b",)], "s string")
    assert df.where(compile_query("s == 'a&b'", df.columns)).count() == 1


def test_constants_yield_to_columns(spark):
    df = spark.createDataFrame([(1.0, 9.0)], "x double, e double")
    assert df.where(compile_query("e > 8 & x < pi", df.columns)).count() == 1


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(F.coalesce(compile_query("a / b"), F.lit(-1.0))).collect()] == [-1.0, 2.0]
