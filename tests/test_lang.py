import pytest
from pyspark.sql import functions as F

from sparkjets.functions.lang import Cut, expression, row_query


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(
        [
            (1, 100.0, 8.0, 2.0, 4.0, [1.0, 2.0, 3.0], [[1.0, 2.0], [3.0, 4.0]]),
            (2, 60.0, float("nan"), 1.0, 0.0, [5.0, 9.0], [[5.0, 6.0], [7.0, 8.0]]),
            (3, 20.0, 1.0, 1.0, 1.0, [], []),
        ],
        "id int, pt double, a double, b double, c double, v array<double>, m array<array<double>>",
    )


def ids(df, condition):
    return sorted(row.id for row in df.where(condition).collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("pt>50", [1, 2]),
        ("pt >= 60", [1, 2]),
        ("pt>5_0", [1, 2]),
        ("50<pt", [1, 2]),
        ("(pt>50) && (pt<90)", [2]),
        ("(pt>90) || (pt<30)", [1, 3]),
        ("((pt>90) || (pt<30)) && (b==1)", [3]),
        ("a>0", [1, 3]),  # NaN passes no cut
        ("a==a", [1, 3]),
        ("a<100", [1, 3]),
        ("v>0", [1, 2, 3]),  # every element; an empty array has no counterexample
        ("v>2", [2, 3]),
        ("pt!=60", [1, 3]),
    ],
)
def test_cut(df, text, expected):
    assert ids(df, Cut(text).column(df)) == expected


def test_cut_combination(df):
    both, either = Cut("pt>50") & Cut("pt<90"), Cut("pt>90") | Cut("pt<30")
    assert ids(df, both.column(df)) == [2]
    assert ids(df, either.column(df)) == [1, 3]
    assert ids(df, (both | either).column(df)) == [1, 2, 3]
    assert str(both) == "(pt>50) && (pt<90)"


@pytest.mark.parametrize("text", ["pt>1 && pt<2 || pt>3", "(pt>1", "pt>1)", "pt", "nothing>1", "__import__('os')"])
def test_bad_cut(df, text):
    with pytest.raises(ValueError):
        Cut(text).column(df)


def test_row_query(df):
    assert ids(df, row_query(df, "pt + b > 60 and not pt == 100")) == [2]
    assert ids(df, row_query(df, "10 < pt < 70 & b == 1")) == [2, 3]


def values(df, text, **options):
    return [row.x for row in df.orderBy("id").select(expression(df, text, **options).alias("x")).collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("pt/10", [10.0, 6.0, 2.0]),
        ("v[0]", [1.0, 5.0, None]),
        ("v[-1]", [3.0, 9.0, None]),
        ("v[0]+v[1]", [3.0, 14.0, None]),
        ("v[1:3]", [[2.0, 3.0], [9.0], []]),
        ("v[0:1]", [1.0, 5.0, None]),
        ("v[1:]", [[2.0, 3.0], [9.0], []]),
        ("v[:-1]", [[1.0, 2.0], [5.0], []]),
        ("m[:,0]", [[1.0, 3.0], [5.0, 7.0], []]),
        ("m[1,0]", [3.0, 7.0, None]),
        ("v*2", [[2.0, 4.0, 6.0], [10.0, 18.0], []]),
        ("2*(pt-10)", [180.0, 100.0, 20.0]),
        ("pt/c", [25.0, None, 20.0]),
    ],
)
def test_expression(df, text, expected):
    assert values(df, text) == expected


@pytest.mark.parametrize(
    "text, standard, legacy",
    [("pt-b-c", 94.0, 102.0), ("pt/b/c", 12.5, 200.0), ("pt-b+c-b", 100.0, 100.0), ("pt*b/c", 50.0, 50.0)],
)
def test_legacy_grouping(df, text, standard, legacy):
    assert values(df, text)[0] == standard
    assert values(df, text, legacy=True)[0] == legacy


def test_expression_errors(df):
    for text in ("nothing+1", "pt[0]", "f(pt)", "v[::2]"):
        with pytest.raises(ValueError):
            expression(df, text)


def test_quoted_names(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`log_PT|PTjet` double, b double")
    assert df.select(expression(df, "`log_PT|PTjet` + b").alias("x")).first().x == 3.0
    assert df.where(row_query(df, "`log_PT|PTjet` < b")).count() == 1
    assert df.select(F.col("b")).count() == 1
