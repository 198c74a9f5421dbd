from lodeweave.functions import symbols as S
from lodeweave.functions import vectors as X
from lodeweave.functions import vocab as V
from lodeweave.operators import retrieval as R
from pyspark.sql import functions as F


def test_query_text():
    assert R.query_tokens("Who reads regGCVM_L2_CNTL and the ring buffer?") == ["reggcvm_l2_cntl", "ring", "buffer"]
    assert R.query_prefixes("reg CP_HQD_* or regSDMA* or a*") == ["cp_hqd_", "regsdma", "sdma"]
    assert R.query_intents("who writes or is reading") == ["read", "write"]


def test_phrase_needs_neighbours_in_order(spark):
    df = spark.createDataFrame([(1, "x GCVM_L2_CNTL y"), (2, "regGCVM_L2_CNTL"), (3, "cntl l2 gcvm"), (4, None), (5, "gcvm l2 cntl")], "id bigint, text string")
    assert {r.id for r in R.phrase_match(df, ["gcvm_l2_cntl"]).collect()} == {1, 5}
    assert R.phrase_match(df, []).count() == 0


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(X.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_scalars(spark):
    df = spark.createDataFrame([("WREG32(mmA_CNTL, 1)\nx", "mmA_CNTL"), ("l1\nl2\nl3\nl4 foo_x\nl5\nl6\nl7", "foo_x")], "text string, symbol string")
    got = df.select(S.access_type(F.col("text"), F.col("symbol")).alias("a"), S.snippet(F.col("text"), F.col("symbol")).alias("s"), S.entity_type(F.col("symbol")).alias("e")).collect()
    assert (got[0].a, got[0].e, got[1].a, got[1].e) == ("write", "register", "mention", "function")
    assert got[1].s == "l2\nl3\nl4 foo_x\nl5\nl6"
    v = spark.createDataFrame([("src/gfx_v11_0.c", "12: ## A b-C\nx")], "p string, t string")
    r = v.select(V.ip_version(F.col("p")).alias("v"), V.section_id(F.col("p"), F.col("t"), F.lit(None).cast("int"), F.lit(3)).alias("s")).first()
    assert (r.v, r.s) == ("11.0", "src/gfx_v11_0.c#a-b-c")


def test_diversity_brings_in_each_source_type(spark):
    rows = [(i, f"s{i}", "p", "code", None, 1, 10.0 - i, 1.0) for i in range(5)] + [(9, "d", "q", "doc", 1, None, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "chunk_id bigint, symbol string, path string, source_type string, page int, line_start int, rank_score double, score double")
    got = R.diversified(df, 3).orderBy("rank").collect()
    assert [r.symbol for r in got] == ["s0", "s1", "d"]


def test_reciprocal_rank(spark):
    res = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 4, "z")], "case_id string, rank int, key string")
    cases = spark.createDataFrame([("a", "y"), ("b", "z"), ("c", "q")], "case_id string, key string")
    assert tuple(R.reciprocal_rank(res, cases).first()) == (2, 0.375)
