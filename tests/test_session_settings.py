from tidewire.operators import model as MO
from tidewire.plans import catalog
from tidewire.plans import queries_models as Q


def test_queries_split_methods_the_jvm_would_interpret(spark):
    """In a session with Spark's defaults wide projections were fused into methods that are never compiled."""
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        catalog.queries()["cic_transform"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)


def test_the_unsplit_table_is_let_go_before_training(spark, monkeypatch):
    kept, plain = [], MO.train

    def train(table, *args):
        kept.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return plain(table, *args)

    monkeypatch.setattr(MO, "train", train)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    MO.fit_and_evaluate(Q.learnable(spark, "/root/testdata/sf0.001"), MO.forest(trees=2, depth=2), row_key=["row_id"])
    assert kept == [before + 1]
