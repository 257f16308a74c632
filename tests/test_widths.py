"""How much of a large input one task takes."""

from cohortry.functions import inputs
from cohortry.operators.options import OPTION, sku_row_counts
from cohortry.plans import Segmentation, segmentation
from cohortry.sources.star import STAR_RULES, star_sources

ROOT = "/root/testdata/sf0.001"


def test_merged_partitions_stay_small_unless_the_session_says_otherwise(spark):
    settings = (inputs.INITIAL_PARTITIONS, "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name in settings:
            spark.conf.unset(name)
        with inputs.fitted_shuffles(spark, [spark.range(3)]):
            assert spark.conf.get(settings[1]) == "8m"
        assert spark.conf.get(settings[1], None) is None
        inputs.fit_shuffles(spark, 6_000_000_000)
        assert int(spark.conf.get(settings[0])) > 350
        spark.conf.set(settings[1], "20m")
        inputs.fit_shuffles(spark, 6_000_000_000)
        assert spark.conf.get(settings[1]) == "20m"
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_rows_by_option_are_shuffled_once(spark, monkeypatch):
    """The catalogue of options is joined as it was grouped, and the counts of SKUs lie by option."""
    job = Segmentation(star_sources(spark, ROOT), STAR_RULES)
    monkeypatch.setitem(job.__dict__, "excluded", None)
    names = []
    real = segmentation.stage
    monkeypatch.setattr(segmentation, "stage", lambda df, name: names.append(name) or real(df, name))
    assert job.purchases.count() > 0
    assert "options" not in names
    by_option = job.sku_counts.groupBy(*OPTION).count()
    assert "Exchange" not in by_option._jdf.queryExecution().executedPlan().toString()
    want = sku_row_counts(job.sources.items, job.sources.skus)
    assert job.sku_counts.exceptAll(want).count() == 0 == want.exceptAll(job.sku_counts).count()
