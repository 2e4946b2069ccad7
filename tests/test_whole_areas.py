"""The samplers' queries cover all areas, with the operators' own steps and pools."""

from collections import Counter

from blockweave.operators import chains
from blockweave.plans import demo
from blockweave.plans.catalog_models import QUERIES


def test_mcmc_reduced_covers_every_area(spark, tmp_path, monkeypatch):
    lines = [(o, "R" if i < back else "N") for o, (n, back) in enumerate([(1, 0), (1, 1), (3, 0), (4, 1), (5, 5), (6, 2)]) for i in range(n)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []
    run = chains.sample_chains
    monkeypatch.setattr(chains, "sample_chains", lambda *a, **kw: asked.append(kw) or run(*a, **kw))
    out = QUERIES["mcmc_reduced"](spark, str(tmp_path)).collect()
    assert Counter(r.block for r in out) == Counter(range(6)) and all(r.exact for r in out)
    assert not {"steps", "k"} & set(asked[0])


def test_household_pipeline_takes_the_defaults(spark, sf, monkeypatch):
    asked = []

    def generate(blocks, households, **kw):
        asked.append(kw)
        return blocks, spark.range(0)

    monkeypatch.setattr(demo, "generate", generate)
    demo.demo_microdata(spark, spark.read.parquet(f"{sf}/customer.parquet"))
    assert asked == [{}]
