import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import likelihood as J


def test_masks(spark):
    """An N has rate 1 and even chances; a mask of 0 does the same to a base, but it doesn't turn into itself."""
    sites = spark.createDataFrame([(0, 3, 1, 1), (1, 3, 4, 0), (2, 3, 2, 0)], "site int, kmer int, base int, mask int")
    model = spark.createDataFrame([(3, 0.7, [1.0, 2.0, 3.0, 4.0])], "kmer int, log_rate double, logits array<double>")
    for frame in (sites, sites.where("site < 2").drop("mask")):
        got = {r.site: r for r in J.fivemer_rates(frame, model, bias=0.1).collect()}
        e = np.exp([1.0, 3.0, 4.0])
        assert got[0].rate == pytest.approx(np.exp(0.8)) and got[0].csp == pytest.approx([e[0] / e.sum(), 0, e[1] / e.sum(), e[2] / e.sum()])
        assert got[1].rate == 1.0 and got[1].csp == [0.25] * 4
    got = {r.site: r for r in J.fivemer_rates(sites, model).collect()}
    assert got[2].rate == 1.0 and got[2].csp == pytest.approx([1 / 3, 1 / 3, 0, 1 / 3])


def test_cnn_on_rows_is_the_network_itself(spark):
    draw = np.random.default_rng(3)
    shapes = {"kmer_embedding.weight": (65, 4), "conv.weight": (6, 4, 5), "conv.bias": (6,), "linear.bias": None, "linear.weight": None}
    weights = {}
    for head, n in (("r_", 1), ("s_", 4)):
        for name, shape in shapes.items():
            shape = shape or ((n, 6) if name.endswith("weight") else (n,))
            weights[head + name] = draw.normal(size=shape)
    table = spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in weights.items()], "name string, shape array<int>, values array<double>")
    loaded = J.model_weights(table)
    assert all(np.array_equal(loaded[k], v) for k, v in weights.items())
    texts = spark.createDataFrame([("a", "ACGTNACG"), ("b", "GG"), ("c", "")], "id string, s string")
    rows = texts.select("id", J.encoded(F.col("s"), 3).alias("kmers"), F.when(F.length("s") > 0, J.base_codes(F.col("s"))).alias("bases"))
    got = {(r.id, r.site): r for r in J.cnn_sites(rows, loaded).collect()}
    assert len(got) == 10
    for r in rows.where("id <> 'c'").collect():
        rates, logits = (J.cnn_rates(np.array(r.kmers), weights, head) for head in ("r_", "s_"))
        for i, base in enumerate(r.bases):
            x = np.where(np.arange(4) == base, -1e9, logits[i]) if base < 4 else np.zeros(4)
            e = np.exp(x - x.max())
            assert got[r.id, i].rate == pytest.approx(np.exp(rates[i, 0]) if base < 4 else 1.0)
            assert got[r.id, i].csp == pytest.approx((e / e.sum()).tolist())
