import numpy as np
import pytest

from riskloom.llm import quality_rules


@pytest.mark.parametrize("digits", [1, 3, 9])
def test_threshold_of_all_labelled_rows(spark, digits):
    """The cut over a table is that of plain numpy on all its labelled rows that pass the base rules."""
    rng = np.random.default_rng(digits)
    n = 500
    good = rng.random(n) < 0.9
    score = np.round(np.clip(rng.normal(np.where(good, 0.45, 0.6), 0.05), 0, 1), digits)
    failed = rng.random(n) < 0.2
    rows = spark.createDataFrame([(i, float(s), bool(f)) for i, (s, f) in enumerate(zip(score, failed))] + [(n, 0.99, False)], "doc_id long, score double, base_failed boolean").repartition(3)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)] + [(n, None), (None, 0)], "doc_id long, quality int")
    for loss in (0.01, 0.2):
        m = int(np.ceil(loss * good[~failed].sum()))
        cut = quality_rules.labelled_threshold(rows, labels, "quality", loss)
        want = quality_rules.threshold(score[~failed], good[~failed], m)
        assert ((score > cut) == (score > want)).all()
    assert quality_rules.labelled_threshold(rows, labels.where("quality = 1"), "quality", 0.1) == 2.0
