"""Block rates behind url verdicts: every value, all labelled rows outside the own fold, sampling by id."""

import pytest

pytest.importorskip("riskframe.llm")
from riskframe.llm import boosted, url_filter  # noqa: E402
from riskframe.llm.queries import RULES  # noqa: E402

HOSTS = 700


def labelled_pages(spark):
    rows = [(2 * i + j, f"http://w{j}.h{i}.com/{'de' if i % 2 else 'fr'}/{j}") for i in range(HOSTS) for j in range(2)]
    rows += [(10_000 + i, "http://hot.com/de/1") for i in range(HOSTS)]  # one url holds a third of the rows
    return spark.createDataFrame(rows, "page_id long, url string").repartition(4)


class Seen(boosted.Trees):
    def __init__(self, rows, features, label):
        Seen.rows = [(list(r[0]), r[1]) for r in rows.collect()]
        super().__init__(rows, features, label, rounds=2)


@pytest.mark.parametrize("small", [True, False])
def test_every_suffix_has_its_rate_over_the_other_folds(spark, monkeypatch, small):
    monkeypatch.setattr(url_filter, "Trees", Seen)
    monkeypatch.setattr(url_filter, "bounded_sample", lambda df, key: boosted.bounded_sample(df, key, limit=300))
    monkeypatch.setattr(url_filter, "fits_broadcast", lambda *_: small, raising=False)
    got = url_filter.judge_urls(labelled_pages(spark), RULES).collect()
    assert len(got) == 3 * HOSTS
    overall = 2 / 3
    # a host has two urls: at most one of them lies outside the other's fold
    want = {round((c * y + 20 * overall) / (c + 20), 9) for y in (0, 1) for c in (0, 1)}
    cold = {round(features[-2], 9) for features, _ in Seen.rows if features[-2] <= 0.95}
    assert cold == want
    hot = [features[-2] for features, _ in Seen.rows if features[-2] > 0.95]
    assert len(set(hot)) <= url_filter.FOLDS and all(0.5 * HOSTS < 20 * (x - overall) / (1 - x) < 0.95 * HOSTS for x in hot)
    tops = {features[-3] for features, _ in Seen.rows}
    assert 1 < len(tops) <= url_filter.FOLDS and all(abs(t - overall) < 0.05 for t in tops)
    # the sample holds its bound, and the hot url about its share of it
    hot = sum(features[-2] > 0.95 for features, _ in Seen.rows)
    assert 220 <= len(Seen.rows) <= 380 and 60 <= hot <= 140
