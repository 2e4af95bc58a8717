"""Archives, url and quality verdicts, toxicity and the pipeline."""

import base64
import hashlib
import os
import re
from collections import Counter

import pytest

pytest.importorskip("riskframe.llm")
import corpus_pipeline  # noqa: E402
from riskframe.llm import archive, near_text, personal, quality, toxicity, url_filter  # noqa: E402
from riskframe.llm.labelling import fit_votes  # noqa: E402
from riskframe.llm.queries import RULES  # noqa: E402


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "x\r\n\r\nWARC/1.1\r\n\r\ny\n", "é" * 3000, "<p>a</p>"]
    rows = [(5 - i, None if i == 2 else f"http://a b.example/{i}\n", h, "x") for i, h in enumerate(html)]
    rows += [(None, "http://n/", "<p>a</p>", "x"), (5, "http://again/", "<p>a</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    got = archive.archive_pages(df).collect()
    first = {}
    for key, _, body, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(body or "", key)
    assert all(r["intact"] for r in got)
    want, seen = Counter(), set()
    for key, _, body, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (body or "").encode()
        new = (body or "") not in seen
        seen.add(body or "")
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[(key, len(raw), digest, "response" if new else "revisit", None if new else first[body or ""])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert archive.archive_pages(df.limit(0)).count() == 0


def test_legacy_versions_and_bad_lengths():
    for version in (1, 2):
        opening = f"{version} 0 o\n{archive.FIELDS[version]}\n"
        extra = "200 - - 0 f " if version == 2 else ""
        data = f"filedesc://x 0 1999 text/plain {extra}{len(opening)}\n{opening}\nhttp://u 1.2.3.4 199901 text/html {extra}3\nabc\n\n"
        (found,) = archive.read_arc(data.encode())
        assert found["block"] == b"abc" and archive.iso_date(found["date"]) == "1999-01-01T00:00:00Z"
        with pytest.raises(ValueError):
            list(archive.read_arc(data.replace("3\nabc", "9\nabc").encode()))


def test_urls_follow_the_longest_rule(spark):
    urls = [
        "http://A.Example.ORG/es/1", "https://x.org", "ftp://example.org/en/1?x", "http://notorg/", "http://b.com/de/",
        "http://com/fr/a#b", None, "no scheme", "", "http://h.net/q?a=1&b=2", "http://h.net/" + "z" * 50_000,
    ] * 2
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(df, RULES).collect()}
    assert len(rows) == len(urls)
    assert [rows[i]["rule"] for i in range(9)] == ["example.org/es/", None, "example.org/en/1", None, "com/de/", "com/fr/", None, None, None]
    assert rows[0]["host"] == "a.example.org" and rows[2]["path"] == "/en/1" and rows[6]["host"] == rows[7]["path"] == ""
    assert rows[4]["verdict"] == "block" and rows[5]["verdict"] == "allow"
    assert all(r["verdict"] in ("allow", "block") for r in rows.values())
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, seen, covered = len(words), Counter(), set()
    for i in range(n - 4):
        seen[tuple(words[i : i + 5])] += 1
    for i in range(n - 4):
        if seen[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_plain_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = ["", None, " \n\t", "a b c d e a b c d e a b c d e", "é x y\x0bz|<>\n\n x\n x", "q " * 9000]
    df = docs.union(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], docs.schema))
    df = df.selectExpr("*", "1 AS n_words", "'x' AS kept")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = quality.judge_quality(df).collect()
    for r in rows:
        assert plain_measures(texts[r["doc_id"]]) == tuple(r)[1:6], r["doc_id"]
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == kept
    assert quality.keep_good(df).columns == df.columns
    assert quality.judge_quality(df.limit(0)).count() == 0


def test_votes_are_weighed_by_agreement():
    patterns = [((1, 1, 1), 800.0), ((0, 0, 1), 150.0), ((0, 0, 0), 30.0), ((1, 1, 0), 20.0)]
    constant, weights = fit_votes(patterns)
    odds = lambda votes: constant + sum(w[v] for w, v in zip(weights, votes))
    assert odds((1, 1, 1)) > 0 > odds((0, 0, 1)) and odds((1, 1, 0)) > 0
    assert fit_votes([])[1] == []


def test_toxicity_learns_and_holds_out(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("larger test tables are not available")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, 1.0), (None, "", 1.0), (-2, "x " * 50_000, 1.0)], "doc_id long, text string, score double")
    df = docs.selectExpr("doc_id", "text", "1.0D AS score").union(odd)
    rows = toxicity.score_toxicity(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(toxic[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    nothing = toxicity.score_toxicity(df, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.0}
    assert toxicity._fits("id1ot", toxicity.INSULTS) and toxicity._fits("m*ron", toxicity.INSULTS)
    assert not toxicity._fits("m*r", toxicity.INSULTS)


def test_pipeline_against_its_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    clean = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("predicted = 0")
    left = docs.join(clean.select("doc_id"), "doc_id")
    good = {r["doc_id"] for r in quality.judge_quality(left).filter("kept").collect()}

    def shingles(text):
        words = text.encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    order = sorted(good)
    sets = {k: shingles(rows[k]["text"]) for k in order}
    parent = {k: k for k in order}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    kept = {k for k in order if find(k) == k}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == kept
    left = docs.filter(docs["doc_id"].isin(list(kept)))
    verdicts = personal.fit_span_classifier(left)
    hidden = {r["doc_id"]: r for r in corpus_pipeline.hide_personal(spark, left, sf_dir).collect()}
    assert set(hidden) == kept
    changed = 0
    for k, r in hidden.items():
        plain, out, floor = rows[k]["text"], "", 0
        base, more = personal.all_spans(plain, verdicts)
        for start, kind, end in sorted(base + more):
            if start >= floor:
                out += plain[floor:start] + f"[{personal.KINDS[kind].upper()}]"
            floor = max(floor, end)
        assert r["text"] == out + plain[floor:] and r["n_chars"] == len(r["text"])
        changed += bool(base)
        assert all(plain[s:e] not in r["text"] for s, kind, e in base if personal.KINDS[kind] == "email")
    assert changed > 3
    assert near_text.band_count(80) == 31
