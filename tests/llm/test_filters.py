import random
import re
from collections import Counter

from pyspark.sql import functions as F

from veilspark.llm import mixing, quality, urls


def plain_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_urls_against_all_rules(spark):
    rng = random.Random(3)
    hosts = ["net", "a.net", "b.a.net", "ab.net", "org", "x.org", "example.com", "net.org"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in hosts[:6] for p in ("/", "/en/", "/en/x") if rng.random() < 0.6]
    found = [None, "", "no-scheme.net/", "http://", "HTTP://B.A.NET/en/x?y://z", "http://a.net#f", "mailto:x"]
    found += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/xy', '/de/'])}{rng.choice(['', '?q', '#f/en/'])}" for _ in range(300)] + ["http://a.net/en/"] * 200
    df = spark.createDataFrame([(k, u, "own") for k, u in enumerate(found)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert got == {k: plain_rule(u, rules) for k, u in enumerate(found)}
    assert urls.filter_urls(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c d e f g h a b c d e f g h", "x\u00a0y z", "l\nl\n \nl|#*", "😀 ü " * 30, "w " * 5000]
    texts += [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 60))) + rng.choice(["", "\n\n<x>", "\x0b$"]) for _ in range(80)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    for r in quality.quality_report(docs, []).collect():
        n, chars, symbols, dups, repeats = plain_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and r.kept == (not r.base_failed)


def test_decision_list_and_its_expression(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.labelled(docs, labels)
    rules = quality.learn(rows)
    assert rules
    kept = {r.doc_id for r in quality.accepted(docs, rules).collect()}
    for r in rows:
        assert (r["doc_id"] in kept) == (not any(quality.matches(rule, r) for rule in rules))
    assert sum(r["doc_id"] in kept for r in rows if not r["bad"]) >= 0.99 * sum(not r["bad"] for r in rows)
    assert quality.learn([]) == [] and quality.accepted(docs, rules).columns == docs.columns


def water(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, total, full = {}, sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["a", "b", "b", "b", "b", "c", "ä", None]), " ".join(["w"] * rng.randint(0, 40)) if rng.random() < 0.95 else None) for k in range(600)]
    rows += [(7, "tiny", "one two")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    got = mixing.mix_report(docs, shards=5).collect()
    want = water(dict(sizes))
    source = {k: s for k, s, _ in rows if k != 7}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        if r.doc_id != 7:
            assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6
            taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes if s != "tiny")
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs, shards=5).collect()))
    mixed = mixing.mixed(docs, shards=5)
    assert mixed.count() == sum(r.taken // r.size for r in got if r.size) + sum(1 for r in mixing.mix(docs, 5).where("size = 0").selectExpr("explode(draws)").collect())
    assert mixing.mix_report(docs.limit(0)).count() == 0
    quota = {(r.shard, r.source): r["last"] - r["first"] for r in mixing.shard_quotas(mixing.quotas(mixing.placed(docs, mixing.blocks_for(docs), 1), mixing.blocks_for(docs)), 5, 1).collect()}
    drawn = {(k, source.get(r.doc_id, "tiny")) for r in got for k in r.shards}
    assert drawn <= set(quota) and all(len(r.shards) * r.size == r.taken for r in got)


def test_mix_of_clashing_columns(spark):
    names = ["size", "at", "block", "n", "part", "target", "low", "high", "passes", "rest", "ranges", "source_size", "row", "of", "draws", "_more", "one", "absent"]
    rows = [(k, f"s{k % 3}", "w " * (k % 7 + 1), *range(len(names))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{c} int" for c in names))
    assert mixing.mixed(docs, 3).columns == docs.columns and {tuple(r) for r in mixing.mixed(docs, 3).collect()} <= set(rows)
    assert mixing.mix_report(docs).count() == 60
    assert mixing.mixed(docs.limit(0), 3).count() == 0


def test_shards_of_many_sources(spark):
    share = spark.createDataFrame([(f"s{k}", k % 40) for k in range(200)], "source string, n long")
    before, mixing.GROUP = mixing.GROUP, 16
    try:
        got = mixing.shard_quotas(share, 6, 3).collect()
    finally:
        mixing.GROUP = before
    by_source, by_shard = Counter(), Counter()
    for r in got:
        by_source[r.source] += r["last"] - r["first"]
        by_shard[r.shard] += r["last"] - r["first"]
    assert all(by_source[f"s{k}"] == k % 40 for k in range(200)) and max(by_shard.values()) - min(by_shard.values()) <= 16


def test_mix_fills_past_a_long_document(spark):
    """Short documents go on filling a last pass whose order meets a long one first."""
    sizes = [1] * 100 + [30]
    rows = [(k, "s", " ".join(["w"] * n)) for k, n in enumerate(sizes)] + [(200 + k, "t", "w") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for seed in (1, 2):
        share = mixing.mix(docs, 4, seed, (1.0, 1.25)).where("source = 's'").selectExpr("sum(`size` * size(draws)) AS taken", "max(target) AS target").first()
        assert abs(share.taken - share.target) <= 1, (seed, share)
    docs = mixing.F.array(*[mixing.F.struct(mixing.F.lit(k).alias("_nth"), mixing.F.lit(n).alias("size")) for k, n in enumerate([50, *[1] * 20, 3])])
    got = spark.range(1).select(mixing.fillers(mixing.F.lit(12.0), docs).alias("f")).first().f
    assert got == list(range(1, 13))


def test_shards_get_exact_quotas(spark):
    assert sorted((r.source, r.weight) for r in mixing.weighed(spark.createDataFrame([(c,) for c in "dbca"], "source string"), (1.0, 2.0, 3.0)).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 1.0)]
    share = spark.createDataFrame([("a", 100), ("b", 37), (None, 3)], "source string, n long")
    got = mixing.shard_quotas(share, 7, 1).collect()
    by_source = Counter()
    for r in got:
        by_source[r.source] += r["last"] - r["first"]
    assert by_source == {"a": 100, "b": 37, None: 3}
    by_shard = Counter()
    for r in got:
        by_shard[r.shard] += r["last"] - r["first"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 3


def test_hypergeometric_matches_its_law(spark):
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(30).cast("long"), F.lit(12).cast("long"), F.lit(10).cast("long"), (F.col("id") + 0.5) / 4000).alias("k"))
    from math import comb

    got = Counter(r.k for r in df.collect())
    for k in range(0, 11):
        want = comb(12, k) * comb(18, 10 - k) / comb(30, 10) * 4000
        assert abs(got[k] - want) <= 2
