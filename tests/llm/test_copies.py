import math
import random
from collections import defaultdict

import numpy as np

from veilspark.llm import common, embeddings, lines, neardup
from veilspark.llm.shingles import shingle_set


def roots(n, links):
    parent = {}
    for a, b in links:
        common.join_up(parent, a, b)
    return {k: common.find(parent, k) for k in n}


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({x for p in links for x in p if p[0] != p[1]}, links)
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def documents(rng):
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    rows, k = [], 0
    for _ in range(25):
        base = [word() for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            sep = [" ", "\n", "\t"]
            rows.append((k, "".join(w.upper() + rng.choice(sep) if rng.random() < 0.1 else w + rng.choice(sep) for w in text)))
            k += 1
    return rows + [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one two"), (k + 4, "ONE two"), (k + 5, "w " * 30000), (None, "one two")]


def test_near_duplicates(spark):
    rows = documents(random.Random(4))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {k: set(shingle_set(t).tolist()) for k, t in rows if k is not None}
    links = [(a, b) for a in sets for b in sets if a > b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {k: (len(s), want[k], want[k] == k) for k, s in sets.items()}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_star(spark):
    """Copies near a common original but not near each other: all links go through it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=8))
    base = [word() for _ in range(704)]
    rows = []
    for k in range(400):
        text = list(base)
        for at in rng.sample(range(10, 694), 9):
            text[at] = word()
        rows.append((k, " ".join(text)))
    rows.append((400, " ".join(base)))
    sets = {k: set(shingle_set(t).tolist()) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(links) < 1000 and len(set(want.values())) < 40


def crowd(rng, groups, copies):
    """Chains of near copies: each is changed from an earlier one, so similarities lie about the threshold."""
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    rows = []
    for _ in range(groups):
        made = [[word() for _ in range(150)]]
        for _ in range(copies - 1):
            text = list(rng.choice(made[-40:]))
            for _ in range(rng.choice([1, 2, 4, 6])):
                text[rng.randrange(150)] = word()
            made.append(text)
        rows += [" ".join(x) for x in made]
    rng.shuffle(rows)
    return list(enumerate(rows))


def links_among(rows, percent):
    """All links by brute force, over an index of shingles."""
    sets, holders = {k: set(shingle_set(t).tolist()) for k, t in rows}, defaultdict(list)
    for k, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for o in holders[x]:
                both[o] += 1
            holders[x].append(k)
        yield from ((k, o) for o, n in both.items() if 100 * n >= percent * (len(s) + len(sets[o]) - n))


def test_near_duplicates_of_crowds_about_the_threshold(spark):
    rows = crowd(random.Random(12), 3, 250)
    want = roots(range(len(rows)), links_among(rows, 85))
    assert 20 < len(set(want.values())) < 700
    before = neardup.BLOCK, neardup.COLUMNS
    neardup.BLOCK, neardup.COLUMNS = 64, 512
    try:
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    finally:
        neardup.BLOCK, neardup.COLUMNS = before
    assert got == want


def test_near_duplicates_of_a_large_crowd(spark):
    rows = crowd(random.Random(13), 1, 5000)
    want = roots(range(len(rows)), links_among(rows, 85))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == want


def test_near_duplicates_edges(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a, 1, 1), (2, a, 1, 1), (5, b, 1, 1), (3, b, 1, 1), (9, c, 1, 1), (9, c, 1, 1), (None, c, 1, 1), (7, None, 1, 1), (8, "z " * 300_000, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, component_id int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 26, None, True), (2, 26, 2, True), (3, 26, 2, False), (5, 26, 2, False), (5, 26, 2, False), (7, 0, 7, True), (8, 1, 8, True), (9, 26, 9, True), (9, 26, 9, True)]


def test_slack_loses_hardly_any_pair():
    n = neardup.TREES * neardup.LEAST_DEPTH
    lost = sum(math.comb(n, k) * 0.85**k * 0.15 ** (n - k) for k in range(n + 1) if k / n < 0.85 - neardup.SLACK)
    assert lost < 2e-8


def test_line_dedup(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    bases = [rng.sample(words, rng.randint(3, 40)) for _ in range(30)]
    rows = []
    for k in range(60):
        text = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(words)
            rng.shuffle(line)
            text.append(" ".join(line).title() if rng.random() < 0.2 else " ".join(line))
        rows.append((k, "\n".join(text), "own"))
    rows += [(100, None, ""), (101, "", ""), (None, rows[0][1], "x"), (102, "the same again and again here", ""), (103, "the same again and again here\n", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    for t, crowd, listed in ((0.8, 3, 1), (0.8, lines.CROWD, 1), (0.9, lines.CROWD, lines.LISTED), (0.4, 2, 2)):
        before = lines.CROWD, lines.LISTED, lines.BLOCK
        lines.CROWD, lines.LISTED, lines.BLOCK = crowd, listed, 8
        try:
            got = {r.doc_id: r for r in lines.without_repeats(docs, t).collect()}
        finally:
            lines.CROWD, lines.LISTED, lines.BLOCK = before
        seen = []
        for k, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            kept = []
            for line in (text or "").split("\n"):
                s = set(line.lower().split())
                if len(line.split()) >= lines.LEAST_WORDS:
                    gone = any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen)
                    seen.append(s)
                    if gone:
                        continue
                kept.append(line)
            assert got[k].text == (None if text is None else "\n".join(kept)), k
        assert got[None].text == rows[0][1]
    assert lines.without_repeats(docs.limit(0)).count() == 0


def test_line_dedup_of_a_crowd_about_the_threshold(spark):
    """Over a thousand lines of a word, few of them alike, in small Arrow batches."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(20)]
    found = []
    for _ in range(1100):
        line = list(base)
        for at in rng.sample(range(1, 20), rng.choice([2, 3, 4])):
            line[at] = f"x{rng.randrange(60)}"
        found.append(" ".join(line))
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").repartition(3)
    sets, gone = [set(x.split()) for x in found], set()
    for k, s in enumerate(sets):
        if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in sets[:k]):
            gone.add(k)
    assert 100 < len(gone) < 1000
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for crowd, batch in ((lines.CROWD, "10000"), (1024, "64")):
        before, lines.CROWD = lines.CROWD, crowd
        spark.conf.set(size, batch)
        try:
            assert {r.doc_id for r in lines.removed_lines(docs).collect()} == gone
        finally:
            lines.CROWD = before
            spark.conf.unset(size)


def test_line_dedup_edges(spark):
    long = "w " * 200_000
    rows = [(1, "a b c d e f", 0, 1), (1, "a b c d e f", 0, 1), (1, "other words stand here now", 0, 1), (2, "now here stand words other\nz", 0, 1), (3, long, 0, 1), (4, "W\n\n" + long, 0, 1), (5, "a" * 400_000, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, __id int")
    got = sorted((r.doc_id, r.text, r.n, r.gone) for r in lines.without_repeats(docs, counts=("n", "gone")).collect())
    assert got == sorted([(1, rows[0][1], 1, 0), (1, rows[1][1], 1, 0), (1, rows[2][1], 1, 0), (2, "z", 2, 1), (3, long, 1, 0), (4, "", 3, 2), (5, rows[6][1], 1, 0)])
    assert lines.without_repeats(docs, counts=None).columns == docs.columns


def test_blocks_hold_any_numbers():
    columns = [np.array(c, np.int64) for c in ([0, 2**63 - 1, -(2**63)], [5, 5, 5], [-3, 250, 7])]
    assert [c.tolist() for c in lines.unpack(lines.pack(columns), 3)] == [c.tolist() for c in columns]
    assert [len(c) for c in lines.unpack(lines.pack([columns[0][:0]] * 2), 2)] == [0, 0]


def test_line_dedup_finds_one_changed_word_in_nine(spark):
    line = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(0, line), (1, line.replace("five", "other"))], "doc_id long, text string")
    assert {r.doc_id: r._n_removed for r in lines.without_repeats(docs).collect()} == {0: 0, 1: 1}


def test_line_dedup_of_short_lines(spark):
    docs = spark.createDataFrame([(0, "Read more\nShare\n\n"), (1, "read  more\n\nshare this"), (2, "more read\nSHARE\nread")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}
    assert got == {0: "Read more\nShare\n\n", 1: "\nshare this", 2: "read"}


def test_sieve(spark):
    ids = spark.createDataFrame([(k * 977,) for k in range(500)], "id long")
    sieve = common.Sieve(ids)
    assert ids.where(sieve.holds(ids["id"])).count() == 500
    others = spark.range(1_000_000, 1_010_000)
    assert others.where(sieve.holds(others["id"])).count() < 20


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [centres[rng.integers(40)] + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25, 0.3]) for _ in range(400)]
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, rows[0], [2 * x for x in rows[0]], [1.0, 2.0], [None] * 16, rows[1][:15] + [None]]
    df = spark.createDataFrame([(k, r, 0) for k, r in enumerate(rows)], "vec_id long, embedding array<float>, n_links int")
    before = embeddings.INTERVAL, embeddings.BLOCK
    embeddings.INTERVAL, embeddings.BLOCK = 64, 16
    try:
        got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    finally:
        embeddings.INTERVAL, embeddings.BLOCK = before
    good = {k: np.array(r, np.float64) for k, r in enumerate(rows) if r and len(r) == 16 and None not in r and np.isfinite(r).all() and any(r)}
    links = defaultdict(list)
    for a in good:
        for b in good:
            if a != b and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95:
                links[a].append(b)
    want = roots(range(len(rows)), [(a, b) for a in links for b in links[a]])
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (len(links[k]), want[k], want[k] == k) for k in range(len(rows))}
    assert embeddings.near_vectors(df.limit(0)).count() == 0
