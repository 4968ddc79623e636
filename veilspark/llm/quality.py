"""Quality rules: text statistics as Spark expressions, and a decision list learned from labels.

Sequential covering grows conjunctions of thresholds that pick out rejected texts, prunes them
on rows held back, and emits the list as one ordered conditional expression.  Learning looks at a
bounded sample of labelled rows; statistics and verdicts are built-in expressions over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: Labelled rows that learning looks at, at most.
SAMPLE_ROWS = 6000
#: What the learned rules may look at.
RATIOS = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "distinct_rate", "digit_rate")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever body does with it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(hashed: Column) -> Column:
    """Words (given as hashes) that lie in a window of eight found twice or more, the first included."""

    def covered(at: Column) -> Column:
        n = F.size(at)
        steps = F.transform(at, lambda p, k: F.when(k == n - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(at, k + 1) - p)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def places(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        def twice(s: Column) -> Column:
            n = F.size(s)
            same = lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(F.filter(s, same), lambda x: x["k"]))
        return let(by_hash, twice)

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(places(windows), covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WINDOW)]))

    return F.when(F.size(hashed) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows(hashed), count))


def base_statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the
    counts that the learned rules use (null texts count as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    packed = F.struct(
        let(
            F.transform(words_of(text), lambda w: F.xxhash64(w)),
            lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).alias("n_repeat_words"), F.size(F.array_distinct(h)).cast("long").alias("n_distinct")),
        ).alias("w"),
        (F.length(text) - times(text, SPACE)).cast("long").alias("word_chars"),
        times(text, SYMBOL).alias("n_symbols"),
        let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.size(F.split(text, "\n")).cast("long").alias("n_lines"),
        times(text, "[A-Z]").alias("n_upper"),
        times(text, "[!?]").alias("n_marks"),
        times(text, "[0-9]").alias("n_digits"),
    )
    kept = [c for c in docs.columns if c != "_stats"]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], packed.alias("_stats"))
    n, r = F.col("_stats.w.n_words"), F.col("_stats.w.n_repeat_words")
    return out.withColumn("_failed", (n < 20) | (100 * r > 30 * n))


def ratios() -> dict[str, Column]:
    s = lambda c: F.col(f"_stats.{c}")
    words, chars = F.greatest(s("w.n_words"), F.lit(1)), F.greatest(s("word_chars"), F.lit(1))
    return {
        "n_words": s("w.n_words").cast("double"),
        "mean_word": s("word_chars") / words,
        "symbol_rate": s("n_symbols") / words,
        "dup_line_rate": s("n_dup_lines") / F.greatest(s("n_lines"), F.lit(1)),
        "repeat_rate": s("w.n_repeat_words") / words,
        "upper_rate": s("n_upper") / chars,
        "mark_rate": s("n_marks") / words,
        "distinct_rate": s("w.n_distinct") / words,
        "digit_rate": s("n_digits") / chars,
    }


# -- learning ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] > self.limit if self.above else row[self.feature] <= self.limit

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.limit if self.above else of[self.feature] <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


Rule = tuple[Test, ...]


def matches(rule: Rule, row: dict) -> bool:
    return all(t.holds(row) for t in rule)


def grow(bad: list[dict], good: list[dict], longest: int = 4, cuts: int = 24) -> Rule:
    """Adds the test of the highest information gain until no good row is left."""
    rule: Rule = ()
    while good and len(rule) < longest:
        base = math.log2(len(bad) / (len(bad) + len(good)))
        best: tuple[float, Test] | None = None
        for f in RATIOS:
            values = sorted({r[f] for r in bad} | {r[f] for r in good})
            at = range(1, len(values)) if len(values) <= cuts else sorted({len(values) * i // cuts for i in range(1, cuts)} | {_cut(values, bad, f, True), _cut(values, bad, f, False)})
            for i in at:
                if not 0 < i < len(values):
                    continue
                limit = (values[i - 1] + values[i]) / 2
                for above in (True, False):
                    test = Test(f, above, limit)
                    p = sum(map(test.holds, bad))
                    if not p:
                        continue
                    gain = p * (math.log2(p / (p + sum(map(test.holds, good)))) - base)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, test)
        if best is None:
            break
        rule += (best[1],)
        bad, good = [r for r in bad if best[1].holds(r)], [r for r in good if best[1].holds(r)]
    return rule


def _cut(values: list[float], bad: list[dict], f: str, low: bool) -> int:
    """The place in values where the bad rows' middle nine tenths begin or end."""
    own = sorted(r[f] for r in bad)
    edge = own[len(own) // 20] if low else own[-1 - len(own) // 20]
    return values.index(edge) + (0 if low else 1)


def worth(rule: Rule, bad: list[dict], good: list[dict]) -> float:
    p, n = sum(matches(rule, r) for r in bad), sum(matches(rule, r) for r in good)
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: list[dict], most_rules: int = 12, precision: float = 0.98) -> list[Rule]:
    """Sequential covering.  rows hold RATIOS and bad (true: rejected).  A rule stands only if it
    is right on nearly all rows that it picks, grown and held back, so clean texts are let alone."""
    held = [r for i, r in enumerate(rows) if i % 3 == 2]
    own = [r for i, r in enumerate(rows) if i % 3 != 2]
    bad, good = [r for r in own if r["bad"]], [r for r in own if not r["bad"]]
    held_bad, held_good = [r for r in held if r["bad"]], [r for r in held if not r["bad"]]
    rules: list[Rule] = []
    while bad and len(rules) < most_rules:
        rule = grow(bad, good)
        if not rule:
            break
        while len(rule) > 1 and worth(rule[:-1], held_bad, held_good) >= worth(rule, held_bad, held_good):
            rule = rule[:-1]
        hit, wrong = sum(matches(rule, r) for r in bad + held_bad), sum(matches(rule, r) for r in good + held_good)
        left = [r for r in bad if not matches(rule, r)]
        if hit < 5 or hit < precision * (hit + wrong) or len(left) == len(bad):
            break
        rules.append(rule)
        bad, held_bad = left, [r for r in held_bad if not matches(rule, r)]
    return rules


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[dict]:
    """At most `rows` labelled texts (the lowest hashes of doc_id), as ratios; texts that the base
    rules reject are left out, as the list never sees them.  Rows without a label do not count."""
    some = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # A document of several rows has one text here, the first in order; so the rows that come are bounded.
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    found = base_statistics(texts).where("NOT _failed")
    got = found.select("doc_id", (F.col("quality") == 0).alias("bad"), *[c.alias(k) for k, c in ratios().items()]).collect()
    return [r.asDict() for r in sorted(got, key=lambda r: (r["doc_id"], r["n_words"], r["mean_word"]))]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one expression: true keeps."""
    of, out = ratios(), F.lit(True)
    for rule in reversed(rules):
        fits = F.lit(True)
        for t in rule:
            fits = fits & t.column(of)
        out = F.when(fits, F.lit(False)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with _stats, _failed and _kept.  Null texts count as empty and fail; repeated rows are
    judged alike; other columns stay as they are."""
    return base_statistics(docs).withColumn("_kept", ~F.col("_failed") & verdict(rules))


def quality_report(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    s = lambda c, name: F.col(f"_stats.{c}").alias(name)
    return judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", s("w.n_words", "n_words"), s("word_chars", "word_chars"), s("n_symbols", "n_symbols"), s("n_dup_lines", "n_dup_lines"),
        s("w.n_repeat_words", "n_repeat_words"), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )


def accepted(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that are kept, with their own columns, whatever their names.  Null and empty texts fail
    the base rules; no rows give no rows."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return judge(packed, rules).where("_kept").select("row.*")
