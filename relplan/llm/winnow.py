"""Benchmark decontamination by winnowing, in DataFrame functions only.

A document is cut into words; of its k-gram hashes the smallest of each sliding
window is kept.  Any run of ``span`` words that a document shares with an item
has a kept hash in common with it, so documents without a common fingerprint are
settled at once.  The others are extended: every window of ``span`` words is
looked up by hash and by its words among the items' windows.

The items' fingerprints and windows are written into the plan while there are at
most ``most_literals`` of them (the size is checked); beyond that documents and
fingerprints meet in a shuffled join.  Texts are read once and never shuffled on
the first way.

Defined cases: null and empty texts have no words; an item of fewer than
``span`` words is one window of its length; items without id or words are left
out; equal item ids count once; repeated documents give repeated rows; extra
columns don't take part; rows without id are rows like others; an empty benchmark
hits nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relplan.sources import shared

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN, GRAM = 8, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts of ASCII take the fast built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWERED))


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def upto(n: Column) -> Column:
    """0 .. n-1, empty if n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(of: Column, span: int = SPAN, k: int = GRAM) -> Column:
    """Distinct minimal k-gram hashes over each run of ``span`` words."""
    codes = F.transform(of, lambda w: F.xxhash64(w))
    width = span - k + 1

    def kept(h: Column) -> Column:
        gram = F.transform(upto(F.size(h) - k + 1), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return let(gram, lambda g: F.array_distinct(F.transform(upto(F.size(g) - width + 1), lambda i: F.least(*[F.get(g, i + j) for j in range(width)]))))

    return let(codes, kept)


def windows(of: Column, length: int) -> Column:
    """(pos, length, hash) of each run of ``length`` words."""
    return F.transform(upto(F.size(of) - length + 1), lambda i: F.struct(i.alias("pos"), F.lit(length).alias("length"), F.xxhash64(F.slice(of, i + 1, length)).alias("hash")))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, least_items: int = 2, most_literals: int = 20_000, telling: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    With ``telling``, also n_telling, the items met in a window of so many words or more, and rest, the whole row.
    """
    rest = [] if telling is None else [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")]
    kept = [] if telling is None else ["rest"]
    item = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    lengths = sorted({r[0] for r in item.select(F.least(F.size("w"), F.lit(span))).distinct().collect()})
    each = [item.where(F.size("w") >= span if n == span else F.size("w") == n).select("item", "w", F.explode(windows(F.col("w"), n)).alias("x")) for n in lengths]
    if not each:
        return docs.select(*rest, *[F.lit(0).cast("long").alias("n_telling") for _ in kept], "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    shown = each[0]
    for other in each[1:]:
        shown = shown.unionByName(other)
    known = shown.select("item", "x.length", "x.hash", F.array_join(F.slice("w", F.col("x.pos") + 1, F.col("x.length")), " ").alias("run")).distinct()
    known = shared.keep(known, "windows")
    prints = shared.keep(item.where(F.size("w") >= span).select(F.explode(fingerprints(F.col("w"), span)).alias("print")).distinct(), "prints")
    n_windows, n_prints = known.count(), prints.count()
    listed = n_windows <= most_literals and n_prints <= most_literals
    short = [n for n in lengths if n < span]
    cut = docs.select(*rest, "doc_id", words(F.col("text")).alias("w"))
    by_length = {n: sorted(r[0] for r in known.where(F.col("length") == n).select("hash").distinct().collect()) for n in lengths} if listed else {}

    def known_at(of: Column, n: int) -> Column:
        return F.filter(windows(of, n), lambda x: F.lit(True)) if not listed else F.filter(windows(of, n), lambda x: _member(x["hash"], by_length[n]))

    if listed:
        first = sorted(r[0] for r in prints.collect())
        suspect = F.exists(fingerprints(F.col("w"), span), lambda p: _member(p, first)) if first else F.lit(False)
        for n in short:
            suspect = suspect | (F.size(known_at(F.col("w"), n)) > 0)
        settled = cut.select(*kept, "doc_id", F.size("w").cast("long").alias("n_words"), F.when(suspect, F.col("w")).alias("w"))
    else:
        keyed = cut.withColumn("key", F.xxhash64("doc_id", "w"))
        flagged = keyed.select("key", F.explode(fingerprints(F.col("w"), span)).alias("print")).join(prints, "print", "left_semi").select("key")
        for n in short:
            flagged = flagged.union(keyed.select("key", F.explode(windows(F.col("w"), n)).alias("x")).select("key", F.col("x.hash").alias("hash")).join(known.where(F.col("length") == n), "hash", "left_semi").select("key"))
        settled = keyed.join(flagged.distinct().withColumn("hit", F.lit(True)), "key", "left").select(*kept, "doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.col("hit"), F.col("w")).alias("w"))
    settled = shared.keep(settled.withColumn("row", F.monotonically_increasing_id()), "suspects")
    spots = settled.where(F.col("w").isNotNull())
    found = spots.select("row", F.explode(F.flatten(F.array(*[F.transform(known_at(F.col("w"), n), lambda x: F.struct(x["pos"].alias("pos"), x["length"].alias("length"), x["hash"].alias("hash"), F.array_join(F.slice("w", x["pos"] + 1, x["length"]), " ").alias("run"))) for n in lengths]))).alias("x")).select("row", "x.*")
    met = found.join(known, ["length", "hash", "run"]).groupBy("row").agg(F.collect_set(F.struct("pos", "length")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"), F.count_distinct(F.when(F.col("length") >= (telling or 0), F.col("item"))).alias("n_telling"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p["pos"], p["pos"] + p["length"] - 1))))
    counted = met.select("row", F.size(covered).cast("long").alias("hit"), F.size("items").cast("long").alias("found"), F.array_join("items", ",").alias("ids"), "n_telling")
    n_items = F.coalesce("found", F.lit(0).cast("long"))
    return settled.select("row", *kept, "doc_id", "n_words").join(counted, "row", "left").select(*kept, *[F.coalesce("n_telling", F.lit(0).cast("long")).alias("n_telling") for _ in kept], "doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"))


def _member(value: Column, values: list[int]) -> Column:
    """``value`` in a hashed set that is part of the plan."""
    if not values:
        return F.lit(False)
    return value.isin(values)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bp AS (SELECT item, w, least(len(w), 8) AS n, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS run FROM bp),
lens AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT x.r, x.i, x.n, bw.item FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS run FROM dp) x JOIN bw ON bw.n = x.n AND bw.run = x.run),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
