"""Every operator against its SQL on the driver's smallest tables, and against brute force on hard little ones."""

import random
from collections import Counter

import pytest
from brute import ALNUM, WORD, base_scores, contaminated, fold, near, removed, sha, targets
from oracle import DATA, duckdb_rows, spark_rows

from relplan.llm import entries, kdtree, lbl, licenses, minhash, mixing, pu_quality, substrings, wacz, winnow

SF = f"{DATA}/sf0.001"
#: Columns whose names the operators use themselves.
EXTRA = ", score double, row string, rest string, kept int, node long, size int, key string, words string, copy int, bucket int, held boolean, label int"


def frame(spark, docs, extra=True):
    """(doc_id, text, lang, source, n_chars) and clashing columns, all null."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long" + (EXTRA if extra else "")
    width = kinds.count(",") + 1
    return spark.createDataFrame([(*d, *[None] * (width - len(d))) for d in docs], kinds)


def texts(seed=3, n=60):
    """Words of a small vocabulary, near and whole copies, empty, null, tiny and long texts, other scripts and blanks."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "Straße", "ΣΙΓΜΑ", "日本語", "x,", "y.", "THE", "the"]
    passage = " ".join(rng.choices(vocabulary, k=55))
    out = []
    for i in range(n):
        kind = i % 10
        words = rng.choices(vocabulary, k=rng.randint(1, 160))
        if kind == 1 and out and out[-1]:
            words = out[-1].split(" ")
            words[rng.randrange(len(words))] = "changed"
        if kind == 2:
            words[len(words) // 2 : len(words) // 2] = passage.split(" ")
        text = {3: None, 4: "", 5: out[0] if out else "a", 6: " \t\n ", 7: "one two three", 8: "\n".join(words)}.get(kind, rng.choice(["", " ", "\t"]) + " ".join(words))
        out.append(text)
    out.append(" ".join(rng.choices(vocabulary, k=30_000)))
    out += ["THE one two", "the one two", "z " * 700, passage + " " + passage]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs():
    return texts()


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_against_sql(spark, name):
    assert spark_rows(entries.queries()[name](spark, SF)) == duckdb_rows(entries.oracle_sql()[name], SF)


def test_minhash_against_brute_force(spark, docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(frame(spark, docs)).collect()}
    assert found == near(docs)


def test_minhash_blocks_of_an_open_bucket(spark):
    """A crowd of texts about as similar as the threshold, in chains, compared in blocks of five."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            words[rng.randrange(120)] = f"n{rng.random()}"
        docs.append((1000 - i, " ".join(words)))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.groups(frame(spark, docs), block_rows=5).collect()}
    assert found == near(docs)


def test_minhash_odd_rows(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, None), (4, "")]
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.groups(frame(spark, rows)).collect()), key=str)
    assert found == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)], key=str)
    left = minhash.first_of_each(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "None"]


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    bins = minhash.sketch(np.concatenate([shared, a, shared, b]), np.array([0, 900, 1800]))
    assert (bins != minhash.EMPTY).all() and abs((bins[0] == bins[1]).mean() - 0.8) < 0.12
    tiny = minhash.sketch(shared[:1], np.array([0, 1]))
    assert (tiny != minhash.EMPTY).all()


@pytest.mark.parametrize("units", [substrings.BYTES, substrings.WORDS], ids=["bytes", "words"])
def test_repeats_against_brute_force(spark, docs, units):
    want = removed(docs, units.words)
    found = substrings.remove_repeats(frame(spark, docs), units, texts=True, least=7).selectExpr("rest.doc_id", "n_units", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    assert len(found) == len(docs)
    for r in found:
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_units, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, sha(kept)), r.doc_id
        if gone or not units.words:
            assert bytes(r.kept) == kept


def test_repeats_inside_a_document_and_runs_of_one_word(spark):
    docs = [(5, "a " * 100), (6, "q r " * 40), (2, " ".join(f"u{i}" for i in range(30)) * 2)]
    want = removed(docs, True)
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, docs), substrings.WORDS).selectExpr("rest.doc_id", "n_removed").collect()} == {i: w[1] for i, w in want.items()}


def test_bucket_pointer_refinement_finds_equal_windows():
    import numpy as np

    codes = np.frombuffer(b"abab" * 60 + b"xyz" * 50, np.uint8)
    starts = np.arange(len(codes) - 49)
    order, first = substrings.classes(substrings.BYTES, codes, starts)
    groups = np.split(starts[order], first[1:])
    want = Counter(codes[s : s + 50].tobytes() for s in starts)
    assert sorted(map(len, groups)) == sorted(want.values())
    assert all(len({codes[s : s + 50].tobytes() for s in g}) == 1 for g in groups)


def pages(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, payload string")


def test_archives_keep_every_payload(spark):
    from relplan.sources import shared

    rows = [(1, "http://a/ä?q=1\r\n", "<p>Grüße</p>\r\n\r\nx"), (2, None, None), (3, "u", ""), (9, "u", "same"), (4, "v", "same"), (5, "v", "same"), (7, "w", "long " * 200_000), (None, "n", "no id")]
    target = shared.new_path(spark, "wacz")
    found = {r.page_id: r for r in wacz.read(spark, wacz.write(pages(spark, rows), target, most_bytes=1000), target).collect()}
    assert len(found) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(raw), wacz.digest(raw))
        assert found[i].payload is None if found[i].record_type == "revisit" else bytes(found[i].payload) == raw
    assert {i: (r.record_type, r.refers_to) for i, r in found.items() if i in (2, 3, 4, 5, 9)} == {2: ("response", None), 3: ("revisit", 2), 4: ("response", None), 5: ("revisit", 4), 9: ("revisit", 4)}


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(wide):
    import io
    import zipfile

    members = {"a": b"x" * 10, "archive/ü": b"", "c": b"PK\x05\x06" * 3}
    raw = wacz.packed(members, wide)
    found = wacz.directory(io.BytesIO(raw), len(raw))
    assert {n: raw[at : at + size] for n, (method, at, size) in found.items() if method == 0} == members
    with zipfile.ZipFile(io.BytesIO(raw)) as other:
        assert other.testzip() is None and {n: other.read(n) for n in other.namelist()} == members
    with pytest.raises(ValueError):
        wacz.directory(io.BytesIO(b"nothing"), 7)


def test_language_model_against_brute_force(spark, docs):
    want = base_scores(docs)
    found = {r.doc_id: r for r in lbl.score(frame(spark, docs), block_bytes=2000).collect()}
    assert set(found) == set(want)
    for i, (tokens, known, n, base) in want.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, fold(i, 10) == 0)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_language_model_is_normalised_and_learns_contexts():
    import numpy as np

    classes = lbl.Classes(top=6, tails=3)
    counts = np.zeros((classes.size,) * 3, np.int64)
    for a in range(6):
        counts[a, (a + 1) % 6, (a + 2) % 6] = 100  # each word follows from the last
    table = lbl.train(counts, classes)
    assert np.allclose((10.0 ** table[..., : classes.end + 1]).sum(-1), 1, atol=1e-4) and (table[..., classes.start] < -30).all()
    assert all(table[a, (a + 1) % 6].argmax() == (a + 2) % 6 and table[a, (a + 1) % 6].max() > -0.3 for a in range(6))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_language_model_beats_the_counts_on_held_out_texts(spark):
    held = lbl.score(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > held[1] * 0.98


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind, express or implied."
    rows = [(1, None), (2, ""), (3, "Some text\nReleased under the MIT License.\nMore"), (4, mit), (5, "Licensed under the Apache License, Version 2.0. All rights reserved."), (6, "Released under the MIT Licence"), (7, "All rights reserved.\n" * 3), (8, "RELEASED UNDER THE MIT LICENSE!  ü")]
    found = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.scan(frame(spark, rows)).collect()}
    assert found == {1: ("", ""), 2: ("", ""), 3: ("1", "MIT"), 4: ("4,5,6", "MIT"), 5: ("10,90", "Apache-2.0,all-rights-reserved"), 6: ("", ""), 7: ("90,90,90", "all-rights-reserved"), 8: ("1", "MIT")}


def vectors(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], "vec_id long, embedding array<float>, score double")


def test_search_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(400)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0]), (1100, [float("nan"), 0.0, 0.0, 0.0]), (1150, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (1200, []), (1250, [1.0, 2.0])]
    found = [tuple(r) for r in kdtree.top_k(vectors(spark, rows), shard_rows=90, query_rows=3, seed_rows=20).select("query_id", "rank", "vec_id", "score").collect()]
    want = []
    for q, x in rows[:400]:
        if q % 50 == 0:
            best = sorted((-sum((256 * a // 1) * (256 * b // 1) for a, b in zip(x, y)), i) for i, y in rows[:400] if i != q)[:5]
            want += [(q, n + 1, i, int(-s)) for n, (s, i) in enumerate(best)]
    assert sorted(found) == sorted(want)


def test_decontamination_against_brute_force(spark, docs):
    rng = random.Random(2)
    items = [(i, " ".join(WORD.findall((docs[j][1] or "").encode())[k : k + n].__iter__().__next__().decode() if n == 1 else w.decode() for w in WORD.findall((docs[j][1] or "").encode())[k : k + n])) for i, (j, k, n) in enumerate([(0, 2, 12), (10, 0, 8), (19, 1, 5), (29, 3, 20), (60, 100, 60)])]
    items += [(90, None), (91, ""), (92, "one, TWO three"), (None, "one two three"), (93, "nothing like it anywhere in these texts at all"), (92, "one, TWO three"), (4, rng.choice(items)[1])]
    named = [(i, t) for i, t in items if i is not None]
    want = contaminated(docs, named)
    bench = spark.createDataFrame([(*i, None) for i in items], "item_id long, text string, print long")
    for most in (20_000, 3):
        found = {r.doc_id: r for r in winnow.contamination(frame(spark, docs), bench, most_literals=most).collect()}
        assert len(found) == len(docs)
        for i, (n, hit, met) in want.items():
            r = found[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(met), sha(",".join(met).encode()), len(met) >= 2), (i, most)
    assert ALNUM.findall(b"a-b") == [b"a", b"b"]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_quality_on_held_out_labels(spark):
    sf = f"{DATA}/sf0.01"
    found = {r.doc_id: r for r in entries.queries()["op9_quality_classifier"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    assert sum(found[r.doc_id].predicted == r.quality for r in labels) > 0.93 * len(labels)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (fold(i, 4) == 2) for i, r in found.items())


def test_quality_without_labels_and_odd_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [*docs, (None, "x"), (3, None), (3, None)]
    assert {r.score for r in pu_quality.classify(frame(spark, rows), labels).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(None, 1, 0), (5, None, None), (6, 7, 0)], "doc_id long, quality int, toxic int")
    found = pu_quality.classify(frame(spark, rows), some).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 3}) == 1


def test_mixing_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "a b", "w " * rng.randint(1, 60)]), None, rng.choice([None, "s1", "s2", "s3", "big", "tiny"])) for i in range(300)]
    rows += [(500 + i, "w " * 200, None, "big") for i in range(60)] + [(7, "w w", None, "s1"), (7, "w w", None, "s1"), (None, "w", None, None)]
    found = mixing.mix(frame(spark, rows), rows_per_bucket=20).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want = targets(sizes)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-6) for s in sizes) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    plan = mixing.schedule(frame(spark, rows))
    copies = plan.collect()
    assert plan.columns[-3:] == ["copy_", "words_", "virtual_finish"]
    assert [r.virtual_finish for r in copies] == sorted(r.virtual_finish for r in copies)
    per = Counter()
    for r in copies:
        per[r.source] += r.words_
    assert per == +taken


EMPTY = {
    "groups": lambda d, s: minhash.groups(d),
    "bytes": lambda d, s: substrings.remove_repeats(d, substrings.BYTES, texts=True),
    "words": lambda d, s: substrings.remove_repeats(d, substrings.WORDS),
    "archives": lambda d, s: wacz.round_trip(pages(s, [(1, "u", "h")]).where("false")),
    "language model": lambda d, s: lbl.score(d),
    "licences": lambda d, s: licenses.scan(d),
    "search": lambda d, s: kdtree.top_k(vectors(s, [(1, [1.0])]).where("false")),
    "decontamination": lambda d, s: winnow.contamination(d, s.createDataFrame([(1, "a b")], "item_id long, text string")),
    "quality": lambda d, s: pu_quality.classify(d, s.createDataFrame([(1, 1)], "doc_id long, quality int")),
    "mixing": lambda d, s: mixing.mix(d),
    "schedule": lambda d, s: mixing.schedule(d),
}


@pytest.mark.parametrize("name", list(EMPTY))
def test_empty_tables(spark, name):
    assert EMPTY[name](frame(spark, [(1, "a")]).where("false"), spark).count() == 0


def test_empty_benchmark(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.contamination(frame(spark, docs), none).where("n_hit > 0 or contaminated").count() == 0


def test_trees_have_tight_boxes_and_the_best_first_walk_skips_leaves():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.normal(0, 0.1, (4000, 3)) + rng.integers(-3, 4, (4000, 1))))
    order, tree = kdtree.build(x, 64)
    assert sorted(order.tolist()) == list(range(4000))
    for i in range(len(tree.lo)):
        part = x[order[tree.lo[i] : tree.hi[i]]]
        assert (part.min(0) == tree.low[i]).all() and (part.max(0) == tree.high[i]).all()
        assert tree.left[i] < 0 or (tree.lo[tree.left[i]], tree.hi[tree.left[i]], tree.hi[tree.right[i]]) == (tree.lo[i], tree.lo[tree.right[i]], tree.hi[i])
    met = []
    plain, kdtree.products = kdtree.products, lambda q, y: met.append(len(y)) or plain(q, y)
    try:
        score, ident = kdtree.search(np.array([-1]), x[:1], order, x[order], tree, 5, np.array([-np.inf]))
    finally:
        kdtree.products = plain
    want = sorted(((-float(s), i) for i, s in enumerate(x @ x[0])))[:5]
    assert [(-s, i) for s, i in zip(score[0], ident[0])] == want and sum(met) < 2000


def test_search_over_repeated_ids_and_large_products(spark):
    rows = [(0, [3e9, 1.0]), (0, [1.0, 1.0]), (1, [3e9, 2.0]), (1, [3e9, 2.0]), (2, [-3e9, 5.0]), (3, [3e9, 1.0]), (50, [0.0, 0.0])]
    found = [tuple(r) for r in kdtree.top_k(vectors(spark, rows)).select("query_id", "rank", "vec_id", "score").collect()]
    assert all(q != v for q, _, v, _ in found) and {q for q, _, _, _ in found} == {0, 50}
    assert [r[2:] for r in sorted(found) if r[0] == 50] == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0)]
    assert max(r[3] for r in found) <= 2**63 - 1
