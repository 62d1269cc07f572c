"""Operators on texts against brute force over whole small tables and over odd rows."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from pairfold.llm import decontaminate, jaccard, language, licences, lm, mixing, quality, queries, substrings, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, name string, chunk long, n int, part int, of long"
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a very strange potion "


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [words(60) for _ in range(6)]
    near = base[0].split()
    texts = [None, "", "   \n\t ", "one", "One", "two words", words(120_000), PASSAGE * 3, words(20) + PASSAGE, PASSAGE + words(4), *base]
    for k in range(8):
        x = list(near)
        x[-1 - k] = f"changed{k}"
        texts.append(" ".join(x))
    texts += [base[1], base[1], base[1].upper(), "größe übung " * 12 + words(10), words(10) + " größe übung" * 12, "a\x00b " * 20, "🙂" * 40, "x🙂" * 40]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s", "s", "t", None]), 7, "k", "n", 1, 2, 3, 4) for k, t in enumerate(texts)]
    rows += [(None, base[2], None, None, None, None, None, None, None, None, None), (3, "one", "en", "s", 3, "k", "n", 1, 2, 3, 4), rows[12], rows[12], (14, base[4] + " differs", "en", "s", 1, "k", "n", 1, 2, 3, 4)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module", params=["odd", "docs"])
def texts(request):
    df = request.getfixturevalue(request.param)
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(params=[1, 2])
def levels(request, monkeypatch):
    """The exchange of names in one level, and in two with several ranges, groups and chunks."""
    from pairfold.llm import chunks

    if request.param == 2:
        monkeypatch.setattr(chunks, "ranges_for", lambda n_bytes: chunks.Ranges(3, 4, 3))
        for module in (lm, jaccard, substrings):
            monkeypatch.setattr(module, "ranges_for", chunks.ranges_for)
        monkeypatch.setattr(chunks, "CHUNK_BYTES", 1 << 20)
    return request.param


def test_ranges():
    from pairfold.llm import chunks

    assert chunks.ranges_for(0) == chunks.Ranges(8)
    for size in (1 << 30, 1 << 40, 100 << 40):
        r = chunks.ranges_for(size)
        assert size / chunks.RANGE_BYTES <= r.first * r.second <= 1.1 * size / chunks.RANGE_BYTES + 8
        assert (size / chunks.CHUNK_BYTES) * r.first < 1.1e11


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def roots(n, pairs):
    root = list(range(n))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[of(a)] = of(b)
    return [of(x) for x in range(n)]


def test_packed_numbers():
    import numpy as np

    from pairfold.llm import chunks

    rng = np.random.default_rng(2)
    for values in ([], [5], [-7, 2**62], [0] * 10 + [2**40], [1, 2, 3], rng.integers(0, 3, 1000), rng.integers(-(2**60), 2**60, 300), np.r_[rng.integers(0, 200, 5000), [70_000, 2**50, 300]], np.r_[np.arange(255), 256]):
        values = np.array(values, dtype=np.int64)
        assert chunks.unpack_ints(chunks.pack_ints(values)).tolist() == values.tolist()
        names = np.unique(values.view(np.uint64))
        assert chunks.unpack_names(chunks.pack_names(names)).tolist() == names.tolist()


def test_jaccard_equals_all_pairs(texts, levels):
    df, rows = texts
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    least = {}
    for (key, _), r in zip(rows, root, strict=True):
        if key is not None:
            least[r] = min(least.get(r, key), key)
    want = sorted(((k, len(s), least.get(r) if s else k) for (k, _), s, r in zip(rows, sets, root, strict=True)), key=repr)
    assert rows_of(jaccard.similar(df), "doc_id", "n_shingles", "component_id") == want


def test_jaccard_long_lists(spark):
    """One shingle list of several thousand sets: chains, copies, and sets that share too little."""
    rng = random.Random(1)
    core = [f"c{k}" for k in range(40)]
    texts = []
    for k in range(700):
        w = list(core)
        for at in rng.sample(range(40), rng.choice([0, 1, 1, 2, 6])):
            w[at] = f"x{rng.randrange(30)}"
        texts.append(" ".join(w + [f"y{k % 9}"] * rng.choice([0, 3])))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    root = roots(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    least = {}
    for k, r in enumerate(root):
        least.setdefault(r, k)
    assert rows_of(jaccard.similar(df), "doc_id", "component_id") == sorted(((k, least[r]) for k, r in enumerate(root)), key=repr)


def test_jaccard_representatives(odd):
    comps = {(r.doc_id): r.component_id for r in jaccard.similar(odd).collect()}
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    assert max(got.values()) == 1
    assert {k for k, _ in got} == {None} | {k for k, c in comps.items() if k == c}


def test_substrings_equal_brute_force(texts, levels):
    df, rows = texts
    last = 2**63 - 1
    least = {}
    for key, text in rows:
        b, k = (text or "").encode(), last if key is None else key
        for at in range(len(b) - 49):
            w = b[at : at + 50]
            if least.get(w, last + 1) > k:
                least[w] = k
    want = []
    for key, text in rows:
        b, k = (text or "").encode(), last if key is None else key
        mark = bytearray(len(b))
        for at in range(len(b) - 49):
            if least[b[at : at + 50]] < k:
                mark[at : at + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for at in range(len(b)) if mark[at] and not (at and mark[at - 1]))
        want.append((key, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))

    def digest(body, starts, ends):
        body = body or b""
        kept = substrings.without_spans(body, starts, ends)
        return len(body), len(body) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()

    got = substrings.repeats(df, digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert rows_of(got, "key", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_windows_of_many_short_runs_are_named_together(monkeypatch):
    body = np.random.default_rng(3).integers(0, 4, 400_000, dtype=np.uint8)
    first = np.arange(0, 399_000, 97)
    last = first + np.arange(len(first)) % 60  # some runs overlap
    want_places = np.concatenate([np.arange(a, z + 1) for a, z in zip(first, last, strict=True)])
    every = substrings.identifiers(body, (32,))[32]
    calls, named = [], substrings.identifiers
    monkeypatch.setattr(substrings, "identifiers", lambda b, sizes: calls.append(len(b)) or named(b, sizes))
    places, names = substrings._windows(body, first, last, 50)
    assert np.array_equal(places, want_places) and np.array_equal(names, substrings.mix(every[places], every[places + 18]))
    assert len(calls) <= 400_000 // substrings.BLOCK + 1 and max(calls) < 2 * substrings.BLOCK


def test_substrings_across_blocks(spark):
    """Very long texts are named block by block; repeats may lie across the blocks' ends."""
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a = make(200_000)
    b = make(65_000) + a[64_000:64_050] + make(400) + a[130_900:131_500] + make(70_000) + a[:49] + make(90) + "ab" * 400
    c = "ab" * 300 + make(10) + b[-850:-700] + make(60)
    rows = [(1, a), (2, b), (3, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.deduplicated(df).collect()}
    seen, want = {}, {}
    for k, t in rows:
        mark = [False] * len(t)
        for at in range(len(t) - 49):
            if seen.setdefault(t[at : at + 50], k) < k:
                mark[at : at + 50] = [True] * 50
        want[k] = "".join(x for x, m in zip(t, mark, strict=True) if not m)
    assert got == want and len(want[2]) < len(b) and len(want[3]) < len(c)


def test_decontamination_equals_brute_force(spark, texts):
    df, rows = texts
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "..."), (903, "two WORDS"), (904, PASSAGE), (905, PASSAGE), (None, "one"), (906, "größe übung")]
    fold = lambda t: bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in (t or "").encode()).split()
    windows = collections.defaultdict(set)
    for name, text in items:
        w = fold(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1) if size else ():
            windows[tuple(w[k : k + size])].add("null" if name is None else str(name))
    sizes = sorted({len(w) for w in windows})
    want = []
    for key, text in rows:
        w, found = fold(text), set()
        hit = [False] * len(w)
        for size in sizes:
            for k in range(len(w) - size + 1):
                if names := windows.get(tuple(w[k : k + size])):
                    hit[k : k + size] = [True] * size
                    found |= names
        want.append((key, len(w), sum(hit), tuple(sorted(found))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for max_bytes in (32 << 20, 3000):  # one broadcast, or several passes
        got = decontaminate.with_overlaps(df, bench, 10, max_bytes=max_bytes).withColumn("hit", decontaminate.n_hit())
        assert sorted(((r.doc_id, r["__overlap"].n_words, r.hit, tuple(r["__overlap"]["items"])) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert decontaminate.with_overlaps(df, bench.limit(0), 10).where("size(__overlap.starts) > 0").count() == 0
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(1 for w in want if not w[2])


def lm_brute(rows, train, order, steps=60):
    """Deleted interpolation with plain dictionaries; estimates are not rounded for the EM."""
    seqs = [[*words(t), None] for _, t in rows]
    gram = lambda s, k, n: tuple(s[k - n + 1 : k + 1]) if k + 1 >= n else ("<", *s[: k + 1])
    grams = lambda s: [[gram(s, k, n) for n in range(1, order + 1)] for k in range(len(s))]
    made = [grams(s) for s in seqs]
    counts = [collections.Counter() for _ in range(order)]
    for g, ok in zip(made, train, strict=True):
        if ok:
            for token in g:
                for n in range(order):
                    counts[n][token[n]] += 1
    total, texts, distinct = sum(counts[0].values()), sum(train), len(counts[0])
    bucket = lambda h: 0 if h <= 0 else h.bit_length()

    def estimates(g, k, minus, size, n_texts):
        """(count, context count) of each order at token k."""
        out = []
        for n in range(order):
            c = counts[n][g[k][n]] - minus[n][g[k][n]]
            h = total - size if n == 0 else n_texts if k == 0 else counts[n - 1][g[k - 1][n - 1]] - minus[n - 1][g[k - 1][n - 1]]
            out.append((c, h))
        return out

    cells = collections.defaultdict(collections.Counter)
    nothing = [collections.Counter() for _ in range(order)]
    for g, ok in zip(made, train, strict=True):
        if ok:
            own = [collections.Counter(token[n] for token in g) for n in range(order)]
            for k in range(len(g)):
                e = estimates(g, k, own, len(g), texts - 1)
                cells[bucket(e[-1][1])][1 / (distinct + 1), *(c / h if h > 0 else 0.0 for c, h in e)] += 1

    def em(cell):
        w = [1 / (order + 1)] * (order + 1)
        for _ in range(steps):
            r = [0.0] * (order + 1)
            for p, n in cell.items():
                x = [a * b for a, b in zip(p, w)]
                r = [a + n * b / max(sum(x), 1e-300) for a, b in zip(r, x)]
            w = [max(a / sum(r), 1e-7) for a in r]
            w = [a / sum(w) for a in w]
        return w

    whole = collections.Counter()
    for c in cells.values():
        whole.update(c)
    weights = {b: em(c) for b, c in cells.items()}
    rest = em(whole) if whole else [1 / (order + 1)] * (order + 1)
    out = []
    for (key, _), s, g in zip(rows, seqs, made, strict=True):
        score = base = 0.0
        for k in range(len(s)):
            e = estimates(g, k, nothing, 0, texts)
            a = weights.get(bucket(e[-1][1]), rest)
            p = a[0] / (distinct + 1) + sum(w * c / h for w, (c, h) in zip(a[1:], e) if h > 0)
            score += math.log10(p if total else 1 / (distinct + 1))
            base += math.log10((e[0][0] + 1) / (total + distinct + 1))
        out.append((key, len(s), sum(counts[0][w,] > 0 for w in s), total, base, score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [2, 3])
def test_lm_equals_brute_force(texts, order, levels):
    df, rows = texts
    train = [k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for k, _ in rows]
    from pyspark.sql import functions as F

    from pairfold.llm.common import crc_mod

    flag = (crc_mod("doc_id", 7) != 2) & F.col("doc_id").isNotNull()
    got = rows_of(lm.score(df, flag, order), "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = lm_brute(rows, train, order)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (repr(r[0]), r[1:3], round(r[4], 3))), sorted(want, key=lambda r: (repr(r[0]), r[1:3], round(r[4], 3))), strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], rel=0.01)


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = queries.op1_lm_scoring(spark, SF)
    a, b = got.where("held_out").groupBy().sum("score", "base_score").first()
    assert a > b


def test_lm_without_training(odd):
    from pyspark.sql import functions as F

    assert lm.score(odd, F.lit(None).cast("boolean")).where("score <> 0 OR n_known <> 0 OR train_tokens <> 0").count() == 0


def test_token_counts_equal_the_library(spark, texts):
    import public_tokenizers
    import sentencepiece

    df, rows = texts
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((k, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for k, t in rows), key=repr)
    assert rows_of(tokens.count_tokens(df, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_counts_of_random_strings():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Counter(tokens.read_pieces(path))
    rng = random.Random(11)
    alphabets = ["ab ", "aeiou nrst", "\n \t", "▁ a", "äöüß éè", "中文字 ", "<s></s><unk>", "0123456789.,", "🙂👍🏽 x", "aaaa", "=-_#*", "\x00\x01 a", "مرحبا ", "<0x0A>"]
    made = ["".join(rng.choice(rng.choice(alphabets[:k] or alphabets)) for _ in range(rng.randrange(40))) for k in range(len(alphabets)) for _ in range(120)]
    assert counter.texts(made) == [len(x) for x in library.encode(made)]


def test_token_counts_of_long_words():
    """Text without spaces is one pre-token; it is merged in few rounds and not kept."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, counter = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Counter(tokens.read_pieces(path))
    rng = random.Random(12)
    made = ["".join(rng.choice("etaoinshrdlu") for _ in range(60_000)), "ab" * 40_000, "aaab" * 10_001, "the" * 20_000 + " end", "=" * 30_011]
    assert counter.texts(made) == [len(x) for x in library.encode(made)]
    assert all(len(w) <= tokens.LONGEST_KNOWN for w in counter.known)


def test_token_counts_with_a_small_table(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    merges = tokens.read_pieces(path)
    made = [f"word{k} and {k * 7} others" for k in range(300)]
    whole = tokens.Counter(merges).texts(made)
    monkeypatch.setattr(tokens, "KNOWN_CHARS", 100)
    counter = tokens.Counter(merges)
    assert [counter.texts([t])[0] for t in made] == whole


def auc(rows):
    order = sorted(rows)
    ranks, k = {}, 0
    pos = sum(y for _, y in rows)
    total = 0.0
    for _, same in itertools.groupby(order, key=lambda r: r[0]):
        same = list(same)
        total += sum(y for _, y in same) * (k + (len(same) + 1) / 2)
        k += len(same)
    del ranks
    return (total - pos * (pos + 1) / 2) / (pos * (len(rows) - pos))


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality(spark, sf)
    assert got.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.5)").count() == 0
    joined = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality IS NOT NULL")
    assert auc([(r.score, r.quality) for r in joined.collect()]) > 0.85
    assert rows_of(queries.op7_quality(spark, sf), "doc_id", "score") == rows_of(got, "doc_id", "score")


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (4, 1), (4, 7)], "doc_id long, quality int")
    trees = quality.learn(odd, labels)
    got = quality.classify(odd, trees)
    assert got.count() == odd.count() and got.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    assert quality.accepted(odd, trees).columns == odd.columns
    assert {r.score for r in quality.classify(odd, quality.learn(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.classify(none, trees).count() == 0 and quality.accepted(none, trees).count() == 0


def test_quality_of_one_hot_document(spark, monkeypatch):
    """A labelled doc_id with a third of all rows: its rows go to the fit once with their count, and never over the bound."""
    import numpy as np

    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, weight: seen.append((x, y, weight)) or fit(x, y, weight=weight))
    rows = [(k, f"text {k} " * (k % 7 + 1)) for k in range(200)] + [(200, "hot text")] * 3000 + [(200, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, k % 2) for k in range(201)] + [(200, 1)], "doc_id long, quality int")
    trees = quality.learn(docs, labels)
    x, y, n = seen[0]
    assert len(x) == 204 and sorted(n)[-5:] == [1, 5, 5, 3000, 3000] and n.sum() == 200 + 2 * 3005
    repeated = fit(np.repeat(x, n.astype(int), axis=0), np.repeat(y, n.astype(int)))
    assert trees.score(x) == pytest.approx(repeated.score(x), rel=1e-6)
    distinct = docs.unionByName(spark.createDataFrame([(200, f"another hot text {k}") for k in range(900)], docs.schema))
    quality.learn(distinct, labels, sample=150)
    quality.learn(distinct.repartition(3), labels, sample=150)
    assert len(seen[1][0]) <= 150 and all(np.array_equal(a, b) for a, b in zip(seen[1], seen[2], strict=True))


def test_trees_equal_a_plain_traversal():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    trees = quality.fit(x, y, rounds=20)
    got = trees.score(x)
    for row, s in zip(x[:50], got[:50], strict=True):
        margin = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            margin += leaf[at - len(f)]
        assert s == pytest.approx(1 / (1 + math.exp(-margin)))
    assert ((got >= 0.5) == y).mean() > 0.97


def plain_boosting(x, y, rounds, depth, rate, bins, smooth, least):
    """Boosted trees with one threshold tried after the other; scores of the rows fitted to."""
    import numpy as np

    n = len(y)
    share = sum(y) / n
    margin = [math.log(share / (1 - share))] * n
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for f in range(x.shape[1])]
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        groups = [list(range(n))]
        for _ in range(depth):
            split = []
            for rows in groups:
                best = (1e-9, None)
                if len(rows) >= 2 * least:
                    gain_of = lambda r: sum(g[i] for i in r) ** 2 / (sum(h[i] for i in r) + smooth)  # noqa: B023, E731
                    for f, values in enumerate(cuts):
                        for c in values:
                            left, right = [i for i in rows if x[i, f] <= c], [i for i in rows if x[i, f] > c]
                            if len(left) >= least and len(right) >= least:
                                gain = gain_of(left) + gain_of(right) - gain_of(rows)
                                if gain > best[0] + 1e-12:
                                    best = (gain, (left, right))
                split += best[1] or (rows, [])
            groups = split
        for rows in groups:
            step = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + smooth)
            for i in rows:
                margin[i] += step
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_boosting_equals_plain_loops():
    import numpy as np

    rng = np.random.default_rng(14)
    x = np.c_[rng.normal(size=(160, 3)), rng.integers(0, 4, 160)]
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 1) ^ (rng.random(160) < 0.1)).astype(float)
    trees = quality.fit(x, y, rounds=6, depth=3, rate=0.3, bins=12, smooth=1.0, least=8)
    assert trees.score(x) == pytest.approx(plain_boosting(x, y.tolist(), 6, 3, 0.3, 12, 1.0, 8), rel=1e-9)


def test_quality_labels_with_clashing_columns(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    from pyspark.sql import functions as F

    wide = labels.withColumns({c: F.lit("x") for c in ("text", "source", "key", "x", "__label", "__of", "__key")})
    assert rows_of(quality.classify(docs, quality.learn(docs, wide)), "doc_id", "score") == rows_of(quality.classify(docs, quality.learn(docs, labels)), "doc_id", "score")


def test_language_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 40")
    rows = got.where("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 50 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert got.where("score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0


def test_language_odd_rows(odd, none):
    known = language.learn(odd)
    assert list(known) == ["de", "en"]
    got = language.identify(odd, known)
    assert got.count() == odd.count()
    assert {r.lang_pred for r in got.join(odd.where("text IS NULL OR trim(text) = ''").select("doc_id"), "doc_id").collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.learn(none) == {} and language.identify(none, known).count() == 0


def test_language_distance_is_out_of_place():
    """The distance against a plain count of places."""
    known = {"x": [3, 1, 2, 9], "y": [1, 2, 3, 4]}
    p = language.Profiles(known, 3)
    counts = collections.Counter(itertools.chain.from_iterable(g.tolist() for g in language.grams(language.letters("ab ba"))))
    assert counts and p.of("ab ba") == ("x", 0.0) and p.of("...") == ("und", 0.0)


def language_brute(known, profile, text):
    """Distances by plain dictionaries; n-grams of equal count go by their best place in any language, then by key."""
    best = {}
    for x in known.values():
        for place, g in enumerate(x):
            best[g] = min(place, best.get(g, place))
    n = collections.Counter(g for keys in language.grams(language.letters(text)) for g in keys.tolist() if g not in (0x20, 0x2020))
    top = sorted(n, key=lambda g: (-n[g], best.get(g, 1 << 40), g))[:profile]
    away = {}
    for lang, x in known.items():
        places = {g: place for place, g in enumerate(x[:profile])}
        away[lang] = sum(abs(places[g] - k) if g in places else profile for k, g in enumerate(top))
    lang = min(away, key=away.get)
    return lang, 1 - away[lang] / (profile * len(top))


def test_language_query_equals_brute_force(spark):
    """Profiles and distances of a whole table with plain dictionaries."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None and r.text is not None:
            counts[r.lang].update(g for keys in language.grams(language.letters(r.text)) for g in keys.tolist() if g not in (0x20, 0x2020))
    known = {lang: sorted(n, key=lambda g: (-n[g], g))[:1500] for lang, n in sorted(counts.items())}
    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op5_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = language_brute(known, 400, r.text) if r.text is not None and language.LETTER.search(r.text) else ("und", 0.0)
        assert got[r.doc_id][0] == want[0] and got[r.doc_id][1] == pytest.approx(want[1], abs=1e-12)


def test_language_counts_in_parts(spark, odd, monkeypatch):
    """Counts that leave a task in several parts."""
    whole = language.learn(odd)
    monkeypatch.setattr(language, "HELD", 50)
    assert language.learn(odd) == whole


@pytest.mark.parametrize("languages", [4, 60, 1000])
def test_language_of_many_languages(languages):
    """1000 languages of 1500 n-grams each, mostly disjoint: more n-grams than 16 bits number, more places than a table holds."""
    rng = random.Random(3)
    alphabets = ["abcdefghijklm", "nopqrstuvwxyz", "abcnopäöüß"]  # of over 1500 n-grams each
    texts = [" ".join("".join(rng.choice(x) for _ in range(rng.randrange(1, 8))) for _ in range(size)) for x in alphabets for size in (1, 30, 900)]
    # Byte triples over 0xC0 stand in no text; each language but the last three has its own.
    known = {f"l{k:04}": list(range(0xC00000 + 1500 * k, 0xC00000 + 1500 * (k + 1))) for k in range(languages - 3)}
    for k, alphabet in enumerate(alphabets):
        seen = collections.Counter(g for keys in language.grams(language.letters(" ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(4000)))) for g in keys.tolist())
        known[f"z{k}"] = [g for g, _ in seen.most_common(1500)]
        assert len(known[f"z{k}"]) == 1500 or k == 2
    profiles = language.Profiles(known, 400)
    for k, text in enumerate(texts):
        got, want = profiles.of(text), language_brute(known, 400, text)
        assert got[0] == want[0] == f"z{k // 3}" and got[1] == pytest.approx(want[1], abs=1e-12)
    assert profiles.of("ÿ 漢字") == language_brute(known, 400, "ÿ 漢字")


def test_licences(spark, odd, none):
    rows = [
        (1, "Intro. Licensed under the Apache License, Version 2.0. More"), (2, "Released under the MIT License."), (3, None), (4, ""), (5, "nothing here"),
        (6, "Licensed under CC BY-SA 4.0.\nReleased under the MIT License"), (7, " ".join(licences.SENTENCES["grant"] + licences.SENTENCES["notice"])), (8, "Released   under the mit LICENSE!!"),
    ]
    got = {r.doc_id: (list(r.sentence_ids), r.licence, list(r.licences)) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == (["mit-short"], "MIT", ["MIT"]) == got[8]
    assert got[3] == got[4] == got[5] == ([], None, [])
    assert got[6][1:] == ("CC-BY-SA-4.0", ["CC-BY-SA-4.0", "MIT"]) and got[7][1] == "MIT" and got[1][1] == "Apache-2.0"
    assert licences.scan(odd).count() == odd.count() and licences.scan(none).count() == 0


WRAPPED = {
    "MIT": "MIT License\n\nCopyright (c) 2020 A. Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\"",
    "BSD-3-Clause": "Copyright (c) 2020, A. Body\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\nTHIS SOFTWARE",
    "Apache-2.0": "Copyright 2020 A. Body\n\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law",
    "ISC": "Copyright (c) 2020, A. Body\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@pytest.mark.parametrize("before, between, after", [("", "", ""), ("# ", "# ", ""), ("/*\n * ", " * ", "\n */\nint x;"), ("// ", "// ", ""), ("; ", "; ", ""), ("REM ", "REM ", ""), ("<!--\n", "  ", "\n-->")])
@pytest.mark.parametrize("line", ["\n", "\r\n"])
def test_licences_of_wrapped_texts(spark, before, between, after, line):
    made = {name: (before + text.replace("\n", "\n" + between) + after).replace("\n", line) for name, text in WRAPPED.items()}
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(made.items()), "doc_id string, text string")).collect()}
    assert {k: r.licence for k, r in got.items()} == {k: k for k in WRAPPED}
    assert list(got["Apache-2.0"].sentence_ids) == ["apache2-short", "apache2-may-not", "apache2-copy"]
    assert list(got["BSD-3-Clause"].sentence_ids) == ["redistribution", "source-form", "binary-form", "no-endorsement"]


def test_every_known_licence_sentence_is_found_at_any_width(spark):
    import textwrap

    rows = [(name, textwrap.fill(s, width)) for name, group in licences.SENTENCES.items() for s in group for width in (20, 72, 2000)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [list(r.sentence_ids) for r in got] == [[name] for name, _ in rows]


def test_licence_sentences_end(spark):
    rows = [
        (1, "Licensed under the\n\nMIT License."), (2, "Not licensed under the MIT License."), (3, "Licensed under. The MIT License."), (4, "no full stop\nLicensed under CC BY-NC 4.0\nmore"),
        (5, "Licensed under the MIT License. " * 3), (6, "a.\n" * 50_000 + "\n" * 50_000 + "Released under\nthe MIT License."), (7, "Licensed under the MIT License of old."), (8, "Licensed under the\n***\nMIT License."),
    ]
    got = {r.doc_id: list(r.sentence_ids) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [], 4: ["cc-by-nc-4"], 5: ["mit-short"] * 3, 6: ["mit-short"], 7: [], 8: []}


def test_licence_scan_equals_its_sql(spark):
    import duckdb

    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
        want = con.execute(queries.ORACLES["op6_licence_scan"]).fetchall()
        got = queries.op6_licence_scan(spark, f"/root/testdata/{sf}").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_licence_scan_of_wrapped_texts_equals_its_sql(spark, tmp_path):
    import duckdb

    rng = random.Random(21)
    known = list(licences.all_sentences())
    texts = [before + text.replace("\n", line + between) for text in WRAPPED.values() for before, between in (("", ""), ("# ", "# "), (" * ", " *  "), ("REM ", "REM ")) for line in ("\n", "\r\n", "\r")]
    for _ in range(300):  # pieces of licences between odd lines
        parts = [rng.choice([*known, "1) ", "rem", "dnl  ", "(c) 2020", "", "...", "v. 2.0; the", "a)", "-----"]) for _ in range(rng.randrange(1, 9))]
        text = "".join(x + rng.choice(["\n", " ", ". ", "\n\n", "; ", "\n# ", "\t", "\n 1) "]) for x in parts)
        texts.append("".join(c if rng.random() > 0.02 else rng.choice("\n .") for c in text))
    rows = [(k, t) for k, t in enumerate([*texts, None, "", "\n", "P", "L S"])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op6_licence_scan"]).fetchall()
    got = queries.op6_licence_scan(spark, str(tmp_path)).collect()
    assert sum(r.n_sentences for r in got) > 300
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_mixing_takes_near_its_targets(texts, none):
    df, rows = texts
    got = mixing.systematic_copies(df).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 2 * max(r.size for r in mine) + 1
    everything = sum(r.size for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * everything)
    again = mixing.systematic_copies(df.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "copy"] and mixed.count() == sum(r.copies for r in got)
    assert mixing.systematic_copies(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_keeps_rows_that_differ(spark):
    """Rows of one doc_id and text in several sources, or with other columns that differ, stay documents of their own."""
    text = "some words of one text"
    rows = [(k % 5 or None, text if k % 3 else None, s, lang, [None, k % 2] if lang else None) for k in range(60) for s in ("a", "b", None) for lang in ("en", None)]
    rows += [(7, None, "a", "x", [1, None]), (7, None, "a", None, [None, 1]), (7, "x", "a", None, [1, None])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, more array<int>").repartition(6)
    want = collections.Counter()
    for r in mixing.systematic_copies(df, tie=mixing.row_hash(df)).collect():
        want[r.key, r.source, r.size] += r.copies
    mixed = mixing.mix(df).collect()
    got = collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in mixed)
    assert got == +want
    of_row = collections.Counter((r.doc_id, r.text, r.source, r.lang, str(r.more)) for r in mixed)
    there = collections.Counter((d, t, s, lang, str(m)) for d, t, s, lang, m in rows)
    assert all(n <= 2 * there[k] for k, n in of_row.items())
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixed))


def test_empty_tables(none, spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert jaccard.similar(none).count() == 0 and jaccard.representatives(none).count() == 0
    assert substrings.deduplicated(none).count() == 0
    assert decontaminate.clean_documents(none, bench).count() == 0
    from pyspark.sql import functions as F

    assert lm.score(none, F.lit(True)).count() == 0
    import public_tokenizers

    assert tokens.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
